"""Choosing records so that each source supplies its target share of the total size.

Weights run down a tree domain - language - source. A source can supply at most ``max_repeats`` times its size; what it
lacks is taken over by the sources of the same domain and language in proportion to their weights, then by the other
languages of the domain, then by all domains. Each source then takes whole epochs and a prefix, by a seeded order, of one
more, whose last record is taken if that brings the size nearer to the budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webrank.plans.session import materialize


def water_fill(amount: float, weights: list[float], rooms: list[float]) -> list[float]:
    """Shares of ``amount`` in proportion to ``weights``, none above its room; what is cut off goes to the others."""
    out = [0.0] * len(weights)
    open_ = [i for i in range(len(weights)) if weights[i] > 0 and rooms[i] > 0]
    left = amount
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if out[i] + left * weights[i] / total >= rooms[i] - 1e-9]
        if not full:
            for i in open_:
                out[i] += left * weights[i] / total
            break
        for i in full:
            left -= rooms[i] - out[i]
            out[i] = rooms[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def budgets(leaves: list[tuple[tuple[str, ...], float, float]], total: float, depth: int = 0) -> list[float]:
    """Budget of each ``(path, weight, room)`` leaf out of ``total``.

    Every node first asks for its weight's part. A node whose leaves can't supply it leaves the rest to its siblings at the
    level above, after its own children have shared it out among themselves.
    """
    if len(leaves) == 1 or depth >= len(leaves[0][0]):
        return water_fill(total, [w for _, w, _ in leaves], [r for _, _, r in leaves])
    groups: dict[str, list[int]] = {}
    for i, (path, _, _) in enumerate(leaves):
        groups.setdefault(path[depth], []).append(i)
    names = sorted(groups)
    parts = water_fill(total, [sum(leaves[i][1] for i in groups[g]) for g in names], [sum(leaves[i][2] for i in groups[g] if leaves[i][1] > 0) for g in names])
    out = [0.0] * len(leaves)
    for g, part in zip(names, parts):
        for i, b in zip(groups[g], budgets([leaves[i] for i in groups[g]], part, depth + 1)):
            out[i] = b
    return out


def mix_sources(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(choice, shares)`` from ``sizes(doc_id, source, lang, n_tokens)`` and ``targets(source, target_share, max_repeats)``.

    ``choice`` is ``(source, doc_id, n_tokens, repeats)`` of the records used, ``shares`` tells for each target source its
    target, budget, tokens and share reached. ``total`` is the wanted size, by default that of all records with a target.
    Records without a target source are left out; a record's repeated rows count once. A target listed twice counts with
    its greatest share and repeats; null shares or repeats count as 0. The language of a source is its commonest, the domain the first
    label of its name. Only one row of totals for each target source comes to the driver, which holds the targets anyway.
    """
    goal = targets.where("source is not null").groupBy("source").agg(
        F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats")
    )
    docs = sizes.where("doc_id is not null and source is not null and n_tokens is not null").groupBy("doc_id").agg(
        F.max(F.struct("source", "lang", "n_tokens")).alias("x")
    ).select("doc_id", "x.*")
    docs = materialize(docs.join(goal.select("source"), "source", "left_semi"))
    langs = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    per = langs.groupBy("source").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"), F.sum("t").alias("t"))
    rows = goal.join(per, "source", "left").orderBy("source").collect()
    spark = sizes.sparkSession
    leaves = [((r.source.split(".")[0], r.lang or ""), float(r.target_share), float((r.t or 0) * r.max_repeats)) for r in rows]
    total = sum(r.t or 0 for r in rows) if total is None else total
    given = budgets(leaves, float(total)) if leaves else []
    plan = [
        (r.source, r.lang, float(r.target_share), int(r.max_repeats), int(r.t or 0), int(b), min(int(b // r.t), r.max_repeats) if r.t else 0)
        for r, b in zip(rows, given)
    ]
    schema = "source string, lang string, target_share double, max_repeats int, available bigint, budget bigint, epochs int"
    plan_df = spark.createDataFrame(plan, schema).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))
    order = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))
    ordered = docs.drop("lang").join(F.broadcast(plan_df.select("source", "epochs", "rest")), "source")  # the driver's own rows
    ordered = ordered.withColumn("o", order).withColumn("bucket", F.shiftrightunsigned("o", 54))
    sums = ordered.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("bt"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bt").over(before), F.lit(0)))
    joined = ordered.join(sums, ["source", "bucket"])
    whole = joined.where("before + bt <= rest").select("source", "doc_id", "n_tokens", "epochs", F.lit(1).alias("extra"))
    inner = Window.partitionBy("source", "bucket").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = joined.where("before + bt > rest and before < rest").withColumn("upto", F.col("before") + F.sum("n_tokens").over(inner))
    edge = edge.select("source", "doc_id", "n_tokens", "epochs", (F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest")).cast("int").alias("extra"))
    late = joined.where("before + bt > rest and before >= rest").select("source", "doc_id", "n_tokens", "epochs", F.lit(0).alias("extra"))
    repeats = (F.col("epochs") + F.col("extra")).alias("repeats")
    choice = whole.unionByName(edge).unionByName(late).select("source", "doc_id", "n_tokens", repeats).where("repeats > 0")
    used = choice.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("repeats"))
    shares = plan_df.join(used, "source", "left").select(
        "source", "lang", "target_share", "max_repeats", "available", "budget", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("repeats", F.lit(0)).alias("repeats")
    )
    sum_all = shares.agg(F.sum("tokens").alias("all_tokens"))
    shares = shares.join(F.broadcast(sum_all)).withColumn("share", F.when(F.col("all_tokens") > 0, F.round(F.col("tokens") / F.col("all_tokens"), 6))).drop("all_tokens")
    return choice, shares
