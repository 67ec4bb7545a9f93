"""Link analysis by repeated rank transfer (PRK1, JOI3, SET4, MTH5, MTH6, AGG6, AGG7)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrank.plans.session import materialize, release

DAMPING = 0.85


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, rounds: int | None = None, tolerance: float = 1e-4, metric: str = "abs") -> DataFrame:
    """``(url, rank)`` of the ``nodes`` that have a link out or a link in from another node.

    ``edges(src, dst)`` count once each; links to targets outside ``nodes`` take their share of the rank but carry it nowhere.
    Every rank starts at 1 and becomes 0.15 + the sum of 0.85 * rank / links of those that link to it. Runs ``rounds`` rounds,
    or until the greatest change is below ``tolerance``, which must be positive; with ``metric="signed"`` only increases count. The edges carry their
    weight from the start and are stored once; each round joins ranks to them, sums per target (combined before the shuffle)
    and is written out, so the plan stays one round long. Without ``nodes`` all sources are nodes.
    """
    if metric not in ("abs", "signed"):
        raise ValueError(f"unknown metric {metric!r}")
    if rounds is None and not tolerance > 0:
        raise ValueError("tolerance must be positive")
    links = materialize(edges.where("src is not null and dst is not null").distinct())
    inside = (nodes.toDF("url") if nodes is not None else links.select(F.col("src").alias("url"))).where("url is not null").distinct()
    links = links.join(inside.withColumnRenamed("url", "src"), "src", "left_semi")
    fan_out = links.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    weighted = materialize(links.join(fan_out, "src").join(inside.withColumnRenamed("url", "dst"), "dst", "left_semi").select("src", "dst", (F.lit(DAMPING) / F.col("n")).alias("w")))
    members = fan_out.select(F.col("src").alias("url")).union(weighted.select("dst")).distinct()
    ranks = stored = materialize(members.select("url", F.lit(1.0).alias("rank")))
    for _ in range(rounds) if rounds is not None else count():  # changes shrink by the damping in every round
        share = weighted.join(ranks.withColumnRenamed("url", "src"), "src").groupBy("dst").agg(F.sum(F.col("w") * F.col("rank")).alias("sum"))
        new = ranks.join(share.withColumnRenamed("dst", "url"), "url", "left").select("url", F.col("rank").alias("prev"), (F.coalesce("sum", F.lit(0.0)) + (1 - DAMPING)).alias("rank"))
        new = materialize(new)
        release(stored)
        stored, ranks = new, new.select("url", "rank")
        if rounds is None:
            change = F.col("rank") - F.col("prev")
            greatest = new.agg(F.max(F.abs(change) if metric == "abs" else change).alias("c")).first()["c"]
            if greatest is None or greatest < tolerance:
                break
    return ranks
