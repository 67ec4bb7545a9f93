"""Groups of near-duplicate records: similarity join by the generalised pigeonhole principle.

Every record's shingle set becomes a signature of ``partitions * width`` minhash symbols of 32 bits. The bits of one symbol
agree or differ together, so correlated bits are grouped: ``width`` whole symbols form a partition, and a partition within
distance 0 of another record's means equal values. Two sets at the wanted similarity agree in at least ``agree``
partitions (but for a probability that :func:`miss_probability` gives), so a record may leave any ``agree - 1`` partitions
out and must probe all others: it leaves out the dearest, by the exact number of records that share the value.

How each value is probed is decided per partition. Values shared by at most the partition's threshold of records are probed alone. Values
shared by more are probed only two at a time, since a pair of records that has no rare value in common has two frequent ones in
common. The thresholds are unequal: every partition has a histogram of its values by the number of records, which tells for each
threshold how many candidate pairs single probes give and how many records hold frequent values; a dynamic programme over the partitions picks
the thresholds of least candidates among those that leave no more than ``FREQUENT_SHARE`` of all values to be probed two at a
time. Thresholds belong to values, not to records, so both records of a pair probe alike and none is lost. Pairs met
are checked by the Hamming distance of 256 one-bit minhashes in the join itself, and the rest by their exact sets.

Records with equal text are one class: only one of them takes part in the search. Nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrank.llm import hashing
from webrank.operators.skew import counted_join
from webrank.plans.session import materialize

SIGNATURE_BITS = 256
#: Share of all shared values that may be probed two at a time, and the steps in which the programme counts it.
FREQUENT_SHARE = 0.2
STEPS = 400


@dataclass(frozen=True)
class Plan:
    """How records are compared: shingle kind and size, similarity, and the partitions of the signature."""

    kind: str = "word"
    size: int = 5
    similarity: float = 0.8
    width: int = 5
    partitions: int = 48
    agree: int = 2


def miss_probability(plan: Plan) -> float:
    """Probability that two sets exactly at ``similarity`` are missed: they agree in fewer than ``agree`` partitions, or
    their one-bit minhashes are further apart than :func:`max_hamming`."""
    p, q, far = plan.similarity**plan.width, (1 - plan.similarity) / 2, max_hamming(plan)
    few = sum(math.comb(plan.partitions, i) * p**i * (1 - p) ** (plan.partitions - i) for i in range(plan.agree))
    return few + sum(math.comb(SIGNATURE_BITS, i) * q**i * (1 - q) ** (SIGNATURE_BITS - i) for i in range(far + 1, SIGNATURE_BITS + 1))


def max_hamming(plan: Plan, deviations: float = 4.5) -> int:
    """Hamming distance of one-bit minhashes that a pair at ``similarity`` stays within, ``deviations`` above its mean."""
    p = (1 - plan.similarity) / 2
    return math.ceil(SIGNATURE_BITS * p + deviations * math.sqrt(SIGNATURE_BITS * p * (1 - p)))


def shingles(arr: pa.Array, kind: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each shingle, repeats included; ``kind`` is ``word`` or ``char``."""
    return (hashing.word_shingles if kind == "word" else hashing.char_shingles)(arr, size)


def _signatures(arr: pa.Array, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have shingles, their partition values and their one-bit minhashes as four 64-bit words."""
    hashes, rows = shingles(arr, plan.kind, plan.size)
    filled, starts = np.unique(rows, return_index=True)
    values = np.zeros((len(filled), plan.partitions), np.uint64)
    bits = np.zeros((len(filled), SIGNATURE_BITS), np.uint8)
    if len(filled):
        h32 = (hashes >> np.uint64(32)).astype(np.uint32)
        factors = np.random.default_rng(20240607).integers(0, 2**31, plan.partitions * plan.width + SIGNATURE_BITS)
        factors = (factors * 2 + 1).astype(np.uint32)
        for i, factor in enumerate(factors):
            low = np.minimum.reduceat(h32 * factor, starts)
            if i < plan.partitions * plan.width:
                g = i // plan.width
                values[:, g] = hashing.mix(values[:, g] * hashing.BASE + low.astype(np.uint64) + np.uint64(i + 1))
            else:
                bits[:, i - plan.partitions * plan.width] = hashing.mix(low.astype(np.uint64)) & np.uint64(1)
    words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    return filled, values.view(np.int64), words


def _signed(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                filled, values, words = _signatures(part.column("text"), plan)
                flat = pa.array(values.reshape(-1))
                offsets = pa.array(np.arange(len(filled) + 1, dtype=np.int32) * plan.partitions)
                cols = [part.column("id").take(pa.array(filled)), part.column("fp").take(pa.array(filled))]
                cols.append(pa.ListArray.from_arrays(offsets, flat))
                cols += [pa.array(np.ascontiguousarray(words[:, i])) for i in range(4)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "fp", "keys", "b0", "b1", "b2", "b3"])

    return run


def _verified(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = []
                for side in ("text_a", "text_b"):
                    h, r = shingles(part.column(side), plan.kind, plan.size)
                    sets.append(hashing.distinct_per_row(h, r))
                sizes = [np.bincount(r, minlength=part.num_rows) for _, r in sets]
                both = np.concatenate([hashing.mix(h + r.astype(np.uint64) * hashing.BASE) for h, r in sets])
                rows = np.concatenate([r for _, r in sets])
                order = np.argsort(both, kind="stable")
                twice = both[order][1:] == both[order][:-1]
                common = np.bincount(rows[order][1:][twice], minlength=part.num_rows)
                union = sizes[0] + sizes[1] - common
                good = (common > 0) & (common >= plan.similarity * union - 1e-9)
                out = part.select(["id_a", "id_b"]).append_column("common", pa.array(common.astype(np.int64)))
                yield out.append_column("union", pa.array(union.astype(np.int64))).filter(pa.array(good))

    return run


def histograms(counts: DataFrame) -> list[tuple[int, int, int, int]]:
    """``(g, bin, rows, candidates)`` of the values of each partition shared by 2**bin records or more, below twice as many:
    the records that hold them and the pairs they meet in. A few dozen rows per partition come to the driver."""
    n = F.col("n")
    cells = counts.groupBy("g", F.floor(F.log2(n.cast("double"))).cast("int").alias("bin"))
    rows = cells.agg(F.sum(n).alias("rows"), F.sum(n * (n - 1) / 2).cast("bigint").alias("candidates")).collect()
    return sorted((r.g, r.bin, r.rows, r.candidates) for r in rows)


def thresholds(cells: list[tuple[int, int, int, int]], partitions: int, share: float) -> list[int]:
    """The greatest number of records for which a value of each partition is probed alone.

    Of all choices that leave at most ``share`` of the rows to values above their partition's threshold, the one of fewest
    candidate pairs from values below: a knapsack over the partitions, rows counted up in ``STEPS`` steps of the room there is.
    """
    room = share * sum(r for _, _, r, _ in cells)
    top = 1 + max((b for _, b, _, _ in cells), default=0)
    # by partition, the (weight, cost) of each end bin: rows above it, candidates below it
    best = np.zeros(STEPS + 1)
    picks = []
    for g in range(partitions):
        mine = [(b, r, c) for h, b, r, c in cells if h == g]
        now, pick = np.full(STEPS + 1, np.inf), np.full(STEPS + 1, top)
        for end in range(1, top + 1):
            rows, cost = sum(r for b, r, _ in mine if b >= end), sum(c for b, _, c in mine if b < end)
            weight = math.ceil(rows * STEPS / room) if room > 0 else (0 if not rows else STEPS + 1)
            if weight <= STEPS:
                moved = np.full(STEPS + 1, np.inf)
                moved[weight:] = best[: STEPS + 1 - weight] + cost
                better = moved < now
                now, pick = np.where(better, moved, now), np.where(better, end, pick)
        best = now
        picks.append((pick, mine))
    at, out = STEPS, []
    for pick, mine in reversed(picks):
        end = int(pick[at])
        out.append((1 << end) - 1)
        rows = sum(r for b, r, _ in mine if b >= end)
        at -= math.ceil(rows * STEPS / room) if room > 0 else 0
    return out[::-1]


def records(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text, fp)`` of rows with an id and a text, ``fp`` the MD5 of the text."""
    return df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.md5(text_col).alias("fp")
    )


def representative_pairs(df: DataFrame, id_col: str, text_col: str, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``: pairs ``(id_a, id_b, common, union)`` of class representatives, and ``(id, rep)`` of all rows.

    A class holds the rows of equal text and is named by its least id. Rows with a null id or text take no part; texts with
    too few words for a shingle have an empty set and only their own class. Rows repeated with one id count once.
    """
    rows = records(df, id_col, text_col)
    signed = rows.mapInArrow(_signed(plan), "id bigint, fp string, keys array<bigint>, b0 bigint, b1 bigint, b2 bigint, b3 bigint")
    least = signed.groupBy("fp").agg(F.min(F.struct("id", "keys", "b0", "b1", "b2", "b3")).alias("r")).select("r.*")
    reps = materialize(least)
    tokens = reps.select("id", F.posexplode("keys").alias("g", "key"))
    counts = materialize(tokens.groupBy("g", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    if plan.agree > 1:
        ends = F.array(*[F.lit(x) for x in thresholds(histograms(counts), plan.partitions, FREQUENT_SHARE)])
        frequent = F.col("n") > F.get(ends, F.col("g"))
    else:
        frequent = F.lit(False)
    counts = counts.select("key", "n", frequent.alias("frequent"))
    # values that nobody shares can't meet; of the others the agree - 1 dearest of a record are left out
    shared = (
        counted_join(tokens.select("id", "key"), counts, ["key"], "n").where("n is not null")
        .groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key", "frequent"))).alias("t"))
        .where(F.size("t") >= plan.agree)
    )
    shared = materialize(shared)
    none = F.lit(0).cast("bigint")
    kept = F.slice("t", 1, F.size("t") - (plan.agree - 1))
    probes = shared.select("id", F.explode(F.filter(kept, lambda u: ~u["frequent"])).alias("p")).select("id", F.col("p.key").alias("k1"), none.alias("k2"))
    if plan.agree > 1:
        often = shared.select("id", F.filter("t", lambda u: u["frequent"]).alias("h")).where(F.size("h") > 1)
        later = lambda u, i: F.transform(F.slice(F.col("h"), i + 2, F.size("h")), lambda v: F.struct(F.least(u["key"], v["key"]).alias("k1"), F.greatest(u["key"], v["key"]).alias("k2")))
        probes = probes.unionByName(often.select("id", F.inline(F.flatten(F.transform("h", later)))))
    probes = probes.join(reps.select("id", "b0", "b1", "b2", "b3"), "id")
    a = probes.select(F.col("id").alias("id_a"), "k1", "k2", *[F.col(f"b{i}").alias(f"a{i}") for i in range(4)])
    b = probes.select(F.col("id").alias("id_b"), "k1", "k2", "b0", "b1", "b2", "b3")
    distance = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(1, 4)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    met = (
        a.join(b, ["k1", "k2"])
        .where((F.col("id_a") < F.col("id_b")) & (distance <= max_hamming(plan)))
        .select("id_a", "id_b")
        .distinct()
    )
    met = materialize(met)
    ids = met.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    texts = rows.join(ids, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
    left = texts.select(F.col("id").alias("id_a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("id_b"), F.col("text").alias("text_b"))
    both = met.join(left, "id_a").join(right, "id_b").select("id_a", "id_b", "text_a", "text_b")
    pairs = both.mapInArrow(_verified(plan), "id_a bigint, id_b bigint, common bigint, union bigint")
    return pairs, members(rows)


def members(rows: DataFrame) -> DataFrame:
    """``(id, rep)`` of :func:`records`: the least id of the records with the same text."""
    slim = rows.select("id", "fp").distinct()
    return slim.join(slim.groupBy("fp").agg(F.min("id").alias("rep")), "fp").select("id", "rep")


def all_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``, of all rows: pairs of representatives carried over to their copies, and copies."""
    a = members.select(F.col("id").alias("x"), F.col("rep").alias("id_a"))
    b = members.select(F.col("id").alias("y"), F.col("rep").alias("id_b"))
    across = pairs.select("id_a", "id_b").join(a, "id_a").join(b, "id_b").select("x", "y")
    copies = a.join(b, a["id_a"] == b["id_b"]).where("x < y").select("x", "y")
    both = across.unionByName(copies)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicates(df: DataFrame, id_col: str, text_col: str, plan: Plan = Plan()) -> DataFrame:
    """``(id, class_id, n_links)``: one row per record with the least id of its group and its links to other texts.

    Groups are connected components of the similarity graph, found by label propagation over the representatives with
    pointer jumping; a record linked to none is its own group. ``n_links`` counts linked texts, not their copies.
    """
    pairs, named = representative_pairs(df, id_col, text_col, plan)
    pairs, named = materialize(pairs.select("id_a", "id_b")), materialize(named)
    edges = pairs.unionByName(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    degree = edges.groupBy("id_a").agg(F.count(F.lit(1)).alias("n_links")).withColumnRenamed("id_a", "rep")
    labels = degree.select("rep", F.col("rep").alias("label"))
    changed = 1
    while changed:  # labels only fall, so this ends
        near = edges.join(labels.withColumnRenamed("rep", "id_b"), "id_b").groupBy("id_a").agg(F.min("label").alias("m"))
        step = labels.join(near.withColumnRenamed("id_a", "rep"), "rep").select("rep", "label", F.least("label", "m").alias("l2"))
        jump = step.select(F.col("rep").alias("l2"), F.col("l2").alias("l3"))
        step = step.join(jump, "l2").select("rep", "label", F.least("l2", "l3").alias("new"))
        step = materialize(step)
        changed = step.where("new < label").limit(1).count()
        labels = step.select("rep", F.col("new").alias("label"))
    out = named.join(labels, "rep", "left").join(degree, "rep", "left")
    return out.select("id", F.coalesce("label", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
