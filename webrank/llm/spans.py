"""Long exact spans shared between records, by level-wise doubling.

Windows of a quarter of the wanted length are sampled so that every span of the full length holds at least one sampled
window, chosen by its content alone (the least hash among the span's windows). Windows whose hash occurs in one record
alone are dropped; what can still lie in a shared span around the others is extended to windows of twice the length, and
again, until the full length is reached, where every remaining start is tested. A span shared by two records keeps its
windows at every level, so none is lost; a hash of 64 bits stands for a window of text until pairs are compared by their texts. Of an
id delivered with different texts, the greatest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrank.llm import hashing
from webrank.plans.session import materialize

SLICE_BYTES = 1 << 20


def _windows(size: int, length: int):
    """Map ``(id, text, starts)`` to the sampled windows of ``size`` characters inside spans of ``length``.

    ``starts`` are places at which windows of the level before survived, with ``before`` characters each; null at the first
    level, where all of the text counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in hashing.row_slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(at, n)
                codes, offsets = hashing.char_codes(part.column("text"))
                spans = len(codes) - length + 1
                if spans <= 0:
                    continue
                inside = np.ones(spans, bool)
                for edge in offsets[1:-1]:
                    inside[max(0, edge - length + 1) : edge] = False
                if "starts" in part.schema.names:
                    starts = part.column("starts")
                    owner = np.repeat(np.arange(n), np.diff(starts.offsets.to_numpy()))
                    where = starts.flatten().to_numpy(zero_copy_only=False) + offsets[owner]
                    mark = np.zeros(len(codes) + 1, np.int32)
                    low = np.maximum(where + size // 2 - length, offsets[owner])
                    np.add.at(mark, low, 1)
                    np.add.at(mark, where + 1, -1)
                    inside &= np.cumsum(mark)[:spans] > 0
                h = hashing.window_hashes(hashing.prefix_hash(codes), size)
                if size < length:
                    width = length - size + 1
                    least = hashing.sliding_min(h, width)
                    top = np.where(inside, least, 0)
                    pad = np.zeros(width - 1, np.uint64)
                    reach = ~hashing.sliding_min(~np.concatenate([pad, top, pad]), width)
                    chosen = np.flatnonzero((reach == h) & (h > 0))
                else:
                    chosen = np.flatnonzero(inside)
                rows = np.searchsorted(offsets, chosen, side="right") - 1
                cols = [pa.array(h[chosen].view(np.int64)), part.column("id").take(pa.array(rows))]
                cols.append(pa.array((chosen - offsets[rows]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(cols, names=["key", "id", "start"])

    return run


def _repeated(windows: DataFrame) -> DataFrame:
    """The windows whose hash occurs in two records at least; states are pre-aggregated before the shuffle."""
    ends = windows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    return windows.join(ends, "key")


def classes(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, members)``: ``(id, text, rep)`` with the least id of the equal texts, and ``(id, rep, n)``, ``n`` the length."""
    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")
    )
    slim = rows.groupBy("id").agg(F.max(F.struct(F.md5("text").alias("fp"), F.length("text").alias("n"))).alias("x")).select("id", "x.*")
    names = slim.groupBy("fp").agg(F.min("id").alias("rep"))
    return rows, materialize(slim.join(names, "fp").select("id", "rep", "n"))


def shared_windows(df: DataFrame, id_col: str, text_col: str, length: int = 200) -> tuple[DataFrame, DataFrame]:
    """``(windows, members)``: ``(key, id, start)`` of all windows of ``length`` characters that several texts share.

    Only one record of each class of equal texts is searched; ``members`` has ``(id, rep, n)`` of all. Rows with a null id
    or text take no part, texts shorter than ``length`` have no window.
    """
    if length < 8:
        raise ValueError("length must be at least 8")
    rows, members = classes(df, id_col, text_col)
    copies = members.where("id <> rep").select("id")
    texts = rows.where(F.length("text") >= length)
    sizes = [length // 4, length // 2, length]
    schema = "key bigint, id bigint, start int"
    found = materialize(_repeated(materialize(texts.mapInArrow(_windows(sizes[0], length), schema).join(copies, "id", "left_anti"))))
    for size in sizes[1:]:
        places = found.groupBy("id").agg(F.collect_set("start").alias("starts"))
        again = texts.join(places, "id").groupBy("id").agg(F.max("text").alias("text"), F.first("starts").alias("starts"))  # one set of starts an id
        found = materialize(_repeated(materialize(again.mapInArrow(_windows(size, length), schema))))
    return found, members


def representative_pairs(windows: DataFrame, df: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """``(doc_a, doc_b)``, ``doc_a < doc_b``: all different texts that share a window, each named by its class.

    A hash only proposes a pair: the windows of least and greatest hash that two texts have in common are cut from the
    texts of ``df`` and compared, and one of them must be equal.
    """
    ids = F.xxhash64(F.lit(1), "id").cast("decimal(38,0)"), F.xxhash64(F.lit(2), "id").cast("decimal(38,0)")
    held = materialize(windows.groupBy("key", "id").agg(F.min("start").alias("start")))
    # of windows with the same records, told by two hash sums, one stands for all
    sets = held.groupBy("key").agg(F.sum(ids[0]).alias("s"), F.sum(ids[1]).alias("t"), F.count(F.lit(1)).alias("n"))
    keys = sets.groupBy("s", "t", "n").agg(F.min("key").alias("key")).select("key")
    held = held.join(keys, "key")
    met = held.alias("a").join(held.alias("b"), "key").where("a.id < b.id")
    place = F.struct("key", F.col("a.start").alias("sa"), F.col("b.start").alias("sb"))
    pairs = met.groupBy(F.col("a.id").alias("doc_a"), F.col("b.id").alias("doc_b")).agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
    pairs = materialize(pairs)
    sides = [F.struct(F.col(f"doc_{x}").alias("id"), F.lit(w).alias("w"), F.col(f"{w}.s{x}").alias("start")) for x in "ab" for w in ("lo", "hi")]
    cuts = pairs.select("doc_a", "doc_b", F.inline(F.array(*sides)))
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    texts = texts.join(cuts.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
    pieces = cuts.join(texts, "id").select("doc_a", "doc_b", "w", F.expr(f"substring(text, start + 1, {length})").alias("piece"))
    equal = pieces.groupBy("doc_a", "doc_b", "w").agg((F.min("piece") == F.max("piece")).alias("equal"))
    return equal.where("equal").select("doc_a", "doc_b").distinct()


def shared_pairs(pairs: DataFrame, members: DataFrame, length: int) -> DataFrame:
    """``(doc_a, doc_b)``, ``doc_a < doc_b``: all records that share a window, from :func:`representative_pairs`, copies included."""
    long = members.where(F.col("n") >= length)
    a = long.select(F.col("id").alias("x"), F.col("rep").alias("doc_a"))
    b = long.select(F.col("id").alias("y"), F.col("rep").alias("doc_b"))
    across = pairs.join(a, "doc_a").join(b, "doc_b").select("x", "y")
    copies = a.join(b, a["doc_a"] == b["doc_b"]).where("x < y").select("x", "y")
    both = across.unionByName(copies)
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def shared_share(windows: DataFrame, members: DataFrame, length: int) -> DataFrame:
    """``(doc_id, n_chars, shared_chars, shared_share)``: how much of each text lies in spans that occur in another record.

    A text that has an equal copy is shared as a whole if it has ``length`` characters; a text without shared spans has 0.
    """
    from pyspark.sql import Window

    nxt = F.lead("start").over(Window.partitionBy("id").orderBy("start"))
    covered = (
        windows.select("id", "start").distinct()
        .select("id", F.least(F.coalesce(nxt - F.col("start"), F.lit(length)), F.lit(length)).alias("c"))
        .groupBy("id").agg(F.sum("c").alias("c")).withColumnRenamed("id", "rep")
    )
    counts = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    all_of = members.join(counts, "rep").join(covered, "rep", "left")
    chars = F.when((F.col("copies") > 1) & (F.col("n") >= length), F.col("n")).otherwise(F.coalesce("c", F.lit(0))).cast("bigint")
    out = all_of.select(F.col("id").alias("doc_id"), F.col("n").cast("bigint").alias("n_chars"), chars.alias("shared_chars"))
    return out.withColumn("shared_share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(0.0))
