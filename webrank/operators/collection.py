"""Collections ``(value)`` and pairs ``(key, value)`` as DataFrames.

Every operator takes column expressions, so plans stay in generated code; those that take a Python callable end in ``_py``
and run it over Arrow batches. Duplicates are kept unless said otherwise; order is never part of a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Fold = str | Callable[[Column, Column], Column]
PAIR = "key string, value string"


def parallelize(spark: SparkSession, values: Iterable[str]) -> DataFrame:
    """A collection of the driver's values (SRC1)."""
    return spark.createDataFrame([(v,) for v in values], "value string")


def from_rows(df: DataFrame, value: Column) -> DataFrame:
    """One element per row, rows for which ``value`` is null left out (SRC2, UDF3)."""
    return df.select(value.cast("string").alias("value")).where("value is not null")


def flat_map(df: DataFrame, values: Column) -> DataFrame:
    """All entries of the array ``values`` of every row; null and empty arrays give none (MAP1, MAP4)."""
    return df.select(F.explode(values).alias("value"))


def flat_map_to_pair(df: DataFrame, pairs: Column) -> DataFrame:
    """All ``(key, value)`` structs of the array ``pairs`` of every row (MAP2, MAP5)."""
    return df.select(F.inline(pairs)).toDF("key", "value")


def map_to_pair(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """One pair per row; a null key means no pair (MAP3)."""
    return df.select(key.alias("key"), value.alias("value")).where("key is not null")


def filter_(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which ``condition`` is true (FIL1)."""
    return df.where(condition)


def map_partitions_py(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``f`` over the batches of each partition (MAP6)."""
    return df.mapInPandas(f, schema)


def flat_map_py(df: DataFrame, f: Callable[[str], Iterable[str] | None], column: str = "value") -> DataFrame:
    """All strings that ``f`` gives for each value; None gives none (MAP1, UDF1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"value": [y for x in batch[column] for y in (f(x) or ())]}, dtype="object")

    return df.select(column).mapInPandas(run, "value string")


def map_to_pair_py(df: DataFrame, f: Callable[[str], tuple[str, str] | None], column: str = "value") -> DataFrame:
    """The pair that ``f`` gives for each value; None gives none (MAP3, UDF1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([y for x in batch[column] if (y := f(x)) is not None], columns=["key", "value"], dtype="object")

    return df.select(column).mapInPandas(run, PAIR)


def filter_py(df: DataFrame, f: Callable[[str], bool], column: str = "value") -> DataFrame:
    """Rows whose value ``f`` accepts (FIL1, UDF1)."""
    return df.mapInPandas(lambda batches: (b[[bool(f(x)) for x in b[column]]] for b in batches), df.schema)


def pair_flat_map_py(df: DataFrame, f: Callable[[str, str], Iterable[tuple[str, str]] | None]) -> DataFrame:
    """All pairs that ``f`` gives for each pair (MAP5, UDF2)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([y for k, v in zip(b["key"], b["value"]) for y in (f(k, v) or ())], columns=["key", "value"], dtype="object")

    return df.select("key", "value").mapInPandas(run, PAIR)


def sample(df: DataFrame, fraction: float, seed: int | None = None) -> DataFrame:
    """Each row independently with probability ``fraction`` (FIL2)."""
    return df.sample(False, fraction, seed)


def hash_sample(df: DataFrame, key: Column, share: int, of: int) -> DataFrame:
    """Rows of which the MD5 of the key falls in ``share`` of ``of`` classes: the same rows wherever it runs (FIL2)."""
    return df.where(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % of < share)


def _folded(column: Column, zero: object, how: Fold) -> Column:
    if callable(how):
        return F.aggregate(F.sort_array(F.collect_list(column)), F.lit(zero), how)
    start = F.lit(zero)
    if how == "sum":
        return start + F.coalesce(F.sum(column), F.lit(0))
    if how == "max":
        return F.greatest(F.max(column), start)
    if how == "min":
        return F.least(F.min(column), start)
    if how == "concat":
        return F.concat(start, F.array_join(F.sort_array(F.collect_list(column)), ""))
    raise ValueError(f"unknown fold {how!r}")


def fold(df: DataFrame, zero: object, how: Fold, column: str = "value") -> DataFrame:
    """One row: ``zero`` folded once with all values, ``zero`` itself if there are none (AGG2).

    ``how`` is sum, max, min, concat, or ``(accumulator, element) -> Column`` over the values in order; only the named
    ones are combined before the shuffle.
    """
    return df.agg(F.coalesce(_folded(F.col(column), zero, how), F.lit(zero)).alias("value"))


def fold_by_key(df: DataFrame, zero: object, how: Fold) -> DataFrame:
    """The fold of each key's values, ``zero`` applied once per key; a step that gives null leaves the accumulator (AGG3)."""
    step = (lambda acc, x: F.coalesce(how(acc, x), acc)) if callable(how) else how
    return df.groupBy("key").agg(_folded(F.col("value"), zero, step).alias("value"))


def group_by(df: DataFrame, key: Column, column: str = "value") -> DataFrame:
    """``(key, value)``: the values of each key in order, joined by commas (AGG4)."""
    joined = F.array_join(F.sort_array(F.collect_list(F.col(column).cast("string"))), ",")
    return df.groupBy(key.alias("key")).agg(joined.alias("value"))


def concat_by_key(df: DataFrame, separator: str) -> DataFrame:
    """The values of each key in order, joined by ``separator`` (AGG8)."""
    return df.groupBy("key").agg(F.array_join(F.sort_array(F.collect_list("value")), separator).alias("value"))


def join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on the key, every pair of values as ``a,b`` (JOI1)."""
    left, right = a.select("key", F.col("value").alias("va")), b.select("key", F.col("value").alias("vb"))
    return left.join(right, "key").select("key", F.concat_ws(",", "va", "vb").alias("value"))


def cogroup(a: DataFrame, b: DataFrame) -> DataFrame:
    """``[a1,a2],[b1]`` for each key of either side, values in order, ``[]`` for a side without the key (JOI2)."""

    def lists(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("key").agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias(name))

    both = lists(a, "va").join(lists(b, "vb"), "key", "full_outer")
    text = F.concat(F.lit("["), F.coalesce("va", F.lit("")), F.lit("],["), F.coalesce("vb", F.lit("")), F.lit("]"))
    return both.select("key", text.alias("value"))


def distinct(df: DataFrame) -> DataFrame:
    """Each row once (AGG5)."""
    return df.distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, each once (SET1)."""
    return a.intersect(b)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that ``b`` hasn't, duplicates kept (SET2, JOI5)."""
    return a.join(b.distinct(), a.columns, "left_anti")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both (SET3)."""
    return a.unionByName(b)


def take(df: DataFrame, n: int, *order: str) -> DataFrame:
    """At most ``n`` rows, the first by ``order`` if it is given (TOP1, TOP6)."""
    return (df.orderBy(*order) if order else df).limit(n)


def pair_text(df: DataFrame) -> DataFrame:
    """The text form ``(key,value)`` of each pair (FMT1)."""
    return df.select(F.concat(F.lit("("), "key", F.lit(","), "value", F.lit(")")).alias("value"))
