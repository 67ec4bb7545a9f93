"""One ranking from several scores (Borda count), with ranks computed over range partitions instead of whole groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webrank.operators.ranged import running_counts
from webrank.operators.skew import counted_join
from webrank.plans.session import materialize


def borda(df: DataFrame, group: str, item: str, scores: dict[str, float]) -> DataFrame:
    """``(group, item, points)``: the weighted sum of an item's ranks by each score, 1 for the lowest of its group.

    Equal scores share the mean of their ranks. A missing score (null or NaN) gets the middle rank of the group's known
    ones, (n + 1) / 2. Several rows of one item count once, each score with its greatest value; rows whose group or item is
    null are left out. An empty table gives an empty result. ``scores`` maps score columns to their weights.
    """
    if not scores:
        raise ValueError("borda needs at least one score")
    names = list(scores)
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(
        F.col(group).alias("g"), F.col(item).alias("i"), *[F.col(s).cast("double").alias(f"s{k}") for k, s in enumerate(names)]
    )
    rows = rows.groupBy("g", "i").agg(*[F.max(F.when(~F.isnan(f"s{k}"), F.col(f"s{k}"))).alias(f"s{k}") for k in range(len(names))])
    long = materialize(
        rows.select("g", "i", F.posexplode(F.array(*[F.col(f"s{k}") for k in range(len(names))])).alias("k", "v"))
    )
    values = long.where("v is not null").groupBy("g", "k", "v").agg(F.count(F.lit(1)).alias("c"))
    ranks = running_counts(values, ["g", "k"], ["v"], "c", "lower").select("g", "k", "v", "c", (F.col("lower") + (F.col("c") + 1) / 2).alias("r"))
    known = values.groupBy("g", "k").agg(((F.sum("c") + 1) / 2).alias("mid"))
    weights = F.element_at(F.array(*[F.lit(float(scores[s])) for s in names]), F.col("k") + 1)
    # a value that many items share is broadcast with its rank, its rows stay where they are
    given = counted_join(long.where("v is not null"), materialize(ranks), ["g", "k", "v"], "c").select("g", "i", "k", "r")
    missing = long.where("v is null").select("g", "i", "k", F.lit(None).cast("double").alias("r"))
    placed = given.unionByName(missing).join(known, ["g", "k"], "left")
    points = F.sum(weights * F.coalesce("r", "mid", F.lit(0.0)))
    return placed.groupBy("g", "i").agg(F.round(points, 6).alias("points")).select(F.col("g").alias(group), F.col("i").alias(item), "points")


def positions(points: DataFrame, group: str, item: str) -> DataFrame:
    """Adds ``position``, from 1 for the most points of a group; equal points by ``item``."""
    ordered = points.withColumn("__o", -F.col("points")).withColumn("__one", F.lit(1))
    out = running_counts(ordered, [group], ["__o", item], "__one", "__before")
    return out.select(group, item, "points", (F.col("__before") + 1).cast("bigint").alias("position"))


def top(points: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """The ``k`` items of most points per group; each task keeps its own ``k`` before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.col("points").desc(), F.col(item))
    return points.withColumn("position", F.row_number().over(order).cast("bigint")).where(F.col("position") <= k)
