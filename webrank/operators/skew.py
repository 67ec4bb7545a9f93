"""Joins against tables of counted keys in which a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 10_000


def counted_join(big: DataFrame, small: DataFrame, keys: list[str], weight: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Left join of ``big`` to ``small``, whose ``keys`` are unique and whose ``weight`` counts the rows of a key in ``big``.

    Keys of a ``1 / hot_keys`` share of all weight or more are at most ``hot_keys``, as weights add up: they are broadcast, so
    their rows stay where they are. The rows of all other keys, none of which holds a larger share, are joined by a shuffle.
    ``small`` should be stored, since it is read twice; keys must not be null.
    """
    rest = [c for c in small.columns if c not in keys]
    total = small.agg(F.sum(weight).alias("__total"))
    tagged = small.join(F.broadcast(total)).withColumn("__hot", F.col(weight) * hot_keys >= F.col("__total")).drop("__total")  # one row
    hot = tagged.where("__hot").withColumn("__here", F.lit(True)).drop("__hot")
    met = big.join(F.broadcast(hot), keys, "left")
    done = met.where("__here").drop("__here")
    cold = met.where("__here is null").drop("__here", *rest).join(tagged.where("not __hot").drop("__hot"), keys, "left")
    return done.unionByName(cold)
