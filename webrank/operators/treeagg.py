"""Per-key aggregation with even work although a few keys hold most rows.

Fixed-size chunks of the input are combined where they lie (partial aggregation on key and chunk), then the partial
states of a key are merged in rounds of ``fan_in``: a round groups on (key, node // fan_in). Chunks are spread over
``fan_in ** rounds`` nodes, so no reducer gets more than ``fan_in`` states of a key from a round, however many rows the key
has: with the defaults this holds to 10**12 rows, more rounds reach further. The input runs once and is not looked at before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 16
FAN_IN = 64
ROUNDS = 3
NODE = "__tree_node"


def tree_aggregate(
    df: DataFrame,
    keys: list[str],
    states: dict[str, tuple[str, Column]],
    fan_in: int = FAN_IN,
    chunk_rows: int = CHUNK_ROWS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per distinct ``keys`` (nulls are a key of their own) with the merged ``states``.

    ``states`` maps an output name to (``"sum" | "min" | "max" | "count"``, expression). Nulls are skipped as in SQL: a sum,
    min or max over nulls alone is null, a count is 0. Sums of decimals and integers do not depend on the order of rows.
    An empty table gives an empty result. Columns of the input beyond keys and expressions are ignored, whatever their name.
    """
    if fan_in < 2 or chunk_rows < 1 or rounds < 1:
        raise ValueError("fan_in must be at least 2, chunk_rows and rounds at least 1")
    merge = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}
    first = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    inner = {k: f"__k{i}" for i, k in enumerate(keys)}
    cols = [F.col(k).alias(v) for k, v in inner.items()]
    cols += [expr.alias(f"__s{i}") for i, (_, expr) in enumerate(states.values())]
    row = F.monotonically_increasing_id()
    offset = F.floor(row.bitwiseAND((1 << 33) - 1) / F.lit(chunk_rows))
    nodes = fan_in**rounds
    chunk = F.pmod(F.xxhash64(F.shiftright(row, 33), offset), F.lit(nodes))
    level = df.select(*cols, chunk.cast("bigint").alias(NODE))
    names = list(inner.values())
    hows = [how for how, _ in states.values()]
    level = level.groupBy(*names, NODE).agg(*[first[h](f"__s{i}").alias(f"__s{i}") for i, h in enumerate(hows)])
    while nodes > 1:
        nodes = -(-nodes // fan_in)
        by = names if nodes == 1 else [*names, NODE]
        level = (
            level.withColumn(NODE, F.floor(F.col(NODE) / fan_in).cast("bigint"))
            .groupBy(*by)
            .agg(*[merge[h](f"__s{i}").alias(f"__s{i}") for i, h in enumerate(hows)])
        )
    out = [F.col(v).alias(k) for k, v in inner.items()]
    return level.select(*out, *[F.col(f"__s{i}").alias(n) for i, n in enumerate(states)])


def hot_values(df: DataFrame, column: str, share: float, **options) -> DataFrame:
    """Values of ``column`` that hold at least ``share`` of all rows (nulls count in the total, never as a value)."""
    counts = tree_aggregate(df, [column], {"n_rows": ("count", F.lit(1))}, **options)
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    large = counts.join(F.broadcast(total)).where(F.col("n_rows") >= F.lit(share) * F.col("__total"))  # one row
    return large.where(F.col(column).isNotNull()).drop("__total")
