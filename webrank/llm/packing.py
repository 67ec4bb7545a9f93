"""Filling containers of fixed capacity: minimum bin slack over blocks of items.

Items fall into blocks of a few thousand by a hash of their id. In a block, each container starts with the longest item
left; a bitset of reachable sums over the multiset of remaining lengths then finds the filling closest to capacity, and
the counts of each length are read back from the bitsets before it. A block ends with its items, so at most one container
per block is left unfilled for want of items.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ITEMS = 4096


def fill(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """Counts per length, within ``counts``, whose sum is as near ``room`` as any can be and not above it.

    ``lengths`` are the distinct lengths left, ascending. Sums are bits of an integer; a length that occurs c times is
    added in c steps halved as 1, 2, 4, ... The search ends early once the room can be filled wholly.
    """
    mask, full = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[i]
        left, k = min(counts[length], room // length), 1
        while left > 0:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            k *= 2
        if reach & full:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not (before >> at) & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def pack(items: list[tuple[int, int, int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``(bin, id, piece, start, size)`` of a block's ``(id, piece, start, size)`` items, none longer than ``capacity``."""
    pools: dict[int, list[tuple[int, int, int, int]]] = {}
    for item in sorted(items, reverse=True):
        pools.setdefault(item[3], []).append(item)
    empty = pools.pop(0, [])
    counts = {k: len(v) for k, v in pools.items()}
    lengths = sorted(counts)
    out, number = [], 0

    def put(length: int, n: int) -> None:
        pool = pools[length]
        for _ in range(n):
            out.append((number, *pool.pop()))
        counts[length] -= n
        if not counts[length]:
            del counts[length]
            lengths.remove(length)

    while lengths:
        longest = lengths[-1]
        put(longest, 1)
        if (room := capacity - longest) and lengths:
            for length, n in fill(counts, lengths, room).items():
                put(length, n)
        number += 1
    return out + [(0, *item) for item in empty]


def pack_containers(sizes: DataFrame, id_col: str, size_col: str, capacities: dict[str, int] | list[tuple[str, int]], block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``(container, capacity, bin, <id>, piece, start_token, n_tokens)``: the contents of every container of each capacity.

    A name may be given with several capacities. An item longer than the capacity is cut into pieces of the capacity, each filling a container of its own, and a rest
    that is packed like an item; no other item is split. Items of size 0 lie in the first container of their block; rows
    with a null id or size, and repeats of an id, are left out. Bins are named by block and number.
    """
    named = list(capacities.items() if isinstance(capacities, dict) else capacities)
    if min((c for _, c in named), default=1) < 1:
        raise ValueError("capacities must be positive")
    rows = sizes.where(F.col(id_col).isNotNull() & (F.col(size_col) >= 0)).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(size_col).cast("bigint").alias("n"))
    kinds = F.array(*[F.struct(F.lit(k).alias("container"), F.lit(int(c)).cast("bigint").alias("capacity")) for k, c in named])
    spread = rows.select("id", "n", F.explode(kinds).alias("c")).select("id", "n", "c.*")
    blocks = max(1, round(sizes.count() / block_items))
    whole = F.floor(F.col("n") / F.col("capacity")).cast("int")
    cut = spread.where(F.col("n") > F.col("capacity"))
    full = cut.select("container", "capacity", "id", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece")).select(
        "container", "capacity", F.concat_ws("-", F.lit("full"), "id", "piece").alias("bin"), "id", "piece",
        (F.col("piece") * F.col("capacity")).alias("start"), F.col("capacity").alias("size"),
    )
    longer = F.col("n") > F.col("capacity")
    items = spread.select(
        "container", "capacity", "id",
        F.when(longer, whole).otherwise(0).alias("piece"),
        F.when(longer, whole * F.col("capacity")).otherwise(0).cast("bigint").alias("start"),
        F.when(longer, F.col("n") - whole * F.col("capacity")).otherwise(F.col("n")).alias("size"),
        F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
    ).where((F.col("size") > 0) | ~(F.col("n") > F.col("capacity")))

    def run(block: pd.DataFrame) -> pd.DataFrame:
        name, capacity, number = block["container"].iloc[0], int(block["capacity"].iloc[0]), int(block["block"].iloc[0])
        packed = pack(list(zip(*(block[c].tolist() for c in ("id", "piece", "start", "size")))), capacity)
        out = pd.DataFrame(packed, columns=["bin", "id", "piece", "start", "size"])
        out["bin"] = [f"{number}-{b}" for b in out["bin"]]
        return out.assign(container=name, capacity=capacity)[["container", "capacity", "bin", "id", "piece", "start", "size"]]

    schema = "container string, capacity bigint, bin string, id bigint, piece int, start bigint, size bigint"
    rest = items.groupBy("container", "capacity", "block").applyInPandas(run, schema)
    return rest.unionByName(full).select("container", "capacity", "bin", F.col("id").alias(id_col), "piece", F.col("start").alias("start_token"), F.col("size").alias("n_tokens"))
