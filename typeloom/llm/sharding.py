"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions.

Each shard owns `nodes` points of a ring of 64-bit hashes. A key belongs to the first point at or after its own
hash; keys that find their shard full go on clockwise to the next one with room. The walk is planned over the
number of keys in each arc, of which there are shards * nodes, and yields runs: consecutive ranks of an arc that go
to one shard. Rows take their places by joining on arc and rank.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

SHARDS, NODES = 8, 128

#: The ring is cut into so many cells (as a power of 2) for finding a hash's arc.
CELL_BITS = 12

#: Rows of the small tables (arcs and runs, bounded by shards * nodes) that are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def ring(spark, shards: int, nodes: int) -> list[tuple[int, int]]:
    """(unsigned place, shard) of every virtual node, clockwise."""
    made = spark.range(shards * nodes).select((F.col("id") / nodes).cast("int").alias("shard"), F.xxhash64(F.lit("node"), F.col("id")).alias("place"))
    return sorted((r.place % 2**64, r.shard) for r in made.collect())


def flow(counts: dict[int, int], owners: list[int], caps: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, first rank, end rank, shard, first slot) of the bounded walk round the ring.

    All arcs first fill their own shard; what is left goes on, point by point, to the next shard that has room.
    """
    free, slot, arcs = list(caps), [0] * len(caps), len(owners)
    runs = []
    left = [[a, counts[a], 0, a] for a in sorted(counts)]  # arc, keys left, keys placed, the point they are at
    while left:
        rest = []
        for arc, keys, done, at in left:
            shard = owners[at % arcs]
            n = min(keys, free[shard])
            if n:
                runs.append((arc, done, done + n, shard, slot[shard]))
                free[shard] -= n
                slot[shard] += n
            if keys > n:
                rest.append([arc, keys - n, done + n, at])
        for x in rest:  # full shards are passed by
            x[3] += 1
            while not free[owners[x[3] % arcs]]:
                x[3] += 1
        left = rest
    return runs


def shard_rows(rows: DataFrame, key: str = "doc_id", shards: int = SHARDS, nodes: int = NODES, slack: float = 0.0) -> DataFrame:
    """rows with `shard` and `slot` (gapless from 0 within the shard).

    A shard's capacity is its even share of the rows, to within one, times 1 + slack; with no slack, counts differ by at
    most one. Keys may be null or repeat (null is a key like any other); rows with one key each get a place and a slot. Ranks
    in an arc follow the parts of the table that the hashed rows are written to, so no task holds all rows of one key. No
    rows: no rows. rows must not have the columns shard and slot, nor one of the names that are used on the way.
    """
    spark = rows.sparkSession
    if clash := {"shard", "slot", "_place", "_cell", "_low", "_high", "_arc", "_part", "_n", "_before", "_row", "_rank", "_from", "_to", "_first"} & set(rows.columns):
        raise ValueError(f"rows already has {sorted(clash)}")
    points = ring(spark, shards, nodes)
    places = [p for p, _ in points]
    arcs = []
    width = 64 - CELL_BITS
    for cell in range(1 << CELL_BITS):
        low, high = cell << width, (cell + 1 << width) - 1
        while low <= high:
            i = bisect.bisect_left(places, low)
            end = min(high, places[i]) if i < len(places) else high
            arcs.append((cell, *(x - 2**64 if x >= 2**63 else x for x in (low, end)), i % len(places)))
            low = end + 1
    arcs = _small(spark.createDataFrame(arcs, "_cell long, _low long, _high long, _arc int"), len(arcs))
    own = rows.columns
    hashed = rows.withColumn("_place", F.xxhash64(F.lit("key"), F.col(f"`{key}`").cast("string")))
    hashed = hashed.withColumn("_cell", F.shiftrightunsigned("_place", width))
    found = hashed.join(arcs, (hashed["_cell"] == arcs["_cell"]) & (F.col("_place") >= F.col("_low")) & (F.col("_place") <= F.col("_high")))
    table = written(found.select(*(F.col(f"`{c}`") for c in own), "_place", "_arc", F.spark_partition_id().alias("_part")), "ring")
    parts = ["_arc", "_part"]
    counts = table.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
    by_arc = {r["_arc"]: r.n for r in counts.groupBy("_arc").agg(F.sum("_n").alias("n")).collect()}
    total = sum(by_arc.values())
    caps = [-int(-(total // shards + (s < total % shards)) * (1 + slack) // 1) for s in range(shards)]
    runs = flow(by_arc, [s for _, s in points], caps)
    runs = _small(spark.createDataFrame(runs, "_arc int, _from long, _to long, shard int, _first long"), len(runs))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_arc").orderBy("_part")) - F.col("_n")).drop("_n")
    ranked = table.withColumn("_row", F.row_number().over(Window.partitionBy(*parts).orderBy("_place"))).join(before, parts)
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_row") - 1).alias("k").join(runs.alias("r"), (F.col("k._arc") == F.col("r._arc")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return ranked.select(*(F.col(f"k.`{c}`") for c in own), "shard", (F.col("_first") + F.col("_rank") - F.col("_from")).alias("slot"))
