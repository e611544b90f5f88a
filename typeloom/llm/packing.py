"""Best-fit packing of token sequences, planned over the histogram of lengths.

Only counts of pieces by length, at most `capacity` of them, reach the driver. Best-fit decreasing runs over these
counts and yields runs: pieces of one length with consecutive ranks that take one place each in consecutive
sequences. Pieces then take their places by a join on length and rank. A rank within a length is a row number
within (length, part of the table) plus the count in the parts before, so that no task holds a whole length.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship, written
from .tokens import END_ID, binaries, encoded, tokenizer_path

CAPACITY = 1024

#: Runs of a plan that are broadcast; a longer plan is joined by shuffle.
BROADCAST_RUNS = 200_000


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every document's pieces.

    A document's ids end with end_id (null or empty text: that id alone). More than `capacity` ids are cut so that all
    pieces but the first are full. A null doc_id stays null; equal rows give equal pieces.
    """
    ship(docs.sparkSession)
    path = path or tokenizer_path()
    fields = "doc_id long, piece int, start long, length long, ids binary"

    def run(batches):
        for (doc_id,), ids, cuts in encoded(batches, path, end_id, ["doc_id"]):
            n = np.diff(cuts)
            many = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            first = n - (many - 1) * capacity
            start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[row])
            yield pa.RecordBatch.from_arrays(
                [doc_id.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), binaries(ids, np.append(cuts[row] + start, len(ids)))],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, fields)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts. Runs (length, first rank, end rank, first sequence, offset)."""
    room: dict[int, list[list[int]]] = defaultdict(list)  # by room left: [first sequence, sequences]
    runs, sequences = [], 0
    for length in sorted((k for k in counts if counts[k]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            best = next((r for r in range(length, capacity) if room[r]), None)
            if best is None:
                each = capacity // length
                for bins, deep in ((left // each, each), (1 if left % each else 0, left % each)):
                    if bins:
                        for k in range(deep):
                            runs.append((length, rank, rank + bins, sequences, k * length))
                            rank += bins
                        if capacity - deep * length:
                            room[capacity - deep * length].append([sequences, bins])
                        sequences += bins
                break
            first, bins = room[best].pop()
            used = min(bins, left)
            runs.append((length, rank, rank + used, first, capacity - best))
            if bins > used:
                room[best].append([first + used, bins - used])
            if best > length:
                room[best - length].append([first, used])
            rank, left = rank + used, left - used
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: list[str] | None = None) -> DataFrame:
    """pieces with sequence_id and offset: a gapless packing into sequences of at most `capacity`.

    Needs a column `length` from 1 to capacity; rows whose length is null or outside are an error of the caller and raise.
    All other columns pass unchanged; they must not have the names of the added ones, nor one of those used on the way. Equal
    rows each get a place. No rows: no rows.
    """
    spark = pieces.sparkSession
    own = pieces.columns
    if clash := {"sequence_id", "offset", "_part", "_n", "_before", "_row", "_rank", "_from", "_to", "_first", "_offset"} & set(own):
        raise ValueError(f"pieces already has {sorted(clash)}")
    table = written(pieces.withColumn("_part", F.spark_partition_id()), "pieces")
    if table.where(F.col("length").isNull() | ~F.col("length").between(1, capacity)).take(1):
        raise ValueError(f"a piece's length is not between 1 and {capacity}")
    counts = table.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = spark.createDataFrame(plan(histogram, capacity), "length long, _from long, _to long, _first long, _offset long")
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).drop("_n")
    order = order or [c for c in ("doc_id", "piece") if c in own]
    ranked = table.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_part").orderBy(*order or ["length"])))
    ranked = ranked.join(before, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    runs = F.broadcast(runs) if len(histogram) and runs.count() <= BROADCAST_RUNS else runs
    placed = ranked.alias("p").join(runs.alias("r"), (F.col("p.length") == F.col("r.length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.select(*(F.col(f"p.`{c}`") for c in own), (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("_offset").alias("offset"))
