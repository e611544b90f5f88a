"""Blocked Bloom filters of 64-bit hashes: one that is a table, probed with DataFrame functions, and one that is an array.

A hash picks one 64-bit block by its low bits and four bits of that block by its high bits. The table has a block for every
few keys, so it grows with the list and never saturates; its blocks are rows, which the hashes that are asked for find by a
hash join: a broadcast one up to a checked number of blocks, beyond that a shuffled one. The array is sent to all tasks, so
its size has a bound; beyond its capacity it passes more false positives, but never loses a key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 4 MB of blocks of an array.
MOST_BLOCKS = 1 << 19
KEYS_A_BLOCK = 4

#: Blocks of a table that are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_BLOCKS = 1 << 19
_SHIFTS = (40, 46, 52, 58)


def _block(h: Column, blocks: int) -> Column:
    return h.bitwiseAND(F.lit(blocks - 1).cast("long"))


def _mask(h: str) -> str:
    return "(" + " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({h}, {s}) & 63 as int))" for s in _SHIFTS) + ")"


def blocks_for(keys: int) -> int:
    """Blocks of a filter of so many keys: a power of 2."""
    return 1 << max(0, (-(-keys // KEYS_A_BLOCK) - 1).bit_length())


def table(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """The filter of a column of hashes, as _block and _bits of the blocks that hold a key. Null hashes are left out."""
    return keys.where(F.col(column).isNotNull()).groupBy(_block(F.col(column), blocks).alias("_block")).agg(F.expr(f"bit_or({_mask(column)})").alias("_bits"))


def marked(rows: DataFrame, column: str, filter_: DataFrame, blocks: int, name: str) -> DataFrame:
    """rows with a column that is false where the filter does not hold the hash for certain. A null is not held."""
    small = F.broadcast(filter_) if blocks <= BROADCAST_BLOCKS else filter_.hint("shuffle_hash")
    found = rows.withColumn("_block", _block(F.col(column), blocks)).join(small, "_block", "left")
    held = F.coalesce(F.expr(f"(_bits & {_mask(column)}) = {_mask(column)}"), F.lit(False))
    return found.select(*(F.col(f"`{c}`") for c in rows.columns), held.alias(name))


def build(keys: DataFrame, column: str, most: int = MOST_BLOCKS) -> np.ndarray:
    """The filter of a column of hashes, as an array of signed 64-bit blocks. Null hashes are left out."""
    blocks = min(most, blocks_for(keys.count()))
    rows = keys.where(F.col(column).isNotNull()).groupBy(_block(F.col(column), blocks).alias("block")).agg(F.expr(f"bit_or({_mask(column)})").alias("bits")).toArrow()
    out = np.zeros(blocks, dtype=np.int64)
    out[rows.column("block").to_numpy()] = rows.column("bits").to_numpy()
    return out


def passes_array(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of an array of hashes the filter may hold."""
    h = h.view(np.uint64)
    mask = np.zeros(len(h), dtype=np.uint64)
    for s in _SHIFTS:
        mask |= np.uint64(1) << ((h >> np.uint64(s)) & np.uint64(63))
    return (filter_.view(np.uint64)[(h & np.uint64(len(filter_) - 1)).astype(np.int64)] & mask) == mask
