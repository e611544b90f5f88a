"""Samples of exactly so many rows, written once."""

from __future__ import annotations

import math
import random

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import input_files, written

#: Of a table in at least so many files, a sample looks at so many of them at least, and at files with so many times its rows.
FILES, SPARE = 256, 20


def exact_sample(df: DataFrame, rows: int, seed: int, some_files: bool = False) -> DataFrame:
    """df if it has no more than `rows` rows; else exactly so many of them: those whose places hash lowest. Equal rows have places of
    their own, so each row is as likely as any other.

    Rows above a bound that the lowest keep clear of are dropped where they are read; what is left is written, and the last one to
    be taken is found among keys alone. With some_files a table of many files is looked at in some of them, chosen by the seed.
    """
    n = df.count()
    if n <= rows:
        return df
    if some_files:
        few = _some_files(df, rows / n, seed)
        held = few.count() if few is not None else 0
        if held >= rows:
            df, n = few, held
    spread = math.sqrt(rows)
    while True:
        share = min(1.0, (rows + 8 * spread + 16) / n)
        key, place = F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.monotonically_increasing_id()
        low = df.withColumns({"_key": key, "_id": place}).where(F.col("_key") <= int(-(2**63) + share * (2**64 - 4096)))
        low = written(low, "sample")
        if low.count() >= rows or share == 1.0:
            break
        spread *= 4
    last = low.select("_key", "_id").orderBy("_key", "_id").limit(rows).agg(F.max(F.struct("_key", "_id")).alias("x")).first().x
    return low.where((F.col("_key") < last[0]) | (F.col("_key") == last[0]) & (F.col("_id") <= last[1])).select(*(F.col(f"`{c}`") for c in df.columns))


def _some_files(df: DataFrame, share: float, seed: int) -> DataFrame | None:
    """df's rows from some of its files, or None if it has few, or is not read from files row by row."""
    files = input_files(df)
    many = max(FILES, math.ceil(len(files) * share * SPARE))
    if len(files) < 2 * FILES or many >= len(files):
        return None
    try:
        return df.where(F.col("_metadata.file_path").isin(random.Random(seed).sample(files, many)))
    except AnalysisException:
        return None
