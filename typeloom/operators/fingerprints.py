"""Whether two DataFrames hold the same rows, by order-free sums of row hashes.

A row's bucket is a part of its hash. A fingerprint has each bucket's number of rows and the sums of two independent hashes of 64
bits, which are the same for the same rows in any order. Sums that differ prove that rows do; for rows that differ to have the same
sums in all buckets is as likely as guessing 128 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1024


def _value(f: T.StructField) -> Column:
    """A column as what a hash tells apart: nested values as text with their nulls, maps in the order of their keys."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return F.when(c == 0, F.lit(0.0).cast(f.dataType)).otherwise(c)
    if isinstance(f.dataType, T.MapType):
        c = F.array_sort(F.map_entries(c))
    return F.to_json(c, {"ignoreNullFields": "false"}) if isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType)) else c


def hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a row; a null counts as a value of its own."""
    values = [x for f in df.schema for x in (F.col(f"`{f.name}`").isNull(), _value(f))]
    return F.xxhash64(F.lit(1), *values), F.xxhash64(F.lit(2), *values)


def fingerprint(df: DataFrame) -> dict[int, tuple]:
    """(rows, sum, sum) of each bucket that holds rows."""
    a, b = hashes(df)
    wide = lambda x: F.sum(F.col(x).cast("decimal(20,0)"))
    sums = df.select(a.alias("a"), b.alias("b")).groupBy(F.pmod("a", F.lit(BUCKETS)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), wide("a").alias("sa"), wide("b").alias("sb"))
    return {r.bucket: (r.n, r.sa, r.sb) for r in sums.collect()}  # at most BUCKETS


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one that the other lacks, each as often as it lacks it, with `_side`: left or right."""
    if "_side" in left.columns:
        raise ValueError("a column named _side has no place beside the side of a row")
    own, other = fingerprint(left), fingerprint(right)
    apart = [k for k in own.keys() | other.keys() if own.get(k) != other.get(k)]
    # Of the rows in these buckets, counts by hash are compared; equal rows are equal in both hashes.
    a, b = hashes(left)
    some = lambda df, side: df.where(F.pmod(a, F.lit(BUCKETS)).isin(apart)).select("*", a.alias("_a"), b.alias("_b"), F.lit(side).alias("_side"))
    rows = some(left, 1).unionAll(some(right, -1))
    more = rows.groupBy("_a", "_b").agg(F.sum("_side").alias("_more"), F.first(F.struct(*(F.col(f"`{c}`") for c in left.columns))).alias("_row")).where("_more <> 0")
    each = more.select("_row", "_more", F.explode(F.sequence(F.lit(1), F.abs("_more").cast("int"))))
    return each.select("_row.*", F.when(F.col("_more") > 0, "left").otherwise("right").alias("_side"))
