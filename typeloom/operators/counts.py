"""Value counts, in their several orders, and histograms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _c(name: str):
    return F.col(f"`{name}`")


def top_counts(df: DataFrame, name: str, top_n: int | None = 10, ascending: bool = False, dropna: bool = False) -> DataFrame:
    """value and count of the most (ascending: least) frequent values; ties in ascending order of value, null last."""
    counts = (df.where(_c(name).isNotNull()) if dropna else df).groupBy(_c(name).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    ordered = counts.orderBy(F.asc("count") if ascending else F.desc("count"), F.col("value").asc_nulls_last())
    return ordered if top_n is None else ordered.limit(top_n)


def value_counts(table, ascending: bool = False, top_n: int = 10, dropna: bool = False) -> dict[str, list[dict]]:
    """For each column with the tag category its values and counts."""
    out = {}
    for name, schema in table.schema.columns.items():
        if schema.is_categorical and "category" in schema.semantic_tags:
            out[name] = [{"value": r["value"], "count": r["count"]} for r in top_counts(table.df, name, top_n, ascending, dropna).collect()]
    return out


def recent_counts(df: DataFrame, name: str, recent: int = 10) -> DataFrame:
    """value (a date) and count of the most recent dates, by descending count, then date."""
    days = df.groupBy(_c(name).cast("date").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return days.orderBy(F.col("value").desc_nulls_last()).limit(recent).orderBy(F.desc("count"), F.col("value").asc_nulls_last())


def range_counts(df: DataFrame, name: str, low: int, high: int) -> DataFrame:
    """value and count of every whole number from low to high, those that do not occur too."""
    counts = df.where(_c(name).between(low, high)).groupBy(_c(name).cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(low, high + 1).withColumnRenamed("id", "value")
    return every.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("count")).orderBy(F.desc("count"), "value")


def edges_of(low: float, high: float, bins: int) -> list[float]:
    """Edges of bins of equal width over [low, high]. The first is a thousandth of the range lower, as bins are open on the left;
    a constant is widened by a thousandth of itself to both sides."""
    pad = (0.001 * abs(low) if low else 0.001) if low == high else 0.0
    low, high = low - pad, high + pad
    out = [low + i * (high - low) / bins for i in range(bins)] + [high]
    if not pad:
        out[0] -= 0.001 * (high - low)
    return out


def _shortened(x: float, digits: int) -> float:
    """x to so many digits after the point, or, below 1, to so many that are not leading zeros."""
    if x == 0 or not math.isfinite(x):
        return x
    return round(x, digits if abs(x) >= 1 else digits - 1 - math.floor(math.log10(abs(x))))


def shown_edges(edges: list[float]) -> list[float]:
    """Edges to three digits, or as many more as keep them apart."""
    short = edges
    for digits in range(3, 20):
        short = [_shortened(e, digits) for e in edges]
        if len(set(short)) == len(set(edges)):
            break
    return short


def bin_of(value, edges: list[float]):
    """A value's bin: bins are closed on the right, and the first holds the least value too."""
    above = [(value > e).cast("int") for e in edges[1:-1]]
    out = F.lit(0)
    for a in above:
        out = out + a
    return out


def histogram(df: DataFrame, name: str, bins: int = 10, bounds: tuple[float, float] | None = None) -> DataFrame:
    """bin, low, high, frequency of bins of equal width between the least and greatest value; no rows without values.
    low and high are rounded, the bins are not."""
    value = _c(name).cast("double")
    value = F.when(~F.isnan(value), value)
    if bounds is None:
        r = df.agg(F.min(value).alias("a"), F.max(value).alias("b")).first()
        bounds = (r.a, r.b)
    spark = df.sparkSession
    if bounds[0] is None:
        return spark.createDataFrame([], "bin int, low double, high double, frequency long")
    edges = edges_of(*bounds, bins)
    counts = df.where(value.isNotNull()).groupBy(bin_of(value, edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    shown = shown_edges(edges)
    every = spark.createDataFrame([(i, shown[i], shown[i + 1]) for i in range(bins)], "bin int, low double, high double")
    return every.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("frequency"))


def quantile_edges(df: DataFrame, name: str, bins: int = 10) -> list[float]:
    """Distinct edges of bins that hold equally many values."""
    from .quantiles import quantiles

    found = quantiles(df, [name], [i / bins for i in range(bins + 1)])[name]
    return sorted(set(found)) if found else []
