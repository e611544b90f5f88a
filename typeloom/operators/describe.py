"""Statistics of every column.

Sums, counts and extremes of all columns come from one aggregation, numbers of distinct values and modes from counts of hashes,
and quartiles from exact quantiles of all numeric columns together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import logical_types as L
from . import counts
from .modes import distinct_and_mode
from .progress import Progress
from .quantiles import quantiles

ROWS = ["physical_type", "logical_type", "semantic_tags", "count", "nunique", "nan_count", "mean", "mode", "std", "min", "first_quartile", "second_quartile", "third_quartile", "max", "num_true", "num_false"]


def describe_dict(table, include=None, callback: Callable | None = None, results_callback: Callable | None = None, extra_stats: bool = False, bins: int = 10, top_x: int = 10, recent_x: int = 10) -> dict[str, dict]:
    """Statistics by column; the index is left out. With extra_stats also histograms, top values, values in range and recent dates."""
    names = table.columns if include is None else table.schema.selected(include, names_too=True)
    names = [c for c in names if c != table.index]
    if include is not None and not names:
        raise ValueError("no columns fit the selection")
    df, schemas = table.df, table.schema.columns
    numeric = [c for c in names if schemas[c].is_numeric]
    dates = [c for c in names if schemas[c].is_datetime]
    booleans = [c for c in names if schemas[c].is_boolean]
    categories = [c for c in names if schemas[c].is_categorical]
    unknown = [c for c in names if isinstance(schemas[c].logical_type, L.Unknown) and not isinstance(df.schema[c].dataType, (T.MapType,))]
    modal = [c for c in names if not isinstance(df.schema[c].dataType, (T.MapType, T.BinaryType))]
    exprs, keys = [], []

    def want(c, stat, e):
        keys.append((c, stat))
        exprs.append(e.alias(f"x{len(exprs)}"))

    want(None, "n", F.count(F.lit(1)))
    for c in names:
        x = F.col(f"`{c}`")
        missing = L.LatLong.missing(x) if isinstance(schemas[c].logical_type, L.LatLong) else x.isNull()
        want(c, "nan_count", F.count_if(missing))
        if c in numeric:
            for stat, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
                want(c, stat, f(x))
        elif c in dates:
            want(c, "min", F.min(x))
            want(c, "max", F.max(x))
            want(c, "mean", F.timestamp_micros(F.avg(F.unix_micros(F.to_utc_timestamp(x, "UTC").cast("timestamp"))).cast("bigint")).cast("timestamp_ntz"))
        elif c in booleans:
            want(c, "num_true", F.count_if(x))
            want(c, "num_false", F.count_if(~x))
    got: dict = {}
    for (c, stat), v in zip(keys, df.agg(*exprs).first(), strict=True):
        got.setdefault(c, {})[stat] = v
    total = got.pop(None)["n"]
    progress = Progress(callback, len(names))
    distinct = distinct_and_mode(df, modal, modal)
    quart = quantiles(df, numeric, [0.25, 0.5, 0.75])
    out: dict[str, dict] = {}
    for c in names:
        own = got.get(c, {})
        stats = {"physical_type": table.physical_types[c], "logical_type": schemas[c].logical_type, "semantic_tags": schemas[c].semantic_tags, "count": total - own["nan_count"], "nan_count": own["nan_count"]}
        if c in numeric or c in dates or c in categories or c in unknown:
            stats["nunique"] = distinct[c][0]
        if c in modal:
            stats["mode"] = distinct[c][1]
        stats |= {k: v for k, v in own.items() if k != "nan_count"}
        if c in numeric and quart[c] is not None:
            stats |= dict(zip(("first_quartile", "second_quartile", "third_quartile"), quart[c], strict=True))
        if extra_stats:
            stats |= _extra(table, c, stats, bins, top_x, recent_x)
        out[c] = stats
        progress.step()
        if results_callback is not None:
            results_callback(out, {c: stats})
    return out


def _extra(table, c: str, stats: dict, bins: int, top_x: int, recent_x: int) -> dict:
    df, schema = table.df, table.schema.columns[c]
    listed = lambda rows: [{"value": r["value"], "count": r["count"]} for r in rows.collect()]
    if schema.is_categorical:
        return {"top_values": listed(counts.top_counts(df, c, top_x, dropna=True))}
    if schema.is_datetime:
        return {"recent_values": listed(counts.recent_counts(df, c, recent_x))}
    if schema.is_numeric:
        bounds = (stats.get("min"), stats.get("max"))
        rows = counts.histogram(df, c, bins, None if bounds[0] is None else tuple(map(float, bounds))).orderBy("bin").collect()
        out = {"histogram": [{"bins": [r.low, r.high], "frequency": r.frequency} for r in rows]}
        whole = isinstance(schema.logical_type, L.IntegerNullable)
        if whole and bounds[0] is not None and bounds[1] - bounds[0] + 1 <= bins:
            out["top_values"] = listed(counts.range_counts(df, c, int(bounds[0]), int(bounds[1])))
        return out
    return {}


def describe(table, include=None, **kw) -> DataFrame:
    """A row a column, with the statistics as strings in a fixed order of columns."""
    found = describe_dict(table, include, **kw)

    def text(v):
        return None if v is None else ", ".join(sorted(v)) if isinstance(v, (set, frozenset)) else str(v)

    rows = [(c, *(text(s.get(k)) for k in ROWS)) for c, s in found.items()]
    return table.df.sparkSession.createDataFrame(rows, ", ".join(["column string", *(f"{k} string" for k in ROWS)]))
