"""Outlier bounds: box plots, and box plots adjusted by skewness by way of the medcouple."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import config
from .medcouples import whole_medcouple
from .quantiles import quantiles

QUARTILES = [0.0, 0.25, 0.5, 0.75, 1.0]


def medcouple(x: np.ndarray) -> float:
    """The median of the kernel ((b - m) - (m - a)) / (b - a) over values b at or above and a at or below the median m.

    For values equal to the median the kernel is the sign of i + j - k + 1 over their places among the k ties. The median of
    all kernels is found by bisection on the kernel's value, as rows of the kernel are sorted, in O(n) memory.
    """
    x = np.sort(x[~np.isnan(x)])
    if len(x) < 3:
        return 0.0
    m = (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2
    scale = np.abs(x - m).max()
    if scale == 0:
        return 0.0
    z = (x - m) / scale
    up, down = z[z >= 0][::-1], z[z <= 0][::-1]  # both from greatest to least
    ties = int((z == 0).sum())
    p, q = len(up), len(down)

    def kernel(i: int, js: np.ndarray) -> np.ndarray:
        a = up[i]
        b = down[js]
        with np.errstate(divide="ignore", invalid="ignore"):
            h = (a + b) / (a - b)
        if a == 0:
            tied = js < ties
            h = np.where(tied, np.sign((ties - 1) - (i - (p - ties)) - js), h)
        return h

    def counts(t: float) -> tuple[int, int]:
        """Kernels above t, and at or above t."""
        above = at = 0
        for i in range(p):
            h = kernel(i, np.arange(q))
            above += int((h > t).sum())
            at += int((h >= t).sum())
        return above, at

    total = p * q
    if total <= 4_000_000:
        return float(np.median(np.concatenate([kernel(i, np.arange(q)) for i in range(p)])))
    low, high = -1.0, 1.0
    place = total // 2
    for _ in range(40):
        mid = (low + high) / 2
        above, at = counts(mid)
        if above <= place < at:
            return mid
        low, high = (mid, high) if above > place else (low, mid)
    return (low + high) / 2


def _values(table, name: str, ignore_zeros: bool) -> tuple[DataFrame, str]:
    schema = table.schema.columns[name]
    if not schema.is_numeric:
        raise TypeError(f"'{name}' is not numeric")
    value = F.col(f"`{name}`").cast("double")
    keep = value.isNotNull() & ~F.isnan(value)
    if ignore_zeros:
        keep = keep & (value != 0)
    keys = [F.col(f"`{table.index}`").alias("index")] if table.index and table.index != name else [F.col(f"`{name}`").alias("index")] if table.index else []
    return table.df.where(keep).select(*keys, value.alias("value")), "index" if keys else ""


def _quartiles(values: DataFrame, given: dict | None) -> list[float] | None:
    if given is not None:
        if missing := [p for p in QUARTILES if p != 0.5 and p not in given]:
            raise ValueError(f"quantiles lack {missing}")
        return [given[0.0], given[0.25], given.get(0.5), given[0.75], given[1.0]]
    return quantiles(values, ["value"], QUARTILES)["value"]


def _bounded(table, name: str, bounds, method: str, q, include: bool, ignore_zeros: bool, more: dict) -> dict:
    low, high = (round(b, 5) for b in bounds)
    out = {"method": method, "low_bound": low, "high_bound": high, "quantiles": dict(zip(QUARTILES, q, strict=True)), **more}
    if include:
        rows = outlier_rows(table, name, low, high, ignore_zeros)
        found = rows.orderBy(*rows.columns[:1]).collect()
        for side in ("low", "high"):
            out[f"{side}_values"] = [r.value for r in found if r.side == side]
            if "index" in rows.columns:
                out[f"{side}_indices"] = [r["index"] for r in found if r.side == side]
    return out


def outlier_rows(table, name: str, low: float, high: float, ignore_zeros: bool = False) -> DataFrame:
    """index (if there is one), value and side (low or high) of the values outside the bounds."""
    values, _ = _values(table, name, ignore_zeros)
    side = F.when(F.col("value") < low, "low").when(F.col("value") > high, "high")
    return values.withColumn("side", side).where(F.col("side").isNotNull())


def _none(method: str, include: bool) -> dict:
    out = {"method": method, "low_bound": None, "high_bound": None, "quantiles": dict.fromkeys(QUARTILES)}
    return out | ({"low_values": [], "high_values": []} if include else {})


def box_plot(table, name: str, quantiles: dict | None = None, include_indices_and_values: bool = True, ignore_zeros: bool = False) -> dict:
    """Bounds one and a half interquartile ranges beyond the quartiles, within the values' own range."""
    values, _ = _values(table, name, ignore_zeros)
    q = _quartiles(values, quantiles)
    if q is None:
        return _none("box_plot", include_indices_and_values)
    spread = q[3] - q[1]
    bounds = max(q[0], q[1] - 1.5 * spread), min(q[4], q[3] + 1.5 * spread)
    return _bounded(table, name, bounds, "box_plot", q, include_indices_and_values, ignore_zeros, {})


def sampled_medcouple(table, name: str, ignore_zeros: bool = False) -> float | None:
    """The medcouple, to three digits, of the values or of a sample of medcouple_sample_size of them, of all if that is None; None
    without values."""
    values, _ = _values(table, name, ignore_zeros)
    most = config.get_option("medcouple_sample_size")
    if most is None:
        found = whole_medcouple(values)
        return found if found is None else round(found, 3) + 0.0
    n = values.count()
    if n == 0:
        return None
    if n > most:
        values = values.orderBy(F.xxhash64(F.lit(42), *values.columns), *values.columns).limit(most)  # however the rows lie
    return round(medcouple(values.select("value").toPandas()["value"].to_numpy(dtype=float)), 3)


def skewness(table, name: str, ignore_zeros: bool = False) -> float | None:
    """The third standardised moment of all values, not corrected for their number; None without values or if all are equal."""
    values, _ = _values(table, name, ignore_zeros)
    return values.agg(F.skewness("value").alias("s")).first().s


def medcouple_bounds(table, name: str, quantiles: dict | None = None, include_indices_and_values: bool = True, ignore_zeros: bool = False, mc: float | None = None) -> dict:
    """Box-plot bounds stretched on the side of the tail and shortened on the other, by the medcouple and the skewness."""
    values, _ = _values(table, name, ignore_zeros)
    q = _quartiles(values, quantiles)
    if q is None:
        return _none("medcouple", include_indices_and_values)
    mc = sampled_medcouple(table, name, ignore_zeros) if mc is None else mc
    k = min(abs(skewness(table, name, ignore_zeros) or 0.0), 3.5)
    a, b = (-k, k) if mc >= 0 else (k, -k)
    spread = q[3] - q[1]
    bounds = q[1] - 1.5 * math.exp(a * mc) * spread, q[3] + 1.5 * math.exp(b * mc) * spread
    bounds = max(q[0], bounds[0]), min(q[4], bounds[1])
    return _bounded(table, name, bounds, "medcouple", q, include_indices_and_values, ignore_zeros, {"medcouple_stat": mc})


def outliers(table, name: str, method: str = "best", quantiles: dict | None = None, include_indices_and_values: bool = True, ignore_zeros: bool = False) -> dict:
    """By box plot or medcouple; "best" takes the box plot where the medcouple is small."""
    if method not in ("best", "box_plot", "medcouple"):
        raise ValueError("method must be best, box_plot or medcouple")
    kw = {"quantiles": quantiles, "include_indices_and_values": include_indices_and_values, "ignore_zeros": ignore_zeros}
    if method == "box_plot":
        return box_plot(table, name, **kw)
    if method == "medcouple":
        return medcouple_bounds(table, name, **kw)
    mc = sampled_medcouple(table, name, ignore_zeros)
    if mc is None or abs(mc) < config.get_option("medcouple_threshold"):
        return box_plot(table, name, **kw)
    return medcouple_bounds(table, name, mc=mc, **kw)
