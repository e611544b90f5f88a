"""Dependence between pairs of columns: Pearson, Spearman, adjusted mutual information, and the greatest of them.

Columns are prepared in one projection: codes of quantile bins or categories, ranks, numbers. All Pearson sums come from one
aggregation over all pairs. Spearman ranks come from counts by value, without ordering all rows in one task. The contingency
table of a pair is an aggregation, and only its marginal sizes, collapsed by frequency, enter the expected information.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import config
from ..errors import SparseDataWarning
from ..functions import logical_types as L
from ..plans.registry import warn
from ..scratch import written
from . import counts
from .places import PART, ordered
from .progress import Progress
from .catalog import valid_mi_types, valid_pearson_types, valid_spearman_types

MEASURES = ["pearson", "spearman", "mutual_info"]
SHOWN = ["max", "pearson", "spearman", "mutual_info"]

#: Pairs of columns whose moments one aggregation takes.
PAIRS = 100

#: Category columns with more values than this may be left out together.
LARGE_CATEGORY = 800


def parse_measures(measures) -> tuple[list[str], list[str]]:
    """Measures to calculate, in order, and those to return."""
    asked = [measures] if isinstance(measures, str) else list(measures)
    known = config.get_option("correlation_metrics")
    if not asked:
        raise ValueError("no measures are asked for")
    if bad := [m for m in asked if m not in known]:
        raise ValueError(f"unknown measure '{bad[0]}'; known are {', '.join(known)}")
    if "all" in asked:
        if len(asked) > 1:
            warn("'all' makes the other measures superfluous", UserWarning)
        return MEASURES, SHOWN
    calculated = MEASURES if "max" in asked else [m for m in MEASURES if m in asked]
    return calculated, ["max"] if asked == ["max"] else [m for m in asked]


def adjusted_mutual_information(table: list[tuple[int, int, int, int]], rows: dict[int, int], cols: dict[int, int]) -> float:
    """From a contingency table collapsed by equal sizes: (row total, column total, count, how many such cells), and how many
    rows and columns there are of each total. Normalised by the mean entropy, expectation under the hypergeometric model.
    """
    n = sum(a * k for a, k in rows.items())
    if sum(rows.values()) == 1 and sum(cols.values()) == 1:
        return 1.0
    entropy = lambda side: -sum(k * a / n * math.log(a / n) for a, k in side.items())
    hu, hv = entropy(rows), entropy(cols)
    info = sum(w * c / n * math.log(n * c / (a * b)) for a, b, c, w in table)
    expected = sum(k * m * _expected(a, b, n) for a, k in rows.items() for b, m in cols.items())
    norm = (hu + hv) / 2 - expected
    gain = info - expected
    if abs(norm) < 1e-15:
        norm = math.copysign(2.220446049250313e-16, norm)
    return gain / norm


#: Terms of an expectation that are all added up; standard deviations to each side that are looked at; points in one of them where
#: there are more terms.
WHOLE, REACH, FINE = 4096, 40, 50


def _expected(a: int, b: int, n: int) -> float:
    """Expected information of a cell with marginals a and b among n: the sum over the cell's sizes c, in hypergeometric shares, of
    c/n log(nc/ab). Sizes beyond REACH deviations add nothing that a double shows. Where deviations are large the shares change so
    slowly that equally spaced sizes give the sum: the number of terms has a bound that rows don't move."""
    low, high = max(0, a + b - n), min(a, b)
    mean = a * b / n
    deviation = math.sqrt(mean * (1 - a / n) * (1 - b / n) * n / max(n - 1, 1))
    low, high = max(low, math.floor(mean - REACH * deviation) - 8), min(high, math.ceil(mean + REACH * deviation) + 8)
    step = 1 if high - low <= WHOLE else max(1, math.floor(deviation / FINE))
    middle = round(mean)
    c = np.arange(middle - (middle - low) // step * step, high + 1, step, dtype=float)
    share = np.exp(_log_binomial(c, a, b / n) + _log_binomial(b - c, n - a, b / n) - _log_binomial(np.array([float(b)]), n, b / n))
    information = np.zeros_like(c)
    some = c > 0
    information[some] = c[some] / n * np.log1p((c[some] - mean) / mean)
    return float((share * information).sum() / share.sum())


def _log_binomial(x: np.ndarray, n: int, p: float) -> np.ndarray:
    """log of the binomial mass by deviances and the error of Stirling's formula, which keeps its digits for large n."""
    if p >= 1.0 or n == 0:
        return np.where(x == n * (p >= 1.0), 0.0, -np.inf)
    out = np.empty_like(x)
    inner = (x > 0) & (x < n)
    y = x[inner]
    out[inner] = _stirling_error(np.array([float(n)])) - _stirling_error(y) - _stirling_error(n - y) - _deviance(y, n * p) - _deviance(n - y, n * (1 - p)) + 0.5 * np.log(n / (2 * math.pi * y * (n - y)))
    out[x == 0] = n * math.log1p(-p)
    out[x == n] = n * math.log(p)
    out[(x < 0) | (x > n)] = -np.inf
    return out


def _stirling_error(x: np.ndarray) -> np.ndarray:
    """log x! less Stirling's formula for it, for whole x above 0."""
    y = 1 / np.maximum(x, 16) ** 2
    out = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - y / 1188) * y) * y) * y) / np.maximum(x, 16)
    small = x < 16
    if small.any():
        table = np.array([0.0] + [math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi) for k in range(1, 16)])
        out[small] = table[x[small].astype(int)]
    return out


def _deviance(x: np.ndarray, m: float) -> np.ndarray:
    """x log(x/m) + m - x; near m by a series, as it would lose all digits."""
    d = (x - m) / (x + m)
    out = x * np.log(x / m) + m - x
    near = np.abs(d) < 0.1
    z, e = d[near], d[near] ** 2
    total, power = (x[near] - m) * z, 2 * x[near] * z
    for k in range(1, 12):
        power = power * e
        total = total + power / (2 * k + 1)
    out[near] = total
    return out


def _information(df: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float]:
    """Adjusted mutual information of code columns, over the rows where both are not null.

    Every pair's cells are aggregated by one exploded job; what comes to the driver are counts of equal (marginal, marginal,
    cell) sizes, of which there are few however many categories and rows there are.
    """
    out: dict[tuple[str, str], float] = {}
    for at in range(0, len(pairs), 24):
        group = pairs[at : at + 24]
        each = F.array(*(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.lit(i).alias("p"), F.col(a).cast("string").alias("u"), F.col(b).cast("string").alias("v"))) for i, (a, b) in enumerate(group)))
        cells = df.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).groupBy("x.p", "x.u", "x.v").agg(F.count(F.lit(1)).alias("c"))
        us = cells.groupBy("p", "u").agg(F.sum("c").alias("a"))
        vs = cells.groupBy("p", "v").agg(F.sum("c").alias("b"))
        sizes = cells.join(us, ["p", "u"]).join(vs, ["p", "v"]).groupBy("p", "a", "b", "c").agg(F.count(F.lit(1)).alias("w"))
        kind = lambda d, k, s: d.groupBy("p", k).agg(F.count(F.lit(1)).alias("w")).select("p", F.lit(s).alias("side"), F.col(k).alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("c"), "w")
        rows = sizes.select("p", F.lit(0).alias("side"), "a", "b", "c", "w").unionByName(kind(us, "a", 1)).unionByName(kind(vs, "b", 2))

        def score(x: pd.DataFrame) -> pd.DataFrame:
            table = [tuple(map(int, r)) for r in x[x.side == 0][["a", "b", "c", "w"]].itertuples(index=False)]
            sides = [dict(zip(y.a.astype(int), y.w.astype(int), strict=True)) for y in (x[x.side == s] for s in (1, 2))]
            return pd.DataFrame({"p": [int(x.p.iloc[0])], "score": [adjusted_mutual_information(table, *sides)]})

        for r in rows.groupBy("p").applyInPandas(score, "p int, score double").collect():
            out[group[r.p]] = r.score
    return out


def ranked(df: DataFrame, names: list[str], row: str) -> DataFrame:
    """The columns' average ranks among their own values, null where they are null. `row` names a column that tells rows apart.

    Ranks of values come from counts by (column, value) of all columns at once: running sums within written ranges, to which the
    totals of the ranges before are added. Columns of few values, as counted, take theirs from tables sent to all tasks. The rows
    of all others are turned into (row, column, value), which meet the ranks in one join, and back into rows in one grouping.
    """
    spark = df.sparkSession
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.col(n).alias("v")) for i, n in enumerate(names)))
    by = df.select(F.explode(each).alias("x")).where("x.v is not null").groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("n"))
    ranges = ordered(by, ["i", "v"]).rows
    totals = ranges.groupBy("i", PART).agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k")).collect()  # at most a row a range and column
    bases, sizes = [], Counter()
    running: Counter = Counter()
    for r in sorted(totals, key=lambda r: (r.i, r[PART])):
        bases.append((r.i, r[PART], running[r.i]))
        running[r.i] += r.t
        sizes[r.i] += r.k
    before = F.broadcast(spark.createDataFrame(bases, f"i int, {PART} int, before long"))
    upto = F.sum("n").over(Window.partitionBy("i", PART).orderBy("v"))
    ranks = ranges.withColumn("upto", upto).join(before, ["i", PART]).select("i", "v", (F.col("before") + F.col("upto") - (F.col("n") - 1) / 2).alias("r"))
    most = config.get_option("broadcast_rows")
    few, many = [i for i in range(len(names)) if sizes[i] <= most], [i for i in range(len(names)) if sizes[i] > most]
    near = df.select(row, *names)
    for i in few:
        own = ranks.where(F.col("i") == i).select(F.col("v").alias("_v"), F.col("r").alias(f"_r{i}"))
        near = near.join(F.broadcast(own), F.col(names[i]) == F.col("_v"), "left").drop("_v")
    if not many:
        return near.select(*(F.col(f"_r{i}").alias(n) for i, n in enumerate(names)))
    held = F.struct(*(F.col(f"_r{i}").alias(f"r{i}") for i in few)) if few else F.lit(None).cast("struct<none:int>")
    kind = near.select(held.alias("held")).schema["held"].dataType
    long = df.select(row, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(names[i]).alias("v")) for i in many))).alias("x")).where("x.v is not null").select(row, "x.i", "x.v")
    met = long.join(ranks, ["i", "v"]).select(row, "i", "r", F.lit(None).cast(kind).alias("held"))
    if few:
        met = met.unionByName(near.select(row, F.lit(-1).alias("i"), F.lit(None).cast("double").alias("r"), held.alias("held")))
    wide = met.groupBy(row).agg(F.max("held").alias("held"), *(F.max(F.when(F.col("i") == i, F.col("r"))).alias(f"_r{i}") for i in many))
    return wide.select(*(F.col(f"held.r{i}" if i in few else f"_r{i}").alias(n) for i, n in enumerate(names)))


def _moments(df: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float | None]:
    """Pearson's correlation of number columns over the rows where both are not null; None if one is constant there."""
    out = {}
    for at in range(0, len(pairs), PAIRS):
        group, exprs = pairs[at : at + PAIRS], []
        for i, (a, b) in enumerate(group):
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
            exprs.append((F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))).alias(f"r{i}"))
        row = df.agg(*exprs).first()
        for i, p in enumerate(group):
            out[p] = None if row[i] is None else max(-1.0, min(1.0, row[i]))
    return out


def dependence(table, measures="all", num_bins: int = 10, nrows: int | None = None, include_index: bool = False, include_time_index: bool = False, callback=None, extra_stats: bool = False, min_shared: int = 25, random_seed: int = 0, max_nunique: int = 6000, target_col: str | None = None) -> DataFrame:
    """column_1, column_2 and each measure (null where too sparse or undefined), by falling size of the first of them.

    A score is scaled by the share of the rows where both columns have values among those where either has. With nrows a
    seeded sample of so many rows is used. extra_stats adds shared_rows and, with max, measure_used.
    """
    calculated, shown = parse_measures(measures)
    if target_col is not None and target_col not in table.schema.columns:
        raise ValueError(f"there is no column '{target_col}'")
    df, schemas = table.df, table.schema.columns
    skip = {table.index} if not include_index else set()
    skip |= {table.time_index} if not include_time_index else set()
    valid = {"pearson": valid_pearson_types(), "spearman": valid_spearman_types(), "mutual_info": valid_mi_types()}
    fits = {}
    for m in calculated:
        booleans = (L.Boolean, L.BooleanNullable)
        fits[m] = [c for c, s in schemas.items() if c not in skip and s.logical_type is not None and (type(s.logical_type) in (*valid[m], *booleans) or bool(s.standard_tags & {"numeric"}))]
    columns = [c for c in schemas if any(c in f for f in fits.values())]
    place = {c: f"c{i}" for i, c in enumerate(columns)}
    data = df.select(*(F.col(f"`{c}`").alias(place[c]) for c in columns))
    if nrows is not None and nrows < data.count():  # by a hash of the row, so that the sample does not depend on how rows lie
        data = data.orderBy(F.xxhash64(F.lit(random_seed), *data.columns), *data.columns).limit(nrows)
    if columns:
        row = data.agg(*(F.count(place[c]).alias(place[c]) for c in columns)).first()
        columns = [c for c in columns if row[place[c]]]
    if "mutual_info" in calculated:
        columns = _without_large(data, columns, schemas, place, max_nunique)
    fits = {m: [c for c in f if c in columns] for m, f in fits.items()}
    numbers, codes, exprs, binned = {}, {}, [], []
    for c in columns:
        s, x = schemas[c], F.col(place[c])
        number = x
        if s.is_datetime:
            number = F.unix_micros(F.to_utc_timestamp(x, "UTC").cast("timestamp"))
        elif s.is_ordinal:
            number = s.logical_type.rank(x)
        elif s.is_boolean:
            number = x.cast("int")
        if s.is_numeric or s.is_datetime or s.is_ordinal or s.is_boolean:
            numbers[c] = f"n{place[c][1:]}"
            exprs.append(number.cast("double").alias(numbers[c]))
        if c in fits.get("mutual_info", ()):
            codes[c] = f"k{place[c][1:]}"
            if s.is_numeric or s.is_datetime:
                binned.append(c)
            else:
                exprs.append(x.alias(codes[c]))
    data = written(data.select(*exprs, F.monotonically_increasing_id().alias("row")), "dependence")  # every aggregation below reads it
    if binned:
        extremes = data.agg(*(e for i, c in enumerate(binned) for e in (F.min(numbers[c]).alias(f"a{i}"), F.max(numbers[c]).alias(f"b{i}")))).first()
        more = data.agg(*(F.count_if((F.col(numbers[c]) != extremes[f"a{i}"]) & (F.col(numbers[c]) != extremes[f"b{i}"])).alias(f"o{i}") for i, c in enumerate(binned))).first()
        from .quantiles import quantiles

        many = [c for i, c in enumerate(binned) if more[f"o{i}"]]
        found = quantiles(data, [numbers[c] for c in many], [i / num_bins for i in range(num_bins + 1)])
        extra = []
        for c in binned:
            if c in many:
                edges = sorted(set(found[numbers[c]]))
                extra.append(F.when(F.col(numbers[c]).isNotNull(), counts.bin_of(F.col(numbers[c]), edges)).alias(codes[c]))
            else:
                extra.append(F.col(numbers[c]).alias(codes[c]))
        data = data.select("*", *extra)

    def pairs_of(m):
        f = fits.get(m, [])
        return [(c, target_col) for c in f if c != target_col] if target_col is not None and target_col in f else [] if target_col is not None else list(combinations(f, 2))

    every = [p for m in calculated for p in pairs_of(m)]
    every = sorted(set(every), key=lambda p: (columns.index(p[0]), columns.index(p[1])))
    any_ = lambda c: numbers.get(c) or codes[c]
    shared = {}
    for at in range(0, len(every), 200):
        group = every[at : at + 200]
        row = data.agg(*(e for i, (a, b) in enumerate(group) for e in (F.count_if(F.col(any_(a)).isNotNull() & F.col(any_(b)).isNotNull()).alias(f"s{i}"), F.count_if(F.col(any_(a)).isNotNull() | F.col(any_(b)).isNotNull()).alias(f"u{i}")))).first()
        for i, p in enumerate(group):
            shared[p] = (row[f"s{i}"], row[f"u{i}"])
    dense = {p for p in every if shared[p][0] >= min_shared}
    if len(dense) < len(every):
        warn("some pairs of columns share too few rows to be measured", SparseDataWarning)
    progress = Progress(callback, sum(len(pairs_of(m)) for m in calculated))
    scores: dict[str, dict] = {}
    for m in calculated:
        todo = [p for p in pairs_of(m) if p in dense]
        if m == "pearson":
            got = _moments(data, [(numbers[a], numbers[b]) for a, b in todo])
            scores[m] = {(a, b): got[numbers[a], numbers[b]] for a, b in todo}
        elif m == "spearman":
            scores[m] = _spearman(data, todo, numbers)
        else:
            got = _information(data, [(codes[a], codes[b]) for a, b in todo])
            scores[m] = {(a, b): got.get((codes[a], codes[b])) for a, b in todo}
        scores[m] = {p: None if v is None else v * shared[p][0] / shared[p][1] for p, v in scores[m].items()}
        progress.step(len(pairs_of(m)))
    rows = []
    for p in every:
        own = {m: scores[m].get(p) for m in calculated}
        known = [(abs(own[m]), -i, m) for i, m in enumerate(("mutual_info", "pearson", "spearman")) if own.get(m) is not None]
        used = max(known)[2] if known else "too sparse" if p not in dense else None
        own["max"] = own[used] if known else None
        rows.append((*p, *(own.get(m) for m in shown), shared[p][0], used))
    rows.sort(key=lambda r: (r[2] is None, -abs(r[2] or 0.0)))
    schema = ", ".join(["column_1 string", "column_2 string", *(f"{m} double" for m in shown), "shared_rows long", "measure_used string"])
    out = df.sparkSession.createDataFrame(rows, schema)
    if not extra_stats:
        return out.drop("shared_rows", "measure_used")
    return out if "max" in shown else out.drop("measure_used")


def _spearman(data: DataFrame, pairs: list[tuple[str, str]], numbers: dict[str, str]) -> dict:
    """Correlations of average ranks among the rows where both have values.

    A column is ranked once for each set of rows that a partner's nulls leave of it: once for all partners without nulls.
    """
    names = sorted({numbers[c] for p in pairs for c in p})
    if not names:
        return {}
    row = data.agg(*(F.count_if(F.col(n).isNull()).alias(n) for n in names)).first()
    holey = {n for n in names if row[n]}
    views: dict[tuple[str, str | None], str] = {}

    def view(own: str, other: str) -> str:
        return views.setdefault((own, other if other in holey else None), f"v{len(views)}")

    used = [(view(numbers[a], numbers[b]), view(numbers[b], numbers[a])) for a, b in pairs]
    held = data.select("row", *(F.col(own).alias(v) if other is None else F.when(F.col(other).isNotNull(), F.col(own)).alias(v) for (own, other), v in views.items()))
    ranks = ranked(held, list(views.values()), "row")
    got = _moments(written(ranks, "ranked") if len(used) > PAIRS else ranks, used)
    return {p: got[u] for p, u in zip(pairs, used, strict=True)}


def valid_mi_columns(table, include_index: bool = False, include_time_index: bool = False) -> list[str]:
    """Columns whose types mutual information can be measured of."""
    skip = {None} | ({table.index} if not include_index else set()) | ({table.time_index} if not include_time_index else set())
    return [c for c, s in table.schema.columns.items() if c not in skip and isinstance(s.logical_type, tuple(valid_mi_types()))]


def _without_large(data: DataFrame, columns: list[str], schemas, place: dict, most: int) -> list[str]:
    """Leaves out categories with very many values, the largest first, while two or more of them have more than `most` together."""
    categories = [c for c in columns if schemas[c].is_categorical]
    if len(categories) < 2:
        return columns
    from .modes import distinct_and_mode

    found = distinct_and_mode(data, [place[c] for c in categories], [])
    sizes = {c: found[place[c]][0] for c in categories if found[place[c]][0] > LARGE_CATEGORY}
    gone = []
    while len(sizes) > 1 and sum(sizes.values()) > most:
        gone.append(max(sizes, key=lambda c: sizes[c]))
        sizes.pop(gone[-1])
    if gone:
        warn(f"left out for their many values: {', '.join(gone)}", UserWarning)
    return [c for c in columns if c not in gone]
