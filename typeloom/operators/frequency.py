"""Time-series frequencies: the alias that fits all timestamps of a column and, in debug mode, where a noisy series departs
from its most likely frequency.

Aliases are B (weekdays), D, W-MON to W-SUN, M and MS (month ends and starts), BM and BMS (their weekday variants), SM (15th
and month end), Q-DEC and BQ-DEC, QS-JAN and so on, A-DEC and AS-JAN and so on, H, T, S, L (milliseconds) and U
(microseconds), with a multiple in front where it is not 1.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import config
from ..functions import logical_types as L
from ..scratch import written
from .places import numbered

NO_FREQ = "NO_FREQ"

#: Consecutive timestamps whose windows one group of rows holds; timestamps that a task makes.
BLOCK, STEPS_A_TASK = 50_000, 1_000_000
MICROS = [("D", 86_400_000_000), ("H", 3_600_000_000), ("T", 60_000_000), ("S", 1_000_000), ("L", 1_000), ("U", 1)]
DAYS = ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"]
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def series(spark: SparkSession, alias: str, first: datetime, last: datetime) -> DataFrame:
    """pos (from 0) and ts of every timestamp from first to last at an alias; first must be one. Made by tasks, not by the driver."""
    digits = len(alias) - len(alias.lstrip("0123456789"))
    k, base = int(alias[:digits] or 1), alias[digits:].split("-")[0]
    unit = dict(MICROS) | {"W": 7 * MICROS[0][1]}
    start = F.lit(first).cast("timestamp_ntz")
    micros = int((last - first) / timedelta(microseconds=1))
    steps = lambda n: spark.range(0, max(0, n), numPartitions=max(1, min(4096, n // STEPS_A_TASK + 1)))
    if base in unit:
        return steps(micros // (unit[base] * k) + 1).select(F.col("id").alias("pos"), F.timestamp_add("MICROSECOND", F.col("id") * (unit[base] * k), start).alias("ts"))
    if base == "B":
        days = steps(micros // MICROS[0][1] + 1).select(F.timestamp_add("DAY", F.col("id"), start).alias("ts")).where(F.weekday("ts") < 5)
        return numbered(days, ["ts"], "pos").select("pos", "ts")
    each = {"A": 12, "AS": 12, "BA": 12, "BAS": 12, "Q": 3, "QS": 3, "BQ": 3, "BQS": 3}.get(base, 1) * k
    many = (last.year * 12 + last.month - first.year * 12 - first.month) // (1 if base == "SM" else each) + 1
    month = F.add_months(F.trunc(start, "month"), (F.col("id") * (1 if base == "SM" else each)).cast("int"))
    early, late = (first_weekday(month), last_weekday(month)) if base.startswith("B") else (month, F.last_day(month))
    days = [F.date_add(month, 14), F.last_day(month)] if base == "SM" else [early if base.endswith("S") else late]
    clock = F.timestamp_diff("MICROSECOND", F.date_trunc("day", start), start)
    made = steps(many).select(F.explode(F.array(*days)).alias("d")).select(F.timestamp_add("MICROSECOND", clock, F.col("d").cast("timestamp_ntz")).alias("ts"))
    return numbered(made.where((F.col("ts") >= start) & (F.col("ts") <= F.lit(last).cast("timestamp_ntz"))), ["ts"], "pos").select("pos", "ts")


def last_weekday(day):
    """The last weekday of a day's month."""
    last = F.last_day(day)
    return F.date_sub(last, F.greatest(F.lit(0), F.weekday(last) - 4))


def first_weekday(day):
    first = F.trunc(day, "month")
    return F.date_add(first, F.when(F.weekday(first) > 4, 7 - F.weekday(first)).otherwise(0))


class Message(Enum):
    """Why no frequency is estimated. Results must equal them."""

    EMPTY = "datetime_series_is_empty"
    UNORDERED = "datetime_series_is_not_monotonic"
    SHORT = "datetime_series_is_not_long_enough"
    UNFIT = "datetime_series_freq_cannot_be_estimated"


@dataclass
class Range:
    dt: str
    idx: int
    range: int


@dataclass
class Debug:
    actual_range_start: str | None = None
    actual_range_end: str | None = None
    message: str | None = None
    estimated_freq: str | None = None
    estimated_range_start: str | None = None
    estimated_range_end: str | None = None
    duplicate_values: list[Range] = field(default_factory=list)
    missing_values: list[Range] = field(default_factory=list)
    extra_values: list[Range] = field(default_factory=list)
    nan_values: list[Range] = field(default_factory=list)


def positioned(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """pos (from 0) and ts of a column."""
    return numbered(df.select(F.col(f"`{name}`").alias("ts"), *(F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order))), [f"o{i}" for i in range(len(order))], "pos").select("pos", "ts")


def runs(rows: DataFrame, pos: str = "pos", ts: str = "ts") -> DataFrame:
    """dt (the first timestamp), idx and range of each run of consecutive places."""
    keyed = numbered(rows, [pos], "_k").withColumn("_g", F.col(pos) - F.col("_k"))
    return keyed.groupBy("_g").agg(F.min_by(ts, pos).alias("dt"), F.min(pos).alias("idx"), F.count(F.lit(1)).alias("range")).drop("_g")


def duplicates(rows: DataFrame) -> DataFrame:
    """Places whose timestamp also stands at an earlier place."""
    first = rows.where(F.col("ts").isNotNull()).groupBy("ts").agg(F.min("pos").alias("first"))
    return rows.join(first, "ts").where(F.col("pos") > F.col("first")).select("pos", "ts")


def missing(estimated: DataFrame, observed: DataFrame) -> DataFrame:
    """Places of the estimated series whose timestamp is not observed."""
    return estimated.join(observed.select("ts"), "ts", "left_anti").select("pos", "ts")


def candidates(rows: DataFrame, window: int | None = None) -> DataFrame:
    """alias, count, min_dt and max_dt over every window of consecutive timestamps: rows is (pos, ts), without nulls and repeats."""
    window = window or config.get_option("frequency_window_length")

    # Blocks of consecutive places, each with the first rows of the next, so that every window lies within one block.
    dense = positioned(rows, "ts", ["pos"])
    home = F.floor(F.col("pos") / BLOCK)
    shared = F.when(F.col("pos") % BLOCK < window - 1, F.array(home - 1, home)).otherwise(F.array(home))
    blocks = dense.withColumn("_home", home).withColumn("_block", F.explode(shared))
    order = Window.partitionBy("_block").orderBy("pos")
    near = blocks.withColumn("b", F.lag("ts").over(order))
    whole, moves = order.rowsBetween(0, window - 1), order.rowsBetween(1, window - 1)
    facts = {k: f.over(moves if of_moves else whole) for k, (f, of_moves) in _facts().items()}
    full = near.select("_home", "_block", "ts", F.lead("ts", window - 1).over(order).alias("end"), F.count(F.lit(1)).over(whole).alias("many"), *(f.alias(k) for k, f in facts.items()))
    full = full.where((F.col("_home") == F.col("_block")) & (F.col("many") == window))
    return full.select(F.coalesce(_alias(), F.lit(NO_FREQ)).alias("alias"), "ts", "end").groupBy("alias").agg(F.count(F.lit(1)).alias("count"), F.min("ts").alias("min_dt"), F.max("end").alias("max_dt"))


def _micros(c) -> Column:
    return F.unix_micros(F.to_utc_timestamp(c, "UTC").cast("timestamp"))


def _facts() -> dict[str, tuple[Column, bool]]:
    """Aggregates over consecutive timestamps ts, b being the one before, that settle their alias; and which of them are about the
    moves from b to ts. False is 0 and true 1."""
    day, months = F.to_date("ts"), F.year("ts") * 12 + F.month("ts")
    move, step = _micros("ts") - _micros("b"), months - (F.year("b") * 12 + F.month("b"))
    weekdays = (F.weekday("ts") < 5) & (F.weekday("b") < 5) & (F.datediff("ts", "b") == F.when(F.weekday("b") == 4, 3).otherwise(1))
    half = ((F.dayofmonth("ts") == 15) != (F.dayofmonth("b") == 15)) & step.isin(0, 1) & ((F.dayofmonth("ts") == 15) | (day == F.last_day("ts"))) & ((F.dayofmonth("b") == 15) | (F.to_date("b") == F.last_day("b")))
    clock = F.date_format("ts", "HHmmssSSSSSS")
    every = lambda x: F.min(x.cast("int"))
    return {
        "low": (F.min(move), True), "high": (F.max(move), True), "mlow": (F.min(step), True), "mhigh": (F.max(step), True), "weekdays": (every(weekdays), True), "half": (every(half), True),
        "clock1": (F.min(clock), False), "clock2": (F.max(clock), False), "first": (F.min("ts"), False),
        "M": (every(day == F.last_day("ts")), False), "MS": (every(day == F.trunc("ts", "month")), False), "BM": (every(day == last_weekday("ts")), False), "BMS": (every(day == first_weekday("ts")), False),
    }


def _alias() -> Column:
    """The alias that the facts settle; null if none fits. Calendar aliases need one time of day."""
    step, week = F.col("low"), 7 * MICROS[0][1]
    times = lambda k: F.when(k > 1, k.cast("bigint").cast("string")).otherwise("")
    fixed = F.when(step % week == 0, F.concat(times(step / week), F.lit("W-"), F.array(*map(F.lit, DAYS))[F.weekday("first")]))
    for name, unit in MICROS:
        fixed = fixed.when(step % unit == 0, F.concat(times(step / unit), F.lit(name)))
    kind = F.when(F.col("M") == 1, "M").when(F.col("MS") == 1, "MS").when(F.col("BM") == 1, "BM").when(F.col("BMS") == 1, "BMS")
    long = lambda n, letter, anchor: F.concat(times(F.col("mlow") / n), F.when(kind.startswith("B"), "B").otherwise(""), F.lit(letter), F.when(kind.endswith("S"), "S").otherwise(""), F.lit("-"), F.array(*map(F.lit, MONTHS))[anchor])
    month = F.month("first") - 1
    calendar = F.when(F.col("mlow") % 12 == 0, long(12, "A", month)).when(F.col("mlow") % 3 == 0, long(3, "Q", month % 3 + 9)).otherwise(F.concat(times(F.col("mlow")), kind))
    months = (F.col("mlow") == F.col("mhigh")) & (F.col("mlow") > 0) & kind.isNotNull()
    out = F.when(F.col("low") <= 0, F.lit(None).cast("string")).when(F.col("low") == F.col("high"), fixed).when(F.col("clock1") != F.col("clock2"), F.lit(None).cast("string"))
    return out.when(months, calendar).when(F.col("weekdays") == 1, "B").when(F.col("half") == 1, "SM-15")


def steps(rows: DataFrame) -> DataFrame:
    """pos, ts and b, the timestamp at the place before: places are consecutive, so a join finds it."""
    return rows.join(rows.select((F.col("pos") + 1).alias("pos"), F.col("ts").alias("b")), "pos").where(F.col("b").isNotNull())


def infer_frequency(df: DataFrame, name: str, order: list[str] | None = None, debug: bool = False, window_length: int | None = None, threshold: float | None = None):
    """The alias that fits all of a column's timestamps, else None; with debug also where the series departs from its likeliest.

    Rows are in the order of `order`, or of the timestamps themselves. No alias fits a column that holds nulls; where it departs from
    its likeliest, they are left out.
    """
    window = window_length or config.get_option("frequency_window_length")
    threshold = threshold if threshold is not None else config.get_option("frequency_threshold")
    stamp = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.DayTimeIntervalType):
        df = df.withColumn(name, F.expr("timestamp_ntz'1970-01-01'") + stamp)
    else:
        df = df.withColumn(name, stamp.cast("timestamp_ntz"))
    return _inferred(positioned(df, name, order or [name]), window, threshold, debug)


def _inferred(rows: DataFrame, window: int, threshold: float, debug: bool):
    exact = None if _nulls(rows) else _exact(rows)
    if not debug:
        return exact
    out = Debug()
    if exact is not None:
        return exact, asdict(out)
    span = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("ts").alias("n")).first()
    if not span.n:
        out.message = Message.EMPTY.value
        return None, asdict(out)
    out.actual_range_start, out.actual_range_end = span.a.isoformat(), span.b.isoformat()
    ranges = lambda found: [Range(r.dt and r.dt.isoformat(), r.idx, r["range"]) for r in runs(found).orderBy("idx").collect()]
    out.nan_values = ranges(rows.where(F.col("ts").isNull()))
    out.duplicate_values = ranges(duplicates(rows))
    clean = written(rows.where(F.col("ts").isNotNull()).groupBy("ts").agg(F.min("pos").alias("pos")), "timestamps")
    if clean.count() < window:
        out.message = Message.SHORT.value
        return None, asdict(out)
    if steps(positioned(clean, "ts", ["pos"])).where("ts < b").take(1):
        out.message = Message.UNORDERED.value
        return None, asdict(out)
    found = candidates(clean, window).collect()
    total = sum(r["count"] for r in found)
    best = max(found, key=lambda r: (r["count"], r["alias"]))
    if best["alias"] == NO_FREQ or best["count"] / total < threshold:
        out.message = Message.UNFIT.value
        return None, asdict(out)
    out.estimated_freq, out.estimated_range_start, out.estimated_range_end = best["alias"], best.min_dt.isoformat(), best.max_dt.isoformat()
    estimated = series(rows.sparkSession, best["alias"], best.min_dt, best.max_dt)
    out.missing_values, out.extra_values = ranges(missing(estimated, clean)), ranges(missing(clean, estimated))
    return None, asdict(out)


def _nulls(rows: DataFrame) -> bool:
    return bool(rows.where(F.col("ts").isNull()).take(1))


def _exact(rows: DataFrame) -> str | None:
    """The alias of the whole series, from one aggregation over its moves and one over its timestamps."""
    made = _facts()
    moves = steps(rows).agg(F.count(F.lit(1)).alias("n"), *(f.alias(k) for k, (f, of_moves) in made.items() if of_moves))
    stamps = rows.agg(*(f.alias(k) for k, (f, of_moves) in made.items() if not of_moves))
    held = {**moves.first().asDict(), **stamps.first().asDict()}
    if held["n"] < 2:
        return None
    schema = T.StructType([*moves.schema.fields, *stamps.schema.fields])
    return rows.sparkSession.createDataFrame([tuple(held[f.name] for f in schema)], schema).select(_alias().alias("alias")).first().alias


def infer_temporal_frequencies(table, temporal_columns: list[str] | None = None, debug: bool = False) -> dict:
    """The frequency of every Datetime and Timedelta column, or of the named ones."""
    kinds = {c: s.logical_type for c, s in table.schema.columns.items()}
    if temporal_columns is None:
        temporal_columns = [c for c, k in kinds.items() if isinstance(k, (L.Datetime, L.Timedelta))]
    out = {}
    for c in temporal_columns:
        if c not in kinds:
            raise ValueError(f"there is no column '{c}'")
        if not isinstance(kinds[c], (L.Datetime, L.Timedelta)):
            raise TypeError(f"'{c}' is neither Datetime nor Timedelta")
        order = [x for x in (table.time_index, table.index) if x is not None] or None
        out[c] = infer_frequency(table.df, c, order, debug)
    return out
