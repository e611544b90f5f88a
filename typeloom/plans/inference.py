"""Inference of logical types from data.

What the rules need to know of all columns is gathered in aggregations, over a sample where the table is large. A look at a
few rows first refutes most of what has to hold for every value; one pass over the sample settles what is left, and another
counts frequent words in columns that no rule fits, or tries formats on strings that look like datetimes. The walk over the
type graph then runs on the driver.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import config
from ..functions import datetimes
from ..functions import logical_types as L
from ..operators.samples import exact_sample
from .registry import OfValues, TypeSystem, type_system
from .words import COMMON

SEED = 42
_INT = r"^\s*[+-]?\d+(_\d+)*\s*$"
_FLOAT = r"(?i)^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+)?|inf(inity)?|nan)\s*$"
_SPLIT = r"[- \[\].,!\?;\n]"


def sampled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, or exactly `rows` of its rows, chosen by a seed and written once for all looks, where it has more."""
    return exact_sample(df, rows or config.get_option("inference_sample_rows"), SEED, some_files=True)


#: Rows that the first look is at; distinct values, at most, among which a pair of words for true and false is looked for.
HEAD_ROWS, FEW = 1000, 64


def frequent_words(c: Column) -> Column:
    """How many of a text's words are frequent ones, on average."""
    words = sorted(config.get_option("common_words") or COMMON)
    return F.avg(F.size(F.filter(F.split(F.lower(c), _SPLIT), lambda w: w.isin(*words))))


def facts(c: Column, kind: T.DataType) -> dict[str, Column]:
    """Aggregates about a column that the rules use."""
    value = L.clean(c, kind)
    out = {"n": F.count(F.lit(1)), "some": F.count(value)}
    every = lambda test: F.every(F.coalesce(test, value.isNull()))
    distinct = F.collect_set(value) if isinstance(kind, L.NUMBERS) else None
    if isinstance(kind, T.StringType):
        distinct = F.collect_set(F.when(value.isNotNull(), F.xxhash64(value)))
        number = F.regexp_replace(F.trim(value), "_", "").try_cast("double")
        out |= {
            "distinct": F.size(distinct),
            "few": F.array_sort(F.collect_set(F.when(F.length(value) <= FEW, F.lower(value)))),
            "int": every(value.rlike(_INT)),
            "float": every(value.rlike(_FLOAT)),
            "fraction": F.some(F.coalesce(value.rlike(_FLOAT) & ~(number == F.floor(number)) | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(False))),
            "date": every(value.rlike(datetimes.SHAPE)),
        }
        for name in ("email", "phone", "postal_code", "url", "ipv4", "ipv6"):
            out[name] = every(L.matches(value, f"{name}_inference_regex"))
    elif isinstance(kind, L.NUMBERS):
        if config.get_option("numeric_categorical_threshold") is not None:
            out["distinct"] = F.size(distinct)
        if isinstance(kind, L.WHOLE) and config.get_option("boolean_inference_ints"):
            out["few_ints"] = every(value.isin([int(x) for x in config.get_option("boolean_inference_ints")]))
        if not isinstance(kind, L.WHOLE):
            x = value.cast("double")
            out["int"] = every((x == F.floor(x)) & (F.abs(x) < 2.0**63))
    return out


class Found:
    """The facts of one column, and the verdicts of the built-in rules."""

    def __init__(self, kind: T.DataType, got: dict, date: bool):
        self.kind, self.got, self.date = kind, got, date
        self.string = isinstance(kind, T.StringType)
        self.nulls = got["n"] > got["some"]

    def _few(self, threshold) -> bool:
        return threshold is not None and "distinct" in self.got and self.got["distinct"] / self.got["some"] <= threshold

    def Categorical(self) -> bool:
        if self.string:
            return not self.date and self._few(config.get_option("categorical_threshold"))
        return isinstance(self.kind, L.NUMBERS) and self._few(config.get_option("numeric_categorical_threshold"))

    def IntegerNullable(self) -> bool:
        if isinstance(self.kind, L.WHOLE):
            return not self._few(config.get_option("numeric_categorical_threshold"))
        if isinstance(self.kind, L.NUMBERS):
            return self.nulls and bool(self.got["int"])
        return self.string and bool(self.got["int"])

    def Integer(self) -> bool:
        return self.IntegerNullable() and not self.nulls

    def Double(self) -> bool:
        if isinstance(self.kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            return True
        return self.string and bool(self.got["float"]) and bool(self.got["fraction"])

    def BooleanNullable(self) -> bool:
        if isinstance(self.kind, T.BooleanType):
            return True
        if self.string:
            return any(sorted(pair) == self.got["few"] for pair in config.get_option("boolean_inference_strings"))
        return bool(self.got.get("few_ints"))

    def Boolean(self) -> bool:
        return self.BooleanNullable() and not self.nulls

    def Datetime(self) -> bool:
        return isinstance(self.kind, L.STAMPS) or self.string and self.date

    def Timedelta(self) -> bool:
        return isinstance(self.kind, T.DayTimeIntervalType)

    def NaturalLanguage(self) -> bool:
        return self.string and (self.got.get("words") or 0) > config.get_option("natural_language_threshold")

    def EmailAddress(self) -> bool:
        return self.string and bool(self.got["email"])

    def PhoneNumber(self) -> bool:
        return self.string and bool(self.got["phone"])

    def PostalCode(self) -> bool:
        return self.string and bool(self.got["postal_code"])

    def URL(self) -> bool:
        return self.string and bool(self.got["url"])

    def IPAddress(self) -> bool:
        return self.string and bool(self.got["ipv4"] or self.got["ipv6"])


def walk(rule, system: TypeSystem) -> type[L.LogicalType]:
    """The type that the verdicts rule(type) (None: no rule) lead to.

    Types are visited from the roots down; the children of a type follow if it matched or has no rule. Without a match it is
    free text or the default. Of several matches at the top a whole number goes before a category or real number, a real
    number before a category, else the first; then each strictly deeper match takes over.
    """
    text = next((t for t in system.types if t.__name__ == "NaturalLanguage"), None)
    level, matched = [t for t in system.root_types if t is not text], []
    while level:
        below = []
        for t in level:
            verdict = rule(t)
            if verdict:
                matched.append(t)
            if verdict is None or verdict:
                below += [x for x in system.children(t) if x not in below]
        level = below
    matched = list(dict.fromkeys(matched))
    if not matched:
        return text if text is not None and rule(text) else system.default_type
    names = {t.__name__: t for t in matched}
    best = matched[0]
    if "IntegerNullable" in names and ("Categorical" in names or "Double" in names):
        best = names["IntegerNullable"]
    elif "Categorical" in names and "Double" in names:
        best = names["Double"]
    for t in matched:
        if system.depth(t) > system.depth(best):
            best = t
    return best


def infer(df: DataFrame, columns: list[str] | None = None, system: TypeSystem | None = None) -> dict[str, L.LogicalType]:
    """The logical type of each column. No values, or none that do not stand for null: the default type."""
    system = system or type_system
    columns = columns if columns is not None else df.columns
    if not columns:
        return {}
    kinds = {c: df.schema[c].dataType for c in columns}
    sample = sampled(df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns))))
    custom = {t: r for t, r in system.rules.items() if callable(r) and not isinstance(r, OfValues)}
    by_values = {t: r for t, r in system.rules.items() if isinstance(r, OfValues)}
    exprs, names = [], []
    for i, c in enumerate(columns):
        own = facts(F.col(f"c{i}"), kinds[c])
        for j, r in enumerate(custom.values()):
            verdict = r(F.col(f"c{i}"), kinds[c])
            own[f"custom{j}"] = F.lit(False) if verdict is None else verdict
        for k, e in own.items():
            exprs.append(e.alias(f"a{len(names)}"))
            names.append((c, k))
    got: dict[str, dict] = {c: {} for c in columns}
    head, open_ = sample.limit(HEAD_ROWS).agg(F.count(F.lit(1)), *exprs).first(), []
    whole = head[0] < HEAD_ROWS  # then there is no more to see
    for (c, k), e, v in zip(names, exprs, head[1:], strict=True):
        if k in _EVERY and v is False or k == "few" and len(v) > FEW:
            got[c][k] = v if k != "few" else None  # what fails on some rows fails on more
        elif whole:
            got[c][k] = v
        else:
            open_.append(((c, k), e))
    row = sample.agg(*(e.alias(f"a{i}") for i, (_, e) in enumerate(open_))).first() if open_ else ()
    for ((c, k), _), v in zip(open_, row, strict=True):
        got[c][k] = v
    for c in columns:
        if got[c].get("few") is not None and len(got[c]["few"]) > FEW:
            got[c]["few"] = None
    verdicts = _verdicts(sample, columns, by_values)
    dated = [c for c in columns if isinstance(kinds[c], T.StringType) and got[c]["some"] and got[c]["date"]]
    dates = _dates(sample, {c: f"c{columns.index(c)}" for c in dated})

    def walked(c: str) -> type[L.LogicalType]:
        found = Found(kinds[c], got[c], dates.get(c, False))
        if not found.got["some"]:
            return system.default_type

        def rule(t):
            r = system.rules.get(t)
            if r is None:
                return None
            if isinstance(r, OfValues):
                return verdicts.get((c, t), False)
            return bool(found.got[f"custom{list(custom).index(t)}"]) if callable(r) else getattr(found, r)()

        return walk(rule, system)

    out = {c: walked(c) for c in columns}
    texts = [c for c in columns if isinstance(kinds[c], T.StringType) and out[c] is system.default_type and got[c]["some"]]
    if texts:
        row = sample.agg(*(frequent_words(F.col(f"c{columns.index(c)}")).alias(f"w{i}") for i, c in enumerate(texts))).first()
        for i, c in enumerate(texts):
            got[c]["words"] = row[i]
            out[c] = walked(c)
    return {c: out[c]() for c in columns}


def _verdicts(sample: DataFrame, columns: list[str], rules: dict[type[L.LogicalType], OfValues]) -> dict[tuple[str, type[L.LogicalType]], bool]:
    """What rules of values say of each column. A task has a column of the sample, whose rows have a bound."""
    if not rules:
        return {}
    kinds, tests = list(rules), [r.test for r in rules.values()]

    def judged(i: int):
        def run(x: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"i": [i] * len(tests), "j": list(range(len(tests))), "fits": [bool(test(x["v"])) for test in tests]})

        return run

    out = []
    for i in range(len(columns)):
        # Grouped by a constant: all of a column's rows of the sample meet in one task.
        own = sample.select(F.lit(i).alias("i"), F.col(f"c{i}").alias("v")).groupBy("i")
        out.append(own.applyInPandas(judged(i), "i int, j int, fits boolean"))
    return {(columns[r.i], kinds[r.j]): r.fits for r in reduce(DataFrame.unionByName, out).collect()}


#: Facts that hold for every value or not at all.
_EVERY = {"int", "float", "date", "email", "phone", "postal_code", "url", "ipv4", "ipv6", "few_ints"}


def _dates(sample: DataFrame, columns: dict[str, str], rows: int = 100) -> dict[str, bool]:
    """Whether some one format parses all of a column's values. A few values settle on the driver which formats are worth trying."""
    tried, exprs = {}, []
    for c, place in columns.items():
        value = L.clean(F.col(place), T.StringType())
        few = [r[0] for r in sample.select(value.alias("v")).dropna().limit(rows).collect()]
        tried[c] = datetimes.candidates(few)
        exprs += [F.every(F.try_to_timestamp(F.trim(value), F.lit(datetimes.spark_pattern(f))).isNotNull() | value.isNull()) for f in tried[c]]
    row = iter(sample.agg(*(e.alias(f"d{i}") for i, e in enumerate(exprs))).first() if exprs else ())
    return {c: any([next(row) for _ in fs]) for c, fs in tried.items()}
