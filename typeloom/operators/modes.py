"""Distinct values and most frequent values of many columns, from counts of hashes.

All columns are read in one scan. What is shuffled are 128-bit hashes with their counts, summed in the tasks first, so that its
size does not grow with the length of the values. The greatest counts leave a few hashes a column, and one more scan looks for the
least value among those that have them, without a shuffle.
"""

from __future__ import annotations

import json
from collections import defaultdict
from datetime import date, datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import logical_types as L
from ..scratch import written

#: Hashes of a column that the second scan compares one by one; where more have the greatest count, a join finds their rows.
FEW = 50

#: Characters of texts that such a join carries.
HEAD = 16

_NESTED = (T.StructType, T.ArrayType)


def _hashes(c: str, kind: T.DataType) -> tuple[Column, Column]:
    value = F.col(f"`{c}`")
    if isinstance(kind, _NESTED):
        value = F.to_json(value, {"ignoreNullFields": "false"})  # a hash leaves out nulls within
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        value = F.when(value == 0, F.lit(0.0).cast(kind)).otherwise(value)  # 0 and -0 are one value
    return F.xxhash64(value), F.xxhash64(F.lit(7), value)


def _text(value: Column, kind: T.DataType) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"}) if isinstance(kind, _NESTED) else value.cast("string")


def distinct_and_mode(df: DataFrame, columns: list[str], with_mode: list[str]) -> dict[str, tuple[int, object]]:
    """Each column's number of distinct non-null values and, where asked, its most frequent value (the least of several)."""
    if not columns:
        return {}
    kinds = {c: df.schema[c].dataType for c in columns}
    keys = {c: _hashes(c, kinds[c]) for c in columns}
    each = F.array(*(F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.lit(i).alias("i"), keys[c][0].alias("h1"), keys[c][1].alias("h2"))) for i, c in enumerate(columns)))
    by = df.select(F.explode(each).alias("x")).where("x is not null").groupBy("x.i", "x.h1", "x.h2").agg(F.count(F.lit(1)).alias("n"))
    by = written(by, "hashes")
    sizes = {columns[r.i]: r for r in by.groupBy("i").agg(F.count(F.lit(1)).alias("distinct"), F.max("n").alias("top"), F.min("n").alias("low")).collect()}
    open_ = [c for c in with_mode if c in sizes and sizes[c].low < sizes[c].top]  # elsewhere all values are equally frequent
    hashes: dict[str, list] = defaultdict(list)
    many: list[str] = []
    if open_:
        fits = reduce(lambda a, b: a | b, ((F.col("i") == columns.index(c)) & (F.col("n") == sizes[c].top) for c in open_))
        best = by.where(fits)
        held = {columns[r.i]: r.k for r in best.groupBy("i").agg(F.count(F.lit(1)).alias("k")).collect()}
        many = [c for c in open_ if held[c] > FEW]
        few = [columns.index(c) for c in open_ if c not in many]
        for r in best.where(F.col("i").isin(few)).collect() if few else []:  # at most FEW a column
            hashes[columns[r.i]].append((r.h1, r.h2))
    exprs = []
    for i, c in enumerate(columns):
        if c not in with_mode or c not in sizes or c in many:
            continue
        value = F.col(f"`{c}`")
        if c in hashes:
            h1, h2 = keys[c]
            value = F.when(reduce(lambda a, b: a | b, ((h1 == x) & (h2 == y) for x, y in hashes[c])), value)
        exprs.append(_text(F.min(value), kinds[c]).alias(f"m{i}"))
    found = df.agg(*exprs).first().asDict() if exprs else {}
    for c in many:
        i = columns.index(c)
        found[f"m{i}"] = _least_of_many(df, c, kinds[c], keys[c], best.where(F.col("i") == i).select("h1", "h2"))
    return {c: (sizes[c].distinct if c in sizes else 0, _value(found.get(f"m{i}"), kinds[c])) for i, c in enumerate(columns)}


def _least_of_many(df: DataFrame, c: str, kind: T.DataType, key: tuple[Column, Column], best: DataFrame) -> str | None:
    """The least of very many values that are equally frequent, as text. Of texts, heads are compared first, and only those with the
    least head go on whole."""
    value = F.col(f"`{c}`")
    rows = df.where(value.isNotNull()).select(key[0].alias("h1"), key[1].alias("h2"), value.alias("v"))
    if isinstance(kind, T.StringType):
        heads = rows.select("h1", "h2", F.substring("v", 1, HEAD).alias("v")).join(best, ["h1", "h2"], "left_semi")
        rows = rows.where(F.substring("v", 1, HEAD) == heads.agg(F.min("v")).first()[0])
    return rows.join(best, ["h1", "h2"], "left_semi").agg(_text(F.min("v"), kind)).first()[0]


def _value(text: str | None, kind: T.DataType):
    """What Spark's text of a value stands for."""
    if text is None or isinstance(kind, T.StringType):
        return text
    if isinstance(kind, L.WHOLE):
        return int(text)
    if isinstance(kind, T.StructType):
        return tuple(json.loads(text).values())
    if isinstance(kind, T.ArrayType):
        return json.loads(text)
    if isinstance(kind, T.BooleanType):
        return text == "true"
    if isinstance(kind, T.DecimalType):
        return Decimal(text)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float(text)
    return datetime.fromisoformat(text) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else date.fromisoformat(text) if isinstance(kind, T.DateType) else text
