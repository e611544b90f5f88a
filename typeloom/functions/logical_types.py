"""Logical types: what values mean, as Spark expressions.

A type names the Spark type that holds its values, the standard tags of its columns, how other columns are coerced to it
and which of its values are invalid.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import config
from ..errors import TypeConversionError
from . import datetimes

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
STAMPS = (T.TimestampType, T.TimestampNTZType, T.DateType)
LATLONG = T.StructType([T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())])


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def clean(c: Column, kind: T.DataType) -> Column:
    """Null for NaN and for strings that stand for null."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    if isinstance(kind, T.StringType):
        return F.when(~c.isin(config.get_option("null_strings")), c)
    return c


def matches(c: Column, option: str) -> Column:
    """Whether a string matches an option's pattern from its start on."""
    return c.rlike(f"^(?:{config.get_option(option)})")


class LogicalType:
    """Base of all logical types; compared by class and parameters."""

    physical: T.DataType = T.StringType()
    standard_tags: frozenset[str] = frozenset()
    nullable = True
    keeps_physical = False
    pattern: str | None = None

    @classmethod
    def type_string(cls) -> str:
        return snake(cls.__name__)

    @property
    def parameters(self) -> dict:
        return {}

    def __eq__(self, other) -> bool:
        return type(self) is type(other) and self.parameters == other.parameters

    def __hash__(self) -> int:
        return hash((type(self), str(self.parameters)))

    def __repr__(self) -> str:
        inner = ", ".join(f"{k}={v!r}" for k, v in self.parameters.items() if v is not None)
        return f"{type(self).__name__}({inner})" if inner else type(self).__name__

    def fits(self, kind: T.DataType) -> bool:
        """Whether a column of this Spark type can be of this logical type as it is."""
        if self.keeps_physical:
            return isinstance(kind, (T.StringType, T.BooleanType, *NUMBERS))
        return type(kind) is type(self.physical)

    def coerce(self, c: Column, kind: T.DataType, lenient: bool = False) -> Column:
        """The column's values as this type. Strict coercion raises at run time for values that do not convert; lenient
        coercion makes these, and invalid ones, null."""
        if self.keeps_physical and self.fits(kind):
            return clean(c, kind) if not isinstance(kind, T.StringType) else c
        out = c.try_cast(self.physical) if lenient and not isinstance(kind, T.StructType) else c.cast(self.physical)
        if lenient and (bad := self.invalid(out)) is not None:
            out = F.when(~bad, out)
        return out

    def invalid(self, c: Column) -> Column | None:
        """Which values are invalid; null values never are. None: no check."""
        if self.pattern:
            return c.isNotNull() & ~matches(c.cast("string"), self.pattern)
        return None


class Address(LogicalType):
    """Postal addresses."""


class Filepath(LogicalType):
    """Places in a file system."""


class PersonFullName(LogicalType):
    """Full names of people."""


class NaturalLanguage(LogicalType):
    """Free text."""


class Unknown(LogicalType):
    """Values of no known kind."""

    def fits(self, kind: T.DataType) -> bool:
        return True

    def coerce(self, c: Column, kind: T.DataType, lenient: bool = False) -> Column:
        return c if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) else c.cast("string")


class IPAddress(LogicalType):
    """IPv4 and IPv6 addresses."""


class EmailAddress(LogicalType):
    """Addresses of electronic mail."""

    pattern = "email_inference_regex"


class PhoneNumber(LogicalType):
    """North American telephone numbers."""

    pattern = "phone_inference_regex"


class URL(LogicalType):
    """Web addresses."""

    pattern = "url_inference_regex"


class Categorical(LogicalType):
    """Values from a small set."""

    standard_tags = frozenset({"category"})
    keeps_physical = True

    def __init__(self, encoding=None):
        self.encoding = encoding

    @property
    def parameters(self) -> dict:
        return {"encoding": self.encoding}


class CountryCode(Categorical):
    """ISO 3166 codes of countries."""


class CurrencyCode(Categorical):
    """ISO 4217 codes of currencies."""


class SubRegionCode(Categorical):
    """ISO 3166 codes of parts of countries."""


class PostalCode(LogicalType):
    """United States postal codes."""

    standard_tags = frozenset({"category"})
    pattern = "postal_code_inference_regex"

    def coerce(self, c: Column, kind: T.DataType, lenient: bool = False) -> Column:
        if isinstance(kind, NUMBERS):
            c = clean(c, kind).cast("bigint")
        return super().coerce(c.cast("string"), T.StringType(), lenient)


class Ordinal(Categorical):
    """Categories in an order, from least to greatest."""

    def __init__(self, order=None):
        if order is not None and not isinstance(order, (list, tuple)):
            raise TypeError("order must be a list or tuple")
        if order is not None and len(set(order)) != len(order):
            raise ValueError("order has repeated values")
        super().__init__()
        self.order = order

    @property
    def parameters(self) -> dict:
        return {"order": list(self.order) if self.order is not None else None}

    def _order(self) -> Column:
        if self.order is None:
            raise TypeError("an Ordinal needs its order of values")
        return F.array(*map(F.lit, self.order))

    def coerce(self, c: Column, kind: T.DataType, lenient: bool = False) -> Column:
        return F.when(~self.invalid(c), c) if lenient else super().coerce(c, kind)

    def invalid(self, c: Column) -> Column:
        return c.isNotNull() & ~F.array_contains(self._order(), c)

    def rank(self, c: Column) -> Column:
        """A value's place in the order, from 0."""
        return F.when(c.isNotNull(), F.array_position(self._order(), c) - 1)


class _Number(LogicalType):
    standard_tags = frozenset({"numeric"})

    def number(self, c: Column, kind: T.DataType, lenient: bool) -> Column:
        """As a double; strings that stand for null, and NaN, are null."""
        c = clean(c, kind)
        x = c.try_cast("double") if lenient else c.cast("double")
        return F.when(~F.isnan(x), x)


class Double(_Number):
    """Real numbers."""

    physical = T.DoubleType()

    def coerce(self, c: Column, kind: T.DataType, lenient: bool = False) -> Column:
        return self._only_valid(self.number(c, kind, lenient), lenient)

    def _only_valid(self, x: Column, lenient: bool) -> Column:
        return F.when(~self.invalid(x), x) if lenient and self.invalid(x) is not None else x


class AgeFractional(Double):
    """Ages, in parts of years."""

    def invalid(self, c: Column) -> Column:
        return F.coalesce(c < 0, F.lit(False))


class IntegerNullable(_Number):
    """Whole numbers, some of which may be missing."""

    physical = T.LongType()

    def coerce(self, c: Column, kind: T.DataType, lenient: bool = False) -> Column:
        if isinstance(kind, (*WHOLE, T.BooleanType)):
            whole = c.cast("bigint")
        elif isinstance(kind, T.StringType):
            text = clean(c, kind)
            exact, real = F.trim(text).try_cast("bigint"), self.number(c, kind, lenient)
            whole = F.when(exact.isNotNull() & ~text.rlike(r"[.eE]"), exact).otherwise(self._whole(real, lenient))
        else:
            whole = self._whole(self.number(c, kind, lenient), lenient)
        if lenient and (bad := self.invalid(whole)) is not None:
            whole = F.when(~bad, whole)
        return whole

    def _whole(self, x: Column, lenient: bool) -> Column:
        fraction = F.raise_error(F.concat(F.lit("not a whole number: "), x.cast("string"))).cast("bigint")
        return F.when(x.isNull(), F.lit(None)).when(x == F.floor(x), x.cast("bigint")).otherwise(F.lit(None) if lenient else fraction).cast("bigint")


class Integer(IntegerNullable):
    """Whole numbers."""

    nullable = False

    def coerce(self, c: Column, kind: T.DataType, lenient: bool = False) -> Column:
        x = super().coerce(c, kind, lenient)
        return x if lenient else F.coalesce(x, F.raise_error(F.lit(f"null values cannot be {type(self).__name__}")).cast("bigint"))


class Age(Integer):
    """Ages in whole years."""

    def invalid(self, c: Column) -> Column:
        return F.coalesce(c < 0, F.lit(False))


class AgeNullable(IntegerNullable):
    """Ages in whole years, some of which may be missing."""

    def invalid(self, c: Column) -> Column:
        return F.coalesce(c < 0, F.lit(False))


class BooleanNullable(LogicalType):
    """True or false, or missing."""

    physical = T.BooleanType()

    def coerce(self, c: Column, kind: T.DataType, lenient: bool = False) -> Column:
        if isinstance(kind, T.BooleanType):
            return c
        if isinstance(kind, T.StringType):
            known = {**config.get_option("boolean_transform_mappings"), "1": True, "0": False, "1.0": True, "0.0": False}
            text = clean(c, kind)
            low = F.lower(F.trim(text))
            other = F.lit(None) if lenient else F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean")
            return F.when(text.isNull(), F.lit(None)).when(low.isin([k for k, v in known.items() if v]), True).when(low.isin([k for k, v in known.items() if not v]), False).otherwise(other)
        if isinstance(kind, NUMBERS):
            x = clean(c, kind)
            other = F.lit(None) if lenient else F.raise_error(F.concat(F.lit("not a boolean: "), x.cast("string"))).cast("boolean")
            return F.when(x.isNull(), F.lit(None)).when(x == 1, True).when(x == 0, False).otherwise(other)
        raise TypeConversionError(f"cannot convert {kind.simpleString()} to {type(self).__name__}")


class Boolean(BooleanNullable):
    """True or false. cast_nulls_as: what missing values become."""

    nullable = False

    def __init__(self, cast_nulls_as: bool | None = None):
        self.cast_nulls_as = cast_nulls_as

    @property
    def parameters(self) -> dict:
        return {"cast_nulls_as": self.cast_nulls_as}

    def coerce(self, c: Column, kind: T.DataType, lenient: bool = False) -> Column:
        x = super().coerce(c, kind, lenient)
        if self.cast_nulls_as is not None:
            return F.coalesce(x, F.lit(bool(self.cast_nulls_as)))
        return x if lenient else F.coalesce(x, F.raise_error(F.lit("null values cannot be Boolean")).cast("boolean"))


class Datetime(LogicalType):
    """Points of wall-clock time. Strings are read with datetime_format; what does not parse becomes null."""

    physical = T.TimestampNTZType()

    def __init__(self, datetime_format: str | None = None, timezone: str | None = None):
        self.datetime_format, self.timezone = datetime_format, timezone

    @property
    def parameters(self) -> dict:
        return {"datetime_format": self.datetime_format, "timezone": self.timezone}

    def coerce(self, c: Column, kind: T.DataType, lenient: bool = False) -> Column:
        if isinstance(kind, STAMPS):
            return c.cast("timestamp_ntz")
        if isinstance(kind, T.StringType):
            formats = [self.datetime_format] if self.datetime_format else ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S"]
            return F.coalesce(*(datetimes.parsed(clean(c, kind), f) for f in formats))
        raise TypeConversionError(f"cannot convert {kind.simpleString()} to Datetime")


class Timedelta(LogicalType):
    """Lengths of time."""

    physical = T.DayTimeIntervalType(0, 3)


class LatLong(LogicalType):
    """Latitude and longitude, from pairs or from strings such as (1, 2), [1, 2] and 1, 2."""

    physical = LATLONG

    def coerce(self, c: Column, kind: T.DataType, lenient: bool = False) -> Column:
        if isinstance(kind, T.StructType):
            first, second = (c[f.name] for f in kind.fields[:2])
            return F.when(c.isNotNull(), self._pair(first, second))
        if isinstance(kind, T.ArrayType):
            bad = None if lenient else F.raise_error(F.lit("a LatLong needs two values")).cast(LATLONG)
            return F.when(c.isNull(), F.lit(None)).when(F.size(c) == 2, self._pair(F.get(c, F.lit(0)), F.get(c, F.lit(1)))).otherwise(F.lit(None) if bad is None else bad)
        text = clean(c, kind)
        number = r"\s*['\"]?([^,()\[\]'\"]*?)['\"]?\s*"
        shape = rf"^\s*[\[(]?{number},{number}[\])]?\s*$"
        bad = F.lit(None) if lenient else F.raise_error(F.concat(F.lit("not a LatLong: "), text)).cast(LATLONG)
        return F.when(text.isNull(), F.lit(None)).when(text.rlike(shape), self._pair(F.regexp_extract(text, shape, 1), F.regexp_extract(text, shape, 2))).otherwise(bad)

    def invalid(self, c: Column) -> Column:
        """A coordinate is a number or null; NaN is neither."""
        return c.isNotNull() & (F.coalesce(F.isnan(c["latitude"]), F.lit(False)) | F.coalesce(F.isnan(c["longitude"]), F.lit(False)))

    def _pair(self, a: Column, b: Column) -> Column:
        def part(x):
            y = x.try_cast("double")
            return F.when(~F.isnan(y), y)

        return F.struct(part(a).alias("latitude"), part(b).alias("longitude"))

    @staticmethod
    def missing(c: Column) -> Column:
        return c.isNull() | (c["latitude"].isNull() & c["longitude"].isNull())


def all_types() -> list[type[LogicalType]]:
    """The 26 types of this module, by name."""
    found, queue = set(), [LogicalType]
    while queue:
        for c in queue.pop().__subclasses__():
            if c not in found:
                found.add(c)
                queue.append(c)
    return sorted((c for c in found if not c.__name__.startswith("_") and c.__module__ == __name__), key=lambda c: c.__name__)
