"""Datetime formats: strptime directives in terms of Spark patterns, and the ladder of formats that are tried on strings."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DIRECTIVES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%z": "[XXX][XX]", "%Z": "zzz", "%%": "%"}
_NARROW = {"MM": "M", "dd": "d", "HH": "H", "hh": "h"}

#: Strings of such shapes alone are tried as datetimes: digits around - / . with an optional time, or the name of a month.
SHAPE = r"(?i)^\s*(\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|\d{8}|\d{1,2}[- ][a-z]{3,9}[-, ]+\d{2,4}|[a-z]{3,9} \d{1,2},? \d{4})([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?( ?[ap]m)?)?( ?(Z|[+-]\d{2}:?\d{2}))?\s*$"

_ORDERS = ["%Y{0}%m{0}%d", "%m{0}%d{0}%Y", "%d{0}%m{0}%Y", "%y{0}%m{0}%d", "%m{0}%d{0}%y", "%d{0}%m{0}%y", "%Y{0}%d{0}%m", "%y{0}%d{0}%m"]
_TIMES = ["", " %H:%M:%S", "T%H:%M:%S", " %H:%M", " %H:%M:%S.%f", "T%H:%M:%S.%f", " %I:%M:%S %p", " %I:%M %p"]


def ladder() -> list[str]:
    """Formats in the order in which they win: dates by order and separator, then with times, then with names of months."""
    dates = [o.format(s) for s in "-/." for o in _ORDERS]
    out = [d + t for t in _TIMES for d in dates]
    out += [d + t + "%z" for t in (" %H:%M:%S", "T%H:%M:%S", " %H:%M:%S.%f", "T%H:%M:%S.%f") for d in dates[:2]]
    return [*out, "%Y%m%d", "%d-%b-%Y", "%d %b %Y", "%d %B %Y", "%b %d, %Y", "%B %d, %Y", "%b %d %Y", "%B %d %Y"]


def spark_pattern(format_: str) -> str:
    """A Spark datetime pattern for a strptime format. Numbers may lack their leading zeros, as in strptime, where a
    separator follows."""
    out, literal = [], ""

    def close():
        nonlocal literal
        if literal:
            out.append("'" + literal.replace("'", "''") + "'" if re.search("[A-Za-z']", literal) else literal)
            literal = ""

    parts = re.findall(r"%.|[^%]+", format_)
    packed = "%Y%m" in format_ or "%m%d" in format_
    for p in parts:
        if p in _DIRECTIVES and p != "%%":
            close()
            letters = _DIRECTIVES[p]
            out.append(letters if packed else _NARROW.get(letters, letters))
        elif p.startswith("%") and p != "%%":
            raise ValueError(f"the directive {p} is not supported")
        else:
            literal += "%" if p == "%%" else p
    close()
    return "".join(out)


def parsed(c: Column, format_: str, today_year: int | None = None) -> Column:
    """The wall-clock timestamp of a string in a format, null where it does not parse. Offsets turn into UTC. With two-digit
    years, more than ten years ahead means the century before."""
    pattern = F.lit(spark_pattern(format_))
    text = F.trim(c)
    if "%z" in format_:
        stamp = _as_utc(F.try_to_timestamp(text, pattern))
    else:
        stamp = F.try_to_timestamp(text, pattern).cast("timestamp_ntz")
    if "%y" in format_:
        limit = F.lit(today_year) if today_year is not None else F.year(F.current_date())
        stamp = F.when(F.year(stamp) > limit + 10, F.add_months(stamp, -1200).cast("timestamp_ntz") + (stamp - F.date_trunc("day", stamp).cast("timestamp_ntz"))).otherwise(stamp)
    return stamp


def _as_utc(stamp: Column) -> Column:
    """A timestamp's wall clock in UTC, whatever the session's zone."""
    return F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(stamp, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))


def parses(text: str, format_: str) -> bool:
    try:
        datetime.strptime(text.strip(), format_)
    except ValueError:
        return False
    return True


def candidates(values: list[str]) -> list[str]:
    """The ladder's formats, in order, that parse all of a few strings."""
    return [f for f in ladder() if all(parses(v, f) for v in values)] if values else []


def infer_format(df: DataFrame, name: str, rows: int = 100) -> str | None:
    """The first format of the ladder that parses all of up to `rows` non-null strings, else the one that parses most; None if
    none parses any."""
    values = [r[0] for r in df.select(F.col(f"`{name}`").cast("string")).dropna().limit(rows).collect()]
    if found := candidates(values):
        return found[0]
    hits = [(-sum(parses(v, f) for v in values), i, f) for i, f in enumerate(ladder())]
    best, _, format_ = min(hits)
    return format_ if best < 0 else None
