"""Places of rows in an order, without ordering all rows in one task.

Rows are dealt by ranges of the order, sorted within them and written once, each with its range and its number there. A manifest of
how many rows each range holds turns these into places. All that follows reads the written table, so ranges are sampled and dealt
once only, and an executor that is lost changes no place.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written

PART, AT, SALT = "_part", "_at", "_salt"

#: A row's number within its task is in the low bits of Spark's increasing ids, the task's in those above.
_BITS = 33


@dataclass
class Ordered:
    """Rows in an order: df's columns, _part and _at, as they were written; and (part, rows in it) in ascending order."""

    rows: DataFrame
    manifest: list[tuple[int, int]]

    @property
    def total(self) -> int:
        return sum(n for _, n in self.manifest)

    def bases(self) -> dict[int, int]:
        """How many rows lie in the ranges before each."""
        return dict(zip((p for p, _ in self.manifest), accumulate((n for _, n in self.manifest), initial=0), strict=False))

    def _placed(self, rows: DataFrame, name: str) -> DataFrame:
        # The manifest has a row a range, which are at most as many as shuffle partitions: few enough to be sent to all tasks.
        before = rows.sparkSession.createDataFrame(list(self.bases().items()), f"{PART} int, _before long")
        kept = [c for c in rows.columns if c not in (PART, AT)]
        return rows.join(F.broadcast(before), PART).select(*(F.col(f"`{c}`") for c in kept), (F.col("_before") + F.col(AT)).alias(name))

    def numbered(self, name: str) -> DataFrame:
        """All rows with their places, from 0."""
        return self._placed(self.rows, name)

    def between(self, low: int, high: int, name: str) -> DataFrame:
        """Rows at the places from low to high with their places; only the ranges that hold them are read."""
        bases = self.bases()
        parts = [p for p, n in self.manifest if bases[p] <= high and bases[p] + n > low]
        return self._placed(self.rows.where(F.col(PART).isin(parts)), name).where(F.col(name).between(low, high))

    def at(self, places: Iterable[int], name: str) -> DataFrame:
        """Rows at some places with their places."""
        bases, wanted, i = self.bases(), sorted(set(places)), 0
        fits: Column = F.lit(False)
        for p, n in self.manifest:
            own = []
            while i < len(wanted) and wanted[i] < bases[p] + n:
                own.append(wanted[i] - bases[p])
                i += 1
            if own:
                fits = fits | (F.col(PART) == p) & F.col(AT).isin(own)
        return self._placed(self.rows.where(fits), name)


def ordered(df: DataFrame, order: list[str], parts: int | None = None) -> Ordered:
    """df in ascending order of the columns, nulls last; equal rows in any order, so that a frequent value does not stay in one range.
    df must have none of the columns _part, _at, _salt and _before."""
    if clash := {PART, AT, SALT, "_before"} & set(df.columns):
        raise ValueError(f"columns named {sorted(clash)} have no place beside those of places")
    keys = [*(F.col(f"`{c}`").asc_nulls_last() for c in order), F.col(SALT)]
    salted = df.withColumn(SALT, F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(parts, *keys) if parts else salted.repartitionByRange(*keys)
    own = F.monotonically_increasing_id()
    sorted_ = ranged.sortWithinPartitions(*keys).select(*(F.col(f"`{c}`") for c in df.columns), own.alias("_id"))
    rows = written(sorted_.select(*(F.col(f"`{c}`") for c in df.columns), F.shiftright("_id", _BITS).cast("int").alias(PART), F.col("_id").bitwiseAND((1 << _BITS) - 1).alias(AT)), "ordered")
    counts = rows.groupBy(PART).agg(F.count(F.lit(1)).alias("n")).collect()
    return Ordered(rows, sorted((r[PART], r.n) for r in counts))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with each row's place, from 0, in ascending order of the columns, nulls last."""
    return ordered(df, order).numbered(name)
