"""The medcouple of a whole column, however many rows it has.

The kernel of a value a above the median and one b below it is (1 - r) / (1 + r) for the ratio r of their distances from it, so the
median of all kernels is that of all ratios. There are as many as pairs of rows, and none is made: how many ratios are at most r
is a count of the distances below that are at most r a, for each a. Distinct distances with their counts are sorted, dealt by
ranges and written once, in chunks. The chunks' ends alone bracket the wanted ratio; then each pass counts at many points of the
bracket, from those pairs of chunks that the bracket leaves open: a staircase, so about as many as there are chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .places import AT, PART, ordered
from .quantiles import quantiles

#: Distinct distances of a chunk, at most; points of the bracket that a pass counts at; relative width at which a bracket is a value.
CHUNK, POINTS, EXACT = 16_384, 64, 1e-11

#: Ratios beyond these give kernels of 1 and -1 to the last digit.
LEAST, MOST = 1e-300, 1e300


@dataclass
class Side:
    """The chunks of the distances on one side of the median, ascending: ids, least and greatest distance, rows before each."""

    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Side:
        rows = sorted(rows, key=lambda r: r.low)
        total = np.array([int(r.n) for r in rows], dtype=object)  # products of counts may pass 64 bits
        return cls(np.array([r.id for r in rows], dtype=np.int64), np.array([r.low for r in rows]), np.array([r.high for r in rows]), total, np.concatenate([[0], np.cumsum(total)]).astype(object))


def tallied(points: np.ndarray, a: np.ndarray, times: np.ndarray, below: np.ndarray, each: np.ndarray) -> list[int]:
    """For each point the pairs of a distance a and one below that is at most the point's multiple of a. Distances ascend."""
    upto = np.concatenate([[0], np.cumsum(each)])
    found = upto[np.searchsorted(below, np.multiply.outer(points, a), side="right")]
    if int(times.sum()) * int(upto[-1]) >= 1 << 62:
        found, times = found.astype(object), times.astype(object)
    return [int(n) for n in found @ times]


class Ratios:
    """Counts of ratios between distances below and above the median, with `ties` ratios of 1 more."""

    def __init__(self, chunks: DataFrame, ties: int):
        heads = chunks.select("up", "id", F.element_at("sizes", 1).alias("low"), F.element_at("sizes", -1).alias("high"), F.expr("aggregate(times, 0L, (x, y) -> x + y)").alias("n")).collect()
        self.chunks, self.ties = chunks, ties
        self.up, self.down = (Side.of([r for r in heads if r.up == up]) for up in (True, False))

    def bounds(self, r: float) -> tuple[int, int]:
        """Ratios up to r, at least and at most, as the ends of chunks tell."""
        up, down, tied = self.up, self.down, self.ties if r >= 1 else 0
        sure = down.before[np.searchsorted(down.high, r * up.low, side="right")]
        open_ = down.before[np.searchsorted(down.low, r * up.high, side="right")]
        return int((up.total * sure).sum()) + tied, int((up.total * open_).sum()) + tied

    def counts(self, points: np.ndarray) -> list[int]:
        """Ratios up to each of the ascending points."""
        up, down, spark = self.up, self.down, self.chunks.sparkSession
        first = np.searchsorted(down.high, points[0] * up.low, side="right")
        end = np.maximum(first, np.searchsorted(down.low, points[-1] * up.high, side="right"))
        out = [int((up.total * down.before[first]).sum()) + (self.ties if r >= 1 else 0) for r in points]
        many = end - first
        if not many.any():
            return out
        to = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - first, many)
        pairs = spark.createDataFrame(pd.DataFrame({"a": np.repeat(up.ids, many), "b": down.ids[to]}))
        above = self.chunks.where("up").select(F.col("id").alias("a"), F.col("sizes").alias("x"), F.col("times").alias("m"))
        below = self.chunks.where("not up").select(F.col("id").alias("b"), F.col("sizes").alias("y"), F.col("times").alias("n"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [0] * len(points)
            for batch in batches:
                for i in range(batch.num_rows):
                    sides = (batch.column(j)[i].values.to_numpy(zero_copy_only=False) for j in range(4))
                    sums = [s + n for s, n in zip(sums, tallied(points, *sides), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(points)), pa.int32()), pa.array([str(s) for s in sums])], names=["at", "n"])

        found = pairs.join(above, "a").join(below, "b").select("x", "m", "y", "n").mapInArrow(run, "at int, n string")
        for row in found.groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
            out[row["at"]] += int(row.n)
        return out

    def at(self, ranks: list[int]) -> list[float]:
        """The ratios at some ranks, from 1."""
        low, high = LEAST, MOST
        for ends, fits in (("low", lambda r: self.bounds(r)[1] < min(ranks)), ("high", lambda r: self.bounds(r)[0] < max(ranks))):
            a, b = LEAST, MOST
            while b / a > 1 + 1e-6:
                mid = float(np.sqrt(a) * np.sqrt(b))
                a, b = (mid, b) if fits(mid) else (a, mid)
            low, high = (a, high) if ends == "low" else (low, b)
        known = [(low, -1), (high, 1 << 200)]  # counts below and above all ranks
        out = []
        for rank in ranks:
            while True:
                a, b = max(r for r, n in known if n < rank), min(r for r, n in known if n >= rank)
                if b / a <= 1 + EXACT:
                    break
                inner = np.geomspace(a, b, POINTS + 2)[1:-1]
                points = np.unique(np.concatenate([inner, [1.0, np.nextafter(1, 0)]] if a < 1 < b else [inner]))
                points = points[(points > a) & (points < b)]
                known += zip(points.tolist(), self.counts(points), strict=True)
            out.append(b)
        return out


def whole_medcouple(values: DataFrame, chunk: int = CHUNK) -> float | None:
    """The medcouple of the column `value`, of all its rows, to some ten digits.

    Nulls, NaN and infinite values are left out; None without values, 0 for fewer than three. The kernels of the k values equal to
    the median count as k zeros and as many of 1 as of -1. The driver holds the ends of the chunks alone, a row for `chunk`
    distinct values.
    """
    values = values.where("value is not null and not isnan(value) and abs(value) < double('infinity')").select(F.col("value").cast("double").alias("value"))
    middle = quantiles(values, ["value"], [0.5])["value"]
    if middle is None:
        return None
    z = F.col("value") - F.lit(middle[0])
    counted = written(values.select(z.alias("z")).groupBy("z").agg(F.count(F.lit(1)).alias("n")), "distances")
    sums = counted.agg(*(F.coalesce(F.sum(F.when(side, F.col("n"))), F.lit(0)) for side in (F.col("z") > 0, F.col("z") < 0, F.col("z") == 0))).first()
    p, q, ties = (int(n) for n in sums)
    total, even = (p + ties) * (q + ties), ties * (ties - 1) // 2
    if p + q + ties < 3:
        return 0.0
    least, most = p * ties + even, total - q * ties - even  # ratios of 0 come before, infinite ones after
    places = [(total - 1) // 2, total // 2]
    inside = sorted({j - least + 1 for j in places if least <= j < most})
    ratios = dict.fromkeys(inside, 1.0)
    if p and q and inside:
        order = ordered(counted.where("z <> 0").select((F.col("z") > 0).alias("up"), F.abs("z").alias("size"), "n"), ["up", "size"])
        piece = F.floor(F.col(AT) / chunk)
        held = order.rows.groupBy("up", PART, piece.alias("piece")).agg(F.array_sort(F.collect_list(F.struct("size", "n"))).alias("all"))
        chunks = held.select("up", (F.col(PART) * F.lit(1 << 40) + F.col("piece")).alias("id"), F.col("all.size").alias("sizes"), F.col("all.n").alias("times"))
        ratios = dict(zip(inside, Ratios(written(chunks, "chunks"), ties).at(inside), strict=True))

    def kernel(place: int) -> float:
        r = ratios.get(place - least + 1)
        return (1.0 if place < least else -1.0) if r is None else (1 - r) / (1 + r)

    return sum(kernel(j) for j in places) / 2 + 0.0
