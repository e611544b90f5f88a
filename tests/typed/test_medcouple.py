"""The medcouple of a whole column against all kernels, made one by one."""

from __future__ import annotations

import numpy as np
import pytest

from typeloom.config import config
from typeloom.operators.medcouples import Ratios, tallied, whole_medcouple
from typeloom.operators.outliers import medcouple, sampled_medcouple
from typeloom.operators.table import TypedTable

RNG = np.random.default_rng(7)
CASES = {
    "one-sided": RNG.exponential(size=401),
    "an even number": RNG.exponential(size=500) ** 2,
    "ties": RNG.integers(0, 6, 400).astype(float),
    "ties at one end": np.array([1.0, 5, 5, 5, 2]),
    "symmetric": np.array([-3.0, -1, 0, 1, 3]),
    "one value": np.ones(9),
    "two values": np.array([1.0, 4.0]),
    "one frequent value": np.concatenate([np.full(900, 2.5), RNG.normal(2, 5, 300)]),
    "far apart": np.array([1e-150, 2e-150, 1.0, 3.0, 1e150, 5e150, 7e150]),
}


def plain(x: np.ndarray) -> float:
    """All kernels, with as many of 1 as of -1 and k of 0 between the k values equal to the median."""
    m = np.median(x)
    up, down, k = x[x > m], x[x < m], int((x == m).sum())
    kernels = (((up[:, None] - m) - (m - down)) / (up[:, None] - down)).ravel()
    even = k * (k - 1) // 2
    return float(np.median(np.concatenate([kernels, np.zeros(k), np.ones(k * len(up) + even), -np.ones(k * len(down) + even)]))) if len(x) > 2 else 0.0


def column(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "value double")


@pytest.mark.parametrize("name", CASES)
def test_equals_all_kernels(spark, name):
    x = CASES[name]
    assert whole_medcouple(column(spark, x), chunk=32) == pytest.approx(plain(x), abs=1e-9)


def test_equals_the_sampled_one_where_the_sample_is_all(spark):
    x = RNG.gamma(2.0, size=10_000)
    assert whole_medcouple(column(spark, x), chunk=512) == pytest.approx(medcouple(x), abs=1e-6)


def test_values_that_are_left_out(spark):
    assert whole_medcouple(column(spark, [None, float("nan")])) is None
    assert whole_medcouple(column(spark, [])) is None
    x = [1.0, 2.0, 7.0, 30.0]
    assert whole_medcouple(column(spark, [*x, None, float("nan"), float("inf"), float("-inf")])) == pytest.approx(plain(np.array(x)), abs=1e-9)


def test_option_takes_the_whole_column(spark):
    x = np.round(RNG.exponential(size=300) ** 2, 3)
    t = TypedTable.init(spark.createDataFrame([(float(v),) for v in x], "x double"), logical_types={"x": "Double"})
    with config.with_options(medcouple_sample_size=None):
        assert sampled_medcouple(t, "x") == pytest.approx(plain(x), abs=6e-4)
        assert t["x"].medcouple_dict(include_indices_and_values=False)["medcouple_stat"] == sampled_medcouple(t, "x")
    for wrong in (0, "all"):
        with pytest.raises(ValueError), config.with_options(medcouple_sample_size=wrong):
            pass


def test_passes_read_a_staircase_of_chunks(spark, monkeypatch):
    """Within the first bracket, which the ends of chunks give, few pairs of chunks are open."""
    seen = []
    real = Ratios.counts

    def counts(self, points):
        up, down = self.up, self.down
        first = np.searchsorted(down.high, points[0] * up.low, side="right")
        end = np.searchsorted(down.low, points[-1] * up.high, side="right")
        seen.append((int(np.maximum(end - first, 0).sum()), len(up.ids), len(down.ids)))
        return real(self, points)

    monkeypatch.setattr(Ratios, "counts", counts)
    x = RNG.normal(size=8_000)
    whole_medcouple(column(spark, x), chunk=50)
    assert seen and all(pairs <= 6 * (a + b) < a * b for pairs, a, b in seen)


def test_counts_beyond_64_bits():
    a, many = np.array([1.0, 2.0]), np.array([1 << 40, 1 << 40])
    assert tallied(np.array([0.4, 1.0, 2.0]), a, many, np.array([1.0, 2.0]), many) == [0, 3 << 80, 4 << 80]
