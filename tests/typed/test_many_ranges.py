"""What depends on the order of rows, over many ranges: 200 shuffle partitions that are not put together. And all typed queries
against their SQL over many partitions, so that no result may hang on all rows lying in one."""

from __future__ import annotations

import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from typeloom import queries, table_queries  # noqa: F401
from typeloom.config import config
from typeloom.operators import dependence, frequency
from typeloom.operators.places import ordered
from typeloom.operators.table import TypedTable

SF = "/root/testdata/sf0.001"
N = 2_000_000


@pytest.fixture(scope="module")
def many(spark):
    keys = {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def shuffled(many):
    """Keys 0 to N-1 in scattered order, each with a payload that depends on it."""
    return many.range(N).select(((F.col("id") * 1_299_709) % N).alias("k")).withColumn("payload", F.sha2(F.col("k").cast("string"), 256))


def test_places_are_the_ranks_of_keys(shuffled):
    rows = ordered(shuffled, ["k"])
    assert len(rows.manifest) == 200 and rows.total == N
    got = rows.numbered("place").agg(F.count_if(F.col("place") != F.col("k")).alias("wrong"), F.countDistinct("place").alias("n")).first()
    assert tuple(got) == (0, N)


def test_rows_by_place(shuffled):
    table = TypedTable.init(shuffled, index="k", logical_types={"k": "Integer", "payload": "Unknown"}, validate=False)
    assert sorted(r.k for r in table.iloc(slice(N // 2, N // 2 + 10)).df.collect()) == list(range(N // 2, N // 2 + 10))
    assert sorted(r.k for r in table.iloc(slice(None, None, 400_000)).df.collect()) == list(range(0, N, 400_000))
    assert sorted(r.k for r in table.iloc([5, -1, 777_777]).df.collect()) == [5, 777_777, N - 1]
    assert table.iloc(1_234_567).k == 1_234_567


def test_one_value_may_fill_many_ranges(many):
    """Ties are dealt over ranges, and each row still has a place of its own."""
    df = many.range(300_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), "id")
    rows = ordered(df, ["k"], 50)
    assert max(n for _, n in rows.manifest) < 3 * 300_000 / 50
    got = rows.numbered("place")
    assert got.select("place").distinct().count() == 300_000
    assert got.where("k = -1").agg(F.max("place")).first()[0] == 199_999


def test_runs_and_windows(shuffled, many):
    kept = shuffled.select(F.col("k").alias("pos"), (F.lit(dt.datetime(2020, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("k"))).alias("ts")).where("pos % 100000 != 7")
    got = sorted((r.idx, r["range"]) for r in frequency.runs(kept).collect())
    edges = [-1, *range(7, N, 100_000), N]
    assert got == [(a + 1, b - a - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    (minutes,) = [r for r in frequency.candidates(kept).collect() if r.alias == "T"]
    assert minutes["count"] == sum(b - a - 1 - 14 for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a - 1 > 14)
    places = frequency.positioned(kept, "ts", ["ts"])
    assert places.agg(F.count_if(F.col("pos") >= N - 20), F.max("pos")).first()[:] == (0, N - 21)


def test_frequency_of_a_long_series(shuffled):
    stamp = F.lit(dt.datetime(2000, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("k"))
    assert frequency.infer_frequency(shuffled.select(stamp.alias("ts"), "payload"), "ts") == "T"
    holes = shuffled.where("k % 500000 not between 100 and 102").select(stamp.alias("ts"))
    alias, found = frequency.infer_frequency(holes, "ts", debug=True)
    assert alias is None and found["estimated_freq"] == "T" and [(m["idx"], m["range"]) for m in found["missing_values"]] == [(i * 500_000 + 100, 3) for i in range(4)]


@pytest.mark.parametrize("few", [100_000, 0])
def test_ranks(shuffled, few):
    """Of a column of many values, its falling square, one with ties, and one with nulls; with and without tables sent to tasks."""
    a = F.col("k").cast("double")
    df = shuffled.select(F.col("k").alias("row"), a.alias("a"), (-a * a).alias("b"), F.floor(a / 1000).alias("c"), F.when(F.col("k") % 2 == 0, a % 97).alias("d"))
    with config.with_options(broadcast_rows=few):
        got = dependence.ranked(df, ["a", "b", "c", "d"], "row")
    ks = np.arange(N)
    d = np.where(ks % 2 == 0, ks % 97, -1)
    counts = np.bincount(d[d >= 0], minlength=97)
    rank_d = np.cumsum(counts) - (counts - 1) / 2
    out = {r.a: r for r in got.where("a % 200003 = 1").collect()}
    assert len(out) == 10
    for rank, r in out.items():
        k = int(rank) - 1
        assert (r.b, r.c, r.d) == (N - k, k // 1000 * 1000 + 500.5, rank_d[k % 97] if k % 2 == 0 else None)


def test_spearman_of_a_large_table(shuffled):
    a = F.col("k").cast("double")
    df = shuffled.select(a.alias("a"), (-a * a).alias("b"), F.floor(a / 7).cast("double").alias("c"))
    table = TypedTable.init(df, logical_types={"a": "Double", "b": "Double", "c": "Double"}, validate=False)
    got = {(r.column_1, r.column_2): r.spearman for r in table.dependence("spearman").collect()}
    assert got["a", "b"] == pytest.approx(-1, abs=1e-12) and got["a", "c"] == pytest.approx(1, abs=1e-9) and got["b", "c"] == pytest.approx(-got["a", "c"], abs=1e-12)


def test_expected_information_keeps_its_digits():
    """Against a plain sum over all terms, and for very many rows against the leading term of the expansion in 1/n."""

    def plain(a, b, n):
        g, out = math.lgamma, 0.0
        base = g(a + 1) + g(b + 1) + g(n - a + 1) + g(n - b + 1) - g(n + 1)
        for c in range(max(1, a + b - n), min(a, b) + 1):
            out += c / n * math.log(n * c / (a * b)) * math.exp(base - g(c + 1) - g(a - c + 1) - g(b - c + 1) - g(n - a - b + c + 1))
        return out

    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 10, 333, 20_000, 300_000):
        for _ in range(20 if n < 1000 else 5):
            a, b = (int(x) for x in rng.integers(1, n + 1, 2))
            assert dependence._expected(a, b, n) == pytest.approx(plain(a, b, n), abs=1e-9)
    for n in (10**9, 10**12):
        assert dependence._expected(n // 2, n // 3, n) == pytest.approx((1 - 1 / 2) * (1 - 1 / 3) / (2 * n), rel=1e-6)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_over_many_partitions(spark, oracle, name):
    keys = {"spark.sql.shuffle.partitions": "11", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        out = queries.QUERIES[name](spark, SF)
        got, columns = out.collect(), sorted(out.columns)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    cursor = oracle.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = [tuple(_plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert sorted((tuple(_plain(r[c]) for c in columns) for r in got), key=repr) == sorted(want, key=repr)


def _plain(x):
    """A value as it is compared: numbers as floats, to nine digits."""
    if isinstance(x, bool) or x is None:
        return x
    return float(f"{float(x):.9g}") if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else x
