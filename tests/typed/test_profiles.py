"""Statistics, dependence, outliers, frequencies and streams, against plain computations."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from typeloom import errors
from typeloom.config import config
from typeloom.operators import counts, dependence, frequency, outliers
from typeloom.operators.quantiles import quantiles
from typeloom.operators.table import TypedTable
from typeloom.streaming import profile


def typed(spark, data: dict, kinds: dict, **kw) -> TypedTable:
    rows = list(zip(*data.values()))
    schema = ", ".join(f"`{c}` {t}" for c, (t, _) in kinds.items())
    return TypedTable.init(spark.createDataFrame(rows, schema), logical_types={c: k for c, (_, k) in kinds.items()}, validate=False, **kw)


@pytest.mark.parametrize("most", [100_000, 50])
def test_quantiles(spark, most):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"a": rng.normal(size=3000), "b": rng.integers(0, 5, 3000).astype(float), "c": np.where(rng.random(3000) < 0.6, 7.0, rng.normal(size=3000)), "d": [np.nan] * 2999 + [3.0]})
    df = spark.createDataFrame(frame).select("*", F.lit(None).cast("double").alias("e"))
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    with config.with_options(exact_values_in_a_task=most):
        got = quantiles(df, list("abcde"), ps)
    for c in "abcd":
        assert got[c] == pytest.approx(frame[c].quantile(ps).tolist(), abs=1e-12)
    assert got["e"] is None


def test_describe(spark):
    data = {
        "k": list(range(8)),
        "flag": [True, False, True, True, False, True, False, None],
        "color": ["red", "blue", "red", None, "red", "blue", "red", "yellow"],
        "when": [dt.datetime(2020, 2, d) for d in (1, 2, 1, 3, 1, 2, 4)] + [None],
        "n": [10.0, 20.0, 17.0, 32.0, 1.0, None, 56.0, 10.0],
        "i": [1, 2, 2, 5, 5, None, 1, 1],
        "text": ["a b", None, "c", "d", "e", "f", "g", "h"],
        "u": ["x", "y", None, "x", "z", "x", "y", "w"],
    }
    kinds = {"k": ("long", "Integer"), "flag": ("boolean", "BooleanNullable"), "color": ("string", "Categorical"), "when": ("timestamp_ntz", "Datetime"), "n": ("double", "Double"), "i": ("long", "IntegerNullable"), "text": ("string", "NaturalLanguage"), "u": ("string", "Unknown")}
    t = typed(spark, data, kinds, index="k")
    seen = []
    d = t.describe_dict(extra_stats=True, callback=lambda *a: seen.append(a))
    assert "k" not in d and len(seen) == 7
    assert (d["flag"]["num_true"], d["flag"]["num_false"], d["flag"]["mode"], d["flag"]["nan_count"]) == (4, 3, True, 1)
    assert (d["color"]["nunique"], d["color"]["mode"], d["color"]["count"]) == (3, "red", 7)
    assert d["color"]["top_values"] == [{"value": "red", "count": 4}, {"value": "blue", "count": 2}, {"value": "yellow", "count": 1}]
    assert (d["when"]["min"], d["when"]["max"], d["when"]["mode"]) == (dt.datetime(2020, 2, 1), dt.datetime(2020, 2, 4), dt.datetime(2020, 2, 1))
    assert d["when"]["mean"] == dt.datetime(2020, 2, 2)
    x = pd.Series(data["n"])
    assert d["n"]["mean"] == pytest.approx(x.mean()) and d["n"]["std"] == pytest.approx(x.std()) and d["n"]["mode"] == 10.0
    assert [d["n"][q] for q in ("first_quartile", "second_quartile", "third_quartile")] == pytest.approx(x.quantile([0.25, 0.5, 0.75]).tolist())
    cut = pd.cut(x.dropna(), 10)
    assert [b["frequency"] for b in d["n"]["histogram"]] == cut.value_counts().sort_index().tolist()
    assert d["i"]["top_values"] == [{"value": 1, "count": 3}, {"value": 2, "count": 2}, {"value": 5, "count": 2}, {"value": 3, "count": 0}, {"value": 4, "count": 0}]
    assert set(d["text"]) == {"physical_type", "logical_type", "semantic_tags", "count", "nan_count", "mode"} and d["text"]["mode"] == "a b" and d["u"]["nunique"] == 4
    assert [b["bins"] for b in d["n"]["histogram"]] == [[c.left, c.right] for c in cut.cat.categories]
    assert [a[:4] for a in seen] == [(1, i + 1, 7, "calculations") for i in range(7)] and all(a[4] > 0 for a in seen)
    table = t.describe(["numeric", "flag"]).collect()
    assert [r.column for r in table] == ["flag", "n", "i"] and table[0].num_true == "4"
    with pytest.raises(ValueError):
        t.describe_dict(["none"])


def test_counts(spark):
    t = typed(spark, {"c": ["b", "a", None, "a", "b", None, None, "z"]}, {"c": ("string", "Categorical")})
    assert t.value_counts()["c"] == [{"value": None, "count": 3}, {"value": "a", "count": 2}, {"value": "b", "count": 2}, {"value": "z", "count": 1}]
    assert t.value_counts(ascending=True, top_n=1, dropna=True)["c"] == [{"value": "z", "count": 1}]
    df = spark.createDataFrame([(5.0,)] * 3 + [(float("nan"),), (None,)], "x double")
    assert [r.frequency for r in counts.histogram(df, "x", 4).orderBy("bin").collect()].count(0) == 3
    assert counts.histogram(df.where("x is null"), "x").count() == 0
    x = pd.Series(np.random.default_rng(2).integers(0, 30, 500).astype(float))
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    codes = pd.qcut(x, 10, labels=False, duplicates="drop")
    got = df.groupBy(counts.bin_of(F.col("x"), counts.quantile_edges(df, "x")).alias("b")).count().collect()
    assert Counter({r.b: r["count"] for r in got}) == Counter(codes.tolist())


def test_box_plots(spark):
    values = [-16.0, -1.0, 42.0, 50.0, 51.0, 53.0, 54.0, 55.0, 93.0, None]
    t = typed(spark, {"k": list(range(10)), "x": values, "s": ["a"] * 10, "e": [None] * 10}, {"k": ("long", "Integer"), "x": ("double", "Double"), "s": ("string", "Categorical"), "e": ("double", "Double")}, index="k")
    x = pd.Series(values).dropna()
    q1, q3 = x.quantile([0.25, 0.75])
    got = t["x"].box_plot_dict()
    low, high = max(x.min(), q1 - 1.5 * (q3 - q1)), min(x.max(), q3 + 1.5 * (q3 - q1))
    assert (got["low_bound"], got["high_bound"]) == (low, high)
    assert got["low_indices"] == [0, 1] and got["high_values"] == [93.0]
    assert t["e"].box_plot_dict()["low_bound"] is None
    with pytest.raises(TypeError):
        t["s"].box_plot_dict()
    with pytest.raises(ValueError):
        t["x"].box_plot_dict(quantiles={0.0: 1})
    assert t["x"].box_plot_dict(quantiles=got["quantiles"], include_indices_and_values=False)["low_bound"] == low


def brute_medcouple(x):
    m = np.median(x)
    up, down = [v for v in x if v >= m], [v for v in x if v <= m]
    h = [((a - m) - (m - b)) / (a - b) for a in up for b in down if a != b]
    return float(np.median(h))


def test_medcouple(spark):
    rng = np.random.default_rng(4)
    for n in (20, 51, 400):
        x = rng.exponential(size=n)
        assert outliers.medcouple(x) == pytest.approx(brute_medcouple(x), abs=0.02)
    x = rng.exponential(size=3000)
    assert outliers.medcouple(x) == pytest.approx(outliers.medcouple(x[:1900]), abs=0.06)
    assert outliers.medcouple(np.array([1.0, 2.0, 3.0])) == 0.0 and outliers.medcouple(np.ones(9)) == 0.0
    skewed = [float(v) for v in np.round(rng.exponential(size=66) ** 2, 3)]
    t = typed(spark, {"x": skewed}, {"x": ("double", "Double")})
    got = t["x"].get_outliers()
    assert got["method"] == "medcouple" and got["medcouple_stat"] >= 0.3
    s = pd.Series(skewed)
    k = min(abs(((s - s.mean()) ** 3).mean() / ((s - s.mean()) ** 2).mean() ** 1.5), 3.5)
    q1, q3 = s.quantile([0.25, 0.75])
    assert got["high_bound"] == pytest.approx(min(s.max(), q3 + 1.5 * math.exp(k * got["medcouple_stat"]) * (q3 - q1)), abs=1e-4)
    with pytest.raises(ValueError):
        t["x"].get_outliers("other")


def pairs_of(frame, a, b):
    both = frame[[a, b]].dropna()
    either = frame[[a, b]].dropna(how="all")
    return both, len(both) / len(either)


def test_dependence(spark):
    rng = np.random.default_rng(6)
    n = 400
    x = rng.normal(size=n)
    frame = pd.DataFrame({"x": x, "y": x * 2 + rng.normal(size=n), "z": np.where(rng.random(n) < 0.3, np.nan, np.round(x**3)), "c": rng.choice(list("abc"), n), "flat": 1.0})
    t = TypedTable.init(spark.createDataFrame(frame.assign(o=np.where(x > 0, "hi", "lo"))), logical_types={"x": "Double", "y": "Double", "z": "Double", "c": "Categorical", "flat": "Double", "o": __import__("typeloom.functions.logical_types", fromlist=["Ordinal"]).Ordinal(["lo", "hi"])})
    got = {(r.column_1, r.column_2): r for r in t.dependence(extra_stats=True, min_shared=10).collect()}
    for a, b in (("x", "y"), ("x", "z"), ("y", "z")):
        both, share = pairs_of(frame, a, b)
        r = got[a, b]
        assert r.shared_rows == len(both)
        assert r.pearson == pytest.approx(both.corr().iloc[0, 1] * share)
        assert r.spearman == pytest.approx(both.rank().corr().iloc[0, 1] * share)
        best = max((abs(v), -i) for i, v in enumerate((r.mutual_info, r.pearson, r.spearman)))
        assert abs(r.max) == best[0]
    assert got["x", "flat"].pearson is None and got["x", "o"].spearman > 0.8 and got["x", "o"].pearson is None
    assert got["x", "c"].mutual_info == pytest.approx(0, abs=0.03) and got["x", "o"].mutual_info > 0.3
    order = [abs(r.max) for r in t.dependence("max").collect() if r.max is not None]
    assert order == sorted(order, reverse=True) and t.dependence("max").columns == ["column_1", "column_2", "max"]
    assert {r.column_2 for r in t.dependence("pearson", target_col="y").collect()} == {"y"}
    with pytest.raises(ValueError):
        t.dependence("pearson", target_col="none")
    with pytest.raises(ValueError):
        t.dependence("other")
    with pytest.warns(errors.SparseDataWarning):
        assert all(r.pearson is None for r in t.dependence("pearson", min_shared=1000).collect())
    with pytest.warns(UserWarning):
        dependence.parse_measures(["all", "max"])
    assert t.pearson_correlation(nrows=50).count() == len(t.pearson_correlation_dict())


def test_adjusted_information():
    def of(u, v):
        cells, a, b = Counter(zip(u, v)), Counter(u), Counter(v)
        sizes = Counter((a[x], b[y], n) for (x, y), n in cells.items())
        return dependence.adjusted_mutual_information([(*k, w) for k, w in sizes.items()], Counter(a.values()), Counter(b.values()))

    assert of("aabb", "xxyy") == pytest.approx(1.0) and of("aaaa", "xxxx") == 1.0 and of("aabb", "xxxx") == pytest.approx(0.0)
    # two binary columns of four rows that are independent: information 0, expectation ln(2) / 3
    assert of("aabb", "xyxy") == pytest.approx(-(math.log(2) / 3) / (math.log(2) - math.log(2) / 3))


def test_large_categories_are_left_out(spark):
    df = spark.range(4000).select((F.col("id") % 3001).cast("string").alias("a"), (F.col("id") % 3001).cast("string").alias("b"), (F.col("id") % 100).cast("string").alias("c"))
    t = TypedTable.init(df, logical_types=dict.fromkeys("abc", "Categorical"))
    with pytest.warns(UserWarning, match="left out"):
        assert {(r.column_1, r.column_2) for r in t.mutual_information().collect()} == {("b", "c")}


def test_histogram_edges_are_shown_as_pandas_shows_them(spark):
    for values, bins in (([0.0001, 0.00015, 0.0002], 7), ([1.0, 1.0], 3), ([-5.0, 1234.5678], 4), ([1e-9, 2.5], 10), ([100.0001, 100.0002], 10), ([0.0, 0.0], 2)):
        got = counts.histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v", bins).orderBy("bin").collect()
        cut = pd.cut(pd.Series(values), bins)
        assert [(r.low, r.high) for r in got] == [(c.left, c.right) for c in cut.cat.categories]
        assert [r.frequency for r in got] == cut.value_counts().sort_index().tolist()


def test_spearman_with_nulls_on_both_sides(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"a": rng.integers(0, 6, 400).astype(float), "b": rng.normal(size=400), "c": rng.integers(0, 50, 400).astype(float), "d": rng.normal(size=400)})
    frame.loc[rng.random(400) < 0.2, "b"] = np.nan
    frame.loc[rng.random(400) < 0.3, "c"] = np.nan
    want = frame.corr("spearman")
    for few in (100_000, 10):
        with config.with_options(broadcast_rows=few):
            got = TypedTable.init(spark.createDataFrame(frame), logical_types=dict.fromkeys("abcd", "Double"), validate=False).spearman_correlation()
        for r in got.collect():
            both, either = frame[[r.column_1, r.column_2]].notna().all(axis=1).sum(), frame[[r.column_1, r.column_2]].notna().any(axis=1).sum()
            assert r.spearman == pytest.approx(want.loc[r.column_1, r.column_2] * both / either, abs=1e-9)


def test_dependence_leaves_out_indexes_by_default(spark):
    t = typed(spark, {"k": range(40), "t": [dt.datetime(2020, 1, 1) + dt.timedelta(days=i) for i in range(40)], "x": range(40), "y": range(40)}, {"k": ("long", "Integer"), "t": ("timestamp_ntz", "Datetime"), "x": ("long", "Integer"), "y": ("long", "Integer")}, index="k", time_index="t")
    assert [(r.column_1, r.column_2) for r in t.pearson_correlation().collect()] == [("x", "y")]
    assert len(t.pearson_correlation(include_index=True, include_time_index=True).collect()) == 6
    assert dependence.valid_mi_columns(t) == ["x", "y"] and dependence.valid_mi_columns(t, True, True) == ["k", "t", "x", "y"]
    first = t.pearson_correlation(nrows=20, min_shared=5).collect()
    assert first == TypedTable(t.df.repartition(7), t.schema).pearson_correlation(nrows=20, min_shared=5).collect()


def day(text):
    return dt.datetime.fromisoformat(text)


#: Our aliases, those of pandas, first dates and how many timestamps.
ALIASES = [("3D", "3D", "2005-01-01"), ("2W-SUN", "2W-SUN", "2005-01-02"), ("6H", "6h", "2005-01-01"), ("T", "min", "2005-01-01"), ("U", "us", "2005-01-01"), ("M", "ME", "2005-01-31"), ("5M", "5ME", "2005-01-31"), ("BM", "BME", "2005-01-31"), ("BMS", "BMS", "2005-01-03"), ("QS-OCT", "QS-OCT", "2005-01-01"), ("A-DEC", "YE-DEC", "2005-12-31"), ("B", "B", "2005-01-03"), ("SM-15", "SME-15", "2005-01-15")]


@pytest.mark.parametrize("alias,other,first", ALIASES)
def test_frequency_aliases(spark, alias, other, first):
    stamps = pd.date_range(first, periods=40, freq=other) + pd.Timedelta("07:30:01")
    made = frequency.series(spark, alias, stamps[0].to_pydatetime(), stamps[-1].to_pydatetime())
    assert [(r.pos, r.ts) for r in made.orderBy("pos").collect()] == list(enumerate(t.to_pydatetime() for t in stamps))
    rows = made.withColumn("other", F.when(F.col("pos") != 20, F.col("ts")))
    assert frequency.infer_frequency(rows, "ts") == alias
    assert frequency.infer_frequency(rows.where("other is not null"), "other") != alias
    assert frequency.infer_frequency(rows.where("pos < 2"), "ts") is None
    found = {r.alias: r["count"] for r in frequency.candidates(rows.where("other is not null").select("pos", "ts"), 15).collect()}
    assert found[alias] == 11 and sum(found.values()) == 25  # of 25 windows of 15 among 39 timestamps those without the gap


def days(first, last):
    return [t.to_pydatetime() for t in pd.date_range(first, last, freq="D")]


def debugged(spark, stamps):
    df = spark.createDataFrame(list(enumerate(stamps)), "k long, t timestamp_ntz")
    t = TypedTable.init(df, index="k", logical_types={"t": "Datetime"})
    return t.infer_temporal_frequencies(["t"], debug=True)["t"]


def test_frequency_errors_are_found(spark):
    clean = days("2005-01-01", "2005-12-31")
    alias, d = debugged(spark, clean)
    assert alias == "D" and d["estimated_freq"] is None and not d["missing_values"]
    noisy = clean[:100] + clean[103:200] + [clean[199]] * 2 + clean[200:250] + [clean[249] + dt.timedelta(hours=5)] + clean[250:300] + [None] + clean[300:]
    alias, d = debugged(spark, noisy)
    assert alias is None and d["estimated_freq"] == "D"
    assert d["missing_values"] == [{"dt": "2005-04-11T00:00:00", "idx": 100, "range": 3}]
    assert d["duplicate_values"] == [{"dt": clean[199].isoformat(), "idx": 197, "range": 2}]
    assert d["extra_values"] == [{"dt": (clean[249] + dt.timedelta(hours=5)).isoformat(), "idx": 249, "range": 1}]
    assert [(r["idx"], r["range"]) for r in d["nan_values"]] == [(300, 1)]


def test_frequency_gives_up(spark):
    assert "datetime_series_is_not_long_enough" == debugged(spark, [day("2005-01-01"), day("2005-01-03"), day("2005-01-04")])[1]["message"]
    assert "datetime_series_is_empty" == debugged(spark, [None, None])[1]["message"]
    assert "datetime_series_is_not_monotonic" == debugged(spark, [day("2005-02-01")] + days("2005-01-01", "2005-01-20"))[1]["message"]
    rng = np.random.default_rng(1)
    mess = [day("2005-01-01") + dt.timedelta(hours=int(h)) for h in np.cumsum(rng.integers(1, 50, 60))]
    assert "datetime_series_freq_cannot_be_estimated" == debugged(spark, mess)[1]["message"]
    df = spark.createDataFrame([(1, "x")], "k long, s string")
    t = TypedTable.init(df)
    with pytest.raises(TypeError):
        t.infer_temporal_frequencies(["s"])
    with pytest.raises(ValueError):
        t.infer_temporal_frequencies(["none"])


def test_frequency_of_lengths_of_time(spark):
    df = spark.range(20).select(F.make_dt_interval(days=F.col("id").cast("int") * 2).alias("d"))
    assert TypedTable.init(df, logical_types={"d": "Timedelta"}).infer_temporal_frequencies() == {"d": "2D"}


def test_stream_profile(spark, tmp_path):
    frame = pd.DataFrame({"x": [1.0, 2.0, np.nan, 4.0], "s": ["a", None, "b", "c"]})
    for i in range(3):
        spark.createDataFrame(frame).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("x double, s string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        profile.start(stream, f"{tmp_path}/parts", f"{tmp_path}/state").awaitTermination()
    got = {r.column: r for r in profile.read(spark, f"{tmp_path}/parts").collect()}
    x = pd.concat([frame.x] * 3)
    assert (got["x"]["count"], got["x"].nan_count, got["s"].nan_count) == (9, 3, 3)
    assert got["x"].mean == pytest.approx(x.mean()) and got["x"].std == pytest.approx(x.std()) and (got["x"].min, got["x"].max) == (1.0, 4.0)
