"""Hashed modes, exact samples, rules of values, fingerprints, side-by-side tables, Arrow files as a source, and typing within files."""

from __future__ import annotations

import datetime as dt
import os
import random
import shutil
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom import errors
from typeloom.config import config
from typeloom.functions import logical_types as L
from typeloom.operators import fingerprints, modes, samples
from typeloom.operators.table import TypedTable, concat_columns
from typeloom.plans import inference
from typeloom.plans.registry import OfValues, TypeSystem
from typeloom.sources import arrow_source, files


def plans(spark, df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [50, 1])
def test_modes_equal_plain_counts(spark, monkeypatch, few):
    """With few = 1 every tie goes by the join."""
    monkeypatch.setattr(modes, "FEW", few)
    rng = random.Random(2)
    long = "x" * 3000
    data = {
        "word": ("string", [rng.choice(["b", "a", "c", None]) for _ in range(400)]),
        "text": ("string", [long + str(i) for i in range(400)]),
        "tied": ("string", [f"{'same head for all of them '}{i // 2 if i < 300 else i}" for i in range(400)]),
        "number": ("double", [rng.choice([0.0, -0.0, 1.5, None]) for _ in range(400)]),
        "whole": ("long", [i % 7 for i in range(400)]),
        "flag": ("boolean", [True, False] * 200),
        "day": ("date", [dt.date(2020, 1, 1 + i % 3) for i in range(400)]),
        "pair": ("struct<a:double,b:double>", [(1.0, None) if i % 3 else (None, 1.0) for i in range(400)]),
        "list": ("array<int>", [[i % 2, None] for i in range(400)]),
        "none": ("string", [None] * 400),
    }
    df = spark.createDataFrame(list(zip(*(v for _, v in data.values()), strict=True)), ", ".join(f"{c} {t}" for c, (t, _) in data.items())).repartition(5)
    got = modes.distinct_and_mode(df, list(data), list(data))
    for c, (_, values) in data.items():
        counts = Counter(tuple(v) if isinstance(v, (list, tuple)) else v for v in values if v is not None)
        top = max(counts.values(), default=0)
        key = lambda v: tuple((x is not None, x or 0) for x in v) if isinstance(v, tuple) else v
        least = min((v for v, n in counts.items() if n == top), key=key, default=None)
        assert got[c] == (len(counts), list(least) if c == "list" else least), c


def test_what_is_shuffled_does_not_grow_with_texts(spark, monkeypatch):
    """The counts of hashes that are shuffled and written are as large for long texts as for short ones."""
    kept = []
    monkeypatch.setattr(modes, "written", lambda df, name: kept.append(df) or df)
    for n in (10, 10_000):
        df = spark.range(2000).select(F.concat(F.repeat(F.lit("y"), n), F.col("id").cast("string")).alias("t"))
        assert modes.distinct_and_mode(df, ["t"], ["t"])["t"] == (2000, "y" * n + "0")
    assert [f.dataType.simpleString() for f in kept[1].schema] == ["int", "bigint", "bigint", "bigint"]
    assert "hashpartitioning(x.i" in plans(spark, kept[1]) or "hashpartitioning(i" in plans(spark, kept[1]) or "hashpartitioning(_groupingexpression" in plans(spark, kept[1])


def test_samples_are_exact_and_seeded(spark):
    df = spark.range(50_000).select((F.col("id") % 10).alias("x"), F.lit("same").alias("y"), "id")
    one, again, other = (samples.exact_sample(df, 3000, s) for s in (1, 1, 2))
    ids = [sorted(r.id for r in s.select("id").collect()) for s in (one, again, other)]
    assert [len(x) for x in ids] == [3000] * 3 and len(set(ids[0])) == 3000 and ids[0] == ids[1] != ids[2]
    assert all(200 < n < 400 for n in Counter(i % 10 for i in ids[0]).values())
    assert samples.exact_sample(df, 50_000, 1) is df
    repeated = spark.range(9000).select(F.lit(7).alias("x"))
    assert samples.exact_sample(repeated, 100, 3).count() == 100


def test_samples_of_many_files_look_at_some(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(samples, "FILES", 4)
    monkeypatch.setattr(samples, "SPARE", 3)
    spark.range(0, 4000, 1, 40).write.parquet(f"{tmp_path}/a")
    df = spark.read.parquet(f"{tmp_path}/a").where("id >= 0")
    got = [r.id for r in samples.exact_sample(df, 60, 5, some_files=True).collect()]
    assert len(set(got)) == 60 and len({i // 100 for i in got}) <= 4
    joined = df.join(df.select((F.col("id") + 1).alias("id")), "id")
    assert samples.exact_sample(joined, 60, 5, some_files=True).count() == 60


def test_rules_of_values(spark):
    class Distinct(L.Double):
        """Numbers none of which comes twice."""

    class Palindrome(L.Unknown):
        """Texts that read the same backwards."""

    system = TypeSystem()
    system.add_type(Distinct, OfValues(lambda s: s.dtype.kind == "f" and s.dropna().is_unique and bool(s.notna().any())), parent="Double")
    system.add_type(Palindrome, OfValues(lambda s: all(isinstance(v, str) and v == v[::-1] for v in s.dropna())), parent="Unknown")
    df = spark.createDataFrame([(1.5, 2.5, "anna", "bob"), (None, 2.5, "otto", "cat"), (3.5, None, None, "dog")], "a double, b double, c string, d string")
    got = {c: type(k).__name__ for c, k in inference.infer(df, system=system).items()}
    assert got == {"a": "Distinct", "b": "Double", "c": "Palindrome", "d": "Unknown"}


def test_fingerprints(spark):
    rows = [(1, None, 0.0, {"a": 1}, (1.0, None)), (2, "x", float("nan"), None, None), (2, "x", float("nan"), None, None), (3, None, None, {"b": 2, "a": 1}, (None, 1.0))]
    schema = "k long, s string, d double, m map<string,int>, p struct<a:double,b:double>"
    left = spark.createDataFrame(rows, schema)
    same = spark.createDataFrame([rows[3][:3] + ({"a": 1, "b": 2}, (None, 1.0)), (1, None, -0.0, {"a": 1}, (1.0, None)), rows[1], rows[1]], schema).repartition(3)
    assert fingerprints.fingerprint(left) == fingerprints.fingerprint(same)
    for change in (rows[:3], [*rows, rows[0]], [*rows[:3], (3, None, None, {"b": 2, "a": 1}, (1.0, None))], [*rows[:3], (None, "3", None, {"b": 2, "a": 1}, (None, 1.0))]):
        assert fingerprints.fingerprint(left) != fingerprints.fingerprint(spark.createDataFrame(change, schema))
    a, b = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "k long, v string"), spark.createDataFrame([(1, "a"), (2, None), (4, "c"), (4, "c")], "k long, v string")
    assert sorted(map(tuple, fingerprints.differing(a, b).collect())) == [(1, "a", "left"), (3, "c", "left"), (4, "c", "right"), (4, "c", "right")]
    assert fingerprints.differing(a, a.repartition(2)).count() == 0
    kinds = {"k": "Integer", "v": "Unknown"}
    t, u = (TypedTable.init(x, logical_types=kinds) for x in (a, b))
    assert t.equals(TypedTable.init(a.repartition(4), logical_types=kinds), deep=True) and not t.equals(u, deep=True) and t.equals(u)
    assert t.differing(u).count() == 4


def test_five_tables_side_by_side_meet_in_one_shuffle(spark):
    parts = []
    for i in range(5):
        df = spark.range(i, 100, i + 1).select("id", (F.col("id") * i).alias(f"v{i}"), F.when(F.col("id") % 2 == 0, "e").alias(f"s{i}"))
        parts.append(TypedTable.init(df, f"t{i}", "id", logical_types={"id": "Integer", f"v{i}": "Integer", f"s{i}": "Unknown"}))
    out = concat_columns(parts)
    plan = plans(spark, out.df)
    assert plan.count("Join") == 0 and plan.count("Exchange hashpartitioning") == 1
    got = {r.id: r for r in out.df.collect()}
    want = {k: tuple(x for i in range(5) for x in ((k * i, "e" if k % 2 == 0 else None) if k >= i and (k - i) % (i + 1) == 0 else (None, None))) for k in range(100)}
    assert {k: tuple(r)[1:] for k, r in got.items()} == want
    assert [str(out.logical_types[f"v{i}"]) for i in range(5)] == ["Integer"] + ["IntegerNullable"] * 4 and out.name == "t0_t1_t2_t3_t4"
    twice = TypedTable.init(spark.createDataFrame([(1, 2), (1, 3)], "id long, w long"), index="id", logical_types={"id": "Integer", "w": "Integer"}, validate=False)
    with pytest.raises(Exception, match="repeats the key 1"):
        concat_columns([parts[0], twice], validate=False).df.collect()


def test_arrow_files_are_read_by_batches(spark, tmp_path):
    schema = pa.schema([("a", pa.int64()), ("b", pa.string()), ("c", pa.float64())])
    for f in range(2):
        with pa.ipc.new_file(f"{tmp_path}/{f}.arrow", schema) as w:
            for i in range(30):
                w.write_batch(pa.record_batch([pa.array([f * 100 + i]), pa.array(["z" * 1000]), pa.array([0.5])], schema=schema))
    df = arrow_source.read(spark, str(tmp_path), task_bytes=5000)
    assert df.rdd.getNumPartitions() > 8 and df.agg(F.sum("a")).first()[0] == sum(range(30)) + sum(range(100, 130)) and df.columns == ["a", "b", "c"]
    some = arrow_source.read(spark, f"file://{tmp_path}/1.arrow", ["c", "a"])
    assert some.columns == ["c", "a"] and some.rdd.getNumPartitions() == 1 and some.count() == 30 and some.first().c == 0.5
    with pytest.raises(Exception, match="nothing"):
        arrow_source.read(spark, f"{tmp_path}/nothing")


def test_a_failed_write_of_arrow_files_leaves_nothing(spark, tmp_path):
    df = spark.range(0, 100, 1, 4)
    with pytest.raises(Exception, match="stop here"):
        arrow_source.write(df.select(F.when(F.col("id") == 99, F.raise_error(F.lit("stop here")).cast("long")).otherwise(F.col("id")).alias("id")), f"{tmp_path}/x")
    assert not os.path.exists(f"{tmp_path}/x")
    arrow_source.write(df, f"{tmp_path}/x")
    assert sorted(os.listdir(f"{tmp_path}/x")) == [f"part-{i:05d}.arrow" for i in range(4)]
    assert sorted(r.id for r in arrow_source.read(spark, f"{tmp_path}/x").collect()) == list(range(100))


def test_typing_within_parquet_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, "b", None)], "k long, c string, x double")
    t = TypedTable.init(df, "t", "k", logical_types={"k": "Integer", "c": L.Ordinal(["b", "a"]), "x": "Double"}, semantic_tags={"x": "money"}, table_metadata={"m": 1}, column_descriptions={"c": "grade"})
    t.to_disk(f"file://{tmp_path}/t", format="parquet")
    shutil.move(f"{tmp_path}/t/data/data", f"{tmp_path}/moved.parquet")
    back = files.read_typed(spark, f"file://{tmp_path}/moved.parquet", validate=True)
    assert back.equals(t, deep=True) and back.schema.columns["c"].description == "grade" and not back.df.schema["c"].metadata
    some = files.read_typed(spark, f"file://{tmp_path}/moved.parquet", ["x", "c"])
    assert some.index is None and some.semantic_tags["x"] == {"numeric", "money"} and some.name == "t"
    os.makedirs(f"{tmp_path}/u/data")
    shutil.move(f"{tmp_path}/moved.parquet", f"{tmp_path}/u/data/d.parquet")
    assert files.read_table(spark, f"{tmp_path}/u", "d.parquet").equals(t, deep=True)
    df.write.parquet(f"{tmp_path}/plain")
    with pytest.raises(ValueError):
        files.read_typed(spark, f"{tmp_path}/plain")


def test_csv_files_with_line_breaks_are_read_whole_and_others_in_parts(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"one\ntwo"\n2,x\n')
    (tmp_path / "b.csv").write_text("k,v\n" + "".join(f"{i},plain\n" for i in range(3, 3000)))
    df = files._csv(spark, f"file://{tmp_path}", header=True, escape='"')
    assert df.count() == 2999 and df.where("k = '1'").first().v == "one\ntwo"
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        assert files._csv(spark, f"file://{tmp_path}", header=True, escape='"').rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_coordinates_are_numbers_or_null(spark):
    df = spark.createDataFrame([(1, (1.0, None)), (2, (float("nan"), 2.0)), (3, None)], "k long, p struct<latitude:double,longitude:double>")
    t = TypedTable.init_with_full_schema(df, TypedTable.init(df, logical_types={"k": "Integer", "p": "LatLong"}).schema, validate=False)
    with pytest.raises(errors.TypeValidationError):
        t.validate_logical_types()
    assert t.validate_logical_types(return_invalid_values=True).count() == 1


def test_inference_reads_the_sample_once_it_is_written(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("a"), F.col("id") % 3).alias("s"), (F.col("id") % 2 == 0).alias("b"))
    with config.with_options(inference_sample_rows=500):
        assert inference.sampled(df).count() == 500
        assert [type(k).__name__ for k in inference.infer(df).values()] == ["Integer", "Categorical", "Boolean"]
