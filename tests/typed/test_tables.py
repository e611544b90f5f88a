"""Typed tables: types, tags, selection, coercion, checks and files."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom import errors
from typeloom.config import OPTIONS, Config, config
from typeloom.functions import datetimes
from typeloom.functions import logical_types as L
from typeloom.operators.catalog import list_logical_types, list_semantic_tags
from typeloom.operators.table import TypedTable, concat_columns, init_series, invalid_schema_message, is_schema_valid, typed_series
from typeloom.plans import inference
from typeloom.plans.registry import TypeSystem
from typeloom.plans.schema import ColumnSchema, TableSchema
from typeloom.sources import files


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, f"Name {i}", f"p{i}@example.com" if i % 4 else None, f"1-(555)-234-567{i}", 30 + i if i != 2 else None, dt.datetime(2020, 9, i + 1), bool(i % 2)) for i in range(6)]
    return spark.createDataFrame(rows, "id long, full_name string, email string, phone string, age long, signup timestamp_ntz, registered boolean")


@pytest.fixture(scope="module")
def table(people):
    return TypedTable.init(people, "people", "id", "signup", {"full_name": "PersonFullName"}, {"age": "custom"})


def test_inferred_and_given_types(table):
    assert {c: str(k) for c, k in table.logical_types.items()} == {"id": "Integer", "full_name": "PersonFullName", "email": "EmailAddress", "phone": "PhoneNumber", "age": "IntegerNullable", "signup": "Datetime", "registered": "Boolean"}
    assert table.semantic_tags["id"] == {"index"} and table.semantic_tags["age"] == {"numeric", "custom"} and table.semantic_tags["signup"] == {"time_index"}
    assert (table.index, table.time_index, table.name) == ("id", "signup", "people")
    assert not table["id"].schema.custom_tags and table["id"].schema.is_numeric


STRINGS = {
    "integers": (["1", "2", " 3 ", "+4", "1_000"], L.Integer),
    "integers_missing": (["1", "NA", None, "7"], L.IntegerNullable),
    "doubles": (["1.5", "2", "1e3"], L.Double),
    "infinite": (["inf", "2", "3"], L.Double),
    "booleans": (["Yes", "no", "YES"], L.Boolean),
    "booleans_missing": (["t", "f", "nan"], L.BooleanNullable),
    "one_boolean": (["yes", "yes"], L.Unknown),
    "dates": (["2020-01-02", "2021-11-30"], L.Datetime),
    "times": (["01/02/2020 10:11:12", "12/31/2021 00:00:00"], L.Datetime),
    "emails": (["a@b.com", "c.d@e.org"], L.EmailAddress),
    "bad_emails": (["a@b.com", "c.d@e"], L.Unknown),
    "urls": (["http://a.com/x", "https://b.org"], L.URL),
    "addresses": (["1.2.3.4", "255.0.0.1"], L.IPAddress),
    "addresses6": (["2001:db8::1", "1.2.3.4"], L.Unknown),
    "only6": (["2001:0db8:0000:0000:0000:ff00:0042:8329", "::1"], L.IPAddress),
    "phones": (["555-234-5678", "(555) 234 5678"], L.PhoneNumber),
    "postal": (["12345", "12345-6789", "54321"], L.PostalCode),
    "nothing": ([None, "", "NaN"], L.Unknown),
    "text": (["this is one of the many things that we all know", "what he said to them is not for you to say"], L.NaturalLanguage),
    "names": (["zed", "yan", "xu"], L.Unknown),
    "few": (["red", "blue"] * 10, L.Categorical),
}


@pytest.mark.parametrize("name", sorted(STRINGS))
def test_inference_of_strings(spark, name):
    values, kind = STRINGS[name]
    got = inference.infer(spark.createDataFrame([(v,) for v in values], "c string"))
    assert type(got["c"]) is kind


def test_inference_of_other_types(spark):
    df = spark.sql("select * from values (1, 1.0D, cast(1 as double), true, date'2020-01-01', interval '1' day, array(1)), (2, null, 2.5D, null, null, null, null) t(i, d, e, b, t, v, a)")
    assert {c: str(k) for c, k in inference.infer(df).items()} == {"i": "Integer", "d": "IntegerNullable", "e": "Double", "b": "BooleanNullable", "t": "Datetime", "v": "Timedelta", "a": "Unknown"}
    with config.with_options(numeric_categorical_threshold=0.5):
        assert type(inference.infer(spark.createDataFrame([(1,)] * 5, "i long"))["i"]) is L.Categorical
    assert inference.infer(df.select()) == {}


def test_inference_takes_custom_rules(spark):
    class Even(L.LogicalType):
        """Even numbers."""

        physical = T.LongType()

    system = TypeSystem()
    system.add_type(Even, lambda c, kind: F.every(c % 2 == 0) if isinstance(kind, T.LongType) else None, "Integer")
    assert type(inference.infer(spark.createDataFrame([(2,), (4,)], "x long"), system=system)["x"]) is Even
    with pytest.raises(ValueError):
        system.add_type(Even)
    system.remove_type("Even")
    assert type(inference.infer(spark.createDataFrame([(2,), (4,)], "x long"), system=system)["x"]) is L.Integer
    system.remove_type("Integer")
    assert system.parent(L.Age) is L.IntegerNullable
    system.reset_defaults()
    assert len(system.registered_types) == 26 and L.Age not in system.root_types
    system.update_relationship("Age", None)
    assert L.Age in system.root_types


def test_large_tables_are_sampled(spark):
    df = spark.range(120_000).select((F.col("id") % 2 == 0).alias("b"), F.col("id").cast("string").alias("s"))
    assert {c: str(k) for c, k in inference.infer(df).items()} == {"b": "Boolean", "s": "Integer"}


def test_tags(table):
    t = table.add_semantic_tags({"age": ["x", "y"]})
    assert t.semantic_tags["age"] == {"numeric", "custom", "x", "y"} and table.semantic_tags["age"] == {"numeric", "custom"}
    with pytest.warns(errors.DuplicateTagsWarning):
        t.add_semantic_tags({"age": "x"})
    with pytest.warns(errors.StandardTagsChangedWarning):
        assert t.remove_semantic_tags({"age": "numeric"}).semantic_tags["age"] == {"custom", "x", "y"}
    with pytest.raises(LookupError):
        t.remove_semantic_tags({"age": "none"})
    with pytest.raises(ValueError):
        t.add_semantic_tags({"age": "index"})
    assert t.reset_semantic_tags().semantic_tags["age"] == {"numeric"}
    assert t["age"].set_semantic_tags("z").semantic_tags["age"] == {"numeric", "z"}
    with pytest.raises(errors.ColumnNotPresentError):
        t.add_semantic_tags({"none": "x"})


def test_index_moves_and_checks(table):
    t = table.set_index("full_name")
    assert t.index == "full_name" and t.semantic_tags["id"] == {"numeric"}
    with pytest.raises(IndexError, match="not unique"):
        table.set_index("registered")
    with pytest.raises(IndexError, match="null"):
        table.set_index("email")
    with pytest.raises(ValueError):
        table.set_index("signup")
    with pytest.raises(TypeError):
        table.set_time_index("full_name")
    assert table.set_time_index("age").semantic_tags["age"] == {"numeric", "custom", "time_index"}
    assert table.set_index(None).index is None


def test_selection(table):
    assert table.select(include="numeric").columns == ["age"]
    assert table.select(include=["Datetime", L.Boolean]).columns == ["signup", "registered"]
    assert table.select(exclude=["numeric", "index"]).columns == ["full_name", "email", "phone", "signup", "registered"]
    assert table.select(include="nothing_of_this").columns == []
    assert isinstance(table.select(include="index", return_schema=True), TableSchema)
    for bad in (L.Integer(), 5):
        with pytest.raises(TypeError):
            table.select(include=bad)
    with pytest.raises(ValueError):
        table.select()


def test_columns(table):
    t = table.rename({"age": "phone", "phone": "age"})
    assert t.columns == ["id", "full_name", "email", "age", "phone", "signup", "registered"] and str(t.logical_types["phone"]) == "IntegerNullable"
    for bad in ({"age": "id"}, {"age": "x", "phone": "x"}, {"none": "x"}):
        with pytest.raises((ValueError, KeyError)):
            table.rename(bad)
    assert table.drop(["age", "phone"]).columns == ["id", "full_name", "email", "signup", "registered"]
    c, rest = table.pop("age")
    assert c.name == "age" and "age" not in rest and "age" in table
    t = table.with_column("half", F.col("age") / 2)
    assert str(t.logical_types["half"]) == "Double" and t.columns[-1] == "half"
    with pytest.raises(KeyError):
        table.with_column("id", F.lit(1))
    with pytest.warns(errors.IndexTagRemovedWarning):
        tagged = ColumnSchema("Integer", None, True)
        tagged.semantic_tags.add("index")
        assert table.with_column("n", F.lit(1).cast("long"), tagged).semantic_tags["n"] == {"numeric"}
    assert table.loc([1, 3]).df.count() == 2 and table.loc(F.col("age") > 32, ["age"]).columns == ["age"]
    assert table.iloc(2).id == 2 and [r.id for r in table.iloc(slice(1, 3), ["id"]).df.collect()] == [1, 2]
    with pytest.raises(IndexError):
        table.iloc(100)
    ids = lambda places: sorted(r.id for r in table.iloc(places).df.collect())
    for places in (slice(None), slice(-2, None), slice(None, None, 2), slice(5, 0, -2), slice(4, 100), slice(3, 1)):
        assert ids(places) == sorted(list(range(6))[places])
    assert ids([0, -1, 2]) == [0, 2, 5] and table.iloc(-1).id == 5
    assert table["age"].iloc(0) == 30 and table["age"].loc([1, 3]).df.count() == 2 and table["age"].iloc(slice(0, 2)).name == "age"
    assert table["age"].transform(lambda d: d.filter("age > 31")).logical_type == table["age"].logical_type
    assert isinstance(table.transform(lambda d: d.filter("age > 31")), TypedTable)
    with pytest.warns(errors.TypingInfoMismatchWarning):
        assert not isinstance(table.transform(lambda d: d.drop("age")), TypedTable)
    assert table.equals(table.filter("true"), deep=True) and not table.equals(table.filter("age > 31"), deep=True)


def test_full_schemas(people, table):
    assert TypedTable.init_with_full_schema(table.df, table.schema) == table
    with pytest.warns(errors.ParametersIgnoredWarning):
        TypedTable.init_with_full_schema(table.df, table.schema, index="id")
    assert not is_schema_valid(people.drop("age"), table.schema)
    assert "not unique" in invalid_schema_message(people.union(people), table.schema)
    partial = table.schema.subset(["id", "age"])
    assert TypedTable.init(people, schema=partial, logical_types={"age": None}).logical_types["age"] == L.IntegerNullable()
    with pytest.raises(errors.ColumnNotPresentError):
        TypedTable.init(people, index="none")
    with pytest.raises(errors.ColumnBothIgnoredAndSetError):
        TypedTable.init(people, ignore_columns=["age"], logical_types={"age": "Age"})
    assert str(TypedTable.init(people, ignore_columns=["age"]).logical_types["age"]) == "Unknown"


def values(spark, rows, kind, source="string", lenient=False):
    df = spark.createDataFrame([(r,) for r in rows], f"c {source}")
    return [r.c for r in TypedTable.init(df, logical_types={"c": kind}, null_invalid_values=lenient, validate=False).df.collect()]


def test_coercions(spark):
    assert values(spark, ["1", "NA", "12.0", "9007199254740993"], "IntegerNullable") == [1, None, 12, 9007199254740993]
    assert values(spark, ["1", "x", "1.5"], "IntegerNullable", lenient=True) == [1, None, None]
    assert values(spark, ["1.5", "nan", "", "x"], "Double", lenient=True) == [1.5, None, None, None]
    assert values(spark, [3, None, -2], "AgeNullable", "long", True) == [3, None, None]
    assert values(spark, ["Yes", "F", "1", "0.0", None, "x"], "BooleanNullable", lenient=True) == [True, False, True, False, None, None]
    assert values(spark, [None, "y"], L.Boolean(cast_nulls_as=False)) == [False, True]
    assert values(spark, [12345.0, float("nan"), 1234567890.0], "PostalCode", "double", True) == ["12345", None, None]
    assert values(spark, ["a@b.com", "x", None], "EmailAddress", lenient=True) == ["a@b.com", None, None]
    assert values(spark, ["(1, 2)", "[3,nan]", "5, 6", None, "none"], "LatLong") == [(1.0, 2.0), (3.0, None), (5.0, 6.0), None, None]
    assert values(spark, [["1", "2"], ["x"]], "LatLong", "array<string>", True) == [(1.0, 2.0), None]
    assert values(spark, ["a", "z"], L.Ordinal(["b", "a"]), lenient=True) == ["a", None]
    for rows, kind in ((["x"], "Integer"), ([None], "Integer"), (["maybe"], "Boolean"), (["1,2,3"], "LatLong"), (["1.5"], "IntegerNullable")):
        with pytest.raises(Exception):
            values(spark, rows, kind)


def test_datetimes(spark):
    assert values(spark, ["2020-01-02", "2020-03-04"], "Datetime") == [dt.datetime(2020, 1, 2), dt.datetime(2020, 3, 4)]
    assert values(spark, ["31.12.2020", "1.2.2020"], "Datetime") == [dt.datetime(2020, 12, 31), dt.datetime(2020, 2, 1)]
    assert values(spark, ["2020-01-02 03:04:05-0500"], "Datetime") == [dt.datetime(2020, 1, 2, 8, 4, 5)]
    assert values(spark, ["2020-01-02", "never"], L.Datetime("%Y-%m-%d")) == [dt.datetime(2020, 1, 2), None]
    assert values(spark, ["01/02/69", "01/02/20"], L.Datetime("%m/%d/%y")) == [dt.datetime(1969, 1, 2), dt.datetime(2020, 1, 2)]
    assert datetimes.infer_format(spark.createDataFrame([("2020~01~02",)], "c string"), "c") is None
    with pytest.raises(ValueError):
        datetimes.spark_pattern("%Q")
    for f in datetimes.ladder():
        t = dt.datetime(2011, 12, 13, 14, 15, 16, 170000, dt.timezone.utc)
        df = spark.createDataFrame([(t.strftime(f),)], "c string")
        assert datetimes.parses(t.strftime(f), f)
        break
    df = spark.createDataFrame([tuple(t.strftime(f) for f in datetimes.ladder())], ", ".join(f"c{i} string" for i in range(len(datetimes.ladder()))))
    row = df.select(*(datetimes.parsed(F.col(f"c{i}"), f).alias(f"c{i}") for i, f in enumerate(datetimes.ladder()))).first()
    for f, got in zip(datetimes.ladder(), row):
        assert got == dt.datetime.strptime(t.strftime(f), f).replace(tzinfo=None), f


def test_validation(spark):
    df = spark.createDataFrame([(1, "http://a.com", 5), (2, "bad", -1), (3, None, None)], "k long, u string, a long")
    t = TypedTable.init(df, index="k", logical_types={"u": "URL", "a": "AgeNullable"}, validate=False)
    with pytest.raises(errors.TypeValidationError, match="'u' has 1"):
        t.validate_logical_types()
    assert [tuple(r) for r in t.validate_logical_types(True).collect()] == [(2, "bad", -1)]
    assert t["a"].validate_logical_type(True).count() == 1
    with pytest.raises(errors.TypeValidationError):
        TypedTable(df, TableSchema({"k": ColumnSchema("Double"), "u": ColumnSchema("URL"), "a": ColumnSchema("Age")})).validate_logical_types()
    with pytest.raises(ValueError):
        L.Ordinal([1, 1])
    with pytest.raises(TypeError):
        TypedTable.init(df, logical_types={"u": "Ordinal"})


def test_set_types(table):
    t = table.set_types({"age": "Double", "full_name": None}, {"phone": "contact"})
    assert dict(t.df.dtypes)["age"] == "double" and t.semantic_tags["age"] == {"numeric"} and t.semantic_tags["phone"] == {"contact"}
    assert str(t.logical_types["full_name"]) == "Unknown"
    assert table["age"].set_logical_type("Categorical").semantic_tags["age"] == {"category"}
    assert table.set_types({"id": "Double"}).semantic_tags["id"] == {"index"}
    assert typed_series(table.df, "age", "IntegerNullable").semantic_tags == {"numeric"}
    with pytest.raises(errors.TypeValidationError):
        typed_series(table.df, "age", "Double")
    c = init_series(table.df, "age", "Double", "extra")
    assert c.semantic_tags == {"numeric", "extra"} and c.nullable


def test_concat(table, spark):
    a, b = table[["id", "age"]], table[["id", "registered", "email"]].filter("id <> 1")
    out = concat_columns([a, b])
    assert out.columns == ["id", "age", "registered", "email"] and out.df.count() == 6
    assert str(out.logical_types["registered"]) == "BooleanNullable"
    assert concat_columns([a, table["phone"]]).columns == ["id", "age", "phone"]
    for bad in ([], [a, a], [a, table.set_index("full_name")[["full_name", "phone"]]], [a, table.set_index(None)[["phone"]]]):
        with pytest.raises(ValueError):
            concat_columns(bad)


@pytest.mark.parametrize("kind", ["csv", "parquet", "orc", "arrow", "feather"])
def test_files_come_back(spark, tmp_path, kind):
    df = spark.sql("select * from values (1, ' a\\nb \"q\" ', true, 1.5D, timestamp_ntz'2020-01-02 03:04:05.5', named_struct('latitude', 1D, 'longitude', null), interval '1 02:03:04.5' day to second), (2, null, null, null, null, null, null) t(k, s, b, d, t, p, v)")
    kinds = {"k": "Integer", "s": "Unknown", "b": "BooleanNullable", "d": "Double", "t": "Datetime", "p": "LatLong", "v": "Timedelta"}
    if kind in ("orc", "csv"):
        df = df.drop("v") if kind == "orc" else df
    t = TypedTable.init(df, "t", "k", logical_types={c: k for c, k in kinds.items() if c in df.columns}, semantic_tags={"s": "x"}, table_metadata={"a": [1]}, column_descriptions={"s": "text"})
    t.to_disk(f"file://{tmp_path}/x", format=kind)
    back = files.read_table(spark, f"file://{tmp_path}/x", validate=True)
    assert back.equals(t, deep=True)
    with pytest.raises(errors.FileExistsInPathError):
        t.to_disk(f"file://{tmp_path}/x", format=kind)


def test_reading_plain_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v,d\n1,NA,2020-01-01\n2,x,2020-01-02\n")
    t = files.read_file(spark, f"file://{tmp_path}/a.csv", index="k", replace_nan=True)
    assert [str(k) for k in t.logical_types.values()] == ["Integer", "Unknown", "Datetime(datetime_format='%Y-%m-%d')"] and t.df.where("v is null").count() == 1
    for bad in (f"{tmp_path}/a", f"{tmp_path}/a.xyz"):
        with pytest.raises(RuntimeError):
            files.read_file(spark, bad)
    with pytest.raises(ValueError):
        t.to_disk(f"{tmp_path}/y", format="pickle")
    with pytest.raises(ValueError):
        t.to_disk("http://a.com/x")
    with pytest.raises(TypeError):
        TypedTable(t.df, TableSchema(t.schema.columns, None, {"a": object()})).to_disk(f"{tmp_path}/z")
    with pytest.warns(errors.UpgradeSchemaWarning):
        files._check_version("99.0.0")
    with pytest.warns(errors.OutdatedSchemaWarning):
        files._check_version("0.9.0")


def test_catalogues(spark):
    rows = {r.name: r for r in list_logical_types(spark).collect()}
    assert len(rows) == 26 and rows["Age"].parent_type == "Integer" and rows["Unknown"].is_default_type and rows["URL"].type_string == "url" and rows["IPAddress"].type_string == "ip_address"
    assert {r.name for r in list_semantic_tags(spark).collect() if r.is_standard} == {"numeric", "category"}


def test_config():
    c = Config(OPTIONS)
    with c.with_options(categorical_threshold=0.5):
        assert c.get_option("categorical_threshold") == 0.5
    assert c.get_option("categorical_threshold") == 0.2
    c.set_option("categorical_threshold", 1)
    c.reset_option("categorical_threshold")
    assert c.get_option("categorical_threshold") == 0.2
    with pytest.raises(KeyError):
        c.get_option("none")
    with pytest.raises(KeyError):
        c.set_option("none", 1)
    for name, value in (("categorical_threshold", 2), ("inference_sample_rows", 0), ("null_strings", "NA"), ("url_inference_regex", 5)):
        with pytest.raises(ValueError):
            c.set_option(name, value)
    with c.with_options(null_strings=["-"]):
        c.get_option("null_strings").append("x")
        c.set_option("null_strings", ["--"])
        with c.with_options(categorical_threshold=None):
            assert c.get_option("null_strings") == ["--"] and c.get_option("categorical_threshold") is None
    assert "NA" in c.get_option("null_strings")
    with pytest.raises(RuntimeError), c.with_options(categorical_threshold=0.9):
        raise RuntimeError
    assert c.get_option("categorical_threshold") == 0.2


def test_ipv6_addresses():
    import ipaddress
    import random
    import re

    rng, pattern = random.Random(1), re.compile(config.get_option("ipv6_inference_regex"))
    texts = ["::", "fe80::1%eth0", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5::1.2.3.4", "1:2:3:4:5:6::1.2.3.4", "1::2::3", "::12345", "g::1", "1.2.3.4", ":1", "1:", "::1.2.3.256", "::%", ""]
    for _ in range(20000):
        parts = [rng.choice(["", "1", "ab", "ffff"]) if rng.random() < 0.35 else rng.choice(["1", "abcd", "0"]) for _ in range(rng.randint(1, 9))]
        texts.append(":".join(parts) + (rng.choice([":1.2.3.4", ".1"]) if rng.random() < 0.2 else ""))
    for t in texts:
        try:
            valid = bool(ipaddress.IPv6Address(t))
        except ValueError:
            valid = False
        assert bool(pattern.match(t)) == valid, t


def test_odd_names_and_empty_tables(spark):
    t = TypedTable.init(spark.createDataFrame([(1, "x")], "`a.b` long, `c d` string"))
    assert t.select(include="numeric").columns == ["a.b"] and t.describe().count() == 2
    empty = TypedTable.init(spark.createDataFrame([], "a long, b string"))
    assert {str(k) for k in empty.logical_types.values()} == {"Unknown"}
