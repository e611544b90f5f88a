"""More registered queries: operations on typed tables and columns, types and their inference, frequencies, and files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import config
from .functions import logical_types as L
from .operators import dependence as depend
from .operators import frequency, outliers
from .operators.table import TypedTable, concat_columns, init_series, is_schema_valid, typed_series
from .plans import inference
from .plans.registry import OfValues, TypeSystem
from .queries import INFERRED, ORACLE_SQL, _table, _typed, query
from .scratch import fresh_path
from .sources import arrow_source, files


def _rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# -- inference, by its rules in SQL ------------------------------------------------------------------------------------

_URL = r"^(?:(http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+))"


def _rule(c: str) -> str:
    """SQL for the type that inference gives a column, by the type that holds it and, for strings, by their values."""
    from .plans.words import COMMON

    words = "[" + ", ".join(f"'{w}'" for w in sorted(COMMON)) + "]"
    common = rf"avg(len(list_filter(string_split_regex(lower({c}::VARCHAR), '[- \[\].,!\?;\n]'), lambda x: list_contains({words}, x))))"
    text = rf"""CASE WHEN bool_and(regexp_matches({c}::VARCHAR, '^\d{{4}}-\d\d-\d\d( \d\d:\d\d:\d\d)?$')) THEN 'Datetime'
        WHEN bool_and(regexp_matches({c}::VARCHAR, '^[+-]?\d+$')) THEN CASE WHEN count(*) > count({c}) THEN 'IntegerNullable' ELSE 'Integer' END
        WHEN bool_and(regexp_matches({c}::VARCHAR, '^[+-]?\d*\.?\d+(E-?\d+)?$')) THEN 'Double'
        WHEN bool_and(regexp_matches({c}::VARCHAR, '^[^@ ]+@[^@ ]+\.[a-z]+$')) THEN 'EmailAddress'
        WHEN bool_and(regexp_matches({c}::VARCHAR, '{_URL}')) THEN 'URL'
        WHEN count(DISTINCT lower({c}::VARCHAR)) = 2 AND bool_and(lower({c}::VARCHAR) IN ('yes', 'no')) THEN CASE WHEN count(*) > count({c}) THEN 'BooleanNullable' ELSE 'Boolean' END
        WHEN count(DISTINCT {c}) <= 0.2 * count({c}) THEN 'Categorical' WHEN {common} > 1.14 THEN 'NaturalLanguage' ELSE 'Unknown' END"""
    return f"""CASE any_value(typeof({c})) WHEN 'BIGINT' THEN CASE WHEN count(*) > count({c}) THEN 'IntegerNullable' ELSE 'Integer' END WHEN 'INTEGER' THEN 'Integer' WHEN 'DOUBLE' THEN 'Double'
        WHEN 'TIMESTAMP' THEN 'Datetime' WHEN 'INTERVAL' THEN 'Timedelta' WHEN 'BOOLEAN' THEN CASE WHEN count(*) > count({c}) THEN 'BooleanNullable' ELSE 'Boolean' END ELSE {text} END"""


ORACLE_SQL["infer_types"] = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {_rule(c)} AS logical_type FROM {t}" for t, cs in INFERRED.items() for c in cs)
ORACLE_SQL["infer_types_of_text"] = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_rule(c)} AS logical_type FROM (SELECT {c}::VARCHAR AS {c} FROM orders)" for c in ("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus"))

_MADE = {
    "whole": ("CASE WHEN c_custkey % 9 > 0 THEN c_custkey END", lambda k: F.when(k % 9 > 0, k)),
    "whole_text": ("CASE WHEN c_custkey % 9 > 0 THEN c_custkey::VARCHAR END", lambda k: F.when(k % 9 > 0, k.cast("string"))),
    "real_text": ("c_acctbal::VARCHAR", lambda k: F.col("c_acctbal").cast("decimal(20,2)").cast("string")),
    "email": ("lower(c_mktsegment) || c_custkey || '@example.com'", lambda k: F.concat(F.lower("c_mktsegment"), k, F.lit("@example.com"))),
    "answer": ("CASE WHEN c_custkey % 3 = 0 THEN 'Yes' ELSE 'no' END", lambda k: F.when(k % 3 == 0, "Yes").otherwise("no")),
    "answer_or_none": ("CASE c_custkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' END", lambda k: F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "no")),
    "flag": ("c_custkey % 2 = 0", lambda k: k % 2 == 0),
    "flag_or_none": ("CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 2 = 0 END", lambda k: F.when(k % 5 > 0, k % 2 == 0)),
    "length": ("to_days(c_custkey::INTEGER)", lambda k: F.make_dt_interval(days=k.cast("int"))),
    "phrase": ("'this is for the ' || c_name || ' and for all of us'", lambda k: F.concat(F.lit("this is for the "), F.col("c_name"), F.lit(" and for all of us"))),
    "segment": ("c_mktsegment", lambda k: F.col("c_mktsegment")),
    "name": ("c_name", lambda k: F.col("c_name")),
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS \"column\", {_rule(n)} AS logical_type FROM (SELECT {e} AS {n} FROM customer)" for n, (e, _) in _MADE.items()))
def infer_types_of_made_columns(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").select(*(f(F.col("c_custkey")).alias(n) for n, (_, f) in _MADE.items()))
    return _rows(spark, [(c, type(k).__name__) for c, k in inference.infer(df).items()], "column string, logical_type string")


@query(
    r"""SELECT 'phone' AS "column", CASE WHEN bool_and(regexp_matches(x, '^\(?[2-9]\d\d\)?[-. ]?[2-9]\d\d[-. ]?\d{4}$')) THEN 'PhoneNumber' ELSE 'Unknown' END AS logical_type FROM (SELECT '(5' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || ') 555-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS x FROM customer)
    UNION ALL SELECT 'postal', CASE WHEN bool_and(regexp_matches(x, '^\d{5}-\d{4}$')) THEN 'PostalCode' ELSE 'Unknown' END FROM (SELECT lpad((c_custkey % 100000)::VARCHAR, 5, '0') || '-' || lpad((c_custkey % 9973)::VARCHAR, 4, '0') AS x FROM customer)
    UNION ALL SELECT 'ipv4', CASE WHEN bool_and(regexp_matches(x, '^(\d{1,3}\.){3}\d{1,3}$')) THEN 'IPAddress' ELSE 'Unknown' END FROM (SELECT '10.' || c_custkey % 250 || '.' || c_custkey // 250 % 250 || '.' || c_nationkey AS x FROM customer)
    UNION ALL SELECT 'ipv6', CASE WHEN bool_and(regexp_matches(x, '^2001:db8::[0-9a-f]+:[0-9a-f]+$')) THEN 'IPAddress' ELSE 'Unknown' END FROM (SELECT '2001:db8::' || lower(to_hex(c_nationkey)) || ':' || lower(to_hex(c_custkey % 65536)) AS x FROM customer)"""
)
def infer_types_by_patterns(spark, sf_dir):
    k = F.col("c_custkey")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    df = _table(spark, sf_dir, "customer").select(
        F.concat(F.lit("(5"), pad(k % 100, 2), F.lit(") 555-"), pad(k % 10000, 4)).alias("phone"),
        F.concat(pad(k % 100000, 5), F.lit("-"), pad(k % 9973, 4)).alias("postal"),
        F.concat(F.lit("10."), k % 250, F.lit("."), F.floor(k / 250) % 250, F.lit("."), F.col("c_nationkey")).alias("ipv4"),
        F.concat(F.lit("2001:db8::"), F.lower(F.hex("c_nationkey")), F.lit(":"), F.lower(F.hex(k % 65536))).alias("ipv6"),
    )
    return _rows(spark, [(c, type(x).__name__) for c, x in inference.infer(df).items()], "column string, logical_type string")


class EvenNumber(L.IntegerNullable):
    """Whole numbers that 2 divides."""


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CASE WHEN bool_and({e} % 2 = 0) THEN 'EvenNumber' ELSE 'Integer' END AS logical_type FROM customer" for c, e in (("doubled", "c_custkey * 2"), ("plain", "c_custkey"))))
def infer_custom_type(spark, sf_dir):
    system = TypeSystem()
    system.add_type(EvenNumber, lambda c, kind: F.every(c % 2 == 0) if isinstance(kind, L.WHOLE) else None, parent="Integer")
    df = _table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("doubled"), F.col("c_custkey").alias("plain"))
    return _rows(spark, [(c, type(k).__name__) for c, k in inference.infer(df, system=system).items()], "column string, logical_type string")


# -- tables and columns ------------------------------------------------------------------------------------------------

LINES = {"l_orderkey": "Integer", "l_linenumber": "Integer", "l_quantity": "Double", "l_discount": "Double", "l_returnflag": "Categorical"}


@query("SELECT l_linenumber AS line, l_quantity, l_quantity / 2 AS half FROM lineitem WHERE l_discount > 0.05")
def column_edits(spark, sf_dir):
    t = _typed(spark, sf_dir, "lineitem", LINES)
    t = t.with_column("half", F.col("l_quantity") / 2).filter("l_discount > 0.05")
    _, t = t.drop("l_orderkey").pop("l_discount")
    return t[["l_linenumber", "l_quantity", "half"]].rename({"l_linenumber": "line"}).df


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag")
def table_transform(spark, sf_dir):
    t = _typed(spark, sf_dir, "lineitem", LINES).transform(lambda d: d.where("l_quantity > 25"))
    return t["l_returnflag"].transform(lambda d: d.where("l_returnflag is not null")).df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


_TAGS = """SELECT column_name AS "column", CASE WHEN column_name = 'l_orderkey' THEN 'index' WHEN column_name = 'l_quantity' THEN 'amount,numeric' WHEN column_name = 'l_discount' THEN 'rate'
    WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' WHEN column_type = 'VARCHAR' THEN 'category' ELSE '' END AS tags FROM (DESCRIBE SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag FROM lineitem)"""


@query(_TAGS)
def tag_edits(spark, sf_dir):
    t = _typed(spark, sf_dir, "lineitem", LINES).set_index("l_orderkey", validate=False)
    t = t.add_semantic_tags({"l_quantity": "amount", "l_linenumber": ["a", "b"], "l_discount": "x"}).remove_semantic_tags({"l_linenumber": "a", "l_discount": ["x", "numeric"]})
    t = t["l_linenumber"].reset_semantic_tags().add_semantic_tags({"l_discount": "rate"})
    return _rows(spark, [(c, ",".join(sorted(tags))) for c, tags in t.semantic_tags.items()], "column string, tags string")


@query("""SELECT column_name AS "column", CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE 'string' END AS physical_type,
    CASE column_type WHEN 'BIGINT' THEN 'Integer' WHEN 'DOUBLE' THEN 'Double' WHEN 'TIMESTAMP' THEN 'Datetime' ELSE 'Categorical' END AS logical_type FROM (DESCRIBE orders)""")
def typing_information(spark, sf_dir):
    info = _typed(spark, sf_dir, "orders", INFERRED["orders"], index="o_orderkey").typing_info()
    return _rows(spark, [(c["name"], c["physical_type"]["type"], L_name(c["logical_type"]["type"])) for c in info["column_typing_info"]], "column string, physical_type string, logical_type string")


def L_name(type_string: str) -> str:
    """The class name of a type string."""
    from .plans.registry import type_system

    return type_system.str_to_logical_type(type_string).__name__


@query("SELECT count(*)::BIGINT AS rows, (SELECT count(*) FROM (DESCRIBE orders))::BIGINT AS columns, 'o_orderkey' AS index, 'o_orderdate' AS time_index, 'orders' AS name FROM orders")
def table_properties(spark, sf_dir):
    t = files.load_orders(spark, sf_dir)
    return _rows(spark, [(len(t), len(t.columns), t.index, t.time_index, t.name)], "rows long, columns long, index string, time_index string, name string")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def loaded_orders(spark, sf_dir):
    return files.load_orders(spark, sf_dir).filter("o_orderdate >= timestamp_ntz'1996-01-01'")[["o_orderkey", "o_orderstatus", "o_totalprice"]].df


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM (SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25)")
def sorted_at_init(spark, sf_dir):
    t = _typed(spark, sf_dir, "orders", {"o_orderkey": "Integer", "o_orderdate": "Datetime"}, index="o_orderkey", time_index="o_orderdate")
    return t.df.limit(25).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM p WHERE i >= n - 40 AND (i - (n - 40)) % 3 = 0 UNION ALL SELECT o_orderkey FROM p WHERE i IN (0, 7, n - 1)")
def rows_by_place(spark, sf_dir):
    t = _typed(spark, sf_dir, "orders", {"o_orderkey": "Integer"}, index="o_orderkey")
    return t.iloc(slice(-40, None, 3)).df.unionByName(t.iloc([0, 7, -1]).df)


@query("""SELECT count(*) = count(DISTINCT o_orderkey) AS by_key, count(*) = count(DISTINCT o_custkey) AS by_customer, (SELECT count(*) FROM (SELECT * FROM orders EXCEPT ALL SELECT * FROM orders)) = 0 AS same,
    (SELECT count(*) FROM (SELECT * FROM orders EXCEPT ALL SELECT * FROM orders WHERE o_orderstatus <> 'P')) = 0 AS same_without_p FROM orders""")
def schema_checks(spark, sf_dir):
    t = _typed(spark, sf_dir, "orders", INFERRED["orders"], index="o_orderkey")
    by_customer = t.set_index("o_custkey", validate=False).schema
    back = TypedTable.init_with_full_schema(t.df.repartition(5), t.schema)
    row = (is_schema_valid(t.df, t.schema), is_schema_valid(t.df, by_customer), t.equals(back, deep=True), t.equals(t.filter("o_orderstatus <> 'P'"), deep=True))
    return _rows(spark, [row], "by_key boolean, by_customer boolean, same boolean, same_without_p boolean")


@query("SELECT 'init' AS how, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders UNION ALL SELECT 'typed', round(sum(s_acctbal), 2), count(*) FROM supplier")
def column_init(spark, sf_dir):
    text = _table(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("string").alias("v"))
    made, as_is = init_series(text, "v", "Double"), typed_series(_table(spark, sf_dir, "supplier"), "s_acctbal", "Double")
    total = lambda c, how: c.df.agg(F.lit(how).alias("how"), F.round(F.sum(c.name), 2).alias("total"), F.count(F.lit(1)).alias("n"))
    return total(made, "init").unionByName(total(as_is, "typed"))


@query(r"SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey::VARCHAR ELSE lpad((s_suppkey % 100000)::VARCHAR, 5, '0') END AS code FROM supplier WHERE s_suppkey % 4 = 0 AND NOT regexp_matches(s_suppkey::VARCHAR, '^[0-9]{5}(?:-[0-9]{4})?$')")
def validate_column(spark, sf_dir):
    k = F.col("s_suppkey")
    df = _table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 4 == 0, k.cast("string")).otherwise(F.lpad((k % 100000).cast("string"), 5, "0")).alias("code"))
    t = TypedTable.init(df, index="s_suppkey", logical_types={"code": "PostalCode"}, validate=False)
    return t.validate_logical_types(return_invalid_values=True)


@query("""SELECT c_custkey, c_custkey::VARCHAR AS code, c_name AS name, 'x/' || c_name AS path, c_mktsegment AS country, c_nationkey::VARCHAR AS sub, c_acctbal AS fraction, (c_custkey % 90)::BIGINT AS age, c_custkey::BIGINT AS days,
    c_custkey % 2 = 1 AS flag, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 2 = 0 ELSE false END AS filled FROM customer""")
def coerced_to_every_kind(spark, sf_dir):
    k = F.col("c_custkey")
    df = _table(spark, sf_dir, "customer").select(
        "c_custkey", k.alias("code"), F.col("c_name").alias("name"), F.concat(F.lit("x/"), F.col("c_name")).alias("path"), F.col("c_mktsegment").alias("country"), F.col("c_nationkey").alias("sub"),
        F.col("c_acctbal").cast("decimal(20,2)").cast("string").alias("fraction"), (k % 90).cast("string").alias("age"), F.make_dt_interval(days=k.cast("int")).alias("days"),
        (k % 2).cast("double").alias("flag"), F.when(k % 3 > 0, F.when(k % 2 == 0, "t").otherwise("F")).alias("filled"),
    )
    kinds = {"c_custkey": "Integer", "code": "Categorical", "name": "PersonFullName", "path": "Filepath", "country": "CountryCode", "sub": "SubRegionCode", "fraction": "Double", "age": "Age", "days": "Timedelta", "flag": "Boolean", "filled": L.Boolean(cast_nulls_as=False)}
    t = TypedTable.init(df, logical_types=kinds)
    return t.df.withColumns({"code": F.col("code").cast("string"), "sub": F.col("sub").cast("string"), "days": F.expr("cast(extract(day from days) as bigint)")})


@query("SELECT c_custkey, c_acctbal >= 0 AS valid FROM customer")
def fractional_ages(spark, sf_dir):
    t = _typed(spark, sf_dir, "customer", {"c_custkey": "Integer", "c_acctbal": "AgeFractional"})
    bad = t.logical_types["c_acctbal"].invalid(F.col("c_acctbal"))
    return t.df.select("c_custkey", (~bad).alias("valid"))


_GUARDS = {
    "negative ages": ("customer", "min(c_acctbal) < 0"),
    "repeated index": ("orders", "count(*) > count(DISTINCT o_custkey)"),
    "unique index": ("orders", "count(*) > count(DISTINCT o_orderkey)"),
    "beyond the order": ("orders", "count_if(o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) > 0"),
    "within the order": ("orders", "count_if(o_orderstatus NOT IN ('F', 'O', 'P')) > 0"),
    "no booleans": ("customer", "count_if(c_mktsegment NOT IN ('yes', 'no')) > 0"),
    "nulls in whole numbers": ("lineitem", "count_if(l_discount = 0) > 0"),
    "parts of whole numbers": ("lineitem", "count_if(l_tax <> floor(l_tax)) > 0"),
    "no coordinates": ("supplier", "count_if(s_name NOT LIKE '(%') > 0"),
    "no email": ("supplier", "count_if(s_name NOT LIKE '%@%') > 0"),
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS guard, {e} AS raised FROM {t}" for k, (t, e) in _GUARDS.items()))
def guards(spark, sf_dir):
    """Which changes are refused: each raises exactly where the data has what it forbids."""
    from pyspark.errors import PySparkException

    from .errors import TypeConversionError, TypeValidationError

    read = lambda t, *c: _table(spark, sf_dir, t).select(*c)
    typed = lambda df, k: TypedTable.init(df, logical_types={df.columns[0]: k}).df.write.format("noop").mode("overwrite").save()
    orders = TypedTable.init(read("orders", "o_orderkey", "o_custkey"), logical_types={"o_orderkey": "Integer", "o_custkey": "Integer"})
    tried = {
        "negative ages": lambda: typed(read("customer", "c_acctbal"), "AgeFractional"),
        "repeated index": lambda: orders.set_index("o_custkey"),
        "unique index": lambda: orders.set_index("o_orderkey"),
        "beyond the order": lambda: typed(read("orders", "o_orderpriority"), L.Ordinal(["1-URGENT", "2-HIGH", "3-MEDIUM"])),
        "within the order": lambda: typed(read("orders", "o_orderstatus"), L.Ordinal(["F", "O", "P"])),
        "no booleans": lambda: typed(read("customer", "c_mktsegment"), "Boolean"),
        "nulls in whole numbers": lambda: typed(read("lineitem", F.nullif("l_discount", F.lit(0.0)).alias("x")).select((F.col("x") * 100).cast("int").alias("x")), "Integer"),
        "parts of whole numbers": lambda: typed(read("lineitem", "l_tax"), "IntegerNullable"),
        "no coordinates": lambda: typed(read("supplier", "s_name"), "LatLong"),
        "no email": lambda: typed(read("supplier", "s_name"), "EmailAddress"),
    }
    rows = []
    for name, do in tried.items():
        try:
            do()
            rows.append((name, False))
        except (PySparkException, TypeConversionError, TypeValidationError, IndexError):
            rows.append((name, True))
    return _rows(spark, rows, "guard string, raised boolean")


@query("SELECT column_name AS \"column\", CASE WHEN column_type IN ('BIGINT', 'DOUBLE') THEN true ELSE false END AS is_numeric, column_name IN ('o_orderstatus', 'o_orderpriority') AS is_categorical, column_type = 'TIMESTAMP' AS is_datetime, column_name = 'o_orderkey' AS is_index FROM (DESCRIBE orders)")
def column_kinds(spark, sf_dir):
    t = _typed(spark, sf_dir, "orders", INFERRED["orders"], index="o_orderkey")
    return _rows(spark, [(c, s.is_numeric or c == t.index, s.is_categorical, s.is_datetime, c == t.index) for c, s in t.schema.columns.items()], "column string, is_numeric boolean, is_categorical boolean, is_datetime boolean, is_index boolean")


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM (SELECT * FROM customer WHERE c_acctbal > 0) GROUP BY ALL")
def typed_rows_by_sql(spark, sf_dir):
    """A typed table's rows are a DataFrame like any other."""
    _typed(spark, sf_dir, "customer", {"c_nationkey": "Integer", "c_mktsegment": "Categorical", "c_acctbal": "Double"}).filter("c_acctbal > 0").df.createOrReplaceTempView("typed_customers")
    return spark.sql("SELECT cast(c_nationkey AS int) AS c_nationkey, c_mktsegment, count(*) AS n FROM typed_customers GROUP BY ALL")


# -- statistics --------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS count, count_if(o_orderstatus = 'F') AS num_true, count_if(o_orderstatus <> 'F') AS num_false, count_if(o_orderstatus = 'F') > count_if(o_orderstatus <> 'F') AS mode FROM orders")
def describe_boolean(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").alias("flag"))
    d = TypedTable.init(df).describe_dict()["flag"]
    return _rows(spark, [(d["count"], d["num_true"], d["num_false"], d["mode"])], "count long, num_true long, num_false long, mode boolean")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c})::VARCHAR AS count, (count(*) - count({c}))::VARCHAR AS nan_count, (SELECT v FROM (SELECT {c}::VARCHAR AS v, {c} AS x, count(*) AS n FROM part GROUP BY 1, 2) ORDER BY n DESC, x LIMIT 1) AS mode FROM part" for c in ("p_name", "p_brand", "p_type", "p_size")))
def describe_frame(spark, sf_dir):
    kinds = {"p_name": "Unknown", "p_brand": "Categorical", "p_type": "Categorical", "p_size": "Integer"}
    return _typed(spark, sf_dir, "part", kinds).describe().select("column", "count", "nan_count", "mode")


@query("""WITH b AS (SELECT min(s_acctbal) AS a, max(s_acctbal) AS z FROM supplier), e AS (SELECT i, CASE WHEN i = 10 THEN z WHEN i = 0 THEN a - 0.001 * (z - a) ELSE a + i * (z - a) / 10 END AS edge FROM b, range(0, 11) r(i))
    SELECT x.i::INTEGER AS bin, round(x.edge, 3) AS low, round(y.edge, 3) AS high, (SELECT count(*) FROM supplier WHERE s_acctbal > x.edge AND s_acctbal <= y.edge) AS frequency FROM e x JOIN e y ON y.i = x.i + 1""")
def histogram_edges(spark, sf_dir):
    from .operators import counts

    return counts.histogram(_table(spark, sf_dir, "supplier"), "s_acctbal", 10)


@query("SELECT 'o_custkey' AS column_1, 'o_totalprice' AS column_2, round(corr(o_custkey, o_totalprice), 6) AS pearson FROM orders")
def dependence_default(spark, sf_dir):
    """A table with index and time index, both of which are left out unless they are asked for."""
    t = _typed(spark, sf_dir, "orders", {"o_orderkey": "Integer", "o_custkey": "Integer", "o_totalprice": "Double", "o_orderdate": "Datetime"}, index="o_orderkey", time_index="o_orderdate", already_sorted=True)
    return t.pearson_correlation().select("column_1", "column_2", F.round("pearson", 6).alias("pearson"))


@query("SELECT least(count(*), 700)::BIGINT AS shared_rows FROM lineitem")
def dependence_of_a_sample(spark, sf_dir):
    t = _typed(spark, sf_dir, "lineitem", {"l_quantity": "Double", "l_extendedprice": "Double"})
    return t.pearson_correlation(nrows=700, extra_stats=True).select("shared_rows")


@query("""SELECT column_name AS "column" FROM (DESCRIBE orders) WHERE column_type IN ('BIGINT', 'DOUBLE', 'TIMESTAMP') AND column_name <> 'o_orderkey' OR column_name IN ('o_orderstatus', 'o_orderpriority')""")
def mutual_info_columns(spark, sf_dir):
    t = _typed(spark, sf_dir, "orders", INFERRED["orders"], index="o_orderkey")
    return _rows(spark, [(c,) for c in depend.valid_mi_columns(t)], "column string")


@query("SELECT (count(*) - 1)::BIGINT AS steps, (count(*) - 1)::BIGINT AS results, true AS in_order FROM (DESCRIBE orders)")
def progress_calls(spark, sf_dir):
    seen, results = [], []
    _typed(spark, sf_dir, "orders", INFERRED["orders"], index="o_orderkey").describe_dict(callback=lambda *a: seen.append(a), results_callback=lambda all_, new: results.append(new))
    in_order = [a[1] for a in seen] == list(range(1, len(seen) + 1)) and all(a[2] == len(seen) and a[4] >= 0 for a in seen)
    return _rows(spark, [(len(seen), len(results), in_order)], "steps long, results long, in_order boolean")


@query("SELECT count_if(c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS count, count_if(c_mktsegment IN ('BUILDING', 'MACHINERY')) AS nan_count FROM customer")
def options_in_a_scope(spark, sf_dir):
    with config.with_options(null_strings=["BUILDING", "MACHINERY"]):
        df = _table(spark, sf_dir, "customer").select(L.clean(F.col("c_mktsegment"), L.T.StringType()).alias("v"))
    return df.agg(F.count("v").alias("count"), F.count_if(F.col("v").isNull()).alias("nan_count"))


_EVENT_BOUNDS = "SELECT round(greatest(min(value), q1 - 1.5 * (q3 - q1)), 5) AS low, round(least(max(value), q3 + 1.5 * (q3 - q1)), 5) AS high FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) GROUP BY q1, q3"


@query(f"SELECT CASE WHEN value < low THEN 'low' ELSE 'high' END AS side, event_id AS index, value FROM events, ({_EVENT_BOUNDS}) WHERE value < low OR value > high")
def outlier_lists(spark, sf_dir):
    """Outliers as box_plot_dict lists them, with quantiles that the caller gives."""
    t = _typed(spark, sf_dir, "events", {"event_id": "Integer", "value": "Double"}, index="event_id")
    from .operators.quantiles import quantiles

    given = dict(zip(outliers.QUARTILES, quantiles(t.df, ["value"], outliers.QUARTILES)["value"], strict=True))
    b = t["value"].box_plot_dict(quantiles=given)
    return _rows(spark, [(side, i, v) for side in ("low", "high") for i, v in zip(b[f"{side}_indices"], b[f"{side}_values"], strict=True)], "side string, index long, value double")


# -- frequencies -------------------------------------------------------------------------------------------------------


@query(
    """WITH h AS (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM events), m AS (SELECT ts, date_diff('hour', lag(ts) OVER (ORDER BY ts), ts) AS d, lead(ts, 14) OVER (ORDER BY ts) AS z FROM h),
    w AS (SELECT ts, z, min(d) OVER (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING) AS lo, max(d) OVER (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING) AS hi FROM m)
    SELECT CASE WHEN lo < hi THEN 'NO_FREQ' WHEN lo % 24 = 0 THEN CASE WHEN lo > 24 THEN (lo // 24)::VARCHAR ELSE '' END || 'D' ELSE CASE WHEN lo > 1 THEN lo::VARCHAR ELSE '' END || 'H' END AS alias,
    count(*) AS count, strftime(min(ts), '%Y-%m-%d %H') AS min_dt, strftime(max(z), '%Y-%m-%d %H') AS max_dt FROM w WHERE z IS NOT NULL GROUP BY 1"""
)
def frequency_candidates(spark, sf_dir):
    from .queries import _slots

    found = frequency.candidates(_slots(spark, sf_dir, 60))
    return found.select("alias", "count", F.date_format("min_dt", "yyyy-MM-dd HH").alias("min_dt"), F.date_format("max_dt", "yyyy-MM-dd HH").alias("max_dt"))


#: A daily series from the dates of orders, with days left out, days twice, moments between days, and nulls at its end.
_NOISE = """o AS (SELECT DISTINCT date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS n FROM orders), b AS (SELECT min(n) AS a, max(n) AS z FROM o), d AS (SELECT unnest(range(a, z + 1)) AS n FROM b),
    s AS (SELECT DATE '1990-01-01'::TIMESTAMP + to_days(n::INTEGER) AS ts FROM d WHERE n % 400 > 1 UNION ALL SELECT DATE '1990-01-01'::TIMESTAMP + to_days(n::INTEGER) FROM d WHERE n % 300 = 7
    UNION ALL SELECT DATE '1990-01-01'::TIMESTAMP + to_days(n::INTEGER) + INTERVAL 5 HOUR FROM d WHERE n % 500 = 9), p AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM s)"""


def _noisy(spark, sf_dir) -> DataFrame:
    n = F.datediff(F.col("o_orderdate").cast("date"), F.lit(dt.date(1990, 1, 1)))
    ends = _table(spark, sf_dir, "orders").agg(F.min(n).alias("a"), F.max(n).alias("z")).first()
    day = spark.range(ends.a, ends.z + 1).select("id", F.timestamp_add("DAY", F.col("id"), F.expr("timestamp_ntz'1990-01-01'")).alias("ts"))
    twice = day.where("id % 300 = 7").select("ts")
    between = day.where("id % 500 = 9").select(F.timestamp_add("HOUR", F.lit(5), F.col("ts")).alias("ts"))
    made = day.where("id % 400 > 1").select("ts").unionByName(twice).unionByName(between)
    return made.unionByName(spark.range(4).select(F.lit(None).cast("timestamp_ntz").alias("ts")))


@query(
    f"""WITH {_NOISE}, c AS (SELECT ts, min(pos) AS pos FROM p GROUP BY ts), e AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM c)),
    x AS (SELECT 'missing' AS kind, ts, pos FROM e WHERE ts NOT IN (SELECT ts FROM c) UNION ALL SELECT 'extra', ts, pos FROM c WHERE ts NOT IN (SELECT ts FROM e)
    UNION ALL SELECT 'duplicate', ts, pos FROM p WHERE pos > (SELECT c.pos FROM c WHERE c.ts = p.ts) UNION ALL SELECT 'nan', NULL, n + i FROM (SELECT count(*) AS n FROM p), range(4) r(i)),
    g AS (SELECT *, pos - row_number() OVER (PARTITION BY kind ORDER BY pos) AS grp FROM x)
    SELECT kind, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS dt, min(pos)::BIGINT AS idx, count(*) AS range, 'D' AS freq FROM g GROUP BY kind, grp"""
)
def frequency_debug(spark, sf_dir):
    """Missing, extra, repeated and null timestamps, as inference in debug mode reports them."""
    _, found = frequency.infer_frequency(_noisy(spark, sf_dir), "ts", debug=True)
    rows = [(kind, r["dt"], r["idx"], r["range"], found["estimated_freq"]) for kind in ("missing", "extra", "duplicate", "nan") for r in found[f"{kind}_values"]]
    return _rows(spark, rows, "kind string, dt string, idx long, range long, freq string")


@query(f"WITH {_NOISE} SELECT strftime(min(ts), '%Y-%m-%d') AS first, strftime(max(ts), '%Y-%m-%d') AS last, count(DISTINCT ts) AS n FROM p")
def frequency_range(spark, sf_dir):
    """The range that inference reports, and how many timestamps are left when repeats and nulls are gone."""
    made = _noisy(spark, sf_dir)
    _, found = frequency.infer_frequency(made, "ts", debug=True)
    clean = frequency.positioned(made, "ts", ["ts"]).where("ts is not null").groupBy("ts").agg(F.min("pos").alias("pos"))
    return _rows(spark, [(found["actual_range_start"][:10], found["actual_range_end"][:10], clean.count())], "first string, last string, n long")


_SPAN = "SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS z FROM orders"
_FITS = {"B": "isodow(d) < 6", "M": "d = last_day(d)", "SM-15": "d = last_day(d) OR day(d) = 15", "QS-JAN": "day(d) = 1 AND month(d) % 3 = 1", "A-DEC": "month(d) = 12 AND day(d) = 31", "W-MON": "isodow(d) = 1"}


@query(" UNION ALL ".join(f"SELECT '{a}' AS alias, row_number() OVER (ORDER BY d) - 1 AS pos, strftime(d, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(a, z, INTERVAL 1 DAY)) AS d FROM ({_SPAN})) WHERE {w}" for a, w in _FITS.items()))
def frequency_series(spark, sf_dir):
    """The series that aliases stand for between the first and last day of orders, with their places."""
    span = _table(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("z")).first()
    fits = {"B": lambda d: d.weekday() < 5, "M": lambda d: (d + dt.timedelta(1)).day == 1, "QS-JAN": lambda d: d.day == 1 and d.month % 3 == 1, "A-DEC": lambda d: (d.month, d.day) == (12, 31), "W-MON": lambda d: d.weekday() == 0}
    fits["SM-15"] = lambda d: d.day == 15 or fits["M"](d)
    out = None
    for alias, fit in fits.items():
        first = next(d for i in range(400) if fit(d := span.a + dt.timedelta(i)))
        made = frequency.series(spark, alias, dt.datetime.combine(first, dt.time()), dt.datetime.combine(span.z, dt.time()))
        row = made.select(F.lit(alias).alias("alias"), "pos", F.date_format("ts", "yyyy-MM-dd").alias("day"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    """WITH n AS (SELECT count(DISTINCT o_orderstatus) AS k, count(DISTINCT o_orderdate) AS d FROM orders)
    SELECT kind, CASE kind WHEN 'nothing' THEN 'datetime_series_is_empty' WHEN 'few' THEN CASE WHEN k < 15 THEN 'datetime_series_is_not_long_enough' END
        WHEN 'unordered' THEN 'datetime_series_is_not_monotonic' ELSE 'datetime_series_freq_cannot_be_estimated' END AS message
    FROM n, (VALUES ('nothing'), ('few'), ('unordered'), ('uneven')) v(kind)"""
)
def frequency_messages(spark, sf_dir):
    """Why no frequency is estimated: for no timestamps, few, unordered, and such as follow no alias."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    day = F.expr("timestamp_ntz'2000-01-01'")
    # A second a key, and squares modulo a prime as its fraction: steps differ, and the years of any keys stay within four digits.
    rest = F.col("o_orderkey") % 999_983
    uneven = F.timestamp_add("MICROSECOND", F.col("o_orderkey") * 1_000_000 + rest * rest % 999_983, day)
    made = {
        "nothing": (orders.select(F.lit(None).cast("timestamp_ntz").alias("ts")), None),
        "few": (orders.select(F.timestamp_add("DAY", F.ascii("o_orderstatus"), day).alias("ts")), None),
        "unordered": (orders.select("o_orderkey", F.col("o_orderdate").alias("ts")), ["o_orderkey"]),
        "uneven": (orders.select(uneven.alias("ts")), None),
    }
    return _rows(spark, [(k, frequency.infer_frequency(df, "ts", order, debug=True)[1]["message"]) for k, (df, order) in made.items()], "kind string, message string")


@query("SELECT measure, count(CASE WHEN measure = 'mutual_info' OR column_type <> 'VARCHAR' THEN 1 END) AS columns FROM (DESCRIBE orders), (VALUES ('pearson'), ('spearman'), ('mutual_info')) v(measure) GROUP BY measure")
def measurable_columns(spark, sf_dir):
    """How many columns of orders each measure of dependence takes."""
    from .operators import catalog

    t = TypedTable.init(_table(spark, sf_dir, "orders"), validate=False)
    kinds = {"pearson": catalog.valid_pearson_types(), "spearman": catalog.valid_spearman_types(), "mutual_info": catalog.valid_mi_types()}
    return _rows(spark, [(m, sum(isinstance(k, tuple(ts)) for k in t.logical_types.values())) for m, ts in kinds.items()], "measure string, columns long")


@query("SELECT s_name AS email FROM supplier UNION ALL SELECT c_name FROM customer WHERE c_custkey % 2 = 1")
def validate_one_column(spark, sf_dir):
    """The values of one column that are no addresses."""
    names = _table(spark, sf_dir, "supplier").select(F.col("s_name").alias("email"))
    some = _table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 1, F.col("c_name")).otherwise(F.concat(F.lit("c"), F.col("c_custkey"), F.lit("@shop.com"))).alias("email"))
    df = names.unionByName(some)
    full = TypedTable.init_with_full_schema(df, TypedTable.init(df.limit(0), logical_types={"email": "EmailAddress"}).schema, validate=False)
    return full["email"].validate_logical_type(return_invalid_values=True).select("email")


class DistinctText(L.Unknown):
    """Texts none of which comes twice."""


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {e}) = count({e}) THEN 'DistinctText' ELSE 'Unknown' END AS logical_type FROM customer" for c, e in (("c_name", "c_name"), ("pair", "c_mktsegment || (c_custkey // 2)"))))
def infer_by_values(spark, sf_dir):
    """A custom type that a rule tells from the values themselves."""
    system = TypeSystem()
    system.add_type(DistinctText, OfValues(lambda s: bool(s.dropna().is_unique and s.map(lambda v: isinstance(v, str)).all())), parent="Unknown")
    df = _table(spark, sf_dir, "customer").select("c_name", F.concat("c_mktsegment", F.floor(F.col("c_custkey") / 2)).alias("pair"))
    return _rows(spark, [(c, type(k).__name__) for c, k in inference.infer(df, system=system).items()], "column string, logical_type string")


# -- tables against tables -----------------------------------------------------------------------------------------------


@query(
    """SELECT * FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 2 = 0) FULL JOIN (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 50000) USING (o_orderkey)
    FULL JOIN (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O') USING (o_orderkey) FULL JOIN (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0) USING (o_orderkey)
    FULL JOIN (SELECT o_orderkey, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey) USING (o_orderkey)"""
)
def five_tables_joined(spark, sf_dir):
    """Five tables with one index, side by side."""
    orders = _table(spark, sf_dir, "orders")
    lines = _table(spark, sf_dir, "lineitem").join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.sum("l_quantity").alias("quantity"))
    parts = [
        (orders.where("o_custkey % 2 = 0").select("o_orderkey", "o_custkey"), "Integer"),
        (orders.where("o_totalprice > 50000").select("o_orderkey", "o_totalprice"), "Double"),
        (orders.where("o_orderstatus <> 'O'").select("o_orderkey", "o_orderstatus"), "Categorical"),
        (orders.where("o_orderkey % 3 = 0").select("o_orderkey", "o_orderpriority"), "Categorical"),
        (lines, "Double"),
    ]
    tables = [TypedTable.init(df, index="o_orderkey", logical_types={"o_orderkey": "Integer", df.columns[1]: kind}, validate=False) for df, kind in parts]
    return concat_columns(tables).df


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber < 5), b AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 40)
    SELECT *, 'left' AS _side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"""
)
def differing_rows(spark, sf_dir):
    """Rows that one of two tables lacks, as often as it lacks them."""
    kinds = {"l_orderkey": "Integer", "l_linenumber": "Integer", "l_quantity": "Double"}
    t = _typed(spark, sf_dir, "lineitem", kinds)
    return t.filter("l_linenumber < 5").differing(t.filter("l_quantity < 40"))


@query("SELECT 'same rows, dealt anew' AS tables, true AS equal UNION ALL SELECT 'a value changed', NOT (SELECT count(*) > 0 FROM orders WHERE o_orderkey % 100 = 1) UNION ALL SELECT 'a row twice', (SELECT count(*) = 0 FROM orders)")
def deep_equality(spark, sf_dir):
    t = _typed(spark, sf_dir, "orders", {"o_orderkey": "Integer", "o_totalprice": "Double", "o_orderpriority": "Categorical"})
    others = {
        "same rows, dealt anew": t.df.repartition("o_orderpriority"),
        "a value changed": t.df.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 100 == 1, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))),
        "a row twice": t.df.unionByName(t.df.orderBy("o_orderkey").limit(1)),
    }
    return _rows(spark, [(k, t.equals(TypedTable(df, t.schema), deep=True)) for k, df in others.items()], "tables string, equal boolean")


# -- files -------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name || chr(10) || '\"' || p_brand || '\", x' AS note, p_size::BIGINT AS p_size, p_retailprice FROM part")
def csv_with_line_breaks(spark, sf_dir):
    folder = fresh_path(spark, "typed")
    note = F.concat(F.col("p_name"), F.lit('\n"'), F.col("p_brand"), F.lit('", x'))
    _table(spark, sf_dir, "part").select("p_partkey", note.alias("note"), "p_size", "p_retailprice").write.options(header=True, escape='"').csv(f"{folder}.csv")
    return files.read_file(spark, f"{folder}.csv", "csv", logical_types={"note": "Unknown", "p_size": "Integer"}, index="p_partkey").df


@query("SELECT s_suppkey, s_nationkey::DOUBLE AS latitude, s_acctbal AS longitude FROM supplier")
def latlong_by_csv(spark, sf_dir):
    df = _table(spark, sf_dir, "supplier").select("s_suppkey", F.array(F.col("s_nationkey").cast("double"), "s_acctbal").alias("place"))
    folder = fresh_path(spark, "typed")
    TypedTable.init(df, index="s_suppkey", logical_types={"s_suppkey": "Integer", "place": "LatLong"}).to_disk(folder, format="csv")
    return files.read_table(spark, folder).df.select("s_suppkey", "place.latitude", "place.longitude")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, 'parquet' AS format FROM nation UNION ALL SELECT n_nationkey::BIGINT, n_name, 'orc' FROM nation UNION ALL SELECT n_nationkey::BIGINT, n_name, 'feather' FROM nation")
def files_by_name(spark, sf_dir):
    """Formats told by a file's ending or content type, without typing information."""
    out, base = None, fresh_path(spark, "typed")
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    df.write.parquet(f"{base}.parquet")
    df.write.orc(f"{base}.orc")
    TypedTable.init(df).to_disk(base, format="feather")
    for kind, path, content in (("parquet", f"{base}.parquet", None), ("orc", f"{base}.orc", "application/orc"), ("feather", f"{base}/data/data", "feather")):
        one = files.read_file(spark, path, content).df.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.lit(kind).alias("format"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day, 'Ordinal' AS logical_type FROM orders")
def typing_within_files(spark, sf_dir):
    """Parquet files that are typed by what they carry, without a typing file; of three columns."""
    order = sorted(r[0] for r in _table(spark, sf_dir, "orders").select("o_orderpriority").distinct().collect())
    t = _typed(spark, sf_dir, "orders", INFERRED["orders"] | {"o_orderpriority": L.Ordinal(order)}, index="o_orderkey")
    folder = fresh_path(spark, "typed")
    t.to_disk(folder, format="parquet")
    back = files.read_typed(spark, f"{folder}/data/data", ["o_orderkey", "o_orderpriority", "o_orderdate"])
    return back.df.select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.lit(type(back.logical_types["o_orderpriority"]).__name__).alias("logical_type"))


@query("SELECT c_custkey, c_mktsegment FROM customer")
def arrow_columns(spark, sf_dir):
    """Two columns of Arrow files that tasks wrote, read by runs of their batches."""
    path = fresh_path(spark, "arrow")
    arrow_source.write(_table(spark, sf_dir, "customer").repartition(3), path)
    return arrow_source.read(spark, path, ["c_custkey", "c_mktsegment"], task_bytes=1 << 14)


@query("SELECT * FROM (VALUES ('over data', true), ('pickle', true), ('to a URL', true), ('unknown format', true), ('a new folder', false)) v(guard, raised)")
def sink_guards(spark, sf_dir):
    """Which writes are refused."""
    from .errors import FileExistsInPathError

    t = _typed(spark, sf_dir, "nation", {"n_nationkey": "Integer", "n_name": "Unknown"})
    folder = fresh_path(spark, "typed")
    t.to_disk(folder, format="parquet")
    tried = {
        "over data": lambda: t.to_disk(folder, format="parquet"),
        "pickle": lambda: t.to_disk(fresh_path(spark, "typed"), format="pickle"),
        "to a URL": lambda: t.to_disk("http://example.com/x"),
        "unknown format": lambda: t.to_disk(fresh_path(spark, "typed"), format="xyz"),
        "a new folder": lambda: t.to_disk(fresh_path(spark, "typed"), format="orc"),
    }
    rows = []
    for name, do in tried.items():
        try:
            do()
            rows.append((name, False))
        except (FileExistsInPathError, ValueError):
            rows.append((name, True))
    return _rows(spark, rows, "guard string, raised boolean")
