"""Files: reading any supported format into a typed table, and writing typed tables so that they come back the same."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FileExistsInPathError, OutdatedSchemaWarning, UpgradeSchemaWarning
from ..functions import logical_types as L
from ..operators.table import TypedTable
from ..plans.registry import warn
from ..plans.schema import VERSION, TableSchema
from ..scratch import input_files
from . import arrow_source

FORMATS = {
    "csv": "csv", "text/csv": "csv", "parquet": "parquet", "application/parquet": "parquet", "orc": "orc", "application/orc": "orc",
    "arrow": "arrow", "application/arrow": "arrow", "feather": "arrow", "application/feather": "arrow",
}
TYPING_FILE = "typing_info.json"


def _format(path: str, content_type: str | None) -> str:
    kind = content_type or os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    if not kind:
        raise RuntimeError(f"the content type of {path} cannot be told from its name")
    if kind not in FORMATS:
        raise RuntimeError(f"the content type {kind} is not supported")
    return FORMATS[kind]


def _arrow_files(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files by runs of record batches. Files of stores that only Spark reaches are handed to the tasks whole."""
    import pyarrow as pa
    from pyarrow import fs
    from pyspark.sql.pandas.types import from_arrow_schema

    try:
        fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        files = spark.read.format("binaryFile").load(path)
        first = files.orderBy("path").first()
        if first is None:
            raise FileNotFoundError(path) from None
        schema = from_arrow_schema(pa.ipc.open_file(first.content).schema)

        def batches_of(content):
            reader = pa.ipc.open_file(content)
            return (reader.get_batch(i) for i in range(reader.num_record_batches))

        return files.select("content").mapInArrow(lambda batches: (x for batch in batches for c in batch.column(0) for x in batches_of(c.as_py())), schema)
    return arrow_source.read(spark, path)


def _csv(spark: SparkSession, path: str, schema: T.StructType | None = None, **options) -> DataFrame:
    """csv files, in parts but for those with quoted line breaks, which have lines with an odd number of quotes: of these each is
    read by one task. All files have the same header."""
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    # Names of files, of which a folder holds as many as the driver lists in any case.
    whole = [r.p for r in spark.read.text(path).where(odd).select(F.col("_metadata.file_path").alias("p")).distinct().collect()]
    reader = lambda **more: (spark.read if schema is None else spark.read.schema(schema)).options(**{**more, **options})
    if not whole or "multiLine" in options:
        return reader(multiLine=bool(whole)).csv(path)
    split = sorted(set(input_files(spark.read.text(path))) - set(whole))
    parts = [reader(multiLine=m).csv(ps) for m, ps in ((False, split), (True, sorted(whole))) if ps]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_file(spark: SparkSession, path: str, content_type: str | None = None, name: str | None = None, index: str | None = None, time_index: str | None = None, semantic_tags=None, logical_types=None, use_standard_tags=True, column_origins=None, replace_nan: bool = False, validate: bool = True, **options) -> TypedTable:
    """A typed table from csv, parquet, orc or arrow files. Options go to Spark's reader.

    csv is read as strings, which inference types; files are split among tasks but for those with quoted line breaks. replace_nan makes strings that stand for null null, in all columns.
    """
    kind = _format(path, content_type)
    if kind == "arrow":
        df = _arrow_files(spark, path)
    else:
        df = _csv(spark, path, **{"header": True, "escape": '"', **options}) if kind == "csv" else spark.read.options(**options).format(kind).load(path)
    if replace_nan:
        df = df.select(*(L.clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))
    return TypedTable.init(df, name, index, time_index, logical_types, semantic_tags, use_standard_tags, column_origins=column_origins, validate=validate)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, place = _fs(spark, path)
    out = fs.create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    fs, place = _fs(spark, path)
    if not fs.exists(place):
        raise FileNotFoundError(path)
    stream = fs.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def to_disk(table: TypedTable, path: str, format: str = "csv", filename: str = "data", data_subdirectory: str = "data", typing_info_filename: str = TYPING_FILE, compression: str | None = None, **options) -> None:
    """Writes data and typing information below a folder of any file system that Spark reaches.

    Refuses to write over either. Formats: csv, parquet, orc, arrow (or feather: a part file a task). Pickles are not written.
    """
    if path.startswith(("http://", "https://")):
        raise ValueError("writing to a URL is not supported")
    if format == "pickle":
        raise ValueError("pickle files are not portable; write parquet")
    if format not in FORMATS:
        raise ValueError(f"the format {format} is not supported")
    kind = FORMATS[format]
    info = table.typing_info()
    info["loading_info"] = {"type": format, "location": f"{data_subdirectory}/{filename}", "params": options, "compression": compression}
    text = json.dumps(info)
    spark, data, typing = table.df.sparkSession, f"{path}/{data_subdirectory}/{filename}", f"{path}/{typing_info_filename}"
    for p in (data, typing):
        fs, place = _fs(spark, p)
        if fs.exists(place):
            raise FileExistsInPathError(f"{p} is already there")
    df = table.df
    if kind == "csv":
        df = df.select(*(_as_text(f).alias(f.name) for f in df.schema))
        options = {"header": True, "escape": '"', "emptyValue": '""', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, **options}
    if kind == "arrow":
        arrow_source.write(df, data)
    else:
        df = _with_typing(df, info) if kind == "parquet" else df
        writer = df.write.format(kind).options(**options)
        (writer.option("compression", compression) if compression else writer).save(data)
    _write_text(spark, typing, text)


#: Where a column's metadata in a Spark schema, which Parquet files keep, holds its typing information, and the table's.
COLUMN_TYPING, TABLE_TYPING = "typeloom.column", "typeloom.table"


def _with_typing(df: DataFrame, info: dict) -> DataFrame:
    """df with each column's typing information, as JSON, in its metadata; the table's is in that of every column, so that it stays
    whichever columns are read."""
    table = json.dumps({k: v for k, v in info.items() if k not in ("column_typing_info", "loading_info")})
    own = {c["name"]: json.dumps(c) for c in info["column_typing_info"]}
    return df.select(*(F.col(f"`{f.name}`").alias(f.name, metadata={**f.metadata, COLUMN_TYPING: own[f.name], TABLE_TYPING: table}) for f in df.schema))


def typing_within(df: DataFrame) -> dict | None:
    """The typing information that the columns of df carry, of those that are there; None if one carries none. An index that is no
    longer there is left out."""
    fields = df.schema.fields
    if not fields or any(COLUMN_TYPING not in f.metadata or TABLE_TYPING not in f.metadata for f in fields):
        return None
    info = json.loads(fields[0].metadata[TABLE_TYPING])
    columns = [{**json.loads(f.metadata[COLUMN_TYPING]), "name": f.name, "ordinal": i} for i, f in enumerate(fields)]
    names = {c["name"] for c in columns}
    return {**info, **{k: info[k] if info[k] in names else None for k in ("index", "time_index")}, "column_typing_info": columns}


def read_typed(spark: SparkSession, path: str, columns: list[str] | None = None, validate: bool = False) -> TypedTable:
    """Parquet files typed by the information that they carry within, without a typing file beside them. Of `columns`
    alone, if given. Raises if the files carry none."""
    df = spark.read.parquet(path)
    df = df if columns is None else df.select(*(F.col(f"`{c}`") for c in columns))
    info = typing_within(df)
    if info is None:
        raise ValueError(f"the files of {path} carry no typing information")
    return _typed(df, info, validate)


def _typed(df: DataFrame, info: dict, validate: bool) -> TypedTable:
    _check_version(info["schema_version"])
    want = {c["name"]: c["physical_type"]["type"] for c in info["column_typing_info"]}
    df = df.select(*(F.col(f"`{c}`").cast(k).alias(c, metadata={}) for c, k in want.items()))
    return TypedTable.init_with_full_schema(df, TableSchema.from_dict(info), validate=validate)


def _as_text(f: T.StructField):
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    if isinstance(f.dataType, T.DayTimeIntervalType):
        return F.expr(f"cast(extract(day from `{f.name}`) as bigint) * 86400000000 + cast(extract(hour from `{f.name}`) as bigint) * 3600000000 + cast(extract(minute from `{f.name}`) as bigint) * 60000000 + cast(extract(second from `{f.name}`) * 1000000 as bigint)")
    if isinstance(f.dataType, T.TimestampNTZType):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return c


def read_table(spark: SparkSession, path: str, filename: str | None = None, data_subdirectory: str = "data", typing_info_filename: str = TYPING_FILE, validate: bool = False, format: str | None = None) -> TypedTable:
    """A table as to_disk wrote it. Without a typing file, the named data file is typed by what it carries within, or else by inference."""
    try:
        info = json.loads(_read_text(spark, f"{path}/{typing_info_filename}"))
    except FileNotFoundError:
        if filename is None:
            raise
        kind = format or os.path.splitext(filename)[1].lstrip(".")
        if not kind:
            raise ValueError(f"the format of {filename} is not known") from None
        data = f"{path}/{data_subdirectory}/{filename}"
        if FORMATS.get(kind) == "parquet" and typing_within(spark.read.parquet(data)) is not None:
            return read_typed(spark, data, validate=validate)
        return read_file(spark, data, kind, validate=validate)
    _check_version(info["schema_version"])
    schema = TableSchema.from_dict(info)
    kind = FORMATS[info["loading_info"].get("type") or format]
    data = f"{path}/{info['loading_info']['location']}" if filename is None else f"{path}/{data_subdirectory}/{filename}"
    want = {c["name"]: c["physical_type"]["type"] for c in info["column_typing_info"]}
    if kind == "csv":
        fields = T.StructType([T.StructField(c, T.StringType()) for c in want])
        df = _csv(spark, data, fields, header=True, escape='"', emptyValue="")
        df = df.select(*(_from_text(c, k).alias(c) for c, k in want.items()))
    elif kind == "arrow":
        df = _arrow_files(spark, data)
        df = df.select(*(F.col(f"`{c}`").cast(k) for c, k in want.items()))
    else:
        df = spark.read.format(kind).load(data)
        df = df.select(*(F.col(f"`{c}`").cast(k).alias(c) for c, k in want.items()))
    return TypedTable.init_with_full_schema(df, schema, validate=validate)


def _from_text(name: str, kind: str):
    c = F.col(f"`{name}`")
    if kind.startswith(("struct", "array", "map")):
        return F.from_json(c, kind)
    if kind.startswith("interval"):
        return F.expr(f"make_dt_interval(0, 0, 0, cast(cast(`{name}` as decimal(20, 0)) / 1000000 as decimal(18, 6)))").cast(kind)
    return c if kind == "string" else c.cast(kind)


def _check_version(saved: str) -> None:
    have, was = ([int(x) for x in v.split(".")] for v in (VERSION, saved))
    if was > have:
        warn(f"the typing information has version {saved}, which is newer than {VERSION}", UpgradeSchemaWarning)
    elif was[0] < have[0]:
        warn(f"the typing information has version {saved}, which is older than {VERSION}", OutdatedSchemaWarning)


def load_orders(spark: SparkSession, folder: str) -> TypedTable:
    """A demonstration table: orders, with index and time index."""
    df = spark.read.parquet(f"{folder}/orders.parquet")
    kinds = {"o_orderstatus": "Categorical", "o_orderpriority": "Categorical"}
    return TypedTable.init(df, "orders", "o_orderkey", "o_orderdate", kinds, already_sorted=True)
