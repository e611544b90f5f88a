"""Arrow IPC files as a data source of Spark.

A partition is a run of record batches of one file, told from its footer, so a large file is read by many tasks; only the asked-for
columns are decoded. Writing stages a file a task, and the commit moves all of them into place: a write that fails leaves nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAME = "typeloom_arrow"

#: Bytes of a file that a task reads, about; no less than a record batch.
TASK_BYTES = 64 << 20


def _source() -> type:
    """The data source's class. It is made in a function, so that tasks get it with what they run and need no package of ours."""
    import json
    import os
    import uuid
    from dataclasses import dataclass

    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

    name, task_bytes = NAME, TASK_BYTES

    @dataclass
    class Batches(InputPartition):
        place: str
        first: int
        end: int

    @dataclass
    class Staged(WriterCommitMessage):
        staged: str | None
        place: str | None

    def store_of(path):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")

    def files_of(path):
        from pyarrow import fs

        store, base = store_of(path)
        info = store.get_file_info(base)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(base)) if info.type == fs.FileType.Directory else []
        out = sorted((f.path, f.size) for f in found if f.is_file and not os.path.basename(f.path).startswith((".", "_")))
        if not out:
            raise FileNotFoundError(path)
        return store, out

    class Reader(DataSourceReader):
        def __init__(self, path, columns, bytes_a_task):
            self.path, self.columns, self.bytes = path, columns, bytes_a_task

        def partitions(self):
            import pyarrow as pa

            store, found = files_of(self.path)
            out = []
            for place, size in found:
                with store.open_input_file(place) as f:
                    n = pa.ipc.open_file(f).num_record_batches
                each = max(1, n * self.bytes // max(size, 1))
                out += [Batches(place, i, min(i + each, n)) for i in range(0, n, each)]
            return out or [Batches(found[0][0], 0, 0)]

        def read(self, partition):
            import pyarrow as pa

            store, _ = store_of(self.path)
            with store.open_input_file(partition.place) as f:
                fields = pa.ipc.open_file(f).schema.names
            wanted = pa.ipc.IpcReadOptions(included_fields=[fields.index(c) for c in self.columns]) if self.columns else None
            with store.open_input_file(partition.place) as f:
                reader = pa.ipc.open_file(f, options=wanted)
                for i in range(partition.first, partition.end):
                    batch = reader.get_batch(i)
                    yield batch.select(self.columns) if self.columns else batch

    class Writer(DataSourceArrowWriter):
        def __init__(self, path):
            self.path, self.stage = path, f"_staged-{uuid.uuid4().hex}"
            store, base = store_of(path)
            store.create_dir(f"{base}/{self.stage}", recursive=True)

        def write(self, iterator):
            import pyarrow as pa
            from pyspark import TaskContext

            store, base = store_of(self.path)
            part, writer, out = f"part-{TaskContext.get().partitionId():05d}.arrow", None, None
            staged = f"{base}/{self.stage}/{part}.{uuid.uuid4().hex}"
            for batch in iterator:
                if writer is None:
                    out = store.open_output_stream(staged)
                    writer = pa.ipc.new_file(out, batch.schema)
                writer.write_batch(batch)
            if writer is None:
                return Staged(None, None)
            writer.close()
            out.close()
            return Staged(staged, f"{base}/{part}")

        def commit(self, messages):
            store, base = store_of(self.path)
            for m in messages:
                if m is not None and m.staged is not None:
                    store.move(m.staged, m.place)
            store.delete_dir(f"{base}/{self.stage}")

        def abort(self, messages):
            from pyarrow import fs

            store, base = store_of(self.path)
            store.delete_dir(f"{base}/{self.stage}")
            if not store.get_file_info(fs.FileSelector(base)):
                store.delete_dir(base)

    class ArrowFiles(DataSource):
        @classmethod
        def name(cls):
            return name

        def _columns(self):
            return json.loads(self.options.get("columns", "null"))

        def schema(self):
            import pyarrow as pa
            from pyspark.sql.pandas.types import from_arrow_schema

            store, found = files_of(self.options["path"])
            with store.open_input_file(found[0][0]) as f:
                own = pa.ipc.open_file(f).schema
            return from_arrow_schema(pa.schema([own.field(c) for c in self._columns()]) if self._columns() else own)

        def reader(self, schema):
            return Reader(self.options["path"], self._columns(), int(self.options.get("taskbytes", task_bytes)))

        def writer(self, schema, overwrite):
            return Writer(self.options["path"])

    return ArrowFiles


def register(spark: SparkSession) -> None:
    spark.dataSource.register(_source())


def read(spark: SparkSession, path: str, columns: list[str] | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """All Arrow files of a folder, or one file; of the named columns alone, if any are named. Raises FileNotFoundError's message
    where there are none."""
    import json

    register(spark)
    reader = spark.read.format(NAME).option("taskbytes", task_bytes)
    return (reader.option("columns", json.dumps(columns)) if columns else reader).load(path)


def write(df: DataFrame, path: str) -> None:
    """A file a task, all or none."""
    register(df.sparkSession)
    df.write.format(NAME).mode("append").save(path)
