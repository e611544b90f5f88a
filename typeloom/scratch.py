"""The folder that driver and executors share, for what is written and read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of our own if all run on one machine; on a cluster that is an error, as
    no machine's own folder is seen by the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_own_shared_dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.sparkContext._own_shared_dir = folder
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in it that nothing else uses."""
    return f"{shared_dir(spark)}/typeloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what reads it sees the same rows each time, whichever executors are lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_files(df: DataFrame) -> list[str]:
    """The files that df is read from, named as its hidden column _metadata.file_path names them."""
    return sorted(re.sub(r"^(\w+):///", r"\1:/", f) for f in df.inputFiles())
