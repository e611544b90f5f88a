"""What several corpus operators share: scratch tables in the cluster's shared folder, shipping of the
package to executors, and vectorised word hashing of UTF-8 text held in Arrow buffers."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from ..scratch import fresh_path as scratch_path
from ..scratch import shared_dir

PACKAGE = __name__.partition(".")[0]

#: Bytes that separate words: space and the controls from tab to carriage return.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: The same words, as Java, Python and DuckDB write the pattern.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bytes of text that the Python side handles at a time; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 19

#: Bytes of rows that Spark hands to Python at a time, where the session has its own default of 64 MB.
BATCH_BYTES = 4 << 20
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers whose path does not hold it already, and bounds the batches they get."""
    if spark.conf.get(_BATCH, None) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    context = spark.sparkContext
    if getattr(context, "_shipped_packages", None) == PACKAGE:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{PACKAGE}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(os.path.join(root, PACKAGE)):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, root))
    context.addPyFile(target)
    context._shipped_packages = PACKAGE


def remove_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application. Results that have not been stored can't be read after it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{PACKAGE}-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder. It cuts lineage, and later passes read only the columns they use."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs whose results have been written: it does so once the driver's JVM has collected
    what refers to them, which a driver with memory to spare may put off for long. Twice, as what is freed first may hold more."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def slices(batches, column: str = "text", most: int = SLICE_BYTES):
    """Record batches cut so that the named string column holds about `most` bytes in each."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        if not len(text):
            continue
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(text), 0), dtype=np.int64)
        group = (np.cumsum(size) - size) // most
        edges = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *edges], [*edges, len(text)], strict=True):
            yield batch.slice(a, b - a)


def utf8(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, end to end, and each row's bounds in them; null counts as empty."""
    text = pa.compute.fill_null(batch.column(batch.schema.get_field_index(column)), "").cast(pa.large_binary())
    text = pa.concat_arrays([text])
    _, offsets, data = text.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's start and end in `raw`, and each row's bounds among the words."""
    inside = ~SPACES[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = bounds[(bounds > 0) & (bounds < len(raw))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            steps = np.full(size, self.base, dtype=np.uint64), np.full(size, self.inverse, dtype=np.uint64)
            for x in steps:
                x[0] = 1
            self.up, self.down = (np.cumprod(x) for x in steps)
        return self.up[:n], self.down[:n]


BYTE_POWERS, WORD_POWERS, CHECK_POWERS = Powers(0x2545F4914F6CDD1D), Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F)
BYTE_CODES = mixed(np.arange(256, dtype=np.uint64), 7)


def runs_hashed(values: np.ndarray, powers: Powers, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for each start and end, from one prefix sum."""
    up, down = powers.of(len(values) + 1)
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * down[starts]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed(runs_hashed(BYTE_CODES[raw], BYTE_POWERS, starts, ends) + (ends - starts).astype(np.uint64))
