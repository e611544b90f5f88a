"""Media columns: texts' bytes as FLAC audio, and FLAC decoded to rows of PCM blocks with seekable sample offsets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac
from .shared import ship, slices, utf8

#: Payloads are filled with bytes 0 up to a positive multiple of this.
UNIT = 64

#: Bytes that are coded at a time.
SLICE = 1 << 19

#: Samples of a PCM block; blocks start with a frame.
PCM_SAMPLES = 1 << 16

BLOCK_FIELDS = ["block int", "n_blocks int", "first_sample long", "n_samples long", "flac_place long", "pcm binary"]


def to_flac(docs: DataFrame) -> DataFrame:
    """doc_id, stream (a number that tells rows apart), n_bytes and media: the text's UTF-8 (null: empty), filled up, as an 8-bit
    mono FLAC stream.

    Every row gives a row; equal texts give equal streams. A null doc_id stays null. Other columns of docs are not read.
    """
    ship(docs.sparkSession)

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            raw, bounds = utf8(batch)
            size = np.diff(bounds)
            full = np.maximum(-(-size // UNIT), 1) * UNIT
            new = np.concatenate([[0], np.cumsum(full)])
            filled = np.zeros(new[-1], dtype=np.uint8)
            for i in np.flatnonzero(size):  # no arrays of places: one text may be as long as memory allows
                filled[new[i] : new[i] + size[i]] = raw[bounds[i] : bounds[i + 1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(flac.encode(filled, new), pa.binary())], names=["doc_id", "stream", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("stream"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, stream long, n_bytes long, media binary")


def features(pcm: bytes) -> str:
    """Exact sums over unsigned 8-bit samples, about their middle: count, mean square, zero crossings, least and greatest."""
    x = np.frombuffer(pcm, dtype=np.uint8).astype(np.int64) - 128
    if not len(x):
        return "samples=0"
    return f"samples={len(x)};sum={x.sum()};squares={(x * x).sum()};crossings={int((np.diff(x >= 0)).sum())};min={x.min()};max={x.max()}"


def pcm_blocks(media: DataFrame, column: str = "media", samples: int = PCM_SAMPLES) -> DataFrame:
    """media's rows without their stream, as rows of blocks of its samples: block (from 0), n_blocks, first_sample, n_samples,
    flac_place (the byte of the stream at which the frame of the first sample starts) and pcm.

    The check sums of frames and samples are verified, and a mismatch fails the task. pcm has the samples as in WAV, channels
    interleaved; blocks start where frames do and hold `samples` of them or, but for the last, a few less. A null stream
    gives one row, with nulls. Rows of equal streams give equal blocks. media must not have the columns that are added.
    """
    ship(media.sparkSession)
    names = [c for c in media.columns if c != column]
    if clash := {f.split()[0] for f in BLOCK_FIELDS} & set(names):
        raise ValueError(f"media already has {sorted(clash)}")
    schema = ", ".join([*(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in names), *BLOCK_FIELDS])

    def run(batches):
        for batch in slices(batches, column, SLICE):
            streams = batch.column(batch.schema.get_field_index(column)).to_pylist()
            some = [i for i, s in enumerate(streams) if s is not None]
            read = dict(zip(some, flac.decode([streams[i] for i in some]) if some else [], strict=True))
            row, listed = [], []
            for i in range(len(streams)):
                if i not in read:
                    row.append(i), listed.append((None,) * 6)
                    continue
                pcm, first, place = read[i]
                width = flac.sample_bytes(streams[i])
                total = len(pcm) // width
                cut = np.unique(np.searchsorted(first, np.arange(0, total, samples), side="right") - 1) if total else np.zeros(1, dtype=np.int64)
                start = first[cut] if total else np.zeros(1, dtype=np.int64)
                for k, (a, b) in enumerate(zip(start.tolist(), [*start[1:].tolist(), total], strict=True)):
                    row.append(i), listed.append((k, len(cut), a, b - a, int(place[cut[k]]) if total else 0, pcm[a * width : b * width]))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            own = batch.select(names).take(pa.array(row, pa.int64())) if names else None
            yield pa.RecordBatch.from_arrays([*(own.columns if own is not None else []), *(pa.array(x, t) for x, t in zip(zip(*listed, strict=True), kinds, strict=True))], names=[*names, *(f.split()[0] for f in BLOCK_FIELDS)])

    return media.mapInArrow(run, schema)


def write_blocks(blocks: DataFrame, path: str) -> DataFrame:
    """Writes rows of PCM blocks as Parquet, and returns them as read back."""
    blocks.write.option("compression", "zstd").parquet(path)
    return blocks.sparkSession.read.schema(blocks.schema).parquet(path)


def samples(blocks: DataFrame, first: int, last: int) -> DataFrame:
    """The blocks that hold samples from first up to last, cut to these: their rows with first_sample, n_samples and pcm
    changed. Only such blocks are read, by the offsets that the files' statistics hold."""
    width = F.octet_length("pcm") / F.greatest("n_samples", F.lit(1))
    some = blocks.where((F.col("first_sample") < last) & (F.col("first_sample") + F.col("n_samples") > first))
    some = some.withColumns({"_a": F.greatest(F.lit(first) - F.col("first_sample"), F.lit(0)), "_b": F.least(F.lit(last) - F.col("first_sample"), F.col("n_samples"))})
    some = some.withColumn("pcm", F.substring("pcm", (F.col("_a") * width + 1).cast("int"), ((F.col("_b") - F.col("_a")) * width).cast("int")))
    return some.withColumns({"first_sample": F.col("first_sample") + F.col("_a"), "n_samples": F.col("_b") - F.col("_a")}).drop("_a", "_b")


def streams(blocks: DataFrame, key: str) -> DataFrame:
    """A row for each stream of PCM blocks: their other columns, n_blocks, pcm whole, and feature (see features()).

    `key` tells streams apart. Streams of one block, as most are, are not shuffled; the blocks of others are brought
    together, so that a stream needs the memory of its own samples.
    """
    ship(blocks.sparkSession)
    own = [c for c in blocks.columns if c not in ("block", "first_sample", "n_samples", "flac_place", "pcm")]
    single = F.coalesce(F.col("n_blocks"), F.lit(1)) == 1
    one = blocks.where(single).select(*(F.col(f"`{c}`") for c in own), "pcm")
    many = blocks.where(~single).groupBy(F.col(f"`{key}`")).agg(*(F.first(F.col(f"`{c}`")).alias(c) for c in own if c != key), F.array_sort(F.collect_list(F.struct("block", "pcm"))).alias("_parts"))
    many = many.withColumn("pcm", F.expr("aggregate(_parts, cast('' as binary), (a, x) -> concat(a, x.pcm))")).select(*(F.col(f"`{c}`") for c in own), "pcm")
    both = one.unionByName(many)
    schema = both.select("*", F.lit("").alias("feature")).schema
    for f in schema:
        f.nullable = True

    def run(batches):
        for batch in slices(batches, "pcm", SLICE):
            found = [None if x is None else features(x) for x in batch.column(batch.schema.get_field_index("pcm")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "feature"])

    return both.mapInArrow(run, schema)
