"""Substring deduplication by level-wise doubling of repeated word windows.

Every full window of 50 words has an anchor: the one of its windows of 7 words that hashes least. Equal windows have equal
anchors at equal places, so a full window can repeat between documents only if its anchor does. Those that do are extended
within the full window, to the right where that fits and else to the left, to twice their length, 13, 25 and 50 words, less
one word where that is enough; at each length only what repeats is extended further, until no candidates survive or the full
length is reached, at which windows are grouped exactly. What repeats at a length is sent to all tasks as a filter up to a
checked number of keys; beyond that it is joined by shuffle with the windows.

Longer repeats are found by further doubling: a window of twice the length is a candidate only if both of its halves repeat,
and its identity is that of the pair of halves, so that texts are not read again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .shared import CHECK_POWERS, WORD_POWERS, mixed, runs_hashed, ship, slices, utf8, word_hashes, words, written

WINDOW = 50

#: Words of an anchor, at least; each level's windows are at most twice as long as those of the one before.
ANCHOR = 7

#: Repeated keys of a level that are sent to all tasks as a filter; more are joined by shuffle.
FILTERED_KEYS = bloom.MOST_BLOCKS * bloom.KEYS_A_BLOCK

#: Bits of a word's place, beside which a hash's upper bits order anchors.
_PLACE_BITS = np.uint64(30)


def lengths(size: int) -> list[int]:
    """Lengths of the levels below the full one, ascending: each is half of the next, rounded up."""
    out = []
    while size > ANCHOR:
        size = -(-size // 2)
        out.append(size)
    return out[::-1] or [size]


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = 1
    while 2 * n <= w:
        x, n = np.minimum(x[:-n], x[n:]), 2 * n
    return np.minimum(x[: len(x) - (w - n)], x[w - n :]) if w > n else x


class Windows:
    """The full windows of the texts in `raw`: their rows, first words (counted through all texts), and their anchors' places."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, size: int):
        starts, ends, self.at = words(raw, bounds)
        self.size, self.level = size, lengths(size)[0]
        n = len(starts)
        if n < size:
            self.row = self.first = self.place = np.zeros(0, dtype=np.int64)
            return
        self.hashes = word_hashes(raw, starts, ends)
        each = np.arange(n - self.level + 1)
        low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
        order = (self.keys(each) & ~low) | each.astype(np.uint64)
        self.place = (_least(order, size - self.level + 1) & low).astype(np.int64)
        self.first = np.arange(n - size + 1)
        self.row = np.searchsorted(self.at, self.first, side="right") - 1
        self.keep(self.at[self.row + 1] >= self.first + size)

    def keep(self, ok: np.ndarray) -> None:
        self.row, self.first, self.place = self.row[ok], self.first[ok], self.place[ok]

    def keys(self, place: np.ndarray, length: int | None = None) -> np.ndarray:
        length = length or self.level
        return mixed(runs_hashed(self.hashes, WORD_POWERS, place, place + length), length)

    def extend(self, length: int) -> None:
        """Anchors become longer, to the right where they still end within their window, else to the left."""
        right = self.place - self.first + length <= self.size
        self.place = np.where(right, self.place, self.place - (length - self.level))
        self.level = length

    def runs(self) -> np.ndarray:
        """Which windows have another anchor than the window before."""
        new = np.ones(len(self.row), dtype=bool)
        new[1:] = (self.row[1:] != self.row[:-1]) | (self.place[1:] != self.place[:-1])
        return new


def _sliced(batches, size: int, filters: list[tuple[int, np.ndarray]], held: bool):
    """Each slice's batch, and its windows that pass the filters of the levels so far; of a batch with the column `held`, only
    those that it lists by their first words."""
    for batch in slices(batches):
        w = Windows(*utf8(batch), size)
        if held and len(w.row):
            listed = batch.column(batch.schema.get_field_index("held"))
            own = w.at[np.repeat(np.arange(len(listed)), listed.value_lengths().to_numpy(zero_copy_only=False))] + listed.flatten().to_numpy()
            w.keep(np.isin(w.first, own))
        for length, bits in filters:
            if length > w.level:
                w.extend(length)
            if len(w.row) and bits is not None:
                new = w.runs()
                ok = bloom.passes_array(bits, w.keys(w.place[new]).view(np.int64))
                w.keep(ok[np.cumsum(new) - 1])
        yield batch, w


def occurrences(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """k1, k2 (together a window's hash), doc_id and place of windows of `size` words that may repeat between documents.

    All windows that do repeat are among them; filters let some others pass. place holds a hash of the text in its upper 31
    bits, which tells rows with one doc_id apart, and the first word's place in its lower 32. Rows without a doc_id are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    source = source.withColumn("tie", F.xxhash64("text").bitwiseAND(0x7FFFFFFF))
    filters: list = []
    held = False

    for length in lengths(size):
        so_far, listed = list(filters), held

        def anchors(batches, so_far=so_far, listed=listed, length=length):
            for batch, w in _sliced(batches, size, [(n, b and b.value) for n, b in so_far], listed):
                if length > w.level:
                    w.extend(length)
                if len(w.row):
                    new = w.runs()
                    end = np.append(np.flatnonzero(new)[1:], len(w.row)) - 1
                    row, first = w.row[new], w.first[new] - w.at[w.row[new]]
                    key = w.keys(w.place[new]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(row)), batch.column(2).take(pa.array(row)), pa.array(first), pa.array(w.first[end] - w.at[w.row[end]])], names=["h", "doc_id", "tie", "low", "high"])

        found = source.mapInArrow(anchors, "h long, doc_id long, tie long, low long, high long")
        again = written(found.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h"), "level")
        many = again.count()
        if many <= FILTERED_KEYS:
            filters.append((length, spark.sparkContext.broadcast(bloom.build(again, "h"))))
            if not many:
                break
            continue
        places = F.expr("flatten(collect_list(sequence(cast(low as int), cast(high as int))))")
        alive = written(found.join(again, "h").groupBy("doc_id", "tie").agg(F.array_sort(F.array_distinct(places)).alias("held")), "alive")
        source = source.select("doc_id", "text", "tie").join(alive, ["doc_id", "tie"]).select("doc_id", "text", "tie", "held")
        filters, held = [(length, None)], True

    def full(batches):
        for batch, w in _sliced(batches, size, [(n, b and b.value) for n, b in filters], held):
            if not len(w.row):
                continue
            k1 = mixed(runs_hashed(w.hashes, WORD_POWERS, w.first, w.first + size), 2)
            k2 = mixed(runs_hashed(w.hashes, CHECK_POWERS, w.first, w.first + size), 3)
            tie = np.asarray(batch.column(2))[w.row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1.view(np.int64), pa.int64()), pa.array((k2 >> np.uint64(32)).astype(np.uint32).view(np.int32), pa.int32()), batch.column(0).take(pa.array(w.row)), pa.array(tie << 32 | (w.first - w.at[w.row]), pa.int64())],
                names=["k1", "k2", "doc_id", "place"],
            )

    return source.mapInArrow(full, "k1 long, k2 int, doc_id long, place long")


def _repeating(found: DataFrame) -> DataFrame:
    """Occurrences whose window starts in more than one document, with the least of these as `least`.

    The repeated windows are written first: both sides of the join are then plain exchanges, whose hot keys Spark can split.
    """
    first = found.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    return found.join(written(first, "repeats"), ["k1", "k2"])


def repeated(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, tie (a hash of the text) and positions: the first words, ascending, of all windows of `size` words that also start in
    a document with a smaller doc_id. Documents without such windows give no row, nor does a null doc_id."""
    again = _repeating(occurrences(docs, size)).where("doc_id > least")
    return again.groupBy("doc_id", F.shiftright("place", 32).alias("tie")).agg(F.array_sort(F.collect_set(F.col("place").bitwiseAND(0xFFFFFFFF).cast("int"))).alias("positions"))


def longest_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, position and length of windows of size, 2 size, 4 size ... words that start in more than one document too.

    For each place the longest such window alone. Each level joins the level below with itself, at a distance of its
    length, and is a written table; an empty level ends the doubling. Rows as in occurrences().
    """
    level = written(_repeating(occurrences(docs, size)).select("k1", "k2", "doc_id", "place"), "level")
    out, length = None, size
    while level.take(1):
        left, right = level.alias("l"), level.alias("r")
        pair = left.join(right, (F.col("l.doc_id") == F.col("r.doc_id")) & (F.col("l.place") + length == F.col("r.place")))
        k1 = F.xxhash64("l.k1", "l.k2", "r.k1", "r.k2")
        k2 = F.hash("r.k2", "r.k1", "l.k2", "l.k1")
        longer = written(_repeating(pair.select(k1.alias("k1"), k2.alias("k2"), F.col("l.doc_id").alias("doc_id"), F.col("l.place").alias("place"))).select("k1", "k2", "doc_id", "place"), "level")
        final = level.join(longer.select("doc_id", "place").distinct(), ["doc_id", "place"], "left_anti")
        final = final.select("doc_id", F.col("place").bitwiseAND(0xFFFFFFFF).cast("int").alias("position"), F.lit(length).alias("length"))
        out = final if out is None else out.unionByName(final)
        level, length = longer, 2 * length
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, position int, length int")


def covered(positions: np.ndarray, size: int, n_words: int) -> np.ndarray:
    """Which of a document's words a window covers."""
    step = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(step, positions, 1)
    np.subtract.at(step, positions + size, 1)
    return np.cumsum(step[:-1]) > 0


def deduplicated(docs: DataFrame, size: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the columns of `keep`, n_words, n_removed, removed (ranges of words) and kept_text.

    Removes each word that a window of `size` words covers whose words, in their order, also start in a document with a
    smaller doc_id. kept_text is the text without the removed words and the space after each, so a text that loses nothing
    is unchanged; null counts as empty. Every row gives a row. A row whose doc_id is null loses nothing and takes nothing
    from others; of rows with one doc_id, none takes from another.
    """
    marks = written(repeated(docs, size), "marks")
    keep = keep or []
    if clash := {"doc_id", "text", "n_words", "n_removed", "removed", "kept_text", "kept_words", "positions", "_tie", "_key", "_may", "_block", "_bits"} & set(keep):
        raise ValueError(f"{sorted(clash)} can't be kept beside the columns of the result")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(f"`{c}`") for c in keep), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("_tie", F.xxhash64("text").bitwiseAND(0x7FFFFFFF))
    # Texts without marks pass a filter and stay where they are; the others meet their marks by a join.
    blocks = bloom.blocks_for(marks.count())
    listed = bloom.table(marks.select(F.xxhash64("doc_id", "tie").alias("k")), "k", blocks)
    source = bloom.marked(source.withColumn("_key", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "_tie"))), "_key", listed, blocks, "_may").drop("_key")
    marked = source.where("_may").drop("_may").join(marks.withColumnRenamed("tie", "_tie"), ["doc_id", "_tie"], "left")
    marked = marked.select(*(F.col(f"`{c}`") for c in source.columns if c != "_may"), "positions")
    source = marked.unionByName(source.where("not _may").drop("_may").withColumn("positions", F.lit(None).cast("array<int>"))).drop("_tie")
    names = ["doc_id", *keep]
    schema = source.select(*names, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("removed"), F.lit("").alias("kept_text"), F.lit("").alias("kept_words")).schema
    for f in schema:
        f.nullable = True

    def run(batches):
        for batch in slices(batches):
            raw, bounds = utf8(batch)
            starts, ends, at = words(raw, bounds)
            texts, plain, removed, spans = [], [], [], []
            marks = batch.column(batch.schema.get_field_index("positions"))
            for i in range(len(bounds) - 1):
                a, b = at[i], at[i + 1]
                s, e = starts[a:b], ends[a:b]
                text = raw[bounds[i] : bounds[i + 1]]
                gone = np.zeros(b - a, dtype=bool)
                if marks[i].is_valid:
                    gone = covered(np.array(marks[i].values.to_numpy(), dtype=np.int64), size, b - a)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                    drop = np.zeros(len(text) + 1, dtype=np.int8)
                    end = np.append(s[1:], bounds[i + 1]) - bounds[i]
                    drop[s[gone] - bounds[i]] += 1
                    np.subtract.at(drop, end[gone], 1)
                    text = text[np.cumsum(drop[:-1]) == 0]
                else:
                    spans.append([])
                removed.append(int(gone.sum()))
                texts.append(text.tobytes())
                plain.append(_joined(raw, s[~gone], e[~gone]))
            fields = [pa.array(np.diff(at), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(plain, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *fields], names=[*names, "n_words", "n_removed", "removed", "kept_text", "kept_words"])

    return source.mapInArrow(run, schema)


def _joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words between single spaces."""
    if not len(starts):
        return b""
    length = ends - starts
    new = np.cumsum(length + 1) - length - 1
    flat = np.full(int(new[-1] + length[-1]), 0x20, dtype=np.uint8)
    step = np.repeat(starts - new, length)
    place = np.arange(len(step)) + np.repeat(np.arange(len(starts)), length)
    flat[place] = raw[place + step]
    return flat.tobytes()
