"""Near-duplicates by the Jaccard similarity of documents' sets of word shingles.

Documents with one set are one class. Classes meet where the Gray-order index of SimHash fingerprints joins them by a chain
of links of at most BITS differing bits, so that no pair within those bits is lost. Similar sets may differ in more bits
than an index can search; for these, classes meet too where all ROWS minima of one of BANDS bands of a MinHash signature
agree: two with a similarity of 0.8 meet there but for about 3 in a million pairs, and more similar ones more surely. Pairs
that meet count only if their sets, compared whole, are similar enough. Neighbours within a bucket are compared first;
then, within a task, all pairs of a bucket that this has not brought into one component. No table of all pairs is made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import mixed, ship, slices, utf8, word_hashes, words, written
from .simhash import _LOWER, Forest, components, fingerprints_of, links

#: Words of a shingle; similarity from which documents are near-duplicates, in tenths.
SHINGLE, TENTHS = 5, 8

#: Differing bits of 64 within which fingerprints link.
BITS = 8

BANDS, ROWS = 32, 5

#: Members of a bucket, and shingles of their sets, that a task compares at a time; larger buckets are compared block by block.
BLOCK, BLOCK_SHINGLES = 1500, 2_000_000

#: Shingles whose owners are multiplied at a time.
COLUMNS = 1024

_FACTORS = mixed(np.arange(BANDS * ROWS, dtype=np.uint64), 11) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, ascending, and each text's bounds in them.

    Words are joined by single spaces and A-Z is lower-cased; a text of fewer words is one shingle, one without words none.
    """
    starts, ends, at = words(raw, bounds)
    h = word_hashes(_LOWER[raw], starts, ends)
    count = np.diff(at)
    many = np.maximum(count - shingle + 1, np.minimum(count, 1))
    begin = np.cumsum(many) - many
    first = np.repeat(at[:-1] - begin, many) + np.arange(many.sum())
    width = np.repeat(np.minimum(count, shingle), many)
    all_ = h[first]
    for i in range(1, shingle):
        longer = np.flatnonzero(width > i)
        all_[longer] = mixed(all_[longer] * _STEP + h[first[longer] + i])
    sets = [np.unique(all_[a : a + n]) for a, n in zip(begin.tolist(), many.tolist(), strict=True)]
    return (np.concatenate(sets) if sets else all_), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def signatures(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set's class, a hash of the set, and its bands' keys; a set without shingles has keys that meet its like alone."""
    n = len(bounds) - 1
    some = np.flatnonzero(np.diff(bounds))
    sums = np.zeros(n, dtype=np.uint64)
    least = np.zeros((n, BANDS * ROWS), dtype=np.uint64)
    if len(some):
        sums[some] = np.add.reduceat(mixed(sets, 3), bounds[some])
        for i, factor in enumerate(_FACTORS):
            least[some, i] = np.minimum.reduceat(sets * factor, bounds[some])
    keys = np.tile(mixed(np.arange(BANDS, dtype=np.uint64), 5), (n, 1))
    for i in range(ROWS):
        keys = mixed(keys * _STEP + least[:, i::ROWS])
    return mixed(sums + np.diff(bounds).astype(np.uint64)), keys


def signed(docs: DataFrame) -> DataFrame:
    """docs with _row, which tells rows apart, _class, _size (shingles of the set), _print (SimHash) and _keys, as a written table."""
    ship(docs.sparkSession)
    rows = docs.withColumn("text", F.col("text").cast("string")).withColumn("_row", F.monotonically_increasing_id())
    names = [*rows.columns, "_class", "_size", "_print", "_keys"]

    def run(batches):
        for batch in slices(batches):
            text = utf8(batch)
            sets, bounds = shingle_sets(*text)
            kind, keys = signatures(sets, bounds)
            prints = pa.array(fingerprints_of(*text, SHINGLE).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind.view(np.int64)), pa.array(np.diff(bounds)), prints, lists], names=names)

    longs = [F.lit(0).cast("long").alias(name) for name in ("_class", "_size", "_print")]
    schema = rows.select("*", *longs, F.expr("cast(array() as array<bigint>)").alias("_keys")).schema
    for f in schema:
        f.nullable = True
    return written(rows.mapInArrow(run, schema), "signed")


def by_prints(table: DataFrame) -> DataFrame:
    """class, size and key of signed rows: one key for the classes that a chain of links between fingerprints joins.

    A class is in the group of each of its rows' fingerprints, which count repeats where sets do not.
    """
    prints = written(table.select("_class", "_size", "_print").distinct(), "prints")
    distinct = written(prints.select(F.col("_print").alias("fp")).distinct(), "distinct")
    roots = components(links(distinct, BITS))
    grouped = prints.join(roots, prints["_print"] == roots["node"], "left")
    return grouped.select(F.col("_class").alias("class"), F.col("_size").alias("size"), F.xxhash64(F.lit("print"), F.coalesce("root", "_print")).alias("key")).distinct()


def by_bands(table: DataFrame) -> DataFrame:
    """class, size and key of signed rows, one a class: a key for each band."""
    return table.select(F.col("_class").alias("class"), F.col("_size").alias("size"), F.explode("_keys").alias("key"))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) of classes whose sets, as rows of class and set, are similar enough."""
    one, two = (sets.select(F.col("class").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", (F.size("set_a") + F.size("set_b")).alias("n"), F.size(F.array_intersect("set_a", "set_b")).alias("common"))
    return both.where((10 + TENTHS) * F.col("common") >= TENTHS * F.col("n")).select("a", "b")


def close(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of the sets are similar enough."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    owner, at = owner[times[at] > 1], at[times[at] > 1]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], np.cumsum(np.diff(at[order], prepend=-1) != 0) - 1
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        a, b = np.searchsorted(at, [low, low + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        held[owner[a:b], at[a:b] - low] = 1
        common += held @ held.T
    return (10 + TENTHS) * common.astype(np.int64) >= TENTHS * (size[:, None] + size[None, :])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with _row and _component, equal for documents that a chain of near-duplicates joins. A row for every row.

    Texts without words are near-duplicates of each other.
    """
    table = signed(docs)
    ship(docs.sparkSession)

    def reread(batches):
        for batch in slices(batches):
            sets, bounds = shingle_sets(*utf8(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sets.view(np.int64)))], names=["class", "set"])

    classes = table.groupBy("_class").agg(F.min("_row").alias("_row"))
    keyed = by_prints(table).unionByName(by_bands(table.join(classes.select("_row"), "_row", "left_semi")))
    within = Window.partitionBy("key")
    keyed = keyed.withColumn("before", F.lag(F.struct("class", "size")).over(within.orderBy("class"))).withColumn("after", F.lead("class").over(within.orderBy("class")))
    met = written(keyed.where("before is not null or after is not null"), "met")
    of_size = lambda a, b: 10 * F.least(a, b) >= TENTHS * F.greatest(a, b)
    members = met.select("class").distinct()
    reps = members.join(classes, members["class"] == classes["_class"]).select("_row")
    sets = written(table.join(reps, "_row", "left_semi").select("_class", "text").mapInArrow(reread, "class long, set array<bigint>"), "sets")
    tried = met.where(of_size(F.col("size"), F.col("before.size"))).select(F.col("before.class").alias("a"), F.col("class").alias("b")).distinct()
    edges = written(similar(tried, sets), "near")

    roots = components(edges)
    placed = met.join(roots, met["class"] == roots["node"], "left").select("key", "class", "size", F.coalesce("root", "class").alias("root"))
    placed = written(placed, "placed")
    split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("sizes"))
    split = split.where("low <> high").select("key", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("sizes") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = placed.join(split, "key").withColumn("i", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.expr("sequence(0, greatest(blocks, 1) - 1)")))
    dealt = dealt.select("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "class", "root").join(sets, "class")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        kind, root = group["class"].to_numpy(), group["root"].to_numpy()
        x, y = np.nonzero(np.triu(close(group["set"].tolist()), 1) & (root[:, None] != root[None, :]))
        _, at = np.unique(root, return_inverse=True)
        forest = Forest(len(kind))
        forest.link(at[x], at[y])
        names = np.zeros(len(kind), dtype=np.int64)
        names[at] = root
        low = np.flatnonzero(forest.parent != np.arange(len(kind)))
        return pd.DataFrame({"a": names[forest.parent[low]], "b": names[low]})

    more = written(dealt.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long").distinct(), "more")
    if more.take(1):
        roots = components(edges.unionByName(more))
    out = table.drop("_size", "_print", "_keys").join(roots, table["_class"] == roots["node"], "left")
    return out.select(*docs.columns, "_row", F.coalesce("root", "_class").alias("_component"))
