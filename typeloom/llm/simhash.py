"""SimHash fingerprints, a Gray-order hierarchical index that links close ones, and their components.

Distinct fingerprints meet in buckets: two that differ in at most d bits are equal in at least one of d + 1 bands. A
bucket that is still large is dealt again by bands of its other bits, which loses no link. A task sorts its
fingerprints by bucket and Gray rank and builds an index over that order: each node keeps the bits that all below it
share. Pairs of nodes are followed downwards and dropped, with all below them, as soon as their shared bits differ in
more than d places. A task emits no pairs but the edges of a spanning forest of its links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship, slices, utf8, words, written

SHINGLE, SEED, BITS = 4, 42, 4

#: Fingerprints of a bucket above which it is dealt again, up to DEPTH times.
BUCKET = 20_000
DEPTH = 3

#: Children of an index node, and node pairs followed at a time.
FAN, FRONT = 16, 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints_of(raw: np.ndarray, bounds: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text: words joined by single spaces, A-Z lower-cased, XXH64 of its shingles with their repeats."""
    from xxhash import xxh64_intdigest

    starts, ends, at = words(raw, bounds)
    out = np.zeros(len(bounds) - 1, dtype=np.uint64)
    if not len(starts):
        return out
    length = ends - starts
    new = np.cumsum(length + 1) - length - 1
    held = np.zeros(len(raw) + 1, dtype=bool)
    delta = np.zeros(len(raw) + 1, dtype=np.int8)
    delta[starts] += 1
    np.subtract.at(delta, ends, 1)
    held = np.cumsum(delta[:-1], dtype=np.int8).astype(bool)
    flat = np.full(int(new[-1] + length[-1]), 0x20, dtype=np.uint8)
    place = np.flatnonzero(held) + np.repeat(new - starts, length)
    flat[place] = _LOWER[raw[held]]
    text = flat.tobytes()
    count = np.diff(at)
    many = np.maximum(count - shingle + 1, np.minimum(count, 1))  # shingles of each document
    first = np.repeat(at[:-1] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    last = np.minimum(first + shingle, np.repeat(at[1:], many)) - 1
    bounds_of = zip(new[first].tolist(), (new[last] + length[last]).tolist(), strict=True)
    h = np.array([xxh64_intdigest(text[a:b], SEED) for a, b in bounds_of], dtype=np.uint64)
    bits = np.unpackbits(h.view(np.uint8)).reshape(-1, 64)
    some = np.flatnonzero(many)
    sums = np.add.reduceat(bits, (np.cumsum(many) - many)[some], axis=0, dtype=np.int64)
    out[some] = np.packbits(sums * 2 > many[some, None], axis=1).view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, a signed 64-bit fingerprint. Every row gives a row; no words (null, empty, blank): 0."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(*utf8(batch), shingle).view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bands(bits: list[int], n: int) -> list[list[int]]:
    return [b.tolist() for b in np.array_split(np.array(bits, dtype=int), n)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def gray_rank(fp: str) -> str:
    """SQL for the rank of a fingerprint in Gray order: the number whose Gray code it is."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = f"({fp} ^ shiftrightunsigned({fp}, {shift}))" if shift == 1 else f"transform(array({fp}), x -> x ^ shiftrightunsigned(x, {shift}))[0]"
    return fp


class Forest:
    """Components of what has been linked so far, each named by its least member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.parent[a], self.parent[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                break
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.parent[self.parent]
                if np.array_equal(up, self.parent):
                    break
                self.parent = up


def linked(fp: np.ndarray, key: np.ndarray, most: int) -> np.ndarray:
    """For fingerprints sorted by key and Gray rank: each one's least member in the components of links within a key."""
    n = len(fp)
    forest = Forest(n)
    levels = [(fp, fp, key, key)]  # and, or, least key, greatest key of each node
    while len(levels[-1][0]) > 1:
        a, o, low, high = levels[-1]
        at = np.arange(0, len(a), FAN)
        levels.append((np.bitwise_and.reduceat(a, at), np.bitwise_or.reduceat(o, at), low[at], high[np.minimum(at + FAN, len(a)) - 1]))
    stack = [(len(levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    inner = np.arange(FAN)
    left, right = (x.ravel() for x in np.meshgrid(inner, inner, indexing="ij"))
    while stack:
        level, i, j = stack.pop()
        if level == 0:
            forest.link(i, j)
            continue
        if len(i) * FAN * FAN > FRONT and len(i) > 1:
            half = len(i) // 2
            stack += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
            continue
        level -= 1
        a, o, low, high = levels[level]
        x, y = (i[:, None] * FAN + left).ravel(), (j[:, None] * FAN + right).ravel()
        ok = (y < len(a)) & (x < len(a)) & ((x < y) if level == 0 else (x <= y))
        x, y = x[ok], y[ok]
        ok = low[y] <= high[x]
        x, y = x[ok], y[ok]
        shared = ~((a[x] ^ o[x]) | (a[y] ^ o[y]))
        ok = np.bitwise_count((a[x] ^ a[y]) & shared) <= most
        if ok.any():
            stack.append((level, x[ok], y[ok]))
    return forest.parent


def links(distinct: DataFrame, most: int = BITS) -> DataFrame:
    """Edges (a, b) of fingerprints that join all pairs of the distinct, non-null column fp within `most` differing bits.

    Edges are a forest for each task, so there are at most (most + 1) a fingerprint, whatever the number of pairs.
    """
    spark = distinct.sparkSession
    ship(spark)
    paths: list[tuple[int, list[int]]] = [(sum(1 << b for b in band), [x for x in range(64) if x not in band]) for band in bands(list(range(64)), most + 1)]
    todo, done, start = distinct.select("fp", F.explode(F.array(*map(F.lit, range(len(paths))))).alias("path")), None, 0

    def keyed(rows, masks, first):
        held = F.expr(f"element_at(array({', '.join(f'{_signed(m)}L' for m in masks)}), path - {first} + 1)")
        return rows.withColumn("key", F.xxhash64("path", F.col("fp").bitwiseAND(held)))

    for depth in range(DEPTH):
        rows = keyed(todo, [m for m, _ in paths], start)
        if depth == DEPTH - 1:
            done = rows if done is None else done.unionByName(rows)
            break
        large = rows.groupBy("key").count().where(F.col("count") > BUCKET).select("key")
        large = written(large, "large")
        if not large.take(1):
            done = rows if done is None else done.unionByName(rows)
            break
        fits = rows.join(large, "key", "left_anti")
        done = fits if done is None else done.unionByName(fits)
        after = start + len(paths)
        deeper = [(mask | sum(1 << b for b in band), [x for x in rest if x not in band]) for mask, rest in paths for band in bands(rest, most + 1)]
        todo = rows.join(large, "key", "left_semi").select("fp", F.explode(F.expr(f"transform(sequence(0, {most}), i -> {after} + (path - {start}) * {most + 1} + i)")).alias("path"))
        paths, start = deeper, after

    sorted_ = done.select("key", "fp").repartition("key").sortWithinPartitions("key", F.expr(gray_rank("fp")))

    def run(batches):
        held, many = [], 0

        def edges(k, f):
            parent = linked(f, k, most)
            low = np.flatnonzero(parent != np.arange(len(f)))
            return pa.RecordBatch.from_pydict({"a": f[parent[low]].view(np.int64), "b": f[low].view(np.int64)})

        def joined():
            return (np.concatenate([h[i] for h in held]) for i in range(2))

        for batch in batches:
            key, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if many >= 100_000 and len(key) and (key[0] != held[-1][0][-1] or key[-1] != key[0]):
                whole = np.searchsorted(key, held[-1][0][-1], side="right")  # the last key's rows end in this batch
                held.append((key[:whole], fp[:whole]))
                yield edges(*joined())
                held, many, key, fp = [], 0, key[whole:], fp[whole:]
            if len(key):
                held.append((key, fp))
                many += len(key)
        if held:
            yield edges(*joined())

    return sorted_.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for every node but the roots of edges (a, b).

    Rounds of large and small stars: every node's neighbours are led to the least node among them, until nothing
    changes. A round's minima are pre-aggregated; its edges are a written table.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written before they are joined: the other side is then a plain exchange, whose hot keys Spark can split.
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "stars")
        small = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(small, "u")
        edges = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(edges, "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now


def near_duplicates(docs: DataFrame, most: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links of `most` or fewer differing bits.

    A row for every row of docs. Texts without words have fingerprint 0 and link like any other. A null doc_id gets its
    component's id like its companions, and null only if none of them has an id. Other columns of docs are not read.
    """
    table = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), most))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(named, "named")
    ids = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    members = named.join(ids, "root").select("fp", "component_id")
    return table.join(members, "fp").select("doc_id", "fp", "component_id")
