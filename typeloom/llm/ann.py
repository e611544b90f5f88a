"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are grown on the driver over a bounded sample and sent to all tasks; every row is placed in a leaf of each tree.
A query walks all trees through one priority queue and takes leaves in the order of how unlikely the sides are that lead
to them, until they hold a share of the sample. How large a share finds enough of the true neighbours is measured on the
sample itself, so that vectors with more structure are compared with fewer rows. A row's vector lies in one place alone, a
cell of the first tree, with its leaves of all trees beside it. Which leaves occur in which cell is known from all rows, so
a query goes to those cells that hold a row of a leaf it chose, as a bit for each leaf. There it is compared with these
rows, once each, however many of the trees lead to them; the nearest are reranked by exact distances and passed on alone.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship, written

#: Distinct vectors that trees are grown over, at most (those that hash lowest); trees; sample rows of a leaf, at most.
SAMPLE_ROWS, TREES, LEAF = 20_000, 6, 12

#: Leaves are taken until they hold so many sample rows that this share of true neighbours is found within the sample, as
#: measured with so many of its rows, but never fewer than LEAST rows of it.
RECALL, TRIED, LEAST = 0.95, 64, 2_000

#: Rows that a task compares with queries at a time, as estimated from the sample; cells hold fewer, or are one leaf, dealt over
#: blocks. Cells and leaves are bounded by the sample, and so is the table of which leaves occur in which cell.
BLOCK = 4096

#: Queries and exact distances that a task handles at a time.
ASKED, EXACT = 512, 1 << 15

SEED = 42

#: Slope by which a logistic curve comes closest to the normal one.
SLOPE = 1.702


@dataclass
class Forest:
    """Inner nodes of all trees: a normal, an offset, the spread about it and two children; a child below 0 is leaf -1 - child.
    Leaves count through all trees, with the number of sample rows that each holds; cells are runs of leaves of the first tree,
    whose leaves come first."""

    normals: np.ndarray
    offsets: np.ndarray
    spreads: np.ndarray
    children: np.ndarray
    roots: list[int]
    held: np.ndarray
    cell: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        """Each vector's leaf in each tree."""
        out = np.empty((len(x), len(self.roots)), dtype=np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while len(go := np.flatnonzero(at >= 0)):
                node = at[go]
                right = (np.einsum("ij,ij->i", x[go], self.normals[node]) >= self.offsets[node]).astype(int)
                at[go] = self.children[node, right]
            out[:, t] = -1 - at
        return out

    def search(self, q: np.ndarray, rows: int) -> list[int]:
        """Leaves in the order of the shared queue, until they hold so many sample rows.

        A node's cost is the sum, over the way to it, of minus the logarithm of how likely a near point lies on that side.
        """
        side = SLOPE * (self.normals @ q - self.offsets) / self.spreads if len(self.normals) else self.offsets
        left, right = np.logaddexp(0, side).tolist(), np.logaddexp(0, -side).tolist()
        children, held = self.children.tolist(), self.held.tolist()
        queue, found, n = [(0.0, r) for r in self.roots], [], 0
        heapq.heapify(queue)
        while queue and n < rows:
            cost, at = heapq.heappop(queue)
            if at < 0:
                found.append(-1 - at)
                n += held[-1 - at]
            else:
                a, b = children[at]
                heapq.heappush(queue, (cost + left[at], a))
                heapq.heappush(queue, (cost + right[at], b))
        return found


def grow(sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, cell: int = BLOCK, seed: int = SEED) -> Forest:
    """Projects a node's points on a line between the half that is near a random one of them and the rest, and splits them there
    by the median; by one along a random line where that does not part them. The first tree's subtrees of at most `cell` points are
    cells."""
    rng = np.random.default_rng(seed)
    normals, offsets, spreads, children, roots, held, cells = [], [], [], [], [], [], []
    count = 0

    def split(x: np.ndarray):
        near = x @ x[rng.integers(len(x))]
        close = near >= np.median(near)
        lines = [x[close].mean(axis=0) - x[~close].mean(axis=0)] if not close.all() else []
        for normal in [*lines, rng.standard_normal(x.shape[1])]:
            if (norm := np.linalg.norm(normal)) > 0:
                normal = normal / norm
                z = x @ normal
                offset = float(np.median(z))
                for side in (z >= offset, z > offset):
                    if side.any() and not side.all():
                        return normal, offset if side[z == offset].all() else float(np.nextafter(offset, np.inf)), z.std(), side
        return None

    def node(rows: np.ndarray, own: int) -> int:
        nonlocal count
        if own < 0 and len(rows) <= cell:
            own, count = count, count + 1
        parted = split(sample[rows]) if len(rows) > leaf else None
        if parted is None:
            if own < 0:
                own, count = count, count + 1
            held.append(len(rows))
            if not roots:
                cells.append(own)
            return -len(held)
        normal, offset, spread, side = parted
        at = len(normals)
        normals.append(normal), offsets.append(offset), spreads.append(max(spread, 1e-12)), children.append([0, 0])
        children[at] = [node(rows[~side], own), node(rows[side], own)]
        return at

    for _ in range(trees):
        roots.append(node(np.arange(len(sample)), -1))
    dim = sample.shape[1]
    return Forest(np.array(normals).reshape(-1, dim), *(np.array(x, dtype=float) for x in (offsets, spreads)), np.array(children, dtype=np.int64).reshape(-1, 2), roots, *(np.array(x, dtype=np.int64) for x in (held, cells)))


def share(forest: Forest, sample: np.ndarray, k: int, recall: float = RECALL, tried: int = TRIED) -> int:
    """Sample rows that leaves need to hold so that a search finds the share `recall` of the k nearest within the sample."""
    n = len(sample)
    if n <= k + 1:
        return n * len(forest.roots)
    of = np.linspace(0, n - 1, min(tried, n)).astype(int)
    leaves, need = forest.place(sample), []
    norms = (sample * sample).sum(axis=1)
    for i in of:
        d = norms - 2 * sample @ sample[i]
        d[i] = np.inf
        order = forest.search(sample[i], n * len(forest.roots))
        upto = np.zeros(len(forest.held), dtype=np.int64)
        upto[order] = np.cumsum(forest.held[order])
        need.append(upto[leaves[np.argpartition(d, k - 1)[:k]]].min(axis=1))
    return max(LEAST, int(np.quantile(np.concatenate(need), recall)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim).astype(np.float64)


def nearest_of(q: np.ndarray, chosen: np.ndarray, x: np.ndarray, leaves: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places among q and x, and exact distances, of the k rows of its chosen leaves that are nearest to each query, ties by ids.

    chosen: for each query, whether it chose each leaf. leaves: each row's leaf in each tree.
    """
    wanted = np.zeros((len(q), len(x)), dtype=bool)
    for leaf in leaves.T:
        wanted |= chosen[:, leaf]
    some = np.flatnonzero(wanted.any(axis=0))
    x, ids, wanted = x[some], ids[some], wanted[:, some]
    norms = (x * x).sum(axis=1)
    rough = np.where(wanted, norms - 2 * q @ x.T, np.inf)
    if len(x) > k:
        last = np.partition(rough, k - 1, axis=1)[:, k - 1]
        last = last + 1e-9 * (norms.max() + (q * q).sum(axis=1))  # what rounding may have put behind it
        at, to = np.nonzero((rough <= last[:, None]) & (rough < np.inf))
    else:
        at, to = np.nonzero(wanted)
    far = np.concatenate([np.zeros(0), *(np.sqrt(((x[to[i : i + EXACT]] - q[at[i : i + EXACT]]) ** 2).sum(axis=1)) for i in range(0, len(at), EXACT))])
    order = np.lexsort((ids[to], far, at))
    at, to, far = at[order], to[order], far[order]
    ok = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[ok], some[to[ok]], far[ok]


def occupied(placed: DataFrame, leaves: int, cells: int) -> np.ndarray:
    """For each cell, a bit for each leaf of any tree that one of the cell's rows lies in. Its size is bounded by the sample."""
    found = placed.select("cell", F.explode("leaves").alias("leaf")).distinct().groupBy("cell").agg(F.collect_list("leaf").alias("leaves"))

    def packed(batches):
        for batch in batches:
            bits = np.zeros((batch.num_rows, leaves), dtype=bool)
            bits[np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy()), batch.column(1).flatten().to_numpy()] = True
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in np.packbits(bits, axis=1)], pa.binary())], names=["cell", "bits"])

    out = np.zeros((cells, (leaves + 7) // 8), dtype=np.uint8)
    for row in found.mapInArrow(packed, "cell long, bits binary").collect():
        out[row["cell"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v of the rows that take part: an id, and a vector that is not null or zero, with no null or non-finite
    component and of the most frequent length (of equally frequent lengths the smallest)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where("vec_id is not null and v is not null")
    v = v.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    dims = v.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return v.where(F.size("v") == (dims.dim if dims else -1))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance in double precision) of each query's k nearest found.

    Queries are the usable rows whose vec_id is divisible by `every`, candidates all usable rows but the query's own, ties go
    to the smaller vec_id. Equal vectors are searched once: a vector stands for its k + 1 smallest ids, which no result can go
    beyond. Rows with one id are told apart only by their vectors. Other columns are not read. No usable rows: no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors)
    out = "query_id long, rank int, vec_id long, score double"
    ranked = rows.distinct().withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    distinct = ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = written(distinct.select(F.monotonically_increasing_id().alias("class"), "v", "ids"), "vectors")
    n = classes.count()
    head = classes.orderBy(F.xxhash64("v"), "class").limit(SAMPLE_ROWS).select("v").toArrow()
    if not head.num_rows:
        return spark.createDataFrame([], out)
    first = head.column("v").combine_chunks()
    dim = len(first[0])
    sample = _matrix(first, dim)
    each = n / len(sample)
    forest = grow(sample, trees, cell=max(LEAF, int(BLOCK / each)))
    enough = share(forest, sample, min(k, max(1, len(sample) - 1)), recall)
    blocks = np.maximum(1, np.ceil(np.bincount(forest.cell, forest.held[: len(forest.cell)]) * each / BLOCK)).astype(np.int64)
    sent = spark.sparkContext.broadcast((forest, blocks))
    kind = classes.schema["v"].dataType.simpleString()
    fields = f"cell long, block long, class long, v {kind}, least long, leaves array<int>"

    def index(batches):
        forest, blocks = sent.value
        for batch in batches:
            if batch.num_rows:
                leaf = forest.place(_matrix(batch.column(1), dim))
                cell = forest.cell[leaf[:, 0]]
                block = batch.column(0).to_numpy() % blocks[cell]
                leaves = pa.ListArray.from_arrays(pa.array(np.arange(0, leaf.size + 1, leaf.shape[1]), pa.int32()), pa.array(leaf.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(block), *batch.columns, leaves], names=["cell", "block", "class", "v", "least", "leaves"])

    wanted = rows.where(F.pmod("vec_id", F.lit(every)) == 0).distinct()
    named = [F.xxhash64("v").alias("_x"), F.hash("v").alias("_h")]  # 96 bits of hash for a vector, which joins without it
    asked = written(wanted.select("*", *named).join(classes.select("class", *named), ["_x", "_h"]).select("vec_id", "class", "v"), "queries")
    queries = asked.groupBy("class").agg(F.first("v").alias("v")).repartition(spark.sparkContext.defaultParallelism)
    placed = written(classes.select("class", "v", F.col("ids")[0].alias("least")).mapInArrow(index, fields), "placed")
    where = spark.sparkContext.broadcast(occupied(placed, len(forest.held), len(blocks)))

    def search(batches):
        (forest, blocks), occupied = sent.value, where.value
        for batch in batches:
            for i in range(batch.num_rows):
                chosen = np.zeros(len(forest.held), dtype=bool)
                chosen[forest.search(_matrix(batch.column(1).slice(i, 1), dim)[0], enough)] = True
                bits = occupied & np.packbits(chosen)
                cell = np.flatnonzero(bits.any(axis=1))
                many = blocks[cell]
                cells = np.repeat(cell, many)
                block = np.arange(len(cells)) - np.repeat(np.cumsum(many) - many, many)
                same = pa.array(np.full(len(cells), i))
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(block), *(batch.column(j).take(same) for j in (0, 1)), pa.array([bits[c].tobytes() for c in cells], pa.binary())], names=["cell", "block", "class", "v", "chosen"])

    asks = queries.mapInArrow(search, f"cell long, block long, class long, v {kind}, chosen binary")
    both = placed.unionByName(asks, allowMissingColumns=True).select("cell", "block", "class", "v", "least", "leaves", "chosen")
    both = both.repartition("cell", "block").sortWithinPartitions("cell", "block", F.col("chosen").isNotNull())

    def compare(batches):
        own, held, x = None, [], None
        for batch in batches:
            cell, block = (batch.column(i).to_numpy() for i in range(2))
            asks = batch.column(6).is_valid().to_numpy(zero_copy_only=False)
            edge = np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0) | np.diff(asks)) + 1
            for a, b in zip([0, *edge], [*edge, len(cell)], strict=True):
                if b == a:
                    continue
                if own != (key := (cell[a], block[a])):
                    own, held, x = key, [], None
                part = batch.slice(a, b - a)
                if not asks[a]:
                    held.append((_matrix(part.column(3), dim), part.column(5).flatten().to_numpy().reshape(b - a, -1), part.column(2).to_numpy(), part.column(4).to_numpy()))
                    continue
                if not held:
                    continue
                if x is None:
                    x, leaves, names, ids = (np.concatenate(y) for y in zip(*held, strict=True))
                for c in range(0, part.num_rows, ASKED):
                    some = part.slice(c, ASKED)
                    bits = np.frombuffer(b"".join(some.column(6).to_pylist()), dtype=np.uint8).reshape(some.num_rows, -1)
                    chosen = np.unpackbits(bits, axis=1).view(bool)
                    at, to, far = nearest_of(_matrix(some.column(3), dim), chosen, x, leaves, ids, k + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(some.column(2).to_numpy()[at]), pa.array(names[to]), pa.array(ids[to]), pa.array(far)], names=["query", "class", "least", "score"])

    best = both.mapInArrow(compare, "query long, class long, least long, score double")
    best = best.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy("score", "least"))).where(F.col("_n") <= k + 1)
    best = best.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    answers = best.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k + 1).alias("near"))
    own = asked.join(answers, asked["class"] == answers["query"]).select(F.col("vec_id").alias("query_id"), "near")
    own = own.groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
    own = own.select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("rank", "x"))
    return own.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
