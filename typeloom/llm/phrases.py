"""Phrases whose words stand together more often than their parts would have it, from vertical positional inverted lists.

Text is cut into blocks of pieces. A block's inverted file holds each of its words' ascending positions; positions leave a gap
between pieces, so that neighbouring positions are neighbouring words of one piece. A list is extended by merging it with the
list of what stands one place later: words give pairs, and pairs that are frequent give triples. The length of a list, summed
over all blocks, is a phrase's exact frequency. Blocks are bounded, so a task never holds more than one of them, however
frequent a word or long a text is; what is shuffled are counts by block, so a frequent phrase has one row a block.

Words go by 64-bit hashes from block to block. The hashes of all words are compared with the words themselves; should two words
share one, all is done again with another seed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BYTE_CODES, BYTE_POWERS, Powers, forget_shuffles, mixed, runs_hashed, ship, slices, utf8, written

#: Bytes that end a piece, and those that separate words within it.
_ENDS, _GAPS = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAPS[[0x20, 0x09]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_OTHER_POWERS = Powers(0x9FB21C651E98DF25)

#: Words of a block, about; a piece that is longer makes a block of its own.
BLOCK_WORDS = 400_000

SCALE, LEAST, MOST_RANK, SHARE = 1_000_000, 10, 2000, 50
SEEDS = 8

_FILE = "block long, hashes binary, sizes binary, gaps binary, lang string, word string, n long"


def _words(batch: pa.RecordBatch):
    """(raw, starts, ends, positions from 0, two hashes, language codes, languages) of a batch's words. The hashes tell words apart
    within a block."""
    raw, bounds = utf8(batch)
    raw = _FOLD[raw]
    ends_piece = _ENDS[raw]
    inside = ~(ends_piece | _GAPS[raw])
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = bounds[(bounds > 0) & (bounds < len(raw))]
    first[edge], last[edge - 1] = inside[edge], inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(bounds, starts, side="right") - 1
    piece = np.cumsum(ends_piece)[starts] + row
    at = np.arange(len(starts)) + np.cumsum(np.append(0, np.diff(piece) > 0))[: len(starts)]
    langs = batch.column(1).dictionary_encode()
    names = [x or "" for x in langs.dictionary.to_pylist()]
    code = np.asarray(langs.indices, dtype=np.int64)[row]
    keys = mixed(np.array([xxhash.xxh64_intdigest(x.encode()) for x in names] or [0], dtype=np.uint64), 11)[code]
    codes, size = BYTE_CODES[raw], (ends - starts).astype(np.uint64)
    h = mixed(runs_hashed(codes, BYTE_POWERS, starts, ends) + size + keys)
    small = lambda x: x.astype(np.int32)
    return raw, small(starts), small(ends), small(at), h, mixed(runs_hashed(codes, _OTHER_POWERS, starts, ends) + size + keys, 5), small(code), names


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in an order that brings equal ones together, and where in it each run of equal ones begins."""
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    return order, np.flatnonzero(np.append(True, held[1:] != held[:-1]))


def _hash(seed: int) -> Column:
    """The hash of a row's lang and word that all blocks share."""
    return F.xxhash64(F.concat(F.lit(f"{seed}:"), F.length("lang").cast("string"), F.lit(":"), "lang", "word"))


def _hashed(seed: int, langs: list[str], words: list[bytes]) -> np.ndarray:
    """The same of many words."""
    front = {x: f"{seed}:{len(x)}:{x}".encode() for x in set(langs)}
    return np.array([xxhash.xxh64_intdigest(front[x] + w, 42) for x, w in zip(langs, words, strict=True)], dtype=np.uint64)


def inverted_files(docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each block's inverted file as a row (block, hashes, sizes and gaps: the words' hashes, the lengths of their lists, and all
    lists end to end, each as its first position and the differences after it), and a row (lang, word, n) for each of its words."""
    ship(docs.sparkSession)

    def run(batches):
        held, many, made = [], 0, 0
        task = TaskContext.get().partitionId() << 32

        def flush():
            nonlocal held, many, made
            h, other, size = (np.concatenate([x[i] for x in held]) for i in (0, 1, 2))
            step = np.cumsum([0] + [x[3][-1] + 2 for x in held[:-1]]).astype(np.int32)
            at = np.concatenate([x[3] + s for x, s in zip(held, step, strict=True)])
            where, part = np.concatenate([x[4] for x in held]), np.repeat(np.arange(len(held), dtype=np.int32), [len(x[0]) for x in held])
            code, raws, names = np.concatenate([x[6] for x in held]), [x[5] for x in held], [x[7] for x in held]
            held = []  # the parts of what has been joined are not needed any more
            order, new = _grouped(h)
            sizes, shown = np.diff(np.append(new, len(h))), order[new]
            if (other[order] != np.repeat(other[shown], sizes)).any():  # two words share the first hash: both tell them apart
                order, new = _grouped(np.unique(np.stack([h, other], axis=1), axis=0, return_inverse=True)[1].ravel())
                sizes, shown = np.diff(np.append(new, len(h))), order[new]
            gaps = np.diff(at[order], prepend=0)
            gaps[new] = at[shown]
            block, n = task | made, len(shown)
            texts = [raws[p][s : s + k].tobytes() for p, s, k in zip(part[shown].tolist(), where[shown].tolist(), size[shown].tolist(), strict=True)]
            langs = [names[p][c] for p, c in zip(part[shown].tolist(), code[shown].tolist(), strict=True)]
            raws = h = other = None
            hashes = _hashed(seed, langs, texts)
            none = lambda kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), none(pa.binary()), none(pa.binary()), none(pa.binary()), pa.array(langs, pa.string()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sizes)],
                names=_NAMES,
            )
            one = lambda x: pa.array([x], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), one(hashes.astype("<u8").tobytes()), one(sizes.astype("<i4").tobytes()), one(_planes(gaps)), *(pa.nulls(1, k) for k in (pa.string(), pa.string(), pa.int64()))],
                names=_NAMES,
            )
            many, made = 0, made + 1

        for batch in slices(batches):
            raw, starts, ends, at, h, other, code, names = _words(batch)
            cuts = [0, len(h)]
            if len(h) > block_words:  # one long text: cut where pieces end
                ends_of = np.flatnonzero(np.diff(at) > 1) + 1
                cuts = [0, *ends_of[np.append(True, np.diff(ends_of // block_words) > 0)].tolist(), len(h)] if len(ends_of) else cuts
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    held.append((h[a:b], other[a:b], (ends - starts)[a:b], at[a:b] - at[a], starts[a:b], raw, code[a:b], names))
                    many += b - a
                    if many >= block_words:
                        yield from flush()
        if held:
            yield from flush()

    return docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).mapInArrow(run, _FILE)


_NAMES = [x.split()[0] for x in _FILE.split(", ")]


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers with all their first bytes in front, then all second ones, and so on, which compresses well."""
    return x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _of_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, dtype=np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _pairs_of(hashes: bytes, sizes: bytes, gaps: bytes):
    """Words' hashes, and of all pairs in order of position: position, and local codes of their words in one number."""
    h, n = np.frombuffer(hashes, dtype="<u8"), np.frombuffer(sizes, dtype="<i4")
    gap, begin = _of_planes(gaps), np.cumsum(n) - n
    at = np.cumsum(gap, dtype=np.int64)
    at -= np.repeat(at[begin] - gap[begin], n)
    code = np.empty(int(at.max()) + 2, dtype=np.int32)  # lists merge by position: what stands at each place, -1 between pieces
    code.fill(-1)
    code[at] = np.repeat(np.arange(len(h), dtype=np.int32), n)
    place = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0))
    return h, code, place, code[place].astype(np.int64) << 32 | code[place + 1]


def pair_lists(files: DataFrame) -> DataFrame:
    """block, i (the pair's number in it), h1, h2 and n, the length of the pair's list there."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                h, _, _, key = _pairs_of(r["hashes"], r["sizes"], r["gaps"])
                pair, n = np.unique(key, return_counts=True)
                for a in range(0, len(pair), 1 << 16):
                    p, m = pair[a : a + (1 << 16)], n[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(p), r["block"])), pa.array(np.arange(a, a + len(p), dtype=np.int32)), pa.array(h[p >> 32].view(np.int64)), pa.array(h[p & 0xFFFFFFFF].view(np.int64)), pa.array(m.astype(np.int32))], names=["block", "i", "h1", "h2", "n"]
                    )

    return files.where("gaps is not null").select("block", "hashes", "sizes", "gaps").mapInArrow(run, "block long, i int, h1 long, h2 long, n int")


def triple_lists(files: DataFrame, frequent: DataFrame) -> DataFrame:
    """h1, h2, h3 and n in a block: lists of frequent pairs (block, i) merged with the words one place later, where these end a
    frequent pair themselves."""
    kept = frequent.groupBy("block").agg(F.collect_list("i").alias("kept"))  # at most a block's pairs
    joined = files.where("gaps is not null").select("block", "hashes", "sizes", "gaps").join(kept, "block").select("hashes", "sizes", "gaps", "kept")

    def run(batches):
        for batch in batches:
            for k, r in enumerate(batch.select(["hashes", "sizes", "gaps"]).to_pylist()):
                h, code, place, key = _pairs_of(r["hashes"], r["sizes"], r["gaps"])
                own = batch.column(3)[k].values.to_numpy()
                pair, inverse = np.unique(key, return_inverse=True)
                good = np.zeros(len(pair), dtype=bool)
                good[own] = True
                some = np.flatnonzero(good[inverse])
                two = some[:-1][(np.diff(some) == 1) & (np.diff(place[some]) == 1)]
                triple, n = np.unique(inverse[two].astype(np.int64) << 32 | code[place[two] + 2], return_counts=True)
                for a in range(0, len(triple), 1 << 16):
                    p, m = triple[a : a + (1 << 16)], n[a : a + (1 << 16)]
                    both = pair[p >> 32]
                    yield pa.RecordBatch.from_arrays([*(pa.array(h[x].view(np.int64)) for x in (both >> 32, both & 0xFFFFFFFF, p & 0xFFFFFFFF)), pa.array(m.astype(np.int64))], names=["h1", "h2", "h3", "n"])

    return joined.mapInArrow(run, "h1 long, h2 long, h3 long, n long")


def _score(a: str, left: str, right: str) -> Column:
    """floor(SCALE a a / (l r)), in whole numbers of up to 38 digits."""
    wide = lambda x: f"cast({x} as decimal(16,0))"
    return F.expr(f"({wide(a)} * {wide(a)} * {SCALE}bd) div ({wide(left)} * {wide(right)})")


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST_RANK, share: int = SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's `most` best phrases of two or three words, by falling score,
    falling a, and phrase.

    A null text has no words and a null lang is `und`; an empty lang is a language of its own. Repeated rows count each time.
    No rows, or none frequent, give none. Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    for seed in range(SEEDS):
        files = written(inverted_files(docs, seed, block_words), "inverted")
        counts = files.where("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("f"))
        words = written(counts.select(_hash(seed).alias("h"), "lang", "word", "f"), "words")
        del counts
        if not words.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").take(1):
            break
    else:
        raise RuntimeError("different words share a hash with every seed")
    forget_shuffles(spark)
    # One row a block and pair: a pair's rows are as many as blocks, so no group is large.
    same = Window.partitionBy("h1", "h2")
    totals = pair_lists(files).withColumns({"a": F.sum("n").over(same), "k": F.row_number().over(same.orderBy("block"))}).where(F.col("a") >= least)
    one = F.col("k") == 1
    kept = written(totals.select("block", "i", *(F.when(one, F.col(c)).alias(c) for c in ("h1", "h2", "a"))), "pairs")
    del totals
    forget_shuffles(spark)
    pairs = kept.where("a is not null").select("h1", "h2", "a")
    triples = written(triple_lists(files, kept.select("block", "i")).groupBy("h1", "h2", "h3").agg(F.sum("n").alias("a")).where(F.col("a") >= least), "triples")

    held = words.where(F.col("f") >= least)
    word = lambda i: held.select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}"), *([F.col("lang")] if i == 1 else []))
    over = triples.select("h1", "h2", "a").union(triples.select("h2", "h3", "a")).toDF("h1", "h2", "b").groupBy("h1", "h2").agg(F.max("b").alias("b"))
    two = pairs.join(over, ["h1", "h2"], "left").where(F.col("b").isNull() | (100 * F.col("b") < share * F.col("a")))
    two = two.join(word(1), "h1").join(word(2), "h2")
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r")).withColumn("score", _score("a", "l", "r"))
    three = triples.join(pairs.toDF("h1", "h2", "a12"), ["h1", "h2"]).join(pairs.toDF("h2", "h3", "a23"), ["h2", "h3"])
    three = three.join(word(1), "h1").join(word(2), "h2").join(word(3), "h3").withColumns({"s1": _score("a", "f1", "a23"), "s2": _score("a", "a12", "f3")})
    early = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("a12")).alias("l"), F.when(early, F.col("a23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))

    # The best of 64 parts of each language first, so that no task orders all phrases of one.
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = two.unionByName(three).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= most)
    top = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= most)
    all_words = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return top.join(all_words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
