"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's score is a logistic model of its distinct lower-cased letter runs and their first bytes, so that the forms
of a rare word pool their evidence, hashed to a fixed number of weights.
A document's score is a noisy-or of its sentences' scores and a leak, which takes up labels that no sentence explains.
Weights, bias and leak are fitted to document labels by gradient steps (Adam) on the document likelihood.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BYTE_CODES, BYTE_POWERS, mixed, runs_hashed, ship, slices, utf8

#: Labelled documents that the model is fitted to, at most: those whose id hashes lowest, up to so many bytes of whole texts
#: together. Longer texts than TRAIN_TEXT bytes do not train.
TRAIN_ROWS, TRAIN_BYTES, TRAIN_TEXT = 6000, 48 << 20, 1 << 20

#: Letters of training texts whose features are found at a time; one longer text makes a part of its own.
FIT_LETTERS = 1 << 17

#: Pairs of a sentence and a feature that a gradient step handles at a time.
FIT_PAIRS = 1 << 17

FEATURE_BITS = 20
FEATURES = 1 << FEATURE_BITS

#: Besides a whole letter run, its first so many bytes are features.
STARTS = (4, 5, 6, 7)

#: A feature counts if so many training documents hold it.
LEAST_DOCS = 3

STEPS, RATE, RIDGE = 200, 0.05, 0.01

#: A sentence without evidence scores the logistic of this bias at most.
MOST_BIAS = -7.0

#: Weights are 0 or more, and each unit of weight costs this much likelihood, so that words without steady evidence get none.
SPARSE = 0.3

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord("."), ord("!"), ord("?"), ord("\n")]] = True


def sentences(raw: np.ndarray, bounds: np.ndarray, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (sentence, feature) pairs, of the used features if given, and the sentences' documents and bounds in raw.

    A sentence ends after a full stop, exclamation or question mark, a line's end or the text's end.
    """
    cut = np.unique(np.concatenate([np.flatnonzero(_STOP[raw]) + 1, bounds]))
    first, end = cut[:-1], cut[1:]
    doc = np.searchsorted(bounds, first, side="right") - 1
    inside = _LETTER[raw]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = np.setdiff1d(bounds, [0, len(raw)])
    split = inner[inside[inner] & inside[inner - 1]] if len(raw) else inner
    starts, ends = np.sort(np.append(starts, split)), np.sort(np.append(ends, split))
    codes, pairs = BYTE_CODES[_FOLD[raw]], []
    sentence = np.searchsorted(first, starts, side="right") - 1
    for n in (0, *STARTS):
        long = np.flatnonzero(ends - starts >= n)
        h = mixed(runs_hashed(codes, BYTE_POWERS, starts[long], starts[long] + n if n else ends), n)
        feature = (h >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
        if used is not None:
            some = used[feature]
            long, feature = long[some], feature[some]
        pairs.append(sentence[long] * FEATURES + feature)
    pair = np.unique(np.concatenate(pairs))
    return pair // FEATURES, pair % FEATURES, doc, first, end


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    leak: float

    def score(self, raw: np.ndarray, bounds: np.ndarray):
        """Document scores; sentence scores with their documents and bounds."""
        sentence, feature, doc, first, end = sentences(raw, bounds, self.weights != 0)
        z = self.bias + np.bincount(sentence, self.weights[feature], minlength=len(doc))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(bounds) - 1)
        return 1 - (1 - self.leak) * np.exp(none), p, doc, first, end


def fit(texts: list[str], labels: list[int]) -> Model:
    """Fits the model. With no labels, or of one class alone, all weights are 0 and the leak is the smoothed rate of 1."""
    n = len(texts)
    rate = (sum(labels) + 0.5) / (n + 2)
    if not 0 < sum(labels) < n:
        return Model(np.zeros(FEATURES), -40.0, rate)
    y = np.asarray(labels, dtype=float)
    ends = np.cumsum([len(t) for t in texts])

    def parts(used=None):
        at = 0
        while at < n:  # few letters at a time, as their arrays take many times their size
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FIT_LETTERS, side="right")))
            batch = pa.RecordBatch.from_pydict({"text": pa.array(texts[at:to], pa.string())})
            yield at, *sentences(*utf8(batch), used)[:3]
            at = to

    held, held_toxic = np.zeros(FEATURES, dtype=np.int32), np.zeros(FEATURES, dtype=np.int32)
    for at, sentence, feature, doc in parts():
        in_docs = np.unique((doc[sentence] + at) * FEATURES + feature)
        for counts, own in ((held, in_docs), (held_toxic, in_docs[y[in_docs // FEATURES] > 0])):
            some, many = np.unique(own % FEATURES, return_counts=True)
            counts[some] += many.astype(np.int32)
    kept = np.flatnonzero(held >= LEAST_DOCS)
    bad, good = held_toxic[kept] + 0.5, held[kept] - held_toxic[kept] + 0.5
    odds = np.log(bad / (y.sum() + 1)) - np.log(good / (n - y.sum() + 1))
    start = np.maximum(odds - 2 * np.sqrt(1 / bad + 1 / good), 0)  # the lower bound of a feature's log odds ratio
    kept, start = kept[odds > 0], start[odds > 0]  # weights are 0 or more: others would have none
    del held, held_toxic, bad, good, odds
    used, place = np.zeros(FEATURES, dtype=bool), np.zeros(FEATURES, dtype=np.int32)
    used[kept], place[kept] = True, np.arange(len(kept))
    found, base = ([], [], []), 0
    for at, sentence, feature, doc in parts(used):
        for own, x in zip(found, (sentence + base, place[feature], doc + at), strict=True):
            own.append(x.astype(np.int32))
        base += len(doc)
    joined = []
    for own in found:  # a list goes as soon as its arrays are joined, which keeps the peak low
        joined.append(np.concatenate(own))
        own.clear()
    sentence, feature, doc = joined
    # Ranges of pairs, none of which cuts a sentence: with the same sums as all at once, and no long copies of the pairs.
    cuts = np.unique(np.append(np.searchsorted(sentence, sentence[::FIT_PAIRS]), len(sentence)))
    ranges = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    theta = np.concatenate([start, [MOST_BIAS, np.log(0.02 / 0.98)]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = np.zeros(len(doc))
        for own in ranges:
            first = sentence[own.start]
            sums = np.bincount(sentence[own] - first, theta[feature[own]])
            z[first : first + len(sums)] = sums
        z += theta[-2]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        leak = 1 / (1 + np.exp(-theta[-1]))
        none = np.exp(np.log1p(-leak) + np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))
        pull = y * none / np.maximum(1 - none, 1e-9) - (1 - y)
        by_sentence = p * pull[doc]
        by_feature = np.zeros(len(kept))
        for own in ranges:
            np.add.at(by_feature, feature[own], by_sentence[sentence[own]])
        up = np.concatenate([by_feature - RIDGE * theta[:-2] - SPARSE, [by_sentence.sum(), leak * pull.sum()]]) / n
        m, v = 0.9 * m + 0.1 * up, 0.999 * v + 0.001 * up**2
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        theta[:-2] = np.maximum(theta[:-2], 0)
        theta[-2] = min(theta[-2], MOST_BIAS)
    weights = np.zeros(FEATURES)
    weights[kept] = theta[:-2]
    return Model(weights, float(theta[-2]), float(1 / (1 + np.exp(-theta[-1]))))


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are kept from training: the crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> Model:
    """A model from at most `rows` labelled documents that are not held out, of at most `most` bytes together.

    Labels that are null or neither 0 nor 1, and null ids, are left out; of several labels of one id 1 wins. Of several
    documents with one id, each trains, within the same bound.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    texts = texts.withColumn("size", F.octet_length("text")).where(F.col("size") <= TRAIN_TEXT)
    order = [F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")]
    sizes = np.cumsum([r["size"] for r in texts.orderBy(*order).limit(rows).select("size").collect()])
    texts = texts.orderBy(*order).limit(int(np.searchsorted(sizes, most, side="right"))).select("text", "toxic").collect()
    return fit([r.text for r in texts], [r.toxic for r in texts])


def score(docs: DataFrame, model: Model, doubt: float = 0.5) -> DataFrame:
    """docs with score (0 to 1), predicted (1 if score >= 0.5, else 0) and offending.

    offending: start and end, as bytes of the UTF-8 text, and score of the sentences of `doubt` or more, in order. A
    null or empty text has no sentence, and so the leak for score. All other columns pass unchanged.
    """
    spark = docs.sparkSession
    ship(spark)
    if clash := {"score", "predicted", "offending"} & set(docs.columns):
        raise ValueError(f"docs already has {sorted(clash)}")
    sent = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.leak))
    names = docs.columns
    offending = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches):
        weights, bias, leak = sent.value
        own = Model(weights, bias, leak)
        for batch in slices(batches):
            raw, bounds = utf8(batch)
            s, p, doc, first, end = own.score(raw, bounds)
            s = np.clip(s, 0.0, 1.0)
            bad = np.flatnonzero(p >= doubt)
            at = np.searchsorted(doc[bad], np.arange(len(bounds)))
            spans = pa.StructArray.from_arrays([pa.array(first[bad] - bounds[doc[bad]], pa.int64()), pa.array(end[bad] - bounds[doc[bad]], pa.int64()), pa.array(p[bad], pa.float64())], fields=list(offending))
            more = [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, "score", "predicted", "offending"])

    schema = docs.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.expr("cast(array() as array<struct<start: bigint, end: bigint, score: double>>)").alias("offending")).schema
    for f in schema:
        f.nullable = True
    return docs.mapInArrow(run, schema)
