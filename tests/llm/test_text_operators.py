"""Conversation repair, licence scans and phrase mining against brute-force versions, on hard rows, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from typeloom.llm import licences, phrases, queries, repair

WORD = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def conversations():
    rng = random.Random(3)
    say = lambda: " ".join(rng.choice(["ja", "no", "wé", "so"]) for _ in range(rng.randint(1, 5))) + rng.choice([".", "!", "?", "", ". ", " \n", "…"])
    rows = []
    for conv in range(60):
        turns = sorted(rng.sample(range(30), rng.randint(1, 9)))
        for t in turns:
            rows.append((conv, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", "usher"]), say()))
    rows += [(100, None, "user", "A."), (100, 3, None, "B."), (100, 4, "assistant", None), (100, 5, "assistant", "")]
    rows += [(None, i, "user" if i % 2 else "assistant", f"t{i % 3}.") for i in range(40)]
    rows += [(200, 7, "user", "same."), (200, 7, "user", "same."), (200, 7, "assistant", "Same."), (200, 8, "assistant", "same.")]
    rows += [(300, i, "assistant" if i % 2 else "user", f"long {i}." if i % 11 else "again.") for i in range(700)]
    rows += [(400, t, "user", "gone") for t in range(400) if zlib.crc32(f"400:{t}".encode()) % 20 == 0]
    return rows


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """By Dijkstra-like search over (rows taken, state) with whole (cost, audit) pairs, one edit at a time."""
    import heapq

    moves = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, at, state, made = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in (0, 3):
            return cost, audit, made
        for r in "ua":
            if r in moves[state]:
                heapq.heappush(heap, (cost + 2, audit + "I", at, moves[state][r], (*made, ({"u": "user", "a": "assistant"}[r], ""))))
        if at < len(rows):
            role, text = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, made))
            if faults[at] not in ("blank", "duplicate"):
                cut = faults[at] == "truncated"
                if role[:1] in moves[state]:
                    heapq.heappush(heap, (cost + cut, audit + "K", at + 1, moves[state][role[:1]], (*made, (role, text))))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if r in moves[state]:
                        heapq.heappush(heap, (cost + cut + 2, audit + "R", at + 1, moves[state][r], (*made, (name, text))))


def plain_repair(rows):
    out = {}
    kept = defaultdict(list)
    for r in plain_damage(rows):
        kept[r[0]].append(r)
    for conv in {r[0] for r in rows}:
        own = sorted(kept[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen = [], set()
        for _, _, role, text in own:
            last = WORD.findall(text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        pairs = [(r[2], r[3]) for r in own]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        cost, audit, made = cheapest(pairs, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


@pytest.mark.parametrize("partitions", [1, 2, 7, 23])
def test_conversations_are_repaired_at_least_cost(spark, tmp_path, partitions):
    """Few ranges leave conversations whole, many cut them, the long one into several parts."""
    rows = conversations()
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string").repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = queries.conversation_repair(spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = plain_repair(rows)
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want


def test_repaired_rows_are_legal_and_in_order(spark):
    rows = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    _, fixed = repair.repair(repair.damaged(rows))
    by = defaultdict(list)
    for r in fixed.collect():
        by[r.conv_id].append(r)
    for own in by.values():
        own.sort(key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own)))
        assert re.fullmatch(r"s?(ua)+", "".join(r.role[:1] for r in own))
        assert all(r.text == "" for r in own if r.edit == "I")


def test_ties_go_to_the_least_letters():
    assert repair.best(repair._solved([("user", "", 0)], repair.closed({0: (0, "")}))) == (2, "KI")
    assert repair.best(repair._solved([("x", "", 0)], repair.closed({0: (0, "")}))) == (3, "D")
    assert repair.best(repair.closed({0: (0, "")})) == (0, "")


def scans():
    filler = "lorem ipsum dolor. " * 30
    texts = [None, "", " \n", "MIT License", "the mit-LICENSE; Apache\nLicense and GNU General\tPublic  License, GENERAL PUBLIC LICENSE", "mitlicense mit licenses é mit license", "mit mit license license"]
    texts += [filler + "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0+ WITH Classpath-exception-2.0\nrest mit license", "license: tbd, see below. License: ISC.", "x-license: MIT", "SPDX-License-Identifier: (MIT or (BSD-3-Clause\nand", "SPDX-License-Identifier: LicenseRef-Mine", "SPDX-License-Identifier: and MIT"]
    texts += ["general public " * 50_000 + "license", "a" * 200_000 + " apache license"]
    return [(i * 3, t, None, "s", 0) for i, t in enumerate(texts)] + [(None, "mit license", None, None, None), (9, "MIT License", "x", None, None)] * 2


def plain_scan(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for p, label in licences.BASE.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    return len(ws), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licence_places_equal_a_plain_search(spark, tmp_path, monkeypatch):
    rows = scans()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.licence_scan(spark, str(tmp_path)).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(((r[0], *plain_scan(r[1])) for r in rows), key=key)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    by = {r.doc_id: r for r in got}
    assert (by[21].labels, by[21].asks) == ("apache,gpl,mit", 1)
    assert (by[24].labels, by[27].labels, by[30].labels, by[33].labels, by[36].labels) == ("isc", "", "bsd,mit", "licenseref-mine", "")


def test_notices_over_the_edges_of_chunks(monkeypatch):
    text = b"a general public  license, mit\nlicense apache license mit license " * 40
    whole = licences.notices(text), licences.expressions(b"license: MIT\n" * 90)
    for chunk in (1, 7, 16, 61):
        monkeypatch.setattr(licences, "CHUNK", chunk)
        assert (licences.notices(text), licences.expressions(b"license: MIT\n" * 90)) == whole
    assert (whole[0][0], len(whole[0][1]), len(whole[1])) == (40 * 10, 40 * 4, 90)


def test_expressions_by_recursive_descent():
    """The shunting yard's value of random expressions equals a recursive evaluation."""
    rng = random.Random(1)
    ids = ["MIT", "GPL-2.0", "LGPL-2.1+", "Apache-2.0", "MPL-2.0", "Weird-1"]

    def make(depth):
        if not depth or rng.random() < 0.3:
            name = rng.choice(ids)
            asks = (licences.known(name) or ("", licences.UNKNOWN_ASKS))[1]
            return (f"{name} WITH LLVM-exception", min(asks, 1), 3) if rng.random() < 0.2 else (name, asks, 4)
        op, rank, join = rng.choice([("OR", 1, min), ("AND", 2, max)])
        sides = [make(depth - 1) for _ in range(2)]
        texts = [f"({t})" if r < rank or rng.random() < 0.2 else t for t, _, r in sides]
        return f" {op} ".join(texts), join(v for _, v, _ in sides), rank

    for _ in range(500):
        text, value, _ = make(4)
        parts = licences.tokens(f" {text}\nmore", False)
        assert licences.evaluate(parts)[1] == value, text
    deep = licences.tokens("(" * 50_000 + "MIT" + ")" * 50_000, False)
    assert licences.evaluate(deep)[1:] == (0, ["mit"])


def phrase_rows():
    rng = random.Random(8)
    vocabulary = ["Alpha", "beta", "gämma", "de-lta", "e", "f", "G", "h'", "Éi"]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", ";"]) for _ in range(n))
    rows = [(i, say(rng.randint(1, 60)), rng.choice(["en", "de", None, "", "und"]), None, None) for i in range(120)]
    rows += [(900 + i, "one two three. two three four one two three", "en", "x", 1) for i in range(12)] + [(1, rows[0][1], "en", None, None)] * 3
    return rows + [(None, None, "en", None, None), (5, "", None, None, None), (6, "aaa " * 4000, "en", None, None), (7, " .,; \n", "xx", None, None)]


def plain_phrases(rows, least=10, most=2000):
    grams, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                grams[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in grams.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in good.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in good.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], score))
        found.sort()
        out += [(lang, i + 1, x[2].decode(), x[3], x[4], x[5], n[lang], x[6]) for i, x in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 50, 2_000_000])
def test_phrases_equal_a_plain_count(spark, block):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert sorted(tuple(r) for r in phrases.collocations(docs, block_words=block).collect()) == plain_phrases(rows)
    assert sorted(tuple(r) for r in phrases.collocations(docs, most=5).collect()) == plain_phrases(rows, most=5)


def test_large_counts_are_divided_exactly(spark):
    from pyspark.sql import functions as F

    cases = [(3 * 10**12 + i, 7 * 10**12 + 3 * i, 5 * 10**12 + 7 * i) for i in range(50)] + [(10, 10, 10), (2, 3, 4), (10**13, 10**13, 10**13), (999_999, 10**6, 10**6)]
    out = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", phrases._score("a", "l", "r").alias("s")).where(F.col("s").isNotNull()).collect()
    assert [r.s for r in out] == [1_000_000 * a * a // (b * c) for a, b, c in cases]


def test_words_that_share_a_hash_lead_to_another_seed(spark, monkeypatch):
    """With seed 0 every word gets one hash."""
    from pyspark.sql import functions as F

    made, seeds = phrases._hash, []

    def spoilt(seed):
        seeds.append(seed)
        return F.lit(1).cast("long") if seed == 0 else made(seed)

    monkeypatch.setattr(phrases, "_hash", spoilt)
    rows = phrase_rows()
    assert sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, SCHEMA)).collect()) == plain_phrases(rows)
    assert seeds == [0, 1]


def test_words_that_share_a_blocks_first_hash(monkeypatch):
    """All words of one length get one first hash; the second one keeps them apart."""
    import numpy as np
    import pyarrow as pa

    real, out = phrases._words, {}
    monkeypatch.setattr(phrases, "ship", lambda spark: None)
    monkeypatch.setattr(phrases, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 3)}))}))

    class Docs:
        sparkSession = None

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    batch = pa.record_batch({"text": pa.array(["ab cd ab. abc xy", "cd", None]), "lang": pa.array(["en", "en", "de"])})
    for spoilt in (False, True):
        docs = Docs()
        monkeypatch.setattr(phrases, "_words", (lambda b: (lambda x: (*x[:4], (x[2] - x[1]).astype(np.uint64), *x[5:]))(real(b))) if spoilt else real)
        with pytest.MonkeyPatch.context() as m:
            m.setattr(phrases, "F", type("F", (), {"col": staticmethod(lambda c: Column()), "coalesce": staticmethod(lambda *a: Column()), "lit": staticmethod(lambda x: Column())}))
            phrases.inverted_files(docs)
        out[spoilt] = sorted(r for b in docs.run([batch]) for r in zip(*(b.column(i).to_pylist() for i in (4, 5, 6)), strict=True) if r[1] is not None)
    assert out[True] == out[False] == [("en", "ab", 2), ("en", "abc", 1), ("en", "cd", 2), ("en", "xy", 1)]


class Column:
    def cast(self, kind):
        return self

    def alias(self, name):
        return self


def test_hashes_of_blocks_are_those_of_rows(spark):
    langs, words = ["en", "", "é", "en"], ["a", "b\u0000c", "naïve", "x" * 500]
    got = [r.h for r in spark.createDataFrame(list(zip(langs, words, strict=True)), "lang string, word string").select(phrases._hash(3).alias("h")).collect()]
    assert got == phrases._hashed(3, langs, [w.encode() for w in words]).view("int64").tolist()
