"""Every corpus operator against a brute-force version, over a fixture of hard cases and over a small table."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyarrow import fs
from pyspark.sql import functions as F

from typeloom.llm import ann, flac, jaccard, media, mixing, packing, queries, sharding, simhash, substrings, tokens, toxicity, urls
from typeloom.llm.shared import BYTE_CODES, BYTE_POWERS, mixed, runs_hashed, utf8

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def hard_rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, long = say(70), say(6000)
    texts = [say(rng.randint(1, 200)) for _ in range(40)]
    texts += [None, "", " \n\t ", "one", "two words", texts[0], texts[0], texts[1].upper(), texts[2] + "."]
    texts += [say(30) + "\n" + passage + "  " + say(20), passage, passage + " " + passage, say(49), long, long[: len(long) // 2]]
    texts += ["a  b\n\n c\u00a0d \u2003 e <|endoftext|> f", "  lead", "trail  ", "x" * 5000, "na\u0301ive \U0001f600 don't we'll 12,345.67!!", "tab\tonly\ttabs"]
    rows = [(i * 7 % 101, t, "en", [None, "b", "a", "é", "c"][i % 5], len(t or "")) for i, t in enumerate(texts)]
    return rows + [(None, texts[3], None, None, None), rows[5], rows[5], (rows[6][0], "another text under one id", "en", "a", 5)]


@pytest.fixture(scope="module")
def rows():
    return hard_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    """A folder with the hard cases as documents, for the queries."""
    folder = tmp_path_factory.mktemp("hard")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int("passage" in (r[1] or ""))) for r in hard_rows()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name, schema in {"documents": SCHEMA, "labels": "doc_id long, quality int, toxic int", "embeddings": "vec_id long, embedding array<float>, label int", "pages": "page_id long, url string, html string", "conversations": "conv_id long, turn long, role string, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def plain_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, nothing, name):
    assert queries.QUERIES[name](spark, nothing).count() == 0


def encoded(encoder, texts):
    ids, cuts = encoder.encode(*utf8(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})))
    return [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])]


def test_encoder_equals_plain_tokenizer(rows):
    encoder = tokens.Encoder(tokens.tokenizer_path())
    texts = [r[1] or "" for r in rows] * 2
    assert encoded(encoder, texts) == [x[:-1] for x in plain_ids(texts)]


def test_encoder_equals_plain_tokenizer_on_odd_texts(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_UNITS", 500)  # so that units are forgotten too
    monkeypatch.setattr(tokens, "LOOKED_UP", 1000)
    encoder, rng = tokens.Encoder(tokens.tokenizer_path()), random.Random(3)
    pieces = ["a", "B", "\u00e9", "\u00ff", "\u00d7", "\u00f7", "\u0101", "\u017f", "\u0180", "1", "23", " ", "  ", "\n", "\n\n", "\t", "\r", "\u00a0", "\u2003", "\u3000", "\u0085", "\x1c", "\x00", "'", "'s", "'ll"]
    pieces += ["don't", ".", ",", "!!", "$", "<|endoftext|>", "<|", "\u6f22\u5b57", "\u304b", "\U0001f600", "word", "the", "\u200b", " ", "\u201c", "\u201d", "x" * 40, "\u00aa", "\u00b2", "\u0661"]
    for _ in range(5):
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(800)]
        assert encoded(encoder, texts) == [x[:-1] for x in plain_ids(texts)]


@pytest.mark.parametrize("source", ["hard", SF])
def test_token_files(spark, tables, source):
    folder = tables if source == "hard" else source
    table = sorted(((r.doc_id is not None, r.doc_id or 0, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()), key=lambda r: r[:2])
    got = queries.token_files(spark, folder).collect()
    ids = plain_ids([t for _, _, t in table])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d if some else None, len(x), crc(x)) for (some, d, _), x in zip(table, ids, strict=True))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
def test_token_ids_are_read_by_offset_from_stores_that_are_not_local(monkeypatch, tmp_path, dtype):
    values = np.arange(5000).astype(dtype)
    (tmp_path / "part.ids").write_bytes(values.tobytes())
    near = tokens._between(str(tmp_path), "part.ids", dtype)
    monkeypatch.setattr(tokens, "_store", lambda uri: (fs.SubTreeFileSystem(uri, fs.LocalFileSystem()), ""))
    far = tokens._between(str(tmp_path), "part.ids", dtype)
    for a, b in ((0, 0), (0, 1), (17, 4000), (4999, 5000), (5000, 5000), (0, 5000)):
        assert near(a, b).tolist() == values[a:b].tolist()
        got = far(np.int64(a), np.int64(b))
        assert got.dtype == np.dtype(dtype) and got.tolist() == values[a:b].tolist()


def check_packing(got, table):
    want = Counter()
    for d, x in table:
        n = len(x)
        first = n - (-(-n // 1024) - 1) * 1024
        bounds = [0, *range(first, n + 1, 1024)]
        want.update((d, p, a, b - a, crc(x[a:b])) for p, (a, b) in enumerate(zip(bounds, bounds[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    return len(bins)


def best_fit_decreasing(lengths, capacity=1024):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= n
        else:
            left.append(capacity - n)
    return len(left)


@pytest.mark.parametrize("source", ["hard", SF])
def test_packing(spark, tables, source):
    folder = tables if source == "hard" else source
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.best_fit_packing(spark, folder).collect()
    n = check_packing(got, list(zip([d for d, _ in table], plain_ids([t for _, t in table]))))
    assert n == best_fit_decreasing([r.length for r in got])


def test_packing_plan_equals_best_fit_of_items():
    rng = random.Random(1)
    for capacity in (1, 7, 64):
        for _ in range(30):
            counts = Counter(rng.choice(range(1, capacity + 1)) for _ in range(rng.randint(1, 80)))
            runs = packing.plan(counts, capacity)
            assert Counter({k: sum(b - a for n, a, b, *_ in runs if n == k) for k in counts}) == counts
            assert len({s + i for _, a, b, s, _ in runs for i in range(b - a)}) == best_fit_decreasing(list(counts.elements()), capacity)


def test_packing_refuses_lengths_out_of_range(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 2000)], "doc_id long, length long")).count()


@pytest.mark.parametrize("source", ["hard", SF])
def test_sharding(spark, tables, source):
    folder = tables if source == "hard" else source
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.ring_sharding(spark, folder).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in table)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    sizes = [len(by[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_sharding_walks_the_ring(spark):
    """Each key's shard, against a walk key by key in the order of the ranks of its arc."""
    keys = spark.range(700).select(F.col("id").alias("doc_id"))
    shards, nodes = 5, 6
    placed = sharding.shard_rows(keys, shards=shards, nodes=nodes).collect()
    points = sharding.ring(spark, shards, nodes)
    place = {r.doc_id: r.h % 2**64 for r in keys.select("doc_id", F.xxhash64(F.lit("key"), F.col("doc_id").cast("string")).alias("h")).collect()}
    cap = 700 // shards
    home = lambda d: next((i for i, (p, _) in enumerate(points) if p >= place[d]), 0)
    loads = Counter(r.shard for r in placed)
    assert set(loads.values()) == {cap}
    for r in placed:  # every shard passed on the way is full, and the row's own is on its way
        i, seen = home(r.doc_id), []
        while points[i % len(points)][1] != r.shard:
            seen.append(points[i % len(points)][1])
            i += 1
        assert all(loads[s] == cap for s in seen)
    at_home = sum(points[home(r.doc_id)][1] == r.shard for r in placed)
    assert at_home > 0.6 * 700


def test_sharding_moves_little_when_grown(spark):
    keys = spark.range(4000).select(F.col("id").alias("doc_id"))
    before = {r.doc_id: r.shard for r in sharding.shard_rows(keys, shards=8, slack=0.25).collect()}
    after = {r.doc_id: r.shard for r in sharding.shard_rows(keys, shards=9, slack=0.25).collect()}
    assert sum(before[k] != after[k] for k in before) < 0.3 * 4000


def brute_judge(url):
    host = path = ""
    if url is not None and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = m[1].translate({i: i + 32 for i in range(65, 91)}), m[2]
    fits = [(h, p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_urls(spark):
    made = ["http://Example.ORG/es/1?x#y", "https://a.b.example.org/en/12", "ftp://notexample.org/es/", "http://org", "http://x.com/de/a://b", "x", None, "", "://com/fr/", "http://a.com?/fr/", "http://example.org#z", "http://É.COM/FR/", "HTTP://x.example.org/es", "http://com/fr/\nz", "http://a..org/q"]
    table = [(i, u) for i, u in enumerate(made * 2)] + [(None, "http://x.org/"), (3, "http://org"), (3, "http://org")]
    got = urls.judge(spark.createDataFrame(table, "page_id long, url string"), spark.createDataFrame(queries.RULES + [(None, "/", "block"), ("net", None, "block")], "host string, path string, verdict string")).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter((i, *brute_judge(u)) for i, u in table)
    none = urls.judge(spark.createDataFrame(table, "page_id long, url string"), spark.createDataFrame([], "host string, path string, verdict string"))
    assert {r.verdict for r in none.collect()} == {"allow"}


@pytest.mark.parametrize("broadcast", [True, False])
def test_urls_against_a_long_list(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(urls, "BROADCAST_RULES", 0)
        monkeypatch.setattr(urls.bloom, "BROADCAST_BLOCKS", 0)
    rules = [(f"h{i}.example", f"/{i % 7}/", "block" if i % 2 else "allow") for i in range(3000)]
    table = [(i, f"https://www.h{i * 3}.example/{i % 7}/x", ["kept"]) for i in range(1500)]
    got = urls.judge(spark.createDataFrame(table, "page_id long, url string, tags array<string>"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    by = {(h, p): v for h, p, v in rules}
    want = Counter()
    for i, _, _ in table:
        key = (f"h{i * 3}.example", f"/{i % 7}/")
        want[i, "".join(key) if key in by else None, by.get(key, "allow")] += 1
    assert Counter((r.page_id, r.rule, r.verdict) for r in got) == want and all(r.tags == ["kept"] for r in got)


def test_filter_tables_grow_and_lose_nothing(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    blocks = urls.bloom.blocks_for(5000)
    listed = urls.bloom.table(keys, "k", blocks)
    assert blocks == 2048 and listed.count() <= blocks
    asked = spark.range(20000).select("id", F.xxhash64("id").alias("k")).unionByName(spark.createDataFrame([(-1, None)], "id long, k long"))
    got = {r.id: r.may for r in urls.bloom.marked(asked, "k", listed, blocks, "may").collect()}
    assert len(got) == 20001 and all(got[i] for i in range(5000)) and not got[-1]
    assert sum(got[i] for i in range(5000, 20000)) < 0.05 * 15000
    array = urls.bloom.build(keys, "k")
    assert urls.bloom.passes_array(array, np.array([r.k for r in keys.collect()], dtype=np.int64)).all()


def test_clashing_columns_are_refused_and_others_pass(spark):
    page = spark.createDataFrame([(1, "http://a.com/", 5)], "page_id long, url string, rule long")
    with pytest.raises(ValueError):
        urls.judge(page, spark.createDataFrame(queries.RULES, "host string, path string, verdict string"))
    with pytest.raises(ValueError):
        sharding.shard_rows(spark.createDataFrame([(1, 2)], "doc_id long, slot long"))
    with pytest.raises(ValueError):
        toxicity.score(spark.createDataFrame([(1, "x", 2.0)], "doc_id long, text string, score double"), toxicity.fit([], []))
    with pytest.raises(ValueError):
        media.pcm_blocks(spark.createDataFrame([(1, b"", 2)], "doc_id long, media binary, block int"))
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 3, 4)], "doc_id long, length long, sequence_id long"))
    with pytest.raises(ValueError):
        substrings.deduplicated(spark.createDataFrame([(1, "x", 4)], "doc_id long, text string, n_words long"), keep=["n_words"])
    odd = spark.createDataFrame([(1, "some words", 7, "k")], "doc_id long, text string, vec_id long, kind string")
    assert sharding.shard_rows(odd).select("vec_id", "kind").collect() == [(7, "k")]
    assert tokens.with_ids(odd).count() == simhash.near_duplicates(odd).count() == media.to_flac(odd).count() == 1
    assert substrings.deduplicated(odd, keep=["vec_id"]).select("vec_id").collect() == [(7,)]


def test_sharding_of_equal_rows(spark):
    rows = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text")).repartition(6)
    got = sharding.shard_rows(rows, shards=4).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(map(len, by.values())) == [750] * 4 and all(sorted(x) == list(range(750)) for x in by.values())


def brute_repeats(table, size=50):
    first = {}
    found = {}
    for d, t in table:
        w = WORD.findall(t or "")
        found[d, t] = w
        for i in range(len(w) - size + 1 if d is not None else 0):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in table:
        w = found[d, t]
        gone = set()
        for i in range(len(w) - size + 1 if d is not None else 0):
            if first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("source", ["hard", SF])
def test_substring_dedup(spark, tables, source):
    folder = tables if source == "hard" else source
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.substring_dedup(spark, folder).collect()
    want = brute_repeats(table)
    assert Counter(tuple(r) for r in got) == want
    assert sum(n for _, _, n, _ in want) > 0


def test_repeats_double_until_none_survives(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = [word() for _ in range(230)]
    table = [(1, shared[:230]), (2, [word() for _ in range(20)] + shared[10:225]), (3, shared[:60] + [word()]), (4, [word() for _ in range(80)])]
    got = {(r.doc_id, r.position): r.length for r in substrings.longest_repeats(spark.createDataFrame([(d, " ".join(w)) for d, w in table], "doc_id long, text string")).collect()}
    want = {}
    for size in (50, 100, 200, 400):
        held = defaultdict(set)
        for d, w in table:
            for i in range(len(w) - size + 1):
                held[tuple(w[i : i + size])].add((d, i))
        want |= {x: size for places in held.values() if len({d for d, _ in places}) > 1 for x in places}
    assert got == want and set(want.values()) == {50, 100, 200}


def test_kept_text_of_untouched_documents_is_whole(spark, docs, rows):
    out = substrings.deduplicated(docs, keep=["source"]).where("n_removed = 0").select("doc_id", "kept_text").collect()
    texts = {(r[0], r[1] or "") for r in rows}
    assert out and all((r.doc_id, r.kept_text) in texts for r in out)


def brute_fingerprint(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    parts = [" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, 1))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(parent)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 4:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {p: root(p) for p in keys}


@pytest.mark.parametrize("source", ["hard", SF])
def test_simhash(spark, tables, source):
    folder = tables if source == "hard" else source
    table = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    root = brute_components({p for _, p in table})
    least = {}
    for d, p in table:
        if d is not None:
            least[root[p]] = min(least.get(root[p], d), d)
    got = queries.simhash_groups(spark, folder).collect()
    assert Counter(tuple(r) for r in got) == Counter((d, f"{p:016x}", least.get(root[p])) for d, p in table)


def test_simhash_links_in_large_buckets(spark, monkeypatch):
    """Buckets that are dealt again lose no link."""
    monkeypatch.setattr(simhash, "BUCKET", 20)
    rng = random.Random(3)
    prints = set()
    for _ in range(60):
        seed = rng.getrandbits(64) & ~0x1FFF
        for _ in range(8):
            prints.add(seed ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))))
    signed = [p - 2**64 if p >= 2**63 else p for p in (x % 2**64 for x in prints)]
    edges = simhash.links(spark.createDataFrame([(s,) for s in set(signed)], "fp long"))
    assert edges.count() <= 5 * len(signed)
    got = {r.node % 2**64: r.root % 2**64 for r in simhash.components(edges).collect()}
    want = brute_components({s % 2**64 for s in signed})
    classes = lambda f: {frozenset(m) for m in _groups(f).values()}
    assert classes({p: got.get(p, p) for p in want}) == classes(want)


def _groups(f):
    out = defaultdict(set)
    for k, v in f.items():
        out[v].add(k)
    return out


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def payload(text):
    raw = (text or "").encode()
    return raw + bytes(max(-(-len(raw) // 64), 1) * 64 - len(raw))


def plain_feature(p):
    x = [b - 128 for b in p]
    crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:]))
    return f"samples={len(x)};sum={sum(x)};squares={sum(v * v for v in x)};crossings={crossings};min={min(x)};max={max(x)}"


@pytest.mark.parametrize("source", ["hard", SF])
def test_flac_query(spark, tables, source):
    folder = tables if source == "hard" else source
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.flac_media(spark, folder).collect()
    want = Counter()
    for d, t in table:
        p = payload(t)
        sha = hashlib.sha256(p).hexdigest()
        want[d, len((t or "").encode()), len(p), sha, zlib.crc32(p[-64:]), len(p), sha, plain_feature(p)] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in got) == want
    assert all(0 < r.flac_bytes < r.payload_bytes + 42 + 16 * (r.payload_bytes // 256 + 1) for r in got)


def test_flac_blocks_are_seekable(spark, docs, tmp_path):
    coded = media.write_blocks(media.to_flac(docs), str(tmp_path / "flac"))
    kept = media.write_blocks(media.pcm_blocks(coded, samples=1000), str(tmp_path / "pcm"))
    rows, by = kept.collect(), defaultdict(list)
    for r in rows:
        by[r.stream].append(r)
    flacs = {r.stream: bytes(r.media) for r in coded.collect()}
    texts = {k: flac.decode([x])[0][0] for k, x in flacs.items()}
    assert Counter(texts.values()) == Counter(payload(r.text) for r in docs.collect()) and set(by) == set(texts)
    for stream, own in by.items():
        own.sort(key=lambda r: r.block)
        whole = texts[stream]
        assert [r.block for r in own] == list(range(own[0].n_blocks))
        assert b"".join(r.pcm for r in own) == whole
        for r in own:
            assert r.pcm == whole[r.first_sample : r.first_sample + r.n_samples] and r.n_samples <= 1000 + 256
            assert flacs[stream][r.flac_place : r.flac_place + 2] == b"\xff\xf8"
    for r in media.samples(kept, 900, 2100).groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("first_sample", "pcm"))).alias("x")).collect():
        assert b"".join(x.pcm for x in r.x) == texts[r.stream][900:2100]
    joined = {r.stream: r.pcm for r in media.streams(kept, "stream").collect()}
    assert {k: bytes(v) for k, v in joined.items()} == texts


def test_flac_blocks_can_be_read_alone(spark, docs):
    coded = media.to_flac(docs)
    r = coded.orderBy(F.desc("n_bytes"), "stream").first()
    stream = bytes(r.media)
    pcm, first, place = flac.decode([stream])[0]
    alone = bytearray(stream[:42] + stream[place[3] : place[4]])
    alone[21:26] = (int.from_bytes(alone[21:26]) & ~((1 << 36) - 1)).to_bytes(5)  # unknown length
    alone[26:42] = bytes(16)
    with pytest.raises(flac.FlacError):
        flac.decode([stream[: place[3]] + b"\0" + stream[place[3] + 1 :]])
    assert pcm[first[3] : first[4]] == flac.decode([bytes(alone)])[0][0]


def test_flac_encoder_writes_linear_predictors_and_long_streams(monkeypatch):
    monkeypatch.setattr(flac, "GROUP", 7)  # so that streams span groups
    t = np.arange(60_000)
    wave = (np.sin(t / 1.1) * 60 + np.sin(t / 2.3) * 50 + 128).astype(np.uint8)
    noise = np.random.default_rng(1).integers(0, 256, 999 * 64).astype(np.uint8)
    raw, bounds = np.concatenate([wave, noise, np.full(640, 7, np.uint8)]), np.array([0, 60_000, 60_000 + len(noise), 60_640 + len(noise)])
    streams = flac.encode(raw, bounds)
    heads = [s[p + 6 if len(s) > p + 6 and n < 128 else p + 7] >> 1 & 63 for s, (_, _, place) in zip(streams[:1], flac.decode(streams[:1])) for n, p in enumerate(place.tolist()) if n < 128]
    assert heads.count(32 + flac.LINEAR - 1) > 50
    assert len(streams[0]) < 0.8 * 60_000
    assert [x[0] for x in flac.decode(streams)] == [raw[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


def test_flac_memory_of_a_long_text():
    import tracemalloc

    raw = np.frombuffer(b"some words that go on and on, " * 150_000, dtype=np.uint8)
    raw = raw[: len(raw) // 64 * 64]
    tracemalloc.start()
    stream = flac.encode(raw, np.array([0, len(raw)]))
    assert flac.decode(stream)[0][0] == raw.tobytes()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 120e6 + 12 * len(raw)


class Writer:
    """A plain FLAC writer, bit by bit, for streams that the encoder does not make."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def signed(self, value, n):
        self.put(value & (1 << n) - 1, n)

    def rice(self, value, k):
        u = value << 1 if value >= 0 else -value * 2 - 1
        self.bits += [0] * (u >> k) + [1]
        self.put(u & (1 << k) - 1, k)

    def bytes(self):
        self.bits += [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, self.bits[i : i + 8])), 2) for i in range(0, len(self.bits), 8))


def crc_bits(data, polynomial, width):
    crc = 0
    for byte in data:
        crc ^= byte << (width - 8)
        for _ in range(8):
            crc = (crc << 1 ^ polynomial if crc >> (width - 1) & 1 else crc << 1) & (1 << width) - 1
    return crc


def test_flac_linear_predictors_partitions_escapes_and_stereo():
    rng = random.Random(2)
    n = 32
    left = [int(9000 * np.sin(i / 3)) + rng.randint(-30, 30) for i in range(n)]
    right = [x + rng.randint(-40, 40) for x in left]
    side = [a - b for a, b in zip(left, right)]
    body = Writer()
    body.put(0x20 + 1, 7), body.put(0, 1)  # linear predictor of order 2, left
    for x in left[:2]:
        body.signed(x, 16)
    coef, shift = [7, -3], 2
    body.put(5 - 1, 4), body.signed(shift, 5)
    for c in coef:
        body.signed(c, 5)
    residual = [left[t] - ((coef[0] * left[t - 1] + coef[1] * left[t - 2]) >> shift) for t in range(2, n)]
    body.put(1, 2), body.put(2, 4)  # 5-bit parameters, four partitions
    for p in range(4):
        part = residual[max(0, p * 8 - 2) : p * 8 + 6]
        if p == 2:
            body.put(31, 5), body.put(17, 5)
            for r in part:
                body.signed(r, 17)
        else:
            body.put(6 if p else 1, 5)
            for r in part:
                body.rice(r, 6 if p else 1)
    side2 = [x & ~1 for x in side]
    right = [a - b for a, b in zip(left, side2)]
    body.put(8 + 1, 7), body.put(1, 1), body.put(1, 1)  # fixed predictor of order 1, one wasted bit, side (17 bits)
    s = [x >> 1 for x in side2]
    body.signed(s[0], 16)
    body.put(0, 2), body.put(0, 4), body.put(4, 4)
    for a, b in zip(s, s[1:]):
        body.rice(b - a, 4)
    head = bytes([0xFF, 0xF8, 6 << 4 | 9, 8 << 4 | 4 << 1, 0, n - 1])
    frame = head + bytes([crc_bits(head, 0x07, 8)]) + body.bytes()
    frame += crc_bits(frame, 0x8005, 16).to_bytes(2)
    pcm = np.array([left, right], dtype="<i2").T.tobytes()
    info = (4096).to_bytes(2) * 2 + bytes(6) + (44100 << 44 | 1 << 41 | 15 << 36 | n).to_bytes(8) + hashlib.md5(pcm).digest()
    stream = b"fLaC" + b"\x80\0\0\x22" + info + frame
    assert flac.decode([stream, stream])[1][0] == pcm


def plain_toxicity(model, text):
    """Score and offending sentences of a text, sentence by sentence and word by word."""
    raw, scores = (text or "").encode(), []
    at = 0
    for part in re.findall(rb"[^.!?\n]*[.!?\n]|[^.!?\n]+", raw):
        held = set()
        for w in re.findall(rb"[A-Za-z\x80-\xff]+", part):
            low = bytes(b + 32 if 65 <= b <= 90 else b for b in w)
            for n in (0, *toxicity.STARTS):
                if len(low) >= n:
                    piece = np.frombuffer(low[:n] if n else low, dtype=np.uint8)
                    h = runs_hashed(BYTE_CODES[piece], BYTE_POWERS, np.array([0]), np.array([len(piece)]))
                    held.add(int(mixed(h, n)[0]) >> (64 - toxicity.FEATURE_BITS))
        z = model.bias + sum(float(np.float32(model.weights[f])) for f in held)
        scores.append((at, at + len(part), 1 / (1 + np.exp(-z))))
        at += len(part)
    clean = 1 - model.leak
    for *_, p in scores:
        clean *= 1 - p
    return 1 - clean, [x for x in scores if x[2] >= 0.5]


def test_toxicity_scores_are_noisy_or_of_sentences(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    odd = [(-1, None), (-2, ""), (-3, "no end"), (-4, "...!\n\n? x"), (-5, "\u00c9T\u00c9 9a9b! Zz")]
    got = toxicity.score(docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")), model).collect()
    for r in got:
        score, bad = plain_toxicity(model, r.text)
        assert r.score == pytest.approx(score, abs=1e-9) and r.predicted == int(r.score >= 0.5)
        assert [(s.start, s.end) for s in r.offending] == [x[:2] for x in bad]
    assert sum(r.predicted for r in got) > 0


def test_toxicity_trains_on_a_bounded_sample(spark):
    docs = spark.createDataFrame([(i, ("vile " if i % 2 else "calm ") * (20 + 300_000 * (i == 7))) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    assert len(toxicity.train(docs, labels, most=400).weights) == toxicity.FEATURES
    assert toxicity.train(docs, labels, rows=0).leak == pytest.approx(0.25)
    out = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all(out[i] == i % 2 for i in out)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.toxicity_scores(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    rank, y = out.score.rank().to_numpy(), out.toxic.to_numpy()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.9
    assert (out.predicted[y == 1] == 1).mean() > 0.6 and (out.predicted[y == 0] == 1).mean() < 0.02


def test_toxicity_learns_each_language(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.toxicity_scores(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    out = out.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").select("lang", "predicted", "toxic").toPandas()
    for lang, rows in out.groupby("lang"):
        caught, rejected = (rows.predicted[rows.toxic == t].mean() for t in (1, 0))
        assert caught > 0.6 and rejected < 0.03, (lang, caught, rejected)


def test_toxicity_finds_sentences_and_odd_rows(spark):
    bad, good = "you are a vile toad", "the sun is warm today"
    table = [(i, f"{good}. {bad}! {good}." if i % 2 else f"{good}. {good} indeed.") for i in range(60)] + [(60, None), (61, ""), (None, "toad"), (1, f"{bad}")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(2, None), (None, 1), (4, 7)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(table)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None and r.doc_id < 60 and r.text != bad:
            assert r.predicted == r.doc_id % 2
            found = [r.text.encode()[s.start : s.end].decode() for s in r.offending]
            assert all("toad" in x or "vile" in x for x in found) and bool(found) == bool(r.doc_id % 2)
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, none).where("score >= 0.5").count() == 0


def brute_targets(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = sum(weight[s] for s in sizes if s not in capped)
        target = {s: most * sizes[s] if s in capped else weight[s] * left / free for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("source", ["hard", SF])
def test_mixing(spark, tables, source):
    folder = tables if source == "hard" else source
    table = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    sizes = defaultdict(int)
    for _, s, n in table:
        sizes[s] += n
    want = brute_targets(sizes)
    got = queries.source_mix(spark, folder).collect()
    assert Counter((r.doc_id, r["size"], r.source_size) for r in got) == Counter((d, n, sizes[s]) for d, s, n in table)
    assert sorted(r.target for r in got) == pytest.approx(sorted(want[s] for _, s, _ in table))
    taken = defaultdict(int)
    for r in got:
        taken[round(r.target, 6), r.source_size] += r.taken
        assert r.taken == 0 or r.taken % r["size"] == 0 and r.taken <= 3 * r["size"]
    for (target, size), n in taken.items():
        most = max(x for _, s, x in table if sizes[s] == size)
        assert abs(n - target) <= 1.5 * most
    assert Counter(map(tuple, got)) == Counter(map(tuple, queries.source_mix(spark, folder).collect()))


def test_mixing_splits_groups_of_equal_rows(spark):
    rows = [(None, "a", 10)] * 1000 + [(i, "b", 10) for i in range(1000)] + [(7, "c", 3)] * 50 + [(8, "c", 5)] + [(None, None, 0)] * 9
    table = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(7)
    got = mixing.mix(table).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter(rows)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.times <= 3 and r.taken == r.times * r["size"]
    for source, most in (("a", 10), ("b", 10), ("c", 5), (None, 0)):
        assert abs(taken[source] - target[source]) <= most / 2, source
    assert Counter(got) == Counter(mixing.mix(table).collect())


def test_mixing_refuses_clashing_columns(spark):
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame([(1, "a", 1, 2)], "doc_id long, source string, size long, taken long"))
    with pytest.raises(ValueError):
        mixing.sized(spark.createDataFrame([("x", 1)], "text string, size long"))
    got = mixing.mix(spark.createDataFrame([(1, "a", 1, 2), (2, "b", 1, 3)], "doc_id long, source string, size long, extra long")).collect()
    assert sorted((r.doc_id, r.extra) for r in got) == [(1, 2), (2, 3)]


def test_mixing_caps_small_sources(spark):
    sizes = {"a": 10, "b": 1000, "c": 30, None: 5, "d": 0}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_nearest_recall(spark):
    for sf in ("sf0.01", "sf0.1"):
        vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        got = ann.nearest(vectors).collect()
        table = vectors.select("vec_id", "embedding").toPandas()
        x = np.stack(table.embedding.to_numpy()).astype(np.float64)
        ids = table.vec_id.to_numpy()
        by = defaultdict(list)
        for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
            by[r.query_id].append(r)
        assert set(by) == set(ids[ids % 100 == 0].tolist())
        hit = 0
        for q, near in by.items():
            d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
            best = sorted((s, i) for s, i in zip(d.tolist(), ids.tolist()) if i != q)[:10]
            hit += len({i for _, i in best} & {r.vec_id for r in near})
            assert [r.rank for r in near] == list(range(1, len(near) + 1))
            assert [(r.score, r.vec_id) for r in near] == sorted((r.score, r.vec_id) for r in near)
            assert all(r.score == pytest.approx(d[ids == r.vec_id][0], abs=1e-12) for r in near)
        assert hit / (10 * len(by)) >= 0.9


@pytest.mark.parametrize("sample, block", [(20_000, 256), (500, 64)])
def test_nearest_finds_all_rows_of_the_chosen_leaves(spark, monkeypatch, sample, block):
    """Over several cells, and over leaves that are dealt over blocks, results are those of a plain loop over the same leaves."""
    grown, enough = [], []
    grow, share = ann.grow, ann.share
    monkeypatch.setattr(ann, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "grow", lambda *a, **k: grown.append(grow(*a, **k)) or grown[-1])
    monkeypatch.setattr(ann, "share", lambda *a, **k: enough.append(share(*a, **k) // 4) or enough[-1])
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    by = defaultdict(list)
    for r in sorted(ann.nearest(vectors).collect(), key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append(r.vec_id)
    table = vectors.select("vec_id", "embedding").toPandas()
    x, ids = np.stack(table.embedding.to_numpy()).astype(np.float64), table.vec_id.to_numpy()
    forest = grown[0]
    assert forest.cell.max() > 3
    leaves = forest.place(x)
    assert set(by) == set(ids[ids % 100 == 0].tolist())
    for at in np.flatnonzero(ids % 100 == 0):
        held = np.isin(leaves, forest.search(x[at], enough[0])).any(axis=1) & (ids != ids[at])
        some = np.flatnonzero(held)
        far = np.sqrt(((x[some] - x[at]) ** 2).sum(axis=1))
        assert len(some) < len(x) - 1
        assert by[ids[at]] == ids[some[np.lexsort((ids[some], far))[:10]]].tolist()


def test_nearest_odd_rows(spark):
    same = [1.0, 2.0]
    table = [(i, same) for i in range(30)] + [(100, [1.0, 2.5]), (200, None), (300, [0.0, 0.0]), (400, [float("nan"), 1.0]), (500, [1.0, None]), (600, [1.0]), (None, same), (100, [1.0, 2.5])]
    got = ann.nearest(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    assert {k: sorted(v) for k, v in by.items()} == {0: [(i, i, 0.0) for i in range(1, 11)], 100: [(i + 1, i, 0.5) for i in range(10)]}


def test_nearest_ties_of_different_vectors_go_to_the_smaller_ids(spark):
    table = [(i, [float(i == j) for j in range(120)]) for i in range(120)]
    got = ann.nearest(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(q, n + 1, i) for q in (0, 100) for n, i in enumerate([i for i in range(11) if i != q][:10])]


def test_pipeline_stages_chain(spark):
    import corpus_pipeline

    sf = SF
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), docs.schema)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3]
    table = [(r.doc_id, r.text) for r in docs.collect()]
    got = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    check_packing(got, list(zip([d for d, _ in table], plain_ids([t for _, t in table]))))
    assert corpus_pipeline.run(spark, sf).count() == len(got)


def test_pipeline_on_empty_tables(spark, nothing):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, nothing).count() == 0
    docs = spark.read.parquet(f"{nothing}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, nothing).count() == 0


def test_pipeline_stages_equal_brute_force_on_hard_rows(spark, tables, tmp_path):
    """Each stage against a plain version of it, on what the stage before it kept of the hard rows."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{tables}/documents.parquet")

    def after(name, rows):
        rows.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    model = toxicity.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    clean = after("toxicity", corpus_pipeline.drop_toxic(spark, docs, tables))
    assert Counter(clean.collect()) == Counter(r for r in docs.collect() if plain_toxicity(model, r.text)[0] < 0.5)
    table = clean.collect()
    first = {}
    for r, root in zip(table, brute_jaccard_components([r.text for r in table]), strict=True):
        first[root] = min(first.get(root, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    single = after("near_duplicates", corpus_pipeline.drop_near_duplicates(spark, clean, tables))
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in single.collect()) == Counter(first.values())
    cut = after("substring_dedup", corpus_pipeline.cut_repeats(spark, single, tables))
    want = Counter((d, n - gone, sha) for (d, n, gone, sha), k in brute_repeats([(r.doc_id, r.text) for r in single.collect()]).items() for _ in range(k) if not (n and gone == n))
    got = Counter((r.doc_id, len(w), hashlib.sha256(" ".join(w).encode()).hexdigest()) for r in cut.collect() for w in [WORD.findall(r.text or "")])
    assert got == want and all(r.n_chars == len(r.text or "") for r in cut.collect() if r.text != "")
    mixed_ = after("source_mix", corpus_pipeline.mix_sources(spark, cut, tables))
    times = Counter(mixed_.collect())
    assert max(times.values()) <= 3 and set(times) <= set(cut.collect())
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in cut.collect():
        n = len(WORD.findall(r.text or ""))
        sizes[r.source] += n
        taken[r.source] += n * times[r]
        most[r.source] = max(most[r.source], n)
    for source, target in brute_targets(sizes).items():
        assert abs(taken[source] - target) <= most[source] / 2 + 1e-6
    packed = corpus_pipeline.pack_sequences(spark, mixed_, tables).collect()
    table = [(r.doc_id, r.text) for r in mixed_.collect()]
    check_packing(packed, list(zip([d for d, _ in table], plain_ids([t for _, t in table]))))


def brute_sets(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = [[w.translate(low) for w in WORD.findall(t or "")] for t in texts]
    return [{" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))} for w in held]


def brute_jaccard_components(texts):
    sets, parent = brute_sets(texts), list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owners = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or {None}:
            owners[x].append(i)
    for a, b in {(o[i], o[j]) for o in owners.values() for j in range(len(o)) for i in range(j)}:
        if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(len(texts))]


def near_variants():
    """Texts with some of their words changed, so that similarities lie on both sides of 0.8, and odd ones."""
    rng, texts = random.Random(8), ["", None, " ", "one", "One", "two words", "a b c d e", "A b  c d e", "a b c d f"]
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((40, 120, 300)))]
        for n in range(7):
            text = list(base)
            for _ in range(n * len(base) // 160):
                text[rng.randrange(len(text))] = "other"
            texts.append(" ".join(text))
    return texts


@pytest.mark.parametrize("source", ["variants", "blocks", "/root/testdata/sf0.01"])
def test_pipeline_near_duplicates_share_four_fifths_of_their_shingles(spark, source, monkeypatch):
    import corpus_pipeline

    if source == "blocks":  # buckets that are compared block by block
        monkeypatch.setattr(jaccard, "BLOCK", 2)
        monkeypatch.setattr(jaccard, "COLUMNS", 64)
    if source.startswith("/"):
        docs = spark.read.parquet(f"{source}/documents.parquet")
    else:
        docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(near_variants())], SCHEMA).repartition(3)
    table = docs.select("doc_id", "text").collect()
    least = {}
    for r, root in zip(table, brute_jaccard_components([r.text for r in table]), strict=True):
        least[root] = min(least.get(root, r.doc_id), r.doc_id)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, source).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == sorted(least.values())


def test_pipeline_near_duplicates_keep_one_row_of_each_group(spark):
    import corpus_pipeline

    one, two, three = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    table = [(1, one), (1, one), (1, one), (2, two), (2, one), (3, two), (None, two), (None, three), (None, three), (None, ""), (None, None), (4, "alone")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in table], SCHEMA).repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert Counter((r.doc_id, r.text or "") for r in got) == Counter([(1, one), (2, two), (None, three), (None, ""), (4, "alone")])


def facts(texts):
    """Sets of shingles, keys of bands and five-word fingerprints of texts."""
    text = utf8(pa.RecordBatch.from_pydict({"text": pa.array(texts)}))
    sets, bounds = jaccard.shingle_sets(*text)
    held = [set(sets[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return held, jaccard.signatures(sets, bounds)[1], simhash.fingerprints_of(*text, 5)


def bandless_pair(seed):
    """Two texts whose words differ where most bands' minima lie, so that they agree in no band."""
    rng = random.Random(seed)
    one = two = [f"w{rng.randrange(10**6)}" for _ in range(454)]
    for _ in range(10):
        tries = []
        for _ in range(400):
            i = rng.randrange(454)
            tries.append([*two[:i], f"x{rng.randrange(10**6)}", *two[i + 1 :]])
        _, keys, _ = facts([" ".join(t) for t in [one, *tries]])
        same = (keys[1:] == keys[0]).sum(axis=1)
        two = tries[int(np.argmin(same))]
        if not same.min():
            break
    return " ".join(one), " ".join(two)


def test_pipeline_near_duplicates_of_close_fingerprints_need_no_band(spark):
    """Similar sets that agree in no MinHash band are joined by the index of fingerprints."""
    import corpus_pipeline

    pairs = [bandless_pair(seed) for seed in (0, 2, 3)]
    for pair in pairs:
        (a, b), keys, prints = facts(list(pair))
        assert not (keys[0] == keys[1]).any() and 10 * len(a & b) >= 8 * len(a | b)
        assert int(prints[0] ^ prints[1]).bit_count() <= 8
    docs = spark.createDataFrame([(2 * i + j, t, "en", "a", 0) for i, pair in enumerate(pairs) for j, t in enumerate(pair)], SCHEMA).repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == [0, 2, 4]


@pytest.mark.parametrize("source, bucket", [("variants", 20_000), ("/root/testdata/sf0.01", 20_000), ("/root/testdata/sf0.01", 5)])
def test_pipeline_near_duplicates_go_by_fingerprints(spark, source, bucket, monkeypatch):
    """Without bands, the stage joins the similar ones of each group of fingerprints that links of 8 bits make, and checks their sets."""
    import corpus_pipeline

    monkeypatch.setattr(simhash, "BUCKET", bucket)
    bands = jaccard.by_bands
    monkeypatch.setattr(jaccard, "by_bands", lambda table: bands(table).where("false"))
    texts = near_variants() if source == "variants" else [r.text for r in spark.read.parquet(f"{source}/documents.parquet").collect()]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    sets, _, prints = facts(texts)
    parent, group = list(range(len(texts))), list(range(len(texts)))

    def root(of, x):
        while of[x] != x:
            x = of[x]
        return x

    def join(of, a, b):
        a, b = root(of, a), root(of, b)
        of[max(a, b)] = min(a, b)

    all_pairs = [(a, b) for b in range(len(texts)) for a in range(b)]
    for a, b in all_pairs:
        if int(prints[a] ^ prints[b]).bit_count() <= 8:
            join(group, a, b)
    for a, b in all_pairs:
        if sets[a] == sets[b] or (root(group, a) == root(group, b) and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])):
            join(parent, a, b)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == sorted({root(parent, i) for i in range(len(texts))})
    assert len(got) < len({frozenset(s) for s in sets})


@pytest.mark.parametrize("filtered", [10**6, 0])
def test_levels_of_doubling(spark, tables, monkeypatch, filtered):
    """With filters sent to tasks, and with all levels joined by shuffle."""
    monkeypatch.setattr(substrings, "FILTERED_KEYS", filtered)
    assert substrings.lengths(50) == [7, 13, 25] and substrings.lengths(7) == [7] and substrings.lengths(8) == [4]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    table = [(r.doc_id, r.text) for r in docs.collect()]
    for size in (50, 9):
        out = substrings.deduplicated(docs, size).select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256)).collect()
        assert Counter(tuple(r) for r in out) == brute_repeats(table, size)
    none = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(80))) for i in range(5)], "doc_id long, text string")
    assert substrings.repeated(none).count() == 0


def test_anchors_of_equal_windows_are_equal():
    rng = random.Random(3)
    passage = [rng.choice(["a", "b", "cc"]) for _ in range(80)]
    texts = [" ".join(passage), " ".join(["x"] * 7 + passage + ["y"] * 5)]
    w = substrings.Windows(*utf8(pa.RecordBatch.from_pydict({"text": pa.array(texts)})), 50)
    for length in (7, 13, 25):
        if length > w.level:
            w.extend(length)
        keys, offset = w.keys(w.place), w.place - w.first
        assert ((offset >= 0) & (offset + length <= 50)).all()
        one, two = keys[w.row == 0], keys[w.row == 1][7 : 7 + 31]
        assert (one == two).all() and (offset[w.row == 0] == offset[w.row == 1][7 : 7 + 31]).all()
