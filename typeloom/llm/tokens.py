"""Token ids: encoding whole texts with a public tokenizer, and flat binary token files.

A token file set is a folder with, for each part, `ids` (flat little-endian unsigned integers, 16 bits wide
where the vocabulary fits, else 32), `starts` (64-bit places of the documents within the part) and `docs`
(64-bit document ids, in order), and `manifest.json`, which holds each part's base: the number of ids and
documents in the parts before it, by prefix sums. Parts are in ascending doc_id order, so a document's global
start is its part's base plus its entry in `starts`. Local files are memory-mapped when read.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import mixed, ship, slices, utf8

BYTE_BPE = "byte_bpe_50k.json"
END_ID = 2

#: Ids that a task reads at a time; a longer document is read alone.
READ_IDS = 1 << 18

#: Units whose ids an encoder keeps; slots of their hash table; units looked up at a time.
KEPT_UNITS, TABLE_BITS, LOOKED_UP = 400_000, 20, 1 << 16

#: Bytes of a unit that the table holds, beside its length; longer ones are encoded as they come.
KEY_BYTES = 31

# Kinds of bytes: letter, digit, mark, white space and others.
_LETTER, _DIGIT, _MARK, _SPACE, _OTHER = range(5)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[x for x in range(33, 127) if chr(x) != "'"]] = _MARK
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE

#: U+00C0 to U+00FF are letters but for two signs, U+0100 to U+017F all are; these are their lead bytes.
_LATIN1, _LATIN1_SIGNS, _LATIN_A = 0xC3, (0x97, 0xB7), (0xC4, 0xC5)

#: White space of several bytes, and controls that some take for white space.
_ODD_SPACES = [c.encode() for c in map(chr, range(0x80, 0x3001)) if c.isspace()]
_ODD_CONTROLS = range(0x1C, 0x20)

_MASKS = np.array([[(1 << 8 * max(0, min(8, n - 8 * i))) - 1 for i in range(4)] for n in range(KEY_BYTES + 1)], dtype=np.uint64)
_FACTORS = mixed(np.arange(4, dtype=np.uint64), 21) | np.uint64(1)
_ENCODERS: dict[str, "Encoder"] = {}


def units(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the units of the texts in `raw` start, and which of them are one pre-token for certain.

    The usual byte-level pattern splits runs of letters, of digits and of other marks; a space before a run belongs to it,
    and of more white space the last character stands alone unless the text ends there. Texts are split so wherever that
    follows from ASCII and two-byte Latin letters. Other characters, and apostrophes, stay in one unit with all about
    them, up to single spaces between characters that are not white space, where the pattern always splits.
    """
    kind = _KIND[raw]
    odd = kind == _SPACE
    space = odd.copy()
    for x in _ODD_CONTROLS:
        odd |= raw == x
    if (raw >= 0x80).any():
        for lead in (_LATIN1, *_LATIN_A):
            at = np.flatnonzero(raw[:-1] == lead)
            if lead == _LATIN1:
                at = at[~np.isin(raw[at + 1], _LATIN1_SIGNS)]
            kind[at] = kind[at + 1] = _LETTER
        for first in {c[0] for c in _ODD_SPACES}:
            for at in (x for x in [np.flatnonzero(raw == first)] if len(x)):
                for c in (c for c in _ODD_SPACES if c[0] == first):
                    same = at[at + len(c) <= len(raw)]
                    for i in range(1, len(c)):
                        same = same[raw[same + i] == c[i]]
                    for i in range(len(c)):
                        odd[same + i] = True
    row = np.zeros(len(raw) + 1, dtype=bool)
    row[bounds] = True
    first, last = row[:-1], row[1:]
    blank = raw == 0x20
    start = first.copy()
    start[1:] |= np.where(space[1:], ~space[:-1], (kind[1:] != kind[:-1]) & ~blank[:-1])
    start[:-1] |= space[:-1] & ~space[1:] & ~last[:-1]
    if not (kind == _OTHER).any():
        starts = np.flatnonzero(start)
        return starts, np.ones(len(starts), dtype=bool)
    safe = first.copy()
    safe[1:-1] |= blank[1:-1] & ~odd[:-2] & ~odd[2:] & ~last[1:-1]
    chunk = np.flatnonzero(safe)
    whole = np.maximum.reduceat(kind, chunk) == _OTHER
    start &= np.repeat(~whole, np.diff(np.append(chunk, len(raw))))
    start[chunk] = True
    starts = np.flatnonzero(start)
    return starts, ~whole[np.searchsorted(chunk, starts, side="right") - 1]


class Encoder:
    """Encodes texts with a tokenizers file, the same ids as encode_batch(texts, add_special_tokens=False).

    For a byte-level BPE with the usual splitting pattern, texts are cut into units that are encoded independently of each
    other. The ids of short units are kept in a hash table of arrays, keyed by the units' own bytes, so that known units
    cost no Python object each. A full table keeps the units that were met again. Texts with an added token, and all texts
    of other tokenizers, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        spec = json.loads(self.tokenizer.to_str())
        splitter = spec.get("pre_tokenizer") or {}
        self.by_unit = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space") and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        if self.by_unit:
            self.alphabet = str.maketrans({chr(i): c for i, c in enumerate(self._alphabet())})
        self._clear()

    @staticmethod
    def at(path: str) -> "Encoder":
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]

    @staticmethod
    def _alphabet() -> list[str]:
        """The characters that stand for the 256 bytes: themselves if printable, else the next ones from U+0100."""
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = iter(range(0x100, 0x200))
        return [chr(i if i in shown else next(hidden)) for i in range(256)]

    def _clear(self) -> None:
        self.n = self.filled = 0
        self.table = np.full(1 << TABLE_BITS, -1, dtype=np.int32)
        self.keys = np.zeros((1 << 12, 4), dtype=np.uint64)
        self.begin, self.count, self.met = (np.zeros(1 << 12, dtype=np.int64) for _ in range(3))
        self.pool = np.zeros(1 << 14, dtype=np.uint32)

    def plain(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def encode(self, raw: np.ndarray, bounds: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, those of each text with end_id behind them if given, and each text's bounds in them."""
        if not len(raw):
            return self._ended(np.zeros(0, dtype=np.uint32), np.zeros(len(bounds), dtype=np.int64), end_id)
        starts, single = units(raw, bounds) if self.by_unit else (bounds[:-1][np.diff(bounds) > 0], None)
        if single is None:
            single = np.zeros(len(starts), dtype=bool)
        elif self.added:
            starts, single = self._apart(raw, bounds, starts, single)
        ends, flat, many = np.append(starts[1:], len(raw)), [], []
        for at in range(0, len(starts), LOOKED_UP):
            ids, n = self._units(raw, starts[at : at + LOOKED_UP], ends[at : at + LOOKED_UP], single[at : at + LOOKED_UP])
            flat.append(ids), many.append(n)
        place = np.concatenate([[0], np.cumsum(np.concatenate(many))])
        return self._ended(np.concatenate(flat), place[np.searchsorted(starts, bounds)], end_id)

    @staticmethod
    def _ended(ids: np.ndarray, cuts: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        if end_id is None:
            return ids, cuts
        return np.insert(ids, cuts[1:], np.uint32(end_id)), cuts + np.arange(len(cuts))

    def _apart(self, raw: np.ndarray, bounds: np.ndarray, starts: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold an added token are one unit each."""
        text, rows = raw.tobytes(), set()
        for token in self.added:
            at = text.find(token)
            while at >= 0:
                rows.add(int(np.searchsorted(bounds, at, side="right")) - 1)
                at = text.find(token, at + 1)
        if not rows:
            return starts, single
        own = np.searchsorted(bounds, starts, side="right") - 1
        held = np.isin(own, list(rows))
        single = single & ~held
        keep = ~held | (starts == bounds[own])
        return starts[keep], single[keep]

    def _units(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units' ids, end to end, and how many each has."""
        size = ends - starts
        short = np.flatnonzero(size <= KEY_BYTES) if self.by_unit else np.zeros(0, dtype=np.int64)
        piece = raw[starts[0] : ends[-1]]
        padded = np.zeros(len(piece) + 32, dtype=np.uint8)
        padded[: len(piece)] = piece
        wide = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(piece) + 25,), (1,))
        at = starts[short] - starts[0]
        keys = wide[at[:, None] + np.array([0, 8, 16, 24])] & _MASKS[size[short]]
        keys[:, 3] |= size[short].astype(np.uint64) << np.uint64(56)
        h = (keys * _FACTORS).sum(axis=1, dtype=np.uint64)
        slot = (mixed(h) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        entry = np.full(len(starts), -1, dtype=np.int64)
        entry[short] = self._find(keys, slot)
        self.met[:] += np.bincount(entry[entry >= 0], minlength=len(self.met))
        none = entry[short] < 0
        if none.any():
            _, first, same = np.unique(h[none], return_index=True, return_inverse=True)
            new = np.flatnonzero(none)
            one = new[first]
            alike = (keys[new] == keys[one[same]]).all(axis=1)
            self._learn(raw, starts, ends, single, short, keys, slot, one)
            known = self.n - len(one) + same
            entry[short[new[alike]]] = known[alike]
        rest = np.flatnonzero(entry < 0)
        pool, begin, count = self.pool, self.begin, self.count
        if len(rest):
            ids = self._fresh(raw, starts[rest], ends[rest], single[rest])
            entry[rest] = len(begin) + np.arange(len(rest))
            n = np.array([len(x) for x in ids], dtype=np.int64)
            begin = np.concatenate([begin, self.filled + np.cumsum(n) - n])
            count = np.concatenate([count, n])
            pool = np.concatenate([pool[: self.filled], *(np.asarray(x, dtype=np.uint32) for x in ids)])
        many = count[entry]
        place = np.repeat(begin[entry] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        out = pool[place]
        if self.n > KEPT_UNITS:
            self._forget()
        return out, many

    def _find(self, keys: np.ndarray, slot: np.ndarray) -> np.ndarray:
        found, todo, slot = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), slot.copy()
        while len(todo):
            held = self.table[slot[todo]]
            some = held >= 0
            todo, held = todo[some], held[some]
            same = (self.keys[held] == keys[todo]).all(axis=1)
            found[todo[same]] = held[same]
            todo = todo[~same]
            slot[todo] = (slot[todo] + 1) & (len(self.table) - 1)
        return found

    def _learn(self, raw, starts, ends, single, short, keys, slot, one) -> None:
        """Appends the short units numbered `one`, which are different and not in the table."""
        at = short[one]
        ids = self._fresh(raw, starts[at], ends[at], single[at])
        n = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(n.sum()))
        self._append(keys[one], slot[one], n, flat)

    def _append(self, keys: np.ndarray, slot: np.ndarray, n: np.ndarray, flat: np.ndarray) -> None:
        to, filled = self.n + len(keys), self.filled + len(flat)
        if to > len(self.keys):
            more = max(to, 2 * len(self.keys)) - len(self.keys)
            self.keys = np.concatenate([self.keys, np.zeros((more, 4), dtype=np.uint64)])
            self.begin, self.count, self.met = (np.concatenate([x, np.zeros(more, dtype=np.int64)]) for x in (self.begin, self.count, self.met))
        if filled > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(filled, 2 * len(self.pool)) - len(self.pool), dtype=np.uint32)])
        self.keys[self.n : to], self.count[self.n : to], self.begin[self.n : to] = keys, n, self.filled + np.cumsum(n) - n
        self.met[self.n : to] = 0
        self.pool[self.filled : filled] = flat
        todo, slot = np.arange(len(keys)), slot.copy()
        while len(todo):
            free = todo[self.table[slot[todo]] < 0]
            self.table[slot[free]] = self.n + free
            todo = todo[self.table[slot[todo]] != self.n + todo]
            slot[todo] = (slot[todo] + 1) & (len(self.table) - 1)
        self.n, self.filled = to, filled

    def _forget(self) -> None:
        """Keeps the units met most often, up to half of the table, and of these only such as were met again."""
        most = np.argsort(-self.met[: self.n], kind="stable")[: KEPT_UNITS // 2]
        most = np.sort(most[self.met[most] > 0])
        keys, n, begin, met, pool = self.keys[most], self.count[most], self.begin[most], self.met[most], self.pool
        self._clear()
        place = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        slot = (mixed((keys * _FACTORS).sum(axis=1, dtype=np.uint64)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        self._append(keys, slot, n, pool[place])
        self.met[: self.n] = met // 2

    def _fresh(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, single: np.ndarray) -> list[list[int]]:
        """Ids of units by the tokenizer: of single pre-tokens by its model alone."""
        base = int(starts.min()) if len(starts) else 0
        text = raw[base : int(ends.max(initial=base))].tobytes()
        cut = [text[a:b] for a, b in zip((starts - base).tolist(), (ends - base).tolist(), strict=True)]
        word, alphabet = self.tokenizer.model.tokenize, self.alphabet if self.by_unit else None
        out = [[t.id for t in word(x.decode("latin-1").translate(alphabet))] if one else None for x, one in zip(cut, single.tolist(), strict=True)]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self.plain([cut[i].decode() for i in rest]), strict=True):
            out[i] = ids
        return out


def tokenizer_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(batches, path: str, end_id: int, passed: list[str]):
    """For each slice of the record batches: its passed columns as arrays, all texts' ids (null: none), each with the end id
    behind them, and the texts' bounds in these."""
    encoder = Encoder.at(path)
    for batch in slices(batches):
        yield [batch.column(batch.schema.get_field_index(c)) for c in passed], *encoder.encode(*utf8(batch), end_id)


def binaries(ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The runs of ids between the cuts as binaries of little-endian unsigned 32-bit integers."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts * 4)), pa.py_buffer(ids)]).cast(pa.binary())


def with_ids(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id and `ids`, a binary of little-endian unsigned 32-bit token ids that ends with end_id.

    Every row gives a row. A null or empty text gives the end id alone; a null doc_id stays null. Other columns
    of docs are not read.
    """
    ship(docs.sparkSession)
    path = path or tokenizer_path()

    def run(batches):
        for (doc_id,), ids, cuts in encoded(batches, path, end_id, ["doc_id"]):
            yield pa.RecordBatch.from_arrays([doc_id, binaries(ids, cuts)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def _store(uri: str):
    """The file system of a folder's URI and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _mapped(uri: str, name: str, dtype: str) -> np.ndarray:
    """A flat file as an array: memory-mapped if the store is local, else read."""
    from pyarrow import fs

    store, folder = _store(uri)
    path = f"{folder}/{name}"
    if isinstance(store, fs.LocalFileSystem):
        import os

        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype=dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def _between(uri: str, name: str, dtype: str):
    """A function of a and b that gives a flat file's values from place a to b: from a memory map if the store is local, else read by
    their offset, so that no file needs to fit into memory."""
    from pyarrow import fs

    store, folder = _store(uri)
    if isinstance(store, fs.LocalFileSystem):
        whole = _mapped(uri, name, dtype)
        return lambda a, b: whole[a:b]
    file, size = store.open_input_file(f"{folder}/{name}"), np.dtype(dtype).itemsize
    return lambda a, b: np.frombuffer(file.read_at(int(b - a) * size, int(a) * size), dtype=dtype)


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> dict:
    """Writes the token files of all documents to a folder that all executors share, and returns the manifest.

    Documents are range-partitioned by doc_id (null first; ties by a hash of the text, so that one id in many rows
    still spreads) and sorted. Each task writes its part under a name of its own and renames it when whole, so a
    lost or repeated task leaves the same files. Null text counts as empty. No documents: no parts.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or tokenizer_path()
    dtype = "<u2" if Encoder.at(path).size <= 1 << 16 and end_id < 1 << 16 else "<u4"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, source.rdd.getNumPartitions())
    ordered = source.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        part = f"part-{TaskContext.get().partitionId():06d}"
        names = {k: f"{base}/{part}.{k}.{uuid.uuid4().hex}.tmp" for k in ("ids", "starts", "docs", "nulls")}
        files = {k: store.open_output_stream(v) for k, v in names.items()}
        n_docs = n_ids = 0
        for (doc_id,), ids, cuts in encoded(batches, path, end_id, ["doc_id"]):
            files["ids"].write(ids.astype(dtype).tobytes())
            files["starts"].write((n_ids + cuts[:-1]).astype("<u8").tobytes())
            files["docs"].write(np.asarray(pa.compute.fill_null(doc_id, 0)).astype("<i8").tobytes())
            files["nulls"].write(np.asarray(pa.compute.is_null(doc_id)).astype("u1").tobytes())
            n_docs, n_ids = n_docs + len(doc_id), n_ids + len(ids)
        for k, f in files.items():
            f.close()
            store.move(names[k], f"{base}/{part}.{k}")
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [n_docs], "n_ids": [n_ids]})

    rows = ordered.mapInArrow(run, "part string, n_docs long, n_ids long").collect()
    manifest = {"dtype": dtype, "end_id": end_id, "parts": []}
    docs_before = ids_before = 0
    for r in sorted(rows):
        manifest["parts"].append({"part": r.part, "n_docs": r.n_docs, "n_ids": r.n_ids, "docs_before": docs_before, "ids_before": ids_before})
        docs_before, ids_before = docs_before + r.n_docs, ids_before + r.n_ids
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document of a token file set: doc_id, start, n_tokens and its ids as a binary of the file's integers."""
    ship(spark)
    store, base = _store(folder)
    with store.open_input_stream(f"{base}/manifest.json") as f:
        manifest = json.loads(f.read())
    dtype = manifest["dtype"]
    schema = "doc_id long, start long, n_tokens long, ids binary"
    parts = [(p["part"], p["ids_before"], p["n_ids"]) for p in manifest["parts"] if p["n_docs"]]
    if not parts:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for part, before, n_ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                starts, docs, nulls = (_mapped(folder, f"{part}.{k}", t) for k, t in (("starts", "<u8"), ("docs", "<i8"), ("nulls", "u1")))
                ids = _between(folder, f"{part}.ids", dtype)
                bounds = np.append(starts, n_ids).astype(np.int64)
                edges = np.flatnonzero(np.diff(bounds[:-1] // READ_IDS)) + 1
                for at, to in zip([0, *edges], [*edges, len(docs)], strict=True):
                    own = bounds[at : to + 1]
                    flat = ids(own[0], own[-1]).astype("<u4")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.asarray(docs[at:to], dtype=np.int64), pa.int64(), mask=np.asarray(nulls[at:to], dtype=bool)),
                            pa.array(own[:-1] + before, pa.int64()),
                            pa.array(np.diff(own), pa.int64()),
                            binaries(flat, own - own[0]),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return spark.createDataFrame(parts, "part string, before long, n_ids long").repartition(len(parts)).mapInArrow(run, schema)
