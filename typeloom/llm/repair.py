"""Repair of conversations whose rows are lost, empty, doubled, cut short or given to the wrong role.

A conversation is to be empty, or an optional system row and then user and assistant in turn, ending with the assistant. A
forward Viterbi pass over its rows holds, for each of the grammar's four states, the least (cost, audit): audit has a letter an
edit, Keep, Rerole, Delete or Insert. After each row its layer is closed by at most two insertions. Of audits that cost the same
none begins with another, as a letter adds cost that the rows fix; so the least of two stays the least whatever follows, and it
suffices to hold one a state.

Rows are sorted by range, so a very long conversation lies in several tasks. Conversations within one task are done there. Of
those that a range cuts, every part gives the least (cost, audit) from each state to each; these join one after the other like
the rows themselves, and then each part is edited where it lies. No task holds more than a range and one audit.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ship, written

#: States: nothing yet, after system, after user, after assistant; the first and last may end a conversation.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3

Best = dict[int, tuple[int, str]]


def _put(layer: Best, state: int, cost: int, audit: str) -> None:
    held = layer.get(state)
    if held is None or (cost, audit) < held:
        layer[state] = (cost, audit)


def closed(layer: Best) -> Best:
    """The layer with at most two rows inserted: user after nothing, system or assistant, assistant after user."""
    for _ in range(2):
        for state, (cost, audit) in list(layer.items()):
            _put(layer, ASSISTANT if state == USER else USER, cost + INSERT, audit + "I")
    return layer


def advanced(layer: Best, role: str, fault: int) -> Best:
    """The closed layer after one more row."""
    out: Best = {}
    for state, (cost, audit) in layer.items():
        _put(out, state, cost + DELETE, audit + "D")
        if fault not in (BLANK, DUPLICATE):
            cut = CUT if fault == TRUNCATED else 0
            if (to := MOVES.get(role[:1], {}).get(state)) is not None:
                _put(out, to, cost + cut, audit + "K")
            _put(out, ASSISTANT if state == USER else USER, cost + cut + REROLE, audit + "R")
    return closed(out)


def joined(start: Best, parts: dict[tuple[int, int], tuple[int, str]]) -> tuple[Best, dict[int, int]]:
    """What a part makes of a layer, and the state that each of its states is reached from."""
    out: Best = {}
    origin: dict[int, int] = {}
    for (a, b), (cost, audit) in parts.items():
        if a in start:
            new = start[a][0] + cost, start[a][1] + audit
            if b not in out or new < out[b]:
                out[b], origin[b] = new, a
    return out, origin


def edited(rows: list[tuple[str, str]], audit: str, state: int):
    """(edit, role, text) of the rows that an audit leaves or makes, from a state on."""
    out, at = [], 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        if edit in "RI":
            role = "assistant" if state == USER else "user"
        state = MOVES[role[:1]][state]
        out.append((edit, role, text))
    return out


def _solved(rows: list[tuple[str, str, int]], start: Best) -> Best:
    return reduce(lambda layer, r: advanced(layer, r[0], r[2]), rows, start)


def best(layer: Best) -> tuple[int, str]:
    """The least way to end: with nothing, or after the assistant."""
    return min(layer[s] for s in (NOTHING, ASSISTANT) if s in layer)


def text_fault(text: Column) -> Column:
    """BLANK, TRUNCATED or 0, by the text alone."""
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)


_SCHEMA = "conv_id long, part int, place long, role string, text string, edit string, fault int, digest string, cost long, audit string, blank long, duplicate long, truncated long, illegal long"
_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), *((c, pa.string()) for c in ("role", "text", "edit")), ("fault", pa.int32()), ("digest", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal"))])
_COUNTS = "blank long, duplicate long, truncated long, illegal long"
_COUNTED = [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]
_WAY = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("ways", pa.list_(_WAY)), *_COUNTED, ("head", pa.string()), ("tail", pa.string())])
_CHAIN = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("state", pa.int32()), ("base", pa.int64()), ("letters", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), *_COUNTED])
_LINES = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), *((c, pa.string()) for c in ("edit", "role", "text"))])


def _counted(rows: list[tuple[str, str, int]]) -> dict[str, int]:
    faults = [r[2] for r in rows]
    illegal = sum((a[0][:1], b[0][:1]) not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    return {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED), "illegal": illegal}


def _whole(batches):
    """Reports and repaired rows of the conversations that lie within a range; rows of its first and last as they are."""
    part = TaskContext.get().partitionId()

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)

    def made():
        waiting, seen = None, 0
        for conv, group in groupby(rows(), key=lambda r: r[0]):
            if waiting is not None:
                yield from opened(*waiting) if seen == 1 else repaired(*waiting)
            waiting = conv, [r[1:] for r in group]
            seen += 1
        if waiting is not None:
            yield from opened(*waiting)

    def opened(conv, group):
        for i, (role, text, fault, digest) in enumerate(group):
            yield {"conv_id": conv, "part": part, "place": i, "role": role, "text": text, "fault": fault, "digest": digest}

    def repaired(conv, group):
        met: set = set()
        rows = []
        for role, text, fault, digest in group:
            rows.append((role, text, DUPLICATE if fault != BLANK and (role, digest) in met else fault))
            met.add((role, digest))
        cost, audit = best(_solved([(r[0], "", r[2]) for r in rows], closed({NOTHING: (0, "")})))
        yield {"conv_id": conv, "cost": cost, "audit": audit, **_counted(rows)}
        for i, (edit, role, text) in enumerate(edited([r[:2] for r in rows], audit, NOTHING)):
            yield {"conv_id": conv, "place": i, "edit": edit, "role": role, "text": text}

    held, size = [], 0
    for r in made():
        held.append(r)
        size += len(r.get("text") or "") + 200
        if size > 4 << 20:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports (conv_id, blank, duplicate, truncated, illegal, cost, audit) and repaired rows (conv_id, place from 0, edit, role,
    text), from rows with conv_id, turn, role and text; other columns are not looked at.

    Rows are taken by turn, nulls first, then by role and text (its first 32 characters, then its hash). Null roles and texts count
    as one space; rows with a null conv_id are one conversation. Repeated rows are duplicates of the first. A conversation all of
    whose rows go has a report and no rows; no rows give none.
    """
    ship(rows.sparkSession)
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    keyed = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    keyed = keyed.withColumns({"fault": text_fault(F.col("text")), "digest": F.sha2("text", 256)})
    # The last key only spreads repeated rows over ranges.
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 32), F.col("digest"), F.monotonically_increasing_id()]
    named = keyed.withColumns({f"_{i}": c for i, c in enumerate(order[3:])})
    order = [*order[:3], *(F.col(f"_{i}") for i in range(3))]
    ranged = named.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text", "fault", "digest")
    first = written(ranged.mapInArrow(_whole, _SCHEMA), "conversations")
    report, fixed = first.where("cost is not null"), first.where("edit is not null")
    columns, lines = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"], ["conv_id", "place", "edit", "role", "text"]
    cut_report, cut_rows = _stitched(first.where("digest is not null").select("conv_id", "part", "place", "role", "text", "fault", "digest"))
    return report.select(columns).unionByName(cut_report.select(columns)), fixed.select(lines).unionByName(cut_rows.select(lines))


def _stitched(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """repair's results for conversations that ranges cut: rows lie in parts, and in places within them."""
    key = ["conv_id", "role", "digest"]
    many = rows.groupBy(*key).agg(F.min(F.struct("part", "place")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n").alias("m")
    same = reduce(lambda a, b: a & b, (F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in key))
    later = F.col("first").isNotNull() & (F.struct("part", "place") != F.col("first")) & (F.col("fault") != BLANK)
    told = rows.alias("r").join(many, same, "left").select("r.conv_id", "part", "place", "r.role", "text", F.when(later, DUPLICATE).otherwise(F.col("fault")).cast("int").alias("fault"))
    told = written(told, "cut-conversations")

    def ways(x: pa.Table) -> pa.Table:
        own = sorted(x.to_pylist(), key=lambda r: r["place"])
        rows = [(r["role"], "", r["fault"]) for r in own]
        found = [{"a": a, "b": b, "cost": c, "audit": t} for a in range(4) for b, (c, t) in _solved(rows, {a: (0, "")}).items()]
        return pa.Table.from_pylist([{"conv_id": own[0]["conv_id"], "part": own[0]["part"], "ways": found, **_counted(rows), "head": rows[0][0][:1], "tail": rows[-1][0][:1]}], schema=_PARTS)

    parts = told.select("conv_id", "part", "place", "role", "fault").groupBy("conv_id", "part").applyInArrow(ways, f"conv_id long, part int, ways array<struct<a: int, b: int, cost: long, audit: string>>, {_COUNTS}, head string, tail string")

    def chain(x: pa.Table) -> pa.Table:
        own = sorted(x.to_pylist(), key=lambda r: r["part"])
        lead = closed({NOTHING: (0, "")})
        layer, back = lead, []
        for r in own:
            layer, origin = joined(layer, {(w["a"], w["b"]): (w["cost"], w["audit"]) for w in r["ways"]})
            back.append(origin)
        cost, audit = best(layer)
        state = min((s for s in (NOTHING, ASSISTANT) if s in layer), key=lambda s: layer[s])
        starts = [state]
        for origin in reversed(back):
            starts.append(origin[starts[-1]])
        starts.reverse()
        report = {"cost": cost, "audit": audit, **{k: sum(r[k] for r in own) for k in ("blank", "duplicate", "truncated", "illegal")}}
        report["illegal"] += sum((a["tail"], b["head"]) not in LEGAL for a, b in zip(own, own[1:], strict=False))
        # A part's letters are those of its way; what is inserted before all rows goes with the first.
        out, kept, begin, extra = [], 0, NOTHING, lead[starts[0]][1]
        for r, a, b in zip(own, starts[:-1], starts[1:], strict=True):
            letters = extra + next(w["audit"] for w in r["ways"] if (w["a"], w["b"]) == (a, b))
            out.append({"conv_id": r["conv_id"], "part": r["part"], "state": begin, "base": kept, "letters": letters, **report})
            kept, begin, extra, report = kept + len(letters) - letters.count("D"), b, "", {}
        return pa.Table.from_pylist(out, schema=_CHAIN)

    chained = written(parts.groupBy("conv_id").applyInArrow(chain, f"conv_id long, part int, state int, base long, letters string, cost long, audit string, {_COUNTS}"), "chains")
    steps = chained.select("conv_id", "part", "state", "base", "letters")

    def apply(x: pa.Table, how: pa.Table) -> pa.Table:
        own, (h,) = sorted(x.to_pylist(), key=lambda r: r["place"]), how.to_pylist()
        out = edited([(r["role"], r["text"]) for r in own], h["letters"], h["state"])
        return pa.Table.from_pylist([{"conv_id": h["conv_id"], "place": h["base"] + i, "edit": edit, "role": role, "text": text} for i, (edit, role, text) in enumerate(out)], schema=_LINES)

    fixed = told.groupBy("conv_id", "part").cogroup(steps.groupBy("conv_id", "part")).applyInArrow(apply, "conv_id long, place long, edit string, role string, text string")
    return chained.where("cost is not null"), fixed


def digests(fixed: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, the SHA-256 of a conversation's `role:text` rows, joined by newlines. A digest reads its bytes in
    order, so one task reads a conversation, but as a stream: it holds a batch."""

    def run(batches):
        digest, now, any_ = None, None, False
        for batch in batches:
            done = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not any_ or conv != now:
                    if any_:
                        done.append((now, digest.hexdigest()))
                    digest, now, any_ = hashlib.sha256(), conv, True
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], names=["conv_id", "repaired_sha256"])
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return fixed.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of rows after damage that depends on conv_id and turn: dropped, emptied, without marks at
    sentences' ends, doubled, or given to the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    out = rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("_copy"))
    return out.drop("_copy")


def audited(rows: DataFrame) -> DataFrame:
    """The report of every conversation of `rows` after damage: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    and repaired_sha256; zeros, no letters and the digest of nothing where no row is left."""
    kept = damaged(rows)
    reports, fixed = repair(kept)
    turns = kept.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for side in (turns, reports, digests(fixed)):
        side = side.withColumnRenamed("conv_id", "_id")
        out = out.join(side, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    nothing = hashlib.sha256().hexdigest()
    return out.select("conv_id", *map(zero, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))

