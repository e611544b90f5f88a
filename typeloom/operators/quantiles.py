"""Exact, interpolating quantiles of any number of columns, in a few passes and bounded memory.

A sketch brackets the values that a quantile lies between; one more pass counts what is below the bracket and lists the
values inside it. A bracket with too many values is narrowed by a sketch of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import config

ACCURACY = 2000


def quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float] | None]:
    """Each column's quantiles, interpolated linearly between the values at places (n - 1) p; None without values.

    Columns are numeric; nulls and NaN are left out.
    """
    if not columns:
        return {}
    most = max(1000, config.get_option("exact_values_in_a_task") // max(1, len(columns)))
    value = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in columns}
    row = df.agg(*(F.count(v).alias(f"n{i}") for i, v in enumerate(value.values()))).first()
    sizes = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    # For each place among the sorted values the bracket that holds it: least and greatest value, values below it, values in it.
    places = {(c, k): (None, None, 0, sizes[c]) for c in columns if sizes[c] for p in probabilities for x in [(sizes[c] - 1) * p] for k in (math.floor(x), math.ceil(x))}
    found: dict[tuple[str, int], float] = {}
    while todo := {w: b for w, b in places.items() if w not in found}:
        spans = sorted({(c, *b) for (c, _), b in todo.items()}, key=str)
        exprs = []
        for i, (c, low, high, below, n) in enumerate(spans):
            if n <= most:  # sorted once; only the values at the wanted places leave the task
                wanted = _wanted(todo, spans[i])
                listed = F.array(F.struct(F.array_sort(F.collect_list(_inside(value[c], low, high))).alias("s")))
                exprs.append(F.transform(listed, _places(wanted))[0].alias(f"x{i}"))
            else:
                near = {min(1.0, max(0.0, (k - below) / n + d)) for (a, k), b in todo.items() if (a, *b) == spans[i] for d in (-2 / ACCURACY, 2 / ACCURACY)}
                exprs.append(F.percentile_approx(_inside(value[c], low, high), F.array(*map(F.lit, sorted(near))), F.lit(ACCURACY)).alias(f"x{i}"))
        seen = df.agg(*exprs).first()
        edges: dict[str, set] = {}
        for i, (c, low, high, below, n) in enumerate(spans):
            if n <= most:
                at = dict(zip(_wanted(todo, spans[i]), seen[i], strict=True))
                found |= {(a, k): at[k - below] for (a, k), b in todo.items() if (a, *b) == spans[i]}
            else:
                edges.setdefault(c, set()).update(seen[i])
        if edges:
            _narrow(df, value, places, found, edges)
    out: dict[str, list[float] | None] = {}
    for c in columns:
        out[c] = None if not sizes[c] else []
        for p in probabilities if sizes[c] else ():
            x = (sizes[c] - 1) * p
            a, b = found[c, math.floor(x)], found[c, math.ceil(x)]
            out[c].append(a + (b - a) * (x - math.floor(x)))
    return out


def _wanted(todo: dict, span: tuple) -> list[int]:
    """Places within a bracket, from 0, of the values that are looked for."""
    return sorted({k - b[2] for (a, k), b in todo.items() if (a, *b) == span})


def _places(wanted: list[int]):
    return lambda x: F.array(*(F.get(x["s"], F.lit(k)) for k in wanted))


def _inside(v, low, high):
    """v where it lies between the two values, themselves left out; None bounds nothing."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (v > low)
    if high is not None:
        ok = ok & (v < high)
    return F.when(ok, v)


def _narrow(df: DataFrame, value, places: dict, found: dict, edges: dict[str, set]) -> None:
    """One pass of exact counts at all edges: a place that an edge's own value holds is found, others get closer brackets."""
    flat = [(c, e) for c, es in edges.items() for e in sorted(es)]
    row = df.agg(*(x for i, (c, e) in enumerate(flat) for x in (F.count_if(value[c] < e).alias(f"l{i}"), F.count_if(value[c] <= e).alias(f"u{i}")))).first()
    at = {c: [(e, row[f"l{i}"], row[f"u{i}"]) for i, (d, e) in enumerate(flat) if d == c] for c in edges}
    for (c, k), (low, high, below, n) in places.items():
        if (c, k) in found or c not in at:
            continue
        end = below + n
        for e, less, upto in at[c]:
            if less <= k < upto:
                found[c, k] = e
                break
            if upto <= k and upto >= below:
                low, below = e, upto
            if less > k and less <= end:
                high, end = (e, less) if less < end or high is None else (high, end)
        places[c, k] = (low, high, below, end - below)
