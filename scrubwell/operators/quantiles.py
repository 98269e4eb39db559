"""Exact quantiles without gathering or sorting a column.

A sketch brackets each wanted rank, one aggregate counts the rows below, on and inside every
bracket, and the bracket shrinks until its inside is small; the insides of all brackets are then
counted by value and searched, one group for each bracket. There is one way for every size and
any number of columns. Sketches and counts are partial aggregates, so a value that fills a third
of the table costs nothing extra: it ends up on a bracket edge and is counted, not collected.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import col

INSIDE_LIMIT = 20_000        # rows inside a bracket that may be searched at once
SKETCH_ACCURACY = 10_000     # rank error of a sketch: rows / accuracy
_BATCH = 200                 # brackets handled by one aggregate


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, dict]:
    """``{column: {"count", "values"}}`` with linear interpolation; columns without values are
    left out."""
    if not columns:
        return {}
    numbers = df.select(*[col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    sizes = numbers.agg(*[F.count(c).alias(c) for c in numbers.columns]).first()
    wanted = {c: (sizes[c], sorted({k for p in probabilities for k in _neighbours(p, sizes[c])}))
              for c in numbers.columns if sizes[c]}
    order = _order_statistics(numbers, wanted)
    return {columns[int(c[1:])]: {
        "count": n, "values": [_interpolate(p, n, order[c]) for p in probabilities]} for c, (n, _) in wanted.items()}


def _neighbours(p: float, n: int) -> tuple[int, int]:
    position = p * (n - 1)
    return math.floor(position), math.ceil(position)


def _interpolate(p: float, n: int, values: dict[int, float]) -> float:
    position = p * (n - 1)
    low, high = _neighbours(p, n)
    if low == high or values[low] == values[high]:
        return values[low]
    a, b, t = values[low], values[high], position - low
    return a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t)


def _order_statistics(df: DataFrame, wanted: dict[str, tuple[int, list[int]]]) -> dict[str, dict[int, float]]:
    """The values at given zero-based ranks of each column."""
    answer: dict[str, dict[int, float]] = {c: {} for c in wanted}
    # open bracket (low, high) per (column, rank): rows inside it and the rank within it
    state = {(c, k): (None, None, n, k) for c, (n, ks) in wanted.items() for k in ks}
    while state:
        small = {t: s for t, s in state.items() if s[2] <= INSIDE_LIMIT}
        _search(df, small, answer)
        state = {t: s for t, s in state.items() if t not in small}
        later = {}
        for some in _batches(state):
            later.update(_narrow(df, some, answer))
        state = later
    return answer


def _batches(state: dict) -> list[dict]:
    items = list(state.items())
    return [dict(items[i:i + _BATCH]) for i in range(0, len(items), _BATCH)]


def _inside(c: str, low, high):
    x = F.col(c)
    if low is not None:
        x = F.when(F.col(c) > low, x)
    if high is not None:
        x = F.when(F.col(c) < high, x)
    return x


def _search(df: DataFrame, small: dict, answer: dict) -> None:
    """The wanted value of brackets with few rows inside. Their rows become (bracket, value) rows,
    are counted map-side, and each bracket's running total is a window of its own."""
    for some in _batches(small):
        brackets = list(some.items())
        # columns with one bracket in common (both neighbours of a rank) are read once
        entries = [(F.lit(i), _inside(c, low, high)) for i, ((c, _), (low, high, _, _)) in enumerate(brackets)]
        cells = df.select(F.stack(F.lit(len(entries)), *[x for e in entries for x in e]).alias("bracket", "value"))
        counted = cells.where(F.col("value").isNotNull()).groupBy("bracket", "value").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(W.partitionBy("bracket").orderBy("value"))
        rank = F.element_at(F.array(*[F.lit(k) for _, (_, _, _, k) in brackets]), F.col("bracket") + 1)
        hit = counted.withColumn("upto", upto).where((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank))
        for r in hit.select("bracket", "value").collect():
            (c, k), _ = brackets[r["bracket"]]
            answer[c][k] = r["value"]


def _narrow(df, state, answer):
    """One sketch pass and one count pass; every open bracket shrinks or yields its answer."""
    slack = 2.0 / SKETCH_ACCURACY
    probes = []
    for i, ((c, _), (low, high, n, k)) in enumerate(state.items()):
        at = k / max(n - 1, 1)
        probes.append(F.percentile_approx(
            _inside(c, low, high), [max(at - slack, 0.0), min(at + slack, 1.0)], SKETCH_ACCURACY).alias(f"p{i}"))
    edges = df.agg(*probes).first()
    counts = []
    for i, ((c, _), (low, high, _, _)) in enumerate(state.items()):
        x, (lo, hi) = _inside(c, low, high), edges[f"p{i}"]
        counts += [F.count_if(x < lo).alias(f"b{i}"), F.count_if(x == lo).alias(f"l{i}"),
                   F.count_if((x > lo) & (x < hi)).alias(f"m{i}"),
                   (F.count_if(x == hi) if hi > lo else F.lit(0)).alias(f"h{i}")]
    row = df.agg(*counts).first()
    left = {}
    for i, ((c, rank), (low, high, n, k)) in enumerate(state.items()):
        lo, hi = edges[f"p{i}"]
        below, on_low, middle, on_high = (row[f"{x}{i}"] for x in "blmh")
        if k < below:                                   # the sketch missed: keep the part below
            left[(c, rank)] = (low, lo, below, k)
        elif k < below + on_low:
            answer[c][rank] = lo
        elif k < below + on_low + middle:
            left[(c, rank)] = (lo, hi, middle, k - below - on_low)
        elif k < below + on_low + middle + on_high:
            answer[c][rank] = hi
        else:
            done = below + on_low + middle + on_high
            left[(c, rank)] = (hi, high, n - done, k - done)
    return left
