"""Exact quantiles and order statistics by radix selection.

A double's bits, put in order, are a whole number of 64 bits. Each pass over the table looks at
the next ``DIGIT`` bits of the values that share all bits so far with a wanted one, for all columns and
ranks together: tasks count the digits they see, with the least and greatest value of each, and only these
counts are moved. A rank whose digit holds a single value is found; after 64 bits every one is.
So the work is four passes at most, the counts that reach the driver are bounded (a row per digit, column
and wanted value), and there is one plan for tables of any size and values of any kind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.functions.columns import chunks, quoted

DIGIT = 16
COLUMNS_PER_PASS = 40
#: counts that a task holds before it adds them up
HELD = 1 << 18
_LOWEST = np.int64(-(2**63))
_COUNTS = "target int, digit int, n long, least long, most long"


def _ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of doubles; both zeros are one."""
    b = (x + 0.0).view(np.int64)
    return b ^ ((b >> np.int64(63)) & np.int64(2**63 - 1))


def _value(i: int) -> float:
    b = np.array([i], np.int64)
    return float((b ^ ((b >> np.int64(63)) & np.int64(2**63 - 1))).view(np.float64)[0])


def _added(parts: list[np.ndarray]) -> np.ndarray:
    """Rows of (target, digit, n, least, most), one for each target and digit."""
    rows = np.concatenate(parts, axis=1)
    order = np.lexsort((rows[1], rows[0]))
    rows = rows[:, order]
    first = np.flatnonzero(np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])
    return np.stack([
        rows[0, first],
        rows[1, first],
        np.add.reduceat(rows[2], first),
        np.minimum.reduceat(rows[3], first),
        np.maximum.reduceat(rows[4], first),
    ])


def _digits(targets: list[tuple[int, int]], done: int, width: int):
    """Counts of the ``width`` bits behind the first ``done``, for targets (column, those first bits)."""
    by_column: dict[int, list[tuple[int, int]]] = {}
    for t, (c, prefix) in enumerate(targets):
        by_column.setdefault(c, []).append((t, prefix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for c, wanted in by_column.items():
                column = batch.column(c).drop_null()
                if not len(column):
                    continue
                s = _ordered(column.to_numpy())
                u = (s ^ _LOWEST).view(np.uint64)
                for t, prefix in wanted:
                    some, own = u, s
                    if done:
                        hit = u >> np.uint64(64 - done) == np.uint64(prefix)
                        some, own = u[hit], s[hit]
                        if not len(some):
                            continue
                    d = (some >> np.uint64(64 - done - width) & np.uint64(2**width - 1)).astype(np.uint16)
                    order = np.argsort(d, kind="stable")  # by radix
                    d, own = d[order], own[order]
                    first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                    n = np.diff(np.r_[first, len(d)])
                    held.append(np.stack([np.full(len(first), t), d[first], n, np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)]).astype(np.int64))
                    size += len(first)
            if size > HELD:
                held = [_added(held)]
                size = held[0].shape[1]
        if held:
            rows = _added(held)
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names=[x.split()[0] for x in _COUNTS.split(", ")])

    return run


def _pass(narrow: DataFrame, targets: list[tuple[int, int]], done: int, width: int) -> list[np.ndarray]:
    """Per target its (digit, n, least, most), by digit."""
    found = narrow.mapInArrow(_digits(targets, done, width), _COUNTS).groupBy("target", "digit")
    rows = found.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).toArrow()
    table = np.stack([rows.column(c).to_numpy() for c in ("target", "digit", "n", "least", "most")]).astype(np.int64)
    table = table[:, np.lexsort((table[1], table[0]))]
    at = np.searchsorted(table[0], np.arange(len(targets) + 1))
    return [table[1:, at[t] : at[t + 1]] for t in range(len(targets))]


def _select(narrow: DataFrame, wanted: Mapping[int, Sequence[float]], width: int, probs: bool) -> tuple[dict[int, int], dict[tuple[int, int], float]]:
    """Values per column, and the value at each wanted (column, rank). With ``probs`` the ranks beside each
    probability are wanted, else the given ranks."""
    columns = list(wanted)
    targets: list[tuple[int, int]] = [(c, 0) for c in columns]
    counted = _pass(narrow, targets, 0, width)
    sizes = {c: int(rows[1].sum()) for c, rows in zip(columns, counted)}
    asked: list[list[tuple[int, int]]] = []  # per target: (rank, rank among the target's values)
    for c in columns:
        n = sizes[c]
        if probs:
            ranks = {f(p * (n - 1)) for p in wanted[c] for f in (math.floor, math.ceil)} if n else set()
        else:
            ranks = {int(x) for x in wanted[c]}
        asked.append([(x, x) for x in sorted(ranks)])
    found: dict[tuple[int, int], float] = {}
    done = width
    while True:
        nexts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for (c, prefix), rows, ranks in zip(targets, counted, asked):
            upto = np.cumsum(rows[1])
            for rank, within in ranks:
                i = int(np.searchsorted(upto, within, "right"))
                if rows[2, i] == rows[3, i]:
                    found[c, rank] = _value(int(rows[2, i]))
                else:
                    nexts.setdefault((c, prefix << width | int(rows[0, i])), []).append((rank, within - int(upto[i] - rows[1, i])))
        if not nexts:
            return sizes, found
        targets, asked = list(nexts), list(nexts.values())
        last = min(width, 64 - done)
        counted, width = _pass(narrow, targets, done, last), last
        done += last


def exact_quantiles(df: DataFrame, probs: Mapping[str, Sequence[float]], digit: int = DIGIT) -> dict[str, dict[float, float | None]]:
    """Linear-interpolation quantiles of several columns; missing values are skipped.

    A column without values gives None for every probability.
    """
    names = [c for c in probs if len(probs[c])]
    out: dict[str, dict[float, float | None]] = {}
    for part in chunks(names, COLUMNS_PER_PASS):
        narrow = df.selectExpr(*[f"double({quoted(c)}) AS q{i}" for i, c in enumerate(part)])
        sizes, values = _select(narrow, {i: probs[c] for i, c in enumerate(part)}, digit, True)
        for i, c in enumerate(part):
            out[c] = {}
            for p in probs[c]:
                if not sizes[i]:
                    out[c][p] = None
                    continue
                pos = p * (sizes[i] - 1)
                a, b = values[i, math.floor(pos)], values[i, math.ceil(pos)]
                out[c][p] = a + (b - a) * (pos - math.floor(pos))
    return out


def rank_value(df: DataFrame, value: Column, rank: int, digit: int = DIGIT) -> float:
    """The value at 0-based ``rank`` among the non-missing values of a column."""
    return _select(df.select(value.cast("double").alias("v")), {0: [rank]}, digit, False)[1][0, rank]


def first_k(df: DataFrame, order: Sequence[Column], k: int, digit: int = DIGIT) -> Column:
    """Predicate for the first ``k`` rows in the order of the given columns.

    Each order column must be exact as a double and the whole list unique. Works on
    one column after the other, so ties of any size never meet in one task.
    """
    picked = F.lit(False)
    tied = F.lit(True)
    left = k
    for i, c in enumerate(order):
        c = c.cast("double")
        scope = df.filter(tied)
        n = scope.agg(F.count(c)).first()[0]
        if left <= 0:
            break
        if n <= left:
            return picked | (tied & c.isNotNull())
        bound = rank_value(scope, c, left - 1, digit)
        less = scope.agg(F.count_if(c < F.lit(bound))).first()[0]
        picked = picked | (tied & (c < F.lit(bound)))
        left -= less
        tied = tied & (c == F.lit(bound))
        if i == len(order) - 1 and left > 0:
            picked = picked | tied
    return picked
