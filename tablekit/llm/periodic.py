"""Periodic runs of words: stretches that repeat a block of words over and over, and texts without them.

A run is a stretch with smallest period q and at least ``repeats`` times q words (and ``least`` words), which
no neighbouring word extends. Runs are found as maximal pairs. Where a run of length L begins at word s,
the suffixes at s and s + q agree in exactly L - q words and are preceded by different words; and every pair
of suffixes that is maximal to both sides and less than a third of its agreement apart is such a stretch,
so nothing has to be extended. A stretch is found once for each multiple of its period; the smallest counts.

All texts of a slice are sorted together: words are numbered text by text, so suffixes of different texts
never agree, and prefix doubling goes on only with suffixes that still have company. Groups of suffixes whose
nearest two are too far apart for their agreement are left out. The others become LCP-intervals, visited
bottom-up. An interval keeps the places of its suffixes in order, with the word to the left of each as its
class; where two children meet, the places of the smaller are looked up in the larger and pairs of different
classes reported. Of places within reach of each other all but the first have the same class (the text
between is periodic), so the first place in reach tells whether there is anything to report, and the work
is that of the merges and of the pairs found.

Words are what stands between blanks and control characters 9 to 13, compared byte by byte. Null counts as
an empty text: no words, no runs. The work on a text needs memory in proportion to it; nothing is shuffled.
Columns of ``docs`` with the names of results are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.functions.columns import col
from tablekit.llm.base import extended, mapped
from tablekit.llm.words import byte_slices

RESULT = "n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes in order, and the ranks by the first 1, 2, 4, ... numbers while any two were alike. Ranks
    are padded by one place, which is less than all others."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    new = np.r_[True, ids[order[1:]] != ids[order[:-1]]]
    start = np.flatnonzero(new)
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = np.repeat(start, np.diff(np.r_[start, n]))
    levels, size = [(1, rank)], 1
    shared = np.repeat(np.diff(np.r_[start, n]) > 1, np.diff(np.r_[start, n]))
    active = order[shared]
    while len(active):
        key = rank[active].astype(np.int64) * (n + 1) + rank[np.minimum(active + size, n)] + 1
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        group = rank[active]
        first = np.r_[True, group[1:] != group[:-1]]
        part = np.r_[True, key[1:] != key[:-1]]
        at = np.arange(len(active))
        base = np.maximum.accumulate(np.where(first, at, 0))
        low = np.maximum.accumulate(np.where(part, at, 0))
        order[group + at - base] = active
        rank = rank.copy()
        rank[active] = group + low - base
        size *= 2
        edges = np.flatnonzero(part)
        n_part = np.diff(np.r_[edges, len(active)])
        active = active[np.repeat(n_part > 1, n_part)]
        levels.append((size, rank))
    return order, levels


def agreements(order: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """How many numbers each suffix has in common with the one before it in order; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    one = levels[0][1]
    at = np.flatnonzero(one[order[1:]] == one[order[:-1]]) + 1
    a, b, n = order[at - 1].astype(np.int64), order[at].astype(np.int64), len(order)
    common = np.zeros(len(at), np.int64)
    for size, rank in reversed(levels):
        x, y = np.minimum(a + common, n), np.minimum(b + common, n)
        common += size * ((rank[x] == rank[y]) & (x < n) & (y < n))
    out[at] = common
    return out


def worth_visiting(order: np.ndarray, common: np.ndarray, reach: int, least: int) -> Iterator[tuple[int, int]]:
    """Ranges of the order whose suffixes agree in ``least`` numbers with the next, where some two are near
    enough to each other for a run."""
    group = np.cumsum(common < least)
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[edges, len(group)])
    many = np.repeat(size > 1, size)
    if not many.any():
        return
    g, p, c = group[many], order[many], common[many]
    by = np.lexsort((p, g))
    gap = np.diff(p[by], prepend=0)
    head = np.r_[True, g[1:] != g[:-1]]  # groups stay where they are
    gap[head] = np.iinfo(np.int32).max
    c = np.where(head, 0, c)
    first = np.flatnonzero(head)
    near = np.minimum.reduceat(gap, first) * reach <= np.maximum.reduceat(c, first)
    for k in np.flatnonzero(size > 1)[near]:
        yield int(edges[k]), int(edges[k] + size[k])


def maximal_pairs(order: list[int], common: list[int], left: np.ndarray, reach: int) -> Iterator[tuple[int, int, int]]:
    """(place, later place, agreement) of all pairs of suffixes that are maximal to both sides and at most a
    ``reach``-th of their agreement apart. common[k] is of order[k] and the one before."""
    found: list[tuple[int, int, int]] = []

    def met(one: list[int], other: list[int], depth: int) -> list[int]:
        """Places of both children of an interval; pairs across them are noted."""
        small, large = (one, other) if len(one) < len(other) else (other, one)
        far = depth // reach
        for i in small:
            c = left[i]
            k = bisect_left(large, i - far)
            if k < len(large) and large[k] < i and left[large[k]] != c:
                found.append((large[k], i, depth))
            k = bisect_right(large, i)
            if k < len(large) and large[k] <= i + far and left[large[k]] != c:
                for j in large[k : bisect_right(large, i + far)]:
                    found.append((i, j, depth))
        if 8 * len(small) > len(large):
            large = sorted(large + small)
        else:
            for i in small:
                insort(large, i)
        return large

    stack: list[tuple[int, list[int]]] = []
    for k in range(1, len(order) + 1):
        now = [order[k - 1]]
        depth = common[k] if k < len(order) else -1
        while stack and stack[-1][0] > depth:
            above, places = stack.pop()
            now = met(places, now, above)
        if stack and stack[-1][0] == depth:
            stack[-1] = (depth, met(stack[-1][1], now, depth))
        else:
            stack.append((depth, now))
    yield from found


def runs_of(ids: np.ndarray, left: np.ndarray, repeats: int, least: int) -> dict[tuple[int, int], int]:
    """Smallest period by (start, length) of all runs."""
    out: dict[tuple[int, int], int] = {}
    reach = repeats - 1
    order, levels = suffix_order(ids)
    common = agreements(order, levels)
    # a run of period q has a pair that agrees in max(least, repeats q) - q numbers
    shallow = min(max(least, repeats * q) - q for q in range(1, least + 1))
    for lo, hi in worth_visiting(order, common, reach, shallow):
        for i, j, depth in maximal_pairs(order[lo:hi].tolist(), common[lo:hi].tolist(), left, reach):
            q = j - i
            if depth + q >= least and q < out.get((i, depth + q), q + 1):
                out[i, depth + q] = q
    return out


def find_runs(docs: DataFrame, text: str = "text", repeats: int = 4, least: int = 6) -> DataFrame:
    """The columns of ``docs`` with n_words, runs (start, length, period, by start and period) and collapsed:
    the words that no run holds after its first period, with a blank between."""
    if repeats < 2 or least < 1:
        raise ValueError("runs repeat at least once and have a word")
    added = [f.split()[0] for f in ("n_words long", "runs array", "collapsed string")]
    kept = docs.select(*(col(c) for c in docs.columns if c not in added))
    names, n = kept.columns, len(kept.columns)
    rows = docs.select(*(col(c) for c in names), col(text).cast("string").alias("_words_of"))
    schema = extended(kept.schema.fields, RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in byte_slices(batch.column(n)):
                raw = data.tobytes()
                texts = [raw[a:b].split() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                size = np.array([len(w) for w in texts], np.int64)
                first = np.cumsum(size) - size
                number: list[int] = []
                used = 0
                for words in texts:
                    own: dict[bytes, int] = {}
                    number.extend([own.setdefault(w, used + len(own)) for w in words])
                    used += len(own)
                ids = np.array(number, np.int64)
                left = np.r_[-1, ids[:-1]]
                left[first[size > 0]] = -1
                found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                if len(ids):
                    every = runs_of(ids, left, repeats, least)
                    row = np.searchsorted(first + size, [s for s, _ in every], "right")
                    for ((s, length), q), i in zip(every.items(), row.tolist()):
                        found[i].append((s - int(first[i]), length, q))
                collapsed = []
                for words, mine in zip(texts, found):
                    if mine:
                        mine.sort(key=lambda x: (x[0], x[2]))
                        step = np.zeros(len(words) + 1, np.int64)
                        for s, length, q in mine:
                            step[s + q] += 1
                            step[s + length] -= 1
                        words = compress(words, (np.cumsum(step[:-1]) == 0).tolist())
                    collapsed.append(b" ".join(words))
                flat = [x for mine in found for x in mine]
                parts = [pa.array([x[k] for x in flat], pa.int64()) for k in range(3)]
                offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                made = [
                    pa.array(size),
                    pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=list(_RUN))),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:n]), *made], names=[*names, *added])

    return mapped(rows, run, schema)


def strongest(runs_column: str) -> Column:
    """The run with the greatest exact length over period; ties by smallest start, then period."""
    first = F.try_element_at(col(runs_column), F.lit(1))
    return F.aggregate(
        col(runs_column), first, lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best)
    )
