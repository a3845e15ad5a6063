"""Exact k nearest neighbours of points with many columns.

In many columns the cells of a pivot partition overlap, so that a query would visit, and be sent to, nearly all of
them. Here a tree over a sample puts points and queries in one order, and blocks of bounded size are cut from it on
both sides. A query first searches the block it belongs to; the distance found bounds the search in all other blocks.
Within a pair of blocks, tiles of rows that follow each other are ruled out by their bounding boxes, query by query;
the others are screened by matrix products, and the few points that may be among the nearest measured by differences.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekit.functions.columns import small_table
from tablekit.functions.storage import checkpoint
from tablekit.operators.boxes import matrix
from tablekit.operators.sample import random_rows

#: numbers of a block, and of the rows that the order is fitted on
BLOCK, SAMPLE = 1 << 23, 1 << 22
MAX_SAMPLE, MAX_LEAVES = 1 << 14, 1 << 12
#: rows of a tile of points, and of queries, and the columns that tell how far a query is from a tile
TILE, ASKED, COLUMNS = 256, 256, 32
FOUND = pa.schema([("qkey", pa.int64()), ("pkey", pa.int64()), ("dist", pa.float64())])


@dataclass
class Order:
    """A tree whose leaves are numbered from left to right; a node without a column (-1) is a leaf."""

    axis: np.ndarray
    cut: np.ndarray
    kids: np.ndarray
    leaf: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        at, live = np.zeros(len(x), int), np.arange(len(x))
        while len(live := live[self.axis[at[live]] >= 0]):
            node = at[live]
            at[live] = self.kids[node, (x[live, self.axis[node]] > self.cut[node]).astype(int)]
        return self.leaf[at]


def fit_order(sample: np.ndarray, leaves: int) -> Order:
    """Parts the group with the largest sum of squares in one column at that column's mean, again and again."""
    axis, cut, kids, todo = [], [], [], []

    def add(rows: np.ndarray) -> int:
        spread = sample[rows].var(axis=0)
        widest = int(spread.argmax()) if len(rows) > 1 else 0
        axis.append(-1), cut.append(0.0), kids.append((0, 0))
        if len(rows) > 1 and spread[widest] > 0:
            heapq.heappush(todo, (-spread[widest] * len(rows), len(axis) - 1, rows, widest))
        return len(axis) - 1

    sample = sample[np.isfinite(sample).all(axis=1)]
    with np.errstate(over="ignore", invalid="ignore"):
        add(np.arange(len(sample)))
        found = 1
        while todo and found < leaves:
            _, node, rows, widest = heapq.heappop(todo)
            mean = sample[rows, widest].mean()
            right = sample[rows, widest] > mean
            if not 0 < right.sum() < len(rows):
                continue
            axis[node], cut[node] = widest, float(mean)
            kids[node] = add(rows[~right]), add(rows[right])
            found += 1
    leaf, number, todo = np.zeros(len(axis), np.int64), 0, [0]
    while todo:
        node = todo.pop()
        if axis[node] < 0:
            leaf[node], number = number, number + 1
        else:
            todo += reversed(kids[node])
    return Order(np.array(axis), np.array(cut), np.array(kids), leaf)


def _placed(df: DataFrame, key: str, order: Order, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = order.of(matrix(b.column("x"), width))
                yield pa.RecordBatch.from_arrays([b.column(key), b.column("x"), pa.array(leaf)], names=[key, "x", "leaf"])

    return checkpoint(df.select(key, "x").mapInArrow(run, f"{key} long, x array<double>, leaf long"))


def _blocks(placed: DataFrame, rows: int) -> tuple[list[tuple[int, int, int]], int]:
    """(leaf, first block, blocks) of every leaf, and the number of blocks: leaves that follow each other share a block
    of ``rows`` rows; a larger one is dealt out to several."""
    plan, block, held = [], 0, 0
    for leaf, n in sorted(tuple(r) for r in placed.groupBy("leaf").count().collect()):  # a row per leaf
        if held and held + n > rows:
            block, held = block + 1, 0
        parts = max(1, math.ceil(n / rows))
        plan.append((leaf, block, parts))
        block, held = (block + parts, 0) if parts > 1 else (block, held + n)
    return plan, block + (held > 0)


def _in_blocks(placed: DataFrame, key: str, plan: list[tuple[int, int, int]], name: str) -> DataFrame:
    table = small_table(placed.sparkSession, plan, "leaf long, first long, parts long")
    block = F.col("first") + F.pmod(F.xxhash64(key), F.col("parts"))
    # MAX_LEAVES rows at most
    return placed.join(F.broadcast(table), "leaf").withColumn(name, block).drop("first", "parts")


def _distances_of(qx: np.ndarray, px: np.ndarray, at: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Distances of pairs, squares added up from the first column to the last."""
    out, step = np.empty(len(at)), max(1, (1 << 20) // px.shape[1])
    for i in range(0, len(at), step):
        gap = qx[at[i : i + step]] - px[pick[i : i + step]]
        out[i : i + step] = np.cumsum(gap * gap, axis=1)[:, -1]
    return np.sqrt(out)


def _merged(at: np.ndarray, pick: np.ndarray, dist: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k nearest for every row, ties by smaller key, with their ranks."""
    order = np.lexsort((keys[pick], dist, at))
    at, pick, dist = at[order], pick[order], dist[order]
    new = np.concatenate([[True], at[1:] != at[:-1]])
    rank = np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    keep = rank < k
    return at[keep], pick[keep], dist[keep], rank[keep]


def _squared_gaps(lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances, over the last axis, of boxes from ``lo`` to ``hi`` to boxes from ``low`` to ``high``, rounded
    down; boxes with NaN are at none."""
    gap = np.maximum(np.maximum(low - hi, lo - high), 0.0)
    out = (gap * gap).sum(axis=-1) * (1 - 1e-9)
    out[np.isnan(out)] = 0.0
    return out


def nearest(qx: np.ndarray, bound: np.ndarray, px: np.ndarray, keys: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, point, distance) for queries by the tile: the k nearest points at ``bound`` or nearer. Rows are in any
    order; the closer rows are that follow each other, the fewer tiles are compared. Squared distances by products in
    single precision are off by less than ``slack``, so no nearest point is missed."""
    plain = not all(np.abs(x).max(initial=0.0) < 1e15 for x in (px, qx))  # products need finite numbers that single precision can square
    starts, width = np.arange(0, len(px), TILE), px.shape[1]
    low, high = np.minimum.reduceat(px, starts, axis=0), np.maximum.reduceat(px, starts, axis=0)
    middle = np.zeros(width) if plain else px.mean(axis=0)
    p32, size = np.empty(px.shape, np.float32), np.zeros(len(px))
    for s in () if plain else starts:
        centred = px[s : s + TILE] - middle
        p32[s : s + TILE], size[s : s + TILE] = centred, (centred * centred).sum(axis=1)
    half_size, top = (size / 2).astype(np.float32), np.sqrt(np.maximum.reduceat(size, starts))
    unit = (width + 8) * float(np.finfo(np.float32).eps)
    with np.errstate(over="ignore", invalid="ignore"):
        widest = np.argsort(-px[:: max(1, len(px) // MAX_LEAVES)].var(axis=0))[:COLUMNS]
    for i in range(0, len(qx), ASKED):
        x, limit = qx[i : i + ASKED], bound[i : i + ASKED] ** 2
        best = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        with np.errstate(over="ignore", invalid="ignore"):
            boxes = _squared_gaps(x.min(axis=0), x.max(axis=0), low, high)
            tiles = np.flatnonzero(boxes <= limit.max() * (1 + 1e-9))
            far = np.zeros((len(x), len(tiles)))
            for j in widest:
                far += _squared_gaps(x[:, j, None, None], x[:, j, None, None], low[tiles, j, None], high[tiles, j, None])
            centred = x - middle
            q32, own = centred.astype(np.float32), (centred * centred).sum(axis=1)
        for t in np.argsort(far.mean(axis=0), kind="stable"):
            rows = np.flatnonzero(far[:, t] <= limit * (1 + 1e-9))
            if not len(rows):
                continue
            lo, hi = starts[tiles[t]], min(len(px), starts[tiles[t]] + TILE)
            if plain:
                hit = np.ones((len(rows), hi - lo), bool)
            else:
                half = half_size[lo:hi] - q32[rows] @ p32[lo:hi].T  # half of the squared distance, without the query's own size
                slack = unit * (np.sqrt(own[rows]) + top[tiles[t]]) ** 2 + 1e-33
                cut = (limit[rows] - own[rows]) / 2 + slack
                hit = half <= np.nextafter(cut.astype(np.float32), np.float32(np.inf))[:, None]
                if hi - lo > k and np.count_nonzero(hit) > 4 * k * len(rows):
                    cut = np.minimum(cut, np.partition(half, k - 1, axis=1)[:, k - 1] + slack)
                    hit = half <= np.nextafter(cut.astype(np.float32), np.float32(np.inf))[:, None]
            at, pick = np.nonzero(hit)
            if not len(at):
                continue
            at, pick = rows[at], pick + lo
            with np.errstate(over="ignore", invalid="ignore"):
                dist = _distances_of(x, px, at, pick)
                fits = dist <= bound[i + at]
            new = [np.concatenate(pair) for pair in zip(best, (at[fits], pick[fits], dist[fits]))]
            if len(new[0]):
                *best, rank = _merged(*new, keys, k)
                last = rank == k - 1
                limit[best[0][last]] = np.minimum(limit[best[0][last]], best[2][last] ** 2)
        yield i + best[0], best[1], best[2]


def _sorted_rows(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Their numbers by the order of the leaves, and that order."""
    order = np.argsort(table.column("leaf").to_numpy(), kind="stable")
    x = table.column("x").combine_chunks()
    x = matrix(x, width) if x.flatten().null_count else x.flatten().to_numpy().reshape(-1, width)
    return x[order], order


def _compared(q: DataFrame, p: DataFrame, k: int, width: int) -> DataFrame:
    """The k nearest (or fewer) of every query and block pair (``pi``, ``qi``)."""

    def block(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows or not known.num_rows:
            return FOUND.empty_table()
        (qx, q_order), (px, p_order) = _sorted_rows(asked, width), _sorted_rows(known, width)
        qkeys, keys = asked.column("qkey").to_numpy()[q_order], known.column("pkey").to_numpy()[p_order]
        found = [np.concatenate(part) for part in zip(*nearest(qx, asked.column("bound").to_numpy()[q_order], px, keys, k))]
        return pa.table([qkeys[found[0]], keys[found[1]], found[2]], schema=FOUND)

    on = ["pi", "qi"]
    q, p = q.select(*on, "leaf", "qkey", "x", "bound"), p.select(*on, "leaf", "pkey", "x")
    return q.groupBy(*on).cogroup(p.groupBy(*on)).applyInArrow(block, "qkey long, pkey long, dist double")


def knn_wide(
    queries: DataFrame, points: DataFrame, n: int, width: int, k: int, points_block: int | None = None, queries_block: int | None = None
) -> DataFrame:
    """``qkey, pkey, dist``: the k nearest of the ``n`` points to every query, and maybe some more rows of it."""
    rows = max(TILE, BLOCK // width)
    sample = matrix(random_rows(points.select("x"), n, max(1, min(MAX_SAMPLE, SAMPLE // width)), 42).toArrow().column("x"), width)
    order = fit_order(sample, max(1, min(MAX_LEAVES, n // TILE)))
    p, q = _placed(points, "pkey", order, width), _placed(queries, "qkey", order, width)
    plan, blocks = _blocks(p, points_block or rows)
    asked, parts = _blocks(q, queries_block or rows)
    p = _in_blocks(p, "pkey", plan, "pi")
    # leaves without a point, if any, start at the first block
    homes = plan + [(leaf, 0, 1) for leaf in sorted({r[0] for r in asked} - {r[0] for r in plan})]
    q = _in_blocks(_in_blocks(q, "qkey", asked, "qi"), "qkey", homes, "home")
    # a row per pair of blocks at most
    pairs = small_table(q.sparkSession, [tuple(r) for r in q.select("home", "qi").distinct().collect()], "pi long, qi long")
    first = q.withColumnRenamed("home", "pi").withColumn("bound", F.lit(float("inf")))
    near = checkpoint(_compared(first, p.join(F.broadcast(pairs), "pi"), k, width))
    if blocks == 1:
        return near
    bounds = near.groupBy("qkey").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("bound"))
    again = q.join(bounds, "qkey").withColumn("pi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    every = p.withColumn("qi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return near.unionByName(_compared(again.filter("pi != home"), every, k, width))
