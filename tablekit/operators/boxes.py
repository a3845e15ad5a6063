"""Bringing small boxes that lie within a distance of each other together, in any number of dimensions.

The space is cut by a tree of halving planes into regions. A box belongs to the region of its lower corner
(its home) and visits every region within the distance, so a table is copied once for every region a row
meets, whatever the number of columns; no list of pairs is made. Homes and visitors of a region meet block
by block in one task each, where whole arrays are compared.

The tree comes from a bounded sample, which decides how even the regions are and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablekit.functions.storage import checkpoint

#: boxes that the tree is fitted on, regions it has at most, boxes a region should hold
SAMPLE, REGIONS, WANTED = 1 << 17, 1 << 13, 512
#: points of a block
POINTS = 2048


@dataclass
class Tree:
    """Planes by node: axis and cut, children; a region has a number where it has no children."""

    axis: list
    cut: list
    kids: list
    region: list


def fit_tree(corners: np.ndarray, regions: int) -> Tree:
    """Halves the widest axis at the median until there are ``regions`` parts of equal size."""
    tree = Tree([], [], [], [])
    least = max(16, -(-len(corners) // max(1, regions)))
    found = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal found
        me = len(tree.axis)
        for part in (tree.axis, tree.cut, tree.kids, tree.region):
            part.append(None)
        if len(rows) > least:
            axis = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            values = np.sort(rows[:, axis])
            cut = values[len(values) // 2]
            if cut == values[0]:  # a value held by half of the rows: cut after it
                higher = values[values > cut]
                cut = higher[0] if len(higher) else None
            if cut is not None:
                left = rows[:, axis] < cut
                tree.axis[me], tree.cut[me] = axis, float(cut)
                tree.kids[me] = (grow(rows[left]), grow(rows[~left]))
                return me
        tree.region[me] = found
        found += 1
        return me

    grow(corners)
    return tree


def _visits(tree: Tree, lo: np.ndarray, hi: np.ndarray, reach: float, side: float) -> Iterator[tuple[int, np.ndarray]]:
    """(region, rows that come within ``reach`` of a box of ``side`` whose lower corner may lie there)."""
    dims = lo.shape[1]
    todo = [(0, np.arange(len(lo)), np.full(dims, -np.inf), np.full(dims, np.inf))]
    while todo:
        node, rows, low, high = todo.pop()
        gap = np.maximum(np.maximum(low - hi[rows], lo[rows] - (high + side)), 0.0)
        rows = rows[(gap * gap).sum(axis=1) <= reach * reach]
        if not len(rows):
            continue
        if tree.kids[node] is None:
            yield tree.region[node], rows
            continue
        axis, cut = tree.axis[node], tree.cut[node]
        below, above = high.copy(), low.copy()
        below[axis] = above[axis] = cut
        todo += [(tree.kids[node][0], rows, low, below), (tree.kids[node][1], rows, above, high)]


def _homes(tree: Tree, lo: np.ndarray) -> np.ndarray:
    out = np.full(len(lo), -1)
    todo = [(0, np.arange(len(lo)))]
    while todo:
        node, rows = todo.pop()
        if tree.kids[node] is None:
            out[rows] = tree.region[node]
        elif len(rows):
            left = lo[rows, tree.axis[node]] < tree.cut[node]
            todo += [(tree.kids[node][0], rows[left]), (tree.kids[node][1], rows[~left])]
    return out


def matrix(column, dims: int) -> np.ndarray:
    """Rows of an array column of ``dims`` numbers each; null numbers are NaN, which is near nothing."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def tree_for(cells: DataFrame, dims: int) -> Tree:
    """The tree for boxes (``cid``, ``lo``): from at most ``SAMPLE`` of them, picked by a hash."""
    some = cells.orderBy(F.xxhash64("cid"), "cid").select("lo").limit(SAMPLE).toArrow().column("lo")
    corners = matrix(some, dims)
    corners = corners[np.isfinite(corners).all(axis=1)]
    return fit_tree(corners, min(REGIONS, -(-cells.count() // WANTED)))


def placed_in_regions(cells: DataFrame, tree: Tree, reach: float, side: float, dims: int) -> DataFrame:
    """``cells`` (with ``lo``, ``hi`` at most ``side`` apart on any axis) once for every region they meet: with
    ``region``, and ``home`` for the one they belong to."""
    schema = StructType([*cells.schema.fields]).add("region", "integer", False).add("home", "boolean", False)
    names = schema.names
    shared = cells.sparkSession.sparkContext.broadcast(tree)  # at most 2 * REGIONS nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lo, hi = matrix(batch.column("lo"), dims), matrix(batch.column("hi"), dims)
            home = _homes(tree, lo)
            # rounding of the distances that are compared later stays within this
            top = np.nanmax(np.abs(np.concatenate([lo, hi])), initial=0.0)
            slack = reach * 1e-9 + 8 * np.spacing(top)
            for region, rows in _visits(tree, lo, hi, reach + slack, side + slack):
                got = batch.take(pa.array(rows))
                here = [pa.array(np.full(len(rows), region), pa.int32()), pa.array(home[rows] == region)]
                yield pa.RecordBatch.from_arrays([*got.columns, *here], names=names)

    return cells.mapInArrow(run, schema)


def meet(placed: DataFrame, asks: Column, compare: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``compare(homes, visitors)`` over all regions of ``placed``: homes are the rows that ``asks`` holds for,
    visitors all rows, a block of each at a time. Rows count by the points in ``ids``."""
    placed = checkpoint(placed)  # read three times
    points = F.greatest(F.size("ids"), F.lit(1))
    mine = F.col("home") & asks
    blocks = placed.groupBy("region").agg(
        F.ceil(F.sum(F.when(mine, points)) / POINTS).alias("nh"), F.ceil(F.sum(points) / POINTS).alias("nv")
    )
    blocks = F.broadcast(blocks.where("nh > 0"))  # a row per region
    number = F.xxhash64("cid")
    cells = placed.join(blocks, "region")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("nv") - 1))
    homes = cells.where(mine).withColumn("hb", F.pmod(number, F.col("nh"))).withColumn("vb", every)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("nh") - 1))
    visitors = cells.withColumn("vb", F.pmod(number, F.col("nv"))).withColumn("hb", every)
    keys = ["region", "hb", "vb"]
    drop = ["nh", "nv", "home"]
    # columns of one table on both sides need names of their own
    homes, visitors = (side.select(*[F.col(c).alias(c) for c in side.columns if c not in drop]) for side in (homes, visitors))
    # work grows with pairs in a block, not with its bytes, so partitions aren't merged by size
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    homes, visitors = homes.repartition(parts, *keys), visitors.repartition(parts, *keys)
    return homes.groupBy(*keys).cogroup(visitors.groupBy(*keys)).applyInArrow(compare, schema)


class Cells:
    """A block as arrays: ``cid``, corners, and the carried points with the cell each belongs to."""

    def __init__(self, table: pa.Table, dims: int) -> None:
        self.table = table
        self.cid = table.column("cid").to_numpy()
        self.lo, self.hi = matrix(table.column("lo"), dims), matrix(table.column("hi"), dims)
        ids = table.column("ids").combine_chunks()
        self.ids = ids.flatten().to_numpy()
        sizes = np.diff(ids.offsets.to_numpy()) if len(ids) else np.zeros(0, int)
        self.of = np.repeat(np.arange(len(self.cid)), sizes)
        self.carried = sizes > 0
        self.ws = table.column("ws").combine_chunks().flatten().to_numpy()
        self.xs = matrix(table.column("xs"), dims)

    def column(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y, summed axis by axis."""
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        d = x[:, j, None] - y[None, :, j]
        out += d * d
    return out


def gap_and_span(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared smallest and largest distances of all boxes a to all boxes b."""
    gap, span = np.zeros((len(alo), len(blo))), np.zeros((len(alo), len(blo)))
    for j in range(alo.shape[1]):
        d = np.maximum(np.maximum(blo[None, :, j] - ahi[:, j, None], alo[:, j, None] - bhi[None, :, j]), 0.0)
        gap += d * d
        d = np.maximum(bhi[None, :, j] - alo[:, j, None], ahi[:, j, None] - blo[None, :, j])
        span += d * d
    return gap, span


def slices(n: int, size: int = 256) -> Iterator[slice]:
    return (slice(i, min(n, i + size)) for i in range(0, n, size))


def components(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component numbers of the rows and of the columns of a table of links."""
    rows, cols = linked.shape
    row_in, col_in = np.full(rows, -1), np.full(cols, -1)
    for start in range(rows):
        if row_in[start] >= 0:
            continue
        row_in[start] = start
        edge = np.array([start])
        while len(edge):
            new = np.nonzero(linked[edge].any(axis=0) & (col_in < 0))[0]
            col_in[new] = start
            left = np.nonzero(row_in < 0)[0]
            edge = left[linked[np.ix_(left, new)].any(axis=1)] if len(new) else new
            row_in[edge] = start
    col_in[col_in < 0] = rows + np.nonzero(col_in < 0)[0]
    return row_in, col_in
