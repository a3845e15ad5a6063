"""Second-order gradient boosting over histograms, for numbers and for any number of classes.

Columns are cut into bins once. A round grows one tree for each class together, level by level: every task adds up
first and second derivatives by node, column and bin into arrays, whatever its number of rows, and Spark adds the
arrays of the tasks. A node takes the cut of largest gain, trying missing values on both sides. So a level is one
pass over the rows, and the driver holds sums and trees only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekit.functions.columns import col
from tablekit.functions.storage import checkpoint, spread
from tablekit.operators.boxes import matrix, slices
from tablekit.operators.sample import random_rows

#: cells of a pass; more columns than fit are taken in several passes
CELLS = 1 << 23
#: rounds after which the rows' scores are written, so that passes do not walk all trees again
REFRESH = 16


@dataclass
class Tree:
    """A tree of full depth: node i has the children 2i+1 and 2i+2; rows of a node without a column go left."""

    column: np.ndarray
    cut: np.ndarray  # the last bin that goes left
    gaps_left: np.ndarray  # where missing values go
    value: np.ndarray  # by leaf
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = (1 << depth) - 1
        return Tree(np.full(n, -1), np.zeros(n, int), np.zeros(n, bool), np.zeros(n + 1), np.zeros(n))


def _places(tree: Tree, bins: np.ndarray, missing: int, levels: int) -> np.ndarray:
    """Number of the node, within its level, that every row has reached after ``levels``."""
    at = np.zeros(len(bins), int)
    rows = np.arange(len(bins))
    for _ in range(levels):
        column = tree.column[at]
        b = bins[rows, np.maximum(column, 0)]
        left = np.where(b == missing, tree.gaps_left[at], b <= tree.cut[at]) | (column < 0)
        at = 2 * at + 2 - left
    return at - ((1 << levels) - 1)


def _add_trees(scores: np.ndarray, rounds: list[list[Tree]], bins: np.ndarray, missing: int, depth: int) -> np.ndarray:
    for trees in rounds:
        for k, tree in enumerate(trees):
            scores[:, k] += tree.value[_places(tree, bins, missing, depth)]
    return scores


def _odds(scores: np.ndarray) -> np.ndarray:
    """Class shares of raw scores; one column is the score of the second of two classes."""
    if scores.shape[1] == 1:
        p = 1 / (1 + np.exp(-np.clip(scores, -500, 500)))
        return np.concatenate([1 - p, p], axis=1)
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _derivatives(scores: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, float]:
    """First and second derivatives of the loss by row and tree, and the loss."""
    w = w[:, None]
    if not classes:
        d = scores - y[:, None]
        return d * w, np.broadcast_to(w, d.shape), float((d * d * w).sum() / 2)
    p = _odds(scores)
    own = p[np.arange(len(y)), y.astype(int)]
    loss = -float((np.log(np.maximum(own, 1e-300)) * w[:, 0]).sum())
    if scores.shape[1] == 1:
        p = p[:, 1:]
        is_it = y[:, None]
    else:
        is_it = y[:, None] == np.arange(classes)
    return (p - is_it) * w, p * (1 - p) * w, loss


def _edges(sample: np.ndarray, bins: int) -> list[np.ndarray]:
    """Upper ends of the bins of every column, at most ``bins - 1`` of them: halfway between neighbouring values."""
    out = []
    for x in sample.T:
        values = np.unique(x[np.isfinite(x)])
        if len(values) > bins:
            values = np.unique(np.quantile(x[np.isfinite(x)], np.linspace(0, 1, bins), method="lower"))
        out.append(values[:-1] + np.diff(values) / 2)
    return out


def _binned(x: np.ndarray, edges: list[np.ndarray], missing: int) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), missing, np.searchsorted(e, x[:, j], side="left"))
    return out


def _bytes(column, width: int, kind) -> np.ndarray:
    """Rows of a binary column of equal lengths, as they lie in its buffer."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), width)


def _packed(rows: np.ndarray) -> pa.Array:
    """The reverse: a binary value per row."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows[:1].nbytes
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(rows.ravel().view(np.uint8))])


def best_cuts(g: np.ndarray, h: np.ndarray, missing: int, shrink: float, least: float) -> tuple[np.ndarray, ...]:
    """For sums by (node, column, bin): gain, column, last bin to the left and side of missing values of every node's
    best cut, and (g, h) to its left. The first of equal gains counts; no gain is -inf."""
    nodes, columns, _ = g.shape
    whole_g, whole_h = g[:, :1].sum(axis=2, keepdims=True), h[:, :1].sum(axis=2, keepdims=True)
    gaps_g, gaps_h = g[:, :, missing : missing + 1], h[:, :, missing : missing + 1]
    run_g, run_h = (np.cumsum(v[:, :, :missing], axis=2) for v in (g, h))
    left_g = np.stack([run_g + gaps_g, run_g])  # missing values left, right
    left_h = np.stack([run_h + gaps_h, run_h])
    right_g, right_h = whole_g - left_g, whole_h - left_h
    gain = left_g**2 / (left_h + shrink) + right_g**2 / (right_h + shrink) - whole_g**2 / (whole_h + shrink)
    gain = np.where((left_h >= least) & (right_h >= least) & (gain > 1e-9), gain, -np.inf)
    flat = np.moveaxis(gain, 1, 0).reshape(nodes, -1)
    at = flat.argmax(axis=1)
    side, column, cut = np.unravel_index(at, (2, columns, missing))
    rows = np.arange(nodes)
    return flat[rows, at], column, cut, side == 0, left_g[side, rows, column, cut], left_h[side, rows, column, cut]


class HistogramBoosting:
    """Estimator over a vector column. ``classes`` is 0 for a numeric target, else their number (labels 0, 1, ...);
    two classes take one tree a round, more take one each, tied by the softmax.

    ``bin_rows`` bounds the rows that the bins' ends are taken from; trees see all rows. NaN in a vector is a missing
    value. Boosting ends early when no node has a cut, or the mean loss falls by less than ``tolerance`` of its start.
    """

    def __init__(
        self,
        classes: int,
        features: str,
        label: str,
        weight: str,
        prediction: str,
        probability: str,
        rounds: int = 50,
        depth: int = 3,
        rate: float = 0.2,
        bins: int = 64,
        shrink: float = 1.0,
        least: float = 1.0,
        tolerance: float = 1e-4,
        bin_rows: int = 1 << 14,
        seed: int = 42,
    ) -> None:
        if not 2 <= bins <= 255 or classes == 1:
            raise ValueError("2 to 255 bins, and no or at least two classes")
        self.__dict__.update({k: v for k, v in locals().items() if k != "self"})

    def fit(self, df: DataFrame) -> HistogramBoostingModel:
        """Rows with a missing label are left out; without rows there is no model."""
        x = vector_to_array(col(self.features))
        rows = df.select(x.alias("x"), col(self.label).cast("double").alias("y"), col(self.weight).cast("double").alias("w"))
        rows = rows.filter("y IS NOT NULL")
        n = rows.count()
        some = random_rows(rows.select("x"), n, self.bin_rows, self.seed).toArrow().column("x")
        if not len(some):
            raise ValueError("boosting needs rows")
        sample = matrix(some, len(some[0]))
        edges = _edges(sample, self.bins)
        start = self._start(rows)
        table = self._table(rows, edges, start, n)
        total = table.agg(F.sum("w")).first()[0]
        rounds: list[list[Tree]] = []
        recent: list[list[Tree]] = []
        losses: list[float] = []
        for _ in range(self.rounds):
            trees, loss = self._grow(table, recent, len(edges), len(start))
            losses.append(loss / total)
            slow = len(losses) > 1 and losses[-2] - losses[-1] < self.tolerance * abs(losses[0])
            if slow or all((t.column < 0).all() for t in trees):
                break
            rounds.append(trees)
            recent.append(trees)
            if len(recent) == REFRESH:
                table, recent = self._refreshed(table, recent, len(edges), len(start)), []
        return HistogramBoostingModel.of(self, edges, start, rounds)

    def _start(self, rows: DataFrame) -> np.ndarray:
        if not self.classes:
            return np.array([rows.agg(F.sum(F.col("w") * F.col("y")) / F.sum("w")).first()[0]])
        found = {int(r["y"]): r["w"] for r in rows.groupBy("y").agg(F.sum("w").alias("w")).collect()}  # a row per class
        share = np.array([found.get(k, 0.0) for k in range(self.classes)])
        logs = np.log(np.maximum(share / share.sum(), 1e-9))
        return logs[1:] - logs[:1] if self.classes == 2 else logs

    def _table(self, rows: DataFrame, edges: list[np.ndarray], start: np.ndarray, n: int) -> DataFrame:
        """Bins ``b`` and scores ``f`` of every row as bytes, with ``y`` and ``w``."""
        missing = self.bins
        first = start.astype(float)[None]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins = _binned(matrix(batch.column("x"), len(edges)), edges, missing)
                packed = [_packed(bins), _packed(np.repeat(first, len(bins), axis=0))]
                yield pa.RecordBatch.from_arrays([*packed, batch.column("y"), batch.column("w")], names=["b", "f", "y", "w"])

        return checkpoint(spread(rows.mapInArrow(run, "b binary, f binary, y double, w double"), n))

    def _refreshed(self, table: DataFrame, recent: list[list[Tree]], columns: int, trees: int) -> DataFrame:
        missing, depth = self.bins, self.depth

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins = _bytes(batch.column("b"), columns, np.uint8)
                scores = _add_trees(_bytes(batch.column("f"), trees, float).copy(), recent, bins, missing, depth)
                new = _packed(scores)
                yield pa.RecordBatch.from_arrays([batch.column("b"), new, batch.column("y"), batch.column("w")], names=["b", "f", "y", "w"])

        return checkpoint(table.mapInArrow(run, table.schema))

    def _grow(self, table: DataFrame, recent: list[list[Tree]], columns: int, trees: int) -> tuple[list[Tree], float]:
        """A tree for each score, and the loss before them."""
        grown = [Tree.empty(self.depth) for _ in range(trees)]
        sums: dict[tuple[int, int], tuple[float, float]] = {}
        loss = 0.0
        for level in range(self.depth):
            nodes = 1 << level
            size = max(1, CELLS // (2 * trees * nodes * (self.bins + 1)))
            best = [None] * trees
            for lo in range(0, columns, size):
                hi = min(columns, lo + size)
                g, h, loss_now = self._pass(table, recent, grown, level, lo, hi, columns)
                loss = loss_now if level == 0 else loss
                for k in range(trees):
                    if level == 0 and lo == 0:
                        sums[k, 0] = (float(g[k, 0, 0].sum()), float(h[k, 0, 0].sum()))
                    gain, column, cut, gaps, lg, lh = best_cuts(g[k], h[k], self.bins, self.shrink, self.least)
                    new = np.stack([gain, column + lo, cut, gaps, lg, lh])
                    old = best[k]
                    best[k] = new if old is None else np.where(new[0] > old[0], new, old)
            for k, tree in enumerate(grown):
                for n in range(nodes):
                    node = nodes - 1 + n
                    all_g, all_h = sums.get((k, node), (0.0, 0.0))
                    gain, column, cut, gaps, lg, lh = best[k][:, n]
                    if np.isfinite(gain) and (k, node) in sums:
                        tree.column[node], tree.cut[node], tree.gaps_left[node] = int(column), int(cut), bool(gaps)
                        tree.gain[node] = gain
                        sums[k, 2 * node + 1], sums[k, 2 * node + 2] = (lg, lh), (all_g - lg, all_h - lh)
                    elif (k, node) in sums:
                        sums[k, 2 * node + 1] = (all_g, all_h)
        leaves = 1 << self.depth
        for k, tree in enumerate(grown):
            for n in range(leaves):
                g, h = sums.get((k, leaves - 1 + n), (0.0, 0.0))
                tree.value[n] = -self.rate * g / (h + self.shrink)
        return grown, loss

    def _pass(
        self, table: DataFrame, recent: list[list[Tree]], grown: list[Tree], level: int, lo: int, hi: int, columns: int
    ) -> tuple[np.ndarray, np.ndarray, float]:
        """Sums of both derivatives by (tree, node of the level, column, bin), and the loss."""
        trees, nodes, missing, depth, classes = len(grown), 1 << level, self.bins, self.depth, self.classes
        shape = (2, trees, nodes, hi - lo, missing + 1)
        per_node = (hi - lo) * (missing + 1)
        shared = table.sparkSession.sparkContext.broadcast((recent, grown))  # at most REFRESH + 1 rounds of trees

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            recent, grown = shared.value
            total, lost = np.zeros((2, trees, nodes * per_node)), 0.0
            first = np.arange(hi - lo) * (missing + 1)
            for batch in batches:
                if not batch.num_rows:
                    continue
                every = _bytes(batch.column("b"), columns, np.uint8)
                scores = _bytes(batch.column("f"), trees, float).copy()
                y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
                for s in slices(len(every), max(64, (1 << 20) // (hi - lo))):
                    bins = every[s]
                    now = _add_trees(scores[s], recent, bins, missing, depth)
                    g, h, loss = _derivatives(now, y[s], w[s], classes)
                    lost += loss
                    cell = first + bins[:, lo:hi]
                    for k in range(trees):
                        at = (cell + _places(grown[k], bins, missing, level)[:, None] * per_node).ravel()
                        for which, v in ((0, g), (1, h)):
                            total[which, k] += np.bincount(at, np.repeat(v[:, k], hi - lo), nodes * per_node)
            flat = np.append(total.ravel(), lost)
            found = np.nonzero(flat)[0]
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(flat[found])], names=["i", "v"])

        sums = table.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # CELLS at most
        shared.unpersist()
        flat = np.zeros(int(np.prod(shape)) + 1)
        flat[sums.column("i").to_numpy()] = sums.column("v").to_numpy()
        g, h = flat[:-1].reshape(shape)
        return g, h, float(flat[-1])


class HistogramBoostingModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted trees; adds raw class shares (for classes) and the prediction. Kept and loaded like any stage."""

    columns = Param(Params._dummy(), "columns", "names of the feature, prediction and probability columns", TypeConverters.toListString)
    trees = Param(Params._dummy(), "trees", "edges, start and trees as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, columns=None, trees=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @staticmethod
    def of(fitted: HistogramBoosting, edges: list[np.ndarray], start: np.ndarray, rounds: list[list[Tree]]) -> HistogramBoostingModel:
        about = {
            "classes": fitted.classes,
            "depth": fitted.depth,
            "missing": fitted.bins,
            "edges": [e.tolist() for e in edges],
            "start": start.tolist(),
            "rounds": [[[t.column.tolist(), t.cut.tolist(), t.gaps_left.tolist(), t.value.tolist(), t.gain.tolist()] for t in r] for r in rounds],
        }
        return HistogramBoostingModel(columns=[fitted.features, fitted.prediction, fitted.probability], trees=json.dumps(about))

    @property
    def featureImportances(self) -> DenseVector:
        """Share of every feature in the gains of all cuts."""
        about = json.loads(self.getOrDefault(self.trees))
        out = np.zeros(len(about["edges"]))
        for column, _cut, _gaps, _value, gain in (t for r in about["rounds"] for t in r):
            used = np.array(column) >= 0
            np.add.at(out, np.array(column)[used], np.array(gain)[used])
        return DenseVector(out / max(out.sum(), 1e-300))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        features, prediction, probability = self.getOrDefault(self.columns)
        about = json.loads(self.getOrDefault(self.trees))
        edges = [np.array(e, float) for e in about["edges"]]
        rounds = [[Tree(*[np.array(p) for p in t]) for t in r] for r in about["rounds"]]
        start, missing, depth, classes = np.array(about["start"]), about["missing"], about["depth"], about["classes"]

        @F.arrow_udf("array<double>")
        def scored(x: pa.Array) -> pa.Array:
            rows, parts = matrix(x, len(edges)), []
            for s in slices(len(rows), 4096):
                bins = _binned(rows[s], edges, missing)
                scores = _add_trees(np.tile(start, (len(bins), 1)), rounds, bins, missing, depth)
                parts += list(_odds(scores) if classes else scores)
            return pa.array(parts, pa.list_(pa.float64()))

        out = dataset.withColumn("_tk_scores", scored(vector_to_array(col(features))))
        if not classes:
            return out.withColumn(prediction, F.get("_tk_scores", F.lit(0))).drop("_tk_scores")
        top = F.array_position("_tk_scores", F.array_max("_tk_scores")) - 1
        return out.withColumns({prediction: top.cast("double"), probability: array_to_vector("_tk_scores")}).drop("_tk_scores")
