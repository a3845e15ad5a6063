"""k-means of many starts and cluster numbers together: a round is one pass over the rows for all of them.

Every task assigns its rows to the centres of all fits still moving and gives one row of sums per centre, whatever
its number of rows. The driver holds centres only. First centres are drawn from a bounded sample, which decides
where fits start and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.functions.columns import col
from tablekit.functions.storage import spread
from tablekit.operators.boxes import apart, matrix, slices
from tablekit.operators.sample import random_rows

#: rows that first centres are drawn from
SEEDS = 1 << 13


@dataclass
class Fit:
    """Centres of one k-means and the squared distances of all rows to the nearest, added up."""

    centres: np.ndarray
    cost: float


def first_centres(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows, each drawn with odds by the squared distance to those before; copies of rows where there are too
    few different ones."""
    picked = [rows[rng.integers(len(rows))]]
    far = apart(rows, picked[0][None])[:, 0]
    while len(picked) < k:
        total = far.sum()
        at = rng.choice(len(rows), p=far / total) if total > 0 else rng.integers(len(rows))
        picked.append(rows[at])
        far = np.minimum(far, apart(rows, rows[at][None])[:, 0])
    return np.array(picked)


def _features(names: Sequence[str]) -> Column:
    return F.array(*[col(c).cast("double") for c in names])


def _pass(points: DataFrame, fits: list[np.ndarray], middle: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(rows, sums, cost) by centre for every fit, of one pass over ``points`` (``x``). Sums are taken around
    ``middle``."""
    dims = len(middle)
    ends = np.cumsum([0, *[len(c) for c in fits]])
    shared = points.sparkSession.sparkContext.broadcast(np.concatenate(fits) - middle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        half = (centres * centres).sum(axis=1) / 2
        total = np.zeros((len(centres), 2 + dims))  # rows, cost, sums
        for batch in batches:
            if not batch.num_rows:
                continue
            every = matrix(batch.column("x"), dims) - middle
            for s in slices(len(every), 1024):
                x = every[s]
                gain = x @ centres.T - half  # largest at the nearest centre
                own = np.zeros(gain.shape)
                at = np.arange(len(x))[:, None]
                size = (x * x).sum(axis=1)[:, None]
                best = np.stack([lo + gain[:, lo:hi].argmax(axis=1) for lo, hi in zip(ends[:-1], ends[1:])], axis=1)
                own[at, best] = 1.0
                cost = np.maximum(size - 2 * gain[at, best], 0.0)
                total[:, 1] += np.bincount(best.ravel(), cost.ravel(), len(centres))
                total[:, 0] += own.sum(axis=0)
                total[:, 2:] += own.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    sums = points.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    got = sums.toArrow()  # centres times columns
    shared.unpersist()
    total = np.zeros((ends[-1], 2 + dims))
    total.ravel()[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return [(total[lo:hi, 0], total[lo:hi, 2:], float(total[lo:hi, 1].sum())) for lo, hi in zip(ends[:-1], ends[1:])]


def fit_all(
    points: DataFrame,
    names: Sequence[str],
    ks: Sequence[int],
    seed: int = 42,
    starts: int = 10,
    rounds: int = 300,
    tolerance: float = 1e-4,
) -> dict[int, Fit]:
    """The best of ``starts`` fits for every k in ``ks``, over the numeric columns ``names`` without nulls.

    A fit ends when none of its centres moves by more than ``tolerance``, or after ``rounds``; a centre that no row
    is nearest to stays where it is.
    """
    n = points.count()
    rows = spread(points.select(_features(names).alias("x")), n).persist()
    try:
        some = random_rows(rows, n, SEEDS, seed).toArrow().column("x")
        some = matrix(some, len(names))
        if not len(some):
            raise ValueError("k-means needs rows")
        some = some[np.lexsort(some.T)]
        middle = some.mean(axis=0)
        which = [(k, i) for k in ks for i in range(starts)]
        fits = [first_centres(some, k, np.random.default_rng([seed, k, i])) for k, i in which]
        moving = list(range(len(fits)))
        for _ in range(rounds):
            if not moving:
                break
            still = []
            for f, (n, sums, _cost) in zip(moving, _pass(rows, [fits[f] for f in moving], middle)):
                new = np.where(n[:, None] > 0, middle + sums / np.maximum(n, 1)[:, None], fits[f])
                if np.sqrt(((new - fits[f]) ** 2).sum(axis=1)).max() > tolerance:
                    still.append(f)
                fits[f] = new
            moving = still
        best: dict[int, Fit] = {}
        for (k, _), centres, (_n, _s, cost) in zip(which, fits, _pass(rows, fits, middle)):
            if k not in best or cost < best[k].cost:
                best[k] = Fit(centres, cost)
        return best
    finally:
        rows.unpersist()


def nearest(names: Sequence[str], fit: Fit) -> Column:
    """Number of the nearest centre; the first of equally near ones."""
    centres = fit.centres  # k rows

    @F.arrow_udf("int")
    def number(x: pa.Array) -> pa.Array:
        rows = matrix(x, centres.shape[1])
        parts = [apart(rows[s], centres).argmin(axis=1) for s in slices(len(rows), 1024)]
        return pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32))

    return number(_features(names))
