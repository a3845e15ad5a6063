"""Exact k nearest neighbours as a partitioned join.

Points are assigned to the nearest of a set of pivots drawn from the data. A query first
searches cells that surely hold k points; the distance found bounds the second search,
and cells that the triangle inequality or the bisector plane puts farther away are
skipped. Cells are cut into blocks on both sides, so no task holds more than a block
against a block, and every task emits k rows per query, never all pairs.

Points of a block are screened by matrix products; the few that may be among the nearest are then measured by
differences. Copies of a point count k times at most, and queries at one place are searched once. Points of more than
NARROW columns, whose cells overlap, are searched in another order (``wide_neighbours``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions.columns import col, is_numeric, numeric_columns, quoted, require_columns, small_table
from tablekit.functions.order_stats import exact_quantiles
from tablekit.functions.storage import checkpoint
from tablekit.operators.features import prepared
from tablekit.operators.wide_neighbours import knn_wide

POINTS_PER_BLOCK = 20_000
QUERIES_PER_BLOCK = 20_000
MAX_PIVOTS = 20_000
#: columns up to which a partition by pivots rules out cells
NARROW = 16
#: numbers of the arrays that a task works on, or gives out, at once
HELD = 1 << 20


def _distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences (the product form loses the exact zeros)."""
    d = np.zeros((len(q), len(p)))
    for j in range(q.shape[1]):
        d += (q[:, j][:, None] - p[None, :, j]) ** 2
    return np.sqrt(d)


def _matrix(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), dtype=float)


def _rows_per_step(width: int) -> int:
    return max(1, HELD // max(width, 1))


def _assign(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = _rows_per_step(len(pivots))
        for b in batches:
            for i in range(0, len(b), step):
                part = b.iloc[i : i + step]
                d = _distances(_matrix(part["x"]), pivots)
                cell = d.argmin(axis=1)
                yield part.assign(cell=cell.astype("int32"), r=d[np.arange(len(part)), cell])

    return points.select("pkey", "x").mapInPandas(run, "pkey long, x array<double>, cell int, r double")


def _pieces(rows: pd.DataFrame, at: np.ndarray, cell: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows ``at`` with their cells, in pieces of bounded size: a point of many columns may visit every cell."""
    step = _rows_per_step(len(rows["x"].iloc[0])) if len(rows) else 1
    for i in range(0, len(at), step):
        part = rows.iloc[at[i : i + step]]
        yield pd.DataFrame({"qkey": part["qkey"].to_numpy(), "x": part["x"].to_numpy(), "cell": cell[i : i + step].astype("int32")})


def _candidates(
    queries: DataFrame, pivots: np.ndarray, sizes: np.ndarray, radius: np.ndarray, k: int, second: bool
) -> DataFrame:
    """Cells each query has to look into. First round: the nearest cells by upper bound that
    together hold k points. Second round (``bound`` known): every other cell not ruled out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = _rows_per_step(len(pivots))
        for b in batches:
            for i in range(0, len(b), step):
                part = b.iloc[i : i + step]
                d = _distances(_matrix(part["x"]), pivots)
                order = np.argsort(d + radius[None, :], axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                first = np.zeros(d.shape, dtype=bool)
                np.put_along_axis(first, order, before < k, axis=1)
                hit = first
                if second:
                    bound = part["bound"].to_numpy()[:, None] * (1 + 1e-9) + 1e-12
                    near = d.argmin(axis=1)
                    own = d[np.arange(len(part)), near][:, None]
                    # distances between pivots, only from those that are nearest to some query here
                    used, which = np.unique(near, return_inverse=True)
                    between = _distances(pivots[used], pivots)[which]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = (d**2 - own**2) / (2 * between)
                    plane[np.arange(len(part)), near] = 0.0
                    hit = ~first & (d - radius[None, :] <= bound) & ~(plane > bound)
                yield from _pieces(part, *np.nonzero(hit))

    names = ["qkey", "x", "bound"] if second else ["qkey", "x"]
    return queries.select(*names).mapInPandas(run, "qkey long, x array<double>, cell int")


def _screened(qx: np.ndarray, px: np.ndarray, k: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, point, distance) for ``step`` queries at a time: the k nearest points, and maybe some more. Squared
    distances by products in single precision are off by less than ``slack``, so no nearest point is missed."""
    middle = px.mean(axis=0)
    p, q = px - middle, qx - middle
    p_size, q_size = (p * p).sum(axis=1), (q * q).sum(axis=1)
    slack = (px.shape[1] + 8) * float(np.finfo(np.float32).eps) * (np.sqrt(q_size) + np.sqrt(p_size.max())) ** 2 + 1e-33
    p_half, p32, q32 = (p_size / 2).astype(np.float32), p.T.astype(np.float32), q.astype(np.float32)
    for i in range(0, len(q), step):
        half = p_half - q32[i : i + step] @ p32  # half of the squared distance, without the query's own size
        cut = np.partition(half, k - 1, axis=1)[:, k - 1] + slack[i : i + step]
        at, pick = np.nonzero(half <= cut[:, None])
        d = np.zeros(len(at))
        for j in range(px.shape[1]):
            d += (qx[i + at, j] - px[pick, j]) ** 2
        yield at, pick, np.sqrt(d)


def _compared(qx: np.ndarray, px: np.ndarray, k: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same by differences to all points."""
    for i in range(0, len(qx), step):
        d = _distances(qx[i : i + step], px)
        if len(px) > k:
            cut = np.partition(d, k - 1, axis=1)[:, k - 1][:, None]
            at, pick = np.nonzero(d <= cut)
        else:
            at, pick = np.nonzero(np.ones(d.shape, dtype=bool))
        yield at, pick, d[at, pick]


def _nearest_in_block(q: pd.DataFrame, p: pd.DataFrame, k: int) -> pd.DataFrame:
    p = p.sort_values("pkey")
    keys, px, qx = p["pkey"].to_numpy(), _matrix(p["x"]), _matrix(q["x"])
    out = []
    step = _rows_per_step(len(p))
    # products need finite numbers that single precision can square
    plain = len(p) <= k or not all(np.abs(x).max(initial=0.0) < 1e15 for x in (px, qx))
    for i, (at, pick, dist) in enumerate((_compared if plain else _screened)(qx, px, k, step)):
        i *= step
        order = np.lexsort((pick, dist, at))
        at, pick, dist = at[order], pick[order], dist[order]
        start = np.searchsorted(at, np.arange(len(qx[i : i + step])))
        keep = np.arange(len(at)) - start[at] < k
        out.append(
            pd.DataFrame(
                {
                    "qkey": q["qkey"].to_numpy()[i : i + step][at[keep]],
                    "pkey": keys[pick[keep]],
                    "dist": dist[keep],
                }
            )
        )
    return pd.concat(out)


def _search(
    wanted: DataFrame, cells: DataFrame, sizes: np.ndarray, k: int, points_block: int, queries_block: int
) -> DataFrame:
    spark = wanted.sparkSession
    asked = {r["cell"]: r["count"] for r in wanted.groupBy("cell").count().collect()}  # a row per pivot
    plan = small_table(
        spark,
        [
            (c, max(1, math.ceil(int(sizes[c]) / points_block)), max(1, math.ceil(n / queries_block)))
            for c, n in asked.items()
        ],
        "cell long, pb long, qb long",
    ).withColumn("cell", F.col("cell").cast("int"))
    plan = F.broadcast(plan)  # at most MAX_PIVOTS rows
    q = (
        wanted.join(plan, "cell")
        .withColumn("qi", F.pmod(F.xxhash64("qkey"), F.col("qb")))
        .withColumn("pi", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pb") - 1)))
        .select("cell", "pi", "qi", "qkey", "x")
    )
    p = (
        cells.join(plan, "cell")
        .withColumn("pi", F.pmod(F.xxhash64("pkey"), F.col("pb")))
        .withColumn("qi", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb") - 1)))
        .select("cell", "pi", "qi", "pkey", "x")
    )

    def block(qpdf: pd.DataFrame, ppdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or ppdf.empty:
            return pd.DataFrame({"qkey": [], "pkey": [], "dist": []})
        return _nearest_in_block(qpdf, ppdf, k)

    on = ["cell", "pi", "qi"]
    return q.groupBy(*on).cogroup(p.groupBy(*on)).applyInPandas(block, "qkey long, pkey long, dist double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qkey").orderBy("dist", "pkey")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn_join(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    pivots: int | None = None,
    points_block: int | None = None,
    queries_block: int | None = None,
) -> DataFrame:
    """The k nearest points of every query, ties by smaller key: ``qkey, pkey, dist, rank``.

    ``queries`` has ``qkey, x``, ``points`` has ``pkey, x`` (array<double>, whole-number keys). Queries at one place
    have the same neighbours, and of points at one place only the k of smallest keys can be among them: the work
    grows with the number of places.
    """
    # a sort and a join by the hash first compare two long arrays only where it is the same
    copies = Window.partitionBy(F.xxhash64("x"), "x").orderBy("pkey")
    # row_number <= k is cut inside the map tasks, before the shuffle
    kept = points.select("pkey", "x").withColumn("nth", F.row_number().over(copies)).filter(F.col("nth") <= k).drop("nth")
    places = checkpoint(queries.select("x").distinct().withColumn("place", F.monotonically_increasing_id()))
    near = _knn_places(places.withColumnRenamed("place", "qkey"), checkpoint(kept), k, pivots, points_block, queries_block)
    near = near.select(F.col("qkey").alias("place"), "pkey", "dist")
    if places.count() <= MAX_PIVOTS:  # many queries may share few places: then those go to the queries
        places, near = F.broadcast(places), F.broadcast(near)
    asked, places = (df.withColumn("hash", F.xxhash64("x")) for df in (queries.select("qkey", "x"), places))
    # a key may stand for several queries
    return _best(asked.join(places, ["hash", "x"]).join(near, "place").select("qkey", "pkey", "dist"), k)


def _knn_places(
    queries: DataFrame, points: DataFrame, k: int, pivots: int | None = None, points_block: int | None = None, queries_block: int | None = None
) -> DataFrame:
    """The same for every query by itself; meant for few copies."""
    n = points.count()
    if n == 0:
        raise ValueError("there are no points to search")
    width = points.select(F.size("x")).first()[0]
    if width > NARROW and pivots is None:
        return _best(knn_wide(queries, points, n, width, k, points_block, queries_block), k)
    points_block, queries_block = points_block or POINTS_PER_BLOCK, queries_block or QUERIES_PER_BLOCK
    m = pivots or max(1, min(MAX_PIVOTS, int(math.sqrt(n) / 4)))
    drawn = points.orderBy(F.xxhash64("x"), "pkey").select("x").limit(m).collect()
    centres = np.unique(np.array([r["x"] for r in drawn], dtype=float), axis=0)
    cells = checkpoint(_assign(points, centres))
    sizes, radius = np.zeros(len(centres)), np.zeros(len(centres))
    for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r")).collect():
        sizes[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    radius[sizes == 0] = np.inf  # an empty cell is never searched
    live = sizes > 0
    centres, radius = centres[live], radius[live]
    renumber = np.cumsum(live) - 1
    sizes = sizes[live]
    if not live.all():
        lookup = F.array(*[F.lit(int(v)) for v in renumber])
        cells = cells.withColumn("cell", F.get(lookup, F.col("cell")))
    wanted = _candidates(queries, centres, sizes, radius, k, second=False)
    near = checkpoint(_best(_search(wanted, cells, sizes, k, points_block, queries_block), k))
    if len(centres) == 1:
        return near
    bounds = near.groupBy("qkey").agg(
        F.when(F.count(F.lit(1)) >= k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("bound")
    )
    again = _candidates(queries.join(bounds, "qkey"), centres, sizes, radius, k, second=True)
    far = _search(again, cells, sizes, k, points_block, queries_block)
    return _best(near.select("qkey", "pkey", "dist").unionByName(far), k)


def _points(df: DataFrame, cols: Sequence[str], key: str, name: str) -> DataFrame:
    x = ", ".join(f"double({quoted(c)}) + 0D" for c in cols)  # + 0: no negative zero
    return df.selectExpr(f"bigint({quoted(key)}) AS {name}", f"array({x}) AS x")


def numbered(df: DataFrame, key: str, name: str = "_tk_key") -> DataFrame:
    """``df`` with a whole-number key ``name`` in the order of ``key``, whose type may be any."""
    if isinstance(df.schema[key].dataType, T.IntegralType):
        return df.withColumn(name, col(key).cast("long"))
    # ranges of a sort are numbered upwards, so order is kept; written, so the numbers stay
    ids = df.select(col(key).alias("_tk_own")).distinct().orderBy("_tk_own")
    ids = checkpoint(ids.withColumn(name, F.monotonically_increasing_id()))
    return df.join(ids, col(key).eqNullSafe(F.col("_tk_own"))).drop("_tk_own")


def own_key(result: DataFrame, source: DataFrame, key: str, name: str) -> DataFrame:
    """``result`` with the table's own key in place of the number ``name``."""
    if isinstance(source.schema[key].dataType, T.IntegralType):
        return result.withColumnRenamed(name, key)
    names = source.select(col(key).alias("_tk_back"), F.col("_tk_key").alias("_tk_of")).distinct()
    back = result.join(names, F.col(name) == F.col("_tk_of"))
    return back.select(F.col("_tk_back").alias(key), *[col(c) for c in result.columns if c != name])


def knn_vote(near: DataFrame, targets: DataFrame, classify: bool) -> DataFrame:
    """Majority (the smallest class on a tie) or mean of the neighbours' targets.

    ``near`` from knn_join, ``targets`` with ``pkey, y``; gives ``qkey, prediction``.
    """
    votes = near.join(targets, "pkey")
    if not classify:
        return votes.groupBy("qkey").agg(F.avg("y").alias("prediction"))
    tally = votes.groupBy("qkey", "y").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("qkey").orderBy(F.col("n").desc(), "y")  # at most k rows per query
    return (
        tally.withColumn("_rn", F.row_number().over(best))
        .filter("_rn = 1")
        .select("qkey", F.col("y").alias("prediction"))
    )


def knn_predict(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    target: str,
    key: str,
    k: int = 5,
    classify: bool | None = None,
) -> DataFrame:
    """Prediction per test row from its k nearest training rows in the prepared (imputed,
    standardised) space: ``key, prediction``."""
    require_columns(train, *features, target, key)
    if classify is None:
        classify = not is_numeric(train, target)
    base = numbered(train.filter(col(target).isNotNull()), key)
    asked = numbered(test, key)
    fit, _ = prepared(base, features, fitted_on=base)
    ask, _ = prepared(asked, features, fitted_on=base)
    near = knn_join(_points(ask, features, "_tk_key", "qkey"), _points(fit, features, "_tk_key", "pkey"), k)
    y = col(target) if classify else col(target).cast("double")
    out = knn_vote(near, base.select(col("_tk_key").alias("pkey"), y.alias("y")), classify)
    return own_key(out, asked, key, "qkey").select(col(key), "prediction")


def local_outlier_factor(
    df: DataFrame, key: str, cols: Sequence[str] | None = None, k: int = 20, standardise: bool = True
) -> DataFrame:
    """``key, lof`` for every row: how much sparser a row lies than its k neighbours.

    Rows at the same place have the same neighbours, so at most k + 2 rows per place are
    searched and scored; the others take the score of the last of these. Exact, and a
    place that holds a third of the table costs no more than any other.
    """
    require_columns(df, key)
    df = numbered(df, key)
    names = list(cols or numeric_columns(df, exclude=(key, "_tk_key")))
    work = df
    if standardise:
        work, names = prepared(df, cols, skip=(key, "_tk_key"))
    rows = checkpoint(_points(work, names, "_tk_key", "pkey"))
    n = rows.count()
    k = min(k, n - 1)
    place = Window.partitionBy("x").orderBy("pkey")
    # row_number <= k + 2 is cut inside the map tasks, before the shuffle
    kept = rows.withColumn("nth", F.row_number().over(place)).filter(F.col("nth") <= k + 2)
    kept = checkpoint(kept)
    queries = kept.filter("nth = 1").select(F.col("pkey").alias("qkey"), "x")
    near = _knn_places(queries, kept.filter(F.col("nth") <= k + 1).select("pkey", "x"), k + 1)
    # neighbours of each kept row: those of its place without itself
    home = kept.join(queries.select(F.col("qkey").alias("place"), "x"), "x").select("pkey", "place")
    edges = (
        home.withColumnRenamed("pkey", "row")
        .join(near.withColumnRenamed("qkey", "place"), "place")
        .filter(F.col("pkey") != F.col("row"))
        .select("row", F.col("pkey").alias("nb"), "dist")
    )
    order = Window.partitionBy("row").orderBy("dist", "nb")
    edges = edges.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    edges = checkpoint(edges.select("row", "nb", "dist"))
    kdist = edges.groupBy(F.col("row").alias("nb")).agg(F.max("dist").alias("kdist"))
    reach = edges.join(kdist, "nb").groupBy("row").agg(
        F.avg(F.greatest("dist", "kdist")).alias("reach")
    )
    density = checkpoint(reach.select("row", (F.lit(1.0) / (F.col("reach") + 1e-10)).alias("lrd")))
    factor = (
        edges.join(density.select(F.col("row").alias("nb"), F.col("lrd").alias("nb_lrd")), "nb")
        .groupBy("row")
        .agg(F.avg("nb_lrd").alias("m"))
        .join(density, "row")
        .select(F.col("row").alias("pkey"), (F.col("m") / F.col("lrd")).alias("lof"))
    )
    scored = kept.join(factor, "pkey").select("pkey", "x", "nth", "lof")
    rest = scored.filter(F.col("nth") == k + 2).select("x", F.col("lof").alias("rest"))
    # rows past the kept ones: only places that have any are joined
    others = rows.join(kept.select("pkey"), "pkey", "left_anti").join(rest, "x")
    every = scored.select("pkey", "lof").unionByName(others.select("pkey", F.col("rest").alias("lof")))
    return own_key(every, df, key, "pkey")


def lof_anomalies(
    df: DataFrame,
    key: str,
    cols: Sequence[str] | None = None,
    k: int = 20,
    contamination: float = 0.1,
) -> DataFrame:
    """LOF with the share ``contamination`` of highest factors marked as anomalies."""
    scored = checkpoint(local_outlier_factor(df, key, cols, k))
    cut = exact_quantiles(scored, {"lof": [1 - contamination]})["lof"][1 - contamination]
    return scored.withColumn("is_anomaly", F.col("lof") > F.lit(cut))
