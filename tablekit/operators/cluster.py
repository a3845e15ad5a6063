"""k-means, hierarchical (bisecting) and density clustering."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.functions.columns import col, numeric_columns, require_columns, small_table
from tablekit.functions.numbering import in_order
from tablekit.functions.storage import checkpoint
from tablekit.operators.boxes import Cells, apart, components, gap_and_span, meet, placed_in_regions, slices, tree_for
from tablekit.operators.features import prepared
from tablekit.operators.lloyd import Fit, fit_all, nearest
from tablekit.operators.neighbours import numbered, own_key

LABEL = "cluster_label"
ROWS_PER_SALT = 50_000
#: places of a cell that are carried with it
CARRIED = 32


def _vectors(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol="_features").transform(df)


def _with_label(df: DataFrame, labelled: DataFrame, key: str) -> DataFrame:
    base = df.select(*[col(c) for c in df.columns if c != LABEL])
    return base.join(labelled.select(key, LABEL), key)


def label_nearest(points: DataFrame, names: Sequence[str], fit: Fit) -> DataFrame:
    """``points`` with the number of the nearest centre."""
    return points.withColumn(LABEL, nearest(names, fit))


def clamp_k(k: int, rows: int) -> int:
    return max(2, min(int(k), rows - 1))


def kmeans(
    df: DataFrame, k: int, cols: Sequence[str] | None = None, key: str | None = None, seed: int = 42, starts: int = 10
) -> tuple[DataFrame, DataFrame, float]:
    """(table with ``cluster_label``, centres in prepared space, inertia)."""
    points, names = prepared(df.drop(LABEL), cols, skip=(key,) if key else ())
    k = clamp_k(k, df.count())
    fit = fit_all(points, names, [k], seed, starts)[k]
    labelled = label_nearest(points, names, fit)
    centres = small_table(
        df.sparkSession,
        [(i, c, float(v)) for i, m in enumerate(fit.centres) for c, v in zip(names, m)],
        "cluster long, column_name string, value double",
    )
    out = labelled if key is None else _with_label(df, labelled, key)
    return out, centres, fit.cost


def fit_bisecting(points: DataFrame, names: Sequence[str], k: int, seed: int = 42):
    """(labelled table, model) of bisecting k-means on prepared columns.

    Halves are started by moving the centre by a share of its length, which fails at the
    origin, where standardised data lie. A shift leaves all distances as they are.
    """
    moved = points.select(*[col(c) for c in points.columns], *[(col(c) + 10.0).alias(f"_s{i}") for i, c in enumerate(names)])
    vectors = _vectors(moved, [f"_s{i}" for i in range(len(names))]).persist()
    try:
        model = BisectingKMeans(k=k, seed=seed, featuresCol="_features", predictionCol=LABEL).fit(vectors)
    finally:
        vectors.unpersist()
    return model.transform(vectors).select(*[col(c) for c in points.columns], LABEL), model


def hierarchical(
    df: DataFrame, k: int, cols: Sequence[str] | None = None, key: str | None = None, seed: int = 42
) -> tuple[DataFrame, float]:
    """Top-down hierarchy by bisecting k-means: (table with ``cluster_label``, cost)."""
    points, names = prepared(df.drop(LABEL), cols, skip=(key,) if key else ())
    labelled, model = fit_bisecting(points, names, clamp_k(k, df.count()), seed)
    return (labelled if key is None else _with_label(df, labelled, key)), float(model.summary.trainingCost)


def cluster_sizes(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.groupBy(col(label).cast("long").alias("cluster")).agg(F.count(F.lit(1)).alias("rows"))


# ---- density clustering ------------------------------------------------------------------


def _gap2(alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    """Squared smallest distance between two boxes given by corner arrays."""
    side = F.zip_with(
        F.zip_with(blo, ahi, lambda b, a: b - a),
        F.zip_with(alo, bhi, lambda a, b: a - b),
        lambda u, v: F.greatest(u, v, F.lit(0.0)),
    )
    return F.aggregate(side, F.lit(0.0), lambda acc, s: acc + s * s)


def _span2(alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    """Squared largest distance between two boxes."""
    side = F.zip_with(
        F.zip_with(bhi, alo, lambda b, a: b - a),
        F.zip_with(ahi, blo, lambda a, b: a - b),
        lambda u, v: F.greatest(u, v),
    )
    return F.aggregate(side, F.lit(0.0), lambda acc, s: acc + s * s)


def _dist2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda acc, s: acc + s)


def _corners(dims: int) -> list[Column]:
    lo = F.array(*[F.min(F.get("x", F.lit(j))) for j in range(dims)])
    hi = F.array(*[F.max(F.get("x", F.lit(j))) for j in range(dims)])
    return [lo.alias("lo"), hi.alias("hi")]


def _grid(width: float) -> Column:
    return F.transform("x", lambda v: F.floor(v / F.lit(width)))


def _summaries(placed: DataFrame, most: int, dims: int) -> DataFrame:
    """Cells of places (cid, id, x, w, locs): corners, rows ``cw``, places ``locs``, and the places themselves
    (``ids, ws, xs``) of cells with at most ``most``; of crowded cells these are empty."""
    cells = placed.groupBy("cid").agg(F.sum("w").alias("cw"), F.count(F.lit(1)).alias("locs"), *_corners(dims))
    # at most ``most`` places each
    few = placed.filter(F.col("locs") <= most).groupBy("cid").agg(F.collect_list(F.struct("id", "w", "x")).alias("p"))
    none = F.array()
    return cells.join(few, "cid", "left").select(
        "cid",
        "cw",
        "locs",
        "lo",
        "hi",
        F.coalesce(F.col("p")["id"], none.cast("array<bigint>")).alias("ids"),
        F.coalesce(F.col("p")["w"], none.cast("array<bigint>")).alias("ws"),
        F.coalesce(F.flatten(F.col("p")["x"]), none.cast("array<double>")).alias("xs"),
    )


def _count_near(eps: float, dims: int):
    """Rows within eps of every carried point of the homes (``id, n``), without crowded cells that the ball
    cuts (``id, cid``)."""
    e2 = eps * eps

    def run(homes: pa.Table, visitors: pa.Table) -> pa.Table:
        q, v = Cells(homes, dims), Cells(visitors, dims)
        crowd = np.nonzero(~v.carried)[0]
        cw = v.column("cw")
        n, cut_id, cut_cid = np.zeros(len(q.ids), np.int64), [], []
        for s in slices(len(q.ids)):
            x = q.xs[s]
            n[s] = (apart(x, v.xs) <= e2) @ v.ws
            gap, span = gap_and_span(x, x, v.lo[crowd], v.hi[crowd])
            n[s] += (span <= e2) @ cw[crowd]
            i, j = np.nonzero((gap <= e2) & (span > e2))
            cut_id.append(q.ids[s][i])
            cut_cid.append(v.cid[crowd[j]])
        cid = np.concatenate([np.full(len(n), -1), *cut_cid])
        ids = np.concatenate([q.ids, *cut_id])
        n = np.concatenate([n, np.zeros(len(ids) - len(n), np.int64)])
        return pa.table({"id": ids.astype(np.int64), "cid": pa.array(cid.astype(np.int64), mask=np.arange(len(cid)) < len(q.ids)), "n": n})

    return run


def _link_cells(eps: float, dims: int):
    """Links (``a, b, sure``) of a block: stars over the components that points or corners prove, and the open
    ones between its components, where a cell is crowded."""
    e2 = eps * eps

    def run(homes: pa.Table, visitors: pa.Table) -> pa.Table:
        q, v = Cells(homes, dims), Cells(visitors, dims)
        sure = np.zeros((len(q.cid), len(v.cid)), bool)
        open_ = np.zeros_like(sure)
        cols = np.nonzero(v.carried)[0]
        first = np.searchsorted(v.of, cols)
        for s in slices(len(q.ids)):
            if len(cols):
                near = np.logical_or.reduceat(apart(q.xs[s], v.xs) <= e2, first, axis=1)
                of = q.of[s]
                rows, at = np.unique(of, return_index=True)
                sure[np.ix_(rows, cols)] |= np.logical_or.reduceat(near, at, axis=0)
        for s in slices(len(q.cid)):
            gap, span = gap_and_span(q.lo[s], q.hi[s], v.lo, v.hi)
            crowded = ~(q.carried[s, None] & v.carried[None])
            sure[s] |= crowded & (span <= e2)
            open_[s] = crowded & (gap <= e2) & ~sure[s]
        # a link is seen from both ends; a cell is one node on both sides
        once, same = q.cid[:, None] < v.cid[None], q.cid[:, None] == v.cid[None]
        row_in, col_in = components(sure & once | same)
        number, cid = np.concatenate([row_in, col_in]), np.concatenate([q.cid, v.cid])
        # every component as a star around its first cell
        first = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(first, number, cid)
        star = np.unique(np.stack([cid, first[number]], axis=1), axis=0)
        star = star[star[:, 0] != star[:, 1]]
        u, w = np.nonzero(open_ & once & (row_in[:, None] != col_in[None]))
        a, b = np.concatenate([star[:, 0], q.cid[u]]), np.concatenate([star[:, 1], v.cid[w]])
        return pa.table({"a": a, "b": b, "sure": np.arange(len(a)) < len(star)})

    return run


def _first_label(eps: float, dims: int):
    """The smallest label of the cells within eps of every carried point of the homes (``id, label``), and
    crowded cells of smaller labels that the ball cuts (``id, label, cid``)."""
    e2, far = eps * eps, np.iinfo(np.int64).max

    def run(homes: pa.Table, visitors: pa.Table) -> pa.Table:
        label = visitors.column("label")
        q, v = Cells(homes, dims), Cells(visitors.filter(label.is_valid()), dims)
        label = v.column("label").astype(np.int64)
        crowd = np.nonzero(~v.carried)[0]
        best, cut = np.full(len(q.ids), far), []
        for s in slices(len(q.ids)):
            x = q.xs[s]
            near = np.where(apart(x, v.xs) <= e2, label[v.of][None], far).min(axis=1, initial=far)
            gap, span = gap_and_span(x, x, v.lo[crowd], v.hi[crowd])
            whole = np.where(span <= e2, label[crowd][None], far).min(axis=1, initial=far)
            best[s] = np.minimum(near, whole)
            i, j = np.nonzero((gap <= e2) & (span > e2) & (label[crowd][None] < best[s][:, None]))
            cut.append((q.ids[s][i], label[crowd[j]], v.cid[crowd[j]]))
        has = best < far
        parts = [(q.ids[has], best[has], np.full(int(has.sum()), -1)), *cut]
        ids, labels, cids = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(3))
        return pa.table({"id": ids, "label": labels, "cid": pa.array(cids, mask=np.arange(len(cids)) < has.sum())})

    return run


def _members_near(cut: DataFrame, placed: DataFrame, eps: float) -> DataFrame:
    """``cut`` (id, cid, x) with the weight ``w`` of every place of the crowded cell within eps. Big cells are
    spread over salts."""
    cells = cut.select("cid").distinct().join(placed.select("cid", "locs").distinct(), "cid")
    salts = F.ceil(F.col("locs") / F.lit(ROWS_PER_SALT)).cast("long")
    every = F.explode(F.sequence(F.lit(1).cast("long"), salts))
    asked = cut.join(cells, "cid").withColumn("salt", every).drop("locs")
    members = placed.select("cid", F.col("x").alias("y"), "w", (F.pmod(F.xxhash64("id"), salts) + 1).alias("salt"))
    return asked.join(members, ["cid", "salt"]).filter(_dist2(F.col("x"), F.col("y")) <= F.lit(eps * eps))


def _core_links(core: DataFrame, pairs: DataFrame, eps: float, dims: int, width: float) -> DataFrame:
    """Pairs of cells (a < b) with two core points within eps of each other.

    Boxes around the core points decide most pairs. Undecided pairs are split into boxes of
    a quarter of the side again and again, down to single points if need be, so two crowded
    cells are never compared point by point.
    """
    e2 = F.lit(eps * eps)
    # any real point of a box shows a link early
    rep = F.min(F.struct(F.col("x").alias("x")))["x"].alias("rep")
    links = None
    side, level = width, 0
    boxes = core.groupBy("cell").agg(*_corners(dims), rep).withColumn("sub", F.array().cast("array<bigint>"))
    todo = pairs.filter(F.col("a") < F.col("b")).select("a", "b")
    none = F.array().cast("array<bigint>")
    todo = todo.withColumn("asub", none).withColumn("bsub", none)

    def sided(frame: DataFrame, s: str) -> DataFrame:
        return frame.select(
            F.col("cell").alias(s),
            F.col("sub").alias(f"{s}sub"),
            F.col("lo").alias(f"{s}lo"),
            F.col("hi").alias(f"{s}hi"),
            F.col("rep").alias(f"{s}rep"),
        )

    while True:
        both = todo.join(sided(boxes, "a"), ["a", "asub"]).join(sided(boxes, "b"), ["b", "bsub"])
        corners = [F.col("alo"), F.col("ahi"), F.col("blo"), F.col("bhi")]
        both = both.filter(_gap2(*corners) <= e2).withColumn(
            "yes", (_span2(*corners) <= e2) | (_dist2(F.col("arep"), F.col("brep")) <= e2)
        )
        # two single points are settled either way
        point = (F.col("alo") == F.col("ahi")) & (F.col("blo") == F.col("bhi"))
        both = checkpoint(
            both.filter(F.col("yes") | ~point).select("a", "asub", "b", "bsub", "yes")
        )
        found = both.filter("yes").select("a", "b").distinct()
        links = found if links is None else links.unionByName(found)
        open_ = both.filter("not yes").join(found, ["a", "b"], "left_anti").select("a", "asub", "b", "bsub")
        if open_.isEmpty():
            return links.distinct()
        level += 1
        parent, side = side, side / 4
        sub, up = _grid(side), (none if level == 1 else _grid(parent))
        boxes = (
            core.withColumn("sub", sub)
            .withColumn("up", up)
            .groupBy("cell", "up", "sub")
            .agg(*_corners(dims), rep)
        )
        kids = boxes.select("cell", "up", "sub")
        ka = kids.select(F.col("cell").alias("a"), F.col("up").alias("asub"), F.col("sub").alias("na"))
        kb = kids.select(F.col("cell").alias("b"), F.col("up").alias("bsub"), F.col("sub").alias("nb"))
        todo = (
            open_.join(ka, ["a", "asub"])
            .join(kb, ["b", "bsub"])
            .select("a", "b", F.col("na").alias("asub"), F.col("nb").alias("bsub"))
        )


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id, root`` with the smallest id of each component (large-star / small-star rounds).

    ``nodes`` has ``id``, ``links`` has ``u, v``. Neighbour sets are only ever reduced to
    their minimum, never collected.
    """

    def both_ways(e: DataFrame) -> DataFrame:
        return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def mark(e: DataFrame) -> tuple:
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    edges = checkpoint(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter("u != v")
        .distinct()
    )
    seen = mark(edges)
    while seen[0]:
        two = both_ways(edges)
        low = two.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            two.join(low, "u")
            .filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpoint(
            pairs.unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        )
        now = mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return nodes.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def dbscan(
    df: DataFrame,
    key: str,
    cols: Sequence[str] | None = None,
    eps: float = 0.5,
    min_samples: int = 5,
    standardise: bool = True,
) -> DataFrame:
    """``key, cluster_label``: density clusters 0, 1, ... in order of their first core row, -1
    for outliers. A border row joins the first cluster that reaches it.

    Identical rows are one weighted place. Places lie in grid cells so small that all
    members of a cell are neighbours: a cell with ``min_samples`` rows is dense without
    comparing anything, which is where crowded regions end. Cells that come within eps meet in
    regions of a tree (``boxes``), in any number of columns; a cell brings its places along unless
    it is crowded, and crowded ones are compared place by place only where their corners leave
    the answer open. A place with a missing number is an outlier unless its own copies are dense.
    """
    require_columns(df, key)
    df = numbered(df, key)
    work, names = df, list(cols or numeric_columns(df, exclude=(LABEL, key, "_tk_key")))
    if standardise:
        work, names = prepared(df, cols, skip=(key, "_tk_key"))
    dims = len(names)
    width = eps / math.sqrt(dims) * (1 - 1e-9)
    most = max(min_samples - 1, CARRIED)
    rows = work.select(
        col("_tk_key").alias("key"), F.array(*[col(c).cast("double") + F.lit(0.0) for c in names]).alias("x")
    )
    places = checkpoint(
        rows.groupBy("x")
        .agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("w"))
        .withColumn("cell", _grid(width))
    )
    cells = places.groupBy("cell").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("locs"), F.sum("w").alias("cw"))
    placed = checkpoint(places.join(cells, "cell").select("cid", "id", "x", "w", "locs", "cw"))
    cells = checkpoint(_summaries(placed, most, dims))
    thin = placed.filter(F.col("cw") < min_samples)
    tree = tree_for(cells, dims)

    # how many rows are near a place of a thin cell
    near = meet(
        placed_in_regions(cells, tree, eps, width, dims),
        F.col("cw") < min_samples,
        _count_near(eps, dims),
        "id long, cid long, n long",
    )
    near = checkpoint(near)
    sure = near.filter(F.col("cid").isNull()).groupBy("id").agg(F.sum("n").alias("n"))
    short = sure.filter(F.col("n") < min_samples)
    cut = near.filter(F.col("cid").isNotNull()).select("id", "cid").join(short.select("id"), "id", "left_semi")
    more = _members_near(cut.join(thin.select("id", "x"), "id"), placed, eps).select("id", F.col("w").alias("n"))
    counts = sure.unionByName(more).groupBy("id").agg(F.sum("n").alias("n"))
    thin_core = thin.join(counts.filter(F.col("n") >= min_samples).select("id"), "id", "left_semi")
    # core places, in cells named by the first of them
    thin_core = thin_core.join(thin_core.groupBy("cid").agg(F.min("id").alias("first")), "cid")
    thin_core = thin_core.select(F.col("first").alias("cid"), "id", "x", "w", "locs")
    dense = placed.filter(F.col("cw") >= min_samples).select("cid", "id", "x", "w", "locs")
    core = checkpoint(dense.unionByName(thin_core))
    core_cells = checkpoint(_summaries(core, most, dims))
    if core_cells.isEmpty():
        none = rows.select(F.col("key").alias("_tk_n"), F.lit(-1).cast("long").alias(LABEL))
        return own_key(none, df, key, "_tk_n")

    links = meet(
        placed_in_regions(core_cells, tree, eps, width, dims), F.lit(True), _link_cells(eps, dims), "a long, b long, sure boolean"
    )
    links = checkpoint(links)
    edges = links.filter("sure").select("a", "b")
    undecided = links.filter("not sure").select("a", "b").distinct()
    if not undecided.isEmpty():
        some = undecided.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        crowds = core.join(some, "cid", "left_semi").select(F.col("cid").alias("cell"), "x")
        edges = edges.unionByName(_core_links(checkpoint(crowds), undecided, eps, dims, width))
    roots = connected_components(
        core_cells.select(F.col("cid").alias("id")), edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    )
    number = in_order(roots.select("root").distinct(), [F.col("root")], "label")
    cell_label = checkpoint(roots.withColumnRenamed("id", "cid").join(number, "root").select("cid", "label"))
    core_label = core.join(cell_label, "cid").select("id", "label")

    # other places beside the core
    loose = thin.join(core.select("id"), "id", "left_anti")
    askers = _summaries(loose, most, dims).withColumn("label", F.lit(None).cast("long"))
    beside = askers.unionByName(core_cells.join(cell_label, "cid"))
    found = meet(
        placed_in_regions(beside, tree, eps, width, dims),
        F.col("label").isNull(),
        _first_label(eps, dims),
        "id long, label long, cid long",
    )
    found = checkpoint(found)
    sure = found.filter(F.col("cid").isNull()).groupBy("id").agg(F.min("label").alias("label"))
    cut = found.filter(F.col("cid").isNotNull()).join(sure.withColumnRenamed("label", "known"), "id", "left")
    cut = cut.filter(F.col("known").isNull() | (F.col("label") < F.col("known"))).select("id", "label", "cid").distinct()
    more = _members_near(cut.join(loose.select("id", "x"), "id"), core, eps).select("id", "label")
    border = sure.unionByName(more).groupBy("id").agg(F.min("label").alias("label"))
    labels = places.select("id", "x").join(core_label.unionByName(border), "id", "left")
    found = rows.join(labels.select("x", "label"), "x").select(
        F.col("key").alias("_tk_n"), F.coalesce("label", F.lit(-1)).cast("long").alias(LABEL)
    )
    return own_key(found, df, key, "_tk_n")
