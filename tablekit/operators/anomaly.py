"""Isolation forest: small subsamples build trees in parallel, all rows are scored by them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablekit.functions.columns import col, require_columns, row_hash
from tablekit.functions.order_stats import exact_quantiles
from tablekit.functions.storage import checkpoint
from tablekit.operators.features import prepared
from tablekit.operators.sample import sample_n

TREES = 100
TREE_ROWS = 256

_NODES = "tree int, node int, feature int, cut double, left int, right int, depth double"


def mean_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    deep = 2.0 * (np.log(np.maximum(safe - 1, 1)) + np.euler_gamma) - 2.0 * (safe - 1) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, deep))


def _grow(tree: int, x: np.ndarray, seed: int) -> list[tuple]:
    """Nodes of one random tree; a leaf has feature -1 and the path length of its rows."""
    rng = np.random.default_rng([seed, tree])
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[list] = []

    def add(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([tree, me, -1, 0.0, -1, -1, depth + float(mean_path(len(rows)))])
        if depth >= limit or len(rows) <= 1:
            return me
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        open_ = np.nonzero(hi > lo)[0]
        if not len(open_):
            return me
        f = int(rng.choice(open_))
        cut = float(rng.uniform(lo[f], hi[f]))
        side = x[rows, f] <= cut
        nodes[me][2:4] = [f, cut]
        nodes[me][4] = add(rows[side], depth + 1)
        nodes[me][5] = add(rows[~side], depth + 1)
        return me

    add(np.arange(len(x)), 0)
    return [tuple(n) for n in nodes]


def grow_forest(
    df: DataFrame, cols: Sequence[str], key: Sequence[str], trees: int = TREES, rows: int = TREE_ROWS, seed: int = 42
) -> pd.DataFrame:
    """Trees from per-tree hash subsamples of a bounded pool, one tree per group. Which trees a row may be
    in is decided by its hash for each tree before anything is moved."""
    pool = checkpoint(sample_n(df, 2 * trees * rows, key, seed).select(*[col(k) for k in dict.fromkeys([*key, *cols])]))
    held = max(1, pool.count())
    # twice the rows a tree needs and more: fewer than it needs have odds below 1e-9
    share = 1.0 if held <= 4 * rows else min(1.0, (2 * rows + 200) / held)
    bound = 2**63 - 1 if share == 1.0 else int((share - 0.5) * 2**63 * 2)
    trees_of = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64("h", t).alias("h"))),
        lambda s: s["h"] <= F.lit(bound),
    )
    each = (
        pool.select(F.array(*[col(c) for c in cols]).alias("x"), row_hash(key, seed).alias("h"))
        .select("x", F.explode(trees_of).alias("t"))
        .select("x", "t.tree", "t.h")
    )
    order = Window.partitionBy("tree").orderBy("h")
    drawn = each.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= rows)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        found = _grow(int(pdf["tree"].iloc[0]), np.array(pdf["x"].tolist(), dtype=float), seed)
        return pd.DataFrame(found, columns=["tree", "node", "feature", "cut", "left", "right", "depth"])

    # at most trees * 2 * rows nodes
    return drawn.groupBy("tree").applyInPandas(build, _NODES).toPandas().sort_values(["tree", "node"])


def isolation_forest(
    df: DataFrame,
    key: str,
    cols: Sequence[str] | None = None,
    contamination: float = 0.1,
    trees: int = TREES,
    rows: int = TREE_ROWS,
    seed: int = 42,
) -> DataFrame:
    """``key, score, is_anomaly``: score in (0, 1], higher is more isolated; the share
    ``contamination`` with the highest scores is marked."""
    require_columns(df, key)
    points, names = prepared(df, cols, skip=(key,))
    forest = grow_forest(points, names, [key], trees, rows, seed)
    per_tree = [t.reset_index(drop=True) for _, t in forest.groupby("tree")]
    width = max(len(t) for t in per_tree)

    def table(name: str, fill, kind) -> np.ndarray:
        out = np.full((len(per_tree), width), fill, dtype=kind)
        for i, t in enumerate(per_tree):
            out[i, : len(t)] = t[name].to_numpy()
        return out

    feature, cut = table("feature", -1, int), table("cut", 0.0, float)
    left, right, depth = table("left", -1, int), table("right", -1, int), table("depth", 0.0, float)
    norm = float(mean_path(min(rows, df.count())))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["x"].tolist(), dtype=float)
            at = np.arange(len(x))
            total = np.zeros(len(x))
            for t in range(len(per_tree)):
                node = np.zeros(len(x), dtype=int)
                while True:
                    f = feature[t, node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    low = x[at, np.maximum(f, 0)] <= cut[t, node]
                    node = np.where(inner, np.where(low, left[t, node], right[t, node]), node)
                total += depth[t, node]
            yield pd.DataFrame({"key": b["key"], "score": 2.0 ** (-total / len(per_tree) / norm)})

    rows_in = points.select(col(key).alias("key"), F.array(*[col(c) for c in names]).alias("x"))
    kind = rows_in.schema["key"].dataType.simpleString()
    scored = checkpoint(rows_in.mapInPandas(score, f"key {kind}, score double"))
    p = 1 - contamination
    bound = exact_quantiles(scored, {"score": [p]})["score"][p]
    return scored.select(F.col("key").alias(key), "score", (F.col("score") > F.lit(bound)).alias("is_anomaly"))
