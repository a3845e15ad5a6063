"""Choosing the number of clusters and the clustering method."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekit.functions.columns import col, small_table
from tablekit.functions.storage import checkpoint, spread
from tablekit.operators.cluster import LABEL, dbscan, fit_bisecting, label_nearest
from tablekit.operators.features import prepared
from tablekit.operators.lloyd import fit_all
from tablekit.operators.metrics import cluster_metrics

DENSITY_RADII = (0.3, 0.5, 0.8, 1.2, 1.8, 2.5)


def _metrics(labelled: DataFrame, names: Sequence[str], key: str) -> dict[str, float]:
    return {r["metric"]: r["value"] for r in cluster_metrics(labelled, LABEL, names, [key]).collect()}


def _start(df: DataFrame, key: str, cols: Sequence[str] | None) -> tuple[DataFrame, list[str], int]:
    n = df.count()
    if n < 3:
        raise ValueError("at least three rows are needed")
    points, names = prepared(df.drop(LABEL), cols, skip=(key,))
    # read by every candidate: written once, in tasks of bounded size
    return checkpoint(spread(points.select(col(key), *[col(c) for c in names]), n)), names, n


def suggest_k(df: DataFrame, key: str, cols: Sequence[str] | None = None, max_k: int = 10) -> DataFrame:
    """Inertia and the three scores per k, the votes of four criteria, and the recommended k."""
    points, names, n = _start(df, key, cols)
    ks = list(range(2, max(2, min(max_k, n - 1)) + 1))
    inertia, sil, db, ch = [], [], [], []
    fits = fit_all(points, names, ks)
    for k in ks:
        m = _metrics(label_nearest(points, names, fits[k]), names, key)
        inertia.append(fits[k].cost)
        sil.append(m.get("silhouette_squared", 0.0))
        db.append(m.get("davies_bouldin", 0.0))
        ch.append(m.get("calinski_harabasz", 0.0))
    at = range(len(ks))
    best_sil = max(at, key=lambda i: sil[i])
    best_db = min([i for i in at if db[i] > 0] or [0], key=lambda i: db[i])
    best_ch = max(at, key=lambda i: ch[i])
    elbow = 0
    if len(ks) >= 3:
        bends = [inertia[i - 1] - 2 * inertia[i] + inertia[i + 1] for i in range(1, len(ks) - 1)]
        elbow = 1 + max(range(len(bends)), key=lambda i: bends[i])
    votes = [sum(i == b for b in (best_sil, best_db, best_ch, elbow)) for i in at]
    chosen = max(at, key=lambda i: (votes[i], sil[i]))
    rows = [(k, inertia[i], sil[i], db[i], ch[i], votes[i], i == chosen) for i, k in enumerate(ks)]
    return small_table(
        df.sparkSession,
        rows,
        "k long, inertia double, silhouette double, davies_bouldin double, calinski_harabasz double, "
        "votes long, recommended boolean",
    )


def cluster_best(
    df: DataFrame,
    key: str,
    cols: Sequence[str] | None = None,
    max_k: int = 10,
    radii: Sequence[float] = DENSITY_RADII,
) -> tuple[DataFrame, DataFrame]:
    """(key and ``cluster_label`` of the best clustering, candidate scores, best first)."""
    points, names, n = _start(df, key, cols)
    found: list[tuple[tuple, str, int, float | None, dict, DataFrame]] = []

    def add(method: str, k: int, eps: float | None, labelled: DataFrame, scored: DataFrame) -> None:
        m = _metrics(scored, names, key)
        if m:
            rank = (m.get("silhouette_squared", -1.0), -m["davies_bouldin"], m["calinski_harabasz"])
            found.append((rank, method, k, eps, m, labelled.select(key, LABEL)))

    ks = range(2, max(2, min(max_k, n - 1)) + 1)
    fits = fit_all(points, names, ks)
    for k in ks:
        labelled = label_nearest(points, names, fits[k])
        add("kmeans", k, None, labelled, labelled)
        labelled, _ = fit_bisecting(points, names, k)
        add("hierarchical", k, None, labelled, labelled)
    min_samples = max(5, min(20, len(names) * 2))
    for eps in radii:
        labels = checkpoint(dbscan(points, key, names, eps, min_samples, standardise=False))
        row = labels.agg(
            F.count_if(F.col(LABEL) >= 0).alias("kept"),
            F.count_distinct(F.when(F.col(LABEL) >= 0, F.col(LABEL))).alias("k"),
        ).first()
        if row["k"] < 2 or row["kept"] < max(3, int(0.4 * n)):
            continue
        scored = points.join(labels.filter(F.col(LABEL) >= 0), key)
        add("dbscan", row["k"], eps, labels, scored)
    if not found:
        raise ValueError("no valid clustering was found")
    found.sort(key=lambda f: f[0], reverse=True)
    rows = [
        (i + 1, method, k, eps, m.get("silhouette_squared"), m["davies_bouldin"], m["calinski_harabasz"])
        for i, (_, method, k, eps, m, _) in enumerate(found)
    ]
    table = small_table(
        df.sparkSession,
        rows,
        "rank long, method string, clusters long, eps double, silhouette double, "
        "davies_bouldin double, calinski_harabasz double",
    )
    return found[0][5], table
