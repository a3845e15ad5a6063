"""Scores of predictions and of clusterings."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekit.functions.columns import col, require_columns, small_table
from tablekit.functions.storage import checkpoint

def rank_aucs(df: DataFrame, scores: Mapping[str, tuple[Column, Column]]) -> dict[str, float | None]:
    """Areas under the ROC curves of several (score, positive) pairs by rank sums, ties counted half; None
    where one of the two classes is missing.

    All pairs go into one long table, reduced to (pair, score, positives, negatives) and put in order by
    ranges. Within a range the lower negatives are a running count; what earlier ranges hold is carried
    over from their totals, a row per range and pair. The number of jobs does not depend on the pairs.
    """
    names = list(scores)
    cells = [
        F.struct(F.lit(i).alias("c"), (s.cast("double") + F.lit(0.0)).alias("s"), p.cast("int").alias("p")) for i, (s, p) in enumerate(scores.values())
    ]
    rows = df.select(F.inline(F.array(*cells))).filter(F.col("s").isNotNull() & F.col("p").isNotNull())
    counts = rows.groupBy("c", "s").agg(F.sum("p").cast("double").alias("pos"), F.sum(1 - F.col("p")).cast("double").alias("neg"))
    part = F.shiftright(F.monotonically_increasing_id(), 33).alias("part")
    ranged = checkpoint(counts.orderBy("c", "s").select("c", "s", "pos", "neg", part))  # a second sort might draw other ranges
    lower = Window.partitionBy("part", "c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    pairs = F.col("pos") * (F.coalesce(F.sum("neg").over(lower), F.lit(0.0)) + F.col("neg") / 2)
    totals = ranged.withColumn("pairs", pairs).groupBy("c", "part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("pairs").alias("pairs"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("pairs") + F.col("pos") * F.coalesce(F.sum("neg").over(before), F.lit(0.0))
    areas = totals.withColumn("wins", wins).groupBy("c").agg(F.try_divide(F.sum("wins"), F.sum("pos") * F.sum("neg")).alias("area"))
    got = {r["c"]: r["area"] for r in areas.collect()}  # a row per pair
    return {name: got.get(i) for i, name in enumerate(names)}


def rank_auc(df: DataFrame, score: Column, positive: Column) -> float | None:
    """The area for one pair."""
    return rank_aucs(df, {"": (score, positive)})[""]


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``label, prediction, count`` (text form)."""
    require_columns(df, label, prediction)
    return (
        df.filter(col(label).isNotNull() & col(prediction).isNotNull())
        .groupBy(
            col(label).cast("string").alias("label"), col(prediction).cast("string").alias("prediction")
        )
        .agg(F.count(F.lit(1)).alias("count"))
    )


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Support, precision, recall and F1 per class; an undefined ratio is 0."""
    cells = confusion(df, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(F.lit(0))
    both = F.array(
        F.struct(F.col("label").alias("class"), F.col("count").alias("t"), F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("h")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("t"), F.col("count").alias("q"), hit.cast("long").alias("h")),
    )
    per = (
        cells.select(F.inline(both))
        .groupBy("class")
        .agg(F.sum("t").alias("support"), F.sum("q").alias("predicted"), F.sum("h").alias("hits"))
    )
    zero = F.lit(0.0)
    return per.select(
        "class",
        "support",
        F.coalesce(F.try_divide("hits", "predicted"), zero).alias("precision"),
        F.coalesce(F.try_divide("hits", "support"), zero).alias("recall"),
        F.coalesce(
            F.try_divide(F.lit(2.0) * F.col("hits"), F.col("predicted") + F.col("support")), zero
        ).alias("f1"),
    )


def classification_metrics(
    df: DataFrame,
    label: str,
    prediction: str,
    scores: Mapping[str, Column] | None = None,
) -> DataFrame:
    """accuracy, weighted precision/recall/F1, macro F1, recall per class, and ROC-AUC.

    ``scores`` maps class names to score columns: one entry (the positive class) for a
    binary problem, all classes for the one-against-rest weighted average.
    """
    report = class_report(df, label, prediction).collect()  # a row per class
    n = sum(r["support"] for r in report)
    rows: list[tuple[str, float]] = []
    if n:
        rows.append(("accuracy", sum(r["recall"] * r["support"] for r in report) / n))
        for name in ("precision", "recall", "f1"):
            rows.append((f"{name}_weighted", sum(r[name] * r["support"] for r in report) / n))
        rows.append(("f1_macro", sum(r["f1"] for r in report) / len(report)))
        rows += [(f"recall[{r['class']}]", r["recall"]) for r in report if r["support"]]
    if scores:
        sizes = {r["class"]: r["support"] for r in report}
        total, weight = 0.0, 0
        areas = rank_aucs(df, {cls: (score, col(label).cast("string") == F.lit(cls)) for cls, score in scores.items()})
        for cls, area in areas.items():
            if area is not None:
                w = sizes.get(cls, 0) if len(scores) > 1 else 1
                total, weight = total + area * w, weight + w
        if weight:
            rows.append(("roc_auc", total / weight))
    return small_table(df.sparkSession, rows, "metric string, value double")


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """RMSE, MAE and R2 in one pass plus the mean."""
    require_columns(df, label, prediction)
    y, p = col(label).cast("double"), col(prediction).cast("double")
    rows = df.filter(y.isNotNull() & p.isNotNull())
    row = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((y - p) * (y - p)).alias("mse"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.var_pop(y).alias("var"),
    ).first()
    out = []
    if row["n"]:
        out = [("rmse", math.sqrt(row["mse"])), ("mae", row["mae"])]
        if row["var"]:
            out.append(("r2", 1 - row["mse"] / row["var"]))
    return small_table(df.sparkSession, out, "metric string, value double")


def _silhouette(
    df: DataFrame, label: str, cols: Sequence[str], names: Sequence, sizes: np.ndarray, mean: np.ndarray, spread: np.ndarray
) -> float | None:
    """Mean silhouette of all rows in squared Euclidean distance. The mean squared distance of a row to
    a cluster is that to its centre plus the cluster's variance, so no pair of rows is compared."""
    shared = df.sparkSession.sparkContext.broadcast((list(names), sizes, mean, spread))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, sizes, mean, spread = shared.value
        at = {c: i for i, c in enumerate(names)}
        step = max(1, (1 << 22) // (len(names) * max(1, mean.shape[1])))
        for b in batches:
            own_all = b["c"].map(at).to_numpy()
            x_all = np.array(b["x"].tolist(), dtype=float).reshape(len(b), -1)
            total = 0.0
            for i in range(0, len(b), step):
                own, x = own_all[i : i + step], x_all[i : i + step]
                d = ((x[:, None, :] - mean[None, :, :]) ** 2).sum(axis=2) + spread
                rows, n = np.arange(len(x)), sizes[own]
                inner = d[rows, own] * n / np.maximum(n - 1, 1)
                d[rows, own] = np.inf
                outer = d.min(axis=1)
                top = np.maximum(inner, outer)
                total += float(np.where((n > 1) & (top > 0), (outer - inner) / np.where(top > 0, top, 1), 0.0).sum())
            yield pd.DataFrame({"s": [total], "n": [len(b)]})

    pts = df.select(col(label).cast("string").alias("c"), F.array(*[col(c).cast("double") for c in cols]).alias("x"))
    row = pts.mapInPandas(score, "s double, n long").agg(F.sum("s"), F.sum("n")).first()
    return row[0] / row[1] if row[1] else None


def cluster_metrics(df: DataFrame, label: str, cols: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Silhouette (in squared Euclidean distance), Calinski-Harabasz and Davies-Bouldin of all rows;
    empty for under two or too many labels. Three grouped passes, a row per cluster each."""
    require_columns(df, label, *cols, *key)
    groups = df.groupBy(col(label).alias("c"), col(label).cast("string").alias("name")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(col(c)) for c in cols]).alias("mean"),
        F.array(*[F.var_pop(col(c)) for c in cols]).alias("var"),
    )
    rows = groups.orderBy("c").collect()  # one row per cluster
    sizes = np.array([r["n"] for r in rows], dtype=float)
    n, k = sizes.sum(), len(rows)
    schema = "metric string, value double"
    if k < 2 or k >= n:
        return small_table(df.sparkSession, [], schema)
    mean = np.array([r["mean"] for r in rows])
    var = np.array([r["var"] for r in rows])
    centre = (sizes[:, None] * mean).sum(axis=0) / n
    between = float((sizes[:, None] * (mean - centre) ** 2).sum())
    within = float((sizes[:, None] * var).sum())
    ch = 1.0 if within == 0 else between / (k - 1) / (within / (n - k))
    centres = groups.select(F.col("c").alias("_cluster"), F.col("mean").alias("_centre"))
    near = F.sqrt(
        F.aggregate(
            F.zip_with(F.array(*[col(c).cast("double") for c in cols]), F.col("_centre"), lambda a, b: (a - b) * (a - b)),
            F.lit(0.0),
            lambda acc, v: acc + v,
        )
    )
    # one row per cluster on the right; Spark broadcasts it by its measured size
    spread_rows = (
        df.join(centres, col(label) == F.col("_cluster"))
        .groupBy("_cluster")
        .agg(F.avg(near).alias("s"))
        .orderBy("_cluster")
        .collect()
    )
    spread = np.array([r["s"] for r in spread_rows])
    worst = np.zeros(k)
    for i in range(k):
        gap = np.sqrt(((mean - mean[i]) ** 2).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = (spread + spread[i]) / gap
        ratio[i] = 0.0
        worst[i] = np.nan_to_num(ratio, nan=0.0, posinf=0.0).max()
    out = [("calinski_harabasz", float(ch)), ("davies_bouldin", float(worst.mean()))]
    sil = _silhouette(df, label, cols, [r["name"] for r in rows], sizes, mean, var.sum(axis=1))
    if sil is not None:
        out.insert(0, ("silhouette_squared", float(sil)))
    return small_table(df.sparkSession, out, schema)
