"""Principal components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekit.functions.columns import col, numeric_columns, small_table
from tablekit.operators.features import GENERATED, prepared

#: the first that holds names the result
VERDICTS = (
    ("excellent", "for_80 <= 2"),
    ("good", "for_80 <= greatest(3, columns div 2)"),
    ("poor", "for_90 >= columns"),
)


def _fit(df: DataFrame, cols: Sequence[str] | None, k: int | None, drop_flat: bool):
    names = list(cols or numeric_columns(df, exclude=GENERATED))
    if drop_flat and names:
        row = df.agg(*[F.stddev(col(c)).alias(c) for c in names]).first()
        names = [c for c in names if (row[c] or 0) > 0]
    if len(names) < 2:
        raise ValueError("PCA needs at least two numeric columns")
    points, names = prepared(df, names)
    vectors = VectorAssembler(inputCols=names, outputCol="_features").transform(points)
    model = PCA(k=k or len(names), inputCol="_features", outputCol="_pc").fit(vectors)
    # the sign of a component is arbitrary: its largest loading is made positive
    pc = model.pc.toArray()
    signs = np.sign(pc[np.abs(pc).argmax(axis=0), np.arange(pc.shape[1])])
    return vectors, names, model, pc * signs, signs


def pca_project(
    df: DataFrame, key: Sequence[str], cols: Sequence[str] | None = None, k: int = 2, color: str | None = None
) -> DataFrame:
    """Key columns and coordinates ``pc1 .. pck`` of the standardised rows, with the ``label`` of a
    colour column if one is named."""
    names = list(cols or [c for c in numeric_columns(df, exclude=GENERATED) if c not in key])
    vectors, _, model, _, signs = _fit(df, names, k, False)
    xs = vector_to_array("_pc")
    coords = [(F.get(xs, F.lit(i)) * F.lit(float(signs[i]))).alias(f"pc{i + 1}") for i in range(k)]
    shade = [F.coalesce(col(color).cast("string"), F.lit("(missing)")).alias("label")] if color else []
    return model.transform(vectors).select(*[col(c) for c in key], *coords, *shade)


def pca_variance(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Explained and cumulative share (percent) per component."""
    _, _, model, _, _ = _fit(df, cols, None, True)
    share = model.explainedVariance.toArray() * 100
    rows = [(i + 1, float(v), float(c)) for i, (v, c) in enumerate(zip(share, np.cumsum(share)))]
    return small_table(df.sparkSession, rows, "component long, explained_pct double, cumulative_pct double")


def pca_loadings(df: DataFrame, cols: Sequence[str] | None = None, k: int = 2) -> DataFrame:
    """Weight of every column in the first components."""
    _, names, _, pc, _ = _fit(df, cols, None, True)
    rows = [(c, j + 1, float(pc[i, j])) for i, c in enumerate(names) for j in range(k)]
    return small_table(df.sparkSession, rows, "column_name string, component long, loading double")


def pca_analyse(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row: whether PCA pays off, and the components needed for 80, 90 and 95 %."""
    n = df.count()
    schema = (
        "feasible boolean, columns long, rows long, for_80 long, for_90 long, for_95 long, "
        "top2_pct double, verdict string"
    )
    if n < 10:
        return small_table(df.sparkSession, [(False, 0, n, None, None, None, None, None)], schema)
    try:
        _, names, model, _, _ = _fit(df, cols, None, True)
    except ValueError:
        return small_table(df.sparkSession, [(False, 0, n, None, None, None, None, None)], schema)
    shares = np.round(np.cumsum(model.explainedVariance.toArray()) * 100, 2)
    steps = small_table(df.sparkSession, [(i + 1, float(v)) for i, v in enumerate(shares)], "component long, total double")

    def reached(pct: int):
        """The first component at which the share is reached, else the last."""
        return F.coalesce(F.min(F.when(F.col("total") >= pct, F.col("component"))), F.max("component")).alias(f"for_{pct}")

    row = steps.agg(
        F.lit(True).alias("feasible"),
        F.lit(len(names)).cast("long").alias("columns"),
        F.lit(n).cast("long").alias("rows"),
        *(reached(pct) for pct in (80, 90, 95)),
        F.max_by("total", F.when(F.col("component") <= 2, F.col("component"))).alias("top2_pct"),
    )
    return row.withColumn("verdict", F.coalesce(*(F.when(F.expr(when), name) for name, when in VERDICTS), F.lit("moderate")))
