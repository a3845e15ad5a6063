"""Duplicates, missing values, outliers and text that holds numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekit.functions.columns import (
    col,
    is_numeric,
    numeric_columns,
    quoted,
    require_columns,
    string_columns,
    to_number,
)
from tablekit.functions.frequency import top_value, top_values, value_frequency
from tablekit.functions.order_stats import exact_quantiles


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Distinct rows; missing equals missing."""
    return df.dropDuplicates()


def drop_duplicates_by(df: DataFrame, cols: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """First row per value of ``cols`` in ``order_by`` order.

    ``row_number = 1`` is cut to one row per key inside every map task before the
    shuffle, so a frequent key does not pile up in one reducer.
    """
    require_columns(df, *cols, *order_by)
    first = Window.partitionBy(*[col(c) for c in cols]).orderBy(*[col(c) for c in order_by])
    return df.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def duplicate_count(df: DataFrame) -> DataFrame:
    """``rows`` and ``duplicate_rows`` = rows minus distinct rows."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
    )


def _filled(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    """Fill by column in one projection; a fraction turns a whole-number column to double."""

    def cell(name: str) -> Column:
        value = fills.get(name)
        if value is None:
            return col(name)
        c = col(name)
        if is_numeric(df, name) and isinstance(value, float):
            if value != int(value) or df.schema[name].dataType.typeName() in ("float", "double"):
                c = c.cast("double")
            else:
                value = int(value)
        return F.coalesce(c, F.lit(value)).alias(name)

    return df.select(*[cell(c) for c in df.columns])


def fill_missing(df: DataFrame, column: str, strategy: str, value=None) -> DataFrame:
    """Fill with mean, median, mode, zero or a constant. Mode ties give the smallest value;
    the mode of an empty column is ``Unknown``."""
    require_columns(df, column)
    if strategy == "mean":
        fill = df.agg(F.avg(col(column))).first()[0]
    elif strategy == "median":
        fill = exact_quantiles(df, {column: [0.5]})[column][0.5]
    elif strategy == "mode":
        fill = top_value(df, column)
        if fill is None and not is_numeric(df, column):
            fill = "Unknown"
    elif strategy == "zero":
        fill = 0
    elif strategy == "constant":
        fill = value
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return _filled(df, {column: fill})


def gap_columns(df: DataFrame) -> list[str]:
    """Columns with a missing cell."""
    row = df.selectExpr("count(1)", *[f"count({quoted(c)})" for c in df.columns]).first()
    return [c for i, c in enumerate(df.columns) if row[i + 1] < row[0]]


def fill_values(
    df: DataFrame, numeric: str = "median", categorical: str = "mode", cols: Sequence[str] | None = None
) -> dict:
    """Fill value per column (of ``cols``), from at most three fused passes."""
    fills: dict[str, object] = {}
    wanted = set(df.columns if cols is None else cols)
    nums = [c for c in numeric_columns(df) if c in wanted]
    texts = [c for c in string_columns(df) if c in wanted]
    if numeric == "median" and nums:
        found = exact_quantiles(df, {c: [0.5] for c in nums})
        fills.update({c: found[c][0.5] for c in nums})
    elif numeric == "mean" and nums:
        row = df.agg(*[F.avg(col(c)).alias(c) for c in nums]).first()
        fills.update({c: row[c] for c in nums})
    elif numeric == "zero":
        fills.update({c: 0 for c in nums})
    elif numeric not in ("none", "median", "mean"):
        raise ValueError(f"unknown strategy {numeric}")
    if categorical == "mode" and texts:
        modes = {
            r["column_name"]: r["value"]
            for r in top_values(value_frequency(df, texts), 1).collect()  # a row per column
        }
        fills.update({c: modes.get(c, "Unknown") for c in texts})
    elif categorical == "unknown":
        fills.update({c: "Unknown" for c in texts})
    elif categorical not in ("none", "mode"):
        raise ValueError(f"unknown strategy {categorical}")
    return fills


def fill_missing_all(df: DataFrame, numeric: str = "median", categorical: str = "mode") -> DataFrame:
    """Statistics are taken of the columns that have gaps only."""
    return _filled(df, fill_values(df, numeric, categorical, gap_columns(df)))


def high_missing_columns(df: DataFrame, share: float = 0.5) -> list[str]:
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(col(c)).alias(c) for c in df.columns]).first()
    n = row["_n"]
    return [c for c in df.columns if n and (n - row[c]) / n > share]


def drop_high_missing(df: DataFrame, share: float = 0.5) -> DataFrame:
    gone = set(high_missing_columns(df, share))
    return df.select(*[col(c) for c in df.columns if c not in gone])


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one distinct non-missing value: min = max, no distinct count."""
    aggs = []
    for i, c in enumerate(df.columns):
        aggs.append((F.min(col(c)).eqNullSafe(F.max(col(c)))).alias(f"k{i}"))
    row = df.agg(*aggs).first()
    return [c for i, c in enumerate(df.columns) if row[f"k{i}"]]


def drop_constant(df: DataFrame) -> DataFrame:
    gone = set(constant_columns(df))
    return df.select(*[col(c) for c in df.columns if c not in gone])


def numeric_text_columns(df: DataFrame, share: float = 0.9) -> list[str]:
    texts = string_columns(df)
    if not texts:
        return []
    aggs = []
    for i, c in enumerate(texts):
        aggs += [F.count(col(c)).alias(f"n{i}"), F.count(to_number(col(c))).alias(f"ok{i}")]
    row = df.agg(*aggs).first()
    return [c for i, c in enumerate(texts) if row[f"n{i}"] and row[f"ok{i}"] / row[f"n{i}"] >= share]


def coerce_numeric_text(df: DataFrame, share: float = 0.9) -> DataFrame:
    """Text columns in which 90 % of the values are numbers become double."""
    hit = set(numeric_text_columns(df, share))
    return df.select(*[to_number(col(c)).alias(c) if c in hit else col(c) for c in df.columns])


def iqr_bounds(df: DataFrame, cols: Sequence[str], k: float) -> dict[str, tuple[float, float]]:
    """``[Q1 - k IQR, Q3 + k IQR]`` per column; columns without spread are left out."""
    found = exact_quantiles(df, {c: [0.25, 0.75] for c in cols})
    out = {}
    for c in cols:
        q1, q3 = found[c][0.25], found[c][0.75]
        if q1 is not None and q3 != q1:
            out[c] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return out


def drop_outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows inside the bounds; missing rows go, a column without spread changes nothing."""
    require_columns(df, column)
    bounds = iqr_bounds(df, [column], k)
    if column not in bounds:
        return df
    lo, hi = bounds[column]
    return df.filter(col(column).between(lo, hi))


def drop_outliers_all(df: DataFrame, k: float = 1.5) -> DataFrame:
    """All numeric columns at once, bounds from the original table, missing rows out;
    columns with fewer than four values are skipped."""
    nums = numeric_columns(df)
    if not nums:
        return df
    row = df.agg(*[F.count(col(c)).alias(c) for c in nums]).first()
    keep = F.lit(True)
    for c, (lo, hi) in iqr_bounds(df, [c for c in nums if row[c] >= 4], k).items():
        keep = keep & col(c).between(lo, hi)
    return df.filter(keep)


def clip_columns(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    def cell(c: str) -> Column:
        if c not in bounds:
            return col(c)
        lo, hi = bounds[c]
        # greatest and least skip NULL, so an unguarded clip would fill missing cells
        inside = F.greatest(F.lit(lo), F.least(F.lit(hi), col(c).cast("double")))
        return F.when(col(c).isNotNull(), inside).alias(c)

    return df.select(*[cell(c) for c in df.columns])


def clip_outliers(df: DataFrame, k: float = 3.0) -> DataFrame:
    return clip_columns(df, iqr_bounds(df, numeric_columns(df), k))
