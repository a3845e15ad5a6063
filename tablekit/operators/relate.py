"""Relations between columns and grouped comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablekit.functions.columns import col, is_numeric, numeric_columns, require_columns, small_table
from tablekit.functions.order_stats import first_k
from tablekit.operators.profile import correlation_pairs


def strength(r: float) -> str:
    return "strong" if abs(r) >= 0.7 else "moderate" if abs(r) >= 0.4 else "weak"


def top_correlations(df: DataFrame, target: str | None = None, n: int = 20) -> DataFrame:
    """Strongest numeric pairs by |r|, with sign and strength."""
    pairs = [(a, b, r) for a, b, r in correlation_pairs(df, target=target) if r is not None]
    pairs.sort(key=lambda p: (-abs(p[2]), p[0], p[1]))
    return small_table(
        df.sparkSession,
        [(a, b, r, strength(r)) for a, b, r in pairs[:n]],
        "column_a string, column_b string, r double, strength string",
    )


def group_means(df: DataFrame, number: str, group: str, n: int = 8) -> DataFrame:
    """Mean and count of a number per group, highest mean first; empty groups are dropped."""
    require_columns(df, number, group)
    return (
        df.filter(col(group).isNotNull())
        .groupBy(col(group).alias("group"))
        .agg(F.avg(col(number)).alias("mean"), F.count(col(number)).alias("count"))
        .filter(F.col("mean").isNotNull())
        .orderBy(F.col("mean").desc(), "group")
        .limit(n)
    )


def trend_ends(df: DataFrame, number: str, time: str, key: str) -> DataFrame:
    """Mean of the first and of the last fifth of the rows in time order; ``key`` (a unique
    whole number) settles equal times. No row is sorted: both cuts are found by selection."""
    require_columns(df, number, time, key)
    rows = df.filter(col(number).isNotNull() & col(time).isNotNull()).select(
        col(number).cast("double").alias("v"),
        F.unix_micros(col(time).cast("timestamp")).alias("t"),
        col(key).cast("long").alias("k"),
    )
    n = rows.count()
    if n < 3:
        raise ValueError("a trend needs at least three dated rows")
    k = max(1, n // 5)
    # a 64-bit key as two numbers that a double holds exactly
    order = [F.col("t"), F.shiftright("k", 32), F.col("k").bitwiseAND(F.lit(0xFFFFFFFF))]
    first = first_k(rows, order, k)
    last = first_k(rows, [-c for c in order], k)
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(k).cast("long").alias("rows_per_end"),
        F.avg(F.when(first, F.col("v"))).alias("first_mean"),
        F.avg(F.when(last, F.col("v"))).alias("last_mean"),
    )


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency counts in long form."""
    require_columns(df, a, b)
    return (
        df.filter(col(a).isNotNull() & col(b).isNotNull())
        .groupBy(col(a).alias("value_a"), col(b).alias("value_b"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def crosstab_top(df: DataFrame, a: str, b: str) -> DataFrame:
    """The most common pair of values."""
    return crosstab(df, a, b).orderBy(F.col("count").desc(), "value_a", "value_b").limit(1)


def class_balance(df: DataFrame, target: str, top: int = 8) -> DataFrame:
    """Largest classes, the share of each among the shown rows, and the kind of problem."""
    require_columns(df, target)
    counts = (
        df.filter(col(target).isNotNull())
        .groupBy(col(target).cast("string").alias("class"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    kind = "classification"
    if is_numeric(df, target) and counts.limit(16).count() > 15:
        kind = "regression"
    shown = counts.orderBy(F.col("count").desc(), "class").limit(top)
    everything = Window.partitionBy(F.lit(1))  # over at most ``top`` rows
    return shown.select(
        "class",
        "count",
        (F.col("count") * 100.0 / F.sum("count").over(everything)).alias("pct"),
        F.lit(kind).alias("problem_type"),
    )


def _features(df: DataFrame, label: str, features: Sequence[str] | None) -> list[str]:
    return list(features or [c for c in numeric_columns(df) if c != label])


def cluster_profile(df: DataFrame, label: str, features: Sequence[str] | None = None) -> DataFrame:
    """Rows and mean of every feature per cluster."""
    names = _features(df, label, features)
    return df.groupBy(col(label)).agg(
        F.count(F.lit(1)).alias("rows"), *[F.avg(col(c)).alias(c) for c in names]
    )


def cluster_extremes(df: DataFrame, label: str, feature: str | None = None) -> DataFrame:
    """Largest and smallest cluster, or those with the highest and lowest mean of a feature."""
    value = F.count(F.lit(1)).cast("double") if feature is None else F.avg(col(feature))
    groups = (
        df.groupBy(col(label).alias("cluster")).agg(value.alias("value")).filter("value is not null")
    )
    hi = groups.orderBy(F.col("value").desc(), "cluster").limit(1).withColumn("which", F.lit("highest"))
    lo = groups.orderBy(F.col("value"), "cluster").limit(1).withColumn("which", F.lit("lowest"))
    return hi.unionByName(lo)


def cluster_zscores(df: DataFrame, label: str, features: Sequence[str] | None = None, top: int = 3) -> DataFrame:
    """How far each cluster mean lies from the overall mean, in overall standard deviations:
    the ``top`` features above and below per cluster."""
    names = _features(df, label, features)
    row = df.agg(
        *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.stddev(col(c)).alias(f"s{i}") for i, c in enumerate(names)],
    ).first()
    cells = []
    for i, c in enumerate(names):
        if row[f"s{i}"]:
            z = (F.avg(col(c)) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"])
            cells.append(F.struct(F.lit(c).alias("feature"), z.alias("z")))
    wide = df.filter(col(label).isNotNull()).groupBy(col(label).alias("cluster"))
    scores = wide.agg(F.array(*cells).alias("cells")).select("cluster", F.inline("cells"))
    side = F.when(F.col("z") > 0, "high").when(F.col("z") < 0, "low")
    order = Window.partitionBy("cluster", "side").orderBy(F.abs("z").desc(), "feature")
    return (
        scores.withColumn("side", side)
        .filter(F.col("side").isNotNull())
        .withColumn("rank", F.row_number().over(order).cast("long"))
        .filter(F.col("rank") <= top)
    )
