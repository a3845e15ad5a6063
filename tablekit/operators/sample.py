"""Sorting, top-k and repeatable sampling.

Sampling orders rows by md5(key, seed): the same rows whatever the partitioning. A bound
on the hash keeps only slightly more rows than asked for before anything is sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekit.functions.columns import col, is_numeric, require_columns, row_hash, small_table
from tablekit.functions.numbering import in_order
from tablekit.functions.storage import checkpoint

SMALL_CLASS = 200_000
#: class tables of up to so many rows go to every task; longer ones are joined by class
BROADCAST_CLASSES = 100_000


def sort_by(df: DataFrame, column: str, ascending: bool = True, key: Sequence[str] = ()) -> DataFrame:
    """Sort with missing values last in both directions."""
    require_columns(df, column)
    c = col(column)
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), *[col(k) for k in key])


def top_n(df: DataFrame, column: str, key: Sequence[str], n: int = 10, largest: bool = True) -> DataFrame:
    """The n largest or smallest rows of a numeric column."""
    require_columns(df, column)
    if not is_numeric(df, column):
        raise ValueError(f"{column} is not numeric")
    n = max(1, n)
    out = df.filter(col(column).isNotNull())
    order = col(column).desc() if largest else col(column).asc()
    return out.orderBy(order, *[col(k) for k in key]).limit(n)


def head(df: DataFrame, key: Sequence[str], n: int = 10) -> DataFrame:
    return df.orderBy(*[col(k) for k in key]).limit(n)


def tail(df: DataFrame, key: Sequence[str], n: int = 10) -> DataFrame:
    return df.orderBy(*[col(k).desc() for k in key]).limit(n)


def fraction_of(h: Column) -> Column:
    """Hash to [0, 1) on its first 13 hex digits, monotone in the hash text."""
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly n rows (all if fewer), uniform without replacement."""
    require_columns(df, *key)
    hashed = df.withColumn("_h", row_hash(key, seed))
    total = df.count()
    if total <= n:
        return df
    pool = hashed
    if total > 20 * n:
        bound = (n + 8 * math.sqrt(n) + 50) / total
        near = hashed.filter(fraction_of(F.col("_h")) < F.lit(bound))
        # repeated keys can starve the pool; then the whole table is ordered instead
        if near.count() >= n:
            pool = near
    return pool.orderBy("_h", *[col(k) for k in key]).limit(n).drop("_h")


def random_rows(df: DataFrame, rows: int, n: int, seed: int) -> DataFrame:
    """n random rows of ``df``, of ``rows`` rows. The draw is bounded first, so not every task gives n rows to the sort."""
    names = [col(c) for c in df.columns]
    drawn = df.withColumn("_u", F.rand(seed))
    if rows > n:
        drawn = drawn.filter(F.col("_u") < F.lit((n + 8 * math.sqrt(n) + 50) / rows))
    return drawn.orderBy("_u").limit(n).select(*names)


def class_table(df: DataFrame, label: str) -> DataFrame:
    """``_c, _n``: rows per class, missing labels left out; any number of classes."""
    counts = df.filter(col(label).isNotNull()).groupBy(col(label).cast("string").alias("_c"))
    return checkpoint(counts.agg(F.count(F.lit(1)).alias("_n")))


def _quotas(classes: DataFrame, size: int, total: int, floor_one: bool) -> DataFrame:
    """``_c, _n, _q``: ``size`` split over the classes in proportion, largest remainders first, then by name.
    Whole numbers throughout, so classes of a size tie exactly."""
    product = F.col("_n").cast("decimal(18,0)") * F.lit(size).cast("decimal(18,0)")
    whole = classes.withColumn("_product", product).withColumn("_q", F.expr(f"_product div {total}"))
    whole = whole.withColumn("_rest", F.col("_product") - F.col("_q") * F.lit(total).cast("decimal(18,0)")).drop("_product")
    left = size - (whole.agg(F.sum("_q")).first()[0] or 0)
    if left:
        whole = in_order(whole, [F.col("_rest").desc(), F.col("_c")], "_no")
        whole = whole.withColumn("_q", F.col("_q") + (F.col("_no") < left).cast("long")).drop("_no")
    if floor_one:
        whole = whole.withColumn("_q", F.least(F.greatest(F.col("_q"), F.lit(1).cast("long")), F.col("_n")))
    return whole.drop("_rest")


def _marked(df: DataFrame, label: str, key: Sequence[str], quotas: DataFrame, seed: int, small_class: int) -> tuple[DataFrame, DataFrame]:
    """(taken, left): the first ``_q`` rows of each class in hash order.

    In a large class the rows well below or above the expected cut are decided by their
    hash alone. Only a band of a few standard deviations is ranked, so no task ever
    sorts a whole class.
    """
    p, large = F.col("_q") / F.col("_n"), F.col("_n") > small_class
    d = 8 * F.sqrt(p * (1 - p) / F.col("_n")) + 50 / F.col("_n")
    plan = quotas.select(
        "_c",
        "_q",
        F.when(large, F.greatest(F.lit(0.0), p - d)).otherwise(0.0).alias("_lo"),
        F.when(large, F.least(F.lit(2.0), p + d)).otherwise(2.0).alias("_hi"),
    )
    hashed = df.withColumn("_c", col(label).cast("string")).withColumn("_h", row_hash(key, seed))
    hashed = hashed.withColumn("_u", fraction_of(F.col("_h")))
    rows = plan.agg(F.count(F.lit(1)), F.max("_lo")).first()
    few = rows[0] <= BROADCAST_CLASSES

    def with_plan(plan: DataFrame) -> DataFrame:
        return hashed.join(F.broadcast(plan) if few else plan, "_c")

    plan = plan.withColumn("_below", F.lit(0).cast("long"))
    if rows[1]:
        under = F.count_if(F.col("_u") < F.col("_lo"))
        inside = F.count_if((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
        seen = with_plan(plan.filter("_lo > 0")).groupBy("_c").agg(under.alias("_b"), inside.alias("_in"))
        plan = plan.join(seen, "_c", "left")
        # repeated keys can put too much on one side; then the whole class is ranked
        fits = (F.col("_b") <= F.col("_q")) & (F.col("_q") <= F.col("_b") + F.col("_in"))
        plan = checkpoint(
            plan.select(
                "_c",
                "_q",
                F.when(fits, F.col("_lo")).otherwise(0.0).alias("_lo"),
                F.when(fits | (F.col("_lo") == 0), F.col("_hi")).otherwise(2.0).alias("_hi"),
                F.when(fits, F.col("_b")).otherwise(0).cast("long").alias("_below"),
            )
        )
    joined = with_plan(plan)
    order = Window.partitionBy("_c").orderBy("_h", *[col(k) for k in key])
    band = joined.filter((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).withColumn(
        "_rn", F.row_number().over(order)
    )
    names = [col(c) for c in df.columns]
    quota = F.col("_q") - F.col("_below")
    taken = band.filter(F.col("_rn") <= quota).select(*names)
    left = band.filter(F.col("_rn") > quota).select(*names)
    taken = taken.unionByName(joined.filter(F.col("_u") < F.col("_lo")).select(*names))
    left = left.unionByName(joined.filter(F.col("_u") >= F.col("_hi")).select(*names))
    return taken, left


def stratified_sample(
    df: DataFrame,
    label: str,
    key: Sequence[str],
    n: int | None = None,
    seed: int = 42,
    small_class: int = SMALL_CLASS,
    fraction: float | None = None,
) -> DataFrame:
    """Class-proportional sample of n rows, or of a fraction of them."""
    if (n is None) == (fraction is None):
        raise ValueError("give either n or a fraction")
    require_columns(df, label, *key)
    classes = class_table(df, label)
    total = classes.agg(F.sum("_n")).first()[0] or 0
    size = math.ceil(total * fraction) if n is None else min(n, total)
    if size >= total:
        return df.filter(col(label).isNotNull())
    return _marked(df, label, key, _quotas(classes, size, total, floor_one=False), seed, small_class)[0]


def train_test_split(
    df: DataFrame,
    key: Sequence[str],
    label: str | None = None,
    fraction: float = 0.2,
    seed: int = 42,
    small_class: int = SMALL_CLASS,
) -> tuple[DataFrame, DataFrame]:
    """(train, test) of exact sizes; stratified when every class has at least two rows,
    with at least one test row per class."""
    require_columns(df, *key)
    work, by = df, label
    if label is not None:
        work = df.filter(col(label).isNotNull())
        classes = class_table(work, label)
        k, least, total = classes.agg(F.count(F.lit(1)), F.min("_n"), F.sum("_n")).first()
        if not k or least < 2:
            by = None
    if by is None:
        total, k = work.count(), 1
        classes = small_table(df.sparkSession, [("all", total)], "_c string, _n long")
        work = work.withColumn("_all", F.lit("all"))
    size = max(1, round(total * fraction))
    if by is not None:
        size = max(size, k)
    if total - size < 1:
        raise ValueError("too few rows to split")
    quotas = _quotas(classes, size, total, floor_one=by is not None)
    test, train = _marked(work, by or "_all", key, quotas, seed, small_class)
    names = [col(c) for c in df.columns]
    return train.select(*names), test.select(*names)
