"""One value-frequency table for many columns: one scan, one shuffle, combined map-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions.columns import col, require_columns
from tablekit.functions.text import word_count


_TIMES = (T.TimestampType, T.TimestampNTZType)


def _cell(df: DataFrame, name: str, at: int) -> Column:
    """The cell in one of three slots, so that whole numbers, fractions and text all keep
    their exact value and the grouping key stays cheap to hash."""
    kind = df.schema[name].dataType
    whole, frac, text = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(kind, T.IntegralType):
        whole = col(name).cast("long")
    elif isinstance(kind, _TIMES):
        whole = F.unix_micros(col(name).cast("timestamp"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        frac = col(name).cast("double")
    else:
        text = col(name).cast("string")
    return F.struct(
        F.lit(at).alias("_c"), whole.alias("_n"), frac.alias("_d"), text.alias("_s")
    )


def _cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A row per non-missing cell."""
    require_columns(df, *cols)
    cells = F.array(*[_cell(df, c, i) for i, c in enumerate(cols)])
    return df.select(F.inline(cells)).filter(F.col("_s").isNotNull() | F.col("_n").isNotNull() | F.col("_d").isNotNull())


def _named(freq: DataFrame, cols: Sequence[str]) -> DataFrame:
    return freq.withColumn("column_name", F.get(F.array(*[F.lit(c) for c in cols]), F.col("_c")))


def value_frequency(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column_name, value, count`` of the non-missing values (value as text; the typed
    slots ``_n _d _s`` stay for ordering)."""
    number = F.col("_n").cast("string")
    times = [c for c in cols if isinstance(df.schema[c].dataType, _TIMES)]
    if times:
        moment = F.timestamp_micros("_n").cast("string")
        number = F.when(F.col("column_name").isin(*times), moment).otherwise(number)
    freq = _cells(df, cols).groupBy("_c", "_n", "_d", "_s").agg(F.count(F.lit(1)).alias("count"))
    return _named(freq, cols).withColumn("value", F.coalesce("_s", number, F.col("_d").cast("string")))


def value_digests(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column_name, words, count`` by distinct non-missing value, without the values: texts go into the shuffle
    as SHA-256 digests of 32 bytes, however long they are. ``words`` is null for numbers and -1 for blank texts."""
    text = F.col("_s")
    words = F.when(text.isNotNull(), F.when(F.trim(text) != "", word_count(text)).otherwise(-1))
    cells = _cells(df, cols).select("_c", "_n", "_d", F.unhex(F.sha2(text, 256)).alias("_h"), words.alias("words"))
    freq = cells.groupBy("_c", "_n", "_d", "_h", "words").agg(F.count(F.lit(1)).alias("count"))
    return _named(freq, cols).select("column_name", "words", "count")


def top_values(freq: DataFrame, top: int) -> DataFrame:
    """Most frequent values per column with ``rank``; ties go to the smallest value."""
    order = Window.partitionBy("column_name").orderBy(F.col("count").desc(), "_n", "_d", "_s")
    return (
        freq.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .select("column_name", F.col("rank").cast("long").alias("rank"), "value", "count")
    )


def frequency_summary(df: DataFrame, cols: Sequence[str]) -> dict[str, dict[str, int]]:
    """Per column: ``unique`` values, ``repeated`` values, and for text the non-blank cells
    (``filled``), their distinct values (``unique_nonblank``) and words (``words``)."""
    shown = F.when(F.col("words") >= 0, F.col("count"))
    rows = (
        value_digests(df, cols)
        .groupBy("column_name")
        .agg(
            F.count(F.lit(1)).alias("unique"),
            F.count_if(F.col("count") > 1).alias("repeated"),
            F.count(shown).alias("unique_nonblank"),
            F.coalesce(F.sum(shown), F.lit(0)).alias("filled"),
            F.coalesce(F.sum(shown * F.col("words")), F.lit(0)).alias("words"),
        )
        .collect()  # one row per column
    )
    return {r["column_name"]: r.asDict() for r in rows}


def top_value(df: DataFrame, column: str):
    """Most frequent non-missing value, the smallest on a tie; None for an empty column."""
    row = (
        df.filter(col(column).isNotNull())
        .groupBy(col(column).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "v")
        .first()
    )
    return None if row is None else row["v"]
