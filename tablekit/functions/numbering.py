"""Numbers for rows in an order, without a task that sees all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.functions.columns import col, small_table
from tablekit.functions.storage import checkpoint


def in_order(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with a column ``name``: 0, 1, ... in the given order. Ranges of a sort are numbered one by one and
    continued from the sizes of those before, a row per range."""
    at = F.monotonically_increasing_id()
    ranged = df.orderBy(*order).select(
        "*", F.shiftright(at, 33).alias("_tk_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_tk_nth")
    )
    ranged = checkpoint(ranged)  # a second sort might draw other ranges
    before, starts = 0, []
    for r in ranged.groupBy("_tk_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_tk_part").collect():
        starts.append((r["_tk_part"], before))
        before += r["n"]
    table = small_table(df.sparkSession, starts, "_tk_part long, _tk_before long")  # a row per range of the sort
    number = (F.col("_tk_before") + F.col("_tk_nth")).alias(name)
    return ranged.join(F.broadcast(table), "_tk_part").select(*[col(c) for c in df.columns], number)
