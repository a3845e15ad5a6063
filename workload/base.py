"""Query registry and the tables with injected defects that several queries share."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekit.functions.storage import shared_folder
from tablekit.sources.tables import read_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A test table. Text work is costly per row: those tables, or any with ``spread``, use all
    cores even where the file is a single row group. The tables hold no NaN."""
    wide = spread or name in ("documents", "conversations", "pages")
    cores = spark.sparkContext.defaultParallelism if wide else None
    return read_parquet(spark, os.path.join(sf_dir, f"{name}.parquet"), cores, has_nan=False)


def scratch(spark: SparkSession) -> str:
    """A fresh folder for files a query writes, in the shared folder of the cluster."""
    return shared_folder(spark)


def r(c: Column | str, digits: int = 4) -> Column:
    """Rounded, without a negative zero: sums in another order differ in the last bits."""
    return F.round(c, digits) + F.lit(0.0)


def lineitem(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """lineitem with gaps in ``qty`` and ``flag``."""
    return table(spark, sf_dir, "lineitem", spread).withColumns(
        {
            "qty": F.when(F.col("l_linenumber") != 3, F.col("l_quantity")),
            "flag": F.when(F.col("l_linenumber") != 5, F.col("l_returnflag")),
        }
    )


LINEITEM = """(SELECT *, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS qty,
 CASE WHEN l_linenumber <> 5 THEN l_returnflag END AS flag FROM lineitem)"""

LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
