"""Registry of the training-data queries and the tables they read."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions.columns import col
from tablekit.functions.storage import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Of crc32(doc_id) mod 4: the fold that no model learns from.
HELD_OUT = 2


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the held-out fold; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_models: list[Broadcast] = []


def model(spark: SparkSession, value: Any) -> Broadcast:
    """A broadcast of bounded size that ``release`` knows."""
    _models.append(spark.sparkContext.broadcast(value))
    return _models[-1]


def release() -> None:
    """Executors drop the models they hold. A query that still needs one gets it again."""
    while _models:
        _models.pop().unpersist()


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: Any) -> DataFrame:
    """``mapInArrow`` for columns of any names, by tasks that give back the memory of their batches when
    they end."""
    names = df.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(b.rename_columns(names) for b in batches)
        pa.default_memory_pool().release_unused()

    return df.toDF(*(f"_{i}" for i in range(len(names)))).mapInArrow(task, schema)


ROW = "_row"


def packed(docs: DataFrame, text: str | None = None) -> DataFrame:
    """All columns as one, so that none of their names meets an operator's, with the text beside it."""
    rest = [col(c) for c in docs.columns if c != text] or [F.lit(0).alias("_")]
    return docs.select(F.struct(*rest).alias(ROW), *([col(text)] if text else []))


def unpacked(columns: Sequence[str], text: str | None = None) -> list[Column]:
    """The columns of the table that was packed."""
    return [col(c) if c == text else F.col(ROW).getField(c).alias(c) for c in columns]


def extended(fields: Sequence[T.StructField], added: str) -> T.StructType:
    """A schema with more columns."""
    return T.StructType([*fields, *T.StructType.fromDDL(added).fields])


def text_sample(rows: DataFrame, n: int, group: str | None = None) -> DataFrame:
    """Up to ``n`` distinct values of ``text``, in all or for each value of ``group`` (few), chosen by a
    hash. Hashes alone are moved to find where to cut, then only the chosen texts."""
    names = [group] if group else []
    h = F.xxhash64("text")
    keys = rows.select(*names, h.alias("_h")).distinct()
    if group:
        ranked = keys.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("_h")))
        cuts = ranked.where(F.col("_n") <= n).groupBy(group).agg(F.max("_h").alias("cut")).collect()  # a row per group
        pairs = [F.lit(x) for r in cuts for x in (r[group], r["cut"])]
        cut = F.try_element_at(F.create_map(*pairs), F.col(group)) if pairs else F.lit(None).cast("long")
    else:
        cut = F.lit(keys.orderBy("_h").limit(n).agg(F.max("_h")).first()[0]).cast("long")
    return rows.where(h <= cut).dropDuplicates([*names, "text"])
