"""Folders that all machines share, and cutting lineage in them."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


#: rows of a task, of tables that are read again and again
ROWS_PER_TASK = 1 << 15


def spread(df: DataFrame, rows: int, least: int | None = None) -> DataFrame:
    """``df``, of ``rows`` rows, dealt out to tasks of ROWS_PER_TASK; where rows are costly, to smaller ones of
    ``least`` rows at the smallest as long as cores are idle. A small file, or one row group, comes as a single task
    whatever its number of rows, and a ranked class too."""
    tasks = -(-rows // ROWS_PER_TASK)
    if least:
        tasks = max(tasks, min(df.sparkSession.sparkContext.defaultParallelism, rows // least))
    return df if tasks <= 1 else df.repartition(tasks)


def shared_base(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else the warehouse, which tables share anyway.

    A warehouse on a local disk is refused where tasks run on other machines.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    folder = spark.conf.get("spark.sql.warehouse.dir")
    if re.match(r"file:|/", folder) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return folder.rstrip("/")


def shared_folder(spark: SparkSession, kind: str = "files") -> str:
    """A fresh folder there."""
    return f"{shared_base(spark)}/tablekit-{kind}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark, "checkpoints"))
    return df.checkpoint()
