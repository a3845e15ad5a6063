"""Readers and writers. Every reader returns a table with NULL as the only missing value."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions.columns import col, quoted

SEPARATORS = (",", ";", "\t")
MAX_ROWS = 5_500_000
MAX_COLUMNS = 1_000


def normalise_missing(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column, so no operator handles NaN again."""
    cells = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}"
        cells.append(c)
    return df.selectExpr(*cells)


SURPLUS = "_tk_surplus"


def _csv(
    spark: SparkSession, path: str, sep: str, schema: T.StructType | None, multi_line: bool
) -> DataFrame:
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        # count() must parse as much as the rows do
        .option("columnPruning", False)
    )
    # Without a schema Spark reads the files once more to infer one: give it at scale.
    known = schema if schema is not None else reader.option("inferSchema", True).csv(path).schema
    # one column more takes what a line has too much; short lines are filled with NULL
    wide = T.StructType([*known.fields, T.StructField(SURPLUS, T.StringType())])
    rows = reader.option("inferSchema", False).schema(wide).csv(path)
    return normalise_missing(rows.filter(F.col(SURPLUS).isNull()).drop(SURPLUS))


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    schema: T.StructType | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """CSV with header; the first of comma, semicolon, tab that splits the header is used.

    Empty cells, quoted or not, are NULL, short lines are filled with NULL, lines with a value too many
    are left out, quotes are doubled within quotes. A quoted cell may hold line breaks; where none does, ``multi_line=False`` lets
    several tasks share a file.
    """
    if sep is None:
        head = spark.read.text(path).limit(1).first()
        line = head[0] if head else ""
        sep = next((s for s in SEPARATORS if s in line), ",")
    return _csv(spark, path, sep, schema, multi_line)


def read_tsv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True
) -> DataFrame:
    return _csv(spark, path, "\t", schema, multi_line)


def read_json(
    spark: SparkSession, path: str, multi_line: bool = True, schema: T.StructType | None = None
) -> DataFrame:
    """JSON array or records. One-record-per-line files split across tasks: pass multi_line=False."""
    reader = spark.read.option("multiLine", multi_line)
    if schema is not None:
        reader = reader.schema(schema)
    return normalise_missing(reader.json(path))


def _variant_fields(found: str) -> T.StructType | None:
    """The columns of objects whose merged schema Spark names so; fractions are doubles, and what is
    of several kinds, or always null, is text."""
    if not found.startswith("OBJECT<") or found == "OBJECT<>":
        return None
    kinds = ((r"OBJECT<", "STRUCT<"), (r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE"), (r"(?<=[:<] )VOID|(?<=<)VOID", "STRING"), (r"(?<=[:<] )VARIANT|(?<=<)VARIANT", "STRING"))
    for old, new in kinds:
        found = re.sub(old, new, found)
    return T.StructType.fromDDL(found[len("STRUCT<") : -1])


def read_geojson(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per feature: its properties, ``_feature_index`` within its collection, ``_file`` (its
    name), ``_geometry_type`` and ``_geometry`` as JSON text with the values of the file, keys in order.

    Documents are read as VARIANT values, so coordinates of points, lines, polygons and collections of
    them keep their own nesting beside each other; only the properties get a common schema, which
    takes a pass over the features. A null geometry gives type Unknown and no text. A collection per line
    (multi_line=False) is read by many tasks.
    """
    raw = spark.read.option("multiLine", multi_line).option("singleVariantColumn", "doc").json(path)
    feats = raw.select(
        F.col("_metadata.file_name").alias("_file"),
        F.posexplode(F.expr("try_variant_get(doc, '$.features', 'array<variant>')")).alias("_feature_index", "f"),
    )
    feats = feats.select(
        "_file",
        F.col("_feature_index").cast("long").alias("_feature_index"),
        F.expr("try_variant_get(f, '$.geometry.type', 'string')").alias("_geometry_type"),
        F.expr("try_variant_get(f, '$.geometry', 'variant')").alias("geometry"),
        F.expr("try_variant_get(f, '$.properties', 'variant')").alias("properties"),
    )
    if feats.isEmpty():
        raise ValueError("the file holds no features")
    fields = _variant_fields(feats.agg(F.expr("schema_of_variant_agg(properties)")).first()[0])
    props = [F.col("p.*")] if fields else []
    text = F.to_json("properties")
    shape = F.when(~F.expr("is_variant_null(geometry)"), F.to_json("geometry"))
    return feats.withColumn("p", F.from_json(text, fields) if fields else F.lit(None)).select(
        *props, "_feature_index", F.coalesce("_geometry_type", F.lit("Unknown")).alias("_geometry_type"), "_file", shape.alias("_geometry")
    )


def read_parquet(
    spark: SparkSession, path: str, min_partitions: int | None = None, has_nan: bool = True
) -> DataFrame:
    """Parquet with NULL for NaN.

    The NaN test keeps filters on floating columns from the scan. Where a table is known to mark
    missing values with NULL only, ``has_nan=False`` leaves it out and the filters are pushed down.

    A row group is never split, so a small file may arrive as one task. ``min_partitions``
    deals the rows out by their first column in that case, for work that costs much more than
    moving them; a table that has enough splits is left alone.
    """
    df = spark.read.parquet(path)
    if min_partitions is not None and df.rdd.getNumPartitions() < min_partitions:
        df = df.repartition(min_partitions, col(df.columns[0]))
    return normalise_missing(df) if has_nan else df


def check_select(query: str) -> str:
    """The query without its closing semicolon; only one SELECT or WITH statement passes."""
    text = query.strip().rstrip(";").strip()
    if not re.match(r"(?is)^(select|with)\b", text):
        raise ValueError("only a SELECT or WITH query can be read")
    if ";" in text:
        raise ValueError("only one statement can be read")
    return text


def read_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    *,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """Push one SELECT to a database; a partition column spreads the read over tasks."""
    text = check_select(query)
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column is None:
        reader = reader.option("query", text)
    else:
        # "query" cannot be combined with partitioning, a sub-select can.
        reader = (
            reader.option("dbtable", f"({text}) src")
            .option("partitionColumn", partition_column)
            .option("lowerBound", lower)
            .option("upperBound", upper)
            .option("numPartitions", partitions)
        )
    df = normalise_missing(reader.load())
    if df.isEmpty():
        raise ValueError("the query returned no rows")
    return df


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", sep: str = ","
) -> None:
    """Write one file per partition; CSV gets a header, and read_csv reads back what was written."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"cannot write {fmt}")
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
        writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        writer.parquet(path)


def check_limits(
    df: DataFrame, max_rows: int | None = None, max_columns: int | None = None, refuse: bool = True
) -> DataFrame:
    """Refuse a table above the given limits, or with ``refuse=False`` warn of it and give the whole table. Off by
    default; MAX_ROWS and MAX_COLUMNS are the limits of a one-machine deployment."""
    found = []
    if max_columns is not None and len(df.columns) > max_columns:
        found.append(f"{len(df.columns)} columns, at most {max_columns} are allowed")
    if max_rows is not None and not (found and refuse):
        n = df.count()
        if n > max_rows:
            found.append(f"{n} rows, at most {max_rows} are allowed")
    if found and refuse:
        raise ValueError(found[0])
    for text in found:
        warnings.warn(text, stacklevel=2)
    return df


def preview(df: DataFrame, key: list[str], n: int = 10) -> DataFrame:
    """First n rows in key order (top-k per task, no full sort)."""
    return df.orderBy(*[col(k) for k in key]).limit(n)
