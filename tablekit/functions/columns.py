"""Column roles, ANSI-safe casts and key-derived uniforms."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text accepted as a number. Guards try_cast, which alone would take '12d'.
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# White space of any script, for use inside a character class (Java and RE2).
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"

TWO_32 = 4294967296


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def label_columns(df: DataFrame) -> list[str]:
    """Text and boolean columns."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.StringType, T.BooleanType))
    ]


def quoted(name: str) -> str:
    """A column name for SQL text. Wide tables are handled by SQL text: a thousand columns built
    call by call take longer to plan than to run."""
    return "`" + name.replace("`", "``") + "`"


def number_text(value: float) -> str:
    """A double literal for SQL text."""
    return f"({float(value)!r}D)"


def col(name: str) -> Column:
    """Column by its exact name, dots and spaces included."""
    return F.col(quoted(name))


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def require_columns(df: DataFrame, *names: str) -> None:
    gone = [n for n in names if n not in df.columns]
    if gone:
        raise ValueError(f"no such column: {', '.join(gone)}")


def to_number(c: Column) -> Column:
    """Text to double; NULL unless the whole cell is a number."""
    return F.when(c.rlike(NUMERIC_TEXT), F.trim(c).try_cast("double"))


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def folded(c: Column) -> Column:
    """Trimmed lower-case text form, for case-insensitive equality."""
    return F.lower(F.trim(c.cast("string")))


def row_hash(keys: Sequence[str], *salt: object) -> Column:
    """md5 over the key columns and the salt: the same on every run and layout."""
    parts = [col(k).cast("string") for k in keys]
    parts += [s if isinstance(s, Column) else F.lit(str(s)) for s in salt]
    return F.md5(F.concat_ws(":", *parts))


def hash32(h: Column, start: int = 1) -> Column:
    """Eight hex digits of a hash as a long in [0, 2^32)."""
    return F.conv(F.substring(h, start, 8), 16, 10).cast("long")


def uniform(h: Column, start: int = 1) -> Column:
    """Uniform in [0, 1) from a hash."""
    return hash32(h, start) / F.lit(float(TWO_32))


_ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of already reduced statistics (a row per column, bin or class)."""
    fields = [part.split() for part in schema.split(",")]
    data = {
        name: pa.array([None if r[i] is None else r[i] for r in rows], type=_ARROW[kind])
        for i, (name, kind) in enumerate(fields)
    }
    return spark.createDataFrame(pa.table(data))


def chunks(items: Sequence, size: int) -> Iterable[Sequence]:
    for i in range(0, len(items), size):
        yield items[i : i + size]
