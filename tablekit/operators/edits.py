"""Column edits: names, formulas, row-wise aggregates, rounding, splitting, conversion."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions.columns import (
    col,
    folded,
    is_numeric,
    numeric_columns,
    require_columns,
    string_columns,
    strip,
    to_number,
)

# Date patterns tried when day-first parsing reads less than half of a column (fixed values).
DATE_FORMATS = (
    "yyyy-MM-dd",
    "dd/MM/yyyy",
    "dd-MM-yyyy",
    "MM/dd/yyyy",
    "dd MMM yyyy",
    "dd MMMM yyyy",
    "yyyy/MM/dd",
    "dd/MM/yy",
    "dd-MM-yy",
)
# Day-first reading of common layouts, first hit wins.
DAY_FIRST = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "d/M/yyyy HH:mm:ss",
    "d/M/yyyy",
    "d-M-yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
)
TRUE_TEXT = ("true", "t", "yes", "y", "1")
FALSE_TEXT = ("false", "f", "no", "n", "0")


def _replace(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """Replace columns in place, in one projection."""
    return df.select(*[(changes[c].alias(c) if c in changes else col(c)) for c in df.columns])


def drop_column(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, column)
    return df.select(*[col(c) for c in df.columns if c != column])


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    require_columns(df, old)
    if new != old and new in df.columns:
        raise ValueError(f"column {new} exists")
    return df.select(*[col(c).alias(new) if c == old else col(c) for c in df.columns])


def standard_names(names: Sequence[str]) -> list[str]:
    """Trimmed, lower case, blanks and dashes as underscores; clashes get a number."""
    out: list[str] = []
    for name in names:
        base = name.strip().lower().replace(" ", "_").replace("-", "_") or name
        fresh, i = base, 2
        while fresh in out:
            fresh, i = f"{base}_{i}", i + 1
        out.append(fresh)
    return out


def standardise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*standard_names(df.columns))


def add_empty_column(df: DataFrame, name: str) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    return df.withColumn(name, F.lit(None).cast("double"))


def divide(a: Column, b: Column) -> Column:
    """True division; NULL for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def floor_divide(a: Column, b: Column) -> Column:
    """Floor division; NULL for a zero divisor."""
    return F.floor(divide(a, b))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; NULL for a zero divisor."""
    return a - b * floor_divide(a, b)


def _finite(c: Column) -> Column:
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def _formula(expr: str | Column) -> Column:
    return F.expr(expr) if isinstance(expr, str) else expr


def derive(df: DataFrame, name: str, expr: str | Column) -> DataFrame:
    """New column from an arithmetic expression (Spark SQL text or Column).

    Missing inputs and undefined results give a missing value. Under ANSI mode write
    division as ``try_divide(a, b)`` in SQL text, or use ``divide``, ``modulo`` and
    ``floor_divide`` on Columns.
    """
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    return df.withColumn(name, _finite(_formula(expr)))


def fill_column(df: DataFrame, name: str, expr: str | Column) -> DataFrame:
    """Overwrite an existing column with a formula."""
    require_columns(df, name)
    return _replace(df, {name: _finite(_formula(expr))})


ROW_OPS = ("sum", "mean", "min", "max", "product", "median", "std")


def row_aggregate(df: DataFrame, name: str, op: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Aggregate across columns of each row, missing cells skipped."""
    if op not in ROW_OPS:
        raise ValueError(f"unknown row operation {op}")
    names = list(cols if cols is not None else numeric_columns(df))
    require_columns(df, *names)
    cells = [col(c).cast("double") for c in names]
    if not cells:
        return df.withColumn(name, F.lit(None).cast("double"))
    n = functools.reduce(operator.add, [c.isNotNull().cast("int") for c in cells])
    total = functools.reduce(operator.add, [F.coalesce(c, F.lit(0.0)) for c in cells])
    if op == "sum":
        out = total
    elif op == "product":
        out = functools.reduce(operator.mul, [F.coalesce(c, F.lit(1.0)) for c in cells])
    elif op == "mean":
        out = F.try_divide(total, n)
    elif op in ("min", "max"):
        pick = F.least if op == "min" else F.greatest
        out = pick(*cells) if len(cells) > 1 else cells[0]
    elif op == "std":
        mean = F.try_divide(total, n)
        dev = [F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in cells]
        out = F.when(n > 1, F.sqrt(functools.reduce(operator.add, dev) / (n - 1)))
    else:
        # sort_array puts NULL last in descending order, so the first n cells are the values
        vals = F.sort_array(F.array(*cells), asc=False)
        mid = F.floor((n + 1) / 2).cast("int")
        mid2 = F.floor((n + 2) / 2).cast("int")
        out = F.when(n > 0, (F.get(vals, mid - 1) + F.get(vals, mid2 - 1)) / 2)
    return df.withColumn(name, out)


def _whole(c: Column) -> Column:
    """A 64-bit whole number, or text of one, with all its digits; else missing."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^[+-]?\d{1,19}$"), text.try_cast("long"))


def round_columns(df: DataFrame, cols: Sequence[str] | None, decimals: int) -> DataFrame:
    """Half-to-even rounding; text is read as numbers first; 0 decimals gives integers."""
    if not 0 <= decimals <= 15:
        raise ValueError("decimals must be between 0 and 15")
    names = list(cols) if cols is not None else numeric_columns(df)
    require_columns(df, *names)
    text = [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]
    if text:
        row = df.agg(*[F.count(to_number(col(c))).alias(c) for c in text]).first()
        names = [c for c in names if c not in text or row[c] > 0]
    changes = {}
    for c in names:
        if isinstance(df.schema[c].dataType, T.IntegralType):
            continue  # whole already, and a double wouldn't hold all its digits
        value = to_number(col(c)) if c in text else col(c)
        # scale, round half to even, scale back: the arithmetic of a float array
        scale = F.lit(float(10**decimals))
        value = F.rint(value.cast("double") * scale) / scale
        changes[c] = F.coalesce(_whole(col(c)), value.cast("long")) if decimals == 0 else value
    return _replace(df, changes)


def split_first_word(df: DataFrame, source: str, first: str, rest: str) -> DataFrame:
    """First word and remainder of a text column; blank cells give two missing values."""
    require_columns(df, source)
    text = strip(col(source).cast("string"))
    pattern = r"(?s)^(\S+)(?:\s+(.*))?$"
    head = F.when(text != "", F.regexp_extract(text, pattern, 1))
    tail = F.when(text != "", F.regexp_extract(text, pattern, 2))
    return df.withColumns({first: head, rest: tail})


def _quoted(text: str) -> str:
    """Regular expression for a literal (works in Java and RE2)."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def replace_value(df: DataFrame, column: str, old, new) -> DataFrame:
    """Replace whole cells equal to ``old``; where none is equal, replace the substring."""
    require_columns(df, column)
    c = col(column)
    if is_numeric(df, column):
        return _replace(df, {column: F.when(c == F.lit(old), F.lit(new)).otherwise(c)})
    whole = folded(c) == F.lit(str(old).strip().lower())
    if df.filter(whole).isEmpty():
        literal = _quoted(str(old))
        safe = str(new).replace("\\", "\\\\").replace("$", "\\$")
        return _replace(df, {column: F.regexp_replace(c, "(?i)" + literal, safe)})
    return _replace(df, {column: F.when(whole, F.lit(str(new))).otherwise(c)})


def remove_text(df: DataFrame, column: str, text: str) -> DataFrame:
    """Delete a literal, ignoring case; a closing dot is optional; white space is squeezed."""
    require_columns(df, column)
    literal = _quoted(text)
    if text.endswith(".") and len(text) > 1:
        literal = _quoted(text[:-1]) + r"\.?"
    cut = F.regexp_replace(col(column).cast("string"), "(?i)" + literal, "")
    return _replace(df, {column: F.trim(F.regexp_replace(cut, r"\s+", " "))})


def _first_format(text: Column, formats: Sequence[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def date_parser(df: DataFrame, column: str) -> Column:
    """Timestamp column chosen from one counting pass: the day-first reading if it covers half
    of the values, else the single format that covers most (the day-first one on a tie)."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return col(column).cast("timestamp")
    text = F.trim(col(column).cast("string"))
    options = [_first_format(text, DAY_FIRST)] + [
        F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS
    ]
    row = df.agg(
        F.count(col(column)).alias("n"), *[F.count(o).alias(f"o{i}") for i, o in enumerate(options)]
    ).first()
    best = 0
    if row["o0"] < row["n"] * 0.5:
        for i in range(1, len(options)):
            if row[f"o{i}"] > row[f"o{best}"]:
                best = i
    return options[best]


def convert_type(df: DataFrame, column: str, to: str) -> DataFrame:
    """Convert a column; cells that cannot be read become missing.

    ``to`` is integer, float, text, category, boolean, datetime, date or time. integer is
    refused when a value has a fraction.
    """
    require_columns(df, column)
    c = col(column)
    number = c.cast("double") if is_numeric(df, column) else to_number(c.cast("string"))
    if to == "integer":
        if not df.filter(_whole(c).isNull() & (number != F.floor(number))).isEmpty():
            raise ValueError(f"{column} holds fractions, it cannot become integer")
        out = F.coalesce(_whole(c), number.try_cast("long"))
    elif to == "float":
        out = number
    elif to in ("text", "category"):
        out = c.cast("string")
    elif to == "boolean":
        word = folded(c)
        out = F.when(word.isin(*TRUE_TEXT), True).when(word.isin(*FALSE_TEXT), False)
    elif to == "datetime":
        out = date_parser(df, column)
    elif to == "date":
        out = date_parser(df, column).cast("date")
    elif to == "time":
        clock = F.try_to_timestamp(
            F.concat(F.lit("2000-01-01 "), F.trim(c.cast("string"))), F.lit("yyyy-MM-dd HH:mm:ss")
        )
        short = F.try_to_timestamp(
            F.concat(F.lit("2000-01-01 "), F.trim(c.cast("string"))), F.lit("yyyy-MM-dd HH:mm")
        )
        out = F.date_format(F.coalesce(date_parser(df, column), clock, short), "HH:mm:ss")
    else:
        raise ValueError(f"unknown type {to}")
    return _replace(df, {column: out})


def introduced_missing(before: DataFrame, after: DataFrame, column: str) -> int:
    """How many cells a conversion turned missing."""
    kept = before.agg(F.count(col(column))).first()[0]
    return kept - after.agg(F.count(col(column))).first()[0]


def decimal_comma(c: Column) -> Column:
    """``1.234,56`` read as 1234.56."""
    plain = F.regexp_replace(c, r"(?<=\d)\.(?=\d{3}(?:[,\s]|$))", "")
    return to_number(F.regexp_replace(plain, ",", "."))


def fix_decimal_comma(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Make text columns with decimal commas numeric when at least 70 % of the values parse."""
    names = [c for c in (cols or df.columns) if c in string_columns(df)]
    if not names:
        return df
    aggs = []
    for i, c in enumerate(names):
        aggs += [
            F.count(col(c)).alias(f"n{i}"),
            F.count(decimal_comma(col(c))).alias(f"ok{i}"),
            F.count_if(col(c).rlike(r"\d,\d")).alias(f"comma{i}"),
        ]
    row = df.agg(*aggs).first()
    changes = {
        c: decimal_comma(col(c))
        for i, c in enumerate(names)
        if row[f"comma{i}"] > 0 and row[f"ok{i}"] >= max(row[f"n{i}"] * 0.7, 1)
    }
    return _replace(df, changes)
