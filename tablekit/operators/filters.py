"""Row filters and keyword search."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions.columns import col, folded, is_numeric, require_columns, to_number

_COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_KEEP_FOR_DROP = {"<": operator.ge, "<=": operator.gt, ">": operator.le, ">=": operator.lt}

# Words read as true or false when a boolean column is matched against text (fixed values).
TRUE_WORDS = ("true", "t", "yes", "y", "1", "male", "m")
FALSE_WORDS = ("false", "f", "no", "n", "0", "female")


def filter_expr(df: DataFrame, predicate: str, allow_empty: bool = True) -> DataFrame:
    """Rows for which a Spark SQL predicate holds; optionally refuse an empty result."""
    out = df.filter(F.expr(predicate))
    if not allow_empty and out.isEmpty():
        raise ValueError("no row matches")
    return out


def filter_counts(df: DataFrame, predicate: str) -> DataFrame:
    """Matched and total row counts in one pass, for a preview."""
    return df.agg(
        F.count_if(F.expr(predicate)).alias("matched"), F.count(F.lit(1)).alias("total")
    )


def ne_keep_null(c: Column, value) -> Column:
    """``!=`` that keeps missing rows."""
    return ~c.eqNullSafe(F.lit(value))


def _or_unchanged(df: DataFrame, out: DataFrame, strict: bool) -> DataFrame:
    return df if strict and out.isEmpty() else out


def keep_where_compare(
    df: DataFrame, column: str, op: str, value: float, unchanged_if_empty: bool = False
) -> DataFrame:
    require_columns(df, column)
    out = df.filter(_COMPARE[op](col(column), _literal(df, column, float(value))))
    return _or_unchanged(df, out, unchanged_if_empty)


def drop_where_compare(df: DataFrame, column: str, op: str, value: float) -> DataFrame:
    """Keep the complement; missing rows go too."""
    require_columns(df, column)
    return df.filter(_KEEP_FOR_DROP[op](col(column), _literal(df, column, float(value))))


def _as_number(value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _literal(df: DataFrame, column: str, number: float) -> Column:
    """A literal of the column's kind: a cast on the column would keep the filter from the scan."""
    whole = isinstance(df.schema[column].dataType, T.IntegralType) and number == int(number)
    return F.lit(int(number) if whole else number)


def _equals(df: DataFrame, column: str, value) -> Column:
    number = _as_number(value)
    if is_numeric(df, column) and number is not None:
        return col(column) == _literal(df, column, number)
    return folded(col(column)) == F.lit(str(value).strip().lower())


def keep_where_eq(df: DataFrame, column: str, value, unchanged_if_empty: bool = False) -> DataFrame:
    require_columns(df, column)
    return _or_unchanged(df, df.filter(_equals(df, column, value)), unchanged_if_empty)


def drop_where_eq(df: DataFrame, column: str, value) -> DataFrame:
    """Missing rows stay."""
    require_columns(df, column)
    return df.filter(~F.coalesce(_equals(df, column, value), F.lit(False)))


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, column)
    return df.filter(col(column).isNotNull())


def _condition(df: DataFrame, column: str, op: str, value) -> Column:
    require_columns(df, column)
    c = col(column)
    if op in _COMPARE:
        number = c if is_numeric(df, column) else to_number(c.cast("string"))
        return _COMPARE[op](number, _literal(df, column, float(value)))
    if op == "contains":
        return F.contains(F.lower(c.cast("string")), F.lit(str(value).lower()))
    if op == "==":
        return _equals(df, column, value)
    if op == "!=":
        return ~F.coalesce(_equals(df, column, value), F.lit(False))
    raise ValueError(f"unknown operator {op}")


def filter_conditions(df: DataFrame, conditions: Sequence[tuple[str, str, str, object]]) -> DataFrame:
    """``(and|or, column, op, value)`` conditions folded left to right, without precedence.

    A missing cell meets no condition but ``!=``: unknown is dropped by the filter itself.
    """
    if not conditions:
        return df
    masks = [(logic, _condition(df, c, op, v)) for logic, c, op, v in conditions]
    mask = functools.reduce(
        lambda acc, m: acc | m[1] if m[0] == "or" else acc & m[1], masks[1:], masks[0][1]
    )
    return df.filter(mask)


def normalised(c: Column) -> Column:
    """Lower case, anything but a-z and 0-9 squeezed to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c.cast("string")), "[^a-z0-9]+", " "))


def _normalised_text(value: str) -> str:
    kept = [ch if ch.isascii() and (ch.isdigit() or ch.isalpha()) else " " for ch in value.lower()]
    return " ".join("".join(kept).split())


def match_text(df: DataFrame, conditions: Sequence[tuple[str, str, str]]) -> DataFrame:
    """AND of ``(column, eq|contains|startswith|endswith, value)`` on normalised text."""
    mask = F.lit(True)
    for column, op, value in conditions:
        require_columns(df, column)
        c = col(column)
        kind = df.schema[column].dataType
        number = _as_number(value)
        wanted = F.lit(_normalised_text(value))
        word = value.strip().lower()
        if op == "eq" and isinstance(kind, T.NumericType) and number is not None:
            hit = c == _literal(df, column, number)
        elif op == "eq" and isinstance(kind, T.BooleanType) and word in TRUE_WORDS:
            hit = c
        elif op == "eq" and isinstance(kind, T.BooleanType) and word in FALSE_WORDS:
            hit = ~c
        elif op == "eq":
            hit = normalised(c) == wanted
        elif op == "contains":
            hit = F.contains(normalised(c), wanted)
        elif op == "startswith":
            hit = F.startswith(normalised(c), wanted)
        elif op == "endswith":
            hit = F.endswith(normalised(c), wanted)
        else:
            raise ValueError(f"unknown operator {op}")
        mask = mask & hit
    return df.filter(mask)


def search_scores(df: DataFrame, value: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows that match a keyword phrase, with ``match_score``:
    3 for the phrase in a cell, 2 in the whole row text, 1 for all its words in the row."""
    names = list(cols or df.columns)
    require_columns(df, *names)
    phrase = _normalised_text(value)
    words = [w for w in phrase.split(" ") if len(w) > 1]
    if not words:
        raise ValueError("the search text is too short")
    cells = [F.coalesce(normalised(col(n)), F.lit("")) for n in names]
    wide = df.withColumn("_row", F.concat_ws(" ", *cells))
    in_cell = functools.reduce(operator.or_, [F.contains(c, F.lit(phrase)) for c in cells])
    all_words = functools.reduce(operator.and_, [F.contains(F.col("_row"), F.lit(w)) for w in words])
    in_row = F.contains(F.col("_row"), F.lit(phrase))
    score = F.when(in_cell, 3).otherwise(0) + F.when(in_row, 2).otherwise(0)
    score = score + F.when(all_words, 1).otherwise(0)
    return (
        # the cheap row test goes first: a row that has neither cannot score
        wide.filter(all_words | in_row)
        .withColumn("match_score", score.cast("long"))
        .drop("_row")
    )


def search_rows(
    df: DataFrame, value: str, key: Sequence[str], cols: Sequence[str] | None = None, limit: int = 50
) -> DataFrame:
    """Best ``limit`` matches, highest score first, then key order."""
    return (
        search_scores(df, value, cols)
        .orderBy(F.col("match_score").desc(), *[col(k) for k in key])
        .limit(limit)
    )


