"""The nine-step cleaning job and its recommendations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekit.functions.columns import (
    col,
    is_numeric,
    label_columns,
    numeric_columns,
    quoted,
    small_table,
    string_columns,
    strip,
    to_number,
)
from tablekit.functions.frequency import frequency_summary
from tablekit.functions.storage import checkpoint
from tablekit.operators.clean import (
    _filled,
    clip_columns,
    duplicate_count,
    fill_values,
    iqr_bounds,
)
from tablekit.operators.edits import standard_names

DEFAULTS = {
    "fix_column_names": True,
    "strip_whitespace": True,
    "fix_mixed_types": True,
    "drop_constant_cols": True,
    "drop_high_missing_cols": True,
    "drop_duplicates": True,
    "fill_missing_numeric": "median",
    "fill_missing_categorical": "mode",
    "remove_outliers": True,
}


def clean(df: DataFrame, options: Mapping[str, object] | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean table, log): names, white space, numeric text, constant columns, mostly missing
    columns, duplicates, numeric fill, categorical fill, clip at 3 IQR - in this order.

    Every decision is one fused aggregate over all columns. The table is written once, after
    the duplicates are gone, so the passes behind it do not repeat that shuffle.
    """
    opt = {**DEFAULTS, **(options or {})}
    log: list[tuple[str, int, str]] = []
    out = df

    def note(step: str, n: int, what: str = "") -> None:
        if n:
            log.append((step, n, what))

    if opt["fix_column_names"]:
        names = standard_names(out.columns)
        note("column_names", sum(a != b for a, b in zip(names, out.columns)))
        out = out.toDF(*names)
    # pass 1: padded cells, and numbers among the stripped texts
    texts = string_columns(out)
    tidy = {c: strip(col(c)) if opt["strip_whitespace"] else col(c) for c in texts}
    if texts and (opt["strip_whitespace"] or opt["fix_mixed_types"]):
        aggs = []
        for i, c in enumerate(texts):
            aggs += [
                F.count_if(tidy[c] != col(c)).alias(f"w{i}"),
                F.count(col(c)).alias(f"n{i}"),
                F.count(to_number(tidy[c])).alias(f"x{i}"),
            ]
        row = out.agg(*aggs).first()
        note("whitespace", sum(row[f"w{i}"] > 0 for i in range(len(texts))))
        if opt["fix_mixed_types"]:
            hit = [c for i, c in enumerate(texts) if row[f"n{i}"] and row[f"x{i}"] / row[f"n{i}"] >= 0.9]
            note("numeric_text", len(hit), ", ".join(hit))
            tidy.update({c: to_number(tidy[c]) for c in hit})
        out = out.select(*[tidy[c].alias(c) if c in tidy else col(c) for c in out.columns])
    # pass 2: rows, filled cells, and columns that hold one value
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(out.columns):
        aggs += [F.count(col(c)).alias(f"c{i}"), F.min(col(c)).eqNullSafe(F.max(col(c))).alias(f"k{i}")]
    row = out.agg(*aggs).first()
    n = row["n"]
    names = list(enumerate(out.columns))
    gone: list[str] = []
    if opt["drop_constant_cols"]:
        gone = [c for i, c in names if row[f"k{i}"]]
        note("constant_columns", len(gone), ", ".join(gone))
    if opt["drop_high_missing_cols"]:
        high = [c for i, c in names if c not in gone and n and (n - row[f"c{i}"]) / n > 0.5]
        note("high_missing_columns", len(high), ", ".join(high))
        gone = gone + high
    out = out.select(*[col(c) for _, c in names if c not in gone])
    num, cat = str(opt["fill_missing_numeric"] or "none"), str(opt["fill_missing_categorical"] or "none")
    gaps = {c: n - row[f"c{i}"] for i, c in names if c not in gone and row[f"c{i}"] < n}
    if opt["drop_duplicates"]:
        out = checkpoint(out.dropDuplicates())
        # pass 3: rows and gaps that are left
        row = out.selectExpr("count(1)", *[f"count({quoted(c)})" for c in out.columns]).first()
        note("duplicates", n - row[0])
        gaps = {c: row[0] - row[i + 1] for i, c in enumerate(out.columns) if row[i + 1] < row[0]}
    if gaps and (num != "none" or cat != "none"):
        found = fill_values(out, num, cat, list(gaps))
        note("filled_numeric", sum(gaps[c] for c in gaps if is_numeric(out, c) and c in found), num)
        note("filled_categorical", sum(gaps[c] for c in gaps if not is_numeric(out, c) and c in found), cat)
        out = _filled(out, {c: v for c, v in found.items() if c in gaps})
    if opt["remove_outliers"]:
        nums = numeric_columns(out)
        bounds = iqr_bounds(out, nums, 3.0) if nums else {}
        if bounds:
            row = out.agg(
                *[F.count_if((col(c) < lo) | (col(c) > hi)).alias(c) for c, (lo, hi) in bounds.items()]
            ).first()
            note("clipped", sum(row[c] for c in bounds))
            out = clip_columns(out, bounds)
    return out, small_table(df.sparkSession, log, "step string, changes long, detail string")


def recommend_cleaning(df: DataFrame) -> DataFrame:
    """Issues found, with the affected columns: one wide aggregate, the value-frequency table
    and the duplicate count."""
    texts, nums = string_columns(df), numeric_columns(df)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count(col(c)).alias(f"c{i}"))
        if c in texts:
            aggs.append(F.count_if(strip(col(c)) != col(c)).alias(f"w{i}"))
            aggs.append(F.count(to_number(col(c))).alias(f"x{i}"))
    row = df.agg(*aggs).first()
    n = row["n"]
    count = {c: row[f"c{i}"] for i, c in enumerate(df.columns)}
    at = {c: i for i, c in enumerate(df.columns)}
    summary = frequency_summary(df, df.columns)
    dup = duplicate_count(df).first()["duplicate_rows"]

    def repeated(c: str) -> bool:
        return summary.get(c, {}).get("repeated", 0) > 0 or n - count[c] > 1

    issues: list[tuple[str, int, str]] = []

    def issue(key: str, found: int, names: list[str]) -> None:
        if found:
            issues.append((key, found, ", ".join(names)))

    same = [c for c in df.columns if repeated(c)]
    issue("duplicates", dup or len(same), same)
    flat = [c for c in df.columns if summary.get(c, {}).get("unique", 0) <= 1]
    issue("constant_columns", len(flat), flat)
    high = [c for c in df.columns if n and (n - count[c]) / n > 0.5]
    issue("high_missing_columns", len(high), high)
    issue("missing_numeric", sum(n - count[c] for c in nums), [])
    issue("missing_categorical", sum(n - count[c] for c in label_columns(df)), [])
    blanks = [c for c in texts if row[f"w{at[c]}"]]
    issue("whitespace", len(blanks), blanks)
    mixed = [c for c in texts if count[c] and row[f"x{at[c]}"] / count[c] >= 0.9]
    issue("mixed_types", len(mixed), mixed)
    odd = [c for c in df.columns if c.strip().lower().replace(" ", "_").replace("-", "_") != c]
    issue("column_names", len(odd), odd)
    return small_table(df.sparkSession, issues, "issue string, found long, columns string")


def recommended_options(issues: DataFrame) -> dict[str, object]:
    """Options for ``clean`` from the issue table."""
    keys = {r["issue"] for r in issues.collect()}  # at most eight rows
    return {
        "drop_duplicates": "duplicates" in keys,
        "fill_missing_numeric": "median" if "missing_numeric" in keys else "none",
        "fill_missing_categorical": "mode" if "missing_categorical" in keys else "none",
        "drop_high_missing_cols": "high_missing_columns" in keys,
        "strip_whitespace": "whitespace" in keys,
        "drop_constant_cols": "constant_columns" in keys,
        "fix_mixed_types": "mixed_types" in keys,
        "fix_column_names": "column_names" in keys,
        "remove_outliers": True,
    }
