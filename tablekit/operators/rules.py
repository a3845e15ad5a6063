"""Frequent itemsets over categorical columns and association rules."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions.columns import col, label_columns, require_columns
from tablekit.functions.storage import checkpoint


def _item(df: DataFrame, name: str) -> Column:
    """``column=value``; a boolean column is an item only when true."""
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.when(col(name), F.lit(name))
    return F.concat(F.lit(f"{name}="), col(name).cast("string"))


def _frequent_items(items: DataFrame, n: int, min_support: float) -> dict[str, list[str]]:
    """Items in at least ``min_support`` of the rows but not in all, per column: at most
    1 / min_support each."""
    cells = F.array(*[F.struct(F.lit(c).alias("c"), col(c).alias("item")) for c in items.columns])
    rows = (
        items.select(F.inline(cells))
        .filter(F.col("item").isNotNull())
        .groupBy("c", "item")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") >= min_support * n) & (F.col("n") < n))
        .collect()
    )
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["c"], []).append(r["item"])
    return out


def _baskets(items: DataFrame, at: dict[str, dict[str, int]]) -> DataFrame:
    """``basket`` (sorted numbers of its frequent items) and ``w``: equal rows as one, with their number."""
    cells = [
        F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(at[c].items()) for x in pair]), col(c)) for c in items.columns if c in at
    ]
    basket = F.array_sort(F.array_compact(F.array(*cells)))
    rows = items.select(basket.alias("basket")).filter(F.size("basket") > 0)
    return checkpoint(rows.groupBy("basket").agg(F.count(F.lit(1)).alias("w")))


def _supports(candidates: list[tuple[int, ...]], width: int):
    """Rows of all candidates in a task's weighted baskets; candidates that differ in their last item only
    share the test of the others."""
    by_head: dict[tuple[int, ...], list[int]] = {}
    for n, c in enumerate(candidates):
        by_head.setdefault(c[:-1], []).append(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(candidates), np.int64)
        for batch in batches:
            lists = batch.column("basket")
            has = np.zeros((len(lists), width), bool)
            has[pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).to_numpy()] = True
            w = batch.column("w").to_numpy()
            for head, some in by_head.items():
                rows = np.flatnonzero(has[:, head].all(axis=1))
                if len(rows):
                    last = [candidates[n][-1] for n in some]
                    total[some] += w[rows] @ has[np.ix_(rows, last)]
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit])], names=["candidate", "n"])

    return run


def _grown(sets: list[tuple[int, ...]], column: list[int]) -> list[tuple[int, ...]]:
    """Sets of one more item whose subsets are all frequent; items of one column never meet."""
    known = set(sets)
    by_head: dict[tuple[int, ...], list[int]] = {}
    for s in sorted(sets):
        by_head.setdefault(s[:-1], []).append(s[-1])
    out = []
    for head, last in by_head.items():
        for a, b in itertools.combinations(last, 2):
            new = (*head, a, b)
            if column[a] != column[b] and all(new[:i] + new[i + 1 :] in known for i in range(len(new) - 2)):
                out.append(new)
    return out


def frequent_itemsets(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    min_support: float = 0.1,
) -> DataFrame:
    """``items`` (sorted array), ``size``, ``count``, ``support``.

    Rows with equal items become one weighted basket in a single shuffle, combined in the map tasks. Itemsets
    then grow by one item at a time: every task counts the candidates in its baskets by bit columns, and a
    row per candidate and task is added up. Candidates, and the itemsets that make them, are on the driver:
    as many as the result has, times the items at most; they don't grow with the table.
    """
    names = list(cols or label_columns(df))
    require_columns(df, *names)
    if not names:
        raise ValueError("there is no categorical column")
    items = df.select(*[_item(df, c).alias(c) for c in names])
    n = items.count()
    keep = _frequent_items(items, n, min_support)
    shown: list[str] = []
    column: list[int] = []
    at: dict[str, dict[str, int]] = {}
    for i, c in enumerate(x for x in names if x in keep):
        at[c] = {}
        for item in sorted(keep[c]):
            at[c][item] = len(shown)
            shown.append(item)
            column.append(i)
    found: list[tuple[tuple[int, ...], int]] = []
    if shown:
        baskets = _baskets(items, at)
        now = [(i,) for i in range(len(shown))]
        while now:
            counted = baskets.mapInArrow(_supports(now, len(shown)), "candidate int, n long").groupBy("candidate").agg(F.sum("n").alias("n"))
            often = [(now[r["candidate"]], r["n"]) for r in counted.filter(F.col("n") >= min_support * n).collect()]
            found += often
            now = _grown([s for s, _ in often], column)
    sets = [sorted(shown[i] for i in s) for s, _ in found]
    table = pa.table({"items": pa.array(sets, pa.list_(pa.string())), "count": pa.array([k for _, k in found], pa.int64())})
    return (
        df.sparkSession.createDataFrame(table)
        .withColumn("size", F.size("items").cast("long"))
        .withColumn("support", F.col("count") / F.lit(float(max(n, 1))))
    )


def association_rules(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    min_support: float = 0.1,
    min_confidence: float = 0.5,
    top: int = 50,
) -> DataFrame:
    """Every split of every frequent itemset with its support, confidence and lift, best
    lift first."""
    sets = frequent_itemsets(df, cols, min_support)
    whole = sets.filter(F.col("size") >= 2).select("items", "support")
    split = whole.withColumn(
        "mask", F.explode(F.sequence(F.lit(1), (F.pow(F.lit(2), F.size("items")) - 2).cast("int")))
    )

    def side(bit: int) -> Column:
        return F.filter(
            "items",
            lambda v, i: F.pmod(F.floor(F.col("mask") / F.pow(F.lit(2), i)), F.lit(2)) == bit,
        )

    split = split.select("support", side(1).alias("antecedent"), side(0).alias("consequent"))
    left = sets.select(F.col("items").alias("antecedent"), F.col("support").alias("sa"))
    right = sets.select(F.col("items").alias("consequent"), F.col("support").alias("sc"))
    return (
        split.join(left, "antecedent")
        .join(right, "consequent")
        .withColumn("confidence", F.col("support") / F.col("sa"))
        .filter(F.col("confidence") >= min_confidence)
        .withColumn("lift", F.col("confidence") / F.col("sc"))
        .select("antecedent", "consequent", "support", "confidence", "lift")
        .orderBy(F.round("lift", 9).desc(), "antecedent", "consequent")
        .limit(top)
    )
