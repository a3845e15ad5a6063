"""Mixing sources to target weights in a tree of levels, in DataFrame functions.

Every leaf can give its tokens times the allowed epochs; an inner node what its children can give. The
budget flows from the root: siblings share what their parent got by weight, none gets more than it can
give, and what one can't take goes to its siblings by weight. Because a node's limit is that of all
below it, a shortage is made up among siblings first and reaches the ancestors' siblings only where a
whole family is short. Shares are found by one sorted pass over the children of each node.

A leaf with more budget than tokens repeats its documents: whole epochs, then a prefix, by running
tokens, of a last epoch in an order seeded for that epoch. The running sum has two levels (hash ranges,
then documents within the range that holds the cut), so a leaf with a third of all rows is cut in
many tasks. Documents are whole: the last one that fits entirely closes the prefix.

Null levels are a value of their own. Rows without tokens (null or empty text) are never chosen.
Repeated rows are documents of their own; ties in the order are broken by doc_id and tokens, and rows
that tie in all of that are taken together or not at all. A node without a weight has weight 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekit.functions.columns import col
from tablekit.llm.base import ROW, unpacked, written

NULL_NAME = "\x00null"


def _name(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NULL_NAME))


def _weights(nodes: DataFrame, level: str, given: dict[str, int]) -> Column:
    if not given:
        return F.lit(1).cast("long")
    table = F.create_map(*(F.lit(x) for kv in given.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.col(level)), F.lit(1)).cast("long")


def leaf_budgets(
    leaves: DataFrame, levels: list[str], budget: int, weights: dict[str, dict[str, int]], epochs: int = 4
) -> DataFrame:
    """leaves: levels and available (tokens). Gives every leaf its ``granted`` tokens. ``weights``: per
    level, whole-number weights of node names. Shares are rounded down."""
    nodes = leaves.withColumn("cap", F.col("available") * epochs)
    caps = {}
    for d in range(1, len(levels) + 1):
        caps[d] = nodes.groupBy(*levels[:d]).agg(F.sum("cap").alias("cap"))
    granted = None
    for d in range(1, len(levels) + 1):
        above, level = levels[: d - 1], levels[d - 1]
        kids = caps[d].withColumn("w", _weights(caps[d], level, weights.get(level, {})))
        kids = kids.withColumn("granted", F.lit(budget).cast("long")) if granted is None else kids.join(granted, above)
        granted = _fill(kids, above, [*above, level])
    return leaves.join(granted, levels)


def _fill(kids: DataFrame, above: list[str], keys: list[str]) -> DataFrame:
    """Water filling: in order of cap per weight, a node is full while its cap is no more than its share
    of what the nodes before it left; the others divide the rest by weight."""
    order = [F.col("cap") / F.col("w"), *(F.col(k) for k in keys)]
    here = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
    before = here.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    k = kids.where("w > 0")
    k = k.withColumns(
        {
            "used": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "passed": F.coalesce(F.sum("w").over(before), F.lit(0)),
            "all_w": F.sum("w").over(here),
        }
    )
    # decimals: the products don't fit a long
    left = (F.col("granted") - F.col("used")).cast("decimal(38,0)")
    full = F.col("cap").cast("decimal(38,0)") * (F.col("all_w") - F.col("passed")).cast("decimal(19,0)") <= left * F.col("w").cast("decimal(19,0)")
    k = k.withColumn("full", full)
    k = k.withColumns(
        {
            "taken": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(here), F.lit(0)),
            "open_w": F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(here), F.lit(0)),
        }
    )
    share = F.floor((F.col("granted") - F.col("taken")).cast("double") * F.col("w") / F.col("open_w")).cast("long")
    return k.select(*keys, F.when(F.col("full"), F.col("cap")).otherwise(share).alias("granted"))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in an epoch: 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), _name(doc_id)).cast("binary"))


def mix_sources(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, dict[str, int]],
    tokens: Column,
    budget: int | None = None,
    share: tuple[int, int] = (1, 2),
    epochs: int = 4,
    seed: int = 11,
    id_col: str = "doc_id",
) -> DataFrame:
    """levels: name and value of each level, the top one first. The chosen rows of ``docs`` with n_tokens and repeats (how often the document is read), in place of
    columns of that name. The
    budget is ``budget`` tokens, or ``share`` (a fraction) of all there are."""
    names = [f"_l{i}" for i in range(len(levels))]
    by_name = {f"_l{i}": weights.get(c, {}) for i, c in enumerate(levels)}
    # a table's own columns travel as one, so their names meet none of these
    tagged = docs.select(
        F.struct(*[col(c) for c in docs.columns]).alias(ROW),
        col(id_col).alias("_id"),
        tokens.cast("long").alias("n_tokens"),
        *(_name(c).alias(n) for c, n in zip(levels.values(), names)),
    ).where("n_tokens > 0")
    leaves = written(tagged.groupBy(*names).agg(F.sum("n_tokens").alias("available")))
    if budget is None:
        everything = leaves.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("t")).first()["t"]
        budget = everything * share[0] // share[1]
    plan = leaf_budgets(leaves, names, budget, by_name, epochs)
    # a row per leaf, written: Spark knows its size and broadcasts it if that is small
    plan = written(
        plan.select(
            *(F.col(n).alias(f"p{n}") for n in names),
            F.floor(F.col("granted") / F.col("available")).cast("long").alias("whole"),
            (F.col("granted") % F.col("available")).alias("part"),
        )
    )
    same = reduce(lambda a, b: a & b, (F.col(n) == F.col(f"p{n}") for n in names))
    x = tagged.join(plan, same)
    x = x.withColumn("_key", order_key(seed, F.col("whole"), F.col("_id")))
    x = x.withColumn("_range", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int"))
    # first level: tokens of hash ranges, second: of the documents of the one range that holds the cut
    ranges = x.groupBy(*names, "_range", "part").agg(F.sum("n_tokens").alias("in_range"))
    upto = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("in_range").over(upto), F.lit(0)))
    cut = written(
        ranges.where("before <= part and before + in_range > part").select(
            *(F.col(n).alias(f"c{n}") for n in names), F.col("_range").alias("cut_range"), "before"
        )
    )
    at_cut = reduce(lambda a, b: a & b, (F.col(n) == F.col(f"c{n}") for n in names))
    x = x.join(cut, at_cut, "left")
    inside = x.where("_range = cut_range")
    run = Window.partitionBy(*names).orderBy("_key", "_id", "n_tokens").rangeBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_run", F.col("before") + F.sum("n_tokens").over(run))
    others = x.where("cut_range is null or _range <> cut_range").withColumn("_run", F.lit(0).cast("long"))
    extra = F.when(F.col("_range") < F.col("cut_range"), 1).when(F.col("_range") > F.col("cut_range"), 0)
    extra = F.coalesce(extra, (F.col("_run") <= F.col("part")).cast("int"))
    out = inside.unionByName(others).withColumn("repeats", F.col("whole") + F.when(F.col("cut_range").isNull(), 0).otherwise(extra))
    own = unpacked([c for c in docs.columns if c not in ("n_tokens", "repeats")])
    return out.where("repeats > 0").select(*own, "n_tokens", F.col("repeats").cast("long").alias("repeats"))
