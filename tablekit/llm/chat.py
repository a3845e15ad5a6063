"""Chats as training windows under a token budget, in DataFrame functions only.

Prefix sums of turn tokens place every turn: a window takes the turns that begin within one span of
tokens, and a turn longer than the span has a window to itself. With the span at half of what system
turn and history leave, no window of ordinary turns exceeds the budget, and no turn needs to know
where earlier windows ended, so nothing is sequential. Each window repeats the system turn and the
last turns before it, as far as they fit in the history allowance. Every assistant turn is a target
once, where it is new; repeats are masked.

Prefix sums have two levels (blocks of turn numbers, then turns within a block), so a conversation
with a large share of all rows is summed by many tasks. Ordering windows for the history is one
streamed, spillable sort by conversation of rows that are each a window.

Null role and text are empty; a null conversation is a conversation; a null turn comes first. Turns
with the same number are ordered by role, then text. Repeated rows are turns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn ", "</turn>\n"
#: Every escape is a backslash and a letter of its own, so they can be undone one after the other.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
BLOCK = 1024


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def estimated_tokens(text: Column) -> Column:
    """A token per four bytes, rounded up, and four for the marks of the turn."""
    return F.ceil(F.octet_length(text) / F.lit(4)).cast("long") + F.lit(4)


def format_conversations(
    turns: DataFrame, budget: int = 2048, history: int = 256, tokens=estimated_tokens
) -> DataFrame:
    """Columns conv_id, turn, role, text give a row per window: conv_id, window (from 0), n_turns,
    n_repeated (leading turns that are repeats), n_tokens, formatted, and loss: start (from 0) and
    length, in characters of ``formatted``, of each target's escaped text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), tokens(text).alias("tok"))
    t = t.withColumn("block", F.floor(F.col("turn") / BLOCK))
    system = F.when(F.col("role") == "system", F.struct("turn", "text", "tok"))
    conv = Window.partitionBy("conv_id")
    through = conv.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = (
        t.groupBy("conv_id", "block")
        .agg(F.sum("tok").alias("total"), F.min(system).alias("sys"))
        .select(
            F.col("conv_id").alias("_conv"),
            F.col("block").alias("_block"),
            (F.sum("total").over(through) - F.col("total")).alias("base"),
            F.min("sys").over(conv).alias("sys"),
        )
    )
    own = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    run = F.sum("tok").over(own.rowsBetween(Window.unboundedPreceding, 0))
    span = F.greatest(
        F.lit(1), F.floor((F.lit(budget - history) - F.coalesce(F.col("sys.tok"), F.lit(0))) / 2)
    )
    placed = (
        t.withColumn("run", run)
        .join(blocks, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("block").eqNullSafe(F.col("_block")))
        .withColumn("before", F.col("base") + F.col("run") - F.col("tok"))
        .withColumn("span", span)
        .withColumn("key", F.floor(F.col("before") / F.col("span")) * 2 + (F.col("tok") > F.col("span")).cast("int"))
        .withColumn(
            "is_sys",
            (F.col("role") == "system")
            & F.col("turn").eqNullSafe(F.col("sys.turn"))
            & (F.col("text") == F.col("sys.text")),
        )
    )
    entry = F.struct("before", "turn", "role", "text", "tok", "is_sys")
    by_window = placed.groupBy("conv_id", "key").agg(
        F.sort_array(F.collect_list(entry)).alias("new"),
        F.max(F.col("before") + F.col("tok")).alias("until"),
        F.first("sys").alias("sys"),
    )
    order = conv.orderBy("key")
    tail = F.filter("new", lambda x: (F.col("until") - x["before"] <= history) & ~x["is_sys"])
    windows = by_window.withColumn("tail", tail).select(
        "conv_id",
        (F.row_number().over(order) - 1).alias("window"),
        "new",
        "sys",
        F.coalesce(F.lag("tail").over(order), F.slice("new", 1, 0)).alias("hist"),
    )
    sys_again = (
        F.col("sys").isNotNull()
        & ~F.exists("new", lambda x: x["is_sys"])
        & (F.coalesce(F.col("sys.turn"), F.lit(-(2**62))) <= F.coalesce(F.col("new")[0]["turn"], F.lit(-(2**62))))
    )

    def shown(role: Column, text: Column, tok: Column, target: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape(role), F.lit(">"))
        return F.struct(head.alias("head"), escape(text).alias("body"), tok.alias("tok"), target.alias("target"))

    sys_part = F.when(
        sys_again,
        F.array(shown(F.lit("system"), F.col("sys.text"), F.col("sys.tok"), F.lit(False))),
    ).otherwise(F.array())
    old = F.transform("hist", lambda x: shown(x["role"], x["text"], x["tok"], F.lit(False)))
    new = F.transform("new", lambda x: shown(x["role"], x["text"], x["tok"], x["role"] == "assistant"))
    parts = windows.select(
        "conv_id",
        "window",
        F.size("new").alias("n_new"),
        F.concat(sys_part, old, new).alias("parts"),
    )
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("pos"), F.expr("array()").cast("array<struct<start:int,length:int>>").alias("loss")),
        lambda acc, x: F.struct(
            (acc["pos"] + F.length(x["head"]) + F.length(x["body"]) + len(CLOSE)).alias("pos"),
            F.when(
                x["target"],
                F.concat(
                    acc["loss"],
                    F.array(
                        F.struct(
                            (acc["pos"] + F.length(x["head"])).alias("start"),
                            F.length(x["body"]).alias("length"),
                        )
                    ),
                ),
            )
            .otherwise(acc["loss"])
            .alias("loss"),
        ),
        lambda acc: acc["loss"],
    )
    return parts.select(
        "conv_id",
        "window",
        F.size("parts").alias("n_turns"),
        (F.size("parts") - F.col("n_new")).alias("n_repeated"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["tok"]).alias("n_tokens"),
        F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("formatted"),
        spans.alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """The new turns of each window, parsed from ``formatted``: conv_id, window, n_new, turns (role,
    newline, text, newline for each) and loss_text (all text under the mask, unescaped)."""
    texts = F.split("formatted", CLOSE, -1)
    new = F.slice(texts, F.col("n_repeated") + 1, F.size(texts) - 1 - F.col("n_repeated"))

    def turn(p: Column) -> Column:
        at = F.locate(">", p)
        return F.concat(
            unescape(F.substring(p, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)),
            F.lit("\n"),
            unescape(F.substring(p, at + 1, F.length(p))),
            F.lit("\n"),
        )

    loss = F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"])))
    return windows.select(
        "conv_id",
        "window",
        F.size(new).alias("n_new"),
        F.array_join(F.transform(new, turn), "").alias("turns"),
        F.array_join(loss, "").alias("loss_text"),
        F.length("formatted").alias("chars"),
    )


def digest(windows: DataFrame) -> DataFrame:
    """A row per conversation with SHA-256 over all its turns and over all its masked text. The
    digest of a conversation is one value, so its parts meet in one row."""
    parts = read_back(windows)
    ordered = F.sort_array(F.collect_list(F.struct("window", "turns", "loss_text")))
    return (
        parts.groupBy("conv_id")
        .agg(
            F.sum("n_new").cast("long").alias("n_turns"),
            F.sum(F.length("loss_text")).cast("long").alias("loss_chars"),
            F.sum("chars").cast("long").alias("formatted_chars"),
            ordered.alias("w"),
        )
        .select(
            "conv_id",
            "n_turns",
            F.sha2(F.array_join("w.turns", ""), 256).alias("turns_sha256"),
            "loss_chars",
            F.sha2(F.array_join("w.loss_text", ""), 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
