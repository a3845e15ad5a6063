"""Exact k nearest binary codes by multi-index hashing with growing segment radii.

A 64-bit code is cut into segments, each with a table of its own. If two codes differ in at most
``m * (r + 1) - 1`` bits, one of the m segments differs in at most r. So each round probes the
segment values at the next radius, verifies the whole distance of what it finds, and a query is
finished once its k-th verified distance is within what the rounds so far cover; only the others go
on. The last radius is the segment's width, where every code has been seen.

Scale: equal codes are one index entry with its k smallest ids (more can't be among the nearest), and
equal query codes are one query, so a code shared by a third of all rows costs as much as any other.
Segment tables are split by the leading bits of the value, and crowded parts further by a hash of the
code, into parts of at most ``part_rows`` entries; a query visits the parts its radius can reach.
Within a part numpy looks flipped values up in the sorted table; each part returns k rows per query,
never pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekit.llm.base import written

WIDTH = 64


def sign_code(embedding: Column) -> Column:
    """64 bits: whether each component is positive; null ones count as not. More than 64 components raise."""
    code = F.aggregate(
        embedding,
        F.lit(0).cast("long"),
        lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))),
    )
    wide = F.raise_error(F.lit(f"a vector has more than {WIDTH} components")).cast("long")
    return F.when(F.size(embedding) > WIDTH, wide).when(embedding.isNotNull(), code)


def _flips(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with ``radius`` of them set."""
    if radius < 0 or radius > width:
        return np.zeros(0, np.int64)
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)


def _nearest(q: np.ndarray, distance: np.ndarray, k: int, ids: np.ndarray | None = None) -> np.ndarray:
    """Positions, by query and distance, of the k nearest (ties by id), or without ids of those no
    farther than the k-th."""
    order = np.lexsort((distance, q) if ids is None else (ids, distance, q))
    first = np.flatnonzero(np.r_[True, np.diff(q[order]) != 0]) if len(q) else np.zeros(0, int)
    n = np.diff(np.r_[first, len(q)])
    rank = np.arange(len(q)) - np.repeat(first, n)
    if ids is not None:
        return order[rank < k]
    worst = distance[order][first + np.minimum(n, k) - 1]
    return order[distance[order] <= np.repeat(worst, n)]


def _probe(low_bits: int, k: int):
    """Cogroup function: the k nearest entries of one part for each query that reaches it."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        order = np.argsort(left["low"].to_numpy(), kind="stable")
        low, code, ids = (left[c].to_numpy()[order] for c in ("low", "code", "ids"))
        for (lo, hi), group in right.groupby(["from_r", "to_r"]) if len(left) else ():
            q, q_low = group["q"].to_numpy(), group["q_low"].to_numpy()
            flips = np.concatenate([_flips(low_bits, r) for r in range(int(lo), int(hi) + 1)])
            step = max(1, (1 << 20) // max(1, len(flips)))
            for i in range(0, len(q), step):
                want = (q_low[i : i + step, None] ^ flips[None, :]).ravel()
                a, b = np.searchsorted(low, want, "left"), np.searchsorted(low, want, "right")
                hit = np.flatnonzero(b > a)
                n = (b - a)[hit]
                at = np.repeat(a[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                who = q[np.repeat(hit // max(1, len(flips)) + i, n)]
                distance = np.bitwise_count((code[at] ^ who).view(np.uint64)).astype(np.int32)
                # an entry has up to k ids: the nearest entries with all ties hold the nearest ids
                near = _nearest(who, distance, k)
                each = np.fromiter((len(ids[x]) for x in at[near]), int, len(near))
                who, distance = np.repeat(who[near], each), np.repeat(distance[near], each)
                which = np.concatenate([ids[x] for x in at[near]]) if len(near) else np.zeros(0, np.int64)
                near = _nearest(who, distance, k, which)
                found.append((who[near], which[near], distance[near]))
        q, which, distance = (np.concatenate(x) for x in zip(*found))
        near = _nearest(q, distance, k, which)
        return pd.DataFrame({"q": q[near], "id": which[near], "distance": distance[near]})

    return run


def top_k(
    index: DataFrame, queries: DataFrame, k: int = 10, segments: int = 4, lead_bits: int = 3, part_rows: int = 200_000
) -> DataFrame:
    """index: id, code; queries: query_id, code (both long). A row per query and neighbour: query_id,
    rank (from 1), id, distance; ties go to the smaller id, and a row of the index that is also a query
    is its own neighbour. Null codes and ids are no entries and have no neighbours; a query id given
    twice is answered once; fewer than k entries give fewer rows."""
    spark = index.sparkSession
    bits = WIDTH // segments
    low_bits = bits - lead_bits
    ranked = Window.partitionBy("code").orderBy("id")
    entries = written(
        index.select("id", "code")
        .where("id is not null and code is not null")
        .distinct()
        .withColumn("n", F.row_number().over(ranked))
        .where(F.col("n") <= k)
        .groupBy("code")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    asked = written(queries.select("query_id", "code").where("query_id is not null and code is not null").distinct())
    todo = asked.select(F.col("code").alias("q")).distinct()

    def segment(code: str) -> Column:
        return F.expr(f"shiftrightunsigned({code}, s * {bits}) & {(1 << bits) - 1}L")

    every = F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("s")
    table = entries.select("code", "ids", every).withColumn("v", segment("code"))
    table = table.select(
        "s", F.shiftright("v", low_bits).alias("lead"), F.col("v").bitwiseAND((1 << low_bits) - 1).alias("low"), "code", "ids"
    )
    sizes = {(r["s"], r["lead"]): r["n"] for r in table.groupBy("s", "lead").agg(F.count("*").alias("n")).collect()}
    parts = spark.createDataFrame(
        [(s, lead, -(-n // part_rows)) for (s, lead), n in sizes.items()] or [(0, 0, 1)], "s int, lead long, parts long"
    )
    table = table.join(F.broadcast(parts), ["s", "lead"]).withColumn("part", F.pmod(F.xxhash64("code"), "parts"))
    table = written(table.select("s", "lead", "part", "low", "code", "ids"))
    total = entries.select(F.sum(F.size("ids")).alias("n")).first()["n"] or 0
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, id long, distance int")
    best = None
    for radius in range(1, bits + 1):
        # every lead the radius can reach, and what remains of it for the low bits; the first round has radius 0 too
        start = 0 if radius == 1 else radius
        probes = todo.select("q", every).withColumn("v", segment("q"))
        probes = (
            probes.join(F.broadcast(parts), "s")
            .withColumn("left", F.lit(radius) - F.bit_count(F.col("lead").bitwiseXOR(F.shiftright("v", low_bits))))
            .where((F.col("left") >= 0) & (F.col("left") - (radius - start) <= low_bits))
            .select(
                "s",
                "lead",
                F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
                "q",
                F.col("v").bitwiseAND((1 << low_bits) - 1).alias("q_low"),
                F.greatest(F.lit(0), F.col("left") - (radius - start)).alias("from_r"),
                F.least(F.lit(low_bits), F.col("left")).alias("to_r"),
            )
        )
        found = (
            table.groupBy("s", "lead", "part")
            .cogroup(probes.groupBy("s", "lead", "part"))
            .applyInPandas(_probe(low_bits, k), "q long, id long, distance int")
        )
        if best is not None:
            found = found.unionByName(best.select("q", "id", "distance"))
        # two segments can find the same entry
        near = Window.partitionBy("q").orderBy("distance", "id")
        best = written(
            found.groupBy("q", "id").agg(F.min("distance").alias("distance")).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
        )
        done = best.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        covered = segments * (radius + 1) - 1
        finished = done.where(((F.col("n") == k) & (F.col("far") <= covered)) | (F.col("n") == total)).select("q")
        todo = written(todo.join(finished, "q", "left_anti"))
        if todo.isEmpty():
            break
    return asked.join(best, asked["code"] == best["q"]).select("query_id", "rank", "id", "distance")
