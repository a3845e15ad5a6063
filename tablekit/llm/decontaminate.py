"""Benchmark decontamination: windows of benchmark words, looked up in whole training texts.

The benchmark's windows become a sorted table of 64-bit window hashes with their words. Tasks hash
every window of a text by prefix sums, look all of them up at once, compare the words of each hit, and
mark the words it covers.

The table is broadcast, so its size is checked: windows are dealt by hash into as many tables of at
most ``table_windows`` as it takes, each scanned in a pass of its own, and the passes of a document are
added up. One pass is all that half a million windows need.

Null and empty texts have no words; an item without words has no window; items with a null id mark
words but aren't listed. Repeated documents are judged alike, repeated items once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.functions.columns import col
from tablekit.llm.base import extended, mapped, model
from tablekit.llm.words import run_hashes, word_slices

PREFIX = "_hit_"
FOUND = f"{PREFIX}words long, {PREFIX}start array<int>, {PREFIX}end array<int>, {PREFIX}cut array<struct<start:int,end:int>>, {PREFIX}items array<string>"


def _item_windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = batch.column("item_id"), []
        for w in word_slices(batch.column("text")):
            for i in range(w.hi - w.lo):
                a, b = int(w.first[i]), int(w.first[i + 1])
                size = min(width, b - a)
                for j in range(a, b - size + 1 if size else a):
                    out.append((ids[w.lo + i].as_py(), size, w.text(j, j + size)))
        if out:
            a, b, c = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.string()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], names=["item_id", "size", "words"]
            )


def benchmark_windows(items: DataFrame, width: int = 13) -> DataFrame:
    """A row per distinct window: words (binary, one blank between), size, and the items that have it, by
    ids of the type they come in."""
    kind = items.schema["item_id"].dataType
    named = items.select(F.col("item_id").cast("string"), "text")
    rows = mapped(named, lambda b: _item_windows(b, width), "item_id string, size int, words binary")
    return rows.groupBy("words", "size").agg(F.sort_array(F.collect_set(F.col("item_id").cast(kind))).alias("items"))


def _window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    at = np.arange(len(hashes) - size + 1)
    return run_hashes(hashes, at, at + size)


class _Table:
    """The windows of one pass: per size the sorted hashes, with words and items alongside."""

    def __init__(self, rows: list) -> None:
        self.sizes: dict[int, tuple[np.ndarray, list, list]] = {}
        by_size: dict[int, list] = {}
        for r in rows:
            by_size.setdefault(r["size"], []).append((bytes(r["words"]), list(r["items"])))
        for size, some in by_size.items():
            texts = pa.array([t for t, _ in some], pa.binary())
            # each row is one window of ``size`` words
            hashes = np.concatenate([_window_hashes(w.hashes(), size)[::size] for w in word_slices(texts)])
            order = np.argsort(hashes, kind="stable")
            self.sizes[size] = (hashes[order], [some[i][0] for i in order], [some[i][1] for i in order])

    def scan(self, w) -> tuple[np.ndarray, dict[int, set]]:
        """Marked words of a slice, and the items found in each of its rows."""
        hashes, n = w.hashes(), len(w.start)
        edge = np.zeros(n + 1, np.int32)
        items: dict[int, set] = {}
        row = w.rows()
        for size, (keys, texts, owners) in self.sizes.items():
            if n < size:
                continue
            found = _window_hashes(hashes, size)
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            for j in np.flatnonzero((keys[at] == found) & (row[: n - size + 1] == row[size - 1 :])):
                text, k = w.text(j, j + size), at[j]
                while k < len(keys) and keys[k] == found[j]:  # equal hashes are told apart by the words
                    if texts[k] == text:
                        edge[j] += 1
                        edge[j + size] -= 1
                        items.setdefault(int(row[j]), set()).update(owners[k])
                    k += 1
        return np.cumsum(edge[:-1]) > 0, items


def _runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.r_[0, marked.astype(np.int8), 0])
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _pass(docs: DataFrame, rows: list, text: str) -> DataFrame:
    shared = model(docs.sparkSession, rows)
    names = [f.name for f in docs.schema.fields]
    schema = extended(docs.schema.fields, FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table(shared.value)
        for batch in batches:
            counts, starts, ends, cuts, items = [], [], [], [], []
            for w in word_slices(batch.column(text)):
                marked, found = table.scan(w)
                counts.extend(w.counts.tolist())
                for i in range(w.hi - w.lo):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    if i in found:
                        s, e = _runs(marked[a:b])
                        base = w.bounds[i]
                        cuts.append([{"start": int(w.start[a + x] - base), "end": int(w.end[a + y - 1] - base)} for x, y in zip(s, e)])
                        starts.append(s.tolist())
                        ends.append(e.tolist())
                        items.append([str(x) for x in found[i] if x is not None])
                    else:
                        for x in (starts, ends, cuts, items):
                            x.append([])
            span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            made = [
                pa.array(counts, pa.int64()),
                pa.array(starts, pa.list_(pa.int32())),
                pa.array(ends, pa.list_(pa.int32())),
                pa.array(cuts, pa.list_(span)),
                pa.array(items, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *made], names=[*names, *(f"{PREFIX}{x}" for x in ("words", "start", "end", "cut", "items"))]
            )

    return mapped(docs, run, schema)


def scan(docs: DataFrame, windows: DataFrame, text: str = "text", table_windows: int = 500_000) -> DataFrame:
    """The rows of ``docs`` with n_words, n_hit, items (sorted ids whose windows occur), and spans: start
    and end of each marked run, in bytes of the text's UTF-8. Columns of these names are replaced."""
    kind = windows.schema["items"].dataType.elementType
    clash = {"n_words", "n_hit", "items", "spans", "contaminated"} & set(docs.columns)
    docs = docs.drop(*clash)
    n = windows.count()
    passes = max(1, -(-n // table_windows))
    if passes == 1:
        found = _pass(docs, windows.select("words", "size", "items").collect(), text)
    else:
        # each pass finds its share of the windows; marks and items of a row are merged through one array each
        found = docs
        gathered = None
        for p in range(passes):
            part = windows.where(F.pmod(F.xxhash64("words"), F.lit(passes)) == p).select("words", "size", "items").collect()
            found = _pass(found, part, text)
            now = {c: F.col(PREFIX + c) for c in ("start", "end", "cut", "items")}
            if gathered is not None:
                now = {c: F.concat(F.col(f"_all_{c}"), v) for c, v in now.items()}
            keep = [col(c) for c in docs.columns]
            found = found.select(*keep, F.col(PREFIX + "words").alias("_all_words"), *(v.alias(f"_all_{c}") for c, v in now.items()))
            gathered = found
        found = found.select(
            *(col(c) for c in docs.columns),
            F.col("_all_words").alias(PREFIX + "words"),
            *(F.col(f"_all_{c}").alias(PREFIX + c) for c in ("start", "end", "cut", "items")),
        )
    words = F.arrays_zip(F.col(PREFIX + "start").alias("start"), F.col(PREFIX + "end").alias("end"))
    merged = _merge(words) if passes > 1 else words
    cut = _merge(F.col(PREFIX + "cut")) if passes > 1 else F.col(PREFIX + "cut")
    size = F.aggregate(merged, F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]).cast("long"))
    return found.select(
        *(col(c) for c in docs.columns),
        F.col(PREFIX + "words").alias("n_words"),
        size.alias("n_hit"),
        F.array_sort(F.array_distinct(F.transform(PREFIX + "items", lambda x: x.cast(kind)))).alias("items"),
        cut.alias("spans"),
    )


def _merge(spans: Column) -> Column:
    """Overlapping spans as one."""
    empty = F.slice(spans, 1, 0)

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        kept = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((F.size(acc) > 0) & (x["start"] <= last["end"]), F.concat(kept, F.array(joined))).otherwise(
            F.concat(acc, F.array(x))
        )

    return F.aggregate(F.array_sort(spans), empty, add)


def contaminated(n_words: Column, n_hit: Column, one_in: int = 20) -> Column:
    """Whether marked words are at least one in ``one_in``."""
    return (n_hit > 0) & (one_in * n_hit >= n_words)


def remove(found: DataFrame, text: str = "text", spans_only: bool = False) -> DataFrame:
    """Rows of ``scan`` without contaminated documents, or with all documents and the marked spans
    cut out of them."""
    if not spans_only:
        return found.where(~contaminated(F.col("n_words"), F.col("n_hit")))
    raw = col(text).cast("binary")
    ends = F.concat(F.array(F.lit(0)), F.col("spans.end"))
    starts = F.concat(F.col("spans.start"), F.array(F.octet_length(raw)))
    pieces = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda p: F.substring(raw, p["a"] + 1, p["b"] - p["a"]).cast("string"))
    return found.withColumn(text, F.when(F.size("spans") > 0, F.array_join(pieces, "")).otherwise(col(text)))
