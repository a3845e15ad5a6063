"""Repeated substrings: bytes covered by a string of ``length`` bytes that also starts anywhere else go.

Texts are UTF-8 bytes; strings don't go beyond a text, but the other place may be in the same text and may
overlap. What counts is the input, not what is left of it.

Each string of ``length`` bytes has an anchor: of the runs of ``ANCHOR`` bytes within it that with the smallest
hash, the first of equals. Equal strings have equal anchors at equal places, so they only meet where their
anchors do, and an anchor serves a whole block: the strings one after the other that it is the anchor of, a
few hundred bytes in all. Two thirds of the blocks of a text of prose are found nowhere else and their anchors
neither: one count over digests settles them, and also all blocks that occur twice as a whole, however many
copies there are. The bytes of the others, one of each kind, come together by anchor. Suffixes to the right of
the anchor, and to the left, backwards, are put in order by deep-shallow sorting (``suffixes``). Two strings that
reach a bytes to the left are equal where the suffixes share a bytes there and the rest on the right, so
for each a the classes of both orders tell which strings repeat, without any pairs.

An anchor with more than ``most`` kinds of blocks (the edge of a passage that very many texts hold, each among
words of its own) is not sorted in one task. Its blocks are cut into ranges of ``RANGE`` strings; counts over
digests settle ranges that repeat as a whole and those whose common bytes occur once, and a count over
single strings what is left. All of that is combined in the map tasks.

Texts are known by 128 bits of their SHA-256, and blocks by a 128-bit BLAKE2b digest; ids play no part, and rows
with equal texts are treated alike. Null counts as an empty text; texts of fewer than ``length`` bytes stay
whole. Columns of ``docs`` with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.functions.columns import col
from tablekit.llm.base import extended, mapped, written
from tablekit.llm.suffixes import deep_shallow
from tablekit.llm.words import run_hashes

ANCHOR, RANGE = 40, 16
#: bytes of blocks that a task sorts together
TOGETHER = 1 << 20
RESULT = "n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"
ANCHORS = "tk binary, m int, i0 int, i1 int, until int, n int, h long, b binary"
BLOCKS = "tk binary, m int, i0 int, i1 int, n long, kinds long, h long, b binary, data binary"
SPANS = "tk binary, start int, end int"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def text_key(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def anchors(data: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place and hash of the anchor, first and last string) of the blocks of a text."""
    n = len(data)
    at = np.arange(n - width + 1)
    h = run_hashes(data.astype(np.uint64) + np.uint64(1), at, at + width)
    # the hash decides, then the place: the order is the same wherever the same bytes stand
    packed = h >> np.uint64(32) << np.uint64(32) | at.astype(np.uint64)
    w = length - width + 1
    padded = np.full(-(-len(packed) // w) * w, np.uint64(2**64 - 1))
    padded[: len(packed)] = packed
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    strings = n - length + 1
    least = np.minimum(back[:strings], ahead[w - 1 : w - 1 + strings])
    owner = (least & np.uint64(2**32 - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    place = owner[first]
    return place, h[place].view(np.int64), first, np.r_[first[1:], strings] - 1


def _digest(data: bytes, extra: int) -> bytes:
    return blake2b(data, digest_size=16, salt=extra.to_bytes(8, "little")).digest()


def _anchored(length: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.binary(), *[pa.int32()] * 5, pa.int64(), pa.binary()]
        names = [f.split()[0] for f in ANCHORS.split(", ")]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for key, text in zip(batch.column("tk"), batch.column("text")):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if len(raw) < length:
                    continue
                key, last = key.as_py(), None
                for m, h, i0, i1 in zip(*(x.tolist() for x in anchors(np.frombuffer(raw, np.uint8), length, width))):
                    b = _digest(raw[i0 : i1 + length], m - i0)
                    if last == (h, b):  # the same again, right behind: a text that goes round
                        rows[4][-1] = i1
                        rows[5][-1] += 1
                    else:
                        for column, x in zip(rows, (key, m, i0, i1, i1, 1, h, b)):
                            column.append(x)
                    last = (h, b)
                if len(rows[0]) > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)
                    rows = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    return run


def _cut_out(length: int):
    """The bytes of the wanted blocks of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        types = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            for key, text, wanted in zip(batch.column("tk"), batch.column("text"), batch.column("wanted")):
                raw, key = text.as_buffer().to_pybytes(), key.as_py()
                rows = [(key, *(w[x] for x in names[1:-1]), raw[w["i0"] : w["i1"] + length]) for w in wanted.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def repeated_strings(blocks: list[bytes], before: np.ndarray, strings: np.ndarray, length: int) -> np.ndarray:
    """Of blocks with anchors at ``before`` and so many strings: (block, a), whether the string that begins
    a bytes before the anchor is in another block too."""
    n = len(blocks)
    size = np.array([len(b) for b in blocks], np.int64)
    at = np.cumsum(size) - size
    data = np.frombuffer(b"".join(blocks), np.uint8)
    backwards = np.frombuffer(b"".join(b[k - 1 :: -1] if k else b"" for b, k in zip(blocks, before.tolist())), np.uint8)
    ends = np.cumsum(before)
    right, right_same = deep_shallow(data, at + before, at + size)
    left, left_same = deep_shallow(backwards, ends - before, ends)
    right_rank, left_rank = np.empty(n, np.int64), np.empty(n, np.int64)
    right_rank[right] = left_rank[left] = np.arange(n)
    nearest = before - strings + 1  # the last string of a block begins closest to the anchor
    out = np.zeros((n, int(before.max(initial=0)) + 1), bool)
    for a in range(int(nearest.min(initial=0)), out.shape[1]):
        here = np.flatnonzero((nearest <= a) & (a <= before))
        if len(here) < 2:
            continue
        key = np.cumsum(right_same < length - a)[right_rank[here]] * (n + 1) + np.cumsum(left_same < a)[left_rank[here]]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        out[here, a] = count[which] > 1
    return out


def _ranges_of(marked: np.ndarray) -> Iterator[tuple[int, int]]:
    step = np.diff(np.r_[0, marked.astype(np.int8), 0])
    return zip(np.flatnonzero(step == 1).tolist(), (np.flatnonzero(step == -1) - 1).tolist())


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], []]
    types = (pa.binary(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["tk", "start", "end"])


def _sorted_blocks(length: int):
    """Rows sorted by anchor: what repeats of the blocks that occur once, as spans of their texts."""

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, i0, i1, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("m", "i0", "i1", "n"))
        marked = repeated_strings(batch.column("data").to_pylist(), m - i0, i1 - i0 + 1, length)
        rows = []
        for k in np.flatnonzero((n == 1) & marked.any(axis=1)).tolist():
            key = batch.column("tk")[k].as_py()
            rows += [(key, int(m[k]) - b, int(m[k]) - a + length) for a, b in _ranges_of(marked[k])]
        return _spans(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            edges = np.r_[np.flatnonzero(h[1:] != h[:-1]) + 1]
            size = np.cumsum(np.array([len(x.as_buffer()) for x in batch.column("data")], np.int64))
            lo = 0
            if held and held[-1].column("h")[-1].as_py() != h[0]:
                edges = np.r_[0, edges]
            for e in edges.tolist():
                done = (size[e - 1] if e else 0) - (size[lo - 1] if lo else 0) + sum(x.nbytes for x in held)
                if done >= TOGETHER:
                    yield settle(pa.Table.from_batches([*held, batch.slice(lo, e - lo)]).combine_chunks().to_batches()[0])
                    held, lo = [], e
            held.append(batch.slice(lo))
        if held:
            yield settle(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _range_digests(length: int):
    """For each range of strings of a block: digests of the bytes all strings of a full range have in
    common, and of all bytes of those of its strings that the block has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "b", "r", "core", "whole"]
        for batch in batches:
            rows = []
            for h, b, m, i0, i1, data in zip(*(batch.column(c).to_pylist() for c in ("h", "b", "m", "i0", "i1", "data"))):
                most, least = m - i0, m - i1
                for r in range(least // RANGE, most // RANGE + 1):
                    lo, hi = max(least, r * RANGE), min(most, r * RANGE + RANGE - 1)
                    core = data[most - r * RANGE : most - r * RANGE - RANGE + 1 + length]
                    whole = data[most - hi : most - lo + length]
                    rows.append((h, b, r, _digest(core, r), _digest(whole, hi << 16 | lo)))
            types = (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names=names)

    return run


def _string_digests(length: int):
    """Single strings of the ranges that are left of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tk", "n", "h", "i", "string"]
        for batch in batches:
            rows = []
            for tk, n, h, m, i0, i1, data, left in zip(*(batch.column(c).to_pylist() for c in ("tk", "n", "h", "m", "i0", "i1", "data", "left"))):
                for r in left:
                    for a in range(max(m - i1, r * RANGE), min(m - i0, r * RANGE + RANGE - 1) + 1):
                        rows.append((tk, n, h, m - a, _digest(data[m - i0 - a : m - i0 - a + length], a)))
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names=names)

    return run


def _crowded(blocks: DataFrame, length: int) -> DataFrame:
    """Spans of blocks whose anchors have too many kinds of blocks to be sorted in one task."""
    cut = blocks.select("h", "b", "m", "i0", "i1", "data")
    ranges = written(mapped(cut, _range_digests(length), "h long, b binary, r int, core binary, whole binary"))
    wholes = ranges.groupBy("h", "r", "core", "whole").agg(F.count("*").alias("times"), F.min("b").alias("b"))
    wholes = written(wholes)
    again = wholes.where("times > 1").select("h", "r", "whole")
    done = ranges.join(again, ["h", "r", "whole"]).groupBy("h", "b").agg(F.collect_list("r").alias("done"))
    settled = blocks.where("n = 1").join(done, ["h", "b"]).select("tk", "m", "i0", "i1", F.explode("done").alias("r"))
    near = F.greatest(F.col("m") - F.col("i1"), F.col("r") * RANGE)
    far = F.least(F.col("m") - F.col("i0"), F.col("r") * RANGE + RANGE - 1)
    settled = settled.select("tk", (F.col("m") - far).alias("start"), (F.col("m") - near + length).alias("end"))
    # string by string, where ranges with the same core differ: a block of each kind
    differ = wholes.groupBy("h", "r", "core").agg(F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    left = wholes.join(differ, ["h", "r", "core"]).groupBy("h", "b").agg(F.collect_list("r").alias("left"))
    some = blocks.join(left, ["h", "b"]).select("tk", "n", "h", "m", "i0", "i1", "data", "left")
    single = written(mapped(some, _string_digests(length), "tk binary, n long, h long, i int, string binary"))
    twice = single.groupBy("h", "string").agg(F.count("*").alias("times")).where("times > 1").drop("times")
    found = single.where("n = 1").join(twice, ["h", "string"]).select("tk", F.col("i").alias("start"), (F.col("i") + length).alias("end"))
    return settled.unionByName(found)


def _without_spans(names: list[str], text: int):
    """Adds the results: spans merged, and the bytes outside of them."""
    added = [f.split()[0] for f in ("n_bytes", "spans", "kept")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, spans, kept = [], [], []
            for value, found in zip(batch.column(text), batch.column(text + 1).to_pylist()):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                merged: list[list[int]] = []
                for a, b in sorted((x["start"], x["end"]) for x in found or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                borders = [0, *(x for pair in merged for x in pair), len(raw)]
                n_bytes.append(len(raw))
                spans.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join(raw[a:b] for a, b in zip(borders[::2], borders[1::2])) if merged else raw)
            made = [pa.array(n_bytes, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:text], *made], names=[*names, *added])

    return run


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 400, most: int = 2000) -> DataFrame:
    """The columns of ``docs`` with n_bytes, spans (start and end in bytes of each run of bytes that goes) and
    kept (binary: the bytes that stay)."""
    if length < 2:
        raise ValueError("strings have two bytes at least")
    width = min(ANCHOR, length // 2)
    whole = col(text).cast("string")
    keyed = docs.select(text_key(whole).alias("tk"), whole.alias("text")).where(F.octet_length("text") >= length)
    found = written(mapped(keyed, _anchored(length, width), ANCHORS))
    kinds = found.groupBy("h", "b").agg(F.sum("n").alias("n"), F.min(F.struct("tk", "m", "i0", "i1")).alias("one"))
    kinds = written(kinds)
    crowd = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    twice = kinds.where("n > 1").select("h", "b")
    spans = found.join(twice, ["h", "b"]).select("tk", F.col("i0").alias("start"), (F.col("until") + length).alias("end"))
    wanted = kinds.join(crowd, "h").groupBy(F.col("one.tk").alias("tk"))
    wanted = wanted.agg(F.collect_list(F.struct("one.m", "one.i0", "one.i1", "n", "kinds", "h", "b")).alias("wanted"))
    blocks = mapped(keyed.join(wanted, "tk").select("tk", "text", "wanted"), _cut_out(length), BLOCKS)
    blocks = written(blocks.dropDuplicates(["h", "b"]))
    few = blocks.where(F.col("kinds") <= most).repartition("h").sortWithinPartitions("h")
    sorted_ = mapped(few, _sorted_blocks(length), SPANS)
    crowded = _crowded(blocks.where(F.col("kinds") > most), length)
    every = written(spans.unionByName(sorted_).unionByName(crowded).groupBy("tk").agg(F.collect_set(F.struct("start", "end")).alias("found")))
    added = ["n_bytes", "spans", "kept"]
    kept = docs.select(*(col(c) for c in docs.columns if c not in added))
    names = kept.columns
    inner = [F.col(f"_c{i}") for i in range(len(names))]
    rows = docs.select(*(col(c).alias(f"_c{i}") for i, c in enumerate(names)), whole.alias("_text"), text_key(whole).alias("tk"))
    rows = rows.join(every, "tk", "left").select(*inner, "_text", "found")
    return mapped(rows, _without_spans(names, len(names)), extended(kept.schema.fields, RESULT))
