"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and put together around sentinels.

A text is a row of units, each up to and with its ``delimiter``; what is left behind the last one is a unit
too. Two cuts fall on borders of units (both may fall on one, or at an end). The pieces are joined as
prefix, suffix, middle (psm) or suffix, prefix, middle (spm), each behind its sentinel; a text that is empty,
holds a sentinel, or that the rate leaves out stays plain.

Cuts and form come from the first four groups of eight hexadecimal digits of the SHA-256 of ``seed:id``,
so a task that runs again gives the same rows. Batches go through ``pyarrow.compute`` as a whole: split
into lists, flattened with the index of the parent, numbered within it, filtered by role, rebuilt as
lists, joined. A batch is worked on in slices of ``SLICE`` bytes, one text at least; nothing is shuffled.

Null counts as an empty text, a null id as the empty string. Rows with one id are cut alike. Columns of
``docs`` with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.functions.columns import col
from tablekit.llm.base import extended, mapped
from tablekit.llm.words import SLICE

PLAIN, PSM, SPM = "plain", "psm", "spm"
SENTINELS = ("<P>", "<S>", "<M>")
RESULT = "n_units long, form string, prefix_chars long, middle_chars long, output string"
DRAWS = ("_h1", "_h2", "_h3", "_h4")


def draws(id_column: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(h) for i, h in enumerate(DRAWS)]


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        yield lo, hi
        lo = hi


def units(texts: pa.Array, delimiter: str) -> tuple[pa.Array, np.ndarray]:
    """All units of all texts in a row, and the index of the text each is of."""
    split = pc.split_pattern(texts, delimiter)
    flat, parent = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    last = np.r_[parent[1:] != parent[:-1], np.ones(min(1, len(parent)), bool)]
    ended = pc.if_else(pa.array(last), flat, pc.binary_join_element_wise(flat, pa.scalar(delimiter, flat.type), pa.scalar("", flat.type)))
    keep = pc.or_(pa.array(~last), pc.greater(pc.binary_length(flat), 0))  # nothing stands behind the last delimiter
    return ended.filter(keep), parent[keep.to_numpy(zero_copy_only=False)]


def counted(parent: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(parent, minlength=rows).astype(np.int64)


def joined(flat: pa.Array, parent: np.ndarray, mask: np.ndarray, rows: int) -> pa.Array:
    """The masked units of each text as one string."""
    offsets = np.r_[0, np.cumsum(counted(parent[mask], rows))].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), flat.filter(pa.array(mask)))
    return pc.binary_join(lists, pa.scalar("", flat.type))


def infill(texts: pa.Array, h: list[np.ndarray], delimiter: str, rate: int, spm: int) -> list[pa.Array]:
    """n_units, form, prefix_chars, middle_chars, output of texts without nulls."""
    rows = len(texts)
    flat, parent = units(texts, delimiter)
    n = counted(parent, rows)
    ordinal = np.arange(len(parent)) - (np.cumsum(n) - n)[parent]
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    lo, hi = np.minimum(one, two)[parent], np.maximum(one, two)[parent]
    roles = (ordinal < lo, (ordinal >= lo) & (ordinal < hi), ordinal >= hi)
    prefix, middle, suffix = (joined(flat, parent, mask, rows) for mask in roles)
    marked = np.zeros(rows, bool)
    for s in SENTINELS:
        marked |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    plain = pa.array((n == 0) | marked | (h[2] % 100 >= rate))
    suffix_first = pa.array(h[3] % 100 < spm)
    p, s, m, nothing = (pa.scalar(x, texts.type) for x in (*SENTINELS, ""))
    psm_out = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, nothing)
    spm_out = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, nothing)
    form = pc.if_else(plain, PLAIN, pc.if_else(suffix_first, SPM, PSM))
    none = pa.scalar(None, pa.int64())
    return [
        pa.array(n),
        form.cast(pa.string()),
        pc.if_else(plain, none, pc.utf8_length(prefix).cast(pa.int64())),
        pc.if_else(plain, none, pc.utf8_length(middle).cast(pa.int64())),
        pc.if_else(plain, texts, pc.if_else(suffix_first, spm_out, psm_out)).cast(pa.string()),
    ]


def transform(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", delimiter: str = "\n", rate: int = 100, spm: int = 50, seed: int = 7
) -> DataFrame:
    """The columns of ``docs`` with n_units, form (plain, psm, spm), prefix_chars and middle_chars (code
    points; null if plain) and output. ``rate`` texts of a hundred are transformed, ``spm`` of a hundred
    of these with the suffix first."""
    if not delimiter:
        raise ValueError("a delimiter must not be empty")
    added = [f.split()[0] for f in RESULT.split(", ")]
    kept = docs.select(*(col(c) for c in docs.columns if c not in added))
    whole = F.coalesce(col(text).cast("string"), F.lit("")).alias("_units_of")
    rows = docs.select(*(col(c) for c in kept.columns), *draws(col(id_col), seed), whole)
    names = kept.columns
    n = len(names)
    schema = extended(kept.schema.fields, RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(n + len(DRAWS)).cast(pa.large_string())
            h = [batch.column(n + i).to_numpy() for i in range(len(DRAWS))]
            for lo, hi in slices(texts):
                made = infill(texts.slice(lo, hi - lo), [x[lo:hi] for x in h], delimiter, rate, spm)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:n]), *made], names=[*names, *added])

    return mapped(rows, run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: no piece holds a sentinel, and none can arise where pieces meet."""
    parts = F.split(output, "|".join(SENTINELS))
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
