"""Language identification by prediction by partial matching over bytes.

Every language has a tree of byte contexts of up to three bytes. A byte is coded in the longest
context that the tree has; a context that hasn't seen it codes an escape (as many chances as it has
distinct successors) and passes on to the next shorter one, which leaves out what the longer one has
ruled out; below the empty context all remaining bytes are alike. Statistics are frozen after training,
so the code length of every byte in every context is known beforehand: contexts become the states of an
automaton, and scoring a text adds up one row of the table per byte. The language with the shortest
code wins.

Training reads at most ``train_docs`` labelled texts of each language of at most ``train_bytes`` bytes,
picked by a hash; the trees are counted in tasks and only their counts reach the driver.
Scoring covers every byte of every text.

Null text, and text without any letter, is ``und`` with score 0. Without labelled rows every text is
``und``. Ties go to the smaller language name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekit.functions.columns import col
from tablekit.llm.base import extended, mapped, model as shared_model, text_sample
from tablekit.llm.words import byte_slices

ORDER = 3
UND = "und"


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language, counts of (three bytes of context, byte); before the text the context is zeros."""
    total: dict[str, np.ndarray] = {}
    parts: dict[str, list[np.ndarray]] = {}

    def fold(lang: str) -> None:
        values, n = np.unique(np.concatenate(parts[lang]), return_counts=True)
        if lang in total:
            values, where = np.unique(np.concatenate([total[lang][0], values]), return_inverse=True)
            n = np.bincount(where, np.concatenate([total[lang][1], n])).astype(np.int64)
        total[lang], parts[lang] = (values, n), []

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lo, hi, data, bounds in byte_slices(batch.column("text")):
            for i in range(lo, hi):
                b = np.r_[np.zeros(ORDER, np.int64), data[bounds[i - lo] : bounds[i - lo + 1]].astype(np.int64)]
                if len(b) == ORDER:
                    continue
                parts.setdefault(langs[i], []).append(b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:])
        for lang in parts:
            if sum(map(len, parts[lang])) > 4 << 20:
                fold(lang)
    for lang in parts:
        if parts[lang]:
            fold(lang)
    for lang, (values, n) in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(values), pa.string()), pa.array(values, pa.int64()), pa.array(n, pa.int64())],
            names=["lang", "gram", "n"],
        )


@dataclass
class Model:
    """languages; symbol: number of each byte (0: seen by none); state: of each context of three
    symbols; bits: code length of each symbol in each state and language."""

    languages: list[str]
    symbol: np.ndarray
    state: np.ndarray
    bits: np.ndarray

    def lengths(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits of each text in each language."""
        size = self.symbol.max() + 1
        # three zeros before every text: its own context only
        at = bounds[:-1] + ORDER * np.arange(len(bounds) - 1)
        s = np.zeros(len(data) + ORDER * (len(bounds) - 1), np.int32)
        n = np.diff(bounds)
        place = np.arange(len(data)) + ORDER * np.repeat(np.arange(1, len(bounds)), n)
        s[place] = self.symbol[data]
        context = (s[place - 3] * size + s[place - 2]) * size + s[place - 1]
        cost = self.bits[self.state[context].astype(np.int64) * size + s[place]]
        out = np.zeros((len(n), len(self.languages)))
        some = np.flatnonzero(n)
        if len(some):
            out[some] = np.add.reduceat(cost, bounds[:-1][some], axis=0, dtype=np.float64)
        return out


def compile_model(rows: list[tuple[str, int, int]], min_count: int) -> Model:
    """The automaton of all languages from (language, gram, count). A context is a state where some
    language has seen it ``min_count`` times; else its longest suffix that is one."""
    langs = sorted({r[0] for r in rows})
    which = np.searchsorted(langs, [r[0] for r in rows])
    return compiled(langs, which, np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.float64), min_count)


def compiled(langs: list[str], which: np.ndarray, gram: np.ndarray, n: np.ndarray, min_count: int) -> Model:
    """``compile_model`` of columns, the language as its place in ``langs``."""
    seen = np.unique(np.concatenate([np.unique(gram >> s & 255) for s in (24, 16, 8, 0)]))
    symbol = np.zeros(256, np.int32)
    symbol[seen[seen > 0]] = np.arange(1, (seen > 0).sum() + 1)
    size = int(symbol.max()) + 1
    c1, c2, c3, sym = (symbol[gram >> s & 255].astype(np.int64) for s in (24, 16, 8, 0))
    context = [np.zeros_like(sym), c3, c2 * size + c3, (c1 * size + c2) * size + c3]
    kept = [np.zeros(1, np.int64)]
    for order in range(1, ORDER + 1):
        own, at = np.unique(which * size**order + context[order], return_inverse=True)
        often = np.unique(own[np.bincount(at, n) >= min_count] % size**order)
        kept.append(often[np.isin(often % size ** (order - 1), kept[-1])] if order > 1 else often)
    offsets = np.cumsum([0] + [len(k) for k in kept])
    state = np.zeros(size**ORDER, np.int32)
    for first in range(size):  # the contexts that begin with one symbol
        lo, hi = first * size ** (ORDER - 1), (first + 1) * size ** (ORDER - 1)
        for order in range(1, ORDER + 1):
            suffix = np.arange(lo, hi) % size**order
            at = np.minimum(np.searchsorted(kept[order], suffix), max(0, len(kept[order]) - 1))
            if len(kept[order]):
                state[lo:hi] = np.where(kept[order][at] == suffix, offsets[order] + at, state[lo:hi])
    bits = np.zeros((int(offsets[-1]) * size, len(langs)), np.float32)
    for li in range(len(langs)):
        own = which == li
        counts = []
        for order in range(ORDER + 1):
            dense = np.zeros((len(kept[order]), size))
            at = np.minimum(np.searchsorted(kept[order], context[order][own]), max(0, len(kept[order]) - 1))
            ok = kept[order][at] == context[order][own] if len(kept[order]) else np.zeros(own.sum(), bool)
            np.add.at(dense, (at[ok], sym[own][ok]), n[own][ok])
            counts.append(dense)
        for order in range(ORDER + 1):
            for a in range(0, len(kept[order]), 4096):
                contexts = kept[order][a : a + 4096]
                p = np.zeros((len(contexts), size))
                left = np.ones(len(contexts))  # probability of the escapes so far
                out = np.zeros((len(contexts), size), bool)
                for o in range(order, -1, -1):
                    dense = counts[o][np.searchsorted(kept[o], contexts % size**o)]
                    free = np.where(out, 0, dense)
                    total, distinct = free.sum(axis=1), (free > 0).sum(axis=1)
                    down = np.maximum(total + distinct, 1)
                    p += np.where(free > 0, left[:, None] * free / down[:, None], 0)
                    left = np.where(total > 0, left * distinct / down, left)
                    out |= dense > 0
                # what no context has seen: bytes of the alphabet that remain, all 256 alike
                remaining = 256 - out.sum(axis=1)
                p = np.where(out, p, (left / np.maximum(remaining, 1))[:, None])
                lo = (int(offsets[order]) + a) * size
                bits[lo : lo + p.size, li] = -np.log2(p).ravel()
    return Model(langs, symbol, state, bits)


def train(labelled: DataFrame, train_docs: int = 2000, train_bytes: int = 1 << 17, min_count: int = 8) -> Model | None:
    """labelled: text, lang. None if no row has both."""
    rows = labelled.where("text is not null and lang is not null").where(F.octet_length("text") <= train_bytes)
    sample = text_sample(rows.select("lang", "text"), train_docs, "lang")
    grams = mapped(sample, _count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = grams.toArrow()
    if not table.num_rows:
        return None
    names = table.column("lang").combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    place = np.searchsorted(langs, names.dictionary.to_pylist())
    gram, n = (table.column(c).to_numpy() for c in ("gram", "n"))
    return compiled(langs, place[names.indices.to_numpy()], gram, n.astype(np.float64), min_count)


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` (but those with the names of results) with lang_pred, score (share of the winner where
    every language has the chance two to the power of minus its bits) and bits_per_byte of the winner."""
    added = ("lang_pred", "score", "bits_per_byte")
    names = [c for c in keep if c not in added]
    letters = F.coalesce(F.rlike(col(text), F.lit(r"\p{L}")), F.lit(False))
    kept = docs.select(*(col(c) for c in names), letters.alias("_has_letters"), col(text).alias("_judged"))
    if model is None:
        return kept.select(*(col(c) for c in names), F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(8.0).alias("bits_per_byte"))
    shared, n = shared_model(docs.sparkSession, model), len(names)
    schema = extended(kept.schema.fields[:n], "lang_pred string, score double, bits_per_byte double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        languages = pa.array([*m.languages, UND])
        for batch in batches:
            best, share, bits = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
            for _, _, data, bounds in byte_slices(batch.column(n + 1)):
                length = m.lengths(data, bounds)
                least = length.min(axis=1)
                best.append(length.argmin(axis=1))
                share.append(1 / np.exp2(np.maximum(least[:, None] - length, -1000)).sum(axis=1))
                bits.append(least / np.maximum(np.diff(bounds), 1))
            some = batch.column(n).to_numpy(zero_copy_only=False).astype(bool)
            made = [
                languages.take(pa.array(np.where(some, np.concatenate(best), len(m.languages)))),
                pa.array(np.where(some, np.concatenate(share), 0.0)),
                pa.array(np.concatenate(bits)),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=[*names, *added])

    return mapped(kept, run, schema)
