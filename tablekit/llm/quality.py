"""Quality score of whole texts by a small convolutional network over bytes, in numpy.

A text is cut into overlapping chunks that cover all of it. Bytes are embedded; learned filters slide
over each chunk; the largest response of each filter is the chunk's vector; mean and maximum of the
chunk vectors go into one logistic unit.

Training is a bounded job on the driver: the texts, of at most ``train_bytes`` bytes, of at most
``train_docs`` labels, picked by hash. Scoring is a map over all rows and all bytes.

Null counts as empty text; an empty text is one chunk of padding and has a score like any other.
Without labelled rows every score is 0.5. A text with several labels counts once for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekit.functions.columns import col
from tablekit.llm.base import extended, mapped, model
from tablekit.llm.words import byte_slices

CHUNK, HOP = 512, 383
DIM, WIDTH, STRIDE, FILTERS = 6, 8, 2, 24
WINDOWS = (CHUNK - WIDTH) // STRIDE + 1


def chunks(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, CHUNK) bytes plus one, 0 beyond the end, and the row each chunk is of."""
    n = np.diff(bounds)
    each = np.maximum(1, -(-(n - CHUNK) // HOP) + 1)
    row = np.repeat(np.arange(len(n)), each)
    no = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    at = bounds[:-1][row] + no * HOP
    place = at[:, None] + np.arange(CHUNK)
    if not len(data):
        return np.zeros((len(row), CHUNK), np.int32), row
    inside = place < bounds[1:][row][:, None]
    got = data[np.minimum(place, len(data) - 1)].astype(np.int32) + 1
    return np.where(inside, got, 0), row


@dataclass
class Network:
    """Parameters by name: embedding, filters, filter offsets, output weights and offset."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int) -> Network:
        r = np.random.default_rng(seed)
        shapes = {"emb": (257, DIM), "w": (WIDTH * DIM, FILTERS), "b": (FILTERS,), "v": (2 * FILTERS,), "c": (1,)}
        scale = {"emb": 0.5, "w": 1 / np.sqrt(WIDTH * DIM), "v": 0.1, "b": 0.0, "c": 0.0}
        return Network({k: (r.normal(size=s) * scale[k]).astype(np.float32) for k, s in shapes.items()})

    def windows(self, x: np.ndarray) -> np.ndarray:
        e = np.ascontiguousarray(self.p["emb"][x]).reshape(len(x), CHUNK * DIM)
        view = np.lib.stride_tricks.sliding_window_view(e, WIDTH * DIM, axis=1)
        return view[:, :: STRIDE * DIM]

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """(chunks, FILTERS): the largest response of each filter in each chunk."""
        w = np.ascontiguousarray(self.windows(x)).reshape(-1, WIDTH * DIM)
        return np.maximum((w @ self.p["w"]).reshape(len(x), WINDOWS, FILTERS).max(axis=1) + self.p["b"], 0)

    def together(self, pooled: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Mean and maximum over the chunks of each row; rows are in order and none is missing."""
        first = np.flatnonzero(np.r_[True, np.diff(row) != 0])
        n = np.diff(np.r_[first, len(row)])[:, None]
        return np.hstack([np.add.reduceat(pooled, first, axis=0) / n, np.maximum.reduceat(pooled, first, axis=0)])

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        x, row = chunks(data, bounds)
        pooled = np.concatenate([self.pooled(x[i : i + 256]) for i in range(0, len(x), 256)])
        z = self.together(pooled, row) @ self.p["v"] + self.p["c"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def gradients(self, x: np.ndarray, row: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of a batch. Only the window with the largest response passes it on."""
        p, rows = self.p, len(y)
        w = self.windows(x)
        r = np.ascontiguousarray(w).reshape(-1, WIDTH * DIM) @ p["w"]
        r = r.reshape(len(x), WINDOWS, FILTERS)
        top = r.argmax(axis=1)
        raw = np.take_along_axis(r, top[:, None, :], 1)[:, 0] + p["b"]
        pooled = np.maximum(raw, 0)
        both = self.together(pooled, row)
        z = both @ p["v"] + p["c"]
        dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / rows
        n = np.bincount(row, minlength=rows)[:, None]
        d = ((dz[:, None] * p["v"][:FILTERS]) / n)[row]
        is_top = pooled == both[:, FILTERS:][row]
        ties = np.add.reduceat(is_top, np.flatnonzero(np.r_[True, np.diff(row) != 0]), axis=0, dtype=np.float32)
        d = (d + (dz[:, None] * p["v"][FILTERS:])[row] * is_top / ties[row]) * (raw > 0)
        c, f = np.nonzero(d)
        g, at = d[c, f].astype(np.float32), top[c, f]
        picked = w[c, at]  # (hits, WIDTH * DIM)
        dw = np.zeros_like(p["w"])
        np.add.at(dw.T, f, picked * g[:, None])
        back = (p["w"].T[f] * g[:, None]).reshape(-1, WIDTH, DIM)
        byte = x[c[:, None], at[:, None] * STRIDE + np.arange(WIDTH)]
        demb = np.zeros_like(p["emb"])
        np.add.at(demb, byte, back)
        return {"emb": demb, "w": dw, "b": d.sum(axis=0), "v": both.T @ dz, "c": dz.sum(keepdims=True)}


def fit(texts: list[bytes], labels: list[int], seed: int = 5, steps: int = 600, batch: int = 48, rate: float = 0.01) -> Network:
    """Adam on batches drawn in a seeded order."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    share = float(np.clip(y.mean(), 0.01, 0.99))
    net.p["c"][:] = np.log(share / (1 - share))
    order: list[int] = []
    for t in range(1, steps + 1):
        if len(order) < batch:
            order += rng.permutation(len(texts)).tolist()
        some, order = order[:batch], order[batch:]
        data = np.frombuffer(b"".join(texts[i] for i in some), np.uint8)
        x, row = chunks(data, np.cumsum([0] + [len(texts[i]) for i in some]))
        now = rate * (1 - t / steps) + 1e-4
        for k, g in net.gradients(x, row, y[some]).items():
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            net.p[k] -= (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, train_docs: int = 2500, train_bytes: int = 1 << 14) -> Network | None:
    """docs: doc_id, text; labels: doc_id, label (0 or 1). The labels are sampled, by a hash of the id, so
    only that many ids meet the texts, which stay where they are. None without usable rows."""
    ids = labels.where("doc_id is not null and label in (0, 1)").select(F.col("doc_id").alias("_id"), F.col("label").cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("_id"), "_id", "label").limit(train_docs)
    # at most ``train_docs`` rows
    rows = docs.where(F.octet_length("text") <= train_bytes).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    got = rows.select("text", "label").toArrow()
    if not got.num_rows:
        return None
    pairs = sorted(zip(got.column("text").to_pylist(), got.column("label").to_pylist()))
    return fit([t.encode() for t, _ in pairs], [y for _, y in pairs])


def score_quality(docs: DataFrame, net: Network | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` (but one named score) with score: the probability of label 1."""
    names = [c for c in keep if c != "score"]
    kept = docs.select(*(col(c) for c in names), col(text).alias("_judged"))
    if net is None:
        return kept.select(*(col(c) for c in names), F.lit(0.5).alias("score"))
    shared = model(docs.sparkSession, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.score(data, bounds) for _, _, data, bounds in byte_slices(batch.column(len(names)))]
            scores = np.concatenate([np.zeros(0), *found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*names, "score"])

    return mapped(kept, run, extended(kept.schema.fields[:-1], "score double"))
