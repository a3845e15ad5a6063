"""Near-duplicate classes with DartMinHash signatures, banded joining and exact verification.

A text is the set (or with ``weighted`` the multiset) of its runs of five words. Darts are points of a
random field over element, weight and rank, made by hashing, so equal elements of different texts have
the same darts. A dart counts if its weight coordinate lies within the element's weight; the earliest
dart by rank of each of the signature's coordinates makes the signature, and two texts share a
coordinate with the probability of their (weighted) Jaccard similarity. Ranks are drawn in order from
hashed exponential gaps, only as far as a text of its total weight needs for all coordinates to be hit:
a long text looks at each element once and throws as few darts as a short one.

Texts with equal sets become one node. Nodes that share a band are linked to one leader of the bucket,
the node that meets most others, so buckets give links, not pairs. Links are verified on whole texts in
two turns: the strongest link of each node, then those whose ends are still apart. Where a bucket then
still holds several components, everyone outside its largest one is compared with all of the bucket, in
blocks, by size and signature, which gives the pairs of components that could be linked. Those are
compared text by text in blocks within tasks, until a link is found. So a similar pair that shares a
bucket is never lost, however large the bucket, and what tasks give is links of components, not pairs.

With 24 bands of 4 rows, a pair of similarity 0.8 shares no bucket with probability 4e-6.

Texts without words (null, empty, signs only) are in no class but their own; texts of fewer than five
words are one shingle. Equal texts and repeated rows are in one class; the class id is its smallest
doc_id. Null ids don't count for the class id unless a class has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekit.functions.columns import col
from tablekit.llm.base import ROW, mapped, packed, unpacked, written
from tablekit.llm.words import Words, mix, run_hashes, word_slices
from tablekit.operators.cluster import connected_components

SHINGLE = 5
GOLD = np.uint64(0x9E3779B97F4A7C15)
#: nodes of a bucket, and texts, that a part of a comparison holds on either side
BLOCK, TEXT_BLOCK = 512, 256


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of each distinct shingle, by row and hash."""
    n, first = w.counts, w.first[:-1]
    each = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), each)
    start = np.repeat(first - (np.cumsum(each) - each), each) + np.arange(each.sum())
    made = run_hashes(w.hashes(), start, start + np.minimum(n, size)[row])
    order = np.lexsort((made, row))
    row, made = row[order], made[order]
    new = np.r_[True, (np.diff(row) != 0) | (made[1:] != made[:-1])] if len(row) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return row[at], made[at], np.diff(np.r_[at, len(row)])


def set_hashes(row: np.ndarray, element: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for the set of each row."""
    out = []
    for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)):
        sums = np.zeros(len(row) + 1, np.uint64)
        np.cumsum(mix(element ^ salt), out=sums[1:])
        at = np.searchsorted(row, np.arange(rows + 1))
        out.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return out[0], out[1]


def dart_signatures(
    row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, coordinates: int, seed: int = 1
) -> np.ndarray:
    """(rows, coordinates) of 64-bit dart hashes; rows without elements stay zero."""
    out = np.zeros((rows, coordinates), np.uint64)
    todo = np.unique(row)
    throw = coordinates * (np.log(coordinates) + 4)
    while len(todo):
        mine = np.isin(row, todo)
        r, e, x = np.searchsorted(todo, row[mine]), element[mine], weight[mine].astype(np.float64)
        limit = throw / np.bincount(r, x, len(todo))
        cells, ranks, darts = [], [], []
        low, height, band = 0.0, 1.0, 0
        while True:  # weight bands [0, 1), [1, 2), [2, 4), ...
            key = mix(e + np.uint64(int(GOLD) * (2 * band + seed * 1000003) % 2**64))
            at, rank, chunk, step = np.flatnonzero(x > low), None, 1, 0
            if not len(at):
                break
            rank = np.zeros(len(at))
            while len(at):
                no = np.arange(step + 1, step + chunk + 1, dtype=np.uint64)
                dart = mix(key[at][:, None] + no[None, :] * GOLD)
                gap = -np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / height
                reach = rank[:, None] + np.cumsum(gap, axis=1)
                inside = reach < limit[r[at]][:, None]
                name = mix(dart ^ np.uint64(0xD1B54A32D192ED03))
                hit = inside
                if band or (x[at] < low + height).any():
                    place = (mix(name ^ GOLD) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                    hit = inside & (low + height * place <= x[at][:, None])
                i, _ = np.nonzero(hit)
                name = name[hit]
                cells.append(r[at][i] * coordinates + (name % np.uint64(coordinates)).astype(np.int64))
                ranks.append(reach[hit])
                darts.append(name)
                go = inside[:, -1]
                at, rank = at[go], reach[go, -1]
                step += chunk
                chunk = min(chunk * 2, 64)
            low, height, band = low + height, 1.0 if not band else height * 2, band + 1
        cell, rank, dart = (np.concatenate(v) for v in (cells, ranks, darts))
        best = np.full(len(todo) * coordinates, np.inf)
        np.minimum.at(best, cell, rank)
        win = rank == best[cell]
        sig = np.zeros(len(todo) * coordinates, np.uint64)
        sig[cell[win]] = dart[win]
        full = np.isfinite(best).reshape(-1, coordinates).all(axis=1)
        out[todo[full]] = sig.reshape(-1, coordinates)[full]
        todo = todo[~full]  # a coordinate stayed empty: the same darts and more
        throw *= 2
    return out


def band_values(sig: np.ndarray, rows_in_band: int) -> np.ndarray:
    odd = mix(np.arange(1, rows_in_band + 1, dtype=np.uint64)) | np.uint64(1)
    groups = sig.reshape(len(sig), -1, rows_in_band)
    return mix((groups * odd).sum(axis=2, dtype=np.uint64)).view(np.int64)


def _sign(bands: int, rows_in_band: int, weighted: bool):
    k = bands * rows_in_band

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in word_slices(batch.column("_text")):
                rows, wordless = w.hi - w.lo, w.counts == 0
                row, element, count = shingles(w)
                h1, h2 = set_hashes(row, mix(element + count.astype(np.uint64) * GOLD) if weighted else element, rows)
                sig = dart_signatures(row, element, count if weighted else np.ones(len(row)), rows, k)
                values = band_values(sig, rows_in_band)
                starts = np.arange(0, rows * bands + 1, bands, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").slice(w.lo, rows),
                        pa.array(h1, mask=wordless),
                        pa.array(h2, mask=wordless),
                        pa.array(np.bincount(row, count if weighted else None, rows).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(starts), pa.array(values.ravel())),
                        pa.array([x.tobytes() for x in (sig >> np.uint64(48)).astype(np.uint16)], pa.binary()),
                    ],
                    names=["_id", "h1", "h2", "size", "bands", "sig"],
                )

    return run


def _sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for w in word_slices(column):
        row, element, count = shingles(w)
        at = np.searchsorted(row, np.arange(w.hi - w.lo + 1))
        for i in range(w.hi - w.lo):
            yield element[at[i] : at[i + 1]], count[at[i] : at[i + 1]]


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weighted: bool) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not weighted:
        return len(i) / max(1, len(a[0]) + len(b[0]) - len(i))
    both = np.minimum(a[1][i], b[1][j]).sum()
    return both / max(1, a[1].sum() + b[1].sum() - both)


def _similar(threshold: float, weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            a, b, yes = batch.column("a"), batch.column("b").to_numpy(), []
            other = batch.column("text_b")
            for i, own in enumerate(_sets(batch.column("text_a"))):
                if b[i] != last[0]:  # rows come sorted by b
                    last = (b[i], next(_sets(other.slice(i, 1))))
                yes.append(jaccard(own, last[1], weighted) >= threshold)
            keep = pa.array(yes, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _same_set(weighted: bool):
    """Keeps rows whose text has the set that the node stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            for w in word_slices(batch.column("_text")):
                row, element, count = shingles(w)
                a, b = set_hashes(row, mix(element + count.astype(np.uint64) * GOLD) if weighted else element, w.hi - w.lo)
                keep.append((a == h1[w.lo : w.hi]) & (b == h2[w.lo : w.hi]) & (w.counts > 0))
            mask = pa.array(np.concatenate(keep)) if keep else pa.array([], pa.bool_())
            yield batch.filter(mask)

    return run


KEY = ["band", "value", "i", "j"]


def _related(coordinates: int, threshold: float):
    """Rows sorted by KEY: pairs of roots of an outsider and a member of the same part of a bucket that
    could be similar, by the sizes of their sets and by how often their signatures agree. A pair of nodes
    that shares several buckets is looked at in the first."""

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        key = np.stack([rows.column(c).to_numpy() for c in KEY])
        root, size = rows.column("root").to_numpy(), rows.column("size").to_numpy()
        outside = rows.column("outside").to_numpy(zero_copy_only=False)
        bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(root), -1)
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, coordinates)
        new = np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)] if len(root) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        end = np.repeat(np.r_[first[1:], len(root)], np.diff(np.r_[first, len(root)]))
        found, at = [np.zeros((0, 2), np.int64)], np.arange(len(root))
        for d in range(1, int(np.diff(np.r_[first, len(root)]).max(initial=0))):
            at = at[at + d < end[at]]
            one, two = at, at + d
            ok = (outside[one] != outside[two]) & (root[one] != root[two])
            ok &= np.minimum(size[one], size[two]) >= threshold * np.maximum(size[one], size[two])
            one, two = one[ok], two[ok]
            ok = (bands[one] == bands[two]).argmax(axis=1) == key[0][one]
            one, two = one[ok], two[ok]
            ok = (sig[one] == sig[two]).sum(axis=1) >= 0.75 * threshold * coordinates
            one, two = root[one[ok]], root[two[ok]]
            found.append(np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1))
        got = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last part may go on in the next batch
            key = np.stack([batch.column(c).to_numpy() for c in KEY])
            cut = int(np.flatnonzero((key != key[:, -1:]).any(axis=0)).max(initial=-1)) + 1
            if cut:
                yield pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield pairs(pa.Table.from_batches(held))

    return run


def _links(coordinates: int, threshold: float, weighted: bool):
    """One verified link for each component of the outer rows that has one to the inner rows, which are
    of one component."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(frame["sig"]), np.uint16).reshape(-1, coordinates)
        node, root, size = (frame[c].to_numpy() for c in ("node", "root", "size"))
        outside = frame["outside"].to_numpy()
        sets = list(_sets(pa.array(frame["_text"], pa.string())))
        whole, out, done = np.flatnonzero(~outside), [], set()
        for i in np.flatnonzero(outside):
            if root[i] in done:
                continue
            fits = np.minimum(size[whole], size[i]) >= threshold * np.maximum(size[whole], size[i])
            same = (sig[whole] == sig[i]).sum(axis=1)
            near = whole[fits & (same >= 0.75 * threshold * coordinates)]
            for j in near[np.argsort(-(sig[near] == sig[i]).sum(axis=1), kind="stable")]:
                if jaccard(sets[i], sets[j], weighted) >= threshold:
                    out.append((node[i], node[j]))
                    done.add(root[i])
                    break
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


class NearDuplicates:
    """rows: doc_id with h1, h2 of its set (null without words); nodes: node, h1, h2, rep (smallest
    doc_id), class_id, root (its component)."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, weighted: bool) -> None:
        self.rows, self.nodes, self.weighted = rows, nodes, weighted

    def classes(self) -> DataFrame:
        """A row per document: doc_id, class_id."""
        n = self.nodes.select("class_id", F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
        r = self.rows.select("_id", "h1", "h2")
        found = r.join(n, (r["h1"] == n["_h1"]) & (r["h2"] == n["_h2"]), "left")
        return found.select(F.col("_id").alias("doc_id"), F.when(F.col("h1").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"))

    def keep_one(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """The rows of ``docs`` without all but one row of each class: the smallest id's; texts without
        words all stay."""
        kept = self.nodes.where(F.col("rep").eqNullSafe(F.col("class_id")))
        # by root: ids given twice can make two classes of one id
        kept = kept.groupBy("root").agg(F.min(F.struct("node", "h1", "h2", "rep")).alias("m"))
        kept = kept.select(F.col("m.rep").alias("_rep"), "m.h1", "m.h2")
        wordless = ~F.coalesce(F.rlike(col(text), F.lit(r"[0-9A-Za-z]|[^\x00-\x7F]")), F.lit(False))
        rows = packed(docs.where(~wordless), text).withColumnRenamed(text, "_text")
        rows = rows.withColumn("_key", F.col("_text") if id_col == text else F.col(ROW).getField(id_col))
        one = rows.join(kept, F.col("_key").eqNullSafe(F.col("_rep"))).select(ROW, "_text", "h1", "h2")
        one = mapped(one, _same_set(self.weighted), one.schema).dropDuplicates(["h1", "h2"])
        one = one.withColumnRenamed("_text", text).select(*unpacked(docs.columns, text))
        return one.unionByName(docs.where(wordless))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    threshold: float = 0.8,
    bands: int = 24,
    rows_in_band: int = 4,
    weighted: bool = False,
) -> NearDuplicates:
    k = bands * rows_in_band
    source = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    id_type = source.schema["_id"].dataType.simpleString()
    rows = written(
        mapped(source, _sign(bands, rows_in_band, weighted), f"_id {id_type}, h1 long, h2 long, size long, bands array<long>, sig binary")
    )
    nodes = written(
        rows.where("h1 is not null")
        .groupBy("h1", "h2")
        .agg(F.min("_id").alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    shared = buckets.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    met = written(buckets.join(shared, ["band", "value"]).select("band", "value", "node", "n"))
    # the text that others are copies of meets more of them than any copy does: it leads its buckets
    rank = met.groupBy("node").agg(F.sum("n").alias("rank"))
    led = met.join(rank, "node").withColumn("low", -F.col("node"))
    leaders = led.groupBy("band", "value").agg((-F.max(F.struct("rank", "low"))["low"]).alias("leader"))
    members = written(met.join(leaders, ["band", "value"]).select("band", "value", "node", "leader"))
    in_buckets = members.select("node").distinct()
    wanted = nodes.select("node", "rep", "h1", "h2").join(in_buckets, "node")
    texts = source.join(wanted, source["_id"].eqNullSafe(wanted["rep"])).select("node", "h1", "h2", "_text")
    texts = written(mapped(texts, _same_set(weighted), texts.schema).dropDuplicates(["node"]).select("node", "_text"))

    def verified(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("node").alias("a"), F.col("_text").alias("text_a"))
        b = texts.select(F.col("node").alias("b"), F.col("_text").alias("text_b"))
        both = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
        return written(mapped(both, _similar(threshold, weighted), "a long, b long"))

    def led_to(edges: DataFrame) -> DataFrame:
        """Each node's root where every node has at most one link, upwards in rank."""
        up = in_buckets.join(edges.select(F.col("a").alias("node"), "b"), "node", "left")
        roots = written(up.select("node", F.coalesce("b", "node").alias("root")))
        while True:
            above = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = written(roots.join(above, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
            roots = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                return roots

    def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
        if edges.isEmpty():
            return roots
        links = apart(edges, roots).select(F.col("root_a").alias("u"), F.col("root_b").alias("v"))
        top = connected_components(links.select(F.explode(F.array("u", "v")).alias("id")).distinct(), links)
        top = top.select(F.col("id").alias("root"), F.col("root").alias("top"))
        return written(roots.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")))

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        ra = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        rb = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        return pairs.join(ra, "a").join(rb, "b").where("root_a <> root_b")

    votes = written(
        members.where("node <> leader").groupBy(F.col("node").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("n"))
    )
    strongest = votes.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("m")).select("a", (-F.col("m.b")).alias("b"))
    strongest = written(strongest)
    roots = led_to(verified(strongest))
    rest = written(apart(votes.join(strongest, ["a", "b"], "left_anti"), roots).select("a", "b"))
    roots = joined(roots, verified(rest))
    related = written(_across(members, roots, nodes, k, threshold))
    if not related.isEmpty():
        roots = joined(roots, written(_between(related, roots, nodes, texts, k, threshold, weighted)))
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = placed.groupBy("root").agg(F.min("rep").alias("class_id"))
    return NearDuplicates(rows, written(placed.join(ids, "root").select("node", "h1", "h2", "rep", "class_id", "root")), weighted)


def _across(members: DataFrame, roots: DataFrame, nodes: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs of components (low, high) with nodes in one bucket that could be similar. A true pair falls
    below three quarters of the threshold in its signature with probability under 1e-6."""
    m = members.join(roots, "node")
    parts = m.groupBy("band", "value", "root").agg(F.count("*").alias("n"))
    main = (
        parts.groupBy("band", "value")
        .agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("total"), F.count("*").alias("components"))
        .where("components > 1")
        .select(
            "band",
            "value",
            F.col("m.root").alias("main"),
            F.ceil((F.col("total") - F.col("m.n")) / BLOCK).alias("rest_blocks"),
            F.ceil(F.col("total") / BLOCK).alias("all_blocks"),
        )
    )
    m = m.join(main, ["band", "value"]).join(nodes.select("node", "size", "bands", "sig"), "node")
    h = F.xxhash64("node")

    def blocks(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    kept = ["root", "size", "bands", "sig"]
    rest = m.where("root <> main").select(*KEY[:2], F.pmod(h, "rest_blocks").alias("i"), blocks("all_blocks").alias("j"), *kept, F.lit(True).alias("outside"))
    whole = m.select(*KEY[:2], blocks("rest_blocks").alias("i"), F.pmod(h, "all_blocks").alias("j"), *kept, F.lit(False).alias("outside"))
    parts = rest.unionByName(whole).repartition(*KEY).sortWithinPartitions(*KEY)
    return mapped(parts, _related(k, threshold), "low long, high long").distinct()


def _between(
    related: DataFrame, roots: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, threshold: float, weighted: bool
) -> DataFrame:
    """Verified links between components: the nodes of the smaller are compared with those of the larger
    in blocks, within tasks, and a pair of components gives a link or two at most."""
    n = roots.groupBy("root").agg(F.count("*").alias("n"))
    low = n.select(F.col("root").alias("low"), F.col("n").alias("n_low"))
    high = n.select(F.col("root").alias("high"), F.col("n").alias("n_high"))
    sized = related.join(low, "low").join(high, "high")
    swap = F.col("n_low") > F.col("n_high")
    sized = sized.select(
        F.when(swap, F.col("low")).otherwise(F.col("high")).alias("wide"),
        F.when(swap, F.col("high")).otherwise(F.col("low")).alias("root"),
        F.greatest("n_low", "n_high").alias("n_wide"),
        F.least("n_low", "n_high").alias("n_thin"),
    )
    wide = sized.groupBy("wide").agg(
        F.ceil(F.sum("n_thin") / TEXT_BLOCK).alias("outer"), F.ceil(F.max("n_wide") / TEXT_BLOCK).alias("inner")
    )
    held = roots.join(nodes.select("node", "size", "sig"), "node").join(texts, "node")
    h = F.xxhash64("node")

    def blocks(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    kept = ["node", "root", "size", "sig", "_text"]
    outer = sized.select("wide", "root").join(wide, "wide").join(held, "root")
    outer = outer.select("wide", F.pmod(h, "outer").alias("i"), blocks("inner").alias("j"), *kept, F.lit(True).alias("outside"))
    inner = wide.join(held, F.col("wide") == F.col("root"))
    inner = inner.select("wide", blocks("outer").alias("i"), F.pmod(h, "inner").alias("j"), *kept, F.lit(False).alias("outside"))
    return outer.unionByName(inner).groupBy("wide", "i", "j").applyInPandas(_links(k, threshold, weighted), "a long, b long")
