"""Suffix sorting and repeated substrings by brute force, and on awkward rows."""

import random
from collections import Counter

import numpy as np
import pytest

from tablekit.llm import repeats
from tablekit.llm.suffixes import deep_shallow


def common(x, y):
    n = 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    return n


@pytest.mark.parametrize("shallow", [8, 16, 64])
def test_deep_shallow_order(shallow):
    rng = random.Random(shallow)
    for _ in range(60):
        alphabet = rng.choice(["ab", "abc\x00", "a"])
        block = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40)))
        text = "".join(block if rng.random() < 0.6 else rng.choice(alphabet) for _ in range(rng.randrange(1, 30))).encode()
        start = [rng.randrange(len(text)) for _ in range(rng.randrange(1, 90))]
        end = [rng.randrange(a, len(text)) + 1 for a in start]
        order, shared = deep_shallow(np.frombuffer(text, np.uint8), np.array(start), np.array(end), shallow)
        got = [text[start[i] : end[i]] for i in order]
        assert sorted(order.tolist()) == list(range(len(start))) and got == sorted(got)
        assert shared.tolist() == [0, *(common(x, y) for x, y in zip(got, got[1:]))]


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    times = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        step = np.diff(np.r_[0, gone.astype(np.int8), 0])
        spans = list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))
        out.append((len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def prose(rng, n):
    return "".join(rng.choice(["ein ", "wörter", " of ", "zu", "日本", "x", "\n", "the "]) for _ in range(n))


def rows_with_repeats(rng):
    passage, base = prose(rng, 40), prose(rng, 120)
    texts = [None, "", "x", "y" * 700, "line one\n" * 90, base, base, base + "!", passage, prose(rng, 300)]
    for _ in range(40):
        cut = rng.randrange(len(base))
        some = base[:cut] + rng.choice(["", "z", passage]) + base[cut:]
        texts.append(prose(rng, rng.randrange(20)) + rng.choice([passage, some, passage[5:], some[7:-9], ""]) + prose(rng, rng.randrange(20)))
    return texts


@pytest.mark.parametrize("length, most", [(40, 2000), (100, 2000), (100, 3), (40, 1), (5, 2000)])
def test_repeats_by_brute_force(spark, length, most):
    rng = random.Random(length + most)
    texts = rows_with_repeats(rng)
    df = spark.createDataFrame([(i % 7 or None, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = repeats.remove_repeats(df.repartition(5), length=length, most=most).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "n_bytes", "spans", "kept"}
    want = Counter((t, n, tuple(s), k) for t, (n, s, k) in zip(texts, brute(texts, length)))
    have = Counter((r.text, r.n_bytes, tuple((x.start, x.end) for x in r.spans), bytes(r.kept)) for r in got)
    assert have == want
    assert any(r.spans and len(r.kept) for r in got) and any(r.spans and not len(r.kept) for r in got)


def test_repeats_of_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    assert repeats.remove_repeats(df).collect() == []
    with pytest.raises(ValueError):
        repeats.remove_repeats(df, length=1)


def test_repeat_contract(spark):
    import hashlib

    from tablekit.llm.queries import QUERIES
    from tests.compare import duck

    sf = "/root/testdata/sf0.001"
    rows = duck(sf).sql("SELECT doc_id, text FROM documents").fetchall()
    want = {d: (n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for (d, _), (n, s, k) in zip(rows, brute([t for _, t in rows], 400))}
    got = QUERIES["op12_suffix_repeats"](spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want and len(got) == len(want)
