"""Infilling and periodic runs: by brute force, and on nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablekit.llm import infill, periodic
from tests.llm.test_oracle import brute_runs

# 11 ----------------------------------------------------------------------------------------------


def infilled(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, form int")
    made = infill.transform(df, **kw)
    return made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()


def test_infill_takes_texts_apart_and_restores_them(spark):
    rng = random.Random(3)
    texts = [None, "", "\n", "\n\n", "one", "a\nb", "a\nb\n", "ü\n日本\n\nx", "has <S> in it\nand more", "almost <S\n>\n<", "x" * 400_000 + "\ny\n"]
    texts += ["".join(rng.choice(["a", "é", "\n", "<", "P", ">", "\r"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(11, texts[11], 6), (None, "a\nb\nc", 7)]
    seen = set()
    got = infilled(spark, rows)
    assert len(got) == len(rows) and "form" in got[0].asDict()
    for r in got:
        t = r.text or ""
        units = re.findall(r"[^\n]*\n|[^\n]+", t)
        assert r.n_units == len(units) and r.back == t
        plain = not t or any(s in t for s in infill.SENTINELS)
        assert (r.form == "plain") == plain
        seen.add(r.form)
        if plain:
            assert r.output == t and r.prefix_chars is None and r.middle_chars is None
            continue
        parts = dict(zip("PSM" if r.form == "psm" else "SPM", re.split("<P>|<S>|<M>", r.output)[1:]))
        assert parts["P"] + parts["M"] + parts["S"] == t
        assert (len(parts["P"]), len(parts["M"])) == (r.prefix_chars, r.middle_chars)
        borders = np.cumsum([0, *map(len, units)]).tolist()
        assert r.prefix_chars in borders and r.prefix_chars + r.middle_chars in borders
    assert seen == {"plain", "psm", "spm"}
    twice = [r.output for r in got if r.doc_id == 11]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_infill_rates_delimiters_and_empty_tables(spark):
    rows = [(i, f"w{i} and then more. And a second one. ", 0) for i in range(400)]
    got = infilled(spark, rows, delimiter=". ", rate=60, spm=0)
    assert {r.form for r in got} == {"plain", "psm"} and all(r.n_units == 2 and r.back == r.text for r in got)
    assert 180 < sum(r.form == "psm" for r in got) < 300
    assert infilled(spark, []) == []
    with pytest.raises(ValueError):
        infilled(spark, rows, delimiter="")


# 13 ----------------------------------------------------------------------------------------------


def loops(rng):
    w = [rng.choice("abc") for _ in range(rng.randrange(25))]
    block = [rng.choice("abcd") for _ in range(rng.randrange(1, 6))]
    return w + block * rng.randrange(9) + w[: rng.randrange(20)] + ["z"] * rng.randrange(9)


def test_runs_by_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "x " * 5000, "q\x0bq\x0cq q\rq\nq"]
    texts += [" ".join(loops(rng)) for _ in range(250)]
    texts += ["ein zwei drei\u00a0vier " * 4 + " ".join(f"w{i}" for i in range(30_000))]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate([*texts, texts[20]])], "doc_id long, text string, runs string")
    got = periodic.find_runs(df).withColumn("best", periodic.strongest("runs")).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        want = sorted(brute_runs(words)) if len(words) < 6000 else [(0, 12, 3)]
        want = sorted(want, key=lambda x: (x[0], x[2]))
        assert r.n_words == len(words) and [(x.start, x.length, x.period) for x in r.runs] == want
        dropped = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in dropped)
        assert (r.best is None) == (not want)
        if want:
            assert (r.best.start, r.best.length, r.best.period) == min(want, key=lambda x: (-x[1] / x[2], x[0], x[2]))
    assert periodic.find_runs(df.limit(0)).collect() == []


@pytest.mark.parametrize("repeats, least", [(2, 1), (2, 4), (3, 5), (5, 12)])
def test_runs_of_other_shapes(repeats, least):
    rng = random.Random(repeats)
    for _ in range(150):
        words = loops(rng)
        ids = np.unique(words, return_inverse=True)[1].astype(np.int64)
        if not len(ids):
            continue
        want = {}
        for q in range(1, len(words)):
            i = 0
            while i + q < len(words):
                j = i
                while j + q < len(words) and words[j] == words[j + q]:
                    j += 1
                if j - i + q >= max(least, repeats * q):
                    want.setdefault((i, j - i + q), q)
                i = j + 1
        assert periodic.runs_of(ids, np.r_[-1, ids[:-1]], repeats, least) == want


def test_long_runs_take_linear_work():
    for words in (np.zeros(300_000, np.int64), np.arange(300_000) % 2, np.arange(300_000) % 701):
        assert list(periodic.runs_of(words, np.r_[-1, words[:-1]], 4, 6)) == [(0, 300_000)]
