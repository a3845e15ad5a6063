"""Each operator by brute force, and on nulls, empty and long texts, ties, repeats, empty tables and
clashing columns."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablekit.llm import chat, decontaminate, hamming, language, licences, minhash, mixing, pii, quality, warc
from tablekit.llm.base import text_sample
from tablekit.llm.words import word_slices

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def made_up(rng, n, alphabet=400):
    return " ".join(f"w{rng.randrange(alphabet)}é" if rng.random() < 0.2 else f"W{rng.randrange(alphabet)}" for _ in range(n))


def test_samples_of_texts(spark):
    rows = [(f"t{i % 40}", "ab"[i % 2]) for i in range(400)] + [("hot", "a")] * 300
    df = spark.createDataFrame(rows, "text string, lang string")
    some = [r.text for r in text_sample(df, 10).collect()]
    assert len(some) == len(set(some)) == 10 and sorted(some) == sorted(r.text for r in text_sample(df.repartition(7), 10).collect())
    each = Counter(r.lang for r in text_sample(df, 15, "lang").collect())
    assert each == {"a": 15, "b": 15} and text_sample(df, 100).count() == 41
    assert text_sample(df.limit(0), 5).count() == 0 and text_sample(df.limit(0), 5, "lang").count() == 0


def test_words_of_bytes():
    texts = ["", None, "Zwei Wörter", "a", "a-b_c\x00D", "日本 x", " ", "end"]
    got = [w.text(int(w.first[i]), int(w.first[i + 1])).decode().split() for w in word_slices(pa.array(texts), 12) for i in range(w.hi - w.lo)]
    assert got == [words(t) for t in texts]


# 1 -----------------------------------------------------------------------------------------------


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            parent[find(j)] = find(i)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    return sorted((d, min(x for x in ids[find(i)] if x is not None) if sets[i] else d) for i, (d, _) in enumerate(rows))


def near_rows(seed=1):
    rng, rows = random.Random(seed), []
    for g in range(12):
        base = made_up(rng, rng.choice([3, 40, 120, 300])).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append(" ".join(copy))
    rows += [None, None, "", "...", "one", "ONE!", "one two"]
    return [(i, t) for i, t in enumerate(rows)]


def test_near_duplicates_by_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id) for r in minhash.near_duplicates(df).classes().collect())
    assert got == brute_classes(rows)


def test_links_that_no_leader_sees_are_found(spark):
    """Chains within large groups: neighbours are similar, ends aren't."""
    rng = random.Random(3)
    now, rows = [f"c{i}" for i in range(100)], []
    for i in range(40):
        rows.append((i, " ".join(now)))
        now = [*now[2:], f"x{i}", f"y{i}"]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id) for r in minhash.near_duplicates(df).classes().collect())
    assert got == brute_classes(rows)


def test_one_of_each_class_stays(spark):
    rows = near_rows(5) + [(0, near_rows(5)[0][1]), (1000, None)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, h1 int, _id string, node int")
    kept = minhash.near_duplicates(df).keep_one(df)
    assert kept.columns == df.columns
    want = {d for d, c in brute_classes(rows) if d == c and shingle_set(dict(rows)[d])}
    got = [r.doc_id for r in kept.collect() if shingle_set(r.text)]
    assert sorted(got) == sorted(want)
    assert sum(not shingle_set(t) for _, t in rows) == sum(not shingle_set(r.text) for r in kept.collect())


def test_an_id_given_to_two_texts(spark):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "a b c d e f g"), (1, "h i j k l m n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = minhash.near_duplicates(df).keep_one(df)
    assert sorted(map(tuple, kept.collect())) == sorted(set(rows[:2]))


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    found = minhash.near_duplicates(df)
    assert found.classes().count() == 0 and found.keep_one(df).count() == 0


def test_weighted_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    e = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    row, both = np.repeat([0, 1], 300), np.r_[e, e]
    same = [np.mean(np.equal(*minhash.dart_signatures(row, both, np.r_[a, b], 2, 128, seed))) for seed in range(1, 21)]
    assert abs(np.mean(same) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


# 2 -----------------------------------------------------------------------------------------------


def brute_hits(text, items, width=13):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        size = min(width, len(v))
        wins = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if size else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(w), len(hit), sorted(x for x in found if x is not None)


@pytest.mark.parametrize("table_windows", [500_000, 3])
def test_decontamination_by_brute_force(spark, table_windows):
    rng = random.Random(2)
    items = [(i, made_up(rng, n, 30)) for i, n in enumerate([40, 13, 14, 5, 1, 20])]
    items += [(6, None), (7, "..."), (0, items[0][1]), (None, made_up(rng, 15, 30))]
    docs = [(i, made_up(rng, 60, 30)) for i in range(6)]
    docs += [(6, None), (7, ""), (8, items[0][1]), (9, "x " + items[1][1].upper() + " " + items[9][1]), (10, items[3][1] * 50)]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(*x, "old") for x in docs], "doc_id long, text string, n_words string")
    found = decontaminate.scan(d, decontaminate.benchmark_windows(b), table_windows=table_windows)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in found.collect()}
    assert got == {i: brute_hits(t, items) for i, t in docs}
    clean = {r.doc_id: r.text for r in decontaminate.remove(found, spans_only=True).collect()}
    for i, t in docs:
        n, hit, _ = brute_hits(t, items)
        assert len(words(clean[i])) == n - hit
    left = {r.doc_id for r in decontaminate.remove(found).collect()}
    assert left == {i for i, t in docs if not (brute_hits(t, items)[1] and 20 * brute_hits(t, items)[1] >= brute_hits(t, items)[0])}


def test_empty_benchmark(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    got = decontaminate.scan(d, decontaminate.benchmark_windows(b)).collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == [(3, 0, []), (0, 0, [])]


# 3 -----------------------------------------------------------------------------------------------


def contexts_of(texts):
    """Per context of up to three bytes, how often each byte follows."""
    counts = {}
    for t in texts:
        b = [0, 0, 0, *t.encode()]
        for i in range(3, len(b)):
            for o in range(4):
                counts.setdefault(tuple(b[i - o : i]), Counter())[b[i]] += 1
    return counts


def slow_bits(text, lang, trees, min_count):
    """Prediction by partial matching as its definition has it. A context is in the tree if some language
    has seen it ``min_count`` times; bytes that none has seen are one byte, 0."""
    seen = {x for tree in trees.values() for counter in tree.values() for x in counter} | {0}
    b = [x if x in seen else 0 for x in [0, 0, 0, *text.encode()]]
    total = 0.0
    for i in range(3, len(b)):
        order = 3
        while order and max(sum(tree.get(tuple(b[i - order : i]), {}).values()) for tree in trees.values()) < min_count:
            order -= 1
        left, out, p = 1.0, set(), None
        for k in range(order, -1, -1):
            free = {s: n for s, n in trees[lang].get(tuple(b[i - k : i]), {}).items() if s not in out}
            if free:
                n, q = sum(free.values()), len(free)
                if b[i] in free:
                    p = left * free[b[i]] / (n + q)
                    break
                left *= q / (n + q)
                out |= set(free)
        total -= math.log2(p if p is not None else left / (256 - len(out)))
    return total


def test_code_lengths_by_definition():
    train = {"x": ["abracadabra abra", "cadabra"], "y": ["banana bandana", "cabana ananas"]}
    texts = ["abra banana", "zzz", "", "c", "dabra, ananas"]
    rows = []
    for lang, some in train.items():
        batch = pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some)], names=["lang", "text"])
        rows += zip(*(c.to_pylist() for c in next(language._count_grams(iter([batch]))).columns))
    model = language.compile_model(rows, 2)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    got = model.lengths(data, np.cumsum([0] + [len(t.encode()) for t in texts]))
    trees = {lang: contexts_of(some) for lang, some in train.items()}
    for i, t in enumerate(texts):
        for j, lang in enumerate(model.languages):
            assert got[i, j] == pytest.approx(slow_bits(t, lang, trees, 2), abs=1e-3)


def test_language_of_odd_texts(spark):
    train = [(i, "the cat and the dog", "en") for i in range(9)] + [(20 + i, "der Hund und die Katze", "de") for i in range(9)]
    train += [(50, None, "en"), (51, "x", None)]
    model = language.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "123 !?", 0.5), (4, "the dog", 0.5), (5, "die Katze", 0.5), (6, "the dog " * 30000, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["und", "und", "und", "en", "de", "en"]
    assert got[1][1] == 0.0
    none = language.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert none is None and {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_languages_learn_from_as_many_texts_as_documented(monkeypatch, spark):
    asked = []
    monkeypatch.setattr(language, "text_sample", lambda rows, n, group: asked.append(n) or rows)
    language.train(spark.createDataFrame([("en", "a few words")], "lang string, text string"))
    assert asked == [2000]


# 4 -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, postfix, allowed",
    [
        ("MIT", ["MIT"], True),
        ("MIT OR GPL-3.0-only AND Apache-2.0", ["MIT", "GPL-3.0-only", "Apache-2.0", "and", "or"], True),
        ("(MIT OR GPL-3.0-only) AND GPL-2.0-or-later", ["MIT", "GPL-3.0-only", "or", "GPL-2.0-or-later", "and"], False),
        ("Apache-2.0 WITH LLVM-exception or GPL-2.0", ["Apache-2.0", "LLVM-exception", "with", "GPL-2.0", "or"], True),
        ("MIT and other words", ["MIT"], True),
        ("MIT)", ["MIT"], True),
        ("(MIT", ["MIT"], True),
        ("((GPL-2.0", ["GPL-2.0"], False),
        ("(see below", None, None),
        ("AND MIT", None, None),
        ("", None, None),
        ("() MIT", None, None),
    ],
)
def test_expressions(text, postfix, allowed):
    assert licences.read_expression(text) == postfix
    if postfix:
        assert licences.permitted(postfix) is allowed


def test_licence_tags_and_odd_texts(spark):
    rows = [
        (1, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only)\ncode"),
        (2, None),
        (3, ""),
        (4, "Under the MIT-license, under the mit LICENSE. CC-BY-NC"),
        (5, "spdx license identifier"),
        (6, "word " * 50000 + "Apache License, Version 2.0"),
        (4, "Under the MIT-license, under the mit LICENSE. CC-BY-NC"),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, labels int")
    got = {r.doc_id: r for r in licences.scan_licences(df).collect()}
    assert got[1].labels == ["gpl-2", "mit"] and got[1].expressions[0].permitted
    assert got[2].labels == [] and got[2].score == 0 and got[3].n_words == 0
    assert [(b.label, b.word) for b in got[4].base] == [("mit", 0), ("mit", 4), ("cc-by-nc", 8)]
    assert got[5].labels == [] and got[6].base[0].word == 50000
    assert licences.scan_licences(df.limit(0)).count() == 0


def test_expressions_with_long_lines_and_of_any_length():
    a = licences.automaton()
    for rest in ("", " word" * 3, " word" * 5000):
        _, _, _, found, score = licences.scan_text(b"SPDX-License-Identifier: MIT" + rest.encode(), a)
        assert found == [("MIT", "mit", True)] and score == pytest.approx(0.95)
    _, _, _, found, _ = licences.scan_text("é SPDX-License-Identifier: MIT\nOR GPL-2.0 é".encode(), a)
    assert found == [("MIT", "mit", True)]
    long = licences.read_expression("MIT OR LicenseRef-0" + "".join(f" OR LicenseRef-{i}" for i in range(1, 20_000)))
    assert len(long) == 40_001 and len(licences.licences_in(long)) == 20_001 and licences.permitted(long)
    assert licences.licences_in(["GPL-2.0", "Classpath-exception-2.0", "with", "MIT", "or"]) == {"gpl-2", "mit"}


@pytest.mark.parametrize(
    "text, postfix, allowed",
    [
        ("(MIT OR BSL-1.0)", ["MIT", "BSL-1.0", "or"], True),
        ("MIT AND GPL-1.0-only", ["MIT", "GPL-1.0-only", "and"], False),
        ("Apache-2.0 AND MPL-1.1 */", ["Apache-2.0", "MPL-1.1", "and"], False),
        ("MIT and CC-BY-3.0", ["MIT", "CC-BY-3.0", "and"], False),
        ("MIT AND Ruby", ["MIT", "Ruby", "and"], False),
        ("(MIT or Ruby) and more", ["MIT", "Ruby", "or"], True),
        ("MIT and (well known) words", ["MIT"], True),
        ("MIT AND (Ruby OR (PHP AND Zlib)) more", ["MIT", "Ruby", "PHP", "Zlib", "and", "or", "and"], False),
        ("MIT AND (BSL-1.0", ["MIT", "BSL-1.0", "and"], False),
        ("(MIT OR BSL-1.0, or", ["MIT", "BSL-1.0", "or"], True),
        ("(MIT and other words", ["MIT"], True),
        ("((MIT or Ruby) and other words", ["MIT", "Ruby", "or"], True),
        ("(MIT OR Ruby and other words", ["MIT", "Ruby", "or"], True),
        ("MIT OR Apache-2.0.", ["MIT", "Apache-2.0.", "or"], True),
        ("GPL-2.0 AND MIT with and", ["GPL-2.0", "MIT", "and"], False),
        ("MIT OR ()", ["MIT"], True),
        ("MIT OR AND", ["MIT"], True),
    ],
)
def test_expressions_of_any_names(text, postfix, allowed):
    assert licences.read_expression(text) == postfix
    if postfix:
        assert licences.permitted(postfix) is allowed
        assert not any(x.endswith(".") for x in licences.licences_in(postfix))


def test_base_finds_take_part_in_the_longest_match():
    a = licences.automaton()
    n, base, notices, _, score = licences.scan_text(b"CC BY-NC, and cc by sa; cc by too", a)
    assert base == [("cc-by-nc", 0)] and notices == [("cc-by", 7), ("cc-by-sa", 4)] and n == 10
    assert licences.scan_text(b"cc by nc", a)[4] == pytest.approx(0.9)
    assert licences.judged([("cc-by-nc", 0)], [], []) == (False, 0.0)
    assert licences.judged([], [], [("MIT", "mit", True)]) == (True, pytest.approx(0.95))
    assert licences.judged([], [], [("Ruby MIT or", "mit,ruby", True)])[1] == pytest.approx(0.7)
    assert licences.judged([("mit", 0)], [("gpl", 3)], []) == (False, pytest.approx(0.9 * 0.3)) and licences.judged([], [], []) == (None, 0.0)


def test_licence_finds_by_brute_force():
    rng, a = random.Random(7), licences.automaton()
    vocabulary = sorted({w for p in [*licences.BASE, *licences.NOTICES, licences.TAG] for w in p.split()}) + ["x"]
    phrases = [p.split() for p in [*licences.BASE, *licences.NOTICES, licences.TAG]]
    for _ in range(200):
        text = [w for _ in range(rng.randrange(12)) for w in (rng.choice(phrases) if rng.random() < 0.5 else [rng.choice(vocabulary)])]
        want = sorted((i, " ".join(p)) for p in phrases for i in range(len(text)) if text[i : i + len(p)] == p)
        assert sorted(a.find([w.encode() for w in text])) == want


def test_licence_scan_takes_linear_time():
    import time

    start = time.perf_counter()
    n, base, notices, _, _ = licences.scan_text(b"cc by nc " * 80_000, licences.automaton())
    assert time.perf_counter() - start < 1 and len(base) == 80_000 and not notices and n == 240_000


def test_kept_columns_named_like_results(spark):
    names = "_text string, lang_pred string, score int, _letters int, `labels` int, `a.b` int, text string"
    df = spark.createDataFrame([("t", "p", 1, 2, 3, 4, "ein Text, under the mit license")], names)
    model = language.train(spark.createDataFrame([("ein Text", "de")], "text string, lang string"))
    keep = tuple(df.columns)
    for found in (language.identify(df, model, keep=keep), language.identify(df, None, keep=keep), licences.scan_licences(df, keep=keep)):
        row = found.first()
        assert len(set(found.columns)) == len(found.columns) and row["_text"] == "t" and row["a.b"] == 4 and row["_letters"] == 2
    assert licences.scan_licences(df, keep=keep).first()["labels"] == ["mit"]
    scored = quality.score_quality(df, quality.Network.fresh(1), keep=keep).first()
    assert 0 < scored["score"] < 1 and scored["lang_pred"] == "p"


# 5 -----------------------------------------------------------------------------------------------


def fill(budget, caps, weights):
    """Water filling by bisection-free rounds: who is full leaves, the rest share again."""
    got, open_ = {}, set(caps)
    while open_:
        w = sum(weights[k] for k in open_)
        full = {k for k in open_ if caps[k] * w <= (budget - sum(got.values())) * weights[k]}
        if not full:
            left = budget - sum(got.values())
            return got | {k: left * weights[k] // w for k in open_}
        got |= {k: caps[k] for k in full}
        open_ -= full
    return got


def test_budgets_by_rounds(spark):
    rng = random.Random(4)
    leaves = [(d, s, rng.randrange(1, 2000)) for d in "abc" for s in "pqrst"]
    df = spark.createDataFrame(leaves, "d string, s string, available long")
    weights = {"d": {"a": 5, "b": 1}, "s": {"p": 3, "q": 2}}
    for budget in (0, 1000, 9000, 30000, 10**6):
        got = {(r.d, r.s): r.granted for r in mixing.leaf_budgets(df, ["d", "s"], budget, weights, epochs=2).collect()}
        caps = {d: sum(2 * n for x, _, n in leaves if x == d) for d in "abc"}
        top = fill(budget, caps, {d: weights["d"].get(d, 1) for d in caps})
        for d in caps:
            own = {s: 2 * n for x, s, n in leaves if x == d}
            want = fill(top[d], own, {s: weights["s"].get(s, 1) for s in own})
            assert {s: got[d, s] for s in own} == want


def test_mixture_of_odd_rows(spark):
    rows = [(i, "x" * 40, None if i % 3 else "s", "en") for i in range(30)] + [(100, None, "s", "en"), (101, "", "s", None), (5, "x" * 40, None, "en")]
    df = spark.createDataFrame([(*r, "mine", 7) for r in rows], "doc_id long, text string, source string, lang string, _key string, whole int")
    tokens = F.length(F.coalesce("text", F.lit("")))
    out = mixing.mix_sources(df, {c: F.col(c) for c in ("lang", "source")}, {"source": {"s": 2}}, tokens, budget=900)
    assert out.columns == [*df.columns, "n_tokens", "repeats"]
    got = out.collect()
    assert {r._key for r in got} == {"mine"} and sum(r.n_tokens * r.repeats for r in got) <= 900
    by = Counter()
    for r in got:
        by[r.source] += r.n_tokens * r.repeats
    assert by["s"] == 600 and by[None] in (280, 240)
    assert mixing.mix_sources(df.limit(0), {"lang": F.col("lang")}, {}, tokens).count() == 0


# 6 -----------------------------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    mark = "\r\n\r\nWARC/1.1\r\n"
    pages = [
        (1, "http://a", "x" * 200),
        (2, None, "x" * 200),
        (3, "http://a", mark * 30 + "é"),
        (4, "u\r\nInjected: 1", None),
        (5, "v", ""),
        (6, "v", "short"),
        (7, "v", "short"),
        (8, "w", "ü" * 300_000 + mark + "\r\n\r\n"),
        (0, "w", "ü" * 300_000 + mark + "\r\n\r\n"),
        (1, "http://a", "x" * 200),
        (None, "n", "x" * 200),
    ]
    df = spark.createDataFrame([(*p, "old") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    path = str(tmp_path / "w")
    warc.write_warc(df, path, chunk_bytes=1000)
    chunks = warc.read_warc(spark, path)
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] <= 1000
    got = warc.records(chunks).collect()
    assert len(got) == len(pages) and all(r.intact for r in got)
    want = Counter((p, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for p, _, h in pages)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
    refers = sorted((str(r.page_id), r.refers_to) for r in got if r.record_type == "revisit")
    assert refers == [("1", 1), ("2", 1), ("8", 0), ("None", 1)]
    text = b"".join(bytes(r.data) for r in chunks.where("page_id = 3 or record_id like 'urn:record:3:%'").orderBy("chunk_no").collect())
    assert text.decode() == pages[2][2]


def test_payloads_that_meet_the_mark_and_changed_payloads(spark, tmp_path):
    from tablekit.llm import queries

    mark = "\r\n\r\nWARC/1.1\r\n"
    texts = [mark[:-2], mark[2:], mark[4:], mark[4:-2], "a" + mark[:-2] * 3, mark[4:] + "b" + mark[:-2], "\r\n", "x" * 88 + mark[:-2] + "y" * 50, "x" * 2500]
    df = spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(df, str(tmp_path / "w"), chunk_bytes=100)
    chunks = warc.read_warc(spark, str(tmp_path / "w"))
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.verified(warc.records(chunks)).collect()}
    assert got == {i: (len(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts)}
    for page, old in ((6, "0D0A"), (8, "78")):
        hit = (F.col("record_id").startswith(f"urn:record:{page}:")) & (F.col("chunk_no") == 0)
        changed = chunks.withColumn("data", F.when(hit, F.unhex(F.regexp_replace(F.hex("data"), f"^{old}", "41"))).otherwise(F.col("data")))
        with pytest.raises(Exception, match="payload differs"):
            warc.verified(warc.records(changed)).select("payload_digest").collect()
    df.write.parquet(str(tmp_path / "pages.parquet"))
    plan = queries.op6_warc(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "payload differs" in plan and "sha2" in plan


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(df, str(tmp_path / "w"))
    assert warc.records(warc.read_warc(spark, str(tmp_path / "w"))).count() == 0


# 7 -----------------------------------------------------------------------------------------------


def test_patterns_against_plain_regular_expressions():
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice("a1.@+- ()2%_\n0é") for _ in range(60))
        emails = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        ips = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        got = pii.base_spans(t)
        assert [s[1:] for s in got if s[0] == "email"] == emails and [s[1:] for s in got if s[0] == "ip"] == ips


def sums_by_hand(by_start, n, at=0):
    """All segmentations of the tokens from ``at``: (score, segments)."""
    if at == n:
        yield 0.0, ()
        return
    for s, rest in sums_by_hand(by_start, n, at + 1):
        yield s, rest
    for j, _, scores in by_start[at]:
        for k, x in zip(pii.KINDS, scores):
            for s, rest in sums_by_hand(by_start, n, j):
                yield s + x, ((k, at, j), *rest)


def test_segmentations_by_enumeration():
    crf = pii.Field({("phone", "bias"): 0.7, ("phone", "abroad"): 1.1, ("card", "digits=8"): 0.4, ("ip", "dots=3"): 2.0})
    for text in ("+1 234 5678", "10.0.0.1 12345678", "a.b@c.d 1234567"):
        for tokens in pii.regions(text):
            by_start, n = crf.lattice(text, tokens), len(tokens)
            every = list(sums_by_hand(by_start, n))
            forward, backward = pii.sums(by_start, n)
            total = math.log(sum(math.exp(s) for s, _ in every))
            assert forward[n] == pytest.approx(total) and backward[0] == pytest.approx(total)
            at = {tuple(sorted((k, tokens[i][0], tokens[j - 1][1]) for k, i, j in some)): s for s, some in every}
            assert at[tuple(sorted(crf.decode(text, tokens, 0.0)))] == pytest.approx(max(every)[0])


def test_field_learns_and_masks(spark):
    rng = random.Random(7)
    rows = [(i, f"word call +{rng.randrange(1, 9)} ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)} or mail ann{i}@site{i % 7}.example.org soon 10.{i % 250}.3.4 end") for i in range(120)]
    rows += [(200, None), (201, ""), (202, "Reach me: 001 (743) 555-3824 thanks"), (203, "plain text 12 of 2020"), (204, "x" * 200_000 + " 1.2.3.4"), (204, "x" * 200_000 + " 1.2.3.4")]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, spans string")
    crf = pii.train(df)
    got = {r.doc_id: r for r in pii.find_personal_data(df, crf, mask=True).collect()}
    assert [s.kind for s in got[202].spans] == ["phone"] and got[202].base == []
    assert got[202].text == "Reach me: [PHONE] thanks"
    assert got[200].text is None and got[201].text == "" and got[203].text == "plain text 12 of 2020"
    assert got[204].text.endswith(" [IP]") and got[0].text == "word call [PHONE] or mail [EMAIL] soon [IP] end"
    empty = pii.find_personal_data(df.limit(0), pii.train(df.limit(0)))
    assert empty.count() == 0


def test_marks_and_words_between_blanks_are_scored():
    rng = random.Random(3)
    texts = [f"word call +{rng.randrange(1, 9)} ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)} or mail ann{i}.b@site{i % 7}.example.org soon in {1980 + i % 9} - {1990 + i % 9}" for i in range(120)]
    crf = pii.fit(texts)

    def found(text):
        return [(k, text[a:b]) for k, a, b in pii.all_spans(text, crf)[1]]

    for phone in ("0049 - 30 - 1234567", "0049 / 30 / 1234567"):
        assert found(f"call {phone} now") == [("phone", phone)]
    for email in ("john [at] example.com", "john.doe @ mail.example.com", "ann1 @ site1.example.org"):
        assert found(f"mail {email} or") == [("email", email)]
    for text in ("meet @ noon 5", "see you [at] home now", "in 2019 - 2020 we saw", "x\n@\ny.z"):
        assert found(text) == []


def test_regions_hold_each_token_once():
    r = random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice(["a", "1", ".", "@", "[at]", "(at)", " ", " ", "-", "[", "]", "(", "\n", "é"]) for _ in range(30))
        spans = [s for tokens in pii.regions(t) for s in tokens]
        assert all(a < b and b <= c for (a, b), (c, _) in itertools.pairwise(spans + [(len(t), len(t) + 1)]))
        at = {i for a, b in spans for i in range(a, b)}
        assert all(at.issuperset(range(*m.span())) for m in pii._TRIGGER.finditer(t))


# 8 -----------------------------------------------------------------------------------------------


def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 896, 5000):
        data = np.arange(n) % 251
        x, row = quality.chunks(data.astype(np.uint8), np.array([0, n, n]))
        covered = set()
        for no, c in enumerate(x[row == 0]):
            at = no * quality.HOP
            for i in np.flatnonzero(c):
                assert c[i] == data[at + i] + 1
                covered.add(at + i)
        assert covered == set(range(n)) and (row == 1).sum() == 1


def test_gradients_by_differences():
    net = quality.Network.fresh(0)
    data = np.random.default_rng(1).integers(0, 256, 2000).astype(np.uint8)
    x, row = quality.chunks(data, np.array([0, 700, 2000]))
    y = np.array([1, 0], np.float32)
    g = net.gradients(x, row, y)

    def loss():
        s = net.score(data, np.array([0, 700, 2000]))
        return -np.mean(np.where(y == 1, np.log(s), np.log(1 - s)))

    for k in ("v", "c", "w", "b", "emb"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, h = net.p[k][at], 1e-2
        net.p[k][at] = old + h
        up = loss()
        net.p[k][at] = old - h
        down = loss()
        net.p[k][at] = old
        assert (up - down) / (2 * h) == pytest.approx(float(g[k][at]), rel=0.1, abs=1e-4)


def test_quality_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (3, "x" * 100_000, 5.0)], "doc_id long, text string, score double")
    net = quality.fit([b"good text", b"%%%% $$$$"] * 20, [1, 0] * 20, steps=30)
    got = {r.doc_id: r.score for r in quality.score_quality(df, net).collect()}
    assert got[1] == got[2] and all(0 <= s <= 1 for s in got.values())
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (7, 1)], "doc_id long, label int")
    assert quality.train(df, labels.limit(0)) is None and quality.train(df.limit(0), labels) is None
    assert quality.train(df.where("doc_id < 3"), labels) is None  # a null text, and no label
    assert {r.score for r in quality.score_quality(df, None).collect()} == {0.5}
    assert quality.score_quality(df.limit(0), net).count() == 0


# 9 -----------------------------------------------------------------------------------------------


def test_windows_keep_budget_and_mask(spark):
    rng = random.Random(9)
    rows = []
    for c in range(8):
        if c % 2:
            rows.append((c, 0, "system", "be <nice> \\b"))
        for t in range(1, rng.randrange(2, 40)):
            rows.append((c, t, "assistant" if t % 2 else "user", made_up(rng, rng.randrange(0, 60))))
    rows += [(90, 0, "assistant", "y" * 9000), (90, 1, "user", None), (90, 2, None, "</turn>\n<turn user>"), (None, None, "user", "hi"), (91, 5, "user", "a"), (91, 5, "user", "a"), (91, None, "assistant", "b")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "conv_id long, turn long, role string, text string, window int")
    budget, history = 300, 60
    out = chat.format_conversations(df, budget, history)
    got = out.orderBy("conv_id", "window").collect()
    for r in got:
        assert r.n_tokens <= budget or r.n_turns - r.n_repeated == 1
        for s in r.loss:
            assert r.formatted[: s.start].rpartition("<turn ")[2] == "assistant>"
            assert r.formatted[s.start + s.length :].startswith("</turn>\n")
    per = {r.conv_id: r for r in chat.digest(out).collect()}
    groups = {}
    for c, t, role, text in rows:
        groups.setdefault(c, []).append((t is not None, t, role or "", text or ""))
    for c, some in groups.items():
        some.sort(key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        told = "".join(f"{role}\n{text}\n" for *_, role, text in some)
        loss = "".join(text for *_, role, text in some if role == "assistant")
        assert per[c].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert per[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert (per[c].n_turns, per[c].loss_chars) == (len(some), len(loss))
    later = [r for r in got if r.conv_id == 1 and r.window > 0]
    assert later and all(r.formatted.startswith("<turn system>be \\lnice\\g \\bb</turn>\n") for r in later)
    assert any(r.n_repeated > 1 for r in later)
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_has_no_python_in_its_plan(spark):
    df = spark.createDataFrame([(1, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.digest(chat.format_conversations(df))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 10 ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("part_rows", [200_000, 30])
def test_nearest_codes_by_brute_force(spark, part_rows):
    rng = random.Random(10)
    codes = [(i, rng.getrandbits(12) if i % 3 else rng.choice([5, 6, -1])) for i in range(80)]
    codes += [(150, None), (None, 4), (3, codes[3][1])]
    index = spark.createDataFrame([(*c, 1) for c in codes], "id long, code long, rank int")
    asked = [(i, c) for i, c in codes[:12]] + [(900, 0), (901, None), (None, 3), (900, 0)]
    queries = spark.createDataFrame(asked, "query_id long, code long")
    got = {}
    for r in hamming.top_k(index, queries, k=5, lead_bits=1, part_rows=part_rows).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.id))
    entries = {(i, c) for i, c in codes if i is not None and c is not None}
    want = {}
    for q, c in {x for x in asked if None not in x}:
        near = sorted(((c ^ x) & (2**64 - 1)).bit_count() * 1000 + i for i, x in entries)[:5]
        want[q] = [(n + 1, d // 1000, d % 1000) for n, d in enumerate(near)]
    assert {q: sorted(v) for q, v in got.items()} == want


def test_fewer_codes_than_asked_for(spark):
    index = spark.createDataFrame([(1, 7), (2, -8)], "id long, code long")
    q = spark.createDataFrame([(1, 7)], "query_id long, code long")
    assert [(r.rank, r.id, r.distance) for r in hamming.top_k(index, q, lead_bits=0).orderBy("rank").collect()] == [(1, 1, 0), (2, 2, 64)]
    assert hamming.top_k(index.limit(0), q, lead_bits=0).count() == 0
    assert hamming.top_k(index, q.limit(0), lead_bits=0).count() == 0


def test_sign_codes(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.5],), ([],), (None,)], "e array<double>")
    assert [r[0] for r in df.select(hamming.sign_code(F.col("e"))).collect()] == [5, 0, None]


def test_sign_codes_of_wide_vectors_raise(spark):
    df = spark.createDataFrame([([1.0] * 64,), ([1.0] * 65,)], "e array<double>")
    codes = df.select(hamming.sign_code(F.col("e")))
    assert codes.limit(1).first()[0] == -1
    with pytest.raises(Exception, match="more than 64 components"):
        codes.collect()


def test_archives_of_text_ids(spark, tmp_path):
    rows = [("a:b>", "u", "x" * 200), ("a:b>c#\n", "u", "x" * 200), (None, "u", "short"), ("7", "u", "x" * 200), ("é", "u", None)]
    warc.write_warc(spark.createDataFrame(rows, "page_id string, url string, html string"), str(tmp_path / "w"))
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.verified(warc.records(warc.read_warc(spark, str(tmp_path / "w"), "string"))).collect()}
    assert got == {
        "7": ("response", None, 200),
        "a:b>": ("revisit", "7", 200),
        "a:b>c#\n": ("revisit", "7", 200),
        None: ("response", None, 5),
        "é": ("response", None, 0),
    }


def test_benchmark_items_of_text_ids(spark):
    b = spark.createDataFrame([("q/2", "one two three"), ("q/10", "three four"), (None, "five")], "item_id string, text string")
    d = spark.createDataFrame([(1, "one two three four five"), (2, "six")], "doc_id long, text string")
    for windows in (500_000, 1):
        found = decontaminate.scan(d, decontaminate.benchmark_windows(b), table_windows=windows)
        assert {r.doc_id: (r.n_hit, r["items"]) for r in found.collect()} == {1: (5, ["q/10", "q/2"]), 2: (0, [])}


def test_regions_reach_to_the_blanks_however_far():
    long = "x" * 300 + "@" + "y" * 400 + ".com"
    for text in (long, f"a {long} b", f"one\n{long}\ntwo", "z" * 5000 + "1" * 9, "w" * 200 + " [at] " + "v" * 200 + ".org"):
        found = [(r[0][0], r[-1][1]) for r in pii.regions(text)]
        for m in re.finditer(r"[^\x00-\x20]+", text):
            if re.search(r"[0-9@]|\[at\]", m[0]):
                assert any(a <= m.start() and m.end() <= b for a, b in found), (text[:20], found)
    (whole,) = pii.regions("w" * 200 + " [at] " + "v" * 200 + ".org")
    assert (whole[0][0], whole[-1][1]) == (0, 410)


def test_long_runs_are_decoded_in_linear_time():
    import time

    crf = pii.Field()
    start = time.time()
    for text in ("1" * 300_000, "a1" * 100_000, "1." * 20_000, "@" * 20_000):
        pii.all_spans(text, crf)
    assert time.time() - start < 60
