"""The queries that have SQL, against DuckDB, and the contracts of the others on a small table."""

import hashlib
import zlib
from fractions import Fraction

import pytest

from tablekit.llm.queries import ORACLES, QUERIES
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    ok, note = compare(spark, con, SF, QUERIES[name], ORACLES[name])
    assert ok, note


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_language_is_learned_from_the_other_folds(spark, con):
    rows = QUERIES["op3_language"](spark, SF).collect()
    lang = dict(con.sql("SELECT doc_id, lang FROM documents").fetchall())
    assert {r.doc_id for r in rows} == set(lang) and len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_beats_the_majority(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op8_quality"](spark, sf).collect()
    label = dict(duck(sf).sql("SELECT doc_id, quality FROM labels").fetchall())
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    good, bad = ([r.score for r in held if label[r.doc_id] == y] for y in (1, 0))
    pairs = [(g > b) + 0.5 * (g == b) for g in good for b in bad]
    assert sum(pairs) / len(pairs) > 0.9


def test_personal_data_contract(spark, con):
    import re

    from tablekit.llm.pii import luhn

    text = dict(con.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    for r in QUERIES["op7_personal_data"](spark, SF).collect():
        found = []
        t = text[r.doc_id]
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
            found.append(("email", *m.span()))
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
            if all(int(x) <= 255 for x in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
            if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                found.append(("phone", *m.span()))
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        counts = [sum(k == x for k, *_ in found) for x in ("email", "ip", "card", "phone")]
        assert counts == [r.n_email, r.n_ip, r.n_card, r.n_phone]
        assert set(told.split(",")) - {""} <= set(r.spans.split(","))


def test_licence_contract(spark, con):
    import re

    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    text = dict(con.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    for r in QUERIES["op4_licences"](spark, SF).collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text[r.doc_id])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, k) for p, k in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts, labels = [i for i, _ in at], sorted({k for _, k in at})
        assert (r.n_words, r.n_base) == (len(words), len(at))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if at else (None, None))
        assert r.base_labels == ",".join(labels)
        assert set(labels) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def test_periodic_run_contract(spark, con):
    import re

    text = dict(con.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    rows = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert set(rows) == set(text)
    for d, r in rows.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text[d])
        h, n = zlib.crc32(str(d).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        dropped = {i for s, k, q in runs for i in range(s + q, s + k)}
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
