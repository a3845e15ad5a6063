"""The pipeline, stage by stage, on documents with known faults."""

import random

import corpus_pipeline
from tablekit.llm import queries


def words(rng, n):
    return " ".join(rng.choice(["the", "then", "there", "other", "with", "from", "this", "that", "tion"]) + rng.choice("abcdefgh") for _ in range(n))


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near duplicates", "decontamination", "personal data", "mixture"]


def test_every_decision_takes_effect(spark, tmp_path):
    rng = random.Random(1)
    passage = words(rng, 40)
    docs = [(i, words(rng, 80), "en", f"s{i % 3}", 0, "kept") for i in range(40)]
    docs += [
        (100, docs[0][1], "en", "s0", 0, "copy"),
        (101, docs[1][1] + " extra", "en", "s0", 0, "near"),
        (102, words(rng, 20) + " " + passage, "en", "s1", 0, "leak"),
        (103, None, "en", "s1", 0, "null"),
        (104, "12 + 34", None, None, 0, "no letters"),
        (105, words(rng, 60) + " mail a.b@example.org today", "en", "s2", 0, "private"),
    ]
    sf = str(tmp_path)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, spans string")
    d.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    left = d
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, sf)
        assert left.columns == d.columns and left.schema == d.schema
        seen.append({r.doc_id for r in left.collect()})
    every = {x[0] for x in docs}
    assert seen == [every - {103, 104}, every - {103, 104, 100, 101}, every - {103, 104, 100, 101, 102}, every - {103, 104, 100, 101, 102}]
    rows = {r.doc_id: r for r in left.collect()}
    assert rows[105].text.endswith(" mail [EMAIL] today") and rows[105].n_chars == len(rows[105].text)
    assert rows[105].spans == "private" and rows[0].text == docs[0][1]
    mixed = corpus_pipeline.STAGES[-1][1](spark, left, sf).collect()
    total = sum((len(r.text.encode()) + 3) // 4 for r in rows.values())
    assert 0 < sum(r.n_tokens * r.repeats for r in mixed) <= total // 2
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == {r.doc_id for r in mixed}


def test_pipeline_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "repeats"]
    ids = [r.doc_id for r in got.collect()]
    assert ids and len(ids) == len(set(ids))
    assert {r.doc_id for r in queries.QUERIES["op2_decontaminate"](spark, sf).where("contaminated").collect()}.isdisjoint(ids)
