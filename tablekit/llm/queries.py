"""The training-data queries, a row set per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekit.llm import chat, decontaminate, hamming, infill, language, licences, minhash, mixing, periodic, pii, quality, repeats, warc
from tablekit.llm.base import ORACLES, QUERIES, held_out, query, shared_folder, table

__all__ = ["ORACLES", "QUERIES"]


def learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``documents`` that models may learn from."""
    return table(spark, sf_dir, "documents").where(~held_out(F.col("doc_id")))


def language_model(spark: SparkSession, sf_dir: str) -> language.Model | None:
    return language.train(learned(spark, sf_dir).select("doc_id", "text", "lang"))


@query("op1_minhash")
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).classes()


@query(
    "op2_decontaminate",
    r"""WITH w AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(words)) AS size, array_to_string(words[i:i + least(13, len(words)) - 1], ' ') AS win
 FROM (SELECT item_id, words, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
dw AS (SELECT doc_id, i, size, array_to_string(words[i:i + size - 1], ' ') AS win
 FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM d, sizes)),
hit AS (SELECT dw.doc_id, dw.i, iw.size, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.size = iw.size),
marks AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
 CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN marks ON d.doc_id = marks.doc_id LEFT JOIN its ON d.doc_id = its.doc_id""",
)
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = decontaminate.benchmark_windows(table(spark, sf_dir, "benchmark"))
    found = decontaminate.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), windows)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


@query("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents"), language_model(spark, sf_dir))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query("op4_licences")
def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        F.array_join("expressions.postfix", "; ").alias("expressions"),
        "permitted",
        "usable",
    )


#: whole-number weights of the mixture, by level; others have weight 1
MIX_WEIGHTS = {"domain": {"a": 3, "b": 2}, "lang": {"en": 4, "de": 2, "fr": 2}}


def mixed(docs: DataFrame) -> DataFrame:
    """Half of all tokens, a token per four bytes, each document at most four times. The table has no
    domain: sources are dealt to two by a hash."""
    first = F.substring(F.md5(F.coalesce("source", F.lit("")).cast("binary")), 1, 1)
    levels = {"domain": F.when(first < "8", "a").otherwise("b"), "lang": F.col("lang"), "source": F.col("source")}
    tokens = F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / F.lit(4))
    return mixing.mix_sources(docs, levels, MIX_WEIGHTS, tokens)


def _fill_sql(name: str, above: list[str], level: str, source: str, weight: str) -> str:
    keys = ", ".join([*above, level])
    part = f"PARTITION BY {', '.join(above)}" if above else ""
    got = f"JOIN {source} g USING ({', '.join(above)})" if above else f", {source} g"
    order = f"{part} ORDER BY CAST(cap AS DOUBLE) / w, {keys}"
    return f"""{name}_k AS (SELECT k.*, g.granted FROM (SELECT {keys}, CAST(sum(4 * available) AS BIGINT) AS cap, {weight} AS w
 FROM leaf GROUP BY {keys}) k {got}),
{name}_f AS (SELECT *, CAST(cap AS HUGEINT) * (sum(w) OVER ({part}) - coalesce(sum(w) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
 <= (granted - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS is_full FROM {name}_k),
{name} AS (SELECT {keys}, CAST(CASE WHEN is_full THEN cap ELSE
 floor(CAST(granted - coalesce(sum(cap) FILTER (is_full) OVER ({part}), 0) AS DOUBLE) * w / (sum(w) FILTER (NOT is_full) OVER ({part}))) END AS BIGINT) AS granted
 FROM {name}_f)"""


MIX_SQL = (
    """WITH t AS (SELECT doc_id, CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '8' THEN 'a' ELSE 'b' END AS domain,
 lang, source, CAST((strlen(text) + 3) // 4 AS BIGINT) AS n_tokens FROM documents WHERE strlen(text) > 0),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS available FROM t GROUP BY domain, lang, source),
b AS (SELECT CAST(sum(available) AS BIGINT) // 2 AS granted FROM leaf),
"""
    + _fill_sql("d1", [], "domain", "b", "CASE domain WHEN 'a' THEN 3 ELSE 2 END")
    + ",\n"
    + _fill_sql("d2", ["domain"], "lang", "d1", "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END")
    + ",\n"
    + _fill_sql("d3", ["domain", "lang"], "source", "d2", "1")
    + """,
p AS (SELECT domain, lang, source, granted // available AS whole, granted % available AS part FROM leaf JOIN d3 USING (domain, lang, source)),
x AS (SELECT t.*, whole, part, sum(n_tokens) OVER (PARTITION BY domain, lang, source
 ORDER BY md5('11:' || whole || ':' || doc_id), doc_id, n_tokens) AS run FROM t JOIN p USING (domain, lang, source))
SELECT doc_id, n_tokens, CAST(whole + CASE WHEN run <= part THEN 1 ELSE 0 END AS BIGINT) AS repeats FROM x
WHERE whole > 0 OR run <= part"""
)


@query("op5_mixing", MIX_SQL)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed(docs).select("doc_id", "n_tokens", "repeats")


@query(
    "op6_warc",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
l AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS lead FROM d)
SELECT page_id, payload_bytes, payload_digest,
 CASE WHEN payload_bytes >= 100 AND lead <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 100 AND lead <> page_id THEN lead END AS refers_to FROM l""",
)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.verified(warc.records(warc.read_warc(spark, path))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def personal_data_field(docs: DataFrame) -> pii.Field:
    return pii.train(docs.select("text"))


def _joined_spans(name: str):
    shown = F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(shown, ",")


@query("op7_personal_data")
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs, personal_data_field(docs))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined_spans("base"), 256).alias("base_sha256"), _joined_spans("spans").alias("spans"))


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(~held_out(F.col("doc_id")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, quality.train(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query(
    "op9_chat_windows",
    r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
k AS (SELECT *, CAST((strlen(text) + 3) // 4 + 4 AS BIGINT) AS tok, length(text) + length(text)
  - length(replace(replace(replace(text, '\', ''), '<', ''), '>', '')) AS len FROM t),
y AS (SELECT conv_id, arg_min(tok, turn) AS sys_tok, min(turn) AS sys_turn, arg_min(len, turn) AS sys_len
 FROM k WHERE role = 'system' GROUP BY conv_id),
b AS (SELECT k.*, sys_turn, sys_tok, sys_len, (2048 - 256 - coalesce(sys_tok, 0)) // 2 AS span,
 CAST(sum(tok) OVER (PARTITION BY k.conv_id ORDER BY k.turn) AS BIGINT) - tok AS bef
 FROM k LEFT JOIN y ON k.conv_id = y.conv_id),
p AS (SELECT *, bef // span * 2 + CAST(tok > span AS INT) AS key FROM b),
w AS (SELECT conv_id, key, max(bef + tok) AS until, min(turn) AS first_turn,
 row_number() OVER (PARTITION BY conv_id ORDER BY key) AS n FROM p GROUP BY conv_id, key),
x AS (SELECT p.*, w.until, w.n FROM p JOIN w ON p.conv_id = w.conv_id AND p.key = w.key),
rep AS (SELECT x.conv_id, sum(15 + x.len + length(x.role)) AS chars FROM x JOIN w ON x.conv_id = w.conv_id AND w.n = x.n + 1
 WHERE x.until - x.bef <= 256 AND NOT (x.role = 'system' AND x.turn = x.sys_turn) GROUP BY x.conv_id),
again AS (SELECT w.conv_id, sum(15 + 6 + y.sys_len) AS chars FROM w JOIN y ON w.conv_id = y.conv_id
 WHERE w.first_turn > y.sys_turn GROUP BY w.conv_id),
g AS (SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(15 + len + length(role)) AS own FROM k GROUP BY conv_id)
SELECT g.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
 CAST(own + coalesce(rep.chars, 0) + coalesce(again.chars, 0) AS BIGINT) AS formatted_chars
FROM g LEFT JOIN rep ON g.conv_id = rep.conv_id LEFT JOIN again ON g.conv_id = again.conv_id""",
)
def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    fixed = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    return chat.digest(chat.format_conversations(turns))


@query(
    "op10_hamming_top_k",
    """WITH c AS (SELECT vec_id, bit_or(CASE WHEN embedding[i] > 0 THEN CAST(1 AS UBIGINT) << (64 - i)
 ELSE CAST(0 AS UBIGINT) END) AS code FROM embeddings, range(1, 65) r(i) GROUP BY vec_id),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS id, CAST(bit_count(xor(q.code, c.code)) AS INT) AS distance
 FROM c q, c WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INT) AS rank, id, distance
FROM d QUALIFY rank <= 10""",
)
def op10_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign codes of the embeddings; queries are the rows whose id is divisible by 50, against all rows."""
    codes = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code")
    )
    queries = codes.where("id % 50 = 0").select(F.col("id").alias("query_id"), "code")
    return hamming.top_k(codes, queries, k=10)


@query(
    "op11_infill",
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || s[1:8] AS BIGINT) AS h1,
 CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
 CASE WHEN t = '' OR regexp_matches(t, '<P>|<S>|<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
 CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
 ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
)
def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@query("op12_suffix_repeats")
def op12_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return done.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the ids the words from one place on go round in a loop."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    split = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    g, n = F.floor(h / 10), F.size("words")
    a = F.when(n > 0, g % n).otherwise(0).cast("int")
    p = (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    block = F.slice("words", F.col("a") + 1, p)
    rest = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - F.col("a")) / p).cast("int"))), F.lit(1), n - F.col("a"))
    turned = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), rest), " ")
    rows = docs.select("doc_id", "text", split.alias("words"), g.alias("g")).select("*", a.alias("a"))
    return rows.select("doc_id", F.when(n > 0, turned).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(looped(table(spark, sf_dir, "documents"))).withColumn("best", periodic.strongest("runs"))
    line = F.transform("runs", lambda r: F.concat_ws(",", *(r[x].cast("string") for x in ("start", "length", "period"))))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
