"""Column edits, text cleaning, duplicates, missing values and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekit.functions import text
from tablekit.operators import clean, edits
from tablekit.operators.features import stop_tokens, tfidf, tfidf_terms
from tablekit.plans import cleaning
from workload.base import LINEITEM, lineitem, query, r, table

# ---- columns


@query("c1_drop_column", "SELECT o_orderkey, o_orderstatus FROM orders")
def c1(spark, d):
    got = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return edits.drop_column(got, "o_totalprice")


@query("c2_rename_column", "SELECT p_partkey AS part_id, p_brand FROM part")
def c2(spark, d):
    return edits.rename_column(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey", "part_id")


@query("c3_standardise_names", "SELECT c_custkey AS customer_key, c_name AS customer_name, c_mktsegment AS customer_name_2 FROM customer")
def c3(spark, d):
    got = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return edits.standardise_names(got.toDF(" Customer-Key", "Customer Name", "customer_name"))


@query("c4_add_empty_column", "SELECT o_orderkey, CAST(NULL AS DOUBLE) AS revenue FROM orders")
def c4(spark, d):
    return edits.add_empty_column(table(spark, d, "orders").select("o_orderkey"), "revenue")


@query(
    "c5_derive",
    f"""SELECT l_returnflag, CAST(count(margin) AS BIGINT) AS filled, round(sum(margin), 2) + 0.0 AS margin, round(sum(modulo), 2) + 0.0 AS modulo, round(sum(whole), 2) + 0.0 AS whole,
    CAST(count(modulo) AS BIGINT) AS modulo_filled FROM (SELECT l_returnflag, l_extendedprice * (1 - l_discount) / nullif(qty, 0) - qty ** 2 AS margin,
      -l_quantity - (l_suppkey - 10) * floor(-l_quantity / nullif(l_suppkey - 10, 0)) AS modulo,
      floor(-l_quantity / nullif(l_suppkey - 10, 0)) AS whole FROM {LINEITEM}) GROUP BY l_returnflag""",
)
def c5(spark, d):
    got = edits.derive(lineitem(spark, d), "margin", "try_divide(l_extendedprice * (1 - l_discount), qty) - power(qty, 2)")
    got = edits.derive(got, "modulo", edits.modulo(-F.col("l_quantity"), F.col("l_suppkey") - 10))
    got = edits.derive(got, "whole", edits.floor_divide(-F.col("l_quantity"), F.col("l_suppkey") - 10))
    return got.groupBy("l_returnflag").agg(
        F.count("margin").alias("filled"),
        r(F.sum("margin"), 2).alias("margin"),
        r(F.sum("modulo"), 2).alias("modulo"),
        r(F.sum("whole"), 2).alias("whole"),
        F.count("modulo").alias("modulo_filled"),
    )


@query("c5_fill_column", "SELECT p_partkey, round(p_retailprice * p_size / 100, 4) + 0.0 AS p_retailprice FROM part")
def c5_fill(spark, d):
    got = edits.fill_column(table(spark, d, "part"), "p_retailprice", "p_retailprice * p_size / 100")
    return got.select("p_partkey", r("p_retailprice").alias("p_retailprice"))


ROW_SQL = """SELECT event_id, round({e}, 6) + 0.0 AS v FROM (SELECT event_id,
 list_filter([CASE WHEN user_id <> 7 THEN value END, CASE WHEN user_id > 20 THEN CAST(user_id AS DOUBLE) END, CASE WHEN event_type <> 'view' THEN 3.5 END], lambda x: x IS NOT NULL) AS a FROM events)"""
ROW_EXPR = {
    "sum": "coalesce(list_sum(a), 0)",
    "mean": "list_avg(a)",
    "min": "list_min(a)",
    "max": "list_max(a)",
    "product": "coalesce(list_product(a), 1)",
    "median": "list_median(a)",
    "std": "CASE WHEN len(a) > 1 THEN list_stddev_samp(a) END",
}


def _row_query(op):
    @query(f"c6_row_{op}", ROW_SQL.format(e=ROW_EXPR[op]))
    def c6(spark, d):
        got = table(spark, d, "events").select(
            "event_id",
            F.when(F.col("user_id") != 7, F.col("value")).alias("a"),
            F.when(F.col("user_id") > 20, F.col("user_id").cast("double")).alias("b"),
            F.when(F.col("event_type") != "view", F.lit(3.5)).alias("c"),
        )
        return edits.row_aggregate(got, "v", op, ["a", "b", "c"]).select("event_id", r("v", 6).alias("v"))


for _op in edits.ROW_OPS:
    _row_query(_op)


@query(
    "c7_round_columns",
    "SELECT o_orderkey, CAST(round_even(o_totalprice / 8, 0) AS BIGINT) AS whole, round_even(o_totalprice / 8 * 100, 0) / 100 AS cents FROM orders",
)
def c7(spark, d):
    got = table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 8).alias("whole"), (F.col("o_totalprice") / 8).alias("cents")
    )
    return edits.round_columns(edits.round_columns(got, ["whole"], 0), ["cents"], 2)


@query(
    "c8_split_first_word",
    """SELECT doc_id, CASE WHEN t <> '' THEN regexp_extract(t, '^(\\S+)', 1) END AS head,
    CAST(length(CASE WHEN t <> '' THEN trim(regexp_replace(t, '^\\S+', ''), E' \\n\\t\\r') END) AS BIGINT) AS rest_length
    FROM (SELECT doc_id, trim(text, E' \\n\\t\\r') AS t FROM documents)""",
)
def c8(spark, d):
    got = edits.split_first_word(table(spark, d, "documents"), "text", "head", "rest")
    return got.select("doc_id", "head", F.length("rest").cast("long").alias("rest_length"))


@query("c9_replace_value", "SELECT o_orderkey, CASE WHEN lower(o_orderpriority) = '5-low' THEN 'LOW' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def c9(spark, d):
    got = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return edits.replace_value(got, "o_orderpriority", "5-low", "LOW")


@query("c9_replace_substring", "SELECT p_partkey, regexp_replace(p_name, '(?i)RING', 'band', 'g') AS p_name FROM part")
def c9_sub(spark, d):
    return edits.replace_value(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "RING", "band")


@query("c9_replace_number", "SELECT p_partkey, CAST(CASE WHEN p_size = 7 THEN 70 ELSE p_size END AS BIGINT) AS p_size FROM part")
def c9_num(spark, d):
    got = edits.replace_value(table(spark, d, "part"), "p_size", 7, 70)
    return got.select("p_partkey", F.col("p_size").cast("long").alias("p_size"))


@query("c10_remove_text", "SELECT c_custkey, trim(regexp_replace(regexp_replace(c_name, '(?i)CUSTOMER#\\.?', '', 'g'), '\\s+', ' ', 'g')) AS c_name FROM customer")
def c10(spark, d):
    return edits.remove_text(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", "customer#.")


@query(
    "c11_convert_integer",
    """SELECT p_partkey, CASE WHEN p_size > 45 THEN NULL ELSE CAST(p_size AS BIGINT) END AS size FROM part""",
)
def c11_int(spark, d):
    size = F.when(F.col("p_size") > 45, F.concat(F.col("p_size").cast("string"), F.lit("d"))).otherwise(
        F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".0"))
    )
    got = table(spark, d, "part").select("p_partkey", size.alias("size"))
    return edits.convert_type(got, "size", "integer")


@query("c11_convert_boolean", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN false WHEN 'O' THEN NULL ELSE true END AS flag FROM orders")
def c11_bool(spark, d):
    word = F.when(F.col("o_orderstatus") == "P", F.lit(" Yes")).otherwise(F.col("o_orderstatus"))
    got = table(spark, d, "orders").select("o_orderkey", word.alias("flag"))
    return edits.convert_type(got, "flag", "boolean")


@query("c11_convert_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def c11_date(spark, d):
    got = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    got = edits.convert_type(got, "day", "date")
    return got.select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("c11_convert_month_first", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def c11_month_first(spark, d):
    """Month-first dates, under half of which can be read day first: the counted format wins."""
    got = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"))
    got = edits.convert_type(got, "day", "datetime")
    return got.select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("c11_convert_time", "SELECT event_id, strftime(ts, '%H:%M:%S') AS clock FROM events")
def c11_time(spark, d):
    got = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("clock"))
    return edits.convert_type(got, "clock", "time")


@query("c12_fix_decimal_comma", "SELECT o_orderkey, round(o_totalprice, 2) + 0.0 AS price, o_orderpriority AS priority FROM orders")
def c12(spark, d):
    text_price = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    got = table(spark, d, "orders").select("o_orderkey", text_price.alias("price"), F.col("o_orderpriority").alias("priority"))
    got = edits.fix_decimal_comma(got)
    return got.withColumn("price", r("price", 2))


# ---- text

SPACE = "\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}"


def _strip(c):
    return f"regexp_replace({c}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def _squeeze(c):
    return _strip(f"regexp_replace({c}, '[{SPACE}]+', ' ', 'g')")


STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in text.STOP_WORDS) + "]"
WORDS = f"CASE WHEN {_strip('text')} = '' THEN [] ELSE regexp_split_to_array({_strip('text')}, '[{SPACE}]+') END"
TEXT_SQL = {
    "strip": _strip("'  ' || text || E' \\t'"),
    "lowercase": "lower(text)",
    "uppercase": "upper(replace(text, 'ß', 'SS'))",
    "stopwords": f"array_to_string(list_filter({WORDS}, lambda w: NOT list_contains({STOP}, lower(w))), ' ')",
    "urls": _squeeze(f"regexp_replace(text, 'https?://[^{SPACE}]+|www\\.[^{SPACE}]+', ' ', 'g')"),
    "emails": _squeeze("regexp_replace(text, '[\\p{L}\\p{N}_][\\p{L}\\p{N}_.+-]*@[\\p{L}\\p{N}_-]+\\.[\\p{L}\\p{N}_.-]*[\\p{L}\\p{N}_]', ' ', 'g')"),
    "punctuation": _squeeze(f"regexp_replace(text, '[^\\p{{L}}\\p{{N}}_{SPACE}]', ' ', 'g')"),
    "numbers": _squeeze("regexp_replace(text, '\\b[0-9]+\\b', ' ', 'g')"),
}
TEXT_IDS = {
    "strip": "d1_strip_whitespace",
    "lowercase": "d2_lowercase",
    "uppercase": "d2_uppercase",
    "stopwords": "d3_remove_stopwords",
    "urls": "d4_remove_urls",
    "emails": "d5_remove_emails",
    "punctuation": "d6_remove_punctuation",
    "numbers": "d7_remove_numbers",
}


def _text_query(step):
    @query(TEXT_IDS[step], f"SELECT doc_id, md5({TEXT_SQL[step]}) AS text FROM documents")
    def run(spark, d):
        docs = table(spark, d, "documents").select("doc_id", "text")
        if step == "strip":
            docs = docs.withColumn("text", F.concat(F.lit("  "), "text", F.lit(" \t")))
        return text.edit_text(docs, ["text"], step).withColumn("text", F.md5("text"))


for _step in TEXT_SQL:
    _text_query(_step)


@query(
    "d8_tokenize",
    """SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM documents)
    WHERE length(word) > 1 GROUP BY word""",
)
def d8(spark, d):
    words = table(spark, d, "documents").select(F.explode(text.tokenize(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


SPLIT_STOP = "[" + ", ".join(f"'{w}'" for w in stop_tokens()) + "]"


TERMS_SQL = f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE length(term) > 1 AND NOT list_contains({SPLIT_STOP}, term) GROUP BY ALL),
    v AS (SELECT term, sum(tf) AS total, count(*) AS docs FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 300),
    w AS (SELECT doc_id, term, (ln(tf) + 1) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + docs)) + 1) AS w FROM tf JOIN v USING (term)),
    n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)
    SELECT doc_id, term, round(w / norm, 6) + 0.0 AS weight FROM w JOIN n USING (doc_id)"""


@query("d9_tfidf_terms", TERMS_SQL)
def d9_terms(spark, d):
    got = tfidf_terms(table(spark, d, "documents"), "text", ["doc_id"])
    return got.select("doc_id", "term", r("weight", 6).alias("weight"))


@query("d9_tfidf", TERMS_SQL)
def d9(spark, d):
    """The vectors of the model, as terms."""
    from pyspark.ml.feature import CountVectorizerModel
    from pyspark.ml.functions import vector_to_array

    model, got = tfidf(table(spark, d, "documents").select("doc_id", "text"), "text")
    words = next(s for s in model.stages if isinstance(s, CountVectorizerModel)).vocabulary
    pairs = F.arrays_zip(F.array(*[F.lit(w) for w in words]).alias("term"), vector_to_array("tfidf").alias("weight"))
    long = got.select("doc_id", F.explode(F.filter(pairs, lambda p: p["weight"] > 0)).alias("p"))
    return long.select("doc_id", "p.term", r("p.weight", 6).alias("weight"))


# ---- duplicates, missing values, outliers


@query("e1_drop_duplicates", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def e1(spark, d):
    return clean.drop_duplicates(table(spark, d, "orders").select("o_custkey", "o_orderstatus"))


@query(
    "e2_drop_duplicates_by",
    "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
)
def e2(spark, d):
    got = clean.drop_duplicates_by(table(spark, d, "events"), ["user_id"], ["ts", "event_id"])
    return got.select("user_id", "event_id", "event_type")


@query(
    "e3_duplicate_count",
    """SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM
    (SELECT count(*) AS n FROM documents GROUP BY text, lang)""",
)
def e3(spark, d):
    return clean.duplicate_count(table(spark, d, "documents").select("text", "lang"))


def _fill_query(strategy, sql):
    @query(
        f"e4_fill_{strategy}",
        f"SELECT l_linenumber, round(sum(coalesce(qty, {sql})), 4) + 0.0 AS total, CAST(count(*) AS BIGINT) AS n FROM {LINEITEM} GROUP BY l_linenumber",
    )
    def e4(spark, d):
        got = clean.fill_missing(lineitem(spark, d), "qty", strategy, 17.5)
        return got.groupBy("l_linenumber").agg(r(F.sum("qty")).alias("total"), F.count("qty").alias("n"))


for _s, _sql in {
    "mean": f"(SELECT avg(qty) FROM {LINEITEM})",
    "median": f"(SELECT median(qty) FROM {LINEITEM})",
    "mode": f"(SELECT qty FROM {LINEITEM} WHERE qty IS NOT NULL GROUP BY qty ORDER BY count(*) DESC, qty LIMIT 1)",
    "zero": "0",
    "constant": "17.5",
}.items():
    _fill_query(_s, _sql)


@query(
    "e5_fill_missing_all",
    f"""SELECT l_linenumber, flag, CAST(count(*) AS BIGINT) AS n, round(sum(qty), 4) + 0.0 AS qty FROM (SELECT l_linenumber,
      coalesce(flag, (SELECT flag FROM {LINEITEM} WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag,
      coalesce(qty, (SELECT median(qty) FROM {LINEITEM})) AS qty FROM {LINEITEM}) GROUP BY l_linenumber, flag""",
)
def e5(spark, d):
    got = clean.fill_missing_all(lineitem(spark, d))
    return got.groupBy("l_linenumber", "flag").agg(F.count(F.lit(1)).alias("n"), r(F.sum("qty")).alias("qty"))


@query("e6_drop_high_missing", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity, 2) AS l_quantity FROM lineitem")
def e6(spark, d):
    got = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("l_quantity", 2).alias("l_quantity"),
        F.when(F.col("l_linenumber") == 1, F.col("l_tax")).alias("mostly_missing"),
    )
    return clean.drop_high_missing(got)


@query("e7_drop_constant", "SELECT o_orderkey, o_orderstatus FROM orders")
def e7(spark, d):
    got = table(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", F.lit("x").alias("same"), F.when(F.col("o_orderkey") > 5, 1).alias("one_value"),
        F.lit(None).cast("string").alias("nothing"),
    )
    return clean.drop_constant(got)


@query(
    "e8_coerce_numeric_text",
    "SELECT o_orderkey, CASE WHEN o_custkey > 10 THEN round(o_totalprice, 2) + 0.0 END AS price, o_orderpriority FROM orders",
)
def e8(spark, d):
    price = F.when(F.col("o_custkey") > 10, F.concat(F.lit(" "), F.col("o_totalprice").cast("string"))).otherwise("n/a")
    got = table(spark, d, "orders").select("o_orderkey", price.alias("price"), "o_orderpriority")
    return clean.coerce_numeric_text(got).withColumn("price", r("price", 2))


def _bounds(column, k, source):
    q = f"(SELECT quantile_cont({column}, {{p}}) FROM {source})"
    lo, hi = q.format(p="0.25"), q.format(p="0.75")
    return f"({lo} - {k} * ({hi} - {lo}))", f"({hi} + {k} * ({hi} - {lo}))"


SKEWED = "(SELECT p_partkey, CASE WHEN p_size > 40 THEN p_retailprice * p_size ELSE p_retailprice END AS price, CASE WHEN p_size <> 9 THEN CAST(p_size * p_size * p_size AS DOUBLE) END AS cube FROM part)"


def _skewed(spark, d):
    return table(spark, d, "part").select(
        "p_partkey",
        F.when(F.col("p_size") > 40, F.col("p_retailprice") * F.col("p_size")).otherwise(F.col("p_retailprice")).alias("price"),
        F.when(F.col("p_size") != 9, F.col("p_size") * F.col("p_size") * F.col("p_size") * F.lit(1.0)).alias("cube"),
    )


PRICE_LO, PRICE_HI = _bounds("price", 1.5, SKEWED)
CUBE_LO, CUBE_HI = _bounds("cube", 1.5, SKEWED)
KEY_LO, KEY_HI = _bounds("p_partkey", 1.5, SKEWED)


@query("e9_drop_outliers", f"SELECT p_partkey FROM {SKEWED} WHERE price BETWEEN {PRICE_LO} AND {PRICE_HI}")
def e9(spark, d):
    return clean.drop_outliers(_skewed(spark, d), "price").select("p_partkey")


@query(
    "e10_drop_outliers_all",
    f"""SELECT p_partkey FROM {SKEWED} WHERE price BETWEEN {PRICE_LO} AND {PRICE_HI} AND cube BETWEEN {CUBE_LO} AND {CUBE_HI}
    AND p_partkey BETWEEN {KEY_LO} AND {KEY_HI}""",
)
def e10(spark, d):
    return clean.drop_outliers_all(_skewed(spark, d)).select("p_partkey")


CLIP_LO, CLIP_HI = _bounds("price", 3, SKEWED)
CUBE3_LO, CUBE3_HI = _bounds("cube", 3, SKEWED)


@query(
    "e11_clip_outliers",
    f"""SELECT p_partkey, round(greatest({CLIP_LO}, least({CLIP_HI}, price)), 4) + 0.0 AS price,
    CASE WHEN cube IS NOT NULL THEN round(greatest({CUBE3_LO}, least({CUBE3_HI}, cube)), 4) + 0.0 END AS cube FROM {SKEWED}""",
)
def e11(spark, d):
    got = clean.clip_outliers(_skewed(spark, d))
    return got.select(F.col("p_partkey").cast("long").alias("p_partkey"), r("price").alias("price"), r("cube").alias("cube"))


DIRTY = """(SELECT o_custkey, o_orderstatus, CASE WHEN o_custkey > 40 THEN o_totalprice END AS price,
  CASE WHEN o_orderpriority <> '2-HIGH' THEN o_orderpriority END AS priority FROM orders
  UNION ALL SELECT o_custkey, o_orderstatus, CASE WHEN o_custkey > 40 THEN o_totalprice END AS price,
  CASE WHEN o_orderpriority <> '2-HIGH' THEN o_orderpriority END AS priority FROM orders)"""


def _dirty(spark, d):
    """orders twice, with odd names, padded text, numbers as text, a constant and a mostly empty column."""
    o = table(spark, d, "orders", spread=True)
    one = o.select(
        F.col("o_custkey").alias("Cust Key"),
        F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")).alias(" Status"),
        F.when(F.col("o_custkey") > 40, F.col("o_totalprice").cast("string")).alias("Total-Price"),
        F.when(F.col("o_orderpriority") != "2-HIGH", F.col("o_orderpriority")).alias("priority"),
        F.lit("same").alias("constant"),
        F.when(F.col("o_custkey") < 9, F.col("o_custkey")).alias("rare"),
    )
    return one.unionAll(one)


CLEAN_SQL = f"""WITH a AS (SELECT DISTINCT o_custkey, o_orderstatus, price, priority FROM {DIRTY}),
 b AS (SELECT o_custkey, o_orderstatus, coalesce(price, (SELECT median(price) FROM a)) AS price,
   coalesce(priority, (SELECT priority FROM a WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)) AS priority FROM a),
 q AS (SELECT quantile_cont(price, 0.25) AS p1, quantile_cont(price, 0.75) AS p3, quantile_cont(o_custkey, 0.25) AS c1, quantile_cont(o_custkey, 0.75) AS c3 FROM b)
"""


@query(
    "e12_clean",
    CLEAN_SQL
    + """SELECT round(greatest(c1 - 3 * (c3 - c1), least(c3 + 3 * (c3 - c1), o_custkey)), 4) + 0.0 AS cust_key, o_orderstatus AS status,
    round(greatest(p1 - 3 * (p3 - p1), least(p3 + 3 * (p3 - p1), price)), 4) + 0.0 AS total_price, priority FROM b, q""",
)
def e12(spark, d):
    got, _ = cleaning.clean(_dirty(spark, d))
    return got.select(r(F.col("cust_key").cast("double")).alias("cust_key"), "status", r("total_price").alias("total_price"), "priority")


@query(
    "e12_clean_log",
    CLEAN_SQL
    + f"""SELECT 'column_names' AS step, CAST(3 AS BIGINT) AS changes UNION ALL SELECT 'whitespace', 1 UNION ALL SELECT 'numeric_text', 1
    UNION ALL SELECT 'constant_columns', 1 UNION ALL SELECT 'high_missing_columns', 1
    UNION ALL SELECT 'duplicates', (SELECT count(*) FROM {DIRTY}) - (SELECT count(*) FROM a)
    UNION ALL SELECT 'filled_numeric', (SELECT count(*) FROM a WHERE price IS NULL)
    UNION ALL SELECT 'filled_categorical', (SELECT count(*) FROM a WHERE priority IS NULL)""",
)
def e12_log(spark, d):
    return cleaning.clean(_dirty(spark, d))[1].select("step", "changes")


@query(
    "e13_recommend_cleaning",
    f"""SELECT 'duplicates' AS issue, (SELECT count(*) FROM {DIRTY}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {DIRTY})) AS found
    UNION ALL SELECT 'constant_columns', 1 UNION ALL SELECT 'high_missing_columns', 1
    UNION ALL SELECT 'missing_numeric', (SELECT 2 * count(*) FROM orders WHERE o_custkey >= 9)
    UNION ALL SELECT 'missing_categorical', (SELECT count(*) FROM {DIRTY} WHERE price IS NULL) + (SELECT count(*) FROM {DIRTY} WHERE priority IS NULL)
    UNION ALL SELECT 'whitespace', 1 UNION ALL SELECT 'mixed_types', 1 UNION ALL SELECT 'column_names', 3""",
)
def e13(spark, d):
    return cleaning.recommend_cleaning(_dirty(spark, d)).select("issue", "found")
