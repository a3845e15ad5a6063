"""Profiles, descriptive statistics, quality checks and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekit.operators import profile, relate
from workload.base import LINEITEM, lineitem, query, r, table

NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "qty"]
LINE_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz", "qty": "double", "flag": "string",
}


def _each(names, template, source):
    return " UNION ALL ".join(template.format(c=c, s=source) for c in names)


PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{t}' AS dtype, CAST(count(*) - count({c}) AS BIGINT) AS missing,
    round((count(*) - count({c})) * 100.0 / count(*), 2) + CAST(0 AS DOUBLE) AS missing_pct, CAST(count(DISTINCT {c}) AS BIGINT) AS "unique",
    '{"numeric" if t in ("bigint", "int", "double") else "categorical"}' AS role FROM {LINEITEM}"""
    for c, t in LINE_TYPES.items()
)


@query("f1_column_profile", PROFILE_SQL)
def f1(spark, d):
    return profile.column_profile(lineitem(spark, d, spread=True))


@query(
    "f1_column_profile_text",
    """SELECT 'text' AS column_name, 'text' AS role, CAST(count(DISTINCT text) AS BIGINT) AS "unique" FROM documents
    UNION ALL SELECT 'lang', 'categorical', count(DISTINCT lang) FROM documents""",
)
def f1_text(spark, d):
    got = profile.column_profile(table(spark, d, "documents").select("text", "lang"))
    return got.select("column_name", "role", "unique")


DESCRIBE = """SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 4) + 0.0 AS mean, round(stddev({c}), 4) + 0.0 AS std,
 round(min({c}), 4) + 0.0 AS min, round(quantile_cont({c}, 0.25), 4) + 0.0 AS p25, round(quantile_cont({c}, 0.5), 4) + 0.0 AS p50,
 round(quantile_cont({c}, 0.75), 4) + 0.0 AS p75, round(max({c}), 4) + 0.0 AS max FROM {s}"""


def _rounded(df, digits=4):
    return df.select(*[r(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("f2_describe_numeric", _each(NUMS, DESCRIBE, LINEITEM))
def f2(spark, d):
    return _rounded(profile.describe_numeric(lineitem(spark, d, spread=True), NUMS))


@query(
    "f3_describe_all",
    "SELECT *, CAST(NULL AS BIGINT) AS \"unique\", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq FROM ("
    + _each(["l_quantity", "qty"], DESCRIBE, LINEITEM)
    + ") UNION ALL "
    + _each(
        ["l_returnflag", "l_linestatus", "flag"],
        """SELECT '{c}', CAST(count({c}) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, CAST(count(DISTINCT {c}) AS BIGINT),
        (SELECT {c} FROM {s} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1),
        CAST((SELECT count(*) FROM {s} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS BIGINT) FROM {s}""",
        LINEITEM,
    ),
)
def f3(spark, d):
    return _rounded(profile.describe_all(lineitem(spark, d, spread=True).select("l_quantity", "qty", "l_returnflag", "l_linestatus", "flag")))


HIST = """SELECT '{c}' AS column_name, CAST(i AS BIGINT) AS bin, round(lo + i * w, 6) + 0.0 AS lo, round(lo + (i + 1) * w, 6) + 0.0 AS hi,
 CAST((SELECT count(*) FROM (SELECT least(floor(({c} - lo) / w), nb - 1) AS b, {c} AS v FROM {s}) h
   WHERE b - CAST(v < lo + b * w AS INT) + CAST(v >= lo + (b + 1) * w AND b < nb - 1 AS INT) = i) AS BIGINT) AS count
 FROM (SELECT lo, nb, (hi - lo) / nb AS w FROM (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, least(10, count(DISTINCT {c})) AS nb FROM {s})) m,
 range(10) t(i) WHERE i < nb"""


@query("f4_histogram", _each(["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"], HIST, LINEITEM))
def f4(spark, d):
    got = profile.histogram(lineitem(spark, d, spread=True), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"])
    return got.withColumns({"lo": r("lo", 6), "hi": r("hi", 6)})


@query(
    "f5_value_counts",
    _each(
        ["p_brand", "p_type", "p_size", "p_name"],
        """SELECT '{c}' AS column_name, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS BIGINT) AS rank, CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS count
        FROM {s} GROUP BY {c} QUALIFY row_number() OVER (ORDER BY count(*) DESC, {c}) <= 10""",
        "part",
    ),
)
def f5(spark, d):
    return profile.value_counts(table(spark, d, "part"), ["p_brand", "p_type", "p_size", "p_name"])


WORDS = """len(regexp_extract_all(text, '\\S+'))"""


@query(
    "f6_text_stats",
    f"""SELECT CAST(count(*) AS BIGINT) AS documents, round(avg({WORDS}), 1) + 0.0 AS avg_words, round(median({WORDS}), 1) + 0.0 AS median_words,
    CAST(min({WORDS}) AS BIGINT) AS min_words, CAST(max({WORDS}) AS BIGINT) AS max_words, round(avg(length(text)), 1) + 0.0 AS avg_chars,
    CAST((SELECT count(DISTINCT w) FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS w FROM documents) WHERE length(w) > 1) AS BIGINT) AS vocab_size
    FROM documents WHERE trim(text) <> ''""",
)
def f6(spark, d):
    return profile.text_stats(table(spark, d, "documents"), "text")


@query(
    "f7_detect_text_columns",
    f"""SELECT 'text' AS column_name, CAST(count(*) AS BIGINT) AS filled, round(avg({WORDS}), 4) + 0.0 AS avg_words,
      round(count(DISTINCT text) * 1.0 / count(*), 4) + CAST(0 AS DOUBLE) AS unique_ratio, true AS is_text FROM documents
    UNION ALL SELECT 'lang', count(*), 1.0, round(count(DISTINCT lang) * 1.0 / count(*), 4), false FROM documents
    UNION ALL SELECT 'source', count(*), 1.0, round(count(DISTINCT source) * 1.0 / count(*), 4), false FROM documents""",
)
def f7(spark, d):
    return _rounded(profile.detect_text_columns(table(spark, d, "documents")))


def _corr_sql(names, source, digits):
    rows = []
    for a in names:
        for b in names:
            rows.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(coalesce(corr({a}, {b}), 0), {digits}) + 0.0 AS r FROM {source}")
    return " UNION ALL ".join(rows)


@query("f8_correlation_matrix", _corr_sql(NUMS, LINEITEM, 3))
def f8(spark, d):
    return profile.correlation_matrix(lineitem(spark, d), NUMS).withColumn("r", r("r", 3))


@query(
    "f9_missing_report",
    f"""SELECT 'qty' AS column_name, CAST(count(*) - count(qty) AS BIGINT) AS missing, round((count(*) - count(qty)) * 100.0 / count(*), 4) + CAST(0 AS DOUBLE) AS missing_pct FROM {LINEITEM}
    UNION ALL SELECT 'flag', count(*) - count(flag), round((count(*) - count(flag)) * 100.0 / count(*), 4) FROM {LINEITEM}""",
)
def f9(spark, d):
    return _rounded(profile.missing_report(lineitem(spark, d)))


CUBES = "(SELECT CAST(p_size * p_size * p_size AS DOUBLE) AS cube, CASE WHEN p_size > 45 THEN p_retailprice * p_size ELSE p_retailprice END AS value, p_partkey FROM part)"


def _cubes(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select(
        (size * size * size).cast("double").alias("cube"), F.when(size > 45, F.col("p_retailprice") * size).otherwise(F.col("p_retailprice")).alias("value"), "p_partkey"
    )


@query(
    "f10_outlier_report",
    "SELECT * FROM ("
    + _each(
        ["cube", "value", "p_partkey"],
        """SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS BIGINT) AS outliers,
        round(count(*) FILTER (WHERE {c} < lo OR {c} > hi) * 100.0 / count(*), 4) + CAST(0 AS DOUBLE) AS outlier_pct, round(any_value(lo), 4) + 0.0 AS lo, round(any_value(hi), 4) + 0.0 AS hi
        FROM {s}, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {s})) b""",
        CUBES,
    )
    + ") WHERE outliers > 0",
)
def f10(spark, d):
    return _rounded(profile.outlier_report(_cubes(spark, d)))


@query(
    "f11_column_summary",
    f"""SELECT 'cube' AS column_name, CAST(count(DISTINCT cube) AS BIGINT) AS "unique", CAST(count(*) - count(cube) AS BIGINT) AS missing, round(avg(cube), 4) + 0.0 AS mean, round(median(cube), 4) + 0.0 AS median,
    round(min(cube), 4) + 0.0 AS min, round(max(cube), 4) + 0.0 AS max, round(stddev(cube), 4) + 0.0 AS std, round(skewness(cube), 4) + 0.0 AS skew,
    CASE WHEN abs(skewness(cube)) < 0.5 THEN 'roughly symmetric' WHEN skewness(cube) > 0 THEN 'right-skewed' ELSE 'left-skewed' END AS shape FROM {CUBES}""",
)
def f11(spark, d):
    return _rounded(profile.column_summary(_cubes(spark, d), "cube"))


@query(
    "f11_column_summary_text",
    """SELECT 'o_orderpriority' AS column_name, CAST(row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS BIGINT) AS rank,
    o_orderpriority AS value, CAST(count(*) AS BIGINT) AS count FROM orders GROUP BY o_orderpriority ORDER BY rank LIMIT 5""",
)
def f11_text(spark, d):
    return profile.column_summary(table(spark, d, "orders"), "o_orderpriority")


@query(
    "f12_distribution",
    f"""SELECT 'qty' AS column_name, round(min(qty), 4) + 0.0 AS min, round(quantile_cont(qty, 0.25), 4) + 0.0 AS q1, round(median(qty), 4) + 0.0 AS median,
    round(quantile_cont(qty, 0.75), 4) + 0.0 AS q3, round(max(qty), 4) + 0.0 AS max, round(skewness(qty), 4) + 0.0 AS skew FROM {LINEITEM}""",
)
def f12(spark, d):
    return _rounded(profile.distribution(lineitem(spark, d), "qty"))


STATS = {
    "mean": "avg(qty)", "sum": "sum(qty)", "median": "median(qty)", "std": "stddev(qty)", "variance": "var_samp(qty)",
    "max": "max(qty)", "min": "min(qty)", "nunique": "CAST(count(DISTINCT qty) AS DOUBLE)",
}


@query(
    "f13_scalar_stat",
    " UNION ALL ".join(f"SELECT 'qty' AS column_name, '{k}' AS stat, round({v}, 4) + 0.0 AS value FROM {LINEITEM}" for k, v in STATS.items()),
)
def f13(spark, d):
    df = lineitem(spark, d)
    out = None
    for stat in STATS:
        one = profile.scalar_stat(df, "qty", stat)
        out = one if out is None else out.unionByName(one)
    return _rounded(out)


@query(
    "f14_cardinality_ranking",
    "SELECT * FROM (" + _each(
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
        "SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS \"unique\" FROM {s}", "orders",
    ) + ") ORDER BY \"unique\" DESC, column_name LIMIT 10",
)
def f14(spark, d):
    return profile.cardinality_ranking(table(spark, d, "orders"))


@query(
    "f15_type_inventory",
    """SELECT * FROM (VALUES ('o_orderkey', 'bigint', 'numeric', false, false), ('price', 'string', 'categorical', true, false),
    ('day', 'string', 'categorical', false, true), ('o_orderpriority', 'string', 'categorical', false, false),
    ('o_orderdate', 'timestamp_ntz', 'categorical', false, true)) AS t(column_name, dtype, role, numeric_like, date_like)""",
)
def f15(spark, d):
    got = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("string").alias("price"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"),
        "o_orderpriority", "o_orderdate",
    )
    return profile.type_inventory(got)


@query(
    "f16_quality_flags",
    """SELECT 'Duplicate rows' AS issue, 'Review' AS severity, CAST((SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus)) AS BIGINT) AS found, CAST(NULL AS VARCHAR) AS columns
    UNION ALL SELECT 'High missingness', 'Review', 1, 'gap' UNION ALL SELECT 'Constant columns', 'Low value', 1, 'same'""",
)
def f16(spark, d):
    status = F.col("o_orderstatus")
    got = table(spark, d, "orders").select(
        "o_custkey", "o_orderstatus", F.when(status == "F", status).alias("gap"), F.lit("x").alias("same"),
    )
    # a second value keeps the gap column from being constant
    got = got.withColumn("gap", F.when((status == "F") & (F.col("o_custkey") > 700), "late").otherwise(F.col("gap")))
    return profile.quality_flags(got)


@query(
    "f17_data_warnings",
    """SELECT 'identifier_like' AS warning, 'code' AS subject, CAST(NULL AS VARCHAR) AS other, CAST(count(*) AS DOUBLE) AS value FROM orders
    UNION ALL SELECT 'dominant_value', 'mostly', 'yes', round(count(*) FILTER (WHERE o_custkey > 100) * 100.0 / count(*), 1) FROM orders
    UNION ALL SELECT 'strong_pair', 'o_totalprice', 'twice', round(corr(o_totalprice, o_totalprice * 2 + o_custkey), 3) FROM orders""",
)
def f17(spark, d):
    got = table(spark, d, "orders").select(
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("code"),
        F.when(F.col("o_custkey") > 100, "yes").otherwise("no").alias("mostly"),
        "o_custkey", "o_totalprice", (F.col("o_totalprice") * 2 + F.col("o_custkey")).alias("twice"),
    )
    return profile.data_warnings(got)


@query(
    "f18_suggest_targets",
    """SELECT 'o_orderstatus' AS column_name, CAST(28 AS BIGINT) AS score, 'classification' AS problem_type, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS "unique", CAST(0 AS DOUBLE) AS missing_pct FROM orders
    UNION ALL SELECT 'o_orderpriority', 28, 'classification', count(DISTINCT o_orderpriority), 0 FROM orders""",
)
def f18(spark, d):
    return profile.suggest_targets(table(spark, d, "orders"))


@query(
    "f19_dataset_overview",
    f"""SELECT CAST(count(*) AS BIGINT) AS rows, CAST(13 AS BIGINT) AS columns, CAST(9 AS BIGINT) AS numeric_columns, CAST(4 AS BIGINT) AS other_columns,
    CAST(2 * count(*) - count(qty) - count(flag) AS BIGINT) AS missing_cells, round((2 * count(*) - count(qty) - count(flag)) * 100.0 / (13 * count(*)), 2) + CAST(0 AS DOUBLE) AS missing_pct,
    CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT) AS duplicate_rows FROM {LINEITEM}""",
)
def f19(spark, d):
    return profile.dataset_overview(lineitem(spark, d))


# ---- relations


def _strength(e):
    return f"CASE WHEN abs({e}) >= 0.7 THEN 'strong' WHEN abs({e}) >= 0.4 THEN 'moderate' ELSE 'weak' END"


PAIRS = [(a, b) for i, a in enumerate(NUMS) for b in NUMS[i + 1 :]]


@query(
    "g1_top_correlations",
    "SELECT column_a, column_b, round(r, 4) + 0.0 AS r, " + _strength("r") + " AS strength FROM ("
    + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM {LINEITEM}" for a, b in PAIRS)
    + ") ORDER BY abs(r) DESC LIMIT 8",
)
def g1(spark, d):
    return _rounded(relate.top_correlations(lineitem(spark, d).select(*NUMS), n=8))


@query(
    "g1_target_correlations",
    "SELECT column_a, column_b, round(r, 4) + 0.0 AS r, " + _strength("r") + " AS strength FROM ("
    + " UNION ALL ".join(f"SELECT 'l_quantity' AS column_a, '{b}' AS column_b, corr(l_quantity, {b}) AS r FROM {LINEITEM}" for b in NUMS[1:])
    + ") ORDER BY abs(r) DESC LIMIT 20",
)
def g1_target(spark, d):
    return _rounded(relate.top_correlations(lineitem(spark, d).select(*NUMS), "l_quantity"))


@query(
    "g2_group_means",
    """SELECT p_brand AS "group", round(avg(p_retailprice), 4) + 0.0 AS mean, CAST(count(p_retailprice) AS BIGINT) AS count FROM part
    GROUP BY p_brand ORDER BY avg(p_retailprice) DESC, p_brand LIMIT 8""",
)
def g2(spark, d):
    return _rounded(relate.group_means(table(spark, d, "part"), "p_retailprice", "p_brand"))


TREND = """WITH t AS (SELECT {v} AS v, row_number() OVER (ORDER BY {t}, {k}) AS a, row_number() OVER (ORDER BY {t} DESC, {k} DESC) AS b, count(*) OVER () AS n FROM {s})
 SELECT CAST(any_value(n) AS BIGINT) AS rows, CAST(any_value(n) // 5 AS BIGINT) AS rows_per_end, round(avg(v) FILTER (WHERE a <= n // 5), 8) + 0.0 AS first_mean,
 round(avg(v) FILTER (WHERE b <= n // 5), 8) + 0.0 AS last_mean FROM t"""


@query("g3_trend_ends", TREND.format(v="value", t="ts", k="event_id", s="events"))
def g3(spark, d):
    return _rounded(relate.trend_ends(table(spark, d, "events"), "value", "ts", "event_id"), 8)


@query("g3_trend_ends_tied", TREND.format(v="o_totalprice", t="o_orderdate", k="o_orderkey", s="orders"))
def g3_tied(spark, d):
    """Days hold many orders, so both cuts fall inside a day."""
    return _rounded(relate.trend_ends(table(spark, d, "orders"), "o_totalprice", "o_orderdate", "o_orderkey"), 8)


@query(
    "g4_crosstab",
    """SELECT p_brand AS value_a, p_type AS value_b, CAST(count(*) AS BIGINT) AS count FROM part GROUP BY p_brand, p_type""",
)
def g4(spark, d):
    return relate.crosstab(table(spark, d, "part"), "p_brand", "p_type")


@query(
    "g4_crosstab_top",
    """SELECT p_brand AS value_a, p_type AS value_b, CAST(count(*) AS BIGINT) AS count FROM part GROUP BY p_brand, p_type
    ORDER BY count DESC, value_a, value_b LIMIT 1""",
)
def g4_top(spark, d):
    return relate.crosstab_top(table(spark, d, "part"), "p_brand", "p_type")


@query(
    "g5_class_balance",
    """SELECT class, count, round(count * 100.0 / sum(count) OVER (), 4) + CAST(0 AS DOUBLE) AS pct, 'classification' AS problem_type FROM
    (SELECT p_type AS class, CAST(count(*) AS BIGINT) AS count FROM part GROUP BY p_type ORDER BY count DESC, class LIMIT 8)""",
)
def g5(spark, d):
    return _rounded(relate.class_balance(table(spark, d, "part"), "p_type"))


@query(
    "g6_cluster_profile",
    f"""SELECT l_returnflag, CAST(count(*) AS BIGINT) AS rows, round(avg(l_quantity), 4) + 0.0 AS l_quantity, round(avg(l_extendedprice), 4) + 0.0 AS l_extendedprice,
    round(avg(qty), 4) + 0.0 AS qty FROM {LINEITEM} GROUP BY l_returnflag""",
)
def g6(spark, d):
    return _rounded(relate.cluster_profile(lineitem(spark, d), "l_returnflag", ["l_quantity", "l_extendedprice", "qty"]))


@query(
    "g6_cluster_extremes",
    """WITH g AS (SELECT l_returnflag AS cluster, avg(l_quantity) AS value FROM lineitem GROUP BY 1)
    SELECT * FROM (SELECT cluster, round(value, 4) + 0.0 AS value, 'highest' AS which FROM g ORDER BY g.value DESC, cluster LIMIT 1)
    UNION ALL SELECT * FROM (SELECT cluster, round(value, 4) + 0.0 AS value, 'lowest' AS which FROM g ORDER BY g.value, cluster LIMIT 1)""",
)
def g6_ext(spark, d):
    return _rounded(relate.cluster_extremes(table(spark, d, "lineitem"), "l_returnflag", "l_quantity"))


ZFEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(
    "g7_cluster_zscores",
    "WITH z AS (" + " UNION ALL ".join(
        f"""SELECT l_returnflag AS cluster, '{c}' AS feature, (avg({c}) - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev({c}) FROM lineitem) AS z FROM lineitem GROUP BY 1"""
        for c in ZFEATS
    ) + """), s AS (SELECT *, CASE WHEN z > 0 THEN 'high' WHEN z < 0 THEN 'low' END AS side FROM z)
    SELECT cluster, feature, round(z, 6) + 0.0 AS z, side, CAST(row_number() OVER (PARTITION BY cluster, side ORDER BY abs(z) DESC, feature) AS BIGINT) AS rank FROM s
    WHERE side IS NOT NULL QUALIFY rank <= 3""",
)
def g7(spark, d):
    got = relate.cluster_zscores(table(spark, d, "lineitem"), "l_returnflag", ZFEATS)
    return got.withColumn("z", r("z", 6))
