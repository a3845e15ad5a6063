"""Chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekit.operators import chart
from workload.base import LINEITEM, lineitem, query, r, table
from workload.profiling import _corr_sql, _rounded

FIXED = """WITH v AS (SELECT CAST({c} AS DOUBLE) AS v FROM {s} WHERE {c} >= {lo} AND {c} <= {hi})
 SELECT CAST(i AS BIGINT) AS bin, round({lo} + i * {w}, 4) + CAST(0 AS DOUBLE) AS lo, round({lo} + (i + 1) * {w}, 4) + CAST(0 AS DOUBLE) AS hi,
 CAST((SELECT count(*) FROM v WHERE least(floor((v - {lo}) / {w}), {n} - 1) = i) AS BIGINT) AS count FROM range({n}) t(i)"""


@query("i1_histogram_width", FIXED.format(c="l_quantity", s=LINEITEM, lo="5", hi="45", w="8", n="5"))
def i1_width(spark, d):
    return _rounded(chart.chart_histogram(lineitem(spark, d), "l_quantity", x_min=5, x_max=45, bin_width=8))


@query(
    "i1_histogram_bins",
    """WITH m AS (SELECT min(value) AS lo, (max(value) - min(value)) / 12 AS w FROM events),
    b AS (SELECT value AS v, least(floor((value - lo) / w), 11) AS b, lo, w FROM events, m),
    c AS (SELECT b - CAST(v < lo + b * w AS INT) + CAST(v >= lo + (b + 1) * w AND b < 11 AS INT) AS b FROM b)
    SELECT CAST(i AS BIGINT) AS bin, round(lo + i * w, 6) + 0.0 AS lo, round(lo + (i + 1) * w, 6) + 0.0 AS hi, CAST((SELECT count(*) FROM c WHERE b = i) AS BIGINT) AS count FROM m, range(12) t(i)""",
)
def i1_bins(spark, d):
    got = chart.chart_histogram(table(spark, d, "events"), "value")
    return got.withColumns({"lo": r("lo", 6), "hi": r("hi", 6)})


@query("i2_bar", "SELECT p_brand AS label, CAST(count(*) AS BIGINT) AS count FROM part GROUP BY p_brand")
def i2(spark, d):
    return chart.chart_bar(table(spark, d, "part"), "p_brand")


@query("i2_bar_top", "SELECT p_name AS label, CAST(count(*) AS BIGINT) AS count FROM part GROUP BY p_name ORDER BY count DESC, label LIMIT 7")
def i2_top(spark, d):
    return chart.chart_bar(table(spark, d, "part"), "p_name", 7)


@query(
    "i3_pie",
    """WITH c AS (SELECT p_brand AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rn FROM part GROUP BY p_brand)
    SELECT CASE WHEN rn <= 10 THEN label ELSE 'Other' END AS label, CAST(sum(n) AS BIGINT) AS count FROM c GROUP BY 1""",
)
def i3(spark, d):
    return chart.chart_pie(table(spark, d, "part"), "p_brand")


@query("i4_treemap", "SELECT p_name AS label, CAST(count(*) AS BIGINT) AS count FROM part GROUP BY p_name ORDER BY count DESC, label LIMIT 15")
def i4(spark, d):
    return chart.chart_treemap(table(spark, d, "part"), "p_name")


SAMPLE = "(SELECT * FROM {s} ORDER BY md5({k} || ':42'), {k} LIMIT {n})"


@query("i5_scatter", f"SELECT round(p_size, 4) + CAST(0 AS DOUBLE) AS x, round(p_retailprice, 4) + 0.0 AS y FROM {SAMPLE.format(s='part', k='p_partkey', n=600)}")
def i5(spark, d):
    return _rounded(chart.chart_scatter(table(spark, d, "part"), "p_size", "p_retailprice", ["p_partkey"]))


@query(
    "i6_bubble",
    f"""WITH s AS {SAMPLE.format(s='orders', k='o_orderkey', n=400)} SELECT round(o_custkey, 4) + CAST(0 AS DOUBLE) AS x, round(o_totalprice, 4) + 0.0 AS y,
    round(3 + 27 * (o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER () + CAST(1e-9 AS DOUBLE)), 4) + 0.0 AS r FROM s""",
)
def i6(spark, d):
    return _rounded(chart.chart_bubble(table(spark, d, "orders"), "o_custkey", "o_totalprice", "o_totalprice", ["o_orderkey"]))


BOX = """WITH v AS (SELECT {g} AS g, {x} AS x FROM {s} WHERE {x} IS NOT NULL),
 q AS (SELECT g, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY g ORDER BY g LIMIT 12)
 SELECT CAST(g AS VARCHAR) AS "group", round(min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1)), 4) + 0.0 AS min, round(any_value(q1), 4) + 0.0 AS q1,
 round(any_value(q2), 4) + 0.0 AS median, round(any_value(q3), 4) + 0.0 AS q3, round(max(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1)), 4) + 0.0 AS max,
 CAST(count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers FROM v JOIN q USING (g) GROUP BY g"""
WIDE = "(SELECT *, p_retailprice * CASE WHEN p_size > 45 THEN p_size ELSE 1 END AS price FROM part)"


def _wide(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").withColumn("price", F.col("p_retailprice") * F.when(size > 45, size).otherwise(1))


@query("i7_box", BOX.format(g="p_brand", x="price", s=WIDE))
def i7(spark, d):
    return _rounded(chart.chart_box(_wide(spark, d), "price", "p_brand"))


@query("i7_box_all", BOX.format(g="'all'", x="qty", s=LINEITEM))
def i7_all(spark, d):
    return _rounded(chart.chart_box(lineitem(spark, d), "qty"))


@query(
    "i7_box_outliers",
    f"""WITH v AS (SELECT p_type AS g, price AS x, p_partkey AS k FROM {WIDE}),
    q AS (SELECT g, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY g)
    SELECT g AS "group", round(x, 4) + 0.0 AS value FROM v JOIN q USING (g) WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)
    QUALIFY row_number() OVER (PARTITION BY g ORDER BY k) <= 50""",
)
def i7_out(spark, d):
    return _rounded(chart.chart_box_outliers(_wide(spark, d), "price", ["p_partkey"], "p_type"))


@query(
    "i8_violin",
    """WITH v AS (SELECT event_type AS g, value AS x FROM events),
    q AS (SELECT g, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3,
      (max(x) - min(x)) / least(20, greatest(5, count(*) // 10)) AS w, least(20, greatest(5, count(*) // 10)) AS nb FROM v GROUP BY g ORDER BY g LIMIT 8),
    b AS (SELECT g, x, lo, w, nb, least(floor((x - lo) / w), nb - 1) AS b FROM v JOIN q USING (g)),
    c AS (SELECT g, b - CAST(x < lo + b * w AS INT) + CAST(x >= lo + (b + 1) * w AND b < nb - 1 AS INT) AS bin, count(*) AS n FROM b GROUP BY ALL)
    SELECT q.g AS "group", CAST(i AS BIGINT) AS bin, round((lo + i * w + lo + (i + 1) * w) / 2, 7) + 0.0 AS center, round(lo, 4) + 0.0 AS min, round(q1, 4) + 0.0 AS q1,
    round(q2, 4) + 0.0 AS median, round(q3, 4) + 0.0 AS q3, round(hi, 4) + 0.0 AS max,
    round(coalesce(n, 0) * CAST(1 AS DOUBLE) / max(n) OVER (PARTITION BY q.g), 4) + 0.0 AS width
    FROM q CROSS JOIN range(20) t(i) LEFT JOIN c ON c.g = q.g AND c.bin = i WHERE i < nb""",
)
def i8(spark, d):
    got = chart.chart_violin(table(spark, d, "events"), "value", "event_type")
    return got.select(
        *[r(c, 7 if c == "center" else 4).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes]
    )


@query(
    "i9_density",
    """WITH m AS (SELECT min(value) AS lo, (max(value) - min(value)) / 99 AS step, stddev(value) * power(count(*), -0.2) AS h FROM events)
    SELECT CAST(i AS BIGINT) AS point, round(any_value(lo + i * step), 6) + 0.0 AS x,
    round(avg(exp(-0.5 * power((value - (lo + i * step)) / h, 2))) / (any_value(h) * sqrt(2 * pi())), 8) + 0.0 AS density FROM events, m, range(100) t(i) GROUP BY i""",
)
def i9(spark, d):
    got = chart.chart_density(table(spark, d, "events"), "value")
    return got.select("point", r("x", 6).alias("x"), r("density", 8).alias("density"))


@query("i10_line", f"SELECT CAST(l_linenumber AS BIGINT) AS x, round(qty, 4) + 0.0 AS y FROM {LINEITEM} WHERE qty IS NOT NULL")
def i10(spark, d):
    got = chart.chart_line(lineitem(spark, d), "l_linenumber", "qty")
    return got.select(F.col("x").cast("long").alias("x"), r("y").alias("y"))


@query("i10_area", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS x, round(o_totalprice, 4) + 0.0 AS y FROM orders")
def i10_area(spark, d):
    got = chart.chart_area(table(spark, d, "orders"), "o_orderdate", "o_totalprice")
    return got.select(F.date_format("x", "yyyy-MM-dd").alias("x"), r("y").alias("y"))


@query("i11_heatmap", _corr_sql(["l_quantity", "l_extendedprice"], LINEITEM, 3))
def i11(spark, d):
    return chart.chart_heatmap(lineitem(spark, d), ["l_quantity", "l_extendedprice"]).withColumn("r", r("r", 3))


@query(
    "i12_radar",
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT p_brand AS "group", '{c}' AS column_name, round(avg({c}), 4) + 0.0 AS mean FROM part GROUP BY p_brand ORDER BY p_brand LIMIT 5)"""
        for c in ("p_size", "p_retailprice")
    ),
)
def i12(spark, d):
    return _rounded(chart.chart_radar(table(spark, d, "part"), ["p_size", "p_retailprice"], "p_brand"))


@query(
    "i12_radar_all",
    f"""SELECT 'Mean' AS "group", 'l_quantity' AS column_name, round(avg(l_quantity), 4) + 0.0 AS mean FROM {LINEITEM}
    UNION ALL SELECT 'Mean', 'qty', round(avg(qty), 4) + 0.0 FROM {LINEITEM}""",
)
def i12_all(spark, d):
    return _rounded(chart.chart_radar(lineitem(spark, d), ["l_quantity", "qty"]))


def _word_sql(source, n):
    from workload.edits import STOP

    return f"""SELECT word, CAST(count(*) AS BIGINT) AS count FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM {source})
    WHERE length(word) > 1 AND NOT list_contains({STOP}, word) GROUP BY word ORDER BY count DESC, word LIMIT {n}"""


@query("i13_word_frequency", _word_sql("documents", 25))
def i13(spark, d):
    return chart.chart_word_frequency(table(spark, d, "documents"), "text")


@query("i13_wordcloud", _word_sql("conversations", 60))
def i13_cloud(spark, d):
    return chart.chart_wordcloud(table(spark, d, "conversations"), "text")


def _places(spark, d):
    """customers with made-up coordinates inside the valid range, some missing."""
    c = table(spark, d, "customer")
    return c.select(
        "c_custkey",
        F.when(F.col("c_nationkey") != 3, F.col("c_acctbal") / 120).alias("lat"),
        (F.col("c_nationkey") * 7.0 - 80).alias("lon"),
        "c_acctbal",
        "c_mktsegment",
    )


PLACES = "(SELECT c_custkey, CASE WHEN c_nationkey <> 3 THEN c_acctbal / 120 END AS lat, CAST(c_nationkey * 7 - 80 AS DOUBLE) AS lon, c_acctbal, c_mktsegment FROM customer)"


@query(
    "i14_map",
    f"""WITH s AS (SELECT * FROM {PLACES} WHERE lat IS NOT NULL ORDER BY md5(c_custkey || ':42'), c_custkey LIMIT 2000),
    t AS (SELECT *, (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) AS t FROM s)
    SELECT round(lat, 7) + 0.0 AS lat, round(lon, 4) + 0.0 AS lon, round(c_acctbal, 4) + 0.0 AS size,
    '#' || lpad(lower(to_hex(CAST(floor(255 * t) AS BIGINT))), 2, '0') || lpad(lower(to_hex(CAST(floor(180 * (1 - t) + 212 * t) AS BIGINT))), 2, '0')
    || lpad(lower(to_hex(CAST(floor(214 * (1 - t)) AS BIGINT))), 2, '0') AS color, CAST(3 AS BIGINT) AS popup_cells FROM t""",
)
def i14(spark, d):
    got = chart.chart_map(_places(spark, d), "lat", "lon", ["c_custkey"], "c_acctbal", "c_acctbal")
    return got.select(
        r("lat", 7).alias("lat"), r("lon").alias("lon"), r("size").alias("size"), "color", F.size("popup").cast("long").alias("popup_cells")
    )


@query("i15_detect_coordinates", f"SELECT 'geo_a' AS lat, 'geo_b' AS lon FROM {PLACES} HAVING min(lat) >= -90 AND max(lat) <= 90 AND max(lon) + 50 BETWEEN 90 AND 180")
def i15(spark, d):
    """Geographic hints in the names; the value ranges decide which is which."""
    from tablekit.functions.columns import small_table

    got = _places(spark, d).select("c_custkey", (F.col("lon") + 50).alias("geo_b"), F.col("lat").alias("geo_a"))
    found = chart.detect_coordinates(got)
    return small_table(spark, [(found["lat"], found["lon"])], "lat string, lon string")


@query("i16_choropleth", "SELECT s_suppkey AS _feature_index, round(s_acctbal, 4) + 0.0 AS value, s_name AS name FROM supplier WHERE s_nationkey <> 2")
def i16(spark, d):
    got = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("_feature_index"),
        F.lit("Polygon").alias("_geometry_type"),
        F.when(F.col("s_nationkey") != 2, F.col("s_acctbal")).alias("balance"),
        F.when(F.col("s_nationkey") != 5, F.lit("note")).alias("note"),
        F.col("s_name"),
    )
    return chart.chart_choropleth(got, "balance").select("_feature_index", r("value").alias("value"), "name")


@query(
    "i17_suggest_charts",
    """WITH r AS (SELECT unnest([abs(corr(l_quantity, l_extendedprice)), abs(corr(l_quantity, l_discount)), abs(corr(l_extendedprice, l_discount))]) AS r,
      unnest(['l_quantity', 'l_quantity', 'l_extendedprice']) AS x, unnest(['l_extendedprice', 'l_discount', 'l_discount']) AS y FROM lineitem),
    c AS (SELECT unnest(['l_returnflag', 'l_linestatus']) AS x, unnest([count(DISTINCT l_returnflag), count(DISTINCT l_linestatus)]) AS u FROM lineitem),
    s AS (SELECT x, row_number() OVER (ORDER BY sd DESC) AS n FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS x,
      unnest([stddev(l_quantity), stddev(l_extendedprice), stddev(l_discount)]) AS sd FROM lineitem)),
    o AS (SELECT 1 AS pos, 'scatter' AS chart, x, y FROM (SELECT * FROM r ORDER BY r DESC LIMIT 1)
      UNION ALL SELECT CASE x WHEN 'l_returnflag' THEN 2 ELSE 3 END, CASE WHEN u <= 6 THEN 'pie' ELSE 'bar' END, x, NULL FROM c WHERE u BETWEEN 2 AND 20
      UNION ALL SELECT 4, 'box', x, NULL FROM s WHERE n = 1 UNION ALL SELECT 5, 'histogram', x, NULL FROM s WHERE n = 2
      UNION ALL SELECT 6, 'density', x, NULL FROM s WHERE n = 1)
    SELECT CAST(row_number() OVER (ORDER BY pos) AS BIGINT) AS rank, chart, x, y FROM o""",
)
def i17(spark, d):
    cols = ["l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_linestatus"]
    return chart.suggest_charts(table(spark, d, "lineitem").select(*cols), 6)
