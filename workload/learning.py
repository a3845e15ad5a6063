"""Feature preparation, training, clustering, anomalies, components, rules and what-if."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablekit.functions.columns import small_table
from tablekit.operators import anomaly, boosting, cluster, features, metrics, neighbours, reduce, rules, sample, whatif
from tablekit.plans import clustering, training
from workload.base import LINE_KEYS, LINEITEM, lineitem, query, r, scratch, table
from workload.profiling import _rounded

# ---- features


@query(
    "j1_impute",
    f"""SELECT l_linenumber, round(sum(coalesce(qty, (SELECT median(qty) FROM {LINEITEM} WHERE l_discount < 0.05))), 4) + 0.0 AS qty,
    CAST(count(*) FILTER (WHERE coalesce(flag, (SELECT flag FROM {LINEITEM} WHERE l_discount < 0.05 AND flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) = 'A') AS BIGINT) AS a_rows
    FROM {LINEITEM} GROUP BY l_linenumber""",
)
def j1(spark, d):
    df = lineitem(spark, d)
    got = features.impute(df, fitted_on=df.filter("l_discount < 0.05"))
    return got.groupBy("l_linenumber").agg(r(F.sum("qty")).alias("qty"), F.count_if(F.col("flag") == "A").alias("a_rows"))


@query(
    "j2_standardise",
    """SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) + 0.0 AS value,
    round((user_id - (SELECT avg(user_id) FROM events)) / (SELECT stddev_pop(user_id) FROM events), 6) + 0.0 AS user_id FROM events""",
)
def j2(spark, d):
    got = features.standardise(table(spark, d, "events").select("event_id", "value", "user_id"), ["value", "user_id"])
    return got.select("event_id", r("value", 6).alias("value"), r("user_id", 6).alias("user_id"))


@query(
    "j3_one_hot",
    """WITH k AS (SELECT p_name FROM part GROUP BY p_name HAVING count(*) >= 30),
    y AS (SELECT p_type FROM part GROUP BY p_type HAVING count(*) >= 30),
    c AS (SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM k) THEN p_name ELSE '(rare)' END AS n,
      CASE WHEN p_type IN (SELECT p_type FROM y) THEN p_type ELSE '(rare)' END AS p_type FROM part)
    SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY n) - 1 AS BIGINT) AS name_slot, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS BIGINT) AS type_slot FROM c""",
)
def j3(spark, d):
    got = features.one_hot(table(spark, d, "part"), ["p_name", "p_type"], 30)

    def slot(c):
        return (F.array_position(vector_to_array(c), F.lit(1.0)) - 1).cast("long")

    return got.select("p_partkey", slot("p_name_onehot").alias("name_slot"), slot("p_type_onehot").alias("type_slot"))


@query(
    "j4_feature_pipeline",
    """SELECT c_mktsegment AS segment, CAST(3 + (SELECT count(DISTINCT c_mktsegment) FROM customer) AS BIGINT) AS width,
    CAST(count(*) AS BIGINT) AS rows FROM customer GROUP BY 1""",
)
def j4(spark, d):
    """Two numbers, a place for each value of the category and one for values not seen."""
    df = table(spark, d, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment", F.lit(1).alias("y"))
    got = features.feature_pipeline(df, "y").transform(df)
    width = F.size(vector_to_array("features")).cast("long").alias("width")
    return got.select(F.col("c_mktsegment").alias("segment"), width).groupBy("segment", "width").agg(F.count(F.lit(1)).alias("rows"))


@query("j5_label_index", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS label FROM part")
def j5(spark, d):
    return features.label_index(table(spark, d, "part"), "p_brand").select("p_partkey", "label")


@query(
    "j6_infer_problem_type",
    "SELECT 'p_brand' AS column_name, 'classification' AS problem FROM part HAVING count(*) > 0 UNION ALL "
    + " UNION ALL ".join(
        f"""SELECT '{c}', CASE WHEN count(DISTINCT {c}) <= greatest(10, floor(0.05 * count({c}))) AND count(DISTINCT {c}) < 20 THEN 'classification' ELSE 'regression' END FROM part"""
        for c in ("p_size", "p_retailprice")
    )
    + " UNION ALL SELECT 'l_linenumber', CASE WHEN count(DISTINCT l_linenumber) < 10 THEN 'classification' ELSE 'regression' END FROM lineitem",
)
def j6(spark, d):
    part, line = table(spark, d, "part"), table(spark, d, "lineitem")
    rows = [(c, features.infer_problem_type(part, c)) for c in ("p_brand", "p_size", "p_retailprice")]
    rows.append(("l_linenumber", features.infer_problem_type(line, "l_linenumber")))
    return small_table(spark, rows, "column_name string, problem string")


@query(
    "j7_class_weights",
    """WITH n AS (SELECT CAST(quality AS VARCHAR) AS class, count(*) AS count FROM labels GROUP BY 1)
    SELECT class, CAST(count AS BIGINT) AS count, round((SELECT sum(count) FROM n) / ((SELECT count(*) FROM n) * count), 6) + 0.0 AS weight,
    round((SELECT max(count) FROM n) / (SELECT min(count) FROM n), 6) + 0.0 AS ratio, (SELECT max(count) FROM n) / (SELECT min(count) FROM n) > 3 AS imbalanced FROM n""",
)
def j7(spark, d):
    got = features.class_weights(table(spark, d, "labels"), "quality")
    return got.withColumns({"weight": r("weight", 6), "ratio": r("ratio", 6)})


# ---- training


def _documents(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


def _decided(spark, d):
    """Customers whose class their segment decides: every model can find it."""
    df = table(spark, d, "customer")
    return df.select("c_custkey", "c_mktsegment", F.when(F.col("c_mktsegment") < "F", "early").otherwise("late").alias("label"))


def _decided_sql(models: str) -> str:
    return f"""SELECT CAST(row_number() OVER (ORDER BY m) AS BIGINT) AS rank, m AS model, CAST(1 AS DOUBLE) AS primary_score, CAST(NULL AS VARCHAR) AS error
    FROM (SELECT unnest([{models}]) AS m) WHERE (SELECT count(DISTINCT c_mktsegment < 'F') FROM customer) = 2"""


@query("k1_train_classifiers", _decided_sql("'Gradient Boosting', 'Histogram Gradient Boosting', 'K-Nearest Neighbors', 'Logistic Regression', 'Random Forest'"))
def k1(spark, d):
    run = training.train_models(_decided(spark, d), "label", ["c_custkey"])
    return run.leaderboard.select("rank", "model", r("primary_score", 6).alias("primary_score"), "error")


@query("k1_train_on_texts")
def k1_texts(spark, d):
    run = training.train_models(_documents(spark, d), "quality", ["doc_id"])
    return run.leaderboard.select("rank", "model", "primary_score", "error")


@query(
    "k2_train_regressors",
    """SELECT m AS model, true AS fits, CAST(NULL AS VARCHAR) AS error FROM (SELECT unnest(['Gradient Boosting', 'Histogram Gradient Boosting', 'K-Nearest Neighbors',
    'Random Forest', 'Ridge Regression']) AS m) WHERE (SELECT count(*) FROM part) > 0""",
)
def k2(spark, d):
    """A target that is linear in the one feature: every model explains nearly all of it."""
    df = table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_size") * 3.0 + 5).alias("y"))
    run = training.train_models(df, "y", ["p_partkey"])
    return run.leaderboard.select("model", (F.col("primary_score") > 0.95).alias("fits"), "error")


@query(
    "k1_histogram_boosting",
    """SELECT CAST(3 AS BIGINT) AS classes, true AS fits, CASE WHEN count(*) > 0 THEN 'p_size' END AS strongest FROM part""",
)
def k1_histogram(spark, d):
    """All columns of a table; one of them decides between three classes."""
    df = table(spark, d, "part", spread=True).drop("p_name")
    size = F.when(F.col("p_size") <= 15, "small").when(F.col("p_size") <= 35, "middle").otherwise("large")
    df = df.withColumn("kind", size)
    prep = features.feature_pipeline(df.drop("p_partkey"), "kind")
    rows = prep.transform(features.label_index(df, "kind")).withColumn("w", F.lit(1.0))
    model = boosting.HistogramBoosting(3, "features", "label", "w", "guess", "odds").fit(rows)
    got = model.transform(rows).agg(F.avg((F.col("guess") == F.col("label")).cast("double")).alias("right"))
    attrs = rows.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    top = names[int(model.featureImportances.toArray().argmax())]
    strongest = F.regexp_extract(F.lit(top), "p_[a-z]+", 0).alias("strongest")
    return got.select(F.lit(3).cast("long").alias("classes"), (F.col("right") > 0.99).alias("fits"), strongest)


@query("k4_train_large", _decided_sql("'Gradient Boosting', 'Logistic Regression'"))
def k4(spark, d):
    run = training.train_large(_decided(spark, d), "label", ["c_custkey"])
    return run.leaderboard.select("rank", "model", r("primary_score", 6).alias("primary_score"), "error")


KNN_SQL = """WITH n AS (SELECT label AS c, count(*) AS n FROM embeddings GROUP BY 1),
 e AS (SELECT c, (SELECT round(sum(n) * 0.2) FROM n) * n / (SELECT sum(n) FROM n) AS x FROM n),
 f AS (SELECT c, floor(x) AS q, x - floor(x) AS rest FROM e),
 g AS (SELECT c, greatest(q + CASE WHEN row_number() OVER (ORDER BY rest DESC, CAST(c AS VARCHAR)) <= (SELECT round(sum(n) * 0.2) FROM n) - (SELECT sum(q) FROM f) THEN 1 ELSE 0 END, 1) AS q FROM f),
 k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':42'), vec_id) AS rn FROM embeddings),
 s AS (SELECT vec_id, label, embedding, rn <= q AS test FROM k JOIN g ON c = label),
 l AS (SELECT vec_id, label, test, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM s),
 p AS (SELECT i, avg(v) AS m, stddev_pop(v) AS sd FROM l WHERE NOT test GROUP BY i),
 z AS (SELECT vec_id, label, test, i, (v - m) / sd AS v FROM l JOIN p USING (i)),
 d AS (SELECT a.vec_id AS a, b.vec_id AS b, any_value(b.label) AS y, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS dist FROM z a JOIN z b ON a.i = b.i AND a.test AND NOT b.test GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS rn FROM d),
 v AS (SELECT a, y, count(*) AS n FROM r WHERE rn <= 5 GROUP BY 1, 2)
 SELECT a AS vec_id, CAST(y AS BIGINT) AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, y) = 1"""


def _vectors(spark, d):
    emb = table(spark, d, "embeddings", spread=True)
    return emb.selectExpr("vec_id", "label", *[f"double(embedding[{i}]) AS x{i}" for i in range(64)])


@query("k3_knn_predict", KNN_SQL)
def k3(spark, d):
    train, test = sample.train_test_split(_vectors(spark, d), ["vec_id"], "label")
    got = neighbours.knn_predict(train, test, [f"x{i}" for i in range(64)], "label", "vec_id", 5, classify=True)
    return got.select("vec_id", F.col("prediction").cast("long").alias("prediction"))


SCORED = """(SELECT o_orderkey, o_orderstatus, CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_custkey > 700 THEN 'O' ELSE 'P' END AS guess,
 round(o_totalprice / 1000) + CASE WHEN o_orderstatus = 'F' THEN 20 ELSE 0 END AS score FROM orders)"""


def _scored(spark, d):
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.when(price < 150000, "F").when(F.col("o_custkey") > 700, "O").otherwise("P").alias("guess"),
        (F.round(price / 1000) + F.when(F.col("o_orderstatus") == "F", 20).otherwise(0)).alias("score"),
    )


@query(
    "k5_classification_metrics",
    f"""WITH s AS {SCORED}, c AS (SELECT DISTINCT o_orderstatus AS c FROM s),
    m AS (SELECT c, (SELECT count(*) FROM s WHERE o_orderstatus = c) AS n, (SELECT count(*) FROM s WHERE guess = c) AS p, (SELECT count(*) FROM s WHERE guess = c AND o_orderstatus = c) AS h FROM c),
    x AS (SELECT c, n, coalesce(h / nullif(p, 0), 0) AS pr, h / n AS re, 2 * h / (n + p) AS f1 FROM m),
    k AS (SELECT o_orderstatus = 'F' AS pos, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s)
    SELECT metric, round(value, 6) + 0.0 AS value FROM (
      SELECT 'accuracy' AS metric, (SELECT sum(h) / sum(n) FROM m) AS value UNION ALL SELECT 'precision_weighted', sum(pr * n) / sum(n) FROM x
      UNION ALL SELECT 'recall_weighted', sum(re * n) / sum(n) FROM x UNION ALL SELECT 'f1_weighted', sum(f1 * n) / sum(n) FROM x
      UNION ALL SELECT 'f1_macro', avg(f1) FROM x UNION ALL SELECT 'recall[' || c || ']', re FROM x
      UNION ALL SELECT 'roc_auc', (sum(rk) FILTER (WHERE pos) - CAST(count(*) FILTER (WHERE pos) AS DOUBLE) * (count(*) FILTER (WHERE pos) + 1) / 2) / (CAST(count(*) FILTER (WHERE pos) AS DOUBLE) * count(*) FILTER (WHERE NOT pos)) FROM k)""",
)
def k5(spark, d):
    got = metrics.classification_metrics(_scored(spark, d), "o_orderstatus", "guess", {"F": F.col("score")})
    return got.withColumn("value", r("value", 6))


@query(
    "k6_regression_metrics",
    """WITH s AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)
    SELECT 'rmse' AS metric, round(sqrt(avg((y - p) * (y - p))), 4) + 0.0 AS value FROM s UNION ALL SELECT 'mae', round(avg(abs(y - p)), 4) + 0.0 FROM s
    UNION ALL SELECT 'r2', round(1 - avg((y - p) * (y - p)) / var_pop(y), 4) + 0.0 FROM s""",
)
def k6(spark, d):
    df = table(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1500)
    return _rounded(metrics.regression_metrics(df, "l_extendedprice", "p"))


@query(
    "k7_leaderboard",
    """WITH g AS (SELECT o_orderstatus AS y, CASE WHEN o_totalprice < 150000 THEN 'F' ELSE 'O' END AS a, CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS b FROM orders),
    s AS (SELECT unnest(['by price', 'by key']) AS model, unnest([avg(CAST(y = a AS INT)), avg(CAST(y = b AS INT))]) AS v FROM g)
    SELECT CAST(row_number() OVER (ORDER BY v DESC, model) AS BIGINT) AS rank, model, round(v, 6) + 0.0 AS primary_score, CAST(NULL AS VARCHAR) AS error FROM s
    UNION ALL SELECT 3, 'broken', NULL, 'no fit'""",
)
def k7(spark, d):
    """Two given predictions ranked by accuracy, and a failure."""
    price = F.when(F.col("o_totalprice") < 150000, "F").otherwise("O")
    key = F.when(F.col("o_custkey") % 2 == 0, "F").otherwise("O")
    runs = []
    for name, guess in (("by key", key), ("by price", price)):
        scored = table(spark, d, "orders").select("o_orderstatus", guess.alias("guess"))
        found = {t["metric"]: t["value"] for t in metrics.classification_metrics(scored, "o_orderstatus", "guess").collect()}
        runs.append((name, found, found["accuracy"], None))
    board = training.leaderboard(spark, [("broken", None, None, "no fit"), *runs])
    return board.select("rank", "model", r("primary_score", 6).alias("primary_score"), "error")


def _sized_run(spark, d):
    """Parts whose class their size decides, beside two columns that say nothing."""
    df = table(spark, d, "part").select("p_partkey", "p_size", F.lit(1).alias("flat"), F.lit("x").alias("same"), F.when(F.col("p_size") > 25, "large").otherwise("small").alias("label"))
    return df, training.train_models(df, "label", ["p_partkey"])


@query("k8_feature_importance", "SELECT 'p_size' AS feature, CAST(1 AS DOUBLE) AS importance FROM part HAVING count(*) > 0")
def k8(spark, d):
    df, run = _sized_run(spark, d)
    got = training.feature_importance(run.models["Random Forest"], df)
    return got.where("importance > 0").select(F.regexp_extract("feature", "(p_size|flat|same)", 1).alias("feature"), r("importance", 6).alias("importance"))


SIZED = "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS prediction FROM part"


@query("k9_predict", SIZED)
def k9(spark, d):
    """Without one of the features, which then counts as missing."""
    df, run = _sized_run(spark, d)
    return training.predict(run.models["Random Forest"], df.drop("label", "same")).select("p_partkey", "prediction")


@query(
    "k10_save_and_load_model",
    """SELECT m AS model, CAST((SELECT count(*) FROM part) AS BIGINT) AS same FROM (SELECT unnest(['Gradient Boosting', 'Histogram Gradient Boosting',
    'K-Nearest Neighbors', 'Logistic Regression', 'Random Forest']) AS m)""",
)
def k10(spark, d):
    """Rows that every model, loaded again, predicts as before."""
    df, run = _sized_run(spark, d)
    out = None
    for name, model in run.models.items():
        path = scratch(spark)
        training.save_model(model, path)
        before = training.predict(model, df).select("p_partkey", F.col("prediction").alias("a"))
        after = training.predict(training.load_model(path), df).select("p_partkey", F.col("prediction").alias("b"))
        one = before.join(after, "p_partkey").agg(F.count_if(F.col("a") == F.col("b")).alias("same"))
        one = one.select(F.lit(name).alias("model"), "same")
        out = one if out is None else out.unionByName(one)
    return out


# ---- clustering


def _groups(spark, d):
    """Customers in four groups far from each other."""
    g = F.col("c_custkey") % 4
    at = F.when(g == 0, 0).when(g == 1, 300).when(g == 2, 1000).otherwise(1300)
    x, y = at + F.col("c_custkey") % 7, at + F.col("c_custkey") % 5
    return table(spark, d, "customer").select("c_custkey", x.cast("double").alias("x"), y.cast("double").alias("y"))


def _found_groups(labelled):
    """Clusters by the one group they hold; a cluster across groups would show as -1."""
    g = F.col("c_custkey") % 4
    whole = labelled.groupBy("cluster_label").agg(F.min(g).alias("lo"), F.max(g).alias("hi"), F.count(F.lit(1)).alias("rows"))
    return whole.select(F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-1).cast("long").alias("grp"), "rows")


GROUP_SIZES = "SELECT CAST(c_custkey % 4 AS BIGINT) AS grp, CAST(count(*) AS BIGINT) AS rows FROM customer GROUP BY 1"
GROUP_COUNT = "SELECT CAST(count(DISTINCT c_custkey % 4) AS BIGINT) AS k FROM customer"


@query("l1_kmeans", GROUP_SIZES)
def l1(spark, d):
    return _found_groups(cluster.kmeans(_groups(spark, d), 4, ["x", "y"], "c_custkey")[0])


@query("l1_kmeans_nearest", "SELECT CAST(count(*) AS BIGINT) AS nearest FROM embeddings")
def l1_nearest(spark, d):
    """Rows whose cluster has the nearest of the ten centres."""
    names = [f"x{i}" for i in range(64)]
    df = _vectors(spark, d).select("vec_id", *names)
    labelled, centres, _ = cluster.kmeans(df, 10, names, "vec_id")
    points = features.prepared(df, names)[0]
    at: dict = {}
    for c in centres.collect():  # ten centres
        at.setdefault(c["cluster"], {})[c["column_name"]] = c["value"]

    def far(m):
        gaps = F.zip_with("x", F.array(*[F.lit(m[n]) for n in names]), lambda u, v: (u - v) * (u - v))
        return F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g)

    near = F.array_min(F.array(*[F.struct(far(m).alias("d"), F.lit(k).alias("cluster")) for k, m in at.items()]))
    points = points.select("vec_id", F.array(*names).alias("x"))
    got = points.join(labelled.select("vec_id", "cluster_label"), "vec_id")
    return got.agg(F.count_if(near["cluster"] == F.col("cluster_label")).alias("nearest"))


DBSCAN_SQL = """WITH RECURSIVE m AS (SELECT avg(p_size) AS ma, stddev_pop(p_size) AS sa, avg(p_retailprice) AS mb, stddev_pop(p_retailprice) AS sb FROM part),
 z AS (SELECT p_partkey AS id, (p_size - ma) / sa AS x, (p_retailprice - mb) / sb AS y FROM part, m),
 e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM z a JOIN z b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.06 * 0.06),
 c AS MATERIALIZED (SELECT a AS id FROM e GROUP BY a HAVING count(*) >= 4),
 ce AS MATERIALIZED (SELECT a, b FROM e WHERE a IN (SELECT id FROM c) AND b IN (SELECT id FROM c)),
 lab(i, id, root) AS (SELECT 0, id, id FROM c UNION ALL
   SELECT any_value(lab.i) + 1, ce.a, min(lab.root) FROM ce JOIN lab ON lab.id = ce.b WHERE lab.i < 150 GROUP BY ce.a),
 fin AS (SELECT id, min(root) AS root FROM lab GROUP BY id),
 num AS (SELECT root, dense_rank() OVER (ORDER BY root) - 1 AS label FROM (SELECT DISTINCT root FROM fin)),
 core AS (SELECT id, label FROM fin JOIN num USING (root)),
 edge AS (SELECT e.a AS id, min(label) AS label FROM e JOIN core ON core.id = e.b WHERE e.a NOT IN (SELECT id FROM c) GROUP BY 1)
 SELECT p_partkey, CAST(coalesce(core.label, edge.label, -1) AS BIGINT) AS cluster_label FROM part LEFT JOIN core ON core.id = p_partkey LEFT JOIN edge ON edge.id = p_partkey"""


@query("l2_dbscan", DBSCAN_SQL)
def l2(spark, d):
    return cluster.dbscan(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"], 0.06, 4)


@query("l3_hierarchical", GROUP_SIZES)
def l3(spark, d):
    return _found_groups(cluster.hierarchical(_groups(spark, d), 4, ["x", "y"], "c_custkey")[0])


@query(
    "l4_cluster_metrics",
    """WITH t AS (SELECT o_orderkey AS k, o_orderpriority AS c, o_totalprice / 1000 + length(o_orderpriority) * 40 AS x, CAST(o_custkey AS DOUBLE) AS y FROM orders),
    g AS (SELECT c, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM t GROUP BY c), o AS (SELECT avg(x) AS ox, avg(y) AS oy, count(*) AS n FROM t),
    w AS (SELECT c, sum((x - mx) ** 2 + (y - my) ** 2) AS w, avg(sqrt((x - mx) ** 2 + (y - my) ** 2)) AS s FROM t JOIN g USING (c) GROUP BY c),
    ch AS (SELECT (SELECT sum(g.n * ((mx - ox) ** 2 + (my - oy) ** 2)) FROM g, o) / ((SELECT count(*) FROM g) - 1) / ((SELECT sum(w) FROM w) / ((SELECT n FROM o) - (SELECT count(*) FROM g))) AS v),
    p AS (SELECT a.c AS a, max((wa.s + wb.s) / sqrt((a.mx - b.mx) ** 2 + (a.my - b.my) ** 2)) AS r FROM g a JOIN g b ON a.c <> b.c JOIN w wa ON wa.c = a.c JOIN w wb ON wb.c = b.c GROUP BY 1),
    v AS (SELECT c, w.w / g.n AS var, g.n, mx, my FROM g JOIN w USING (c)),
    d AS (SELECT k, t.c AS c, v.c AS bc, (x - mx) ** 2 + (y - my) ** 2 + var AS s, n FROM t, v),
    ab AS (SELECT k, max(CASE WHEN c = bc THEN s * n / (n - 1) END) AS a, min(CASE WHEN c <> bc THEN s END) AS b FROM d GROUP BY k)
    SELECT 'silhouette_squared' AS metric, (SELECT round(avg((b - a) / greatest(a, b)), 6) + 0.0 FROM ab) AS value
    UNION ALL SELECT 'calinski_harabasz', (SELECT round(v, 4) + 0.0 FROM ch) UNION ALL SELECT 'davies_bouldin', (SELECT round(avg(r), 4) + 0.0 FROM p)""",
)
def l4(spark, d):
    got = table(spark, d, "orders").select(
        "o_orderkey",
        "o_orderpriority",
        (F.col("o_totalprice") / 1000 + F.length("o_orderpriority") * 40).alias("x"),
        F.col("o_custkey").cast("double").alias("y"),
    )
    out = metrics.cluster_metrics(got, "o_orderpriority", ["x", "y"], ["o_orderkey"])
    return out.withColumn("value", F.when(F.col("metric") == "silhouette_squared", r("value", 6)).otherwise(r("value", 4)))


@query("l5_suggest_k", GROUP_COUNT)
def l5(spark, d):
    return clustering.suggest_k(_groups(spark, d), "c_custkey").where("recommended").select("k")


@query("l6_cluster_best", GROUP_SIZES)
def l6(spark, d):
    return _found_groups(clustering.cluster_best(_groups(spark, d), "c_custkey")[0])


# ---- anomalies


@query("m1_isolation_forest", "SELECT c_custkey, c_custkey % 10 = 0 AS is_anomaly FROM customer")
def m1(spark, d):
    """One row in ten lies far from a dense group, each in a place of its own."""
    key = F.col("c_custkey")
    far = key % 10 == 0
    x = F.when(far, 1000 + key * 37 % 5000).otherwise(key % 13 / 10)
    y = F.when(far, -1000 - key * 53 % 7000).otherwise(key % 17 / 10)
    df = table(spark, d, "customer").select(key, x.cast("double").alias("x"), y.cast("double").alias("y"))
    return anomaly.isolation_forest(df, "c_custkey", ["x", "y"]).select("c_custkey", "is_anomaly")


@query("m1_isolation_forest_text_key", "SELECT c_name, c_custkey % 10 = 0 AS is_anomaly FROM customer")
def m1_text(spark, d):
    key = F.col("c_custkey")
    far = key % 10 == 0
    x = F.when(far, 1000 + key * 37 % 5000).otherwise(key % 13 / 10)
    y = F.when(far, -1000 - key * 53 % 7000).otherwise(key % 17 / 10)
    df = table(spark, d, "customer").select("c_name", x.cast("double").alias("x"), y.cast("double").alias("y"))
    return anomaly.isolation_forest(df, "c_name", ["x", "y"]).select("c_name", "is_anomaly")


@query(
    "m2_lof",
    """WITH m AS (SELECT avg(c_nationkey) AS ma, stddev_pop(c_nationkey) AS sa, avg(c_acctbal) AS mb, stddev_pop(c_acctbal) AS sb FROM customer),
    z AS (SELECT c_custkey AS id, (c_nationkey - ma) / sa AS x, (c_acctbal - mb) / sb AS y FROM customer, m),
    e AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM z a JOIN z b ON a.id <> b.id
      QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY d, b.id) <= 20),
    k AS (SELECT a, max(d) AS kd FROM e GROUP BY a),
    l AS (SELECT e.a, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM e JOIN k ON k.a = e.b GROUP BY e.a),
    f AS (SELECT e.a AS id, avg(lb.lrd) / any_value(la.lrd) AS lof FROM e JOIN l la ON la.a = e.a JOIN l lb ON lb.a = e.b GROUP BY e.a)
    SELECT id AS c_custkey, round(lof, 4) + 0.0 AS lof, lof > (SELECT quantile_cont(lof, 0.9) FROM f) AS is_anomaly FROM f""",
)
def m2(spark, d):
    got = neighbours.lof_anomalies(table(spark, d, "customer"), "c_custkey", ["c_nationkey", "c_acctbal"])
    return got.select("c_custkey", r("lof").alias("lof"), "is_anomaly")


# ---- components


#: a column, its negative and another one: with correlation r the eigenvalues are (3 + sqrt(1 + 8 r^2)) / 2, the same with a minus, and 0
TRIPLE = """e AS (SELECT corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem),
 v AS (SELECT n, (3 + sqrt(1 + 8 * r * r)) / 6 * 100 AS a, (3 - sqrt(1 + 8 * r * r)) / 6 * 100 AS b FROM e)"""
TRIPLE_COLS = ["l_quantity", "negative", "l_extendedprice"]


def _triple(spark, d):
    return table(spark, d, "lineitem").withColumn("negative", -F.col("l_quantity"))


@query(
    "n1_pca_analyse",
    f"""WITH {TRIPLE} SELECT true AS feasible, CAST(3 AS BIGINT) AS columns, CAST(n AS BIGINT) AS rows,
    CAST(CASE WHEN round(a, 2) >= 80 THEN 1 ELSE 2 END AS BIGINT) AS for_80, CAST(CASE WHEN round(a, 2) >= 90 THEN 1 ELSE 2 END AS BIGINT) AS for_90,
    CAST(CASE WHEN round(a, 2) >= 95 THEN 1 ELSE 2 END AS BIGINT) AS for_95, CAST(100 AS DOUBLE) AS top2_pct, 'excellent' AS verdict FROM v""",
)
def n1(spark, d):
    return reduce.pca_analyse(_triple(spark, d), TRIPLE_COLS)


@query(
    "n1_pca_variance",
    f"""WITH {TRIPLE} SELECT CAST(1 AS BIGINT) AS component, round(a, 6) + 0.0 AS explained_pct, round(a, 6) + 0.0 AS cumulative_pct FROM v
    UNION ALL SELECT 2, round(b, 6) + 0.0, 100.0 FROM v UNION ALL SELECT 3, 0.0, 100.0 FROM v""",
)
def n1_variance(spark, d):
    return _rounded(reduce.pca_variance(_triple(spark, d), TRIPLE_COLS), 6)


@query(
    "n1_pca_variance_pair",
    """SELECT CAST(i AS BIGINT) AS component, round(CASE WHEN i = 1 THEN 1 + abs(r) ELSE 1 - abs(r) END * 50, 6) + 0.0 AS explained_pct,
    round(CASE WHEN i = 1 THEN 50 * (1 + abs(r)) ELSE 100 END, 6) + 0.0 AS cumulative_pct
    FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem), (VALUES (1), (2)) t(i)""",
)
def n1_pair(spark, d):
    """The eigenvalues of a 2 x 2 correlation matrix are 1 + |r| and 1 - |r|."""
    return _rounded(reduce.pca_variance(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]), 6)


@query(
    "n1_pca_wide",
    """WITH v AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings),
    c AS (SELECT a.i, b.i AS j, corr(a.x, b.x) AS r FROM v a JOIN v b USING (vec_id) GROUP BY a.i, b.i)
    SELECT CAST(64 AS BIGINT) AS components, CAST(100 AS DOUBLE) AS total_pct, round(sum(r * r), 4) + 0.0 AS squares FROM c""",
)
def n1_wide(spark, d):
    """All columns of the embeddings: the eigenvalues add up to their number, and their squares to the squares
    of all correlations."""
    found = reduce.pca_variance(_vectors(spark, d), [f"x{i}" for i in range(64)])
    value = F.col("explained_pct") * 64 / 100
    total = F.round(F.sum("explained_pct"), 6).cast("double").alias("total_pct")
    return found.agg(F.count("*").alias("components"), total, r(F.sum(value * value)).alias("squares"))


@query(
    "n1_pca_loadings",
    """SELECT c AS column_name, CAST(j AS BIGINT) AS component, round(1 / sqrt(2), 6) + 0.0 AS size FROM (SELECT unnest(['l_quantity', 'l_extendedprice']) AS c),
    (VALUES (1), (2)) t(j) WHERE (SELECT count(*) FROM lineitem) > 0""",
)
def n1_loadings(spark, d):
    """Both axes of a pair weigh its columns alike; which sign is whose may be either."""
    got = reduce.pca_loadings(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return got.select("column_name", "component", r(F.abs("loading"), 6).alias("size"))


PAIR = """WITH m AS (SELECT avg(l_quantity) AS ma, stddev_pop(l_quantity) AS sa, avg(l_extendedprice) AS mb, stddev_pop(l_extendedprice) AS sb, sign(corr(l_quantity, l_extendedprice)) AS s FROM lineitem)
 SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(((l_quantity - ma) / sa + s * (l_extendedprice - mb) / sb) / sqrt(2), 4) + 0.0 AS pc1 FROM lineitem, m"""


@query("n2_pca_project", PAIR)
def n2(spark, d):
    """Two standardised columns: the first axis is known to be their diagonal."""
    got = reduce.pca_project(table(spark, d, "lineitem"), LINE_KEYS, ["l_quantity", "l_extendedprice"])
    return got.select(*LINE_KEYS, r("pc1").alias("pc1"))


# ---- rules

FLAGS = """(SELECT 'l_returnflag=' || l_returnflag AS a, 'l_linestatus=' || l_linestatus AS b, 'o_orderstatus=' || o_orderstatus AS c,
 'o_orderpriority=' || CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
ITEMSETS = f"""t AS MATERIALIZED {FLAGS}, n AS (SELECT count(*) AS n FROM t),
 s AS (SELECT list_sort(list_filter([a, b, c, d], lambda v: v IS NOT NULL)) AS items, count(*) AS count FROM t
   GROUP BY CUBE (a, b, c, d) HAVING (grouping(a) = 1 OR a IS NOT NULL) AND (grouping(b) = 1 OR b IS NOT NULL) AND (grouping(c) = 1 OR c IS NOT NULL) AND (grouping(d) = 1 OR d IS NOT NULL)),
 f AS MATERIALIZED (SELECT items, count, count / (SELECT n FROM n) AS support FROM s WHERE len(items) > 0 AND count >= 0.1 * (SELECT n FROM n))"""


def _flags(spark, d):
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    wide = line.join(orders, line.l_orderkey == orders.o_orderkey)
    priority = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    return wide.select("l_returnflag", "l_linestatus", "o_orderstatus", priority.alias("o_orderpriority"))


@query(
    "o1_frequent_itemsets",
    f"WITH {ITEMSETS} SELECT array_to_string(items, '|') AS items, CAST(len(items) AS BIGINT) AS size, CAST(count AS BIGINT) AS count, round(support, 6) + 0.0 AS support FROM f",
)
def o1(spark, d):
    got = rules.frequent_itemsets(_flags(spark, d), min_support=0.1)
    return got.select(F.array_join("items", "|").alias("items"), "size", "count", r("support", 6).alias("support"))


@query(
    "o2_association_rules",
    f"""WITH {ITEMSETS},
    r AS (SELECT x.items AS ante, list_filter(w.items, lambda v: NOT list_contains(x.items, v)) AS cons, w.support AS support, w.support / x.support AS confidence
      FROM f w JOIN f x ON len(x.items) < len(w.items) AND list_has_all(w.items, x.items)),
    q AS (SELECT ante, cons, r.support, confidence, confidence / y.support AS lift FROM r JOIN f y ON y.items = r.cons WHERE confidence >= 0.3)
    SELECT array_to_string(ante, '|') AS antecedent, array_to_string(cons, '|') AS consequent, round(support, 6) + 0.0 AS support, round(confidence, 6) + 0.0 AS confidence, round(lift, 6) + 0.0 AS lift
    FROM q ORDER BY round(q.lift, 9) DESC, ante, cons LIMIT 50""",
)
def o2(spark, d):
    got = rules.association_rules(_flags(spark, d), min_support=0.1, min_confidence=0.3)
    return got.select(
        F.array_join("antecedent", "|").alias("antecedent"),
        F.array_join("consequent", "|").alias("consequent"),
        *[r(c, 6).alias(c) for c in ("support", "confidence", "lift")],
    )


# ---- what-if

SLOPE = f"(SELECT regr_slope(l_extendedprice, qty) FROM {LINEITEM})"


@query("p1_driver_slope", f"SELECT CAST(count(qty) AS BIGINT) AS rows_used, round(regr_slope(l_extendedprice, qty), 4) + 0.0 AS beta FROM {LINEITEM}")
def p1(spark, d):
    return _rounded(whatif.driver_slope(lineitem(spark, d), "qty", "l_extendedprice"))


def _scenario_sql(agg, dx):
    return f"""WITH t AS (SELECT l_extendedprice AS y, l_extendedprice + {SLOPE} * {dx} AS s FROM {LINEITEM} WHERE qty IS NOT NULL)
    SELECT CAST(count(*) AS BIGINT) AS rows_used, round({SLOPE}, 4) + 0.0 AS beta, round({agg}(y), 2) + 0.0 AS baseline, round({agg}(s), 2) + 0.0 AS scenario,
    round({agg}(s) - {agg}(y), 2) + 0.0 AS delta, round(({agg}(s) - {agg}(y)) / {agg}(y) * 100, 4) + 0.0 AS pct_delta FROM t"""


def _scenario(got):
    two = {c: r(c, 2) for c in ("baseline", "scenario", "delta")}
    return got.withColumns({**two, "beta": r("beta"), "pct_delta": r("pct_delta")})


@query("p2_scenario_percent", _scenario_sql("sum", "qty * 0.1"))
def p2(spark, d):
    return _scenario(whatif.scenario(lineitem(spark, d), "qty", "l_extendedprice"))


@query("p2_scenario_fixed_median", _scenario_sql("median", "-3"))
def p2_median(spark, d):
    return _scenario(whatif.scenario(lineitem(spark, d), "qty", "l_extendedprice", "fixed", -3, "median"))


HASH = "md5(l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_linenumber || ':42')"


def _u(h, start):
    return f"(('0x' || substr({h}, {start}, 8))::BIGINT / CAST(4294967296 AS DOUBLE))"


@query("p3_scenario_uniform", _scenario_sql("avg", f"qty * (-10 + 20 * {_u(HASH, 1)}) / 100"))
def p3(spark, d):
    return _scenario(whatif.scenario_random(lineitem(spark, d), "qty", "l_extendedprice", LINE_KEYS, aggregate="mean"))


@query("p3_scenario_normal", _scenario_sql("sum", f"qty * (5 + 10 * sqrt(-2 * ln(1 - {_u(HASH, 1)})) * cos(2 * pi() * {_u(HASH, 9)})) / 100"))
def p3_normal(spark, d):
    got = whatif.scenario_random(lineitem(spark, d), "qty", "l_extendedprice", LINE_KEYS, "normal_percent", 5.0)
    return _scenario(got)


def _hex(start):
    return f"('0x' || substr(h, {start}, 8))::BIGINT"


CUTS = "[" + ", ".join(str(c) for c in whatif.POISSON_CUTS) + "]"
BOOT = f"""b AS (SELECT l_extendedprice AS y, qty AS x, {HASH} AS h FROM {LINEITEM} WHERE qty IS NOT NULL),
 c AS (SELECT y, x, {_hex(1)} AS a, {_hex(9)} | 1 AS b, {_hex(17)} AS c, {_hex(25)} | 1 AS d FROM b),
 w AS MATERIALIZED (SELECT t AS trial, y, x, len(list_filter({CUTS}, lambda q: q <= (a + t * b) % 4294967296)) AS w, (c + t * d) % 4294967296 / CAST(4294967296 AS DOUBLE) AS u FROM c, range(1000) r(t)),
 s AS (SELECT trial, w, y, y + {SLOPE} * x * 0.1 AS s, y + {SLOPE} * x * (-10 + 20 * u) / 100 AS s2 FROM w WHERE w > 0),
 boot AS MATERIALIZED (SELECT trial, sum(w * s) / sum(w) * (SELECT count(*) FROM b) AS result, (sum(w * s) - sum(w * y)) / sum(w) * (SELECT count(*) FROM b) AS delta FROM s GROUP BY trial)"""


@query("p4_bootstrap_sum", f"WITH {BOOT} SELECT CAST(trial AS BIGINT) AS trial, round(result, 0) + 0.0 AS result, round(delta, 0) + 0.0 AS delta FROM boot")
def p4(spark, d):
    got = whatif.bootstrap(lineitem(spark, d), "qty", "l_extendedprice", LINE_KEYS)
    return got.select("trial", r("result", 0).alias("result"), r("delta", 0).alias("delta"))


@query(
    "p4_bootstrap_random_mean",
    f"WITH {BOOT} SELECT CAST(trial AS BIGINT) AS trial, round(sum(w * s2) / sum(w), 4) + 0.0 AS result, round((sum(w * s2) - sum(w * y)) / sum(w), 4) + 0.0 AS delta FROM s GROUP BY trial",
)
def p4_random(spark, d):
    got = whatif.bootstrap(
        lineitem(spark, d), "qty", "l_extendedprice", LINE_KEYS, "uniform_percent", aggregate="mean"
    )
    return _rounded(got)


@query(
    "p4_bootstrap_median",
    f"""WITH {BOOT}, o AS (SELECT trial, y, sum(w) AS w FROM s GROUP BY ALL), e AS (SELECT trial, y, w, sum(w) OVER (PARTITION BY trial ORDER BY y) AS upto, sum(w) OVER (PARTITION BY trial) AS n FROM o),
    o2 AS (SELECT trial, s, sum(w) AS w FROM s GROUP BY ALL), e2 AS (SELECT trial, s, w, sum(w) OVER (PARTITION BY trial ORDER BY s) AS upto, sum(w) OVER (PARTITION BY trial) AS n FROM o2),
    my AS (SELECT trial, (max(y) FILTER (WHERE upto - w <= (n - 1) // 2 AND (n - 1) // 2 < upto) + max(y) FILTER (WHERE upto - w <= n // 2 AND n // 2 < upto)) / 2 AS v FROM e GROUP BY trial),
    ms AS (SELECT trial, (max(s) FILTER (WHERE upto - w <= (n - 1) // 2 AND (n - 1) // 2 < upto) + max(s) FILTER (WHERE upto - w <= n // 2 AND n // 2 < upto)) / 2 AS v FROM e2 GROUP BY trial)
    SELECT CAST(trial AS BIGINT) AS trial, round(ms.v, 4) + 0.0 AS result, round(ms.v - my.v, 4) + 0.0 AS delta FROM ms JOIN my USING (trial)""",
)
def p4_median(spark, d):
    return _rounded(whatif.bootstrap(lineitem(spark, d), "qty", "l_extendedprice", LINE_KEYS, aggregate="median"))


@query(
    "p5_bootstrap_summary",
    f"""WITH {BOOT} SELECT CAST(count(*) AS BIGINT) AS trials, round(avg(result), 0) + 0.0 AS mean, round(median(result), 0) + 0.0 AS median, round(quantile_cont(result, 0.05), 0) + 0.0 AS p05,
    round(quantile_cont(result, 0.95), 0) + 0.0 AS p95, round(avg(delta), 0) + 0.0 AS delta, round(median(delta), 0) + 0.0 AS delta_median, round(quantile_cont(delta, 0.05), 0) + 0.0 AS delta_p05,
    round(quantile_cont(delta, 0.95), 0) + 0.0 AS delta_p95 FROM boot""",
)
def p5(spark, d):
    got = whatif.bootstrap_summary(whatif.bootstrap(lineitem(spark, d), "qty", "l_extendedprice", LINE_KEYS))
    return got.select("trials", *[r(c, 0).alias(c) for c in got.columns if c != "trials"])


@query(
    "p6_bootstrap_histogram",
    f"""WITH {BOOT}, m AS (SELECT min(result) AS lo, (max(result) - min(result)) / 20 AS w FROM boot)
    SELECT CAST(i AS BIGINT) AS bin, round(lo + i * w, 0) + 0.0 AS lo, round(lo + (i + 1) * w, 0) + 0.0 AS hi,
    CAST((SELECT count(*) FROM boot, m WHERE least(greatest(ceil((result - lo) / w) - 1, 0), 19) = i) AS BIGINT) AS count FROM m, range(20) t(i)""",
)
def p6(spark, d):
    got = whatif.bootstrap_histogram(whatif.bootstrap(lineitem(spark, d), "qty", "l_extendedprice", LINE_KEYS))
    return got.select("bin", r("lo", 0).alias("lo"), r("hi", 0).alias("hi"), "count")
