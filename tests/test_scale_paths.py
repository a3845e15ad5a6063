"""The paths meant for large tables, forced on small ones and checked by brute force: a third of
the rows shares one value, key or place."""

import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablekit.functions import order_stats
from tablekit.operators import anomaly, boxes, cluster, features, metrics, neighbours, rules, sample, whatif


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000).round(4)
    x[:1000] = 0.25
    y = rng.exponential(size=3000)
    y[::7] = np.nan
    pdf = pd.DataFrame({"id": np.arange(3000), "x": x, "y": y})
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    return df.repartition(5), pdf


def test_quantiles_by_narrow_digits(hot):
    df, pdf = hot
    probs = [0.0, 0.01, 0.25, 0.5, 0.62, 0.63, 0.999, 1.0]
    got = order_stats.exact_quantiles(df, {"x": probs, "y": probs}, digit=4)
    for c in ("x", "y"):
        want = pdf[c].quantile(probs)
        assert [got[c][p] for p in probs] == pytest.approx(list(want), abs=1e-12)
    direct = order_stats.exact_quantiles(df, {"x": probs, "y": probs})
    assert direct["x"] == pytest.approx(got["x"]) and direct["y"] == pytest.approx(got["y"])
    assert order_stats.exact_quantiles(df.limit(0), {"x": [0.5]}) == {"x": {0.5: None}}


def test_first_rows_with_ties(hot):
    df, pdf = hot
    for k in (1, 700, 1500, 2999, 3000):
        keep = order_stats.first_k(df, [F.col("x"), F.col("id")], k, digit=4)
        want = pdf.sort_values(["x", "id"]).head(k)["id"]
        assert {r["id"] for r in df.filter(keep).select("id").collect()} == set(want)


def test_auc_by_buckets(hot):
    df, pdf = hot
    got = metrics.rank_auc(df, F.floor(F.col("x") * 10), F.col("id") % 3 == 0)
    s, p = np.floor(pdf["x"] * 10), pdf["id"] % 3 == 0
    r = s.rank()
    n1, n0 = p.sum(), (~p).sum()
    assert got == pytest.approx((r[p].sum() - n1 * (n1 + 1) / 2) / (n1 * n0), abs=1e-12)


def test_samples_are_exact(hot):
    df, pdf = hot
    few = sample.sample_n(df, 100, ["id"])
    assert few.count() == 100
    want = df.withColumn("h", F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit("42")))).orderBy("h").limit(100)
    assert {r["id"] for r in few.collect()} == {r["id"] for r in want.collect()}
    # one key for everything: the hash cannot select, the size must still hold
    assert sample.sample_n(df.withColumn("k", F.lit(1)), 100, ["k"]).count() == 100
    labelled = df.withColumn("c", F.when(F.col("x") == 0.25, "hot").otherwise((F.col("id") % 4).cast("string")))
    small = [sample.train_test_split(labelled, ["id"], "c", small_class=10**9), sample.train_test_split(labelled, ["id"], "c", small_class=50)]
    parts = [[{r["id"] for r in p.select("id").collect()} for p in pair] for pair in small]
    assert parts[0] == parts[1] and len(parts[0][1]) == 600 and not parts[0][0] & parts[0][1]
    for n in (10, 900):
        a = sample.stratified_sample(labelled, "c", ["id"], n, small_class=10**9)
        b = sample.stratified_sample(labelled, "c", ["id"], n, small_class=50)
        assert a.count() == n and {r["id"] for r in a.collect()} == {r["id"] for r in b.collect()}


def _cloud(n, dims, seed):
    """Clusters, noise, and a third of the rows at one place."""
    rng = np.random.default_rng(seed)
    pts = np.vstack([rng.normal(c, 0.3, size=(n // 3, dims)) for c in (0, 3)] + [rng.uniform(-4, 7, size=(n - 2 * (n // 3), dims))])
    pts = pts.round(3)
    pts[: n // 3] = pts[0]
    keys = rng.permutation(n)
    pdf = pd.DataFrame(pts, columns=[f"x{j}" for j in range(dims)]).assign(id=keys).sort_values("id")
    return pdf.reset_index(drop=True)


def _dist(pdf):
    x = pdf.drop(columns="id").to_numpy()
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))


@pytest.mark.parametrize("dims", [2, 5])
def test_knn_join(spark, dims):
    pdf = _cloud(600, dims, dims)
    cols = [c for c in pdf.columns if c != "id"]
    df = spark.createDataFrame(pdf)
    x = F.array(*cols)
    got = neighbours.knn_join(
        df.select(F.col("id").alias("qkey"), x.alias("x")), df.select(F.col("id").alias("pkey"), x.alias("x")), 7,
        pivots=12, points_block=40, queries_block=50,
    ).toPandas()
    d = _dist(pdf)
    order = np.argsort(d, axis=1, kind="stable")[:, :7]  # ids are sorted: ties by id
    want = {(i, int(j)) for i in range(len(pdf)) for j in order[i]}
    assert set(zip(got["qkey"], got["pkey"])) == want


def test_lof_with_copies(spark):
    pdf = _cloud(450, 2, 3)
    k = 6
    got = neighbours.local_outlier_factor(spark.createDataFrame(pdf), "id", ["x0", "x1"], k, standardise=False)
    got = got.toPandas().sort_values("id")["lof"].to_numpy()
    d = _dist(pdf)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, axis=1)
    reach = np.maximum(dist, dist.max(axis=1)[near]).mean(axis=1)
    lrd = 1 / (reach + 1e-10)
    want = lrd[near].mean(axis=1) / lrd
    assert len(got) == len(pdf) and np.allclose(got, want, rtol=1e-6)


def _dbscan(pdf, eps, m):
    near = _dist(pdf) <= eps
    core = near.sum(axis=1) >= m
    label = np.full(len(pdf), -1)
    c = 0
    for i in range(len(pdf)):
        if not core[i] or label[i] >= 0:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if label[j] >= 0:
                continue
            label[j] = c
            if core[j]:
                stack += [int(v) for v in np.nonzero(near[j] & (label < 0))[0]]
        c += 1
    return label


@pytest.mark.parametrize("dims,eps,m", [(2, 0.25, 5), (2, 0.6, 4), (3, 0.5, 5), (4, 0.9, 4)])
def test_dbscan(spark, monkeypatch, dims, eps, m):
    monkeypatch.setattr(cluster, "ROWS_PER_SALT", 7)
    pdf = _cloud(500, dims, 10 + dims)
    cols = [c for c in pdf.columns if c != "id"]
    got = cluster.dbscan(spark.createDataFrame(pdf), "id", cols, eps, m, standardise=False).toPandas().sort_values("id")
    want = _dbscan(pdf, eps, m)
    assert want.max() > 0 and (want == -1).any()
    assert list(got["cluster_label"]) == list(want)


def test_dbscan_in_eight_columns_lists_no_pairs(spark, monkeypatch):
    sizes = []
    for module in (cluster, boxes):
        real = module.checkpoint

        def counted(df, real=real):
            out = real(df)
            sizes.append(out.count())
            return out

        monkeypatch.setattr(module, "checkpoint", counted)
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(2000, 8)), columns=list("abcdefgh")).assign(id=np.arange(2000))
    got = cluster.dbscan(spark.createDataFrame(pdf), "id", list("abcdefgh"), 2.5, 5, standardise=False)
    assert list(got.toPandas().sort_values("id")["cluster_label"]) == list(_dbscan(pdf, 2.5, 5))
    assert max(sizes) <= 2000 * -(-2000 // boxes.WANTED)  # rows times regions


def test_dbscan_of_crowded_cells_in_small_blocks(spark, monkeypatch):
    for module, name, value in ((boxes, "POINTS", 64), (boxes, "WANTED", 20), (cluster, "CARRIED", 2), (cluster, "ROWS_PER_SALT", 50)):
        monkeypatch.setattr(module, name, value)
    rng = np.random.default_rng(5)
    crowds = [rng.normal(size=(900, 2)) * 0.15, rng.normal(size=(600, 2)) * 0.15 + [1.0, 0.2], rng.uniform(-2, 2, size=(300, 2))]
    pdf = pd.DataFrame(rng.permutation(np.concatenate(crowds)), columns=["a", "b"]).assign(id=np.arange(1800))
    got = cluster.dbscan(spark.createDataFrame(pdf), "id", ["a", "b"], 0.12, 6, standardise=False)
    want = _dbscan(pdf, 0.12, 6)
    assert want.max() > 0 and (want == -1).any()
    assert list(got.toPandas().sort_values("id")["cluster_label"]) == list(want)


def test_regions_hold_all_that_is_near():
    rng = np.random.default_rng(3)
    lo = np.concatenate([rng.normal(size=(400, 3)), np.zeros((200, 3))])
    hi = lo + rng.uniform(0, 0.1, size=lo.shape)
    tree = boxes.fit_tree(lo, 16)
    home = boxes._homes(tree, lo)
    met = {(r, i) for r, rows in boxes._visits(tree, lo, hi, 0.5, 0.1) for i in rows}
    gap, _ = boxes.gap_and_span(lo, hi, lo, hi)
    assert (home >= 0).all() and len(set(home)) > 4
    assert all((home[i], j) in met for i, j in zip(*np.nonzero(gap <= 0.25)))


def test_components_of_a_chain(spark):
    nodes = spark.range(300)
    links = spark.range(299).filter("id != 150").select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = cluster.connected_components(nodes, links).groupBy("root").count().orderBy("root").collect()
    assert [tuple(r) for r in got] == [(0, 151), (151, 149)]


def test_median_bootstrap(spark, hot):
    df, _ = hot
    args = (df, "x", "y", ["id"])
    got = whatif.bootstrap(*args, aggregate="median", trials=100).toPandas().sort_values("trial")
    rows = whatif._seeded(whatif._complete(df, "x", "y", ["id"]), 1, 42).toPandas()
    beta = whatif.driver_slope(df, "x", "y").first()["beta"]
    ts = np.arange(100)
    copies = whatif._copies(rows, ts)
    s = (rows["y"] + beta * rows["x"] * 0.1).to_numpy()
    want = [np.median(np.repeat(s, copies[:, t])) for t in ts]
    assert np.allclose(got["result"], want)
    assert abs(copies.mean() - 1) < 0.01 and abs(copies.var() - 1) < 0.03
    rand = whatif.bootstrap(*args, "normal_percent", 5.0, aggregate="median", trials=100).toPandas()
    assert len(rand) == 100 and rand["result"].notna().all()


def test_itemsets_by_fp_growth(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({c: rng.choice(list("aab"), 400) for c in "pqr"}).assign(flag=rng.random(400) < 0.4)
    pdf.loc[::9, "q"] = None
    df = spark.createDataFrame(pdf)
    baskets = [
        [f"{c}={v}" for c, v in zip("pqr", row) if v is not None] + ["flag"] * bool(row[3]) for row in pdf.itertuples(index=False)
    ]
    counts = Counter(c for b in baskets for n in range(1, 5) for c in itertools.combinations(sorted(b), n))
    want = {(i, n) for i, n in counts.items() if n >= 40}
    got = {(tuple(r["items"]), r["count"]) for r in rules.frequent_itemsets(df).collect()}
    assert got == want and any("flag" in i for i, _ in got)


def test_isolation_forest(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1000, 3))
    x[:20] += 8
    pdf = pd.DataFrame(x, columns=list("abc")).assign(id=np.arange(1000))
    got = anomaly.isolation_forest(spark.createDataFrame(pdf), "id", contamination=0.02, trees=40).toPandas()
    assert got["is_anomaly"].sum() == 20
    assert set(got.loc[got["is_anomaly"], "id"]) == set(range(20))


def test_silhouette(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(size=(300, 2)), columns=["a", "b"]).assign(id=np.arange(300), c=rng.integers(0, 3, 300))
    pdf.loc[0, "c"] = 9  # a cluster of one
    pdf["a"] += pdf["c"] * 2
    got = {r["metric"]: r["value"] for r in metrics.cluster_metrics(spark.createDataFrame(pdf), "c", ["a", "b"], ["id"]).collect()}
    d, c = _dist(pdf[["id", "a", "b"]]) ** 2, pdf["c"].to_numpy()
    s = []
    for i in range(300):
        own = (c == c[i]) & (np.arange(300) != i)
        if not own.any():
            s.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, c == k].mean() for k in set(c) - {c[i]})
        s.append((b - a) / max(a, b))
    assert got["silhouette_squared"] == pytest.approx(np.mean(s))
    assert math.isfinite(got["davies_bouldin"]) and got["calinski_harabasz"] > 0


def test_keys_of_text(spark):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame(rng.normal(size=(120, 2)), columns=["a", "b"]).assign(id=np.arange(120))
    df = spark.createDataFrame(pdf)
    named = df.selectExpr("a", "b", "format_string('k%03d', id) AS id")
    for run in (
        lambda t: cluster.dbscan(t, "id", ["a", "b"], 0.6, 4),
        lambda t: neighbours.local_outlier_factor(t, "id", ["a", "b"], 5),
    ):
        want = {f"k{r[0]:03d}": r[1] for r in run(df).collect()}
        got = {r[0]: r[1] for r in run(named).collect()}
        assert got == pytest.approx(want)
    scored = anomaly.isolation_forest(named, "id", ["a", "b"], trees=10)
    assert scored.count() == 120 and scored.filter("is_anomaly").count() == 12


def test_split_over_very_many_classes(spark):
    classes = 120_000
    df = spark.range(3 * classes).select("id", F.concat(F.lit("c"), F.col("id") % classes).alias("label"))
    train, test = sample.train_test_split(df, ["id"], "label", fraction=0.4)
    per = test.groupBy("label").count().groupBy("count").agg(F.count("*").alias("n")).collect()
    size = round(3 * classes * 0.4)
    # 1.2 rows of each class: the first of equal remainders, by name, give a second
    assert {r["count"]: r["n"] for r in per} == {1: 2 * classes - size, 2: size - classes}
    second = {r["label"] for r in test.groupBy("label").count().filter("count = 2").collect()}
    assert second == set(sorted(f"c{i}" for i in range(classes))[: size - classes])
    assert train.count() == 3 * classes - size
    weights = features.class_weights(df, "label")
    assert weights.count() == classes and weights.first()["weight"] == 1.0


def test_areas_of_many_pairs_in_one_table(spark, hot):
    df, pdf = hot
    pairs = {f"p{k}": (F.floor(F.col("x") * k), F.col("id") % (k + 1) == 0) for k in range(1, 6)}
    pairs["one class"] = (F.col("x"), F.lit(True))
    got = metrics.rank_aucs(df, pairs)
    for k in range(1, 6):
        score, yes = np.floor(pdf["x"] * k).to_numpy(), (pdf["id"] % (k + 1) == 0).to_numpy()
        wins = (score[yes][:, None] > score[~yes]).sum() + 0.5 * (score[yes][:, None] == score[~yes]).sum()
        assert got[f"p{k}"] == pytest.approx(wins / (yes.sum() * (~yes).sum()))
    assert got["one class"] is None and metrics.rank_auc(df, F.col("x"), F.lit(False)) is None


def test_itemsets_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [tuple(None if rng.random() < 0.1 else str(v) for v in rng.integers(0, k, 5)) for k in (1, 2, 3, 3, 5) for _ in range(60)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    for support in (0.02, 0.1, 0.4):
        counts: Counter = Counter()
        for row in rows:
            items = sorted(f"{c}={v}" for c, v in zip("abcde", row) if v is not None)
            counts.update(s for n in range(1, 6) for s in itertools.combinations(items, n))
        # an item of every row says nothing and is left out
        want = {s: n for s, n in counts.items() if n >= support * len(rows)}
        got = {tuple(r["items"]): r["count"] for r in rules.frequent_itemsets(df, min_support=support).collect()}
        assert got == want
    assert rules.frequent_itemsets(df.limit(0)).collect() == []
