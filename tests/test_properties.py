"""Results that SQL cannot state, by their properties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablekit.functions.text import edit_text
from tablekit.operators import cluster, features, reduce
from tablekit.plans import clustering


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.25, size=(60, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    pdf = pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(180), kind=np.repeat(["p", "q", None], 60))
    return spark.createDataFrame(pdf)


def test_kmeans_and_hierarchy(blobs):
    inertia = []
    for k in (2, 3, 4):
        got, centres, cost = cluster.kmeans(blobs, k, ["a", "b"], "id")
        sizes = [r["rows"] for r in cluster.cluster_sizes(got).collect()]
        assert sum(sizes) == 180 and len(sizes) == k and centres.count() == 2 * k
        inertia.append(cost)
        if k == 3:
            assert sizes == [60, 60, 60]
    assert inertia[0] > inertia[1] > inertia[2]
    got, _ = cluster.hierarchical(blobs, 3, ["a", "b"], "id")
    assert [r["rows"] for r in cluster.cluster_sizes(got).collect()] == [60, 60, 60]
    assert cluster.clamp_k(1, 180) == 2 and cluster.clamp_k(500, 180) == 179


def test_choice_of_clusters(blobs):
    got = clustering.suggest_k(blobs.select("id", "a", "b"), "id", max_k=4).collect()
    assert [r["k"] for r in got if r["recommended"]] == [3]
    assert sum(r["votes"] for r in got) == 4
    labels, table = clustering.cluster_best(blobs.select("id", "a", "b"), "id", max_k=3, radii=(0.5,))
    assert labels.count() == 180
    best = table.orderBy("rank").first()
    assert best["clusters"] == 3 and best["silhouette"] > 0.8


def test_components(blobs):
    got = reduce.pca_variance(blobs, ["a", "b"]).collect()
    assert sum(r["explained_pct"] for r in got) == pytest.approx(100)
    rows = reduce.pca_project(blobs, ["id"], ["a", "b"], color="kind")
    stats = rows.agg(F.avg("pc1"), F.var_pop("pc1"), F.var_pop("pc2"), F.corr("pc1", "pc2")).first()
    assert stats[0] == pytest.approx(0, abs=1e-9) and stats[3] == pytest.approx(0, abs=1e-9)
    assert stats[1] * 50 == pytest.approx(got[0]["explained_pct"])
    assert {r["label"] for r in rows.select("label").distinct().collect()} == {"p", "q", "(missing)"}
    load = reduce.pca_loadings(blobs, ["a", "b"]).filter("component = 1").collect()
    assert sum(r["loading"] ** 2 for r in load) == pytest.approx(1) and max(load, key=lambda r: abs(r["loading"]))["loading"] > 0
    assert not reduce.pca_analyse(blobs.limit(5), ["a", "b"]).first()["feasible"]
    assert not reduce.pca_analyse(blobs.withColumn("c", F.lit(1.0)), ["a", "c"]).first()["feasible"]


def test_scaling_of_a_flat_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert sorted((r["a"], r["b"]) for r in features.standardise(df).collect()) == [(-1.0, 0.0), (1.0, 0.0)]
    with pytest.raises(ValueError):
        features.prepared(df, ["a"])


def test_text_steps(spark):
    raw = "Mail me: a.b+c@x-y.org. or www.z.com/a?b  now—42 times, room4 don't STOP the  été "
    df = spark.createDataFrame([(raw,)], "t string")

    def run(*steps):
        return edit_text(df, ["t"], *steps).first()["t"]

    assert "@" not in run("emails") and "z.com" not in run("urls")
    assert "room4" in run("numbers") and "42" not in run("numbers")
    assert run("punctuation").endswith("times room4 don t STOP the été")
    assert run("stopwords").endswith("times, room4 STOP été")
    assert run("strip", "uppercase").endswith("ÉTÉ")
