"""Steps whose cost must follow the input: copies, blocks of many columns, rows of a task."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablekit.functions import storage
from tablekit.operators import boosting, features, lloyd, neighbours, whatif, wide_neighbours
from tablekit.plans import clustering, training
from tablekit.sources import tables


def test_limits_can_warn_and_give_the_whole_table(spark):
    with pytest.warns(UserWarning, match="10 rows"):
        assert tables.check_limits(spark.range(10), max_rows=9, refuse=False).count() == 10
    with pytest.warns(UserWarning, match="1 columns"):
        assert tables.check_limits(spark.range(10), 10, 0, refuse=False).count() == 10
    with pytest.raises(ValueError):
        tables.check_limits(spark.range(10), 10, 0)


def test_neighbours_are_searched_once_for_a_place(spark, monkeypatch):
    sizes = []
    real = neighbours.checkpoint

    def counted(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "checkpoint", counted)
    x = F.array((F.col("id") % 5).cast("double"), F.lit(0.0))
    points = spark.range(3000).select(F.col("id").alias("pkey"), x.alias("x"))
    asked = spark.range(2000).select(F.col("id").alias("qkey"), x.alias("x"))
    got = neighbours.knn_join(asked, points, 4).collect()
    assert max(sizes) <= 5 * 4
    assert sorted((r["qkey"], r["pkey"], r["dist"], r["rank"]) for r in got) == [(q, q % 5 + 5 * i, 0.0, i + 1) for q in range(2000) for i in range(4)]


def test_keys_of_several_queries_share_their_neighbours(spark):
    asked = spark.createDataFrame([(1, [0.0]), (1, [0.0]), (1, [9.0])], "qkey long, x array<double>")
    points = spark.createDataFrame([(i, [float(i)]) for i in range(10)], "pkey long, x array<double>")
    got = neighbours.knn_join(asked, points, 4).collect()
    assert sorted((r["pkey"], r["dist"]) for r in got) == [(0, 0.0), (0, 0.0), (1, 1.0), (9, 0.0)]


@pytest.mark.parametrize("dims", [1, 3, 64])
def test_screened_neighbours_equal_all_differences(dims):
    rng = np.random.default_rng(dims)
    px, qx = (np.concatenate([rng.normal(size=(300, dims)), rng.integers(0, 3, (300, dims)) * 1.0]) + 1e4 for _ in range(2))
    qx[:50] = px[:50] + 1e-9  # nearer than single precision tells
    frame = lambda x, key: pd.DataFrame({key: np.arange(len(x)), "x": list(x)})
    got = neighbours._nearest_in_block(frame(qx, "qkey"), frame(px, "pkey"), 5)
    d = neighbours._distances(qx, px)
    pick = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert got["pkey"].to_numpy().reshape(-1, 5).tolist() == pick.tolist()
    assert got["dist"].to_numpy().reshape(-1, 5).tolist() == np.take_along_axis(d, pick, axis=1).tolist()


def test_visits_leave_in_pieces(monkeypatch):
    monkeypatch.setattr(neighbours, "HELD", 640)
    rows = pd.DataFrame({"qkey": np.arange(30), "x": list(np.zeros((30, 64)))})
    at, cell = np.nonzero(np.ones((30, 7), bool))
    pieces = list(neighbours._pieces(rows, at, cell))
    assert max(map(len, pieces)) == 10
    whole = pd.concat(pieces)
    assert list(whole["qkey"]) == list(at) and list(whole["cell"]) == list(cell)


def test_training_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(storage, "ROWS_PER_TASK", 50)
    df = spark.range(0, 500, 1, 1).selectExpr("id", "double(id % 7) AS a", "IF(id % 2 = 0, 'e', 'o') AS c")
    run = training.train_models(df, "c", ["id"], trees=2, rounds=1)
    kept = run.models[training.KNN].neighbours
    assert kept.rdd.getNumPartitions() == 8 and kept.count() == 400


def test_cluster_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(storage, "ROWS_PER_TASK", 50)
    seen = []
    real = lloyd._pass
    monkeypatch.setattr(lloyd, "_pass", lambda p, f, m: seen.append(p.rdd.getNumPartitions()) or real(p, f, m))
    df = spark.range(0, 500, 1, 1).selectExpr("id", "double(id % 7) AS a", "double(id % 2 * 100) AS b")
    assert clustering._start(df, "id", None)[0].rdd.getNumPartitions() == 10
    fit = lloyd.fit_all(df, ["a", "b"], [2])[2]
    assert set(seen) == {10} and sorted(fit.centres[:, 1]) == [0.0, 100.0]


def test_binned_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(storage, "ROWS_PER_TASK", 50)
    seen = []
    real = boosting.HistogramBoosting._grow
    grow = lambda self, table, *rest: seen.append(table.rdd.getNumPartitions()) or real(self, table, *rest)
    monkeypatch.setattr(boosting.HistogramBoosting, "_grow", grow)
    from pyspark.ml.functions import array_to_vector

    rows = spark.range(0, 500, 1, 1).selectExpr("array(double(id % 9)) AS x", "double(id % 9 > 4) AS y", "1D AS w")
    model = boosting.HistogramBoosting(2, "x", "y", "w", "guess", "odds", rounds=3, bin_rows=100).fit(rows.withColumn("x", array_to_vector("x")))
    assert set(seen) == {10}
    assert model.transform(rows.withColumn("x", array_to_vector("x"))).filter("guess = y").count() == 500


def test_packed_rows_come_back():
    for a in (np.arange(24.0).reshape(6, 4), np.arange(12, dtype=np.uint8).reshape(6, 2)):
        column = boosting._packed(a)
        assert (boosting._bytes(column, a.shape[1], a.dtype) == a).all()
        assert (boosting._bytes(column.slice(2, 3), a.shape[1], a.dtype) == a[2:5]).all()


def test_copies_by_halves_of_the_draw():
    rng = np.random.default_rng(6)
    a = np.concatenate([rng.integers(0, 2**32, 3000), [c + i for c in whatif.POISSON_CUTS for i in (-1, 0, 1)]])
    rows = pd.DataFrame({"a": a, "b": rng.integers(0, 2**32, len(a)) | 1})
    ts = np.arange(120, dtype=np.int64)
    want = np.searchsorted(np.array(whatif.POISSON_CUTS), whatif._draws(rows["a"].to_numpy(), rows["b"].to_numpy(), ts), side="right")
    assert (whatif._copies(rows, ts) == want).all()


def test_medians_of_both_columns_take_one_pass(spark, monkeypatch):
    passes = []
    real = whatif.checkpoint
    monkeypatch.setattr(whatif, "checkpoint", lambda df: passes.append(1) or real(df))
    df = spark.range(3000).selectExpr("id", "double(id % 50) AS x", "double(id % 977) AS y")
    assert whatif.bootstrap(df, "x", "y", ["id"], aggregate="median", trials=100).count() == 100
    assert len(passes) == 1


def test_wide_points_are_searched_in_blocks(spark, monkeypatch):
    """Also places that hold many points, ties, and more leaves than blocks."""
    monkeypatch.setattr(wide_neighbours, "TILE", 16)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 40)), rng.integers(0, 2, (300, 40)) * (np.arange(40) < 3)])
    x[:100, 5:9] += 50
    frame = lambda name: spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], f"{name} long, x array<double>")
    seen = []
    real = wide_neighbours._in_blocks
    monkeypatch.setattr(wide_neighbours, "_in_blocks", lambda *a: seen.append(len(a[2])) or real(*a))
    got = neighbours.knn_join(frame("qkey"), frame("pkey"), 4, points_block=60, queries_block=50).orderBy("qkey", "rank").toPandas()
    d = neighbours._distances(x, x)
    pick = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert len(seen) == 3 and seen[0] > 10
    assert got["pkey"].to_numpy().reshape(-1, 4).tolist() == pick.tolist()
    assert got["dist"].to_numpy().reshape(-1, 4).tolist() == np.take_along_axis(d, pick, axis=1).tolist()


@pytest.mark.parametrize("odd", [None, np.nan, np.inf, 1e200])
def test_tiles_leave_out_no_neighbour(odd):
    rng = np.random.default_rng(4)
    px, qx = (np.concatenate([rng.normal(size=(700, 24)), rng.integers(0, 3, (700, 24)) * 1.0]) + 1e4 for _ in range(2))
    qx[:50] = px[:50] + 1e-9  # nearer than single precision tells
    if odd is not None:
        px[5, 3] = odd
    keys = rng.permutation(len(px))
    by = np.argsort(wide_neighbours.fit_order(px, 40).of(px), kind="stable")
    with np.errstate(all="ignore"):
        d = neighbours._distances(qx, px[by])
    near = np.array([np.lexsort((keys[by], row))[:5] for row in d])
    dist = np.take_along_axis(d, near, axis=1)
    for bound in (np.full(len(qx), np.inf), dist[:, -1]):
        got = [np.concatenate(part) for part in zip(*wide_neighbours.nearest(qx, bound, px[by], keys[by], 5))]
        assert got[0].tolist() == np.repeat(np.arange(len(qx)), 5).tolist()
        assert got[1].reshape(-1, 5).tolist() == near.tolist() and got[2].reshape(-1, 5).tolist() == dist.tolist()


def test_tiles_far_from_a_query_are_not_measured(monkeypatch):
    """Points of 32 kinds: a query is multiplied with its own kind."""
    rng = np.random.default_rng(5)
    kind = np.repeat(np.arange(32), 256)
    x = np.concatenate([np.eye(32)[kind] * 9, rng.normal(size=(len(kind), 40)) / 40], axis=1)
    pairs = []
    real = np.nonzero
    monkeypatch.setattr(wide_neighbours.np, "nonzero", lambda hit: (pairs.append(hit.size), real(hit))[1])
    found = list(wide_neighbours.nearest(x[::37], np.full(len(x[::37]), 5.0), x, np.arange(len(x)), 3))
    assert sum(pairs) < 0.1 * len(x) * len(x[::37])
    assert (kind[::37].repeat(3) == kind[np.concatenate([f[1] for f in found])]).all()


def test_terms_and_their_rows_are_counted_in_one_pass(spark, monkeypatch):
    passes = []
    real = features._term_counts
    monkeypatch.setattr(features, "_term_counts", lambda *a: passes.append(1) or real(*a))
    df = spark.createDataFrame([(1, "ant ant bee"), (2, "Bee cow, cow. cow"), (3, None), (4, "ant"), (5, "")], "id long, t string")
    model, got = features.tfidf(df, "t", 2)
    counter, weigh = model.stages[3], model.stages[5]
    assert len(passes) == 1 and counter.vocabulary == ["ant", "cow"]
    assert np.allclose(weigh.getScalingVec().toArray(), np.log([6 / 3, 6 / 2]) + 1)
    first = {r["id"]: r["tfidf"].toArray().tolist() for r in got.collect()}
    assert first[1] == [1.0, 0.0] and first[2] == [0.0, 1.0] and first[3] == [0.0, 0.0]
    empty = features.tfidf(df.filter("id = 5"), "t", 2)[0]
    assert empty.stages[3].vocabulary == [""]


def test_costly_rows_use_idle_cores(spark):
    df = spark.range(0, 4000, 1, 1)
    cores = spark.sparkContext.defaultParallelism
    assert storage.spread(df, 4000).rdd.getNumPartitions() == 1
    assert storage.spread(df, 4000, 10).rdd.getNumPartitions() == cores
    assert storage.spread(df, 4000, 4001).rdd.getNumPartitions() == 1


def test_predictions_are_made_once_for_all_scores(spark):
    from pyspark.ml.functions import array_to_vector

    made = spark.sparkContext.accumulator(0)

    def guess(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    p = F.col("id") / 100
    rows = spark.range(100).mapInArrow(guess, "id long")
    rows = rows.select(
        (F.col("id") % 3 > 0).cast("double").alias(training.LABEL), F.round(p).alias(training.PREDICTION), array_to_vector(F.array(1 - p, p)).alias(training.PROBABILITY)
    )
    found = training._measured(rows, "classification", ["0", "1"])
    assert "roc_auc" in found and made.value == 100


def test_forest_of_many_rows_adds_up_fewer_nodes_at_once(spark, monkeypatch):
    df = spark.range(0, 60, 1, 1).selectExpr("id", "double(id % 7) AS a", "IF(id % 2 = 0, 'e', 'o') AS c")
    sizes = []
    for most in (60, 59):
        monkeypatch.setattr(training, "ROWS_PER_TASK", most)
        run = training.train_models(df, "c", ["id"], trees=2, rounds=1, neighbours=False)
        forest = run.models["Random Forest"].pipeline.stages[-1]
        sizes.append(forest.getMaxMemoryInMB())
        assert forest.getNumTrees == 2 and forest.getMaxDepth() == 10
    assert sizes == [256, 32]
