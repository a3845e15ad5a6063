"""Boosting over histograms against plain arithmetic."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablekit.operators import boosting

NAMES = ("x", "y", "w", "guess", "odds")


def _frame(spark, x, y, w=None):
    w = np.ones(len(y)) if w is None else w
    rows = [([float(v) for v in a], float(b), float(c)) for a, b, c in zip(x, y, w)]
    df = spark.createDataFrame(rows, "x array<double>, y double, w double").repartition(4)
    return df.withColumn("x", array_to_vector("x"))


def test_best_cut_by_trying_all():
    rng = np.random.default_rng(5)
    g, h = rng.normal(size=(2, 1, 7)), rng.uniform(0.1, 1, (2, 1, 7))
    g, h = np.repeat(g, 3, axis=1), np.repeat(h, 3, axis=1)
    g[:, 1:, :6] = g[:, 1:, 5::-1]  # the same rows in other bins
    h[:, 1:, :6] = h[:, 1:, 5::-1]
    gain, column, cut, gaps, lg, lh = boosting.best_cuts(g, h, 6, 1.0, 0.5)
    for n in range(2):
        best = -np.inf
        for c in range(3):
            for b in range(6):
                for missing_left in (True, False):
                    a, s = g[n, c, : b + 1].sum(), h[n, c, : b + 1].sum()
                    if missing_left:
                        a, s = a + g[n, c, 6], s + h[n, c, 6]
                    r, t = g[n, c].sum() - a, h[n, c].sum() - s
                    if min(s, t) >= 0.5:
                        whole = g[n, c].sum() ** 2 / (h[n, c].sum() + 1)
                        best = max(best, a * a / (s + 1) + r * r / (t + 1) - whole)
        assert gain[n] == pytest.approx(best)
        c, b = column[n], cut[n]
        assert lg[n] == pytest.approx(g[n, c, : b + 1].sum() + (g[n, c, 6] if gaps[n] else 0))
        assert lh[n] == pytest.approx(h[n, c, : b + 1].sum() + (h[n, c, 6] if gaps[n] else 0))


def test_one_round_of_a_stump(spark):
    x = np.array([[1.0], [2.0], [3.0], [4.0], [np.nan], [np.nan]])
    y = np.array([0.0, 0.0, 10.0, 10.0, 10.0, 10.0])
    model = boosting.HistogramBoosting(0, *NAMES, rounds=1, depth=1, rate=1.0).fit(_frame(spark, x, y))
    got = {str(r["x"][0]): r["guess"] for r in model.transform(_frame(spark, x, y)).collect()}
    mean = y.mean()
    low, high = mean + (0 - mean) * 2 / 3, mean + (10 - mean) * 4 / 5  # sums over rows + 1
    assert got["1.0"] == pytest.approx(low) and got["2.0"] == pytest.approx(low)
    assert all(got[v] == pytest.approx(high) for v in ("3.0", "4.0", "nan"))


def test_blocks_of_columns_and_refreshed_scores_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 5))
    df = _frame(spark, x, (x[:, 1] * x[:, 3] > 0) + 0.0)
    one = boosting.HistogramBoosting(2, *NAMES, rounds=4, depth=2).fit(df)
    monkeypatch.setattr(boosting, "CELLS", 300)
    monkeypatch.setattr(boosting, "REFRESH", 2)
    two = boosting.HistogramBoosting(2, *NAMES, rounds=4, depth=2).fit(df)
    a, b = (sorted([list(r["x"]), list(r["odds"])] for r in m.transform(df).collect()) for m in (one, two))
    assert np.allclose([r[1] for r in a], [r[1] for r in b])


def test_three_classes_better_than_one_against_the_rest(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = rng.uniform(-1, 1, (900, 3))
    y = np.digitize(x[:, 0] + 0.6 * x[:, 1], [-0.15, 0.15])  # the middle class lies between the others
    train, test = _frame(spark, x[:600], y[:600]), _frame(spark, x[600:], y[600:])
    model = boosting.HistogramBoosting(3, *NAMES, rounds=10).fit(train)
    binary = GBTClassifier(maxIter=10, maxDepth=3, seed=42, featuresCol="x", labelCol="y", predictionCol="guess")
    rest = OneVsRest(classifier=binary, featuresCol="x", labelCol="y", predictionCol="guess").fit(train)
    right = [m.transform(test).agg(F.avg((F.col("guess") == F.col("y")).cast("double"))).first()[0] for m in (model, rest)]
    assert right[0] > 0.85 and right[0] >= right[1], right
    PipelineModel(stages=[model]).write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    rows = [sorted((list(r["x"]), r["guess"], list(r["odds"])) for r in m.transform(test).collect()) for m in (model, again)]
    assert rows[0] == rows[1] and all(sum(r[2]) == pytest.approx(1) for r in rows[0])
    top = model.featureImportances.toArray()
    assert top.sum() == pytest.approx(1) and top[0] > top[1] > top[2]


def test_edges(spark):
    flat = _frame(spark, np.ones((5, 1)), np.array([1.0, 2, 3, 4, 5]))
    model = boosting.HistogramBoosting(0, *NAMES).fit(flat)
    assert {r["guess"] for r in model.transform(flat).collect()} == {3.0}
    assert model.transform(flat.limit(0)).count() == 0
    with pytest.raises(ValueError):
        boosting.HistogramBoosting(0, *NAMES).fit(flat.limit(0))
    with pytest.raises(ValueError):
        boosting.HistogramBoosting(1, *NAMES)
