import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablekit.operators import features
from tablekit.plans import training


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = rng.normal(size=(n, 2))
    y = np.where(x[:, 0] + 0.2 * rng.normal(size=n) > 0.9, "yes", "no")
    pdf = pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "kind": rng.choice(list("pq"), n), "y": y})
    pdf.loc[::15, "kind"] = None
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def run(table):
    return training.train_models(table, "y", ["id"], trees=10, rounds=5)


def test_imbalanced_classification(run, table):
    board = run.leaderboard.orderBy("rank").collect()
    assert run.problem == "classification" and all(r["error"] is None for r in board) and len(board) == 5
    scores = [r["primary_score"] for r in board]
    assert scores == sorted(scores, reverse=True) and 0.8 < scores[0] <= 1
    assert features.class_weights(table, "y").first()["imbalanced"]


def test_predict_keeps_rows_and_names_classes(run, table):
    name = run.best if run.best in run.models else "Logistic Regression"  # neighbours keep no model
    got = training.predict(run.models[name], table.drop("kind", "y"))
    assert got.columns == ["id", "a", "b", "prediction"] and got.count() == 400
    assert {r["prediction"] for r in got.select("prediction").distinct().collect()} == {"yes", "no"}


def test_a_column_named_prediction_stays(run, table):
    df, model = table.withColumn("prediction", F.lit("own")), run.models[run.best]
    got = training.predict(model, df, name="guess")
    assert got.columns == [*df.columns, "guess"] and {r["prediction"] for r in got.collect()} == {"own"}


def test_save_and_load(run, table, tmp_path):
    model = run.models["Logistic Regression"]
    training.save_model(model, str(tmp_path / "m"))
    again = training.load_model(str(tmp_path / "m"))
    assert again.classes == model.classes and again.columns == model.columns
    a = training.predict(model, table).orderBy("id").collect()
    assert a == training.predict(again, table).orderBy("id").collect()
    top = training.feature_importance(model, table).first()
    assert "a" in top["feature"]


def test_refusals(table):
    with pytest.raises(ValueError):
        training.train_models(table.select("id", "y"), "y", ["id"])
    with pytest.raises(ValueError):
        training.train_models(table.limit(3), "y", ["id"])


def test_leaderboard_puts_failures_last(spark):
    rows = [("a", {"r2": 0.1}, 0.1, None), ("b", None, None, "broke"), ("c", {"r2": 0.4}, 0.4, None)]
    got = training.leaderboard(spark, rows).orderBy("rank").collect()
    assert [r["model"] for r in got] == ["c", "a", "b"]


def test_pca_in_the_pipeline(table):
    wide = table.selectExpr("a", "a * 2 + b * 0.001 AS a2", "b", "kind", "y")
    model = features.feature_pipeline(wide, "y", use_pca=True)
    assert model.transform(wide).first()["features"].size == 2 + 3


def test_columns_with_the_names_of_this_module(spark):
    rows = [(i, float(i % 2), "a" if i % 3 else "b", i % 2, float(i), "yes" if i % 2 else "no") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, weight double, prediction string, features long, probability double, label string")
    run = training.train_models(df, "label", ["id"], trees=10, rounds=5)
    board = {r["model"]: (r["primary_score"], r["error"]) for r in run.leaderboard.collect()}
    assert len(board) == 5 and all(score == 1.0 and error is None for score, error in board.values())
    got = training.predict(run.models[run.best], df)
    assert got.filter("prediction = label").count() == 200


def test_neighbours_win_predict_and_load(spark, tmp_path):
    """A checkerboard with keys of text: only neighbours see it."""
    rows = [(f"k{i}", f"{j}", float(i), float(j), "x" if (i // 3 + j // 3) % 2 else "y") for i in range(18) for j in range(18)]
    df = spark.createDataFrame(rows, "k1 string, k2 string, a double, b double, c string")
    run = training.train_models(df, "c", ["k1", "k2"], trees=5, rounds=2)
    model = run.models[training.KNN]
    got = training.predict(model, df)
    assert got.filter("prediction = c").count() > 290
    training.save_model(model, str(tmp_path / "m"))
    again = training.predict(training.load_model(str(tmp_path / "m")), df)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_rare_categories_are_folded_by_the_saved_pipeline(spark):
    rows = [(i, "common" if i % 2 else "usual", i % 2) for i in range(60)] + [(100, "rare", 0), (101, "scarce", 1)]
    df = spark.createDataFrame(rows, "id long, kind string, y int")
    model = features.feature_pipeline(df.drop("id"), "y", min_frequency=10)
    seen = model.transform(spark.createDataFrame([("rare",), ("never",), ("usual",)], "kind string"))
    rare, never, usual = [r["features"] for r in seen.collect()]
    assert rare == never != usual


def test_parameters_bound_the_learning_rows_of_classifiers_only(spark):
    df = spark.range(300).selectExpr("id", "double(id % 7) AS a", "double(id) AS y", "IF(id % 2 = 0, 'e', 'o') AS c")
    run = training.train_models(df.drop("y"), "c", ["id"], trees=5, rounds=2, train_rows=50, neighbours=False)
    assert run.leaderboard.count() == 4
    with pytest.raises(ValueError):
        training.train_models(df.drop("c"), "y", ["id"], train_rows=50)
