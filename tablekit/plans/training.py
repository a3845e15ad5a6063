"""Training a panel of models, ranking them, scoring and keeping them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekit.functions.columns import col, require_columns, small_table
from tablekit.functions.storage import ROWS_PER_TASK, checkpoint, spread
from tablekit.operators.boosting import HistogramBoosting
from tablekit.operators.features import (
    class_weights,
    feature_pipeline,
    infer_problem_type,
)
from tablekit.operators.metrics import classification_metrics, regression_metrics
from tablekit.operators.neighbours import knn_join, knn_vote
from tablekit.operators.sample import stratified_sample, train_test_split

KNN = "K-Nearest Neighbors"
HISTOGRAM = "Histogram Gradient Boosting"
#: rows worth a task of their own: a forest alone takes a row through hundreds of trees for every level
COSTLY_ROWS = 1 << 12
#: MB of statistics that a task of a forest adds up at once: Spark's default, and fewer for many rows, whose updates then
#: miss the CPU's caches less often. The number of trees and nodes is the same; nodes draw their columns in another order.
NODES_MB, NODES_MB_LARGE = 256, 32


@dataclass
class TrainedModel:
    """A fitted pipeline from raw columns to prediction, with what scoring needs."""

    name: str
    pipeline: PipelineModel
    target: str
    problem: str
    columns: list[tuple[str, str]]  # feature name and type
    classes: list[str] = field(default_factory=list)
    neighbours: DataFrame | None = None  # prepared training rows, where these are the model


@dataclass
class TrainingRun:
    problem: str
    leaderboard: DataFrame
    models: dict[str, TrainedModel]
    best: str | None


#: names of this module's own columns; a table's columns may be called label or weight
LABEL, WEIGHT, FEATURES, PREDICTION, PROBABILITY = (f"_tk_{x}" for x in ("label", "weight", "features", "prediction", "probability"))


def classification_panel(classes: int, trees: int = 300, fast: bool = False, rounds: int = 50, nodes_mb: int = NODES_MB) -> dict:
    """Estimators by name; ``fast`` leaves out the forest and boosting over histograms, which need the most passes."""
    common = {"featuresCol": FEATURES, "labelCol": LABEL, "weightCol": WEIGHT, "predictionCol": PREDICTION}
    odds = {"probabilityCol": PROBABILITY, "rawPredictionCol": "_tk_raw"}
    gbt = GBTClassifier(maxIter=rounds, maxDepth=3, seed=42, featuresCol=FEATURES, labelCol=LABEL, predictionCol=PREDICTION)
    gbt = gbt.setProbabilityCol(PROBABILITY).setRawPredictionCol("_tk_raw")
    # boosted trees are binary here: one model per class otherwise
    boosted = gbt.setWeightCol(WEIGHT) if classes == 2 else OneVsRest(classifier=gbt, rawPredictionCol="_tk_raw", **common)
    panel = {"Logistic Regression": LogisticRegression(maxIter=100, **common, **odds)}
    if not fast:
        panel["Random Forest"] = RandomForestClassifier(numTrees=trees, maxDepth=10, seed=42, maxMemoryInMB=nodes_mb, **common, **odds)
    panel["Gradient Boosting"] = boosted
    if not fast:
        panel[HISTOGRAM] = HistogramBoosting(classes, FEATURES, LABEL, WEIGHT, PREDICTION, PROBABILITY, rounds)
    return panel


def regression_panel(trees: int = 300, fast: bool = False, rounds: int = 50, nodes_mb: int = NODES_MB) -> dict:
    common = {"featuresCol": FEATURES, "labelCol": LABEL, "predictionCol": PREDICTION}
    panel = {"Ridge Regression": LinearRegression(regParam=0.01, elasticNetParam=0.0, maxIter=100, **common)}
    if not fast:
        panel["Random Forest"] = RandomForestRegressor(numTrees=trees, maxDepth=10, seed=42, maxMemoryInMB=nodes_mb, **common)
    panel["Gradient Boosting"] = GBTRegressor(maxIter=rounds, maxDepth=3, seed=42, **common)
    if not fast:
        panel[HISTOGRAM] = HistogramBoosting(0, FEATURES, LABEL, WEIGHT, PREDICTION, PROBABILITY, rounds)
    return panel


def _scores(pred: DataFrame, classes: list[str], column: str = PROBABILITY) -> dict:
    if column not in pred.columns:
        return {}
    xs = vector_to_array(column)
    if len(classes) == 2:
        return {"1": F.get(xs, F.lit(1))}
    return {str(i): F.get(xs, F.lit(i)) for i in range(len(classes))}


def _measured(pred: DataFrame, problem: str, classes: list[str]) -> dict[str, float]:
    # several aggregates read the predictions, which cost a pass of the model over the rows
    pred = checkpoint(pred.select(*[c for c in (LABEL, PREDICTION, PROBABILITY) if c in pred.columns]))
    if problem == "regression":
        rows = regression_metrics(pred, LABEL, PREDICTION)
    else:
        pred = pred.withColumns({LABEL: col(LABEL).cast("long"), PREDICTION: col(PREDICTION).cast("long")})
        rows = classification_metrics(pred, LABEL, PREDICTION, _scores(pred, classes))
    return {r["metric"]: r["value"] for r in rows.collect()}


def primary_score(metrics: dict[str, float], problem: str, ratio: float) -> float:
    """R2; weighted F1; for unbalanced classes ROC-AUC, or macro F1 where there is none."""
    if problem == "regression":
        return metrics.get("r2", float("-inf"))
    if ratio > 3:
        return metrics.get("roc_auc", metrics.get("f1_macro", 0.0))
    return metrics.get("f1_weighted", 0.0)


def leaderboard(spark: SparkSession, runs: Sequence[tuple[str, dict | None, float | None, str | None]]) -> DataFrame:
    """``(model, metrics, primary score, error)`` ranked by score, failures last."""
    good = sorted([r for r in runs if r[3] is None], key=lambda r: (-r[2], r[0]))
    rows = []
    for i, (name, metrics, score, error) in enumerate(good + [r for r in runs if r[3] is not None]):
        text = json.dumps({k: round(v, 4) for k, v in (metrics or {}).items()}, sort_keys=True)
        rows.append((i + 1, name, score, text, error))
    return small_table(spark, rows, "rank long, model string, primary_score double, metrics string, error string")


def train_models(
    df: DataFrame,
    target: str,
    key: Sequence[str],
    use_pca: bool = False,
    fast: bool = False,
    trees: int = 300,
    rounds: int = 50,
    neighbours: bool = True,
    test_fraction: float = 0.2,
    text_terms: int = 300,
    min_frequency: int | None = None,
    train_rows: int | None = None,
    seed: int = 42,
) -> TrainingRun:
    """Fit the panel on a stratified split and rank it on the test rows.

    The same panel at any size: what large tables may want cheaper is a parameter (``fast`` panel,
    ``neighbours``, ``rounds``, ``min_frequency`` below which categories fold, and for a classifier
    ``train_rows``, a bound on the labelled rows it learns from; test rows are never cut). ``key``
    (unique) makes the split repeatable and stays out of the features.
    """
    require_columns(df, target, *key)
    rows = df.filter(col(target).isNotNull())
    features = [c for c in df.columns if c != target and c not in key]
    if not features:
        raise ValueError("at least one feature column is needed")
    n = rows.count()
    if n < 5:
        raise ValueError("at least five rows with a target are needed")
    problem = infer_problem_type(rows, target)
    classes: list[str] = []
    ratio = 1.0
    spark = df.sparkSession
    train, test = train_test_split(rows, key, target if problem == "classification" else None, test_fraction, seed)
    if train_rows is not None:
        if problem == "regression":
            raise ValueError("train_rows bounds the rows of a classifier only")
        train = stratified_sample(train, target, key, train_rows, seed)
    if problem == "classification":
        weights = class_weights(rows, target)
        found = weights.collect()  # a row per class
        classes = [r["class"] for r in found]
        if len(classes) < 2:
            raise ValueError(f"{target} has only one class")
        ratio = found[0]["ratio"]
        # one row per class
        index = small_table(
            spark,
            [(r["class"], float(i), r["weight"] if ratio > 3 else 1.0) for i, r in enumerate(found)],
            f"_tk_name string, {LABEL} double, {WEIGHT} double",
        )

        def marked(part: DataFrame) -> DataFrame:
            return part.join(F.broadcast(index), col(target).cast("string") == F.col("_tk_name")).drop("_tk_name")
    else:

        def marked(part: DataFrame) -> DataFrame:
            return part.withColumns({LABEL: col(target).cast("double"), WEIGHT: F.lit(1.0)})

    # fitting reads the rows many times: the split is made once, in tasks of bounded size
    asked = int(n * test_fraction)
    train = checkpoint(spread(marked(train), min(n - asked, train_rows or n), COSTLY_ROWS))
    test = checkpoint(spread(marked(test), asked, COSTLY_ROWS))
    # fitted on the training rows only, then read by every model
    inputs = [*features, target]
    prep = feature_pipeline(
        train.select(*[col(c) for c in inputs]), target, use_pca, text_terms, out=FEATURES, min_frequency=min_frequency
    )
    cols_kept = [*[col(k).alias(f"_tk_key{i}") for i, k in enumerate(key)], FEATURES, LABEL, WEIGHT]
    train_set = checkpoint(prep.transform(train).select(*cols_kept))
    test_set = checkpoint(prep.transform(test).select(*cols_kept))
    nodes_mb = NODES_MB if n <= ROWS_PER_TASK else NODES_MB_LARGE
    if problem == "classification":
        panel = classification_panel(len(classes), trees, fast, rounds, nodes_mb)
    else:
        panel = regression_panel(trees, fast, rounds, nodes_mb)
    if neighbours:
        panel[KNN] = None
    runs, models = [], {}
    kinds = [(c, df.schema[c].dataType.simpleString()) for c in features]
    for name, estimator in panel.items():
        try:
            if estimator is None:
                trained = TrainedModel(name, prep, target, problem, kinds, classes, train_set.select(FEATURES, LABEL))
                scored = _knn(trained, test_set)
            else:
                model = estimator.fit(train_set)
                trained = TrainedModel(name, PipelineModel(stages=[*prep.stages, model]), target, problem, kinds, classes)
                scored = model.transform(test_set)
            metrics = _measured(scored, problem, classes)
            runs.append((name, metrics, primary_score(metrics, problem, ratio), None))
            models[name] = trained
        except Exception as error:  # one failing model must not end the run
            runs.append((name, None, None, str(error).splitlines()[0]))
    board = leaderboard(spark, runs)
    best = next((r["model"] for r in board.collect() if r["error"] is None), None)  # a row per model
    return TrainingRun(problem, board, models, best)


def _knn(model: TrainedModel, rows: DataFrame, k: int = 5) -> DataFrame:
    """``rows`` (with the prepared features) and PREDICTION from the k nearest of the kept rows. Rows
    are numbered for the search, so keys of any type, and of many columns, do."""
    asked = checkpoint(rows.withColumn("_tk_row", F.monotonically_increasing_id()))
    known = checkpoint(model.neighbours.withColumn("pkey", F.monotonically_increasing_id()))
    near = knn_join(
        asked.select(F.col("_tk_row").alias("qkey"), vector_to_array(FEATURES).alias("x")),
        known.select("pkey", vector_to_array(FEATURES).alias("x")),
        k,
    )
    votes = knn_vote(near, known.select("pkey", F.col(LABEL).alias("y")), model.problem == "classification")
    votes = votes.select(F.col("qkey").alias("_tk_q"), F.col("prediction").cast("double").alias(PREDICTION))
    return asked.join(votes, F.col("_tk_row") == F.col("_tk_q")).drop("_tk_row", "_tk_q")


def train_large(df: DataFrame, target: str, key: Sequence[str], **options) -> TrainingRun:
    """The fast panel without neighbours, with few rounds and rare categories folded."""
    given = {"fast": True, "neighbours": False, "rounds": 20, "test_fraction": 0.1, "text_terms": 120, "min_frequency": 10}
    return train_models(df, target, key, **(given | options))


def feature_names(model: TrainedModel, df: DataFrame) -> list[str]:
    """Names of the assembled features, from the vector metadata."""
    attrs = predict_raw(model, df.limit(1)).schema[FEATURES].metadata.get("ml_attr", {}).get("attrs", {})
    flat = [a for group in attrs.values() for a in group]
    return [a.get("name", str(a["idx"])) for a in sorted(flat, key=lambda a: a["idx"])]


def feature_importance(model: TrainedModel, df: DataFrame, top: int = 15) -> DataFrame:
    """Largest tree importances or absolute coefficients."""
    last = model.pipeline.stages[-1]
    if hasattr(last, "featureImportances"):
        weights = last.featureImportances.toArray()
    elif hasattr(last, "coefficientMatrix"):
        weights = last.coefficientMatrix.toArray()[0]
    elif hasattr(last, "coefficients"):
        weights = last.coefficients.toArray()
    else:
        weights = []
    names = feature_names(model, df)
    pairs = [(names[i] if i < len(names) else str(i), abs(float(w))) for i, w in enumerate(weights)]
    pairs.sort(key=lambda p: (-p[1], p[0]))
    return small_table(df.sparkSession, pairs[:top], "feature string, importance double")


def predict_raw(model: TrainedModel, df: DataFrame) -> DataFrame:
    """All pipeline columns; feature columns the table lacks count as missing."""
    gaps = {c: F.lit(None).cast(kind) for c, kind in model.columns if c not in df.columns}
    out = model.pipeline.transform(df.withColumns(gaps) if gaps else df)
    return out if model.neighbours is None else _knn(model, out)


def predict(model: TrainedModel, df: DataFrame, name: str = "prediction") -> DataFrame:
    """Adds the column ``name`` (the class name for a classification): any number of rows. It takes the place
    of a column of that name, so a table with a ``prediction`` of its own keeps it under another name only."""
    out = predict_raw(model, df)
    value = F.col(PREDICTION)
    if model.problem == "classification":
        names = F.array(*[F.lit(c) for c in model.classes])
        value = F.get(names, F.col(PREDICTION).cast("int"))
    return out.select(*[col(c) for c in df.columns if c != name], value.alias(name))


def save_model(model: TrainedModel, path: str) -> None:
    """Pipeline, description and, for neighbours, their rows under one folder of any Hadoop file system."""
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    if model.neighbours is not None:
        model.neighbours.write.mode("overwrite").parquet(f"{path}/neighbours")
    about = {
        "name": model.name,
        "target": model.target,
        "problem": model.problem,
        "columns": model.columns,
        "classes": model.classes,
        "neighbours": model.neighbours is not None,
    }
    spark = SparkSession.active()
    small_table(spark, [(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(path: str) -> TrainedModel:
    spark = SparkSession.active()
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return TrainedModel(
        about["name"],
        PipelineModel.load(f"{path}/pipeline"),
        about["target"],
        about["problem"],
        [tuple(c) for c in about["columns"]],
        about["classes"],
        spark.read.parquet(f"{path}/neighbours") if about["neighbours"] else None,
    )

