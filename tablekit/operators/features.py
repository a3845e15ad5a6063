"""Preparing features: imputing, scaling, encoding, weights."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    OneHotEncoder,
    PCA,
    RegexTokenizer,
    SQLTransformer,
    StopWordsRemover,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablekit.functions.columns import (
    chunks,
    col,
    is_numeric,
    number_text,
    numeric_columns,
    quoted,
    require_columns,
    small_table,
)
from tablekit.functions.frequency import value_frequency
from tablekit.functions.order_stats import exact_quantiles
from tablekit.functions.storage import checkpoint
from tablekit.functions.text import STOP_WORDS
from tablekit.operators.clean import _filled, fill_values, gap_columns
from tablekit.operators.profile import column_profile
from tablekit.operators.sample import BROADCAST_CLASSES, class_table

GENERATED = ("cluster_label",)


def impute(
    df: DataFrame, numeric: str = "median", categorical: str = "mode", fitted_on: DataFrame | None = None
) -> DataFrame:
    """Fill missing values with statistics of ``fitted_on`` (the training rows)."""
    base = fitted_on if fitted_on is not None else df
    return _filled(df, fill_values(base, numeric, categorical, gap_columns(df)))


def scaling(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population std) per column; a column without spread gets std 1."""
    return _scaling(df, {c: f"double({quoted(c)})" for c in cols})


def _scaling(df: DataFrame, cells: Mapping[str, str]) -> dict[str, tuple[float, float]]:
    row = df.selectExpr(
        *[f"avg({e})" for e in cells.values()], *[f"stddev_pop({e})" for e in cells.values()]
    ).first()
    return {c: (row[i] or 0.0, row[len(cells) + i] or 1.0) for i, c in enumerate(cells)}


def _scaled(cell: str, params: tuple[float, float]) -> str:
    return f"({cell} - {number_text(params[0])}) / {number_text(params[1])}"


def apply_scaling(df: DataFrame, params: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.selectExpr(
        *[
            f"{_scaled(f'double({quoted(c)})', params[c])} AS {quoted(c)}" if c in params else quoted(c)
            for c in df.columns
        ]
    )


def standardise(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(x - mean) / population std."""
    names = list(cols or numeric_columns(df))
    return apply_scaling(df, scaling(df, names))


def prepared(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    skip: Sequence[str] = (),
    fitted_on: DataFrame | None = None,
) -> tuple[DataFrame, list[str]]:
    """Median-imputed, standardised numeric columns, as the distance-based methods need them."""
    names = list(cols or numeric_columns(df, exclude=(*GENERATED, *skip)))
    if len(names) < 2:
        raise ValueError("at least two numeric columns are needed")
    base = fitted_on if fitted_on is not None else df
    only = [quoted(c) for c in names]
    gaps = set(gap_columns(base.selectExpr(*only)))
    if fitted_on is not None and fitted_on is not df:
        gaps |= set(gap_columns(df.selectExpr(*only)))
    fills: dict[str, float | None] = {}
    if gaps:
        found = exact_quantiles(base, {c: [0.5] for c in names if c in gaps})
        fills = {c: v[0.5] for c, v in found.items()}
    cells = {}
    for c in names:
        cells[c] = f"double({quoted(c)})"
        if fills.get(c) is not None:
            cells[c] = f"coalesce({cells[c]}, {number_text(fills[c])})"
    params = _scaling(base, cells)
    out = df.selectExpr(
        *[f"{_scaled(cells[c], params[c])} AS {quoted(c)}" if c in cells else quoted(c) for c in df.columns]
    )
    return out, names


def fold_rare(df: DataFrame, cols: Sequence[str], min_frequency: int, other: str = "(rare)") -> DataFrame:
    """Categories seen fewer than ``min_frequency`` times become one category."""
    # counted once for all columns
    keep = checkpoint(
        value_frequency(df, cols)
        .filter(F.col("count") >= min_frequency)
        .select("column_name", "value")
    )
    out = df
    for i, c in enumerate(cols):
        # the kept side has at most rows / min_frequency values; Spark picks the join by its size
        kept = keep.filter(F.col("column_name") == c).select(F.col("value").alias(f"_k{i}"))
        text = col(c).cast("string")
        out = out.join(kept, text == F.col(f"_k{i}"), "left").withColumn(
            c, F.when(text.isNull(), text).otherwise(F.coalesce(F.col(f"_k{i}"), F.lit(other)))
        ).drop(f"_k{i}")
    return out


def one_hot_model(df: DataFrame, cols: Sequence[str]):
    """Fitted indexers and encoder; unseen categories give an all-zero vector."""
    stages = [
        StringIndexer(
            inputCols=list(cols),
            outputCols=[f"{c}_index" for c in cols],
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
        OneHotEncoder(
            inputCols=[f"{c}_index" for c in cols],
            outputCols=[f"{c}_onehot" for c in cols],
            handleInvalid="keep",
            dropLast=True,
        ),
    ]
    return Pipeline(stages=stages).fit(df)


def one_hot(df: DataFrame, cols: Sequence[str], min_frequency: int | None = None) -> DataFrame:
    """Adds ``<col>_onehot`` sparse vectors."""
    work = fold_rare(df, cols, min_frequency) if min_frequency else df
    out = one_hot_model(work, cols).transform(work)
    return out.drop(*[f"{c}_index" for c in cols])


def stop_tokens() -> list[str]:
    """What the word tokenizer makes of the stop words."""
    return sorted({t for w in STOP_WORDS for t in re.findall(r"\w+", w) if len(t) > 1})


def _term_counts(df: DataFrame, source: str) -> DataFrame:
    """``term, n, docs``: places and rows of every term, and a row without a term with the number of rows. Counted by
    the batch, so that no row per word is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0)
            coded = words.flatten().dictionary_encode()
            terms, code = coded.dictionary, coded.indices.to_numpy()
            row = pc.list_parent_indices(words).to_numpy()
            once = np.unique(row * max(len(terms), 1) + code) % max(len(terms), 1)
            n, docs = np.bincount(code, minlength=len(terms)), np.bincount(once, minlength=len(terms))
            names = pa.concat_arrays([terms.cast(pa.string()), pa.nulls(1, pa.string())])
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(np.append(n, batch.num_rows)), pa.array(np.append(docs, batch.num_rows))], names=["term", "n", "docs"]
            )

    counts = df.select(col(source)).mapInArrow(run, "term string, n long, docs long")
    return counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class TopTerms(Estimator):
    """Fits a term counter whose vocabulary is the most frequent terms, ties by term. The pass also counts the rows
    that hold them, which SmoothIdf weighs terms by: ``idf`` after the fit."""

    def __init__(self, source: str, out: str, size: int) -> None:
        super().__init__()
        self.source, self.out, self.size = source, out, size
        self.idf: list[float] = []

    def _fit(self, df: DataFrame):
        counts = _term_counts(df, self.source)
        # at most ``size`` rows, after that without a term
        top = counts.orderBy(F.col("term").isNotNull(), F.col("n").desc(), "term").limit(self.size + 1).collect()
        rows = sum(r["n"] for r in top if r["term"] is None)
        found = [(r["term"], r["docs"]) for r in top if r["term"] is not None][: self.size] or [("", 0)]  # a model needs one term
        self.idf = [math.log((rows + 1.0) / (docs + 1.0)) + 1.0 for _, docs in found]
        return CountVectorizerModel.from_vocabulary([t for t, _ in found], inputCol=self.source, outputCol=self.out)


class DampedCounts(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Term counts n to 1 + ln n."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None) -> None:
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        counts = vector_to_array(col(self.getInputCol()))
        damped = F.transform(counts, lambda n: F.when(n > 0, F.log(n) + 1.0).otherwise(0.0))
        return df.withColumn(self.getOutputCol(), array_to_vector(damped))


class SmoothIdf(Estimator):
    """Fits a stage that multiplies by ln((1 + n) / (1 + df)) + 1, as counted by the fit of ``terms`` before it."""

    def __init__(self, source: str, out: str, terms: TopTerms) -> None:
        super().__init__()
        self.source, self.out, self.terms = source, out, terms

    def _fit(self, df: DataFrame):
        return ElementwiseProduct(scalingVec=Vectors.dense(self.terms.idf), inputCol=self.source, outputCol=self.out)


def tfidf_stages(column: str, max_features: int, out: str) -> list:
    """Text to a length-1 vector of (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1)."""
    t = f"_tk_{column}"
    terms = TopTerms(f"{t}_words", f"{t}_tf", max_features)
    return [
        # a missing text counts as empty
        SQLTransformer(statement=f"SELECT *, coalesce({quoted(column)}, '') AS {quoted(t + '_text')} FROM __THIS__"),
        RegexTokenizer(
            inputCol=f"{t}_text",
            outputCol=f"{t}_tok",
            pattern=r"[^\p{L}\p{N}_]+",
            minTokenLength=2,
        ),
        StopWordsRemover(inputCol=f"{t}_tok", outputCol=f"{t}_words", stopWords=stop_tokens()),
        terms,
        DampedCounts(inputCol=f"{t}_tf", outputCol=f"{t}_damped"),
        SmoothIdf(f"{t}_damped", f"{t}_idf", terms),
        Normalizer(inputCol=f"{t}_idf", outputCol=out),
    ]


def tfidf(df: DataFrame, column: str, max_features: int = 300):
    """(model, table with a ``tfidf`` vector) for one text column."""
    require_columns(df, column)
    model = Pipeline(stages=tfidf_stages(column, max_features, "tfidf")).fit(df)
    names = [*[col(c) for c in df.columns], F.col("tfidf")]
    return model, model.transform(df).select(*names)


def tfidf_terms(df: DataFrame, column: str, key: Sequence[str], max_features: int = 300) -> DataFrame:
    """The same weights in long form with sublinear tf, exact in SQL: key, term, weight."""
    require_columns(df, column, *key)
    stop = stop_tokens()
    toks = F.filter(
        F.regexp_extract_all(F.lower(col(column)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)),
        lambda w: (F.length(w) > 1) & ~w.isin(*stop),
    )
    keys = [col(k) for k in key]
    tf = df.select(*keys, F.explode(toks).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = checkpoint(tf)  # read twice; tokenising is the costly part
    vocab = (
        tf.groupBy("term")
        .agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("docs"))
        .orderBy(F.col("total").desc(), "term")
        .limit(max_features)
    )
    n = df.count()
    idf = F.log(F.lit(1.0 + n) / (F.lit(1.0) + F.col("docs"))) + 1.0
    # the vocabulary has at most max_features rows
    raw = tf.join(F.broadcast(vocab), "term").withColumn("w", (F.log(F.col("tf")) + 1.0) * idf)
    # a document has at most max_features rows here
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return raw.select(*keys, "term", (F.col("w") / norm).alias("weight"))


def _level_model(df: DataFrame, cats: Sequence[str], fills: Mapping, min_frequency: int) -> StringIndexerModel:
    """Indexer of the values seen at least ``min_frequency`` times; rarer ones share the place of unseen
    ones, in training as in any later table."""
    filled = df.select(*[F.coalesce(col(c).cast("string"), F.lit(str(fills.get(c, "Unknown")))).alias(c) for c in cats])
    kept = (
        value_frequency(filled, cats)
        .filter(F.col("count") >= min_frequency)
        .groupBy("column_name")
        .agg(F.sort_array(F.collect_list("value")).alias("values"))
    )
    values = {r["column_name"]: r["values"] for r in kept.collect()}  # at most rows / min_frequency values
    return StringIndexerModel.from_arrays_of_labels(
        [values.get(c) or [""] for c in cats],
        inputCols=[f"_tk_{c}_filled" for c in cats],
        outputCols=[f"_tk_{c}_index" for c in cats],
        handleInvalid="keep",
    )


def feature_stages(
    df: DataFrame,
    target: str,
    max_text_features: int = 300,
    roles: Mapping[str, str] | None = None,
    out: str = "features",
    min_frequency: int | None = None,
) -> tuple[list, dict[str, list[str]]]:
    """Pipeline stages from raw columns to ``out``, and the columns by role."""
    if roles is None:
        roles = {r["column_name"]: r["role"] for r in column_profile(df.drop(target)).collect()}
    names = [c for c in df.columns if c != target]
    nums = [c for c in names if is_numeric(df, c)]
    texts = [c for c in names if roles.get(c) == "text"]
    cats = [c for c in names if c not in nums and c not in texts]
    stages: list = []
    parts: list[str] = []
    if nums or cats:
        base = df.select(*[col(c).cast("double").alias(c) for c in nums], *[col(c).cast("string").alias(c) for c in cats])
        fills = fill_values(base)
        params = scaling(_filled(base, {c: fills.get(c) for c in nums}), nums) if nums else {}
        exprs = []
        for c in nums:
            m, s = params[c]
            med = fills.get(c) or 0.0
            cell = f"coalesce(cast({quoted(c)} as double), {med!r}D)"
            exprs.append(f"({cell} - ({m!r}D)) / {s!r}D AS {quoted(f'_tk_{c}_scaled')}")
        for c in cats:
            safe = str(fills.get(c, "Unknown")).replace("\\", "\\\\").replace("'", "\\'")
            exprs.append(f"coalesce(cast({quoted(c)} as string), '{safe}') AS {quoted(f'_tk_{c}_filled')}")
        for part in chunks(exprs, 200):
            stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(part)} FROM __THIS__"))
        if nums:
            stages.append(VectorAssembler(inputCols=[f"_tk_{c}_scaled" for c in nums], outputCol="_tk_num"))
            parts.append("_tk_num")
        if cats:
            ins, outs = [f"_tk_{c}_filled" for c in cats], [f"_tk_{c}_index" for c in cats]
            if min_frequency:
                stages.append(_level_model(df, cats, fills, min_frequency))
            else:
                stages.append(StringIndexer(inputCols=ins, outputCols=outs, handleInvalid="keep"))
            onehot = [f"_tk_{c}_onehot" for c in cats]
            stages.append(OneHotEncoder(inputCols=outs, outputCols=onehot, handleInvalid="keep"))
            parts += onehot
    for c in texts:
        stages += tfidf_stages(c, max_text_features, f"_tk_{c}_tfidf")
        parts.append(f"_tk_{c}_tfidf")
    stages.append(VectorAssembler(inputCols=parts, outputCol=out))
    return stages, {"numeric": nums, "categorical": cats, "text": texts}


def components_for(model, share: float) -> int:
    total, n = 0.0, 0
    for v in model.explainedVariance.toArray():
        total, n = total + float(v), n + 1
        if total >= share:
            break
    return n


def feature_pipeline(
    df: DataFrame,
    target: str,
    use_pca: bool = False,
    max_text_features: int = 300,
    out: str = "features",
    min_frequency: int | None = None,
):
    """Fitted pipeline: numbers imputed and scaled (optionally reduced to 95 % of their
    variance), categories one-hot (those rarer than ``min_frequency`` folded), text tf-idf, all in
    ``out``. Columns in between have private names."""
    require_columns(df, target)
    stages, roles = feature_stages(df, target, max_text_features, out=out, min_frequency=min_frequency)
    if use_pca and len(roles["numeric"]) >= 2:
        at = next(i for i, s in enumerate(stages) if isinstance(s, VectorAssembler) and s.getOutputCol() == "_tk_num")
        numbers = Pipeline(stages=stages[: at + 1]).fit(df).transform(df)
        k = len(roles["numeric"])
        need = components_for(PCA(k=k, inputCol="_tk_num", outputCol="_tk_p").fit(numbers), 0.95)
        stages.insert(at + 1, PCA(k=need, inputCol="_tk_num", outputCol="_tk_num_pca"))
        last = stages[-1]
        last.setInputCols(["_tk_num_pca" if c == "_tk_num" else c for c in last.getInputCols()])
    return Pipeline(stages=stages).fit(df)


def label_indexer(df: DataFrame, target: str):
    text = df.select(col(target).cast("string").alias(target)).filter(col(target).isNotNull())
    return StringIndexer(
        inputCol=target, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep"
    ).fit(text)


def label_index(df: DataFrame, target: str) -> DataFrame:
    """Adds ``label``: 0, 1, ... in alphabetical order of the target text."""
    require_columns(df, target)
    model = label_indexer(df, target)
    out = model.transform(df.withColumn("_t", col(target)).withColumn(target, col(target).cast("string")))
    names = [col("_t").alias(target) if c == target else col(c) for c in df.columns]
    return out.select(*names, F.when(F.col("_t").isNotNull(), F.col("label")).cast("long").alias("label"))


def infer_problem_type(df: DataFrame, target: str) -> str:
    """classification for text and for numbers with few distinct values, else regression."""
    require_columns(df, target)
    if not is_numeric(df, target):
        return "classification"
    row = df.agg(F.count_distinct(col(target)).alias("u"), F.count(col(target)).alias("n")).first()
    few = row["u"] <= max(10, int(0.05 * row["n"])) and row["u"] < 20
    return "classification" if few else "regression"


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Per class: rows, balanced weight n / (k n_c), and whether majority/minority exceeds 3."""
    classes = class_table(df, target)
    n, k, most, least = classes.agg(F.sum("_n"), F.count(F.lit(1)), F.max("_n"), F.min("_n")).first()
    ratio = most / least if k else 0.0
    return classes.select(
        F.col("_c").alias("class"),
        F.col("_n").alias("count"),
        (F.lit(float(n or 0)) / (F.lit(float(k)) * F.col("_n"))).alias("weight"),
        F.lit(ratio).alias("ratio"),
        F.lit(ratio > 3).alias("imbalanced"),
    )


def with_class_weight(df: DataFrame, target: str, weights: DataFrame) -> DataFrame:
    """Adds the ``weight`` column."""
    classes = weights.select(F.col("class").alias("_c"), "weight")
    few = classes.count() <= BROADCAST_CLASSES
    return df.join(F.broadcast(classes) if few else classes, col(target).cast("string") == F.col("_c"), "left").drop("_c")
