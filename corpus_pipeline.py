"""The corpus pipeline: STAGES over ``documents``, each written as a table and read again before the next.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns
of ``documents`` (also columns the table has more than usual, whatever their names); the last one returns
the chosen mixture with n_tokens and repeats. A stage lets go of the models of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekit.llm import decontaminate, language, minhash, pii, queries
from tablekit.llm.base import ROW, packed, release, table, unpacked, written

#: A text that costs more bits per byte than its bytes have is in none of the learned languages; texts of
#: fewer bytes say too little to be rejected for it.
MOST_BITS, FEWEST_BYTES = 8.0, 64


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those that no learned language codes in fewer bits than they have."""
    release()
    model = queries.language_model(spark, sf_dir)
    found = language.identify(packed(docs, "text"), model, keep=(ROW, "text"))
    foreign = (F.col("bits_per_byte") > MOST_BITS) & (F.octet_length("text") >= FEWEST_BYTES)
    return found.where((F.col("lang_pred") != language.UND) & ~foreign).select(*unpacked(docs.columns, "text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the smallest id."""
    release()
    return minhash.near_duplicates(docs).keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is text of the benchmark go."""
    release()
    windows = decontaminate.benchmark_windows(table(spark, sf_dir, "benchmark"))
    found = decontaminate.scan(packed(docs, "text"), windows)
    return decontaminate.remove(found).select(*unpacked(docs.columns, "text"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data becomes its kind in brackets, and n_chars follows the text."""
    release()
    field = queries.personal_data_field(docs)
    found = pii.find_personal_data(packed(docs, "text"), field, mask=True)
    columns = unpacked(docs.columns, "text")
    if "n_chars" in docs.columns:
        old = F.col(ROW).getField("n_chars")
        chars = F.when(F.size("spans") > 0, F.length("text")).otherwise(old).cast(docs.schema["n_chars"].dataType)
        columns[docs.columns.index("n_chars")] = chars.alias("n_chars")
    return found.select(*columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens left, by the weights of domains, languages and sources."""
    release()
    return queries.mixed(docs)


STAGES = [
    ("language", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", mask_personal_data),
    ("mixture", mix),
]

#: Learned models and verified near copies have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
