"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next stage's
``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.llm import exact, packing, pii, quality, simhash
from codeloom.llm.queries.op03_quality import held_out
from codeloom.llm.shared import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram classifier does not reject; it learns from the labels of four fifths of the ids."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    rows = quality.training_rows(docs.select("doc_id", "text"), labels, "doc_id", "label")
    return quality.score(docs, quality.fit(rows, "doc_id", "text", "label")).where("predicted = 1").select(docs.columns)


def first_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts that with the smallest id."""
    return exact.without_duplicates(docs)


def first_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose SimHash fingerprints are linked that with the smallest id."""
    return simhash.one_of_each(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars``, where it is a column, follows the text."""
    found = pii.without_personal_data(docs, pii.train())
    if "n_chars" not in docs.columns:
        return found
    length = F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
    return found.withColumn("n_chars", length)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences whose lengths are powers of two; ``ids`` holds little-endian unsigned 32-bit numbers."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", first_of_equal),
    ("SimHash near-dedup", first_of_similar),
    ("PII", masked),
    ("packing", packed),
]
#: No SQL: the classifier, the random field and the tokenizer are not expressible. Tests use a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
