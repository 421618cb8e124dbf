"""Quality of all documents, learnt from the labels of four fifths of the ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeloom.llm import quality
from codeloom.llm.queries.registry import query, table


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's label is kept back from training."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def learnt(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """Weights learnt from the labels that are not held back."""
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.fit(quality.training_rows(docs, labels, "doc_id", "label"), "doc_id", "text", "label")


@query("op3_quality_classifier")
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.score(docs, learnt(spark, sf_dir))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
