"""Toxicity of all documents, learnt from the labels of two thirds of the ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeloom.llm import toxicity
from codeloom.llm.queries.registry import query, table


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's label is kept back from training."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def learnt(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic")
    return toxicity.train(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


@query("op11_toxic_segments")
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, learnt(spark, sf_dir))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "passages")
