"""Nearest neighbours of every twentieth embedding among all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.llm.nearest import nearest
from codeloom.llm.queries.registry import query, table


@query("op5_cross_polytope")
def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0)
