"""All embeddings on their four leading components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.queries.registry import query, table
from codeloom.llm.whitening import whitened


@query("op13_spectrum_slicing")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
