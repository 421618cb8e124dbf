"""Personal data in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import pii
from codeloom.llm.queries.registry import query, table


@query("op4_personal_data")
def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"), pii.train())
