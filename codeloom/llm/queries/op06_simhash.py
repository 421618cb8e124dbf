"""Near-duplicates among all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.queries.registry import query, table
from codeloom.llm.simhash import near_duplicates


@query("op6_simhash_trie_join")
def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
