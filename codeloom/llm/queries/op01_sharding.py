"""Shards of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.llm.queries.registry import query, table
from codeloom.llm.sharding import shards_of, sized

SHARDS = 24


@query("op1_sampled_splitters")
def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = sized(docs, F.col("text"), F.octet_length(text) + 8, F.col("doc_id"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shards_of(keyed, SHARDS).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                           F.lit(None).cast("int").alias("grown_shard"))
