"""Packing of all documents, with digests in place of the ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.packing import pack
from codeloom.llm.queries.registry import query, table


@query("op9_power_of_two_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False).drop("ids")
