"""Sampled segmentations of all documents, with digests in place of the ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.pieces import segmented
from codeloom.llm.queries.registry import query, table


@query("op10_sampled_segmentation")
def cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return segmented(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False).drop("ids")
