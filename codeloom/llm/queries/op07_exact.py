"""Exact duplicates among all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.exact import duplicate_classes
from codeloom.llm.queries.registry import query, table

CHECK = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""


@query("op7_block_naming", CHECK)
def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
