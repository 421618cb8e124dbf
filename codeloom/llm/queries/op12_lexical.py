"""The twenty best documents for each benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import lexical
from codeloom.llm.queries.registry import query, table

CHECK = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, docs),
impact AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS impact
           FROM tf JOIN w USING (term) JOIN lengths USING (doc_id), whole),
scores AS (SELECT item_id, doc_id, sum(repeats * impact)::BIGINT AS score
           FROM (SELECT item_id, term, count(*) AS repeats FROM q GROUP BY item_id, term) JOIN impact USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query("op12_pair_bound_maxscore", CHECK)
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = lexical.index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lexical.search(postings, table(spark, sf_dir, "benchmark").select("item_id", "text"))
