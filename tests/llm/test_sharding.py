import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import sharding
from codeloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _sharded(docs, shards=24):
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharding.shards_of(sharding.sized(docs, F.col("text"), F.octet_length(text) + 8, F.col("doc_id")), shards).toPandas()


def _slots_are_gapless(found):
    for _, group in found.groupby("shard"):
        assert sorted(group["slot"]) == list(range(len(group)))


def test_query(spark, duck):
    found = QUERIES["op1_sampled_splitters"](spark, SF).toPandas().set_index("doc_id")
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(found) == len(rows)
    for doc, text in rows:
        data = (text or "").encode()
        assert found.loc[doc, "size"] == len(data) + 8 and found.loc[doc, "text_crc32"] == zlib.crc32(data)
    sizes = found.groupby("shard")["size"].sum()
    assert set(sizes.index) == set(range(24))
    assert (sizes - sizes.mean()).abs().max() <= found["size"].max()
    _slots_are_gapless(found)


def test_hot_key_is_dealt(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 20)).otherwise(F.concat(F.lit("x"), F.col("id").cast("string"), F.lit(" y" * 10))).alias("text"))
    found = _sharded(docs, 6)
    sizes = found.groupby("shard")["size"].sum()
    assert sizes.max() <= 1.05 * sizes.min() and len(sizes) == 6
    _slots_are_gapless(found)


def test_odd_rows(odd_docs, no_docs):
    found = _sharded(odd_docs, 3)
    assert len(found) == odd_docs.count()
    _slots_are_gapless(found)
    assert len(_sharded(no_docs)) == 0


def test_small_groups_stay_together(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 1000).cast("string")).alias("text"))
    found = _sharded(docs, 4)
    assert (found.groupby("hash")["shard"].nunique() == 1).all()


@pytest.mark.parametrize("seed", range(5))
def test_ranges_by_hash_and_id(seed):
    draw = np.random.default_rng(seed)
    splitters = np.unique(draw.integers(0, 6, (9, 2)), axis=0)
    keys = draw.integers(0, 6, (50, 2))
    want = [sum(tuple(s) <= tuple(k) for s in splitters.tolist()) for k in keys.tolist()]
    assert sharding._range_of(keys[:, 0], keys[:, 1], splitters).tolist() == want


@pytest.mark.parametrize("large", [0, 3, 400])
def test_sample_is_that_of_all_waits(spark, large):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("hash"), F.col("id").alias("rid"), F.when(F.col("id") < large, 10 ** 9).otherwise(F.col("id") % 7).alias("size"))
    total = rows.agg(F.count("*"), F.sum("size")).first()
    found = sharding._sampled(rows, 200, total[0], total[1])
    every = sharding._sampled(rows, 200, 0, 0)  # no threshold
    assert len(found) == 200 and (found == every).all()
