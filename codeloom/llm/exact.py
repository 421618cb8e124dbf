"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of equal length. Distinct blocks are sorted and get integers as names; then adjacent
pairs of names are sorted and named in turn, until each text has a single name. Two texts have the same number of
blocks and the same last name exactly when they are equal: names come from sorting contents, and a hash only says
where a content is sorted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.llm.shared import rows_once, written

#: Code points in a block.
BLOCK = 4096
#: Distinct contents are sorted inside this many hash buckets; a name is its bucket and its place there, from 1.
BUCKETS = 1 << 16
_PLACES = 1 << 46


def normal_text(text: Column) -> Column:
    """Runs of blanks made one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _blocks(text: Column, size: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def _named(distinct: DataFrame, order: list[str]) -> DataFrame:
    """``name`` for each row of ``distinct``: its hash bucket and its place when the bucket is sorted by ``order``.

    ``twin`` tells whether another row has the same hash.
    """
    sorted_bucket = Window.partitionBy("bucket").orderBy("hash", *order)
    beside = [F.coalesce(step("hash").over(sorted_bucket) == F.col("hash"), F.lit(False)) for step in (F.lag, F.lead)]
    return (distinct.withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)))
            .withColumn("name", F.col("bucket") * _PLACES + F.row_number().over(sorted_bucket))
            .withColumn("twin", beside[0] | beside[1]).drop("bucket"))


def block_names(docs: DataFrame, id_col: str, text_col: str, size: int = BLOCK,
                hashed: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """(rid, blocks, pos, name) of all blocks, and (rid, id, sha) of all rows.

    Contents are shuffled once, as distinct blocks. A block finds its name by its hash, or, where two different
    blocks have the same hash, by the block itself.
    """
    text = normal_text(F.col(text_col))
    # rid tells rows with the same id apart. It is written once, with all that is told of the row.
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("rid", "id", F.unhex(F.sha2("text", 256)).alias("sha"), _blocks(F.col("text"), size).alias("all"))
    narrow = written(rows.select("rid", "id", "sha", F.transform("all", lambda b: hashed(b)).alias("hashes")), "block-hashes")
    contents = docs.select(F.explode(_blocks(text, size)).alias("block")).distinct()
    named = _named(contents.withColumn("hash", hashed(F.col("block"))), ["block"])
    names = written(named.select("hash", "name", "twin", F.when(F.col("twin"), F.col("block")).alias("block")), "block-names")
    if names.where("twin").isEmpty():
        found = narrow.select("rid", F.size("hashes").alias("blocks"), F.posexplode("hashes").alias("pos", "hash"))
        return found.join(names.select("hash", "name"), "hash").drop("hash"), narrow.drop("hashes")
    whole = written(rows.select("rid", "id", "sha", F.size("all").alias("blocks"), F.posexplode("all").alias("pos", "block")), "blocks")
    found = whole.withColumn("hash", hashed(F.col("block"))).withColumnRenamed("block", "own")
    same = F.col("twin") == F.lit(False)
    found = found.join(names, "hash").where(same | (F.col("own") == F.col("block")))
    return found.select("rid", "blocks", "pos", "name"), whole.where("pos = 0").select("rid", "id", "sha")


def _paired(level: DataFrame) -> DataFrame:
    """One name for each two neighbours; a last one without neighbour is paired with 0, which is no name."""
    left = F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a")
    right = F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("b")
    pairs = level.groupBy("rid", "blocks", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(left, right)
    names = _named(pairs.select("a", "b").distinct().withColumn("hash", F.xxhash64("a", "b")), ["a", "b"])
    return pairs.join(names.select("a", "b", "name"), ["a", "b"]).select("rid", "blocks", "pos", "name")


def identities(names: DataFrame) -> DataFrame:
    """(rid, blocks, name): the one name that each row's blocks come to. Rounds: the logarithm of the longest text's blocks."""
    level = written(names, "names-0")
    longest = level.agg(F.max("blocks")).first()[0] or 1
    done, width = [level.where("blocks = 1")], 1
    while width < longest:
        level = written(_paired(level.where(F.col("blocks") > width)), f"names-{2 * width}")
        width *= 2
        done.append(level.where(F.col("blocks") <= width))
    return reduce(DataFrame.unionByName, [d.select("rid", "blocks", "name") for d in done])


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK,
                      hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts that with the smallest id stays (a null id counts as largest; of repeated rows one
    stays). A null text counts as empty. Other columns are not looked at. An empty table gives no rows.
    """
    names, rows = block_names(docs, id_col, text_col, size, hashed)
    known = written(identities(names).join(rows, "rid"), "identities")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "rid")
    groups = known.groupBy("blocks", "name").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    groups = written(groups, "groups")  # the join then reads two plain shuffles, of which Spark splits a hot group
    return known.join(groups, ["blocks", "name"]).select(
        F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows are found again by id and the hash of their text."""
    classes = duplicate_classes(docs, id_col, text_col).groupBy(F.col(id_col).alias("id"), F.col("text_sha256").alias("key"))
    chosen = classes.agg(F.count("*").alias("copies"), F.max("kept").alias("kept")).where("kept")
    return rows_once(docs, id_col, F.sha2(normal_text(F.col(text_col)), 256), written(chosen, "staying"))
