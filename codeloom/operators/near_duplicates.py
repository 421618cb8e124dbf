"""Near-duplicate groups: Jaccard of trimmed-line sets at or above a threshold, below one.

Files are taken in order; a file not yet claimed becomes a seed and claims every
later unclaimed file similar to it. This is computed for whole corpora without
comparing all pairs and without gathering a group anywhere:

1. Files with the same line set and line count form one node, so copies count once.
2. A node publishes the prefix of its lines in a global order, rare lines first.
   Two similar nodes always share a prefix line: the filter loses nothing. A line
   counts apart for each class of sizes, since similar sets are of similar size.
3. Rounds: the first open node of every prefix line stands for that line. A node
   that is first on all its lines cannot be claimed any more and becomes a seed;
   the nodes on its lines are compared with it. A line holding a third of the
   corpus thus costs one comparison per row and round, never a square.

Rounds repeat until no node is open. ``seeds_per_line`` lets several open nodes
of a busy line be settled in one round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from codeloom.functions.similarity import line_set
from codeloom.functions.text import line_count
from codeloom.session import cut_lineage


def _nodes(files: DataFrame) -> DataFrame:
    """One row per (line set, line count): first file id and the sorted line hashes."""
    keyed = files.select(
        "file_id", line_count("content").alias("n_lines"),
        F.array_sort(F.array_distinct(F.transform(line_set("content"), lambda x: F.xxhash64(x)))).alias("lines"))
    keyed = keyed.withColumn("node", F.sha2(F.concat_ws(",", F.transform("lines", lambda x: x.cast("string")),
                                                        F.col("n_lines").cast("string")), 256))
    return keyed


def _smallest_set(threshold: float) -> int:
    """Below this many distinct lines no two different sets reach the threshold."""
    n = 1
    while n / (n + 1) < threshold:
        n += 1
    return n


def _prefix(nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, first_id, token) rows: of each node's first ``n - ceil(threshold * n) + 1`` lines those that others have.

    Lines stand in the order of (nodes that hold them, hash). Lines of one node only come first and bring no
    partner, so they are counted and not moved; the others find their number by a join on the line.
    """
    entries = nodes.select("node", F.explode("lines").alias("line"))
    spread = cut_lineage(entries.groupBy("line").agg(F.count("*").alias("holders")).where("holders > 1"))
    # a node's lines gather again: bounded by the text they come from
    known = entries.join(spread, "line").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("holders", "line"))).alias("shared"))
    n = F.size("lines")
    keep = (n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")
    left = F.greatest(keep - (n - F.size("shared")), F.lit(0))
    chosen = nodes.join(known, "node").select("node", "first_id", n.alias("n"), F.explode(F.slice("shared", F.lit(1), left)).alias("s"))
    # Sets whose sizes differ by the threshold at most are of one class or of two that are next to each other.
    size_class = F.floor(F.log(F.col("n")) / (math.log(1 / threshold) * 1.0001))
    classes = F.explode(F.array(size_class, size_class + 1)).alias("size_class")
    return chosen.select("node", "first_id", "s.line", classes).select("node", "first_id", F.xxhash64("line", "size_class").alias("token"))


def _similarity(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def near_duplicate_members(files: DataFrame, threshold: float = 0.85, seeds_per_line: int = 8) -> DataFrame:
    """``group_id, file_id, similarity``: seed (similarity null) and members of every group of two or more.

    The threshold is held between 0 and 1; from 1 on there are no groups, since equal sets are no near duplicates.
    """
    threshold = max(0.0, min(1.0, threshold))
    spark = files.sparkSession
    keyed = _nodes(files)
    if threshold == 1:
        none = keyed.limit(0)
        return _groups(none, _empty(spark, none.withColumnRenamed("file_id", "first_id")))
    if threshold > 0:
        keyed = keyed.where(F.size("lines") >= _smallest_set(threshold))
    keyed = cut_lineage(keyed)
    nodes = cut_lineage(keyed.groupBy("node").agg(
        F.min("file_id").alias("first_id"), F.first("lines").alias("lines"), F.first("n_lines").alias("n_lines")))
    prefix = _prefix(nodes, threshold) if threshold > 0 else nodes.select("node", "first_id", F.lit(0).alias("token"))
    # tokens of one node only can bring no partner
    shared = prefix.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    tokens = cut_lineage(prefix.join(shared, "token", "left_semi"))
    members = cut_lineage(nodes.join(tokens.select("node").distinct(), "node", "left_semi"))
    # claims: member node -> smallest seed found so far
    claims = _empty(spark, members)
    open_nodes = members.select("node")
    while True:
        step = _round(tokens, members, open_nodes, claims, threshold, seeds_per_line)
        claims = cut_lineage(claims.unionByName(step["claims"]).groupBy("node").agg(
            F.min(F.struct("seed_id", "similarity")).alias("c")).select("node", "c.seed_id", "c.similarity"))
        settled = step["settled"]
        open_nodes = cut_lineage(open_nodes.join(settled, "node", "left_anti").join(claims, "node", "left_anti"))
        if open_nodes.isEmpty():
            break
    return _groups(keyed, claims)


def _empty(spark, members: DataFrame) -> DataFrame:
    schema = StructType.fromDDL("node string, seed_id bigint, similarity double")
    return spark.createDataFrame([], schema).withColumn("seed_id", F.col("seed_id").cast(members.schema["first_id"].dataType))


def _similar(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(node, seed) pairs that pass the line-count gate and the threshold, with their similarity."""
    lines = members.select("node", "lines", "n_lines")
    seeds = members.select(F.col("node").alias("seed"), F.col("lines").alias("s_lines"), F.col("n_lines").alias("s_n"))
    small, large = F.least(F.size("lines"), F.size("s_lines")), F.greatest(F.size("lines"), F.size("s_lines"))
    return (pairs.join(lines, "node").join(seeds, "seed")
            .where((small >= large * F.lit(threshold) - F.lit(1e-9))
                   & (F.abs(F.col("n_lines") - F.col("s_n")) <= F.greatest("n_lines", "s_n") * 0.5))
            .withColumn("similarity", _similarity(F.col("lines"), F.col("s_lines")))
            .where((F.col("similarity") >= threshold) & (F.col("similarity") < 1.0))
            .select("node", "seed", "seed_id", "similarity"))


def _round(tokens: DataFrame, members: DataFrame, open_nodes: DataFrame, claims: DataFrame, threshold: float,
           per_line: int) -> dict[str, DataFrame]:
    """Settle nodes that no open node can claim any more, and what they claim.

    The ``per_line`` first open nodes of each token are its heads. A node that is a head on all
    its tokens has every open predecessor it could be similar to among those heads; if it is
    similar to none of them it is a seed for good. The first open node of all always is.
    """
    live = tokens.join(open_nodes, "node", "left_semi")
    w = Window.partitionBy("token").orderBy("first_id")
    # the rank filter becomes a per-partition limit below the shuffle, so a hot token sends few rows
    heads = live.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_line)
    heads = cut_lineage(heads.select("token", F.col("node").alias("seed"), F.col("first_id").alias("seed_id")))
    n_tokens = live.groupBy(F.col("node").alias("seed")).agg(F.count("*").alias("n_tokens"))
    candidates = (heads.groupBy("seed").agg(F.count("*").alias("n_heads"))
                  .join(n_tokens, "seed").where("n_heads = n_tokens").select("seed"))
    candidate_heads = heads.join(candidates, "seed", "left_semi")
    # at most per_line**2 comparisons a token
    earlier = (candidate_heads.select("token", F.col("seed").alias("node"), F.col("seed_id").alias("first_id"))
               .join(heads, "token").where("seed_id < first_id").select("node", "seed", "seed_id").distinct())
    blocked = _similar(earlier, members, threshold).select(F.col("node").alias("seed")).distinct()
    safe = cut_lineage(candidates.join(blocked, "seed", "left_anti"))
    # seeds meet the later nodes on their tokens: open ones, and claimed ones whose seed comes later
    waiting = (tokens.join(claims.select("node", F.col("seed_id").alias("claimed_by")), "node", "left")
               .join(open_nodes.withColumn("is_open", F.lit(True)), "node", "left")
               .where(F.col("is_open") | F.col("claimed_by").isNotNull()))
    pairs = (waiting.join(heads.join(safe, "seed", "left_semi"), "token")
             .where((F.col("first_id") > F.col("seed_id"))
                    & (F.col("claimed_by").isNull() | (F.col("seed_id") < F.col("claimed_by"))))
             .select("node", "seed", "seed_id").distinct())
    claimed = _similar(pairs, members, threshold).select("node", "seed_id", "similarity")
    return {"claims": claimed, "settled": safe.select(F.col("seed").alias("node"))}


def _groups(keyed: DataFrame, claims: DataFrame) -> DataFrame:
    """Node-level claims spread over the files: all files of a claimed node, and the seed's first file."""
    members = keyed.join(claims, "node").select(
        F.col("seed_id").alias("group_id"), "file_id", "similarity")
    seeds = members.select("group_id").distinct().select(
        "group_id", F.col("group_id").alias("file_id"), F.lit(None).cast("double").alias("similarity"))
    return members.unionByName(seeds)


def near_duplicate_groups(members: DataFrame) -> DataFrame:
    """One row per group: size, and similarity of the seed to its first member."""
    first = F.min_by("similarity", F.when(F.col("similarity").isNotNull(), F.col("file_id")))
    return members.groupBy("group_id").agg(F.count("*").alias("files"), first.alias("similarity"))
