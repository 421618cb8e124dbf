"""Row numbers and winners that survive a key holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def numbered(df: DataFrame, keys: list[str], order: list[Column], coarse: Column, out: str = "rn") -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without one task per key.

    ``coarse`` is non-decreasing in ``order`` (say, an id divided by a million, or
    a minute). Rows are numbered inside (keys, coarse); an offset, the count of
    the key's earlier coarse groups, is added. Only one narrow row per coarse
    group ever meets in a window over the key alone.
    """
    tagged = df.withColumn("_coarse", coarse)
    counts = tagged.groupBy(*keys, "_coarse").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = tagged.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_coarse").orderBy(*order)))
    renamed = offsets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                             F.col("_coarse").alias("_c"), "_before")
    same = F.col("_coarse").eqNullSafe(F.col("_c"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(renamed, same)
    return joined.withColumn(out, F.col("_before") + F.col("_local")).select(*df.columns, out)


def coarse_text(text: Column, characters: int = 7) -> Column:
    """A whole number that does not fall as ``text`` rises: its first bytes. For the coarse groups of ``numbered``."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, characters)), 2 * characters, "0"), 16, 10).cast("bigint")


def winners(df: DataFrame, keys: list[str], id_col: str, best: Column, last: bool = True) -> DataFrame:
    """Ids of the row with the largest (or smallest) ``best`` per key.

    A pre-aggregated max/min over narrow columns: a hot key is folded before the
    shuffle, and contents never travel with it.
    """
    pick = F.max_by(id_col, best) if last else F.min_by(id_col, best)
    return df.groupBy(*keys).agg(pick.alias(id_col))


def rows_of(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` with a chosen id; the id is unique, so the join cannot skew."""
    return df.join(ids.select(id_col), id_col, "left_semi")
