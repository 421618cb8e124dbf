"""Line diffs of text pairs and the set-based counts that scale without them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.functions.text import content_key, lines
from codeloom.operators.versions import with_texts
from codeloom.session import cut_lineage

ROWS_PER_BATCH = 50_000


def diff_lines(pairs: DataFrame, ignore_trailing_blanks: bool = False, approximate: bool = False, whole: bool = False) -> DataFrame:
    """``pair_id, pos, type, content, line_num`` of (pair_id, old, new); with ``whole``, a row per pair with these in ``lines``.

    Equal pairs never reach Python; the others are spread by pair, whose texts bound the work of a row. ``approximate``
    asks for the linear walk in place of a shortest diff. What follows a whole diff works inside its row, without a
    shuffle; each pair id then has one row.
    """
    names = ["pos", "type", "content", "line_num"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from codeloom.functions.linediff import diff
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for pair, old, new in zip(batch["pair_id"], batch["old"], batch["new"]):
                found = diff(old, new, ignore_trailing_blanks, approximate)
                if found:
                    rows.append((pair, range(len(found)), *map(list, zip(*found))))
                    held += len(found)
                if held >= ROWS_PER_BATCH:
                    yield pd.DataFrame(rows, columns=["pair_id", *names])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["pair_id", *names])

    kind = pairs.schema["pair_id"].dataType.simpleString()
    schema = f"pair_id {kind}, pos array<bigint>, type array<string>, content array<string>, line_num array<bigint>"
    narrow = pairs.select("pair_id", "old", "new")
    changed = narrow.where(~F.col("old").eqNullSafe(F.col("new"))).mapInPandas(run, schema).select(
        "pair_id", F.arrays_zip(*names).alias("lines"))

    def unchanged(line: Column, pos: Column) -> Column:
        text = F.rtrim(line, F.lit(" \t\r\n\f\u000b")) if ignore_trailing_blanks else line
        return F.struct(pos.cast("bigint").alias("pos"), F.lit("unchanged").alias("type"), text.alias("content"),
                        (pos + 1).cast("bigint").alias("line_num"))

    same = narrow.where(F.col("old").eqNullSafe(F.col("new")) & (F.col("new") != "")).select(
        "pair_id", F.transform(lines("new"), unchanged).alias("lines"))
    found = changed.unionByName(same)
    return found if whole else found.select("pair_id", F.inline("lines"))


def text_pairs(keyed: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs to diff, each once, and who has them: (``pair_id, old, new``) and (``pair_id, owner``).

    ``keyed`` has ``pair_id, old_key, new_key``. Owners, the pair ids of ``keyed``, share a pair where they have the same
    keys; an owner of several rows has them all under one ``pair_id``. What is found of a pair is handed to its owners by
    ``for_owners``, so texts move by pair and not by owner.
    """
    keys = F.array_sort(F.collect_list(F.struct("old_key", "new_key")))
    owned = keyed.groupBy(F.col("pair_id").alias("owner")).agg(keys.alias("keys"))
    owned = cut_lineage(owned.withColumn("pair_id", content_key(F.to_json("keys"))))  # both results come from the same rows
    pairs = owned.select("pair_id", "keys").dropDuplicates(["pair_id"]).select("pair_id", F.inline("keys"))
    return with_texts(pairs, contents).select("pair_id", "old", "new"), owned.select("pair_id", "owner")


def for_owners(found: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """The rows of each pair, for all of its owners, whose id becomes ``pair_id``; without ``owners``, a pair id is the list of them."""
    rest = [c for c in found.columns if c != "pair_id"]
    if owners is None:
        return found.select(F.explode("pair_id").alias("pair_id"), *rest)
    return owners.join(found, "pair_id").select(F.col("owner").alias("pair_id"), *rest)


def _is_whole(d: DataFrame) -> bool:
    return "lines" in d.columns


def _without(kind: str) -> Column:
    return F.filter("lines", lambda e: e["type"] != kind)


def _of(kind: str) -> Column:
    return F.filter("lines", lambda e: e["type"] == kind)


def diff_statistics(d: DataFrame) -> DataFrame:
    kinds = ("added", "removed", "unchanged")
    if _is_whole(d):
        return d.select("pair_id", *[F.size(_of(k)).cast("bigint").alias(k) for k in kinds])
    return d.groupBy("pair_id").agg(*[F.count_if(F.col("type") == k).alias(k) for k in kinds])


def rebuilt_texts(d: DataFrame) -> DataFrame:
    """``old`` and ``new`` of each pair, from the diff alone."""
    if _is_whole(d):
        return d.select("pair_id", *[F.array_join(F.transform(_without(kind), lambda e: e["content"]), "\n").alias(name)
                                     for name, kind in (("old", "added"), ("new", "removed"))])

    def text(without: str) -> Column:
        kept = F.array_sort(F.collect_list(F.when(F.col("type") != without, F.struct("pos", "content"))))
        return F.array_join(F.transform(kept, lambda e: e["content"]), "\n")

    return d.groupBy("pair_id").agg(text("added").alias("old"), text("removed").alias("new"))


def numbered_lines(d: DataFrame) -> DataFrame:
    """Running old, new and unified line numbers; a pair's lines come from one row, so the window is bounded.

    Of whole diffs the old and the new lines are numbered apart, and an unchanged line, the n-th in both, has both numbers.
    """
    if _is_whole(d):
        def line(e: Column, old: Column, new: Column) -> Column:
            return F.struct(*[e[c].alias(c) for c in ("pos", "type", "content", "line_num")], old.alias("old_no"), new.alias("new_no"),
                            (e["pos"] + 1).alias("unified_no"))

        def side(kind: str) -> Column:
            return F.transform(_without(kind), lambda e, n: F.struct(e.alias("e"), (n + 1).cast("bigint").alias("no")))

        def of(c: str, kind: str) -> Column:
            return F.filter(c, lambda x: x["e"]["type"] == kind)

        none = F.lit(None).cast("bigint")
        sides = d.select("pair_id", side("added").alias("_old"), side("removed").alias("_new"))
        return sides.select("pair_id", F.array_sort(F.concat(
            F.transform(of("_old", "removed"), lambda x: line(x["e"], x["no"], none)),
            F.transform(of("_new", "added"), lambda x: line(x["e"], none, x["no"])),
            F.zip_with(of("_old", "unchanged"), of("_new", "unchanged"), lambda x, y: line(x["e"], x["no"], y["no"])))).alias("lines"))
    w = Window.partitionBy("pair_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    old, new = F.col("type") != "added", F.col("type") != "removed"
    return d.withColumn("old_no", F.when(old, F.sum(old.cast("bigint")).over(w))).withColumn(
        "new_no", F.when(new, F.sum(new.cast("bigint")).over(w))).withColumn("unified_no", F.col("pos") + 1)


def last_numbers(d: DataFrame) -> DataFrame:
    """The last old and new line number of each pair of ``numbered_lines``."""
    if _is_whole(d):
        return d.select("pair_id", *[F.array_max(F.col(f"lines.{c}")).alias(name)
                                     for name, c in (("last_old", "old_no"), ("last_new", "new_no"))])
    return d.groupBy("pair_id").agg(F.max("old_no").alias("last_old"), F.max("new_no").alias("last_new"))


def unified_text(d: DataFrame) -> DataFrame:
    """``+ ``, ``- ``, two blanks: one text per pair."""
    def entry(kind: Column, content: Column) -> Column:
        mark = F.when(kind == "added", F.lit("+ ")).when(kind == "removed", F.lit("- ")).otherwise(F.lit("  "))
        return F.concat(mark, content, F.lit("\n"))

    if _is_whole(d):
        return d.select("pair_id", F.array_join(F.transform("lines", lambda e: entry(e["type"], e["content"])), "").alias("diff"))
    entries = F.array_sort(F.collect_list(F.struct("pos", entry(F.col("type"), F.col("content")).alias("line"))))
    return d.groupBy("pair_id").agg(F.array_join(F.transform(entries, lambda e: e["line"]), "").alias("diff"))


def changed_line_sets(pairs: DataFrame) -> DataFrame:
    """Distinct lines only in the old or only in the new text: map-only, no alignment."""
    a, b = lines("old"), lines("new")
    return pairs.select("pair_id", F.size(F.array_except(a, b)).alias("only_old"), F.size(F.array_except(b, a)).alias("only_new"))


def changed_line_bags(pairs: DataFrame, whole: bool = False) -> DataFrame:
    """Lines lost and gained counting repeats; lines are keyed by (pair, line).

    With ``whole``, each pair id has one row, whose lines are counted where they are.
    """
    if whole:
        return _counted_bags(pairs)

    def side(name: str, sign: int) -> DataFrame:
        return pairs.select("pair_id", F.explode(lines(name)).alias("line")).withColumn("n", F.lit(sign))

    per_line = side("old", -1).unionByName(side("new", 1)).groupBy("pair_id", F.xxhash64("line"), "line").agg(F.sum("n").alias("n"))
    return per_line.groupBy("pair_id").agg(
        F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("lost"), F.sum(F.greatest("n", F.lit(0))).alias("gained"))


def _counted_bags(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pair, old, new in zip(batch["pair_id"], batch["old"], batch["new"]):
                a, b = (Counter(() if text is None else text.split("\n")) for text in (old, new))
                rows.append((pair, (a - b).total(), (b - a).total()))
            yield pd.DataFrame(rows, columns=["pair_id", "lost", "gained"])

    kind = pairs.schema["pair_id"].dataType.simpleString()
    changed = pairs.where(~F.col("old").eqNullSafe(F.col("new"))).select("pair_id", "old", "new")
    same = pairs.where(F.col("old").eqNullSafe(F.col("new")) & F.col("new").isNotNull())
    none = F.lit(0).cast("bigint")
    return changed.mapInPandas(run, f"pair_id {kind}, lost bigint, gained bigint").unionByName(
        same.select("pair_id", none.alias("lost"), none.alias("gained")))
