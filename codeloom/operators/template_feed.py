"""Users' templates as a feed of changes: added, changed and deleted rows, compacted to the templates that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FIELDS = {"name": "string", "description": "string", "category": "string", "language": "string", "tags": "array<string>",
          "files": "array<struct<path:string,language:string,content:string>>"}
FEED = "seq long, kind string, id string, " + ", ".join(f"{n} {t}" for n, t in FIELDS.items())
FORMAT_VERSION = "1.0.0"
_ADD, _CHANGE, _DELETE = "add", "change", "delete"


def _defaults() -> dict:
    empty = F.array().cast(FIELDS["files"])
    return {"description": F.lit(""), "category": F.lit("custom"), "language": F.lit("text"), "tags": F.array(F.lit("custom")), "files": empty}


def compacted(feed: DataFrame) -> DataFrame:
    """``id`` and fields of the templates after all changes of ``feed`` (columns of ``FEED``; ``seq`` is unique for an id).

    An added template has defaults for what it leaves open, and replaces one with its id. A change sets the fields that
    it gives; one of a template that is not there does nothing. A deleted template may be added again. Both steps
    aggregate before the shuffle, so a template with many changes is no hot key.
    """
    spans = feed.groupBy("id").agg(F.max(F.when(F.col("kind") == _ADD, F.col("seq"))).alias("_from"), F.max(F.when(F.col("kind") == _DELETE, F.col("seq"))).alias("_gone"))
    alive = spans.where("_from IS NOT NULL AND (_gone IS NULL OR _gone < _from)").select("id", "_from")
    rows = feed.where(F.col("kind") != _DELETE).join(alive, "id").where("seq >= _from")
    for name, value in _defaults().items():
        rows = rows.withColumn(name, F.when(F.col("kind") == _ADD, F.coalesce(F.col(name), value)).otherwise(F.col(name)))
    return rows.groupBy("id").agg(*[F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(name) for name in FIELDS])


def to_json(templates: DataFrame) -> DataFrame:
    """One document a template, as text lines."""
    return templates.select(F.to_json(F.struct(F.lit(FORMAT_VERSION).alias("version"), F.struct(*FIELDS).alias("template"))).alias("value"))


def from_json(lines: DataFrame, first_seq: int = 0) -> DataFrame:
    """Feed rows that add the templates of such lines under new ids, and ``problem`` for lines that hold none.

    Name and files are required. The id is made of the line, so that a repeated import gives the same template.
    """
    body = ",".join(f"{n}:{t}" for n, t in FIELDS.items())
    parsed = lines.select("value", F.from_json("value", f"version string, template struct<{body}>").alias("j"))
    problem = F.when(F.col("j.template").isNull() | (F.coalesce("j.template.name", F.lit("")) == "") | F.col("j.template.files").isNull(), F.lit("not a template"))
    return parsed.select(F.lit(first_seq).cast("long").alias("seq"), F.lit(_ADD).alias("kind"),
                         F.concat(F.lit("imported_"), F.substring(F.sha2(F.coalesce("value", F.lit("")), 256), 1, 16)).alias("id"),
                         *[F.col(f"j.template.{n}").alias(n) for n in FIELDS], problem.alias("problem"))
