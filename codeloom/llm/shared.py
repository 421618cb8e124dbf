"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeloom.session import ensure_checkpoint_dir

#: Rows whose texts a Python worker holds as strings at a time.
ROWS_AT_ONCE = 256
#: Code points of one text that are worked on at a time.
CHUNK = 1 << 20
_BLANK = re.compile(r"[ \t\n\r]")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the one named in ``spark.checkpoint.dir``, which all executors see."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage is cut and nothing is computed twice.

    The folder is kept, since the frames that read it are lazy; it goes with the checkpoint folder.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few long texts are Python strings at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """``text`` cut into pieces of about ``size`` code points, each ending after a blank (or at the text's end)."""
    start = 0
    while len(text) - start > size:
        found = _BLANK.search(text, start + size)
        if found is None:
            break
        yield text[start:found.end()]
        start = found.end()
    if start < len(text):
        yield text[start:] if start else text


def unused(name: str, columns: list[str]) -> str:
    """``name``, or a longer one where columns have it (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def rows_once(docs: DataFrame, id_col: str, key: Column, chosen: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and ``key`` are in ``chosen`` (id, key, copies), each once, with all their columns.

    ``copies`` says how many rows have that id and key; only where it exceeds one are rows compared with each other.
    """
    own, other_id, other_key, copies = (unused(n, docs.columns) for n in ("_key", "_chosen_id", "_chosen_key", "_copies"))
    tagged = docs.withColumn(own, key)
    chosen = chosen.select(F.col("id").alias(other_id), F.col("key").alias(other_key), F.col("copies").alias(copies))
    same = tagged[id_col].eqNullSafe(F.col(other_id)) & (F.col(own) == F.col(other_key))
    found = tagged.join(chosen.where(F.col(copies) == 1), same, "left_semi")
    repeated = chosen.where(F.col(copies) > 1)
    if not repeated.isEmpty():
        found = found.unionByName(tagged.join(repeated, same, "left_semi").dropDuplicates([id_col, own]))
    return found.drop(own)
