"""Registration of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _wire(df: DataFrame) -> DataFrame:
    """Widen 32-bit integers so that both engines report the same types."""
    narrow = ("integer", "short", "byte")
    return df.select(*[
        F.col(f"`{f.name}`").cast("bigint").alias(f.name) if f.dataType.typeName() in narrow else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def query(name: str, check: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: _wire(fn(Tables(spark, folder)))
        if check is not None:
            CHECKS[name] = check
        return fn
    return register
