"""A queue of changes with retries: each batch is delivered exactly once, or lies among the dead letters.

Delivered batches, dead letters and attempts are folders of generations, numbered by batch. A batch counts once its
number is committed, so one that runs again after a crash replaces what it left, and a committed one is passed over.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeloom.sources.generations import Generations

ATTEMPTS = 3


class ChangeQueue:
    """``deliver(rows, batch_id, attempt)`` gives the rows as delivered, or raises; ``refused`` says why a row cannot be delivered at all."""

    def __init__(self, spark: SparkSession, folder: str, deliver: Callable[[DataFrame, int, int], DataFrame] | None = None, refused: Column | None = None,
                 attempts: int = ATTEMPTS, wait_seconds: float = 0.0):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._deliver = deliver or (lambda rows, batch, attempt: rows)
        self._refused = F.lit(None).cast("string") if refused is None else refused
        self._attempts, self._wait = attempts, wait_seconds
        self._log = Generations(spark, self.folder)

    def open(self) -> ChangeQueue:
        """Begin with an empty folder; a queue that goes on after a crash is not opened again."""
        self._log.begin()
        return self

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One batch, for ``foreachBatch``."""
        if batch_id in self._log.committed():
            return
        rows = batch.withColumn("reason", self._refused)
        good, bad = rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL")
        error, attempt = None, 0
        for attempt in range(1, self._attempts + 1):
            try:
                self._log.write(self._deliver(good, batch_id, attempt).withColumn("attempts", F.lit(attempt)), "sent", batch_id)
                error = None
                break
            except Exception as e:  # whatever the receiver raises counts as a failed attempt
                error = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
                if attempt < self._attempts:
                    time.sleep(self._wait * 2 ** (attempt - 1))
        dead = bad.withColumn("attempts", F.lit(0))
        if error is not None:
            dead = dead.unionByName(good.withColumn("reason", F.lit(error)).withColumn("attempts", F.lit(attempt)))
            self._log.write(good.limit(0).withColumn("attempts", F.lit(0)), "sent", batch_id)
        self._log.write(dead, "dead", batch_id)
        self._log.commit(batch_id, error or "")

    def start(self, changes: DataFrame, checkpoint: str, **trigger):
        return (changes.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"processingTime": "5 seconds"})).start())

    def run(self, changes: DataFrame, checkpoint: str) -> ChangeQueue:
        """Work off what is there."""
        self.start(changes, checkpoint, availableNow=True).awaitTermination()
        return self

    def sent(self, schema: str) -> DataFrame:
        return self._log.read("sent", f"{schema}, attempts int").withColumnRenamed("generation", "batch_id")

    def dead(self, schema: str) -> DataFrame:
        return self._log.read("dead", f"{schema}, reason string, attempts int").withColumnRenamed("generation", "batch_id")
