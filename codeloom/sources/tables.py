"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Session setting with the number of splits for tables of long texts; without it they are read as they are stored.
SPLITS = "codeloom.input.splits"


class Tables:
    """The Parquet tables of one folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.splits = int(spark.conf.get(SPLITS, "0"))

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def spread(self, name: str, *columns: str) -> DataFrame:
        """A table whose rows carry long texts, dealt into the number of splits that the session asks for.

        A table stored as one row group would be read by one task; one with many splits needs no setting.
        """
        df = self(name).select(*columns) if columns else self(name)
        return df.repartition(self.splits) if self.splits else df
