"""The tables of one project folder: read lazily, empty with their schema where they are not there."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from boardloom.schemas import TABLES


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        if "://" not in root and not Path(root).is_dir():
            raise FileNotFoundError(root)
        self.spark, self.root = spark, root
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}.parquet")
            there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
            self._tables[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet") if there else self.spark.createDataFrame([], TABLES[name])
        return self._tables[name]

    def register_views(self) -> None:
        """Every table as a temporary view, for SQL."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)
