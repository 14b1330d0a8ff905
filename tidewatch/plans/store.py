"""Where a run keeps its tables."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder below the one the session names in spark.checkpoint.dir, which all executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    return f"{shared.rstrip('/')}/{name}"


class Store(Protocol):
    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame: ...

    def append(self, name: str, df: DataFrame) -> DataFrame: ...

    def read(self, name: str) -> DataFrame | None: ...


class PathStore:
    """Parquet directories under a base path that all executors can reach."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    @classmethod
    def shared(cls, spark: SparkSession, name: str) -> PathStore:
        return cls(spark, shared_folder(spark, name))

    def _path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, name, df, partition_by=()):
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(self._path(name))
        return self.spark.read.parquet(self._path(name))

    def append(self, name, df):
        df.write.mode("append").parquet(self._path(name))
        return self.spark.read.parquet(self._path(name))

    def read(self, name):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(self._path(name)) if there else None


class TableStore:
    """Catalog tables in a namespace, created when missing."""

    def __init__(self, spark: SparkSession, namespace: str):
        self.spark, self.namespace = spark, namespace
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {namespace}")

    def _table(self, name: str) -> str:
        return f"{self.namespace}.{name}"

    def write(self, name, df, partition_by=()):
        df.write.mode("overwrite").partitionBy(*partition_by).saveAsTable(self._table(name))
        return self.spark.table(self._table(name))

    def append(self, name, df):
        df.write.mode("append").saveAsTable(self._table(name))
        return self.spark.table(self._table(name))

    def read(self, name):
        return self.spark.table(self._table(name)) if self.spark.catalog.tableExists(self._table(name)) else None
