"""Loading sources and listing what a catalog holds."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.schemas import SOURCES, conform

Sources = Mapping[str, DataFrame]


@runtime_checkable
class JointSources(Protocol):
    """Sources of which some are measures of the same rows."""

    def joint(self, *names: str) -> DataFrame | None:
        """Rows that hold the measures of all the named sources, or None if they don't share their rows."""
        ...


def load_sources(spark: SparkSession, locations: Mapping[str, str], file_format: str = "parquet") -> dict[str, DataFrame]:
    """Read the sources named in ``locations``: a path (with a slash) or a catalog table name."""
    unknown = set(locations) - set(SOURCES)
    if unknown:
        raise ValueError(f"unknown sources {sorted(unknown)}")
    loaded = {}
    for name, where in locations.items():
        raw = spark.read.format(file_format).load(where) if "/" in where else spark.table(where)
        loaded[name] = conform(raw, name)
    return loaded


def list_tables(spark: SparkSession, namespace: str, pattern: str | None = None) -> list[str]:
    """Names of the tables and views of a namespace."""
    return sorted(t.name for t in spark.catalog.listTables(namespace, pattern))


def describe(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types."""
    return df.dtypes


def sample_scan(df: DataFrame, n: int, where=None, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows, optionally filtered; with ``order_by`` the rows are the same on every run."""
    picked = df if where is None else df.where(where)
    if order_by:
        picked = picked.orderBy(*[F.col(c).asc_nulls_last() for c in order_by])
    return picked.limit(n)
