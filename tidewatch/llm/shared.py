"""What several operators need: tables in the shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that are Python strings at the same time, unless a column asks for more.
PORTION = 256


class Scratch:
    """Intermediate tables as Parquet below spark.checkpoint.dir, where a written table ends the lineage.

    The setting is read from the session. Only a session on this one machine may do without it; it gets a temporary folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            master = spark.conf.get("spark.master", "")
            if master != "local" and not master.startswith("local["):
                raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
            folder = f"file://{tempfile.mkdtemp(prefix='tidewatch-')}"
        self.base = f"{folder.rstrip('/')}/tidewatch-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        """The rows of df, written once and read from the written table; columns that part it come last in df."""
        path = f"{self.base}/{name}"
        df.write.partitionBy(*partition_by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """In the block, a query's shuffle files go when it ends: what it wrote is read from then on, and never made again."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def over_texts(
    text: Column, result: str, kind: pa.DataType, start: Callable[[], Callable[[list], list]], portion: int = PORTION
) -> Column:
    """A column computed from a text column, a portion of texts at a time.

    start is called once in each task and gives a function from a list of texts (or nulls) to a list of results, of the
    SQL type result and the Arrow type kind. A batch stays in Arrow's form; only a portion of it becomes Python strings.
    The column counts as nondeterministic, so that Spark doesn't compute it again for a filter on it.
    """

    @F.arrow_udf(result)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of_texts = start()
        for batch in batches:
            parts = (of_texts(batch.slice(at, portion).to_pylist()) for at in range(0, len(batch), portion))
            yield pa.array([x for part in parts for x in part], type=kind)
            pa.default_memory_pool().release_unused()  # a worker lives on between tasks and stages

    return run.asNondeterministic()(text)


def hex64(number):
    """A 64-bit number as 16 lowercase hex digits; a negative one by its two's complement."""
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_roots(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """Connected components of undirected edges (a, b), both long: (node, root), root being the smallest node reachable.

    Large-star and small-star steps in turn (Kiveris et al., 2014): each hangs the neighbours of a node on the smallest of
    them, and the number of rounds grows with the logarithm of a component's size. A round groups before it joins, so a
    hot node sends one row per task into the grouping, and the join on it can be split by adaptive execution. Only a row
    count and a checksum come to the driver. Nodes without an edge to another node are not returned; null ends are left
    out.
    """
    current = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{name}-0",
    )
    before, rounds = _checksum(current), 0
    while before[0]:
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(smallest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.keep(large, f"{name}-large-{rounds}")
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(parent, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        rounds += 1
        current = scratch.keep(moved.unionAll(parent.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{rounds}")
        after = _checksum(current)
        scratch.drop(f"{name}-{rounds - 1}")
        scratch.drop(f"{name}-large-{rounds - 1}")
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _checksum(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mixed)).first())
