"""A place in a global order for every row, without bringing all rows into one task.

Rows are dealt into ranges of the order by split points, each range is numbered in a task of its own, and a range's numbers
start behind the rows of the ranges before it. The split points are taken from a sample that is the same whenever it is
drawn, the rows with the least hashes, so parts of a plan that are computed again agree with each other. Equal rows can't
be told apart and share a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges, and sampled rows for each: a range holds its share of the rows within some tenths.
RANGES, SAMPLED = 64, 64


def _key(order: Sequence[tuple[str, bool]]) -> Column:
    """A struct that compares like the order, nulls last. Descending columns have to be numbers."""
    fields = []
    for i, (name, descending) in enumerate(order):
        value = -F.col(name).cast("decimal(38,6)") if descending else F.col(name)
        fields += [F.col(name).isNull().alias(f"absent_{i}"), value.alias(f"value_{i}")]
    return F.struct(*fields)


def _dealt(df: DataFrame, order: Sequence[tuple[str, bool]], ranges: int, sampled: int) -> DataFrame:
    """df with its key and the range of the order that it falls into."""
    if ranges < 2:
        raise ValueError("at least two ranges are needed")
    keyed = df.withColumn("__key", _key(order))
    sample = (
        keyed.select("__key", F.xxhash64("__key").alias("__hash"))
        .orderBy("__hash", "__key")
        .limit(ranges * sampled)
        .agg(F.array_sort(F.collect_list("__key")).alias("keys"))
    )
    step = F.size("keys") / F.lit(ranges)
    places = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.floor(i * step).cast("int"))
    points = sample.select(
        F.when(F.size("keys") > 0, F.array_distinct(F.transform(places, lambda i: F.get("keys", i))))
    ).scalar()
    split = F.size(F.filter("__points", lambda p: p <= F.col("__key")))
    return keyed.withColumn("__points", points).withColumn("__range", split).drop("__points")


def range_sizes(df: DataFrame, order: Sequence[tuple[str, bool]], ranges: int = RANGES, sampled: int = SAMPLED) -> DataFrame:
    """Rows of each range, to judge how even the split points are."""
    return _dealt(df, order, ranges, sampled).groupBy(F.col("__range").alias("range")).agg(F.count("*").alias("n"))


def numbered(
    df: DataFrame, order: Sequence[tuple[str, bool]], name: str, ranges: int = RANGES, sampled: int = SAMPLED
) -> DataFrame:
    """df with its rows numbered from 1 in a global order: ``order`` lists columns and whether they descend, nulls last.

    Descending columns are whole numbers or decimals of up to six places. Rows that the order doesn't tell apart get
    neighbouring numbers in no stated order, as with ``row_number``; an order should tell most rows apart, since equal ones
    can't be split. Besides the rows, which are shuffled once, there move only the sample and one count for each range.
    """
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {name}")
    dealt = _dealt(df, order, ranges, sampled)
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    later = F.sequence(F.col("__range") + 1, F.lit(ranges)).alias("__range")
    before = (
        counts.where(F.col("__range") < ranges)
        .select(F.explode(later).alias("__range"), "__n")
        .groupBy("__range")
        .agg(F.sum("__n").alias("__before"))
    )
    within = F.row_number().over(Window.partitionBy("__range").orderBy("__key"))
    return (
        dealt.withColumn("__within", within)
        .join(before, "__range", "left")
        .withColumn(name, F.coalesce("__before", F.lit(0)) + F.col("__within"))
        .drop("__key", "__range", "__within", "__before")
    )
