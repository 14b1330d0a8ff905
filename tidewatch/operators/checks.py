"""Counts and expectations that tell whether a run went well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.operators.series import filter_price
from tidewatch.spec import Settings


def table_profile(series: DataFrame) -> DataFrame:
    """Rows and regions of every train and detect table, in one pass over the long frame."""
    split = F.when(F.col("is_train"), "train").otherwise("detect")
    late = F.when(F.col("cut_group") == "late", "_late").otherwise("")
    return (
        series.groupBy("signal", "series", "cut_group", "is_train")
        .agg(F.count("*").alias("n"))
        .groupBy(F.concat("signal", F.lit("_"), split, late).alias("tbl"))
        .agg(F.sum("n").alias("row_count"), F.count("series").alias("regions"))
    )


def score_validation(scores: DataFrame) -> DataFrame:
    """Score count, flag count and range per signal."""
    return scores.groupBy("signal").agg(
        F.count("*").alias("total"),
        F.count_if("is_anomaly").alias("is_anomaly_true"),
        F.min("percentile").alias("min_pct"),
        F.max("percentile").alias("max_pct"),
    )


def score_range(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count("*").alias("total"),
        F.min("combined_score").alias("min_score"),
        F.max("combined_score").alias("max_score"),
    )


def profile_coverage(profile: DataFrame) -> DataFrame:
    return profile.agg(F.count("*").alias("total_districts"), F.countDistinct("sgg").alias("sgg_count"))


def distinct_values(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    values = df.select(F.col(column).alias("value")).distinct().orderBy(F.col("value").asc_nulls_last())
    return values if n is None else values.limit(n)


def coverage_by_city(telecom: DataFrame, n: int = 50) -> DataFrame:
    """Date range and rows per state and city, largest first within a state."""
    return (
        telecom.groupBy("install_state", "install_city")
        .agg(F.min("ts").alias("min_ym"), F.max("ts").alias("max_ym"), F.count("*").alias("cnt"))
        .orderBy(F.col("install_state").asc_nulls_last(), F.col("cnt").desc(), "install_city")
        .limit(n)
    )


def date_range(price: DataFrame, districts: list[str]) -> DataFrame:
    """Rows, first and last date of some districts."""
    return price.where(F.col("sgg").isin(*districts)).agg(
        F.count("*").alias("row_count"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts")
    )


def keys_of(pairs: list[tuple[str, DataFrame, Column, DataFrame, Column]]) -> DataFrame:
    """Every key of each pair of sources, and which of them has it: one scan of each side and one grouping."""

    def side(pair: str, df: DataFrame, key: Column, left: bool) -> DataFrame:
        return df.select(F.lit(pair).alias("pair"), key.cast("string").alias("key"), F.lit(left).alias("left"))

    frames = [f for pair, a, ka, b, kb in pairs for f in (side(pair, a, ka, True), side(pair, b, kb, False))]
    return (
        reduce(DataFrame.unionAll, frames)
        .where(F.col("key").isNotNull())
        .groupBy("pair", "key")
        .agg(F.bool_or("left").alias("in_left"), F.bool_or(~F.col("left")).alias("in_right"))
    )


def key_reconciliation(pairs: list[tuple[str, DataFrame, Column, DataFrame, Column]]) -> DataFrame:
    """Keys of two sources compared: how many are in both, only left, only right."""
    return keys_of(pairs).groupBy("pair").agg(
        F.count_if(F.col("in_left") & F.col("in_right")).alias("in_both"),
        F.count_if(~F.col("in_right")).alias("left_only"),
        F.count_if(~F.col("in_left")).alias("right_only"),
    )


def key_mismatches(left: DataFrame, left_key: Column, right: DataFrame, right_key: Column) -> DataFrame:
    """Keys that only one of two sources has, with the side that has them."""
    keyed = keys_of([("", left, left_key, right, right_key)])
    side = F.when(~F.col("in_right"), "left").when(~F.col("in_left"), "right")
    return keyed.select("key", side.alias("side")).where(F.col("side").isNotNull())


def expectations(profile: DataFrame, validation: DataFrame, max_regions: int = 25) -> DataFrame:
    """The expectations of a good run as rows: name and whether it holds."""

    def expected(text: str, holds: Column) -> Column:
        return F.struct(F.concat(F.lit(text), "tbl").alias("expectation"), holds.alias("holds"))

    # Both rows of a table come from one read of its profile.
    rows = expected("rows in ", F.col("row_count") > 0)
    regions = expected("regions of ", F.col("regions") <= max_regions)
    both = F.when(F.col("tbl").startswith("telecom"), F.array(rows, regions)).otherwise(F.array(rows))
    tables = profile.select(F.inline(both))
    scores = validation.select(
        F.concat(F.lit("percentiles of "), "signal").alias("expectation"),
        ((F.col("total") > 0) & (F.col("min_pct") >= 0) & (F.col("max_pct") <= 1)).alias("holds"),
    )
    return tables.unionAll(scores)


def group_split(price: DataFrame, settings: Settings) -> DataFrame:
    """Rows per district and cut-off group; a null district is in no group."""
    group = X.cutoff_group(F.col("sgg"), settings.signal("price").cutoff)
    return (
        filter_price(price, settings.source)
        .withColumn("cut_group", group)
        .where(F.col("cut_group").isNotNull())
        .groupBy("cut_group", "sgg")
        .agg(F.count("*").alias("row_count"))
    )
