"""Choosing the alerts worth a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.spec import SelectionSpec


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of every group in the given order, which must end in a unique column.

    Spark keeps only the best ``k`` of each group in every task before it shuffles, so a group with a large share of
    all rows costs no more than a small one.
    """
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def best_first() -> list[Column]:
    return [F.col("combined_score").desc_nulls_last(), F.col("alert_date"), F.col("region_key")]


def dedup_best(alerts: DataFrame, selection: SelectionSpec) -> DataFrame:
    """Best alert per region above the score floor."""
    above = alerts.where(F.col("combined_score") > selection.score_floor)
    return top_k_per_group(above, ["region_key"], best_first(), 1)


def alert_candidates(alerts: DataFrame, selection: SelectionSpec) -> DataFrame:
    """Best alert per region, at most so many per district."""
    return top_k_per_group(dedup_best(alerts, selection), ["sgg"], best_first(), selection.per_district)
