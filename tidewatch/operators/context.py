"""Product, call-center and traffic context for the prompts and the dashboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.functions import fixed_values as fv
from tidewatch.operators.profile import last_n_months, latest_period
from tidewatch.operators.ranking import numbered
from tidewatch.spec import ContextSpec

SEPARATOR = "·"


def rental_trend(rental: DataFrame, context: ContextSpec) -> DataFrame:
    """Openings, mean amount and mean conversion per category pair over the last months, ranked by openings.

    The rank is a global order over one row per category pair, numbered range by range.
    """
    order = [("total_open", True), ("rental_main_category", False), ("rental_sub_category", False)]
    totals = (
        last_n_months(rental, "ts", context.window_months)
        .where(
            (F.col("rental_sub_category") != context.rental_sub_placeholder)
            & (F.col("rental_main_category") != context.rental_main_placeholder)
        )
        .groupBy("rental_main_category", "rental_sub_category")
        .agg(
            F.sum("open_count").alias("total_open"),
            X.exact_mean(F.col("avg_policy_amount")).alias("avg_policy_amt"),
            X.half_up(X.exact_mean(F.col("open_cvr")), 1).alias("avg_cvr_pct"),
        )
    )
    return numbered(totals, order, "rank_num")


def top_rentals(trend: DataFrame, n: int = 5) -> DataFrame:
    return trend.where(F.col("rank_num") <= n).orderBy("rank_num")


def top_rentals_text(trend: DataFrame, context: ContextSpec) -> DataFrame:
    """Names of the best-ranked products in one row and one text; null when there is none."""
    listed = f"listagg(rental_sub_category, '{SEPARATOR}') WITHIN GROUP (ORDER BY rank_num)"
    return trend.where(F.col("rank_num") <= context.top_rentals).agg(F.expr(listed).alias("rental_products"))


def call_center_context(calls: DataFrame, conversion: DataFrame, context: ContextSpec) -> DataFrame:
    """Calls of one division with their conversion figures, per month and category.

    The tables are matched on month, category and division, and a repeated conversion row counts the calls it matches
    once more. The division is fixed, so each group is one key of that match: both sides are summed first instead of
    emitting every pair of a group. The calls are multiplied by the rows they meet; a mean stays as it is, because all
    its rows are repeated alike.
    """
    keys = ["ts", "main_category_name"]
    here = F.col("division_name") == context.call_division

    def means(*columns: str) -> list[Column]:
        return [X.exact_mean(F.col(c)).alias(c) for c in columns]

    calls, conversion = calls.where(here), conversion.where(here)
    answered = calls.groupBy(*keys).agg(
        F.sum("call_count").alias("calls"), *means("connection_rate", "avg_bill_minute")
    )
    converted = conversion.groupBy(*keys).agg(
        F.count("*").alias("met"), *means("call_to_contract_cvr", "avg_leadtime_days")
    )
    return answered.join(converted, keys, "left").select(
        *keys,
        (F.col("calls") * F.coalesce("met", F.lit(1))).alias("total_calls"),
        F.col("connection_rate").alias("avg_connection_rate"),
        F.col("avg_bill_minute").alias("avg_call_minutes"),
        "call_to_contract_cvr",
        "avg_leadtime_days",
    )


def call_context_text(center: DataFrame, context: ContextSpec) -> DataFrame:
    """The busiest categories of the newest month as one text: name(connection%, conversion%)."""
    busiest = (
        latest_period(center, "ts")
        .where(F.col("main_category_name") != context.call_placeholder)
        .orderBy(F.col("total_calls").desc_nulls_last(), "main_category_name")
        .limit(context.top_calls)
    )
    item = F.concat(
        "main_category_name",
        F.lit("("),
        X.number_text(F.col("avg_connection_rate") * 100),
        F.lit("%연결·전환"),
        X.number_text(F.col("call_to_contract_cvr") * 100, 1),
        F.lit("%)"),
    )
    listed = f"listagg(item, '{SEPARATOR}') WITHIN GROUP (ORDER BY total_calls DESC, main_category_name)"
    return busiest.withColumn("item", item).agg(F.expr(listed).alias("call_context"))


def latest_call_rows(center: DataFrame, n: int = 30) -> DataFrame:
    """Newest call-center rows with rounded figures for display."""
    return (
        center.orderBy(F.col("ts").desc_nulls_last(), "main_category_name")
        .limit(n)
        .select(
            F.col("ts").cast("string").alias("ym"),
            "main_category_name",
            "total_calls",
            X.half_up(F.col("avg_connection_rate"), 1).alias("conn_rate"),
            X.half_up(F.col("call_to_contract_cvr"), 2).alias("call_cvr"),
            X.half_up(F.col("avg_leadtime_days"), 1).alias("lead_days"),
        )
    )


def call_cvr_rows(center: DataFrame, n: int = 30) -> DataFrame:
    """The newest call-center rows that have a conversion rate."""
    return latest_call_rows(center, n).na.drop(subset=["call_cvr"])


def rental_top10(trend: DataFrame, n: int = 10) -> DataFrame:
    return (
        trend.orderBy("rank_num")
        .limit(n)
        .select(
            "rental_main_category",
            "rental_sub_category",
            "total_open",
            X.half_up(F.col("avg_cvr_pct"), 1).alias("cvr_pct"),
            "rank_num",
        )
    )


def category_totals(rental: DataFrame, n: int = 20) -> DataFrame:
    """Openings per category pair over the whole history, largest first."""
    return (
        rental.groupBy("rental_main_category", "rental_sub_category")
        .agg(F.sum("open_count").alias("total_open"))
        .orderBy(F.col("total_open").desc_nulls_last(), "rental_main_category", "rental_sub_category")
        .limit(n)
    )


def traffic_snapshot(traffic: DataFrame, context: ContextSpec) -> DataFrame:
    """Mean speed, probes and a status per district for the newest month; roads are placed by name patterns."""
    place = reduce(
        lambda rest, pair: F.when(
            F.col("road_name").like(pair[0]) | F.col("node_name").like(pair[0]), pair[1]
        ).otherwise(rest),
        reversed(context.road_districts),
        F.lit(None).cast("string"),
    )
    slow, medium, fast = fv.TRAFFIC_STATUS
    speed = F.col("avg_speed_kmph")
    status = F.when(speed < context.slow_below, slow).when(speed < context.fast_from, medium)
    return (
        latest_period(traffic, "ts")
        .withColumn("sgg", place)
        .where(F.col("sgg").isNotNull())
        .groupBy("sgg", "ts")
        .agg(X.exact_mean(speed).alias("avg_speed_kmph"), F.sum("probe_count").alias("probe_count"))
        .withColumn("status", status.when(speed.isNotNull(), fast))
    )
