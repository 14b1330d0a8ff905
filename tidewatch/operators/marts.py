"""Summary tables and the reshaping behind the dashboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.functions import fixed_values as fv
from tidewatch.operators.series import filter_telecom
from tidewatch.spec import SignalSpec, SourceFilter

SCORES = ["combined_score", "price_score", "pop_score", "telecom_score", "card_score"]


# ---- marts over scores and alerts ----------------------------------------------------------------------------------


def signal_timeseries(scores: DataFrame) -> DataFrame:
    """Every score point of every signal."""
    return scores.select(
        F.col("series").alias("region_key"),
        "sgg",
        "emd",
        "ts",
        F.col("signal").alias("signal_type"),
        F.col("y").alias("actual_value"),
        F.col("forecast").alias("forecast_value"),
        "percentile",
        "is_anomaly",
    )


def sgg_summary(alerts: DataFrame, by_flags: bool = False) -> DataFrame:
    """Alert counts and scores per district.

    The per-signal counts go by the words in the label, and labels of several signals don't name them all; by_flags
    counts what is flagged.
    """
    label = F.col("alert_type")
    words = [
        F.count_if(F.col(f"{s}_is_anomaly") if by_flags else label.contains(w)).alias(f"{s}_alerts")
        for s, w in fv.LABEL_WORDS.items()
    ]
    return alerts.groupBy("sgg").agg(
        F.count("*").alias("total_alerts"),
        F.count_if(label == fv.QUAD_LABEL).alias("quad_alerts"),
        F.count_if(label == fv.TRIPLE_LABEL).alias("triple_alerts"),
        *words,
        X.half_up(F.max("combined_score"), 3).alias("max_score"),
        X.half_up(X.exact_mean(F.col("combined_score")), 3).alias("avg_score"),
    )


def telecom_trend(telecom: DataFrame, source: SourceFilter) -> DataFrame:
    """Contracts, openings, conversion and sales per month, district and category."""
    return (
        filter_telecom(telecom, source)
        .groupBy(F.col("ts").alias("year_month"), F.col("install_city").alias("sgg"), "main_category_name")
        .agg(
            F.sum("contract_count").alias("contracts"),
            F.sum("open_count").alias("opens"),
            X.half_up(X.exact_mean(F.col("open_cvr")), 1).alias("avg_cvr_pct"),
            X.exact_sum(F.col("total_net_sales")).cast("double").alias("net_sales"),
        )
    )


def sgg_summary_sorted(summary: DataFrame, n: int | None = None) -> DataFrame:
    """District summary, districts with most alerts first; the first n or all."""
    ordered = summary.orderBy(F.col("total_alerts").desc_nulls_last(), "sgg")
    return ordered if n is None else ordered.limit(n)


def telecom_trend_profile(trend: DataFrame) -> DataFrame:
    """Rows and districts of the telecom mart."""
    return trend.agg(F.count("*").alias("row_count"), F.countDistinct("sgg").alias("sgg_count"))


def top_alerts(alerts: DataFrame, n: int = 15) -> DataFrame:
    return (
        alerts.orderBy(F.col("combined_score").desc_nulls_last(), "sgg", "alert_date")
        .limit(n)
        .select("sgg", "alert_type", X.half_up(F.col("combined_score"), 3).alias("score"), "alert_date")
    )


def alert_type_counts(alerts: DataFrame) -> DataFrame:
    return (
        alerts.groupBy("alert_type").agg(F.count("*").alias("cnt")).orderBy(F.col("cnt").desc(), F.col("alert_type"))
    )


# ---- dashboard reads over the marketing alerts ---------------------------------------------------------------------


def alerts_mart(marketing: DataFrame) -> DataFrame:
    """The alert list a dashboard loads, best first."""
    return marketing.select(
        "sgg",
        "region_key",
        "district_code",
        F.col("alert_date").cast("string").alias("alert_date"),
        "alert_type",
        *[X.half_up(F.col(c), 3).alias(c) for c in SCORES],
        "dominant_age_group",
        "income_profile",
        "trending_rentals",
        "marketing_copy",
    ).orderBy(F.col("combined_score").desc_nulls_last(), "region_key", "alert_date")


def alerts_filtered(
    marketing: DataFrame, sgg: str | None = None, alert_type: str | None = None, score_min: float = 0.0
) -> DataFrame:
    """Alerts of a district and a label (None means all) from a score on."""
    picked = marketing.where(F.col("combined_score") >= score_min)
    if sgg is not None:
        picked = picked.where(F.col("sgg") == sgg)
    if alert_type is not None:
        picked = picked.where(F.col("alert_type") == alert_type)
    return picked


def alert_kpis(marketing: DataFrame) -> DataFrame:
    label = F.col("alert_type")
    return marketing.agg(
        F.count("*").alias("total_alerts"),
        F.count_if(label == fv.QUAD_LABEL).alias("quad_alerts"),
        F.max("combined_score").alias("max_score"),
        F.countDistinct("sgg").alias("districts"),
        F.count_if(F.coalesce(label.rlike(fv.TRIPLE_OR_MORE_PATTERN), F.lit(False))).alias("triple_or_more"),
    )


def top_regions(marketing: DataFrame, n: int = 25) -> DataFrame:
    """Best score per region, label and district; alerts without a label are left out."""
    return (
        marketing.where(F.col("alert_type").isNotNull())
        .groupBy(F.col("region_key").alias("region"), "alert_type", "sgg")
        .agg(F.max("combined_score").alias("combined_score"))
        .orderBy(F.col("combined_score").desc_nulls_last(), "region", "alert_type")
        .limit(n)
    )


def score_long(marketing: DataFrame) -> DataFrame:
    """The four signal scores as rows."""
    return marketing.unpivot("region_key", list(fv.SCORE_NAMES), "code", "score").select(
        "region_key", X.display_name(F.col("code"), fv.SCORE_NAMES).alias("signal"), "score"
    )


def score_distribution(marketing: DataFrame) -> DataFrame:
    """Box-plot figures per signal. Scores carry three digits, so the exact quantile keeps at most 1,001 values."""
    quartiles = F.percentile("score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        score_long(marketing)
        .groupBy("signal")
        .agg(F.min("score").alias("low"), quartiles.alias("q"), F.max("score").alias("high"))
        .select(
            "signal",
            "low",
            *[X.half_up(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3"))],
            "high",
        )
    )


def type_summary(marketing: DataFrame) -> DataFrame:
    """Mean scores per label."""
    means = [X.half_up(X.exact_mean(F.col(c)), 3).alias(c) for c in SCORES]
    return marketing.where(F.col("alert_type").isNotNull()).groupBy("alert_type").agg(*means)


def type_summary_long(summary: DataFrame) -> DataFrame:
    return summary.unpivot("alert_type", list(fv.SUMMARY_NAMES), "code", "mean_score").select(
        "alert_type", X.display_name(F.col("code"), fv.SUMMARY_NAMES).alias("signal"), "mean_score"
    )


def signal_heatmap(summary: DataFrame) -> DataFrame:
    """Alerts per district and signal as rows, districts with most alerts first."""
    total = F.sum("alert_count").over(Window.partitionBy("sgg"))
    return (
        summary.unpivot("sgg", list(fv.ALERT_COUNT_NAMES), "code", "alert_count")
        .select(
            "sgg",
            X.display_name(F.col("code"), fv.ALERT_COUNT_NAMES).alias("signal"),
            "alert_count",
            total.alias("district_total"),
        )
        .orderBy(F.col("district_total").desc(), "sgg", "signal")
    )


def alert_list(marketing: DataFrame) -> DataFrame:
    """The alert list with display column names."""
    with_month = marketing.withColumn("ym", X.month_text(F.col("alert_date")))
    return with_month.select(*[F.col(c).alias(name) for c, name in fv.ALERT_LIST_NAMES.items()])


def alert_detail(marketing: DataFrame, region_key: str, alert_date) -> DataFrame:
    """One alert by key, with a title line and placeholder texts for what is missing."""
    def text(c, missing=fv.MISSING_TEXT):
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(missing)).alias(c)

    title = F.format_string(
        "%s  %s  (%s)  [%s]",
        F.col("region_key"),
        X.month_text(F.col("alert_date")),
        F.col("combined_score").cast("decimal(10,3)").cast("string"),
        F.col("alert_type"),
    )
    return marketing.where((F.col("region_key") == region_key) & (F.col("alert_date") == alert_date)).select(
        F.translate("region_key", "_", " ").alias("region"),
        title.alias("title"),
        text("alert_type"),
        *SCORES,
        text("dominant_age_group"),
        text("income_profile"),
        text("trending_rentals"),
        text("marketing_copy", fv.MISSING_COPY_TEXT),
    )


def labels_present(marketing: DataFrame) -> DataFrame:
    """Labels that occur, in display order."""
    ordinal = X.label_ordinal(F.col("alert_type"))
    return (
        marketing.select("alert_type").distinct().select(ordinal.alias("ordinal"), "alert_type").na.drop()
    ).orderBy("ordinal")


def alerts_by_label(marketing: DataFrame, alert_type: str | None = None) -> DataFrame:
    """Texts of one label (or of all, label by label), best first."""
    picked = alerts_filtered(marketing, alert_type=alert_type)
    return (
        picked.select(
            X.label_ordinal(F.col("alert_type")).alias("ordinal"),
            "alert_type",
            F.col("region_key").alias("region"),
            X.month_text(F.col("alert_date")).alias("ym"),
            "combined_score",
            F.coalesce("marketing_copy", F.lit(fv.MISSING_COPY_TEXT)).alias("marketing_copy"),
        )
    ).orderBy("ordinal", F.col("combined_score").desc_nulls_last(), "region", "ym")


def filter_options(marketing: DataFrame) -> DataFrame:
    """Sorted distinct values of the filter lists, in one pass: list name and value."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("option_list"), F.col(c).alias("value"))
            for name, c in (("district", "sgg"), ("label", "alert_type"), ("region", "region_key"))
        ]
    )
    return (
        marketing.select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy("option_list", "value")
    )


def copy_preview(marketing: DataFrame, length: int = 80) -> DataFrame:
    return marketing.select(
        "sgg",
        "alert_type",
        X.half_up(F.col("combined_score"), 2).alias("score"),
        "dominant_age_group",
        "trending_rentals",
        F.left("marketing_copy", F.lit(length)).alias("copy_preview"),
    ).orderBy(F.col("score").desc_nulls_last(), "sgg")


# ---- parameterised reads -------------------------------------------------------------------------------------------


def signal_lookup(
    timeseries: DataFrame, region_key: str, signal_type: str | None = None, signals: Sequence[SignalSpec] = ()
) -> DataFrame:
    """Score points of one region with the lines of its signal's band, oldest first.

    The key filter reaches the scan of the stored table.
    """
    high, low = F.lit(fv.BAND_HIGH), F.lit(fv.BAND_LOW)
    for s in signals:
        here = F.col("signal_type") == s.name
        high, low = F.when(here, F.lit(s.high)).otherwise(high), F.when(here, F.lit(s.low)).otherwise(low)
    picked = timeseries.where(F.col("region_key") == region_key)
    if signal_type is not None:
        picked = picked.where(F.col("signal_type") == signal_type)
    return picked.select(
        "signal_type",
        X.display_name(F.col("signal_type"), fv.SIGNAL_TITLES).alias("signal_title"),
        "ts",
        "actual_value",
        "forecast_value",
        "percentile",
        "is_anomaly",
        high.alias("high_line"),
        low.alias("low_line"),
    ).orderBy("ts", "signal_type")


def signal_chart(lookup: DataFrame) -> DataFrame:
    """Points of a lookup with their month as a time, for a time axis."""
    return lookup.withColumn("ts", X.to_datetime(F.col("ts")))


def signal_lookup_district(timeseries: DataFrame, sgg: str) -> DataFrame:
    """All signals of a district: sub-district points are averaged, so a price line is shown too."""
    return (
        timeseries.where(F.col("sgg") == sgg)
        .groupBy("signal_type", "ts")
        .agg(
            X.exact_mean(F.col("actual_value")).alias("actual_value"),
            X.exact_mean(F.col("forecast_value")).alias("forecast_value"),
            X.exact_mean(F.col("percentile")).alias("percentile"),
            F.bool_or("is_anomaly").alias("is_anomaly"),
        )
        .orderBy("ts", "signal_type")
    )


def telecom_lookup(trend: DataFrame, sgg: str) -> DataFrame:
    return (
        trend.where(F.col("sgg") == sgg)
        .select(F.col("year_month").cast("string").alias("ym"), "main_category_name", "opens", "contracts")
        .orderBy("ym", "main_category_name")
    )

