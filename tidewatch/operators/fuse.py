"""Fusing the scores of all signals into one alert row per district and month."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.spec import Settings, SignalSpec


def signal_flags(scores: DataFrame, settings: Settings) -> DataFrame:
    """Band flag and direction of every single score."""
    flagged = F.lit(None).cast("boolean")
    direction = F.lit(None).cast("string")
    for s in settings.signals:
        here = F.col("signal") == s.name
        p = F.col("percentile")
        flagged = F.when(here, X.outside_band(p, s.low, s.high)).otherwise(flagged)
        direction = F.when(here & (p > s.high), "up").when(here & (p < s.low), "down").otherwise(direction)
    return scores.select(
        "signal", "series", "sgg", "ts", "percentile", flagged.alias("flagged"), direction.alias("direction")
    )


def price_rollup(scores: DataFrame, settings: Settings, signal: str = "price") -> DataFrame:
    """District view of a sub-district signal: mean place, mean values, flagged when any sub-district is."""
    s = settings.signal(signal)
    outside = X.outside_band(F.col("percentile"), s.low, s.high)
    return (
        scores.where(F.col("signal") == signal)
        .groupBy("sgg", "ts")
        .agg(
            X.exact_mean(F.col("percentile")).alias("percentile"),
            X.exact_mean(F.col("y")).alias("actual"),
            X.exact_mean(F.col("forecast")).alias("forecast"),
            F.coalesce(_any_flagged(outside, settings.flag_share), F.lit(False)).alias("is_anomaly"),
        )
    )


def _signal_columns(s: SignalSpec) -> list[Column]:
    names = ("percentile", "actual", "forecast")
    if s.grain == "emd":
        return [F.col(f"{s.name}_{n}") for n in (*names, "any")]
    fields = ("percentile", "y", "forecast")
    return [F.col(f"{s.name}_score.{f}").alias(f"{s.name}_{n}") for f, n in zip(fields, names, strict=True)]


def _any_flagged(outside: Column, share: float | None) -> Column:
    """Whether any, or at least a share of, the scores is outside the band; null when there is none."""
    if share is None:
        return F.bool_or(outside)
    return F.nullif(F.count(outside), F.lit(0)) * share <= F.count_if(outside)


def _signal_aggregates(s: SignalSpec, share: float | None) -> list[Column]:
    here = F.col("signal") == s.name
    percentile, actual, forecast = (F.when(here, F.col(c)) for c in ("percentile", "y", "forecast"))
    if s.grain == "emd":
        return [
            X.exact_mean(percentile).alias(f"{s.name}_percentile"),
            X.exact_mean(actual).alias(f"{s.name}_actual"),
            X.exact_mean(forecast).alias(f"{s.name}_forecast"),
            _any_flagged(X.outside_band(percentile, s.low, s.high), share).alias(f"{s.name}_any"),
        ]
    # One score per district and month. Should there be more, all values are those of the highest.
    return [F.max(F.when(here, F.struct("percentile", "y", "forecast"))).alias(f"{s.name}_score")]


def signals_joined(scores: DataFrame, settings: Settings) -> DataFrame:
    """All signals side by side for every district and month the driving signal has a score for.

    The scores are one long frame, so a conditional aggregation does the work of a chain of left joins in a single
    shuffle with map-side combine.

    A join matches no null key, so only the driving signal keeps scores without a district or month.
    """
    aggregates = [c for s in settings.signals for c in _signal_aggregates(s, settings.flag_share)]
    is_driver = F.col("signal") == settings.driver
    keyed = scores.where(is_driver | (F.col("sgg").isNotNull() & F.col("ts").isNotNull()))
    wide = keyed.groupBy("sgg", "ts").agg(*aggregates, F.bool_or(is_driver).alias("has_driver"))
    columns = [c for s in settings.signals for c in _signal_columns(s)]
    return wide.where("has_driver").select("sgg", "ts", *columns)


def scored_regions(joined: DataFrame, settings: Settings) -> DataFrame:
    """Neutral values, flags, the part of each signal and the combined score."""
    out = [F.col("sgg").alias("region_key"), F.col("sgg"), F.lit(None).cast("string").alias("emd")]
    out.append(F.col("ts").alias("alert_date"))
    parts = []
    for s in settings.signals:
        raw = F.col(f"{s.name}_percentile")
        filled = X.with_neutral(raw, s)
        if s.grain == "emd":
            flag = F.coalesce(F.col(f"{s.name}_any"), F.lit(False))
        else:
            flag = X.outside_band(filled, s.low, s.high)
        part = X.score_part(raw, s)
        parts.append(part)
        out += [
            filled.alias(f"{s.name}_percentile"),
            F.col(f"{s.name}_actual"),
            F.col(f"{s.name}_forecast"),
            flag.alias(f"{s.name}_is_anomaly"),
            part.alias(f"{s.name}_part"),
        ]
    out.append(reduce(lambda a, b: a + b, parts).alias("combined_score"))
    return joined.select(*out)


def _flags(settings: Settings) -> list[Column]:
    return [F.col(f"{s.name}_is_anomaly") for s in settings.signals]


def labelled(regions: DataFrame, settings: Settings) -> DataFrame:
    """Flag mask and alert label of every district and month."""
    names = [s.name for s in settings.signals]
    return regions.withColumn("flag_mask", X.flag_mask(_flags(settings))).withColumn(
        "alert_type", X.alert_label(F.col("flag_mask"), names)
    )


def alert_rows(scores: DataFrame, settings: Settings) -> DataFrame:
    """Districts and months with at least one flagged signal, with score and label."""
    regions = scored_regions(signals_joined(scores, settings), settings)
    alerts = labelled(regions.where(reduce(lambda a, b: a | b, _flags(settings))), settings)
    per_signal = [
        f"{s.name}_{c}" for s in settings.signals for c in ("percentile", "actual", "forecast", "is_anomaly")
    ]
    return alerts.select("region_key", "sgg", "emd", "alert_date", *per_signal, "combined_score", "alert_type")


def enriched(alerts: DataFrame, geometry: DataFrame, profile: DataFrame) -> DataFrame:
    """Alerts with district code, geometry and customer profile; districts without them keep their alerts."""
    return (
        alerts.join(geometry, "sgg", "left")
        .join(profile, "sgg", "left")
        .select(
            *[alerts[c] for c in alerts.columns if c != "alert_type"],
            "district_code",
            "district_geom",
            "dominant_age_group",
            "income_profile",
            "alert_type",
        )
    )


def region_alerts(scores: DataFrame, geometry: DataFrame, profile: DataFrame, settings: Settings) -> DataFrame:
    """The complete alert table."""
    return enriched(alert_rows(scores, settings), geometry, profile)


def scores_from_results(results: DataFrame, signal: str, settings: Settings) -> DataFrame:
    """Score rows from a result table that has only the series key: the key is taken apart at the delimiter."""
    parts = settings.signal(signal).grain == "emd"

    def part(n: int) -> Column:
        return F.split_part("series", F.lit(settings.key_delimiter), F.lit(n))

    return results.select(
        F.lit(signal).alias("signal"),
        "series",
        (part(1) if parts else F.col("series")).alias("sgg"),
        (part(2) if parts else F.lit(None).cast("string")).alias("emd"),
        "ts",
        "y",
        "forecast",
        "percentile",
        "is_anomaly",
    )
