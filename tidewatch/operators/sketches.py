"""Profiles and histories as mergeable sketches, beside the exact ones.

A sketch has a bounded size, and sketches of parts merge into the sketch of the whole. So a table keeps one per month, and
figures over any range of dates come from those rows alone. Counts, least and greatest values are exact. The number of
different values is within about 1.04 / sqrt(2^LG) of the truth (1.6 %, one deviation), and exact for a few hundred. The
rank of a value, or of a quantile, is within RANK_ERROR of the truth with 99 % confidence, and exact while a sketch has
seen no more than K values.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.operators import detect
from tidewatch.spec import DetectorSpec

#: Size of a distinct-count sketch (a power of two), values that a quantile sketch holds exactly, its rank error.
LG, K, RANK_ERROR = 12, 200, 0.0133
#: Ranks read off a history; five for each value of a full exact sketch, so that whole months come out exactly.
MARKS = 5 * K


def _between(rows: DataFrame, first: dt.date | None, last: dt.date | None, column: str) -> DataFrame:
    if first is not None:
        rows = rows.where(F.col(column) >= F.lit(first))
    return rows if last is None else rows.where(F.col(column) <= F.lit(last))


def profile_sketches(series: DataFrame) -> DataFrame:
    """Rows and regions of every train and detect table by month: what :func:`profile_of` merges."""
    split = F.when(F.col("is_train"), "train").otherwise("detect")
    late = F.when(F.col("cut_group") == "late", "_late").otherwise("")
    return series.groupBy(F.concat("signal", F.lit("_"), split, late).alias("tbl"), "ts").agg(
        F.count("*").alias("row_count"), F.hll_sketch_agg("series", LG).alias("regions")
    )


def profile_of(sketches: DataFrame, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """Rows and estimated regions of every table over the months from first to last."""
    return (
        _between(sketches, first, last, "ts")
        .groupBy("tbl")
        .agg(
            F.sum("row_count").alias("row_count"),
            F.hll_sketch_estimate(F.hll_union_agg("regions")).alias("regions"),
        )
    )


def value_sketches(rows: DataFrame, keys: Sequence[str], value: str, k: int = K) -> DataFrame:
    """Count, least and greatest value and a quantile sketch for each key; the keys should hold the month."""
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"),
    )


def merged_values(sketches: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """Sketches with one for each of the keys, which may be fewer."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"),
    )


def distribution_of(sketches: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """Box-plot figures of each key: a quartile is the least value that at least its share of the values doesn't pass."""

    def quartile(q: float) -> Column:
        return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q)))

    marks = [quartile(q).alias(name) for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    return merged_values(sketches, keys, k).select(*keys, "low", *marks, "high")


def fit_history(series: DataFrame, k: int = K) -> DataFrame:
    """Model table of bounded size: a sketch of each series' training values in place of the values."""
    usable = F.col("is_train") & F.col("y").isNotNull()
    return (
        series.where(usable)
        .groupBy(*detect.KEYS)
        .agg(
            F.first("sgg").alias("sgg"),
            F.first("emd").alias("emd"),
            F.count("*").alias("n_train"),
            X.exact_sum(F.col("y")).alias("total"),
            F.max("ts").alias("last_ts"),
            F.kll_sketch_agg_double("y", F.lit(k)).alias("history"),
        )
    )


def merged_history(models: DataFrame, k: int = K) -> DataFrame:
    """Models of separate parts of the training period as one."""
    return models.groupBy(*detect.KEYS).agg(
        F.first("sgg").alias("sgg"),
        F.first("emd").alias("emd"),
        F.sum("n_train").alias("n_train"),
        F.sum("total").cast(models.schema["total"].dataType).alias("total"),
        F.max("last_ts").alias("last_ts"),
        F.kll_merge_agg_double("history", F.lit(k)).alias("history"),
    )


def score_with_history(observations: DataFrame, model: DataFrame, spec: DetectorSpec = DetectorSpec()) -> DataFrame:
    """Mid-rank scores from sketched histories: those of the full history while it has at most K months.

    A sketch answers which value has a given rank. The values at MARKS ranks are read off it once for each series, and the
    place of a new value among them, as a whole number of months, is its rank.
    """
    ranks = F.array(*[F.lit((i + 0.5) / MARKS) for i in range(MARKS)])
    marked = model.withColumn("marks", F.kll_sketch_get_quantile_double("history", ranks))
    joined = observations.select(*detect.KEYS, "ts", "y").join(marked, list(detect.KEYS))
    y, n = F.col("y"), F.col("n_train")

    def months(marks: Column) -> Column:
        return F.round(F.size(marks) * n / F.lit(MARKS))

    below = months(F.filter("marks", lambda v: v < y))
    equal = months(F.filter("marks", lambda v: v == y))
    scored = joined.where(F.col("ts") > F.col("last_ts")).withColumns(
        {
            "is_train": F.lit(False),
            "forecast": F.col("total").cast("double") / F.nullif(n, F.lit(0)),
            "percentile": F.when(y.isNotNull(), (below + equal * F.lit(0.5)) / F.nullif(n, F.lit(0))),
        }
    )
    return detect.finished(scored, spec)
