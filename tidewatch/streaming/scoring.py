"""Scoring of values as they arrive, against the model table a batch run has stored.

The batch result is the definition: a day is scored once the watermark has passed it, with the figures
:func:`tidewatch.operators.detect.score_with_model` gives for the same day. State is one running sum per series and
open day; the model is a static side of the join, read again when the query starts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions import exprs as X
from tidewatch.operators import detect
from tidewatch.plans.store import shared_folder
from tidewatch.spec import DetectorSpec, SignalSpec


def daily_totals(arrivals: DataFrame, delay: str = "1 day") -> DataFrame:
    """Sum per series and day of ``signal, series, event_time, value`` rows; works on streams and on tables."""
    return (
        arrivals.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", "1 day").alias("day"), "signal", "series")
        .agg(X.exact_sum(F.col("value")).cast("double").alias("y"))
        .select("signal", "series", F.to_date("day.start").alias("ts"), "y")
    )


def score_arrivals(
    arrivals: DataFrame,
    model: DataFrame,
    spec: DetectorSpec = DetectorSpec(),
    delay: str = "1 day",
    signals: Sequence[SignalSpec] = (),
) -> DataFrame:
    """Scores with the band flag of every closed day of a series the model knows.

    Days are compared with days only: a model of months is an error. A signal's own band is used where it is given.
    """
    if not model.where("grain <> 'day'").isEmpty():
        raise ValueError("arrivals are summed by day: fit the model on daily values, not on months")
    scored = detect.score_with_model(daily_totals(arrivals, delay), model, spec)
    percentile = F.col("percentile")
    flagged = X.outside_band(percentile)
    for s in signals:
        flagged = F.when(F.col("signal") == s.name, X.outside_band(percentile, s.low, s.high)).otherwise(flagged)
    return scored.withColumn("flagged", flagged)


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """Place for the progress of a query."""
    return shared_folder(spark, name)


def write_available(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived so far to a parquet directory and stop; the next call goes on from there."""
    return (
        scored.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
