"""The stream gives the batch scores of every closed day, also when it is stopped and started again."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidewatch.operators import detect
from tidewatch.plans.store import PathStore
from tidewatch.spec import DetectorSpec
from tidewatch.streaming import scoring

CUT = dt.date(2024, 1, 21)
SPEC = DetectorSpec(min_points=5)


@pytest.fixture
def arrivals(spark):
    return spark.read.parquet(f"{SF}/events.parquet").select(
        F.lit("events").alias("signal"),
        F.col("event_type").alias("series"),
        F.col("ts").cast("timestamp").alias("event_time"),
        "value",
    )


@pytest.fixture
def model(arrivals):
    daily = scoring.daily_totals(arrivals).select(
        "*", F.col("series").alias("sgg"), F.lit(None).cast("string").alias("emd"), (F.col("ts") < CUT).alias("is_train")
    )
    return detect.fit(daily)


def rows(df):
    return sorted((tuple(r) for r in df.select("series", "ts", "y", "percentile", "is_anomaly", "flagged").collect()), key=str)


def test_stream_equals_batch(spark, arrivals, model, tmp_path):
    late = arrivals.where(F.col("event_time") >= F.lit(CUT))
    expected = scoring.score_arrivals(late, model, SPEC)
    last_day = late.agg(F.to_date(F.max("event_time"))).first()[0]
    closed = rows(expected.where(F.col("ts") < F.lit(last_day - dt.timedelta(days=1))))
    model.write.parquet(f"{tmp_path}/model")
    stored_model = spark.read.parquet(f"{tmp_path}/model")
    halves = [late.where(F.dayofmonth("event_time") <= 25), late.where(F.dayofmonth("event_time") > 25)]
    for half in halves:
        half.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(arrivals.schema).parquet(f"{tmp_path}/in")
        scored = scoring.score_arrivals(stream, stored_model, SPEC)
        scoring.write_available(scored, f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
    got = rows(spark.read.parquet(f"{tmp_path}/out"))
    assert len(closed) > 20 and set(closed) <= set(got)
    assert set(got) <= set(rows(expected)) and len(got) == len(set(got))


def test_progress_folder_comes_from_the_session(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scoring.checkpoint_path(spark, "scores") == f"{shared}/scores"
    assert PathStore.shared(spark, "run").base == f"{shared}/run"
