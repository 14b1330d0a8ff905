"""Sketches: their error on random values, and that parts merge into the whole."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidewatch.operators import checks, detect, marts, sketches
from tidewatch.plans.pipeline import Pipeline
from tidewatch.sources.star import STAR_SETTINGS, StarSources
from tidewatch.spec import DetectorSpec

SERIES = "signal string, series string, sgg string, emd string, ts date, y double, is_train boolean"
DAY = dt.date(2000, 1, 1)


def days(n):
    return [DAY + dt.timedelta(days=i) for i in range(n)]


def place(history, y):
    return (sum(v < y for v in history) + 0.5 * sum(v == y for v in history)) / len(history)


@pytest.fixture
def long_series(frame):
    """Series of 6,000 days, of which 200 are scored: smooth, heavy-tailed, with many equal values."""
    rng = random.Random(7)
    kinds = {"smooth": lambda: rng.gauss(0, 1), "tail": lambda: rng.paretovariate(1.1), "ties": lambda: float(rng.randint(0, 9))}
    values = {name: [kind() for _ in range(6000)] for name, kind in kinds.items()}
    rows = [("s", n, n, None, ts, y, i < 5800) for n, ys in values.items() for i, (ts, y) in enumerate(zip(days(6000), ys, strict=True))]
    return frame(rows, SERIES).repartition(6), values


def errors(scores, values):
    out = {}
    for r in scores.collect():
        out.setdefault(r.series, []).append(abs(r.percentile - place(values[r.series][:5800], r.y)))
    return out


def test_rank_error_is_within_its_bound(long_series):
    df, values = long_series
    model = sketches.fit_history(df)
    scores = sketches.score_with_history(df.where(~F.col("is_train")), model, DetectorSpec())
    found = errors(scores, values)
    assert {n: len(e) for n, e in found.items()} == dict.fromkeys(values, 200)
    for name, gaps in found.items():
        outside = sum(g > sketches.RANK_ERROR + 1 / sketches.MARKS for g in gaps)
        assert outside <= 0.02 * len(gaps) and max(gaps) < 2.5 * sketches.RANK_ERROR, name
    size = model.select(F.max(F.length("history"))).first()[0]
    assert size < 8 * 1000  # 5,800 doubles would be 46,400 bytes


def test_two_sketches_merge_like_one(long_series):
    df, values = long_series
    early = F.col("ts") < DAY + dt.timedelta(days=3000)
    parts = sketches.fit_history(df.where(early)).unionAll(sketches.fit_history(df.where(~early)))
    merged, whole = sketches.merged_history(parts), sketches.fit_history(df)
    plain = [c for c in whole.columns if c != "history"]
    assert sorted(map(str, merged.select(plain).collect())) == sorted(map(str, whole.select(plain).collect()))
    found = errors(sketches.score_with_history(df.where(~F.col("is_train")), merged, DetectorSpec()), values)
    for gaps in found.values():
        assert sum(g > sketches.RANK_ERROR + 1 / sketches.MARKS for g in gaps) <= 0.03 * len(gaps)


def test_histories_up_to_the_size_of_a_sketch_are_exact(frame):
    rng = random.Random(3)
    rows = [("s", f"x{n}", "a", None, ts, float(rng.randint(0, n)), i < n) for n in (18, 40, 199, 200) for i, ts in enumerate(days(n + 30))]
    df = frame(rows, SERIES)
    got = sketches.score_with_history(df.where(~F.col("is_train")), sketches.fit_history(df), DetectorSpec())
    want = detect.score(df, DetectorSpec())
    columns = list(detect.SCORE_COLUMNS)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert got.count() == 120


def test_profiles_of_any_dates_without_reading_rows(spark):
    series = Pipeline(StarSources(spark, SF), STAR_SETTINGS).series
    stored = sketches.profile_sketches(series)
    for first, last in ((None, None), (dt.date(1996, 3, 1), dt.date(1999, 5, 1)), (dt.date(2000, 6, 1), None)):
        rows = series if first is None else series.where(F.col("ts") >= first)
        rows = rows if last is None else rows.where(F.col("ts") <= last)
        exact = {r.tbl: (r.row_count, r.regions) for r in checks.table_profile(rows).collect()}
        assert {r.tbl: (r.row_count, r.regions) for r in sketches.profile_of(stored, first, last).collect()} == exact


def test_distinct_counts_are_within_their_error(spark):
    rows = spark.range(200_000).selectExpr("concat('r', id) as series", "'s' as signal", "true as is_train", "'main' as cut_group", "date_add(date'2000-01-01', cast(id % 40 as int)) as ts")
    (found,) = sketches.profile_of(sketches.profile_sketches(rows)).collect()
    assert found.row_count == 200_000 and abs(found.regions / 200_000 - 1) < 3 * 1.04 / 2 ** (sketches.LG / 2)


def test_box_plot_of_merged_sketches(spark, frame):
    rng = random.Random(5)
    values = [rng.gauss(0, 1) for _ in range(20_000)]
    rows = frame([("a", i % 24, v) for i, v in enumerate(values)] + [("few", 1, 3.0), ("few", 2, 1.0), ("none", 1, None)], "signal string, month int, score double")
    stored = sketches.value_sketches(rows, ["signal", "month"], "score")
    found = {r.signal: r for r in sketches.distribution_of(stored, ["signal"]).collect()}
    ordered = sorted(values)
    assert (found["a"].low, found["a"].high) == (ordered[0], ordered[-1])
    for mark, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        assert abs(sum(v <= found["a"][mark] for v in values) / len(values) - share) < 2 * sketches.RANK_ERROR
    assert (found["few"].q1, found["few"].median, found["few"].q3) == (1.0, 1.0, 3.0)
    assert tuple(found["none"]) == ("none", None, None, None, None, None)


def test_box_plot_of_alert_scores_is_near_the_exact_one(spark):
    points = Pipeline(StarSources(spark, SF), STAR_SETTINGS).alert_points.withColumn("month", F.trunc("alert_date", "month"))
    exact = {r.signal: r for r in marts.score_distribution(points).collect()}
    long = points.unpivot(["month"], ["price_score", "pop_score", "telecom_score", "card_score"], "code", "score")
    stored = sketches.value_sketches(long, ["code", "month"], "score")
    found = sketches.distribution_of(stored, ["code"]).collect()
    names = {"price_score": "시세", "pop_score": "전입인구", "telecom_score": "통신", "card_score": "카드소비"}
    for r in found:
        want = exact[names[r.code]]
        assert (r.low, r.high) == (want.low, want.high)
        scores = [s[0] for s in long.where(F.col("code") == r.code).select("score").collect()]
        for mark, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            below = sum(s < r[mark] for s in scores) / len(scores)
            assert below - 2 * sketches.RANK_ERROR <= share <= sum(s <= r[mark] for s in scores) / len(scores) + 2 * sketches.RANK_ERROR
