"""The seasonal detector: its recurrence, missing months, stored and advanced states."""

from __future__ import annotations

import datetime as dt
import math
import random
from dataclasses import replace

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidewatch.operators import detect, state_space
from tidewatch.plans.pipeline import Pipeline
from tidewatch.plans.store import PathStore
from tidewatch.sources.star import STAR_SETTINGS, StarSources
from tidewatch.spec import DetectorSpec

SERIES = "signal string, series string, sgg string, emd string, ts date, y double, is_train boolean"
SPEC = DetectorSpec(method="state", min_points=3)


def months(n, start=0):
    return [dt.date(2000 + (start + i) // 12, (start + i) % 12 + 1, 1) for i in range(n)]


def plain(rows, spec=SPEC):
    """Scores of one series with plain numbers: rows of (ts, y, is_train)."""
    state = None
    for ts, y, _ in sorted(r for r in rows if r[2] and r[1] is not None):
        x = ts.year * 12 + ts.month
        if state is None:
            level, trend, season, last, n, squares = y, 0.0, [0.0] * 12, x, 1, 0.0
        else:
            level, trend, season, last, n, squares = state
            moved = level + (x - last) * trend
            gap = y - (moved + season[ts.month - 1])
            level, trend = moved + spec.level_gain * gap, trend + spec.trend_gain * gap
            season = [s + spec.season_gain * gap if i == ts.month - 1 else s for i, s in enumerate(season)]
            last, n, squares = x, n + 1, squares + gap * gap
        state = (level, trend, season, last, n, squares)
    level, trend, season, last, n, squares = state
    out = {}
    for ts, y, is_train in rows:
        if not is_train and n >= spec.min_points:
            h = ts.year * 12 + ts.month - last
            wide = 1 + sum(
                (spec.level_gain + spec.trend_gain * j + (spec.season_gain if j % 12 == 0 else 0)) ** 2 for j in range(1, h)
            )
            sigma = math.sqrt(squares / (n - 1)) * math.sqrt(wide)
            forecast = level + h * trend + season[ts.month - 1]
            place = None
            if y is not None:
                place = 0.5 * (1 + math.erf((y - forecast) / sigma / math.sqrt(2))) if sigma else 0.5 + 0.5 * ((y > forecast) - (y < forecast))
            out[ts] = (forecast, place)
    return out


def series_rows(rng, name, n, train):
    level = rng.uniform(50, 100)
    rows = []
    for i, ts in enumerate(months(n)):
        y = level + 0.4 * i + 10 * math.sin(ts.month / 12 * 2 * math.pi) + rng.gauss(0, 2)
        if rng.random() > 0.15 or i == 0:  # some months are missing
            rows.append((ts, None if rng.random() < 0.05 else y, i < train))
    return rows


def test_scores_are_those_of_the_recurrence(frame):
    rng = random.Random(1)
    every = {name: series_rows(rng, name, 80, 50) for name in ("a", "b", "c")}
    df = frame([("s", name, name, None, *r) for name, rows in every.items() for r in rows], SERIES).repartition(5)
    found = {(r.series, r.ts): (r.forecast, r.percentile) for r in state_space.score(df, SPEC).collect()}
    want = {(name, ts): v for name, rows in every.items() for ts, v in plain(rows).items()}
    assert found.keys() == want.keys() and len(want) > 60
    for key, (forecast, place) in want.items():
        assert found[key][0] == pytest.approx(forecast, rel=1e-9)
        assert found[key][1] == (None if place is None else pytest.approx(place, abs=2e-6))


def test_a_season_is_learnt(frame):
    rows = [("s", "a", "a", None, ts, 100.0 + (50.0 if ts.month == 7 else 0.0), i < 96) for i, ts in enumerate(months(108))]
    found = {r.ts.month: r.forecast for r in state_space.score(frame(rows, SERIES), SPEC).collect()}
    assert found[7] > found[6] + 20 and found[7] > found[8] + 20


def test_an_advanced_model_is_the_model_of_all_months(frame):
    rng = random.Random(2)
    rows = [("s", n, n, None, *r) for n in ("a", "b") for r in series_rows(rng, n, 60, 60)]
    rows += [("s", "late", "late", None, ts, 5.0 + i, True) for i, ts in enumerate(months(20, 40))]
    df = frame(rows, SERIES)
    cut = F.lit(dt.date(2002, 7, 1))
    model = state_space.fit(df.where(F.col("ts") < cut), SPEC)
    later = state_space.advance(model, df.where(F.col("ts") >= cut), SPEC)
    whole = state_space.fit(df, SPEC)
    assert state_space.states_differ(later, whole).count() == 0
    assert sorted(map(str, later.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    again = state_space.advance(later, df, SPEC)  # months that it has seen change nothing
    assert state_space.states_differ(again, whole).count() == 0
    assert state_space.states_differ(model, whole).count() == 3


def test_short_constant_and_empty_series(frame):
    rows = [("s", "short", "x", None, ts, 1.0, i < 2) for i, ts in enumerate(months(5))]
    rows += [("s", "flat", "x", None, ts, 7.0 if i != 11 else 8.0, i < 10) for i, ts in enumerate(months(12))]
    rows += [("s", "nothing", "x", None, ts, None, i < 5) for i, ts in enumerate(months(9))]
    found = {(r.series, r.ts): (r.forecast, r.percentile) for r in state_space.score(frame(rows, SERIES), SPEC).collect()}
    assert found == {("flat", months(12)[10]): (7.0, 0.5), ("flat", months(12)[11]): (7.0, 1.0)}
    assert state_space.score(frame([], SERIES), SPEC).count() == 0
    assert state_space.fit(frame([], SERIES), SPEC).columns == list(state_space.MODEL_COLUMNS)


def test_a_stored_state_scores_like_the_batch(spark, tmp_path):
    settings = replace(STAR_SETTINGS, detector=replace(STAR_SETTINGS.detector, method="state"))
    pipeline = Pipeline(StarSources(spark, SF), settings, PathStore(spark, str(tmp_path)))
    stored = state_space.score_with_model(pipeline.series.where(~F.col("is_train")), pipeline.model, settings.detector)
    rows = lambda df: sorted(map(str, df.select(*detect.SCORE_COLUMNS).collect()))
    assert rows(stored) == rows(pipeline.scores) != []
    assert pipeline.region_alerts.count() > 0
