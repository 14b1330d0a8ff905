"""Digits, null keys and the options, on hand-made frames."""

from __future__ import annotations

import datetime as dt
import shutil
import subprocess
import sys
from dataclasses import replace
from decimal import Decimal

import pytest
from conftest import ROOT, SF_SMALL
from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.operators import checks, context, detect, fuse, marts, prompts, series
from tidewatch.sources.schemas import SOURCES
from tidewatch.sources.star import STAR_SETTINGS, StarSources
from tidewatch.spec import Cutoff, DetectorSpec, Settings, SourceFilter, default_signals

DAY = dt.date(2024, 1, 1)
S = Settings()
SCORES = "signal string, series string, sgg string, emd string, ts date, y double, forecast double, percentile double, is_anomaly boolean"


def score(signal, sgg, percentile, y=1.0, ts=DAY, emd=None):
    return (signal, sgg, sgg, emd, ts, y, 2.0, percentile, False)


@pytest.mark.parametrize("digits", range(3, 9))
def test_every_digit_counts(frame, digits):
    small = float(Decimal(4).scaleb(-digits))
    rows = [(DAY, "m", "s", 1, 12345.6789 + small, small)] * 3
    (r,) = context.rental_trend(frame(rows, SOURCES["rental"]), S.context).collect()
    assert r.avg_policy_amt == pytest.approx(12345.6789 + small, rel=1e-15)
    (r,) = frame([(small,)] * 3, "v double").agg(X.exact_mean(F.col("v")).alias("m"), X.exact_sum(F.col("v")).alias("s")).collect()
    assert r.s == Decimal(12).scaleb(-digits) and r.m == float(r.s) / 3
    (r,) = series.pop_series(frame([(DAY, S.source.city, "A", "sgg", S.source.movement_type, small)] * 3, SOURCES["population"]), S).collect()
    assert r.y == float(Decimal(12).scaleb(-digits))
    master = frame([(1, S.source.province_code, "A", "a", "g")], SOURCES["district"])
    spent = frame([(202401, S.source.province_code, 1, small, small, None)] * 3, SOURCES["card"])
    (r,) = series.card_series(spent, master, S).collect()
    assert r.y == pytest.approx(6 * small, rel=1e-12)
    calls = frame([(DAY, "c", S.context.call_division, 5, small, 3 * small)] * 3, SOURCES["calls"])
    (r,) = context.call_center_context(calls, frame([], SOURCES["call_conversion"]), S.context).collect()
    assert r.avg_connection_rate == pytest.approx(small, rel=1e-15) and r.total_calls == 15


def test_large_values_do_not_overflow(frame):
    (r,) = frame([(1e12,)] * 10, "v double").agg(X.exact_mean(F.col("v")).alias("m")).collect()
    assert r.m == 1e12
    assert frame([(0.004,)] * 3, "v double").agg(X.exact_mean(F.col("v")).alias("m")).first().m == 0.004


def test_null_districts_meet_no_other_signal(frame):
    rows = [score("pop", None, 0.5), score("telecom", None, 0.9), score("pop", "A", 0.5), score("telecom", "A", 0.9)]
    got = {r.sgg: r for r in fuse.signals_joined(frame(rows, SCORES), S).collect()}
    assert got[None].telecom_percentile is None and got["A"].telecom_percentile == 0.9
    alerts = fuse.alert_rows(frame(rows, SCORES), S).collect()
    assert [r.sgg for r in alerts] == ["A"]
    for other in ("price", "card"):
        rows = [score("pop", None, 0.5), score(other, None, 0.99)]
        assert fuse.alert_rows(frame(rows, SCORES), S).count() == 0


def test_values_of_a_signal_come_from_one_row(frame):
    rows = [score("pop", "A", 0.5), score("card", "A", 0.9, y=1.0), score("card", "A", 0.1, y=7.0)]
    (r,) = fuse.signals_joined(frame(rows, SCORES), S).collect()
    assert (r.card_percentile, r.card_actual) == (0.9, 1.0)


def test_a_null_series_is_not_a_region(frame):
    schema = "signal string, series string, cut_group string, is_train boolean"
    rows = [("pop", None, "main", True), ("pop", "A", "main", True), ("pop", "A", "main", True)]
    (r,) = checks.table_profile(frame(rows, schema)).collect()
    assert (r.row_count, r.regions) == (3, 1)


def test_the_master_has_every_nation_and_segment(spark):
    sources = StarSources(spark, SF_SMALL)
    assert sources["district"].count() == 125 == sources["district"].select("district_code").distinct().count()
    known = sources["district"].select("district_code")
    assert sources["card"].join(known, "district_code", "left_anti").count() == 0


def test_flag_share(frame):
    rows = [score("pop", "A", 0.5)] + [score("price", "A", p, emd=str(p)) for p in (0.9, 0.5, 0.5, 0.5)]
    for share, flagged in ((None, True), (0.25, True), (0.5, False)):
        (r,) = fuse.price_rollup(frame(rows, SCORES), replace(S, flag_share=share)).collect()
        assert r.is_anomaly == flagged
        assert fuse.alert_rows(frame(rows, SCORES), replace(S, flag_share=share)).count() == int(flagged)


def test_densified_months(frame):
    days = [dt.date(2022, 11, 1), dt.date(2023, 2, 1)]
    rows = [(d, S.source.city, "A", "sgg", S.source.movement_type, 3.0) for d in days]
    dense = series.densified(series.pop_series(frame(rows, SOURCES["population"]), S), S).orderBy("ts").collect()
    assert [(r.ts.month, r.y, r.is_train) for r in dense] == [(11, 3.0, True), (12, None, True), (1, None, False), (2, 3.0, False)]


def test_counts_by_flags(frame):
    rows = [("A", "4중 동시 경보", True, True, True, True, 0.9), ("A", "시세 경보", True, False, None, False, 0.4)]
    schema = "sgg string, alert_type string, price_is_anomaly boolean, pop_is_anomaly boolean, telecom_is_anomaly boolean, card_is_anomaly boolean, combined_score double"
    (words,), (flags,) = (marts.sgg_summary(frame(rows, schema), by).collect() for by in (False, True))
    assert (words.price_alerts, words.card_alerts) == (1, 0)
    assert (flags.price_alerts, flags.pop_alerts, flags.telecom_alerts, flags.card_alerts) == (2, 1, 1, 1)


def test_sorted_summary(frame):
    summary = frame([("B", 3), ("A", 3), ("C", 9)], "sgg string, total_alerts long")
    assert [r.sgg for r in marts.sgg_summary_sorted(summary).collect()] == ["C", "A", "B"]
    assert [r.sgg for r in marts.sgg_summary_sorted(summary, 2).collect()] == ["C", "A"]


def test_direction_in_prompts(frame):
    rows = [score("pop", "A", 0.9), score("card", "A", 0.1)]
    alerts = fuse.enriched(
        fuse.alert_rows(frame(rows, SCORES), S),
        frame([], "sgg string, district_code bigint, district_geom string"),
        frame([], "sgg string, dominant_age_group string, income_profile string"),
    )
    nothing = frame([(None,)], "t string")
    plain = prompts.drafts(alerts, nothing, nothing).first().prompt
    told = prompts.drafts(alerts, nothing, nothing, with_direction=True).first().prompt
    line = "\n[방향] 전입인구 상승 / 카드소비 하락"
    assert line not in plain and line in told and told.replace(line, "") == plain


@pytest.mark.parametrize("method", ["ecdf", "trend"])
def test_a_stored_model_scores_like_the_batch(frame, method):
    cut = dt.date(2004, 1, 1)
    months = [dt.date(2000 + i // 12, i % 12 + 1, 1) for i in range(60)]
    rows = [("pop", "A", "A", None, m, 10.0 + i + (i * 7 % 12) + 0.1 * (i % 5), m < cut) for i, m in enumerate(months)]
    frame_ = frame(rows, "signal string, series string, sgg string, emd string, ts date, y double, is_train boolean")
    spec = DetectorSpec(method=method)
    batch = {r.ts: r for r in detect.score(frame_, spec).collect()}
    model = detect.fit(frame_, spec)
    stored = {r.ts: r for r in detect.score_with_model(frame_.where("not is_train"), model, spec).collect()}
    assert model.first().grain == "month" and set(stored) == set(batch) and len(batch) == 12
    for ts, r in stored.items():
        assert r.percentile == pytest.approx(batch[ts].percentile, abs=1e-9) and r.forecast == pytest.approx(batch[ts].forecast)


def test_bands_of_a_signal_reach_the_lookup(frame):
    ts = frame([("A", "pop", DAY, 1.0, 1.0, 0.5, False)], "region_key string, signal_type string, ts date, actual_value double, forecast_value double, percentile double, is_anomaly boolean")
    own = [replace(s, low=0.1, high=0.9) for s in default_signals()]
    (r,) = marts.signal_lookup(ts, "A", signals=own).collect()
    assert (r.low_line, r.high_line) == (0.1, 0.9)
    (r,) = marts.signal_lookup(ts, "A").collect()
    assert (r.low_line, r.high_line) == (0.25, 0.75)


def test_the_rest_works_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; assert set(e.queries()) == set(e.QUERIES) == set(e.oracle_sql()); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert done.stdout.strip() == "fine", done.stderr


def test_settings_have_the_earlier_defaults():
    assert (S.grain_fallback, S.densify, S.flag_share, S.direction_in_prompts) == (False, False, None, False)
    assert STAR_SETTINGS.source == SourceFilter(movement_type="F", install_state="O")
    assert Cutoff(DAY).late_day is None
