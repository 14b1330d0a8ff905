"""Rules that hold whatever the data, on hand-made frames."""

from __future__ import annotations

import datetime as dt
import itertools
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.functions import fixed_values as fv
from tidewatch.operators import checks, context, detect, fuse, marts, profile, prompts, select, series
from tidewatch.spec import ContextSpec, Cutoff, DetectorSpec, SelectionSpec, Settings, default_signals

S = Settings()
SCORES = "signal string, series string, sgg string, emd string, ts date, y double, forecast double, percentile double, is_anomaly boolean"
M = dt.date(2024, 3, 1)


def score(signal, percentile, sgg="A", emd=None, ts=M, y=1.0):
    key = sgg if emd is None else f"{sgg}_{emd}"
    return (signal, key, sgg, emd, ts, y, 2.0, percentile, False)


def regions(frame, rows):
    return fuse.labelled(fuse.scored_regions(fuse.signals_joined(frame(rows, SCORES), S), S), S)


def alerts(frame, rows):
    geometry = frame([], "sgg string, district_code bigint, district_geom string")
    people = frame([], "sgg string, dominant_age_group string, income_profile string")
    return fuse.region_alerts(frame(rows, SCORES), geometry, people, S)


# ---- driver, neutral values, roll-up, thresholds -------------------------------------------------------------------


def test_only_the_driving_signal_can_alert(frame):
    rows = [score("price", 0.99, emd="x"), score("telecom", 0.99), score("card", 0.01)]
    assert alerts(frame, rows).count() == 0


def test_missing_signals_are_neutral_and_keep_null_values(frame):
    (r,) = alerts(frame, [score("pop", 0.9)]).collect()
    assert (r.price_percentile, r.telecom_percentile, r.card_percentile) == (0.5, 0.5, 0.5)
    assert r.price_actual is None and r.telecom_forecast is None and r.card_actual is None
    assert not (r.price_is_anomaly or r.telecom_is_anomaly or r.card_is_anomaly)
    assert r.combined_score == pytest.approx(0.4 * 2 * 0.25)
    assert r.alert_type == "전입인구 경보"


@pytest.mark.parametrize("absent", ["price", "telecom", "card"])
def test_each_signal_may_be_absent(frame, absent):
    rows = [score(s, 0.9, emd="x" if s == "price" else None) for s in ("price", "pop", "telecom", "card") if s != absent]
    (r,) = alerts(frame, rows).collect()
    assert not r[f"{absent}_is_anomaly"] and r[f"{absent}_percentile"] == 0.5


def test_price_is_flagged_by_any_area_but_scored_by_the_mean(frame):
    rows = [score("pop", 0.5), score("price", 0.9, emd="e0")]
    rows += [score("price", p, emd=f"e{i}") for i, p in enumerate((0.4, 0.4, 0.4, 0.4), 1)]
    (r,) = alerts(frame, rows).collect()
    assert r.price_is_anomaly and r.price_percentile == pytest.approx(0.5) and r.combined_score == pytest.approx(0)
    assert r.alert_type == "시세 경보"


@pytest.mark.parametrize(
    "percentile,flagged",
    [(0.0, True), (0.2499999, True), (0.25, False), (0.2500001, False), (0.5, False), (0.75, False),
     (0.7500001, True), (1.0, True), (None, None)],
)
def test_band_edges_are_strict(frame, percentile, flagged):
    (r,) = regions(frame, [score("pop", percentile)]).collect()
    assert r.pop_is_anomaly is flagged
    assert r.alert_type == ("전입인구 경보" if flagged else None)


def test_a_null_driver_percentile_survives_only_by_another_signal(frame):
    assert alerts(frame, [score("pop", None)]).count() == 0
    (r,) = alerts(frame, [score("pop", None), score("telecom", 0.9)]).collect()
    assert r.combined_score is None and r.pop_is_anomaly is None and r.alert_type == "통신 경보"


def test_score_weights(frame):
    rows = [score(s, 1.0, emd="x" if s == "price" else None) for s in ("price", "pop", "telecom", "card")]
    (r,) = alerts(frame, rows).collect()
    assert r.combined_score == pytest.approx(1.0) and r.alert_type == fv.QUAD_LABEL


def test_flags_do_not_use_the_model_flag(frame):
    calm = ("pop", "A", "A", None, M, 1.0, 2.0, 0.5, True)
    assert alerts(frame, [calm]).count() == 0


# ---- labels --------------------------------------------------------------------------------------------------------


def test_label_of_every_flag_set(frame):
    names = ["price", "pop", "telecom", "card"]
    want = {frozenset(members): label for members, label in fv.ALERT_LABELS}
    rows = list(itertools.product([False, True, None], repeat=4))
    df = frame(rows, ", ".join(f"{n} boolean" for n in names))
    got = df.withColumn("label", X.alert_label(X.flag_mask([F.col(n) for n in names]), names)).collect()
    for r in got:
        assert r.label == want.get(frozenset(n for n in names if r[n]))
    assert len({r.label for r in got if r.label}) == 15


ALERT = "region_key string, sgg string, alert_date date, alert_type string, combined_score double"


def test_summary_counts_go_by_label_words(frame):
    rows = [("A", "A", M, label, 0.5) for _, label in fv.ALERT_LABELS]
    (r,) = marts.sgg_summary(frame(rows, ALERT)).collect()
    assert (r.total_alerts, r.quad_alerts, r.triple_alerts) == (15, 1, 1)
    # Every set with the signal, less the quad and triple labels that name none; the triple has no card.
    assert (r.price_alerts, r.pop_alerts, r.telecom_alerts, r.card_alerts) == (6, 6, 6, 7)


def test_triple_or_more_counts_two_labels_only(frame):
    rows = [("A", "A", M, label, 0.5) for _, label in fv.ALERT_LABELS] + [("B", "B", M, None, 0.9)]
    (r,) = marts.alert_kpis(frame(rows, ALERT)).collect()
    assert (r.total_alerts, r.quad_alerts, r.triple_or_more, r.districts, r.max_score) == (16, 1, 2, 2, 0.9)


def test_labels_in_display_order(frame):
    rows = [("A", "A", M, t, 0.5) for t in ("통신 경보", "4중 동시 경보", None, "통신 경보", "시세 경보")]
    assert [r.alert_type for r in marts.labels_present(frame(rows, ALERT)).collect()] == [
        "4중 동시 경보", "시세 경보", "통신 경보",
    ]


# ---- selection -----------------------------------------------------------------------------------------------------


def test_best_per_region_with_unique_tie_break(frame):
    rows = [
        ("A", "A", dt.date(2024, 2, 1), "x", 0.5),
        ("A", "A", dt.date(2024, 1, 1), "x", 0.5),
        ("A", "A", dt.date(2024, 3, 1), "x", 0.4),
        ("B", "B", dt.date(2024, 1, 1), "x", 0.25),
        ("C", "C", dt.date(2024, 1, 1), "x", None),
    ]
    got = select.dedup_best(frame(rows, ALERT), SelectionSpec()).collect()
    assert [(r.region_key, r.alert_date) for r in got] == [("A", dt.date(2024, 1, 1))]


def test_top_k_per_district_at_area_grain(frame):
    rows = [(f"A_{i:02d}", "A", M, "x", 0.3 + i / 100) for i in range(40)] + [("B_1", "B", M, "x", 0.3)]
    got = select.alert_candidates(frame(rows, ALERT), SelectionSpec()).collect()
    assert sorted(r.region_key for r in got) == sorted([f"A_{i:02d}" for i in range(25, 40)] + ["B_1"])


# ---- profile -------------------------------------------------------------------------------------------------------

DISTRICT = "district_code bigint, province_code int, city_kor_name string, district_kor_name string, district_geom string"
INCOME = "standard_year_month int, district_code bigint, age_group int, customer_count bigint, rate_income_over_70m double"


def people(counts, code=1, period=202401, rate=0.05):
    return [(period, code, age, n, rate) for age, n in zip((25, 35, 45, 55), counts)]


@pytest.mark.parametrize(
    "counts,label",
    [
        ((0, 0, 0, 0), "30대 중심"),
        ((5, 5, 5, 5), "30대 중심"),
        ((5, 1, 5, 5), "40대 중심"),
        ((5, 1, 2, 5), "20대 중심"),
        ((1, 2, 3, 9), "20-50대 혼합"),
        ((1, 9, 3, 2), "30대 중심"),
        ((1, 2, 9, 2), "40대 중심"),
    ],
)
def test_dominant_age_ties(frame, counts, label):
    master = frame([(1, 11, "A", "x", "g")], DISTRICT)
    (r,) = profile.customer_profile(master, frame(people(counts), INCOME), S).collect()
    assert r.dominant_age_group == label


@pytest.mark.parametrize(
    "rate,label", [(0.2000001, "고소득 지역"), (0.2, "중고소득 지역"), (0.1, "중소득 지역"), (0.0, "중소득 지역"), (None, "소득 정보 없음")]
)
def test_income_bands(frame, rate, label):
    master = frame([(1, 11, "A", "x", "g")], DISTRICT)
    (r,) = profile.customer_profile(master, frame(people((1, 1, 1, 1), rate=rate), INCOME), S).collect()
    assert r.income_profile == label


def test_income_rate_is_a_plain_mean_of_the_newest_period(frame):
    rows = [(202301, 1, 35, 1000, 0.9), (202401, 1, 35, 1000, 0.3), (202401, 1, 45, 1, 0.0)]
    (r,) = profile.age_band_counts(frame(rows, INCOME)).collect()
    assert r.rate_income_over_70m == pytest.approx(0.15) and (r.cnt_30s, r.cnt_40s) == (1000, 1)


def test_unmatched_and_null_districts(frame):
    master = frame([(2, 11, "A", "x", "g"), (None, 11, "B", "y", "h"), (3, 11, "C", None, "i")], DISTRICT)
    got = {r.district_code: r for r in profile.customer_profile(master, frame(people((1, 2, 1, 1)), INCOME), S).collect()}
    assert set(got) == {2, 3}
    assert (got[2].dominant_age_group, got[2].income_profile) == ("30-40대 추정", "소득 정보 없음")
    assert got[3].region_key is None


def test_representative_row_is_the_lowest_code(frame):
    master = frame(
        [(9, 11, "A", "x", "g9"), (3, 11, "A", "y", "g3"), (1, 11, "A", None, "g1"), (None, 11, "A", "z", "g0")], DISTRICT
    )
    (r,) = profile.sgg_geometry(master).collect()
    assert (r.district_code, r.district_geom) == (3, "g3")


# ---- series --------------------------------------------------------------------------------------------------------

CARD = (
    "standard_year_month int, province_code int, district_code bigint, electronics_furniture_sales double, "
    "home_life_service_sales double, large_discount_store_sales double"
)


def test_card_months_without_spend_are_dropped(frame):
    d = float
    rows = [
        (202201, 11, 1, d(5), None, d(1)),
        (202201, 11, 2, None, d(2), None),
        (202202, 11, 1, None, None, None),
        (202203, 11, 1, d(3), d(-3), None),
        (202204, 11, 1, d(-1), None, None),
        (202213, 11, 1, d(7), None, None),
        (202301, 99, 1, d(7), None, None),
        (202301, 11, 7, d(7), None, None),
        (202301, 11, 1, d(4), None, None),
    ]
    master = frame([(1, 11, "A", "x", "g"), (2, 11, "A", "y", "g")], DISTRICT)
    got = series.card_series(frame(rows, CARD), master, S).orderBy("ts").collect()
    assert [(r.ts, r.y, r.is_train) for r in got] == [
        (dt.date(2022, 1, 1), 8.0, True),
        (dt.date(2023, 1, 1), 4.0, False),
    ]


PRICE = "ts date, sd string, sgg string, emd string, region_level string, price double"


def test_cut_off_of_both_groups(frame):
    days = [dt.date(2022, 12, 31), dt.date(2023, 1, 1), dt.date(2023, 1, 2), dt.date(2023, 12, 31), dt.date(2024, 1, 1)]
    rows = [(d, "서울", sgg, "e", "emd", 1.0) for d in days for sgg in ("서초구", "강남구", None)]
    rows += [(days[0], "부산", "강남구", "e", "emd", 1.0), (days[0], "서울", "강남구", "e", "sgg", 1.0)]
    got = series.price_series(frame(rows, PRICE), S).orderBy("sgg", "ts").collect()
    assert [(r.sgg, r.ts, r.is_train) for r in got] == [
        *[("강남구", d, d < dt.date(2023, 1, 1)) for d in days],
        *[("서초구", d, d < dt.date(2024, 1, 1)) for d in days],
    ]
    assert {r.series for r in got} == {"강남구_e", "서초구_e"}
    groups = {(r.cut_group, r.sgg): r.row_count for r in checks.group_split(frame(rows, PRICE), S).collect()}
    assert groups == {("late", "서초구"): 5, ("main", "강남구"): 5}


def test_price_is_a_mean_and_null_prices_do_not_count(frame):
    rows = [(M, "서울", "강남구", "e", "emd", p) for p in (1.0, 2.0, None)]
    (r,) = series.price_series(frame(rows, PRICE), S).collect()
    assert r.y == 1.5


def test_null_part_makes_the_key_null(frame):
    rows = [(M, "서울", "강남구", None, "emd", 1.0)]
    (r,) = series.price_series(frame(rows, PRICE), S).collect()
    assert r.series is None and r.sgg == "강남구"


def test_grain_falls_back_when_histories_are_short(frame):
    def months(n):
        return [dt.date(2000 + i // 12, i % 12 + 1, 1) for i in range(n)]

    rows = [(d, "서울", "A", f"e{i}", "emd", 1.0) for i in range(4) for d in months(24 if i < 2 else 23)]
    rows += [(d, "서울", "B", f"e{i}", "emd", 1.0) for i in range(3) for d in months(24 if i < 1 else 23)]
    got = {r.sgg: (r.grain, r.n_long_enough) for r in series.grain_choice(frame(rows, PRICE), S).collect()}
    assert got == {"A": ("emd", 2), "B": ("sgg", 1)}


# ---- detector ------------------------------------------------------------------------------------------------------

SERIES = "signal string, series string, sgg string, emd string, ts date, y double, is_train boolean"
ONE = DetectorSpec(min_points=1)


def points(train, detect_values, key="A"):
    days = [dt.date(2000 + i // 12, i % 12 + 1, 1) for i in range(len(train) + len(detect_values))]
    values = list(train) + list(detect_values)
    return [("pop", key, key, None, d, v, i < len(train)) for i, (d, v) in enumerate(zip(days, values))]


def brute_force_place(train, y):
    usable = [t for t in train if t is not None]
    return (sum(t < y for t in usable) + 0.5 * sum(t == y for t in usable)) / len(usable)


@pytest.mark.parametrize("method", ["window", "model"])
def test_place_in_history(frame, method):
    train = [3.0, 1.0, 2.0, 2.0, None, 5.0]
    observed = [0.5, 9.0, 2.0, 2.5, 5.0, 1.0]
    rows = frame(points(train, observed), SERIES)
    if method == "window":
        got = detect.score_ecdf(rows, ONE)
    else:
        got = detect.score_with_model(rows.where("not is_train"), detect.fit(rows), ONE)
    got = got.orderBy("ts").collect()
    assert [r.percentile for r in got] == [brute_force_place(train, y) for y in observed]
    assert {r.forecast for r in got} == {13.0 / 5}
    assert [r.is_anomaly for r in got] == [True, True, False, False, False, False]


def test_null_observation_has_no_place(frame):
    (r,) = detect.score_ecdf(frame(points([1.0, 2.0], [None]), SERIES), ONE).collect()
    assert r.percentile is None and r.is_anomaly is None


def test_constant_history(frame):
    got = detect.score_ecdf(frame(points([4.0] * 3, [4.0, 5.0, 3.0]), SERIES), ONE).orderBy("ts").collect()
    assert [r.percentile for r in got] == [0.5, 1.0, 0.0]


@pytest.mark.parametrize("n,scored", [(0, 0), (1, 0), (17, 0), (18, 2)])
def test_short_histories_give_no_scores(frame, n, scored):
    rows = frame(points([float(i) for i in range(n)], [1.0, 2.0]), SERIES)
    assert detect.score_ecdf(rows, DetectorSpec()).count() == scored
    assert detect.score_trend(rows, DetectorSpec(method="trend")).count() == scored


def test_trend_follows_a_line(frame):
    rows = frame(points([10.0 + 2 * i for i in range(20)], [50.0, 60.0, 40.0]), SERIES)
    got = detect.score_trend(rows, DetectorSpec(method="trend")).orderBy("ts").collect()
    assert [round(r.forecast, 6) for r in got] == [50.0, 52.0, 54.0]
    assert [round(r.percentile, 6) for r in got] == [0.5, 1.0, 0.0]


def test_trend_against_a_plain_computation(frame):
    train = [100.0 + (30.0 if i % 12 == 0 else 0.0) + 0.5 * i + (i * 37 % 11) for i in range(48)]
    observed = [160.0, 100.0, 131.5]
    rows = frame(points(train, observed), SERIES)
    got = detect.score_trend(rows, DetectorSpec(method="trend")).orderBy("ts").collect()
    slope, intercept = np.polyfit(np.arange(48), train, 1)
    residual = np.array(train) - (intercept + slope * np.arange(48))
    season = np.array([residual[m::12].mean() for m in range(12)])
    sigma = np.std(residual - np.tile(season, 4), ddof=1)
    for i, (r, y) in enumerate(zip(got, observed)):
        forecast = intercept + slope * (48 + i) + season[i]
        assert r.forecast == pytest.approx(forecast, abs=1e-4)
        assert r.percentile == pytest.approx(0.5 * (1 + math.erf((y - forecast) / sigma / math.sqrt(2))), abs=1e-5)


def test_normal_cdf(spark):
    z = [-8.0, -1.959964, -1.0, 0.0, 1.0, 1.959964, 8.0]
    df = spark.createDataFrame([(v,) for v in z], "z double").select("z", X.normal_cdf(F.col("z")).alias("p"))
    want = [0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z]
    assert [r.p for r in df.orderBy("z").collect()] == pytest.approx(want, abs=1.5e-7)


def test_split_check_finds_overlap(frame):
    good = points([1.0, 2.0], [3.0], "A")
    bad = [("pop", "B", "B", None, dt.date(2000, 5, 1), 1.0, True), ("pop", "B", "B", None, dt.date(2000, 4, 1), 1.0, False)]
    got = {r.series: r.violates for r in series.split_check(frame(good + bad, SERIES)).collect()}
    assert got == {"A": False, "B": True}


# ---- context -------------------------------------------------------------------------------------------------------

RENTAL = "ts date, rental_main_category string, rental_sub_category string, open_count bigint, avg_policy_amount double, open_cvr double"


def test_three_months_back_covers_four_months(frame):
    months = [dt.date(2024, m, 1) for m in (1, 2, 3, 4, 5)]
    rows = [(m, "a", "b", 1, 1.0, 1.0) for m in months]
    rows += [(months[-1], "미분류", "b", 9, 1.0, 1.0), (months[-1], "a", "미분류", 9, 1.0, 1.0)]
    rows += [(months[-1], None, "b", 9, 1.0, 1.0), (months[-1], "a", None, 9, 1.0, 1.0)]
    (r,) = context.rental_trend(frame(rows, RENTAL), ContextSpec()).collect()
    assert (r.rental_main_category, r.rental_sub_category, r.total_open, r.rank_num) == ("a", "b", 4, 1)


def test_the_newest_month_counts_placeholder_rows_too(frame):
    rows = [(dt.date(2024, 1, 1), "a", "b", 1, 1.0, 1.0), (dt.date(2024, 9, 1), "미분류", "x", 1, 1.0, 1.0)]
    assert context.rental_trend(frame(rows, RENTAL), ContextSpec()).count() == 0


CALLS = "ts date, main_category_name string, division_name string, call_count bigint, connection_rate double, avg_bill_minute double"
CONVERSION = "ts date, main_category_name string, division_name string, call_to_contract_cvr double, avg_leadtime_days double"


def test_repeated_conversion_rows_count_calls_again(frame):
    calls = frame(
        [(M, "a", "수신", 10, 0.5, 1.0), (M, "a", "수신", 20, 0.7, 3.0), (M, "a", "발신", 99, 0.1, 9.0), (M, "b", "수신", 5, None, 2.0)],
        CALLS,
    )
    conversion = frame(
        [(M, "a", "수신", 0.1, 1.0), (M, "a", "수신", 0.2, 2.0), (M, "a", "수신", None, 6.0), (M, "b", "발신", 0.9, 9.0)],
        CONVERSION,
    )
    spec = ContextSpec()
    got = {r.main_category_name: r for r in context.call_center_context(calls, conversion, spec).collect()}
    keys = ["ts", "main_category_name", "division_name"]
    pairs = calls.where("division_name = '수신'").join(conversion, keys, "left").groupBy("main_category_name").agg(
        F.sum("call_count").alias("calls"),
        F.avg("connection_rate").alias("rate"),
        F.avg("avg_bill_minute").alias("minutes"),
        F.avg("call_to_contract_cvr").alias("cvr"),
        F.avg("avg_leadtime_days").alias("lead"),
    )
    for want in pairs.collect():
        r = got[want.main_category_name]
        assert r.total_calls == want.calls
        for mine, theirs in (
            (r.avg_connection_rate, want.rate),
            (r.avg_call_minutes, want.minutes),
            (r.call_to_contract_cvr, want.cvr),
            (r.avg_leadtime_days, want.lead),
        ):
            assert mine == (None if theirs is None else pytest.approx(theirs))
    assert got["a"].total_calls == 90 and got["b"].call_to_contract_cvr is None


CENTER = "ts date, main_category_name string, total_calls bigint, avg_connection_rate double, call_to_contract_cvr double"


def test_call_text_of_the_newest_month(frame):
    rows = [
        (dt.date(2024, 1, 1), "old", 999, 0.5, 0.5),
        (M, "a", 5, 0.855, 0.123),
        (M, "b", 50, 1.0, 0.12),
        (M, "c", 7, 0.5, None),
        (M, "기타", 500, 0.5, 0.5),
        (M, "d", 1, 0.5, 0.5),
    ]
    (r,) = context.call_context_text(frame(rows, CENTER), ContextSpec()).collect()
    assert r.call_context == "b(100%연결·전환12%)·a(86%연결·전환12.3%)"


TRAFFIC = "ts date, road_name string, node_name string, avg_speed_kmph double, probe_count bigint"


def test_traffic_status_bands(frame):
    spec = ContextSpec(road_districts=(("%강남%", "강남구"), ("%서초%", "서초구"), ("%중%", "중구")))
    rows = [
        (M, "강남대로", "n", 19.9, 2),
        (M, "길", "서초 node", 20.0, 3),
        (M, "중앙로", "n", 30.0, 4),
        (M, "모름", "n", 90.0, 9),
        (dt.date(2024, 1, 1), "강남대로", "n", 90.0, 9),
    ]
    got = {r.sgg: (r.status, r.probe_count) for r in context.traffic_snapshot(frame(rows, TRAFFIC), spec).collect()}
    assert got == {"강남구": ("혼잡", 2), "서초구": ("보통", 3), "중구": ("원활", 4)}


# ---- prompts -------------------------------------------------------------------------------------------------------

CANDIDATE = (
    "region_key string, sgg string, emd string, district_code bigint, district_geom string, alert_date date, "
    "alert_type string, combined_score double, price_percentile double, pop_percentile double, "
    "telecom_percentile double, card_percentile double, dominant_age_group string, income_profile string"
)


def drafted(frame, labels, rentals=None, calls=None, age=None, income=None):
    rows = [("A", "A", None, 1, "g", M, t, 0.725, 0.905, 0.1, 0.805, 0.95, age, income) for t in labels]
    return prompts.drafts(
        frame(rows, CANDIDATE), frame([(rentals,)], "rental_products string"), frame([(calls,)], "call_context string")
    )


def test_every_template_has_its_sections(frame):
    labels = [label for _, label in fv.ALERT_LABELS]
    got = {r.alert_type: r.prompt for r in drafted(frame, labels).collect()}
    for members, label in fv.ALERT_LABELS:
        text, template = got[label], fv.PROMPT_TEMPLATES[label]
        lines = text.split("\n")
        assert lines[:3] == [fv.PROMPT_OPENING, "", "[지역] A (2024-03)"]
        assert lines[3] == "[고객] 30-40대 / " + ("중고소득" if "price" in members else "중소득")
        assert ("[인기상품] 정수기·비데·공기청정기 중 하나 반드시 언급" in lines) == template.get("rental", False)
        assert "[수요강도] " + template["demand"] in lines
        assert ("{" in text) is False
        tags = [line[1 : line.index("]")] for line in lines if line.startswith("[")]
        assert tags == [
            t
            for t in ("지역", "고객", "경보강도", "시장신호", "수요강도", "인기상품", "서비스", "조건", "금지")
            if (t != "시장신호" or "market" in template)
            and (t != "인기상품" or template.get("rental"))
            and (t != "조건" or "condition" in template)
        ]


def test_numbers_and_context_in_a_prompt(frame):
    (r,) = drafted(frame, ["3중 동시 경보"], "P1·P2", "전화 많음", "20대 중심", "고소득 지역").collect()
    assert r.prompt.split("\n")[2:] == [
        "[지역] A (2024-03)",
        "[고객] 20대 중심 / 고소득 지역",
        "[경보강도] 상위 28% 수준 (시세·전입인구·통신 3중 동시 이상)",
        "[시장신호] 시세 91%ile / 전입인구 10%ile / 통신개통 81%ile",
        "[수요강도] 전화 많음",
        "[인기상품] P1·P2 중 하나 반드시 언급",
        "[서비스] 이달 개통 시 렌탈 0원 + 기가 인터넷 결합",
        "[금지] 설명 문장, 큰따옴표, 부가 설명 금지. 문구만.",
    ]


def test_null_label_uses_the_default_template(frame):
    (known, unknown) = (r.prompt for r in drafted(frame, ["통신 경보", None]).collect())
    assert known == unknown and "통신 개통 상위 81%ile 급증" in known


def test_empty_contexts_keep_the_alerts(frame):
    rows = [("A", "A", None, 1, "g", M, "시세 경보", 0.5, 0.9, 0.5, 0.5, 0.5, None, None)]
    none = frame([], RENTAL)
    rentals = context.top_rentals_text(context.rental_trend(none, ContextSpec()), ContextSpec())
    center = context.call_center_context(frame([], CALLS), frame([], CONVERSION), ContextSpec())
    calls = context.call_context_text(center, ContextSpec())
    (r,) = prompts.drafts(frame(rows, CANDIDATE), rentals, calls).collect()
    assert r.trending_rentals is None and "프리미엄 문의 증가" in r.prompt


@pytest.mark.parametrize(
    "response,text",
    [
        ('{"choices":[{"messages":"문구"}]}', "문구"),
        ('{"choices":[{"other":"x"}]}', None),
        ('{"choices":[]}', None),
        ("{broken", None),
        (None, None),
    ],
)
def test_reply_path(frame, response, text):
    (r,) = prompts.copy_text(frame([(response,)], "response string")).collect()
    assert r.marketing_copy == text


@pytest.mark.parametrize(
    "text,reasons",
    [
        ("A 특가", ""),
        ("A" * 40, ""),
        ("A" * 41, "too_long"),
        ("특가", "no_region"),
        ('A "특가"', "quotes"),
        ("A\n특가", "many_lines"),
        ("", "empty,no_region"),
        (None, "empty"),
    ],
)
def test_copy_rules(frame, text, reasons):
    df = frame([("A", "A", M, text)], "region_key string, sgg string, alert_date date, marketing_copy string")
    (r,) = prompts.copy_check(df).collect()
    assert (r.is_valid, r.reasons) == (reasons == "", reasons)


# ---- dashboard reads -----------------------------------------------------------------------------------------------

TIMESERIES = (
    "region_key string, sgg string, emd string, ts date, signal_type string, actual_value double, "
    "forecast_value double, percentile double, is_anomaly boolean"
)


def test_region_lookup_and_district_lookup(frame):
    rows = [
        ("A", "A", None, M, "pop", 1.0, 1.0, 0.5, False),
        ("A_x", "A", "x", M, "price", 1.0, 1.0, 0.4, False),
        ("A_y", "A", "y", M, "price", 3.0, 1.0, 0.8, True),
        ("B", "B", None, M, "pop", 1.0, 1.0, 0.5, False),
    ]
    ts = frame(rows, TIMESERIES)
    assert [r.signal_type for r in marts.signal_lookup(ts, "A").collect()] == ["pop"]
    assert marts.signal_lookup(ts, "A", "price").count() == 0
    got = {r.signal_type: r for r in marts.signal_lookup_district(ts, "A").collect()}
    assert got["price"].actual_value == 2.0 and got["price"].percentile == pytest.approx(0.6) and got["price"].is_anomaly


def test_filters_are_optional(frame):
    rows = [("A", "A", M, "x", 0.5), ("B", "B", M, "y", 0.2), ("B", "B", M, None, 0.9)]
    df = frame(rows, ALERT)
    assert marts.alerts_filtered(df).count() == 3
    assert marts.alerts_filtered(df, sgg="B").count() == 2
    assert marts.alerts_filtered(df, alert_type="y").count() == 1
    assert marts.alerts_filtered(df, score_min=0.5).count() == 2
    assert marts.alerts_filtered(df, sgg="' OR 1=1").count() == 0


def test_detail_placeholders(frame):
    schema = ALERT + (
        ", price_score double, pop_score double, telecom_score double, card_score double, dominant_age_group string"
        ", income_profile string, trending_rentals string, marketing_copy string"
    )
    df = frame([("A_x", "A", M, "t", 0.5, 0.1, 0.2, 0.3, 0.4, None, "", "r", None)], schema)
    (r,) = marts.alert_detail(df, "A_x", M).collect()
    assert (r.region, r.title) == ("A x", "A_x  2024-03  (0.500)  [t]")
    assert (r.dominant_age_group, r.income_profile, r.trending_rentals, r.marketing_copy) == ("-", "-", "r", "문구 없음")


def test_parameters_change_results(frame):
    wide = replace(S, signals=tuple(replace(s, low=0.05, high=0.95) for s in default_signals()))
    rows = frame([score("pop", 0.9)], SCORES)
    assert not fuse.signal_flags(rows, wide).first().flagged
    assert fuse.signal_flags(rows, S).first().flagged and fuse.signal_flags(rows, S).first().direction == "up"
    assert Cutoff(M).late_districts == ()


def test_short_districts_fall_back_to_one_series(frame):
    def months(n):
        return [dt.date(2000 + i // 12, i % 12 + 1, 1) for i in range(n)]

    rows = [(d, "서울", "A", e, "emd", p) for d in months(24) for e, p in (("x", 1.0), ("y", 2.0), ("y", 6.0))]
    rows += [(d, "서울", "B", e, "emd", p) for d in months(3) for e, p in (("x", 1.0), ("y", 2.0), ("y", 6.0))]
    price = frame(rows, PRICE)
    got = series.price_series(price, replace(S, grain_fallback=True)).where("ts = date '2000-01-01'").collect()
    assert sorted((r.series, r.sgg, r.emd, r.y) for r in got if r.emd) == [("A_x", "A", "x", 1.0), ("A_y", "A", "y", 4.0)]
    assert [(r.series, r.sgg, r.emd, r.y) for r in got if r.emd is None] == [("B", "B", None, 3.0)]


def test_result_tables_with_a_series_key(frame):
    schema = "series string, ts date, y double, forecast double, percentile double, is_anomaly boolean"
    results = frame([("A_x", M, 1.0, 2.0, 0.9, False)], schema)
    price = fuse.scores_from_results(results, "price", S).first()
    pop = fuse.scores_from_results(results, "pop", S).first()
    assert (price.signal, price.sgg, price.emd) == ("price", "A", "x")
    assert (pop.signal, pop.sgg, pop.emd) == ("pop", "A_x", None)
