"""One statement per registered query."""

from __future__ import annotations

import re

from oracle.views import ALERT_COLUMNS, CTES, LATE, OUT, RECURSIVE, half_up, mean, month
from tidewatch.functions import fixed_values as fv

SCORE_COLUMNS = ("signal", "series", "sgg", "emd", "ts", "y", "forecast", "percentile", "is_anomaly")
FIVE = ("combined_score", "price_score", "pop_score", "telecom_score", "card_score")
LABELS = tuple(label for _, label in fv.ALERT_LABELS)
ORDINAL = "CAST(CASE alert_type " + " ".join(f"WHEN '{x}' THEN {i + 1}" for i, x in enumerate(LABELS)) + " END AS BIGINT)"


def _series(signal: str) -> str:
    return f"SELECT * FROM series WHERE signal = '{signal}'"


def _scores(signal: str) -> str:
    return f"SELECT {', '.join(SCORE_COLUMNS)} FROM scores WHERE signal = '{signal}'"


STATEMENTS: dict[str, str] = {
    # series
    "price_series": _series("price"),
    "pop_series": _series("pop"),
    "telecom_series": _series("telecom"),
    "card_series": _series("card"),
    "filter_level": """
        SELECT ts, sgg, movement_type, CAST(population AS DOUBLE) AS population FROM population_src
        WHERE movement_type = 'F'""",
    "month_key": f"""
        SELECT month_start, CAST(strftime(month_start, '%Y%m') AS INTEGER) AS month_code,
               strftime(month_start, '%Y-%m') AS ym, month_start AS from_code, count(*) AS row_count
        FROM (SELECT {month("o_orderdate")} AS month_start FROM orders) GROUP BY month_start""",
    "group_split": f"""
        SELECT CASE WHEN sgg IN {LATE} THEN 'late' ELSE 'main' END AS cut_group, sgg, count(*) AS row_count
        FROM price_src GROUP BY sgg""",
    "train_detect_split": "SELECT signal, series, ts, cutoff, is_train FROM series",
    "split_violations": """
        SELECT signal, series, max(ts) FILTER (WHERE is_train) AS last_train,
               min(ts) FILTER (WHERE NOT is_train) AS first_detect,
               coalesce(max(ts) FILTER (WHERE is_train) >= min(ts) FILTER (WHERE NOT is_train), false) AS violates
        FROM series GROUP BY signal, series""",
    "series_length": "SELECT sgg, emd, count(DISTINCT ts) AS data_points FROM price_src GROUP BY sgg, emd",
    "grain_choice": """
        SELECT sgg, count(*) AS n_series, count(*) FILTER (WHERE n >= 24) AS n_long_enough, min(n) AS min_points,
               CASE WHEN count(*) FILTER (WHERE n >= 24) * 2 >= count(*) THEN 'emd' ELSE 'sgg' END AS grain
        FROM (SELECT sgg, emd, count(DISTINCT ts) AS n FROM price_src GROUP BY sgg, emd) GROUP BY sgg""",
    "price_series_fallback": f"""
        SELECT 'price' AS signal, CASE WHEN whole THEN sgg ELSE sgg || '|' || emd END AS series, sgg,
               CASE WHEN whole THEN NULL ELSE emd END AS emd, ts, {mean("price")} AS y,
               CASE WHEN sgg IN {LATE} THEN 'late' ELSE 'main' END AS cut_group,
               CASE WHEN sgg IN {LATE} THEN DATE '2000-01-01' ELSE DATE '1999-01-01' END AS cutoff,
               ts < CASE WHEN sgg IN {LATE} THEN DATE '2000-01-01' ELSE DATE '1999-01-01' END AS is_train
        FROM price_src JOIN (
          SELECT sgg, min(n) < 60 AS whole
          FROM (SELECT sgg, emd, count(DISTINCT ts) AS n FROM price_src GROUP BY sgg, emd) GROUP BY sgg) USING (sgg)
        GROUP BY ALL""",
    "series_densified": """
        SELECT k.signal, k.series, k.ts, s.y, k.ts < k.cutoff AS is_train
        FROM (SELECT signal, series, any_value(cutoff) AS cutoff,
                     unnest(generate_series(min(ts), max(ts), INTERVAL 1 MONTH))::DATE AS ts
              FROM series GROUP BY signal, series) k
        LEFT JOIN series s ON k.signal = s.signal AND k.series = s.series AND k.ts = s.ts""",
    # scores
    "model_params": f"""
        SELECT f.signal, f.series, CAST(f.n AS BIGINT) AS n_train, min(t.ts) AS first_ts, max(t.ts) AS last_ts,
               {half_up("any_value(f.sy) / any_value(f.n)", 4)} AS mean_y, {half_up("stddev_samp(t.y)", 4)} AS stddev_y,
               {half_up("any_value(f.slope)", 4)} AS slope, {half_up("any_value(f.intercept)", 4)} AS intercept,
               median(t.y) AS median_y
        FROM trend_fit f JOIN train t ON f.signal = t.signal AND f.series = t.series
        GROUP BY f.signal, f.series, f.n""",
    "anomaly_price": _scores("price"),
    "anomaly_pop": _scores("pop"),
    "anomaly_telecom": _scores("telecom"),
    "anomaly_card": _scores("card"),
    "anomaly_stored_model": f"SELECT {', '.join(SCORE_COLUMNS)} FROM scores",
    "anomaly_trend": f"""
        SELECT signal, series, ts, y, {half_up("forecast", 4)} AS forecast, {half_up("percentile", 6)} AS percentile
        FROM trend_scores""",
    "anomaly_trend_stored_model": f"""
        SELECT signal, series, ts, y, {half_up("forecast", 4)} AS forecast, {half_up("percentile", 6)} AS percentile
        FROM trend_scores""",
    "anomaly_state": f"""
        SELECT signal, series, ts, y, {half_up("forecast", 4)} AS forecast, {half_up("percentile", 6)} AS percentile
        FROM state_scores""",
    "anomaly_state_stored_model": f"""
        SELECT signal, series, ts, y, {half_up("forecast", 4)} AS forecast, {half_up("percentile", 6)} AS percentile
        FROM state_scores""",
    "anomaly_sketched_model": f"""
        SELECT signal, series, ts, y, {half_up("forecast", 4)} AS forecast, {half_up("percentile", 6)} AS percentile
        FROM scores""",
    # fusion
    "series_key_parts": """
        SELECT signal, series, split_part(series, '|', 1) AS sgg, split_part(series, '|', 2) AS emd, ts, y, forecast,
               percentile, is_anomaly FROM scores WHERE signal = 'price'""",
    "price_rollup": "SELECT * FROM price_of",
    "price_rollup_by_share": f"""
        SELECT sgg, ts, {mean("percentile")} AS percentile, {mean("y")} AS actual, {mean("forecast")} AS forecast,
               coalesce(count(*) FILTER (WHERE {OUT.format("percentile")}) >= CAST(0.6 AS DOUBLE) * nullif(count(percentile), 0), false)
                 AS is_anomaly
        FROM scores WHERE signal = 'price' GROUP BY sgg, ts""",
    "signal_flags": f"""
        SELECT signal, series, sgg, ts, percentile, {OUT.format("percentile")} AS flagged,
               CASE WHEN percentile > 0.75 THEN 'up' WHEN percentile < 0.25 THEN 'down' END AS direction
        FROM scores""",
    "signals_joined": "SELECT * FROM joined",
    "combined_score": """
        SELECT sgg, alert_date, price_part, pop_part, telecom_part, card_part, combined_score FROM regions""",
    "alert_label": """
        SELECT sgg, alert_date, price_is_anomaly, pop_is_anomaly, telecom_is_anomaly, card_is_anomaly, flag_mask, alert_type
        FROM labelled""",
    "region_alerts": f"SELECT {ALERT_COLUMNS} FROM alerts",
    # districts
    "latest_period": """
        SELECT standard_year_month, district_code, age_group, rate_income_over_70m FROM income_src
        WHERE standard_year_month = (SELECT max(standard_year_month) FROM income_src)""",
    "age_band_counts": "SELECT * FROM age_bands",
    "customer_profile": "SELECT * FROM profile",
    "sgg_geometry": "SELECT * FROM geometry_of",
    "sgg_profile": "SELECT * FROM profile_of",
    # selection
    "dedup_best": f"SELECT {ALERT_COLUMNS} FROM deduped",
    "topk_per_group": """
        SELECT sgg, series, ts, percentile, abs(percentile - 0.5) AS distance FROM scores WHERE signal = 'price'
        QUALIFY row_number() OVER (PARTITION BY sgg ORDER BY abs(percentile - 0.5) DESC, ts, series) <= 15""",
    "alert_candidates": f"SELECT {ALERT_COLUMNS} FROM candidates",
    "top_alerts": f"""
        SELECT sgg, alert_type, {half_up("combined_score", 3)} AS score, alert_date FROM alerts
        ORDER BY combined_score DESC, sgg, alert_date LIMIT 15""",
    # context
    "last_n_months": """
        SELECT ts, count(*) AS row_count FROM rental_src
        WHERE ts >= (SELECT max(ts) FROM rental_src) - INTERVAL 3 MONTH GROUP BY ts""",
    "rental_trend": "SELECT * FROM rentals",
    "top_rentals": "SELECT * FROM rentals WHERE rank_num <= 5",
    "top_rentals_text": "SELECT * FROM rentals_text",
    "rental_top10": """
        SELECT rental_main_category, rental_sub_category, total_open, avg_cvr_pct AS cvr_pct, rank_num
        FROM rentals WHERE rank_num <= 10""",
    "category_totals": """
        SELECT rental_main_category, rental_sub_category, count(*) AS total_open FROM rental_src GROUP BY ALL
        ORDER BY total_open DESC, rental_main_category, rental_sub_category LIMIT 20""",
    "call_center_context": "SELECT * FROM call_center",
    "call_context_text": "SELECT * FROM calls_text",
    "latest_call_rows": "SELECT * FROM call_rows",
    "call_cvr_rows": "SELECT * FROM call_rows WHERE call_cvr IS NOT NULL",
    "traffic_snapshot": f"""
        SELECT sgg, ts, avg_speed_kmph, probe_count,
               CASE WHEN avg_speed_kmph < 48.4 THEN '혼잡' WHEN avg_speed_kmph < 50.0 THEN '보통'
                    WHEN avg_speed_kmph IS NOT NULL THEN '원활' END AS status
        FROM (
          SELECT CASE event_type WHEN 'click' THEN 'NATION_0' WHEN 'view' THEN 'NATION_1' WHEN 'purchase' THEN 'NATION_2'
                   WHEN 'signup' THEN 'NATION_3' WHEN 'error' THEN 'NATION_4' END AS sgg,
                 {month("ts")} AS ts, {mean("value")} AS avg_speed_kmph, count(*) AS probe_count
          FROM events WHERE {month("ts")} = (SELECT max({month("ts")}) FROM events) GROUP BY 1, 2)
        WHERE sgg IS NOT NULL""",
    # prompts
    "alert_scores": "SELECT * FROM scored",
    "marketing_prompts": "SELECT * FROM prompts",
    "prompt_messages": """
        SELECT region_key, sgg, alert_date, CAST(0.9 AS DOUBLE) AS temperature,
               '[{"role":"system","content":"당신은 통신·렌탈 서비스 전문 카피라이터입니다. 반드시 지역명을 포함하고, 40자 이내의 광고 문구 한 줄만 '
               || '출력하세요. 부가 설명, 큰따옴표, 줄바꿈 없이 문구만 출력합니다."},{"role":"user","content":"'
               || replace(prompt, chr(10), '\\n') || '"}]' AS messages
        FROM prompts""",
    "copy_text": "SELECT region_key, alert_date, marketing_copy FROM copies",
    "copy_check": """
        SELECT region_key, sgg, alert_date, marketing_copy, reasons = '' AS is_valid, reasons
        FROM (SELECT *, concat_ws(',', CASE WHEN marketing_copy IS NULL OR marketing_copy = '' THEN 'empty' END,
                CASE WHEN NOT contains(marketing_copy, sgg) THEN 'no_region' END,
                CASE WHEN length(marketing_copy) > 40 THEN 'too_long' END,
                CASE WHEN contains(marketing_copy, chr(10)) OR contains(marketing_copy, chr(13)) THEN 'many_lines' END,
                CASE WHEN contains(marketing_copy, '"') THEN 'quotes' END) AS reasons
              FROM copies)""",
    "marketing_alerts": "SELECT * FROM copies",
    "copy_preview": f"""
        SELECT sgg, alert_type, {half_up("combined_score", 2)} AS score, dominant_age_group, trending_rentals,
               left(marketing_copy, 80) AS copy_preview FROM copies""",
    # marts
    "signal_timeseries": "SELECT * FROM timeseries",
    "sgg_summary": "SELECT * FROM summary",
    "sgg_summary_sorted": "SELECT * FROM summary",
    "sgg_summary_top10": "SELECT * FROM summary ORDER BY total_alerts DESC, sgg LIMIT 10",
    "sgg_summary_by_flags": f"""
        SELECT sgg, count(*) AS total_alerts, count(*) FILTER (WHERE alert_type = '{fv.QUAD_LABEL}') AS quad_alerts,
               count(*) FILTER (WHERE alert_type = '{fv.TRIPLE_LABEL}') AS triple_alerts,
               {", ".join(f"count(*) FILTER (WHERE {x}_is_anomaly) AS {x}_alerts" for x in fv.SIGNAL_WEIGHTS)},
               {half_up("max(combined_score)", 3)} AS max_score, {half_up(mean("combined_score"), 3)} AS avg_score
        FROM alerts GROUP BY sgg""",
    "telecom_trend": "SELECT * FROM trend",
    "telecom_trend_profile": "SELECT count(*) AS row_count, count(DISTINCT sgg) AS sgg_count FROM trend",
    "marketing_type_counts": "SELECT alert_type, count(*) AS cnt FROM copies GROUP BY alert_type",
    "alert_type_counts": "SELECT alert_type, count(*) AS cnt FROM alerts GROUP BY alert_type",
    "alerts_mart": """
        SELECT sgg, region_key, district_code, CAST(alert_date AS VARCHAR) AS alert_date, alert_type, combined_score,
               price_score, pop_score, telecom_score, card_score, dominant_age_group, income_profile, trending_rentals,
               marketing_copy FROM copies""",
    "alerts_filtered": "SELECT * FROM scored WHERE combined_score >= 0.6 AND alert_type = '4중 동시 경보'",
    "alert_kpis": """
        SELECT count(*) AS total_alerts, count(*) FILTER (WHERE alert_type = '4중 동시 경보') AS quad_alerts,
               max(combined_score) AS max_score, count(DISTINCT sgg) AS districts,
               count(*) FILTER (WHERE alert_type LIKE '%3중%' OR alert_type LIKE '%4중%') AS triple_or_more
        FROM scored""",
    "top_regions": """
        SELECT region_key AS region, alert_type, sgg, max(combined_score) AS combined_score
        FROM scored WHERE alert_type IS NOT NULL GROUP BY ALL
        ORDER BY combined_score DESC, region, alert_type LIMIT 25""",
    "score_long": """
        SELECT region_key, '시세' AS signal, price_score AS score FROM scored
        UNION ALL SELECT region_key, '전입인구', pop_score FROM scored
        UNION ALL SELECT region_key, '통신', telecom_score FROM scored
        UNION ALL SELECT region_key, '카드소비', card_score FROM scored""",
    "score_distribution": " UNION ALL ".join(
        f"""SELECT '{name}' AS signal, min({c}) AS low, {half_up(f"quantile_cont({c}, 0.25)", 6)} AS q1,
        {half_up(f"quantile_cont({c}, 0.5)", 6)} AS median, {half_up(f"quantile_cont({c}, 0.75)", 6)} AS q3,
        max({c}) AS high FROM scored"""
        for c, name in (
            ("price_score", "시세"), ("pop_score", "전입인구"), ("telecom_score", "통신"), ("card_score", "카드소비")
        )
    ),
    "type_summary": "SELECT * FROM type_means",
    "type_summary_long": " UNION ALL ".join(
        f"SELECT alert_type, '{name}' AS signal, {c} AS mean_score FROM type_means"
        for c, name in zip(FIVE, ("결합", "시세", "전입인구", "통신", "카드소비"))
    ),
    "signal_heatmap": """
        SELECT sgg, signal, alert_count, price_alerts + pop_alerts + telecom_alerts + card_alerts AS district_total
        FROM (SELECT *, unnest(['시세', '전입인구', '통신', '카드소비']) AS signal,
                     unnest([price_alerts, pop_alerts, telecom_alerts, card_alerts]) AS alert_count FROM summary)""",
    "alert_list": """
        SELECT region_key AS "지역", strftime(alert_date, '%Y-%m') AS "기준월", alert_type AS "경보유형",
               combined_score AS "결합점수", price_score AS "시세", pop_score AS "전입인구", telecom_score AS "통신",
               card_score AS "카드소비", dominant_age_group AS "주요연령대", income_profile AS "소득수준" FROM scored""",
    "alert_detail": """
        SELECT replace(region_key, '_', ' ') AS region,
               region_key || '  ' || strftime(alert_date, '%Y-%m') || '  (' || CAST(CAST(combined_score AS DECIMAL(10,3)) AS VARCHAR)
                 || ')  [' || alert_type || ']' AS title,
               alert_type, combined_score, price_score, pop_score, telecom_score, card_score,
               coalesce(dominant_age_group, '-') AS dominant_age_group, coalesce(income_profile, '-') AS income_profile,
               coalesce(trending_rentals, '-') AS trending_rentals, coalesce(marketing_copy, '문구 없음') AS marketing_copy
        FROM copies WHERE region_key = 'NATION_1' AND alert_date = DATE '2001-03-01'""",
    "labels_present": f"SELECT DISTINCT {ORDINAL} AS ordinal, alert_type FROM scored",
    "alerts_by_label": f"""
        SELECT {ORDINAL} AS ordinal, alert_type, region_key AS region, strftime(alert_date, '%Y-%m') AS ym, combined_score,
               coalesce(marketing_copy, '문구 없음') AS marketing_copy FROM copies""",
    "filter_options": """
        SELECT DISTINCT 'district' AS option_list, sgg AS value FROM scored
        UNION SELECT DISTINCT 'label', alert_type FROM scored WHERE alert_type IS NOT NULL
        UNION SELECT DISTINCT 'region', region_key FROM scored""",
    "signal_lookup": """
        SELECT signal_type, CASE signal_type WHEN 'price' THEN '🏠 시세' WHEN 'pop' THEN '👥 전입인구'
                 WHEN 'telecom' THEN '📱 통신 개통' WHEN 'card' THEN '💳 카드소비(가전·가구)' END AS signal_title,
               ts, actual_value, forecast_value, percentile, is_anomaly,
               CAST(0.75 AS DOUBLE) AS high_line, CAST(0.25 AS DOUBLE) AS low_line
        FROM timeseries WHERE region_key = 'NATION_3'""",
    "signal_chart": """
        SELECT signal_type, '👥 전입인구' AS signal_title, CAST(ts AS TIMESTAMP) AS ts, actual_value, forecast_value, percentile,
               is_anomaly, CAST(0.75 AS DOUBLE) AS high_line, CAST(0.25 AS DOUBLE) AS low_line
        FROM timeseries WHERE region_key = 'NATION_3' AND signal_type = 'pop'""",
    "signal_lookup_district": f"""
        SELECT signal_type, ts, {mean("actual_value")} AS actual_value, {mean("forecast_value")} AS forecast_value,
               {mean("percentile")} AS percentile, bool_or(is_anomaly) AS is_anomaly
        FROM timeseries WHERE sgg = 'NATION_3' GROUP BY signal_type, ts""",
    "telecom_lookup": """
        SELECT CAST(year_month AS VARCHAR) AS ym, main_category_name, opens, contracts FROM trend WHERE sgg = 'NATION_7'""",
    # checks
    "table_profile": """
        SELECT signal || '_' || CASE WHEN is_train THEN 'train' ELSE 'detect' END
                 || CASE WHEN cut_group = 'late' THEN '_late' ELSE '' END AS tbl,
               count(*) AS row_count, count(DISTINCT series) AS regions FROM series GROUP BY 1""",
    "score_validation": """
        SELECT signal, count(*) AS total, count(*) FILTER (WHERE is_anomaly) AS is_anomaly_true,
               min(percentile) AS min_pct, max(percentile) AS max_pct FROM scores GROUP BY signal""",
    "expectations": """
        SELECT expectation, bool_and(holds) AS holds FROM (
          SELECT 'rows in ' || signal || '_' || CASE WHEN is_train THEN 'train' ELSE 'detect' END
                 || CASE WHEN cut_group = 'late' THEN '_late' ELSE '' END AS expectation, true AS holds FROM series
          UNION ALL SELECT 'regions of telecom_' || CASE WHEN is_train THEN 'train' ELSE 'detect' END,
                 count(DISTINCT series) <= 25 FROM series WHERE signal = 'telecom' GROUP BY is_train
          UNION ALL SELECT 'percentiles of ' || signal, percentile BETWEEN 0 AND 1 FROM scores) GROUP BY expectation""",
    "score_range": """
        SELECT count(*) AS total, min(combined_score) AS min_score, max(combined_score) AS max_score FROM alerts""",
    "profile_coverage": """
        SELECT count(*) AS total_districts, count(DISTINCT sgg) AS sgg_count FROM profile""",
    "key_mismatches": """
        SELECT CAST(district_code AS VARCHAR) AS key, 'left' AS side FROM card_src
        WHERE district_code NOT IN (SELECT district_code FROM district_src)
        UNION SELECT CAST(district_code AS VARCHAR), 'right' FROM district_src
        WHERE district_code NOT IN (SELECT district_code FROM card_src)""",
    "key_reconciliation": """
        SELECT pair, count(*) FILTER (WHERE l AND r) AS in_both, count(*) FILTER (WHERE l AND NOT r) AS left_only,
               count(*) FILTER (WHERE r AND NOT l) AS right_only
        FROM (
          SELECT pair, key, bool_or(l) AS l, bool_or(NOT l) AS r FROM (
            SELECT 'telecom city / district' AS pair, install_city AS key, true AS l FROM telecom_src
            UNION ALL SELECT 'telecom city / district', city_kor_name, false FROM district_src
            UNION ALL SELECT 'price area / district', sgg || '|' || emd, true FROM price_src
            UNION ALL SELECT 'price area / district', city_kor_name || '|' || district_kor_name, false FROM district_src
            UNION ALL SELECT 'card code / income code', CAST(district_code AS VARCHAR), true FROM card_src
            UNION ALL SELECT 'card code / income code', CAST(district_code AS VARCHAR), false FROM income_src
              WHERE standard_year_month = (SELECT max(standard_year_month) FROM income_src))
          WHERE key IS NOT NULL GROUP BY pair, key)
        GROUP BY pair""",
    "key_suggestions": "SELECT pair, side, key, suggestion, distance, n_nearest FROM suggested_keys",
    "key_mapping": """
        SELECT key, suggestion AS mapped_key FROM suggested_keys s
        WHERE pair = 'price area / district' AND side = 'left' AND n_nearest = 1 AND NOT EXISTS (
          SELECT 1 FROM suggested_keys o WHERE o.pair = s.pair AND o.side = s.side AND o.n_nearest = 1
            AND o.suggestion = s.suggestion AND o.key <> s.key AND o.distance <= s.distance)""",
    "coverage_by_city": """
        SELECT install_state, install_city, min(ts) AS min_ym, max(ts) AS max_ym, count(*) AS cnt FROM telecom_src
        GROUP BY install_state, install_city ORDER BY install_state, cnt DESC, install_city LIMIT 50""",
    "date_range": f"""
        SELECT count(*) AS row_count, min(ts) AS min_ts, max(ts) AS max_ts FROM price_src WHERE sgg IN {LATE}""",
    "distinct_values": "SELECT DISTINCT install_city AS value FROM telecom_src",
    "sample_scan": """
        SELECT ts, sgg, emd, CAST(price AS DOUBLE) AS price FROM price_src WHERE sgg = 'NATION_3' ORDER BY ts, emd, price LIMIT 3""",
}


def _needed(sql: str, found: list[str], of: str | None = None) -> list[str]:
    """Names of the common table expressions a statement needs, dependencies first."""
    for name in CTES:
        if name != of and name not in found and re.search(rf"\b(FROM|JOIN) {name}\b", sql):
            _needed(CTES[name], found, name)
            if name not in found:
                found.append(name)
    return found


def statement(key: str) -> str:
    main = STATEMENTS[key]
    ctes = _needed(main, [])
    head = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in ctes)
    kind = "WITH RECURSIVE" if RECURSIVE.intersection(ctes) else "WITH"
    return (f"{kind} {head}\n" if head else "") + main.strip()


# The same results by another way.
STATEMENTS["telecom_trend_by_parts"] = STATEMENTS["telecom_trend"]
STATEMENTS["sgg_summary_by_parts"] = STATEMENTS["sgg_summary"]
STATEMENTS["table_profile_sketched"] = STATEMENTS["table_profile"]
