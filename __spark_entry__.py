
from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle.statements import STATEMENTS, statement  # noqa: E402
from tidewatch.functions import exprs as X  # noqa: E402
from tidewatch.operators import checks, context, detect, fuse, key_match, marts, partials, profile, prompts  # noqa: E402
from tidewatch.operators import select, sketches, state_space  # noqa: E402
from tidewatch.operators import series as series_ops  # noqa: E402
from tidewatch.plans.pipeline import Pipeline  # noqa: E402
from tidewatch.sources.catalog import sample_scan  # noqa: E402
from tidewatch.sources.star import STAR_SETTINGS, StarSources  # noqa: E402

try:  # the operators of a training-data pipeline, with their own queries, may be absent
    import corpus_pipeline
    from tidewatch.llm.queries import ORACLE as LLM_ORACLE
    from tidewatch.llm.queries import QUERIES as LLM_QUERIES

    LLM_QUERIES = {**LLM_QUERIES, "pipeline": corpus_pipeline.run}
    if corpus_pipeline.ORACLE_SQL:
        LLM_ORACLE = {**LLM_ORACLE, "pipeline": corpus_pipeline.ORACLE_SQL}
except ModuleNotFoundError as absent:
    if (absent.name or "").partition(".llm")[0] not in ("corpus_pipeline", "tidewatch"):
        raise
    LLM_QUERIES, LLM_ORACLE = {}, {}

S = STAR_SETTINGS
SMALLEST = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    """Fused alerts on the smallest tables."""
    return Pipeline(StarSources(spark, SMALLEST), S).region_alerts


def _scores_of(signal: str):
    return lambda p: p.scores_of(signal)


def _series_of(signal: str):
    return lambda p: p.series_of(signal)


def _price_fallback(p: Pipeline) -> DataFrame:
    """Districts stay at sub-district grain only when all their series have 60 months, so that some fall back."""
    return series_ops.price_series(p.sources["price"], replace(S, grain_fallback=True, grain_points=60), min_share=1.0)


def _series_key_parts(p: Pipeline) -> DataFrame:
    """Score rows rebuilt from a result table that only has the series key."""
    results = p.scores_of("price").drop("signal", "sgg", "emd")
    return fuse.scores_from_results(results, "price", S)


def _stored_model(p: Pipeline) -> DataFrame:
    detect_rows = p.series.where(~F.col("is_train"))
    return detect.score_with_model(detect_rows, p.model, S.detector)


def _model_params(p: Pipeline) -> DataFrame:
    half = (F.col("n_train") / 2).cast("int")
    middle = F.element_at("history", half + 1)
    median = F.when(F.col("n_train") % 2 == 1, middle).otherwise((F.element_at("history", half) + middle) / 2)
    rounded = [X.half_up(F.col(c), 4).alias(c) for c in ("mean_y", "stddev_y", "slope", "intercept")]
    return p.model.where(F.col("n_train") > 1).select(
        "signal", "series", "n_train", "first_ts", "last_ts", *rounded, median.alias("median_y")
    )


TREND = replace(S.detector, method="trend")


def _trend(p: Pipeline) -> DataFrame:
    return _rounded_scores(detect.score_trend(p.series, TREND))


def _trend_stored_model(p: Pipeline) -> DataFrame:
    return _rounded_scores(detect.score_with_model(p.series.where(~F.col("is_train")), p.model, TREND))


STATE = replace(S.detector, method="state")


def _state(p: Pipeline) -> DataFrame:
    return _rounded_scores(state_space.score(p.series, STATE))


def _state_stored_model(p: Pipeline) -> DataFrame:
    """Scores from a model that was fitted with the first months and advanced by the others."""
    train = p.series.where(F.col("is_train"))
    first = F.col("ts") < dt.date(1997, 1, 1)
    model = state_space.advance(state_space.fit(train.where(first), STATE), train.where(~first), STATE)
    return _rounded_scores(state_space.score_with_model(p.series.where(~F.col("is_train")), model, STATE))


def _sketched_model(p: Pipeline) -> DataFrame:
    """Scores from sketches of two parts of the history, merged; histories of this length are exact in them."""
    train = p.series.where(F.col("is_train"))
    first = F.col("ts") < dt.date(1997, 1, 1)
    parts = sketches.fit_history(train.where(first)).unionAll(sketches.fit_history(train.where(~first)))
    detect_rows = p.series.where(~F.col("is_train"))
    return _rounded_scores(sketches.score_with_history(detect_rows, sketches.merged_history(parts), S.detector))


def _telecom_from_partials(p: Pipeline) -> DataFrame:
    """The telecom mart from partial rows of odd and even months that were made apart and merged."""
    telecom = p.sources["telecom"]
    odd = F.month("ts") % 2 == 1
    parts = [partials.telecom_partials(telecom.where(c), S.source) for c in (odd, ~odd)]
    return partials.telecom_trend_of(parts[0].unionAll(parts[1]))


def _rounded_scores(scores: DataFrame) -> DataFrame:
    return scores.select(
        "signal",
        "series",
        "ts",
        "y",
        X.half_up(F.col("forecast"), 4).alias("forecast"),
        X.half_up(F.col("percentile"), 6).alias("percentile"),
    )


def _alert_detail(p: Pipeline) -> DataFrame:
    """One alert; the key goes to the drafts, so no other text is asked for."""
    region, month = "NATION_1", dt.date(2001, 3, 1)
    picked = p.marketing_of(F.col("region_key") == region, F.col("alert_date") == month)
    return marts.alert_detail(picked, region, month)


def _combined(p: Pipeline) -> DataFrame:
    regions = fuse.scored_regions(fuse.signals_joined(p.scores, S), S)
    return regions.select("sgg", "alert_date", *[f"{s.name}_part" for s in S.signals], "combined_score")


def _labels(p: Pipeline) -> DataFrame:
    regions = fuse.labelled(fuse.scored_regions(fuse.signals_joined(p.scores, S), S), S)
    return regions.select("sgg", "alert_date", *[f"{s.name}_is_anomaly" for s in S.signals], "flag_mask", "alert_type")


def _top_k(p: Pipeline) -> DataFrame:
    points = p.scores_of("price").select(
        "sgg", "series", "ts", "percentile", F.abs(F.col("percentile") - 0.5).alias("distance")
    )
    return select.top_k_per_group(points, ["sgg"], [F.col("distance").desc(), F.col("ts"), F.col("series")], 15)


def _month_key(p: Pipeline) -> DataFrame:
    started = X.month_of(F.col("o_orderdate")).alias("month_start")
    months = p.sources.table("orders").groupBy(started).agg(F.count("*").alias("row_count"))
    code = X.month_code(F.col("month_start"))
    return months.select(
        "month_start",
        code.alias("month_code"),
        X.month_text(F.col("month_start")).alias("ym"),
        X.month_from_code(code).alias("from_code"),
        "row_count",
    )


def _key_reconciliation(p: Pipeline) -> DataFrame:
    src = p.sources
    area = X.region_key("|", F.col("sgg"), F.col("emd"))
    master_area = X.region_key("|", F.col("city_kor_name"), F.col("district_kor_name"))
    newest_income = profile.latest_period(src["income"], "standard_year_month")
    code = F.col("district_code")
    return checks.key_reconciliation(
        [
            ("telecom city / district", src["telecom"], F.col("install_city"), src["district"], F.col("city_kor_name")),
            ("price area / district", src["price"], area, src["district"], master_area),
            ("card code / income code", src["card"], code, newest_income, code),
        ]
    )


def _key_suggestions(p: Pipeline) -> DataFrame:
    """Areas of the prices against the master's, as another system may spell them: a third of the names lack a letter."""
    src = p.sources
    area = X.region_key("|", F.col("sgg"), F.col("emd"))
    master = X.region_key(" ", F.initcap("city_kor_name"), F.initcap("district_kor_name"))
    shorter = F.when(F.col("district_code") % 3 == 0, F.substring(master, F.lit(1), F.length(master) - 1)).otherwise(master)
    return key_match.key_suggestions(
        [
            ("price area / district", src["price"], area, src["district"], shorter),
            ("price area / city", src["price"], area, src["telecom"], F.col("install_city")),
        ]
    )


QUERIES: dict[str, Callable[[Pipeline], DataFrame]] = {
    # series
    "price_series": _series_of("price"),
    "pop_series": _series_of("pop"),
    "telecom_series": _series_of("telecom"),
    "card_series": _series_of("card"),
    "filter_level": lambda p: series_ops.filter_population(p.sources["population"], S.source).select(
        "ts", "sgg", "movement_type", "population"
    ),
    "month_key": _month_key,
    "group_split": lambda p: checks.group_split(p.sources["price"], S),
    "train_detect_split": lambda p: p.series.select("signal", "series", "ts", "cutoff", "is_train"),
    "split_violations": lambda p: series_ops.split_check(p.series),
    "series_length": lambda p: series_ops.series_length(p.sources["price"], S),
    "grain_choice": lambda p: series_ops.grain_choice(p.sources["price"], S),
    "price_series_fallback": _price_fallback,
    "series_densified": lambda p: series_ops.densified(p.series, S).select("signal", "series", "ts", "y", "is_train"),
    # scores
    "model_params": _model_params,
    "anomaly_price": _scores_of("price"),
    "anomaly_pop": _scores_of("pop"),
    "anomaly_telecom": _scores_of("telecom"),
    "anomaly_card": _scores_of("card"),
    "anomaly_stored_model": _stored_model,
    "anomaly_trend": _trend,
    "anomaly_trend_stored_model": _trend_stored_model,
    "anomaly_state": _state,
    "anomaly_state_stored_model": _state_stored_model,
    "anomaly_sketched_model": _sketched_model,
    # fusion
    "series_key_parts": _series_key_parts,
    "price_rollup": lambda p: fuse.price_rollup(p.scores_of("price"), S),
    "price_rollup_by_share": lambda p: fuse.price_rollup(p.scores_of("price"), replace(S, flag_share=0.6)),
    "signal_flags": lambda p: fuse.signal_flags(p.scores, S),
    "signals_joined": lambda p: fuse.signals_joined(p.scores, S),
    "combined_score": _combined,
    "alert_label": _labels,
    "region_alerts": lambda p: p.region_alerts,
    # districts
    "latest_period": lambda p: profile.latest_period(p.sources["income"], "standard_year_month").select(
        "standard_year_month", "district_code", "age_group", "rate_income_over_70m"
    ),
    "age_band_counts": lambda p: profile.age_band_counts(p.sources["income"]),
    "customer_profile": lambda p: p.customer_profile,
    "sgg_geometry": lambda p: p.sgg_geometry,
    "sgg_profile": lambda p: p.sgg_profile,
    # selection
    "dedup_best": lambda p: select.dedup_best(p.region_alerts, S.selection),
    "topk_per_group": _top_k,
    "alert_candidates": lambda p: p.candidates,
    "top_alerts": lambda p: marts.top_alerts(p.alerts),
    # context
    "last_n_months": lambda p: profile.last_n_months(p.sources["rental"], "ts", 3)
    .groupBy("ts")
    .agg(F.count("*").alias("row_count")),
    "rental_trend": lambda p: p.rental_trend,
    "top_rentals": lambda p: context.top_rentals(p.rental_trend),
    "top_rentals_text": lambda p: p.rentals_text,
    "rental_top10": lambda p: context.rental_top10(p.rental_trend),
    "category_totals": lambda p: context.category_totals(p.sources["rental"]),
    "call_center_context": lambda p: p.call_center,
    "call_context_text": lambda p: p.calls_text,
    "latest_call_rows": lambda p: context.latest_call_rows(p.call_center),
    "call_cvr_rows": lambda p: context.call_cvr_rows(p.call_center),
    "traffic_snapshot": lambda p: p.traffic_snapshot,
    # prompts
    "alert_scores": lambda p: p.alert_scores,
    "marketing_prompts": lambda p: p.drafts.select("region_key", "sgg", "alert_date", "alert_type", "prompt"),
    "prompt_messages": lambda p: p.drafts.select("region_key", "sgg", "alert_date", "messages", "temperature"),
    "copy_text": lambda p: prompts.copy_text(p.responses).select("region_key", "alert_date", "marketing_copy"),
    "copy_check": lambda p: p.copy_check,
    "marketing_alerts": lambda p: p.marketing_alerts,
    "copy_preview": lambda p: marts.copy_preview(p.marketing_alerts),
    # marts
    "signal_timeseries": lambda p: p.signal_timeseries,
    "sgg_summary": lambda p: p.sgg_summary,
    "sgg_summary_sorted": lambda p: marts.sgg_summary_sorted(p.sgg_summary),
    "sgg_summary_top10": lambda p: marts.sgg_summary_sorted(p.sgg_summary, 10),
    "sgg_summary_by_flags": lambda p: marts.sgg_summary(p.alerts, by_flags=True),
    "telecom_trend_profile": lambda p: marts.telecom_trend_profile(p.telecom_trend),
    "telecom_trend": lambda p: p.telecom_trend,
    "telecom_trend_by_parts": _telecom_from_partials,
    "sgg_summary_by_parts": lambda p: partials.sgg_summary_of(partials.alert_partials(p.alerts)),
    "alert_type_counts": lambda p: marts.alert_type_counts(p.alerts),
    "alerts_mart": lambda p: marts.alerts_mart(p.marketing_alerts),
    "alerts_filtered": lambda p: marts.alerts_filtered(p.alert_scores, alert_type="4중 동시 경보", score_min=0.6),
    "alert_kpis": lambda p: marts.alert_kpis(p.alert_points),
    "top_regions": lambda p: marts.top_regions(p.alert_points),
    "score_long": lambda p: marts.score_long(p.alert_points),
    "score_distribution": lambda p: marts.score_distribution(p.alert_points),
    "type_summary": lambda p: marts.type_summary(p.alert_points),
    "type_summary_long": lambda p: marts.type_summary_long(marts.type_summary(p.alert_points)),
    "signal_heatmap": lambda p: marts.signal_heatmap(p.sgg_summary),
    "alert_list": lambda p: marts.alert_list(p.alert_scores),
    "alert_detail": _alert_detail,
    "labels_present": lambda p: marts.labels_present(p.alert_points),
    "alerts_by_label": lambda p: marts.alerts_by_label(p.marketing_alerts),
    "marketing_type_counts": lambda p: marts.alert_type_counts(p.marketing_alerts),
    "filter_options": lambda p: marts.filter_options(p.alert_points),
    "signal_lookup": lambda p: marts.signal_lookup(p.signal_timeseries, "NATION_3", signals=S.signals),
    "signal_chart": lambda p: marts.signal_chart(marts.signal_lookup(p.signal_timeseries, "NATION_3", "pop")),
    "signal_lookup_district": lambda p: marts.signal_lookup_district(p.signal_timeseries, "NATION_3"),
    "telecom_lookup": lambda p: marts.telecom_lookup(p.telecom_trend, "NATION_7"),
    # checks
    "table_profile": lambda p: checks.table_profile(p.series),
    "table_profile_sketched": lambda p: sketches.profile_of(sketches.profile_sketches(p.series)),
    "score_validation": lambda p: checks.score_validation(p.scores),
    "expectations": lambda p: p.expectations,
    "score_range": lambda p: checks.score_range(p.alerts),
    "profile_coverage": lambda p: checks.profile_coverage(p.customer_profile),
    "key_mismatches": lambda p: checks.key_mismatches(
        p.sources["card"], F.col("district_code"), p.sources["district"], F.col("district_code")
    ),
    "key_reconciliation": _key_reconciliation,
    "key_suggestions": _key_suggestions,
    "key_mapping": lambda p: key_match.key_mapping(_key_suggestions(p), "price area / district"),
    "coverage_by_city": lambda p: checks.coverage_by_city(p.sources["telecom"]),
    "date_range": lambda p: checks.date_range(p.sources["price"], ["NATION_3", "NATION_11", "NATION_19"]),
    "distinct_values": lambda p: checks.distinct_values(p.sources["telecom"], "install_city"),
    "sample_scan": lambda p: sample_scan(
        p.sources["price"].select("ts", "sgg", "emd", "price"), 3, F.col("sgg") == "NATION_3", ["ts", "emd", "price"]
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query as a function of the session and the table directory."""

    def bind(build):
        return lambda spark, sf_dir: build(Pipeline(StarSources(spark, sf_dir), S))

    return {name: bind(build) for name, build in QUERIES.items()} | LLM_QUERIES


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the same result for each query."""
    return {name: statement(name) for name in QUERIES if name in STATEMENTS} | LLM_ORACLE
