"""Runs that write tables, loading of provider tables, and the reply store."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from dataclasses import replace

import pytest
from conftest import SF, SF_SMALL
from pyspark.sql import functions as F

from tidewatch.operators import completion, marts, prompts
from tidewatch.plans.pipeline import Pipeline
from tidewatch.plans.store import PathStore, TableStore
from tidewatch.sources import catalog
from tidewatch.sources.schemas import SOURCES, assert_schema, conform
from tidewatch.sources.star import ADAPTERS, STAR_SETTINGS, StarSources
from tidewatch.spec import DetectorSpec


def sorted_rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)


def test_adapters_have_canonical_columns(spark):
    sources = StarSources(spark, SF_SMALL)
    for name in ADAPTERS:
        assert_schema(sources[name], name)


def test_catalog_run_equals_the_lazy_result(spark):
    store = TableStore(spark, "tidewatch_test")
    tables = Pipeline(StarSources(spark, SF), STAR_SETTINGS, store).run()
    names = catalog.list_tables(spark, "tidewatch_test")
    assert set(names) == {
        "series", "model_params", "scores", "customer_profile", "region_alerts", "rental_trend", "call_center_context",
        "traffic_snapshot", "drafts", "marketing_alerts", "signal_timeseries", "sgg_summary", "telecom_trend",
    }
    assert catalog.list_tables(spark, "tidewatch_test", "sgg*") == ["sgg_summary"]
    lazy = Pipeline(StarSources(spark, SF), STAR_SETTINGS)
    assert sorted_rows(tables["region_alerts"]) == sorted_rows(lazy.region_alerts)
    assert sorted_rows(tables["marketing_alerts"]) == sorted_rows(lazy.marketing_alerts)
    assert dict(catalog.describe(tables["sgg_summary"]))["total_alerts"] == "bigint"
    spark.sql("DROP SCHEMA tidewatch_test CASCADE")


def test_a_second_run_asks_nothing_again(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def client(messages, options):
        name = str(abs(hash(messages[-1]["content"])))
        with open(f"{asked}/{name}", "a") as f:
            f.write("x")
        return '{"choices": [{"messages": "a text"}]}'

    store = PathStore(spark, str(tmp_path / "store"))
    first = Pipeline(StarSources(spark, SF), STAR_SETTINGS, store, client).marketing_alerts
    rows = sorted_rows(first)
    calls = sum(len(p.read_text()) for p in asked.iterdir())
    assert calls == len(rows) > 0
    second = Pipeline(StarSources(spark, SF), STAR_SETTINGS, store, client).marketing_alerts
    assert sorted_rows(second) == rows
    assert sum(len(p.read_text()) for p in asked.iterdir()) == calls


def test_broken_replies_keep_the_alert(spark, tmp_path):
    store = PathStore(spark, str(tmp_path))
    pipeline = Pipeline(StarSources(spark, SF), STAR_SETTINGS, store, lambda messages, options: "{broken")
    rows = pipeline.marketing_alerts.collect()
    assert rows and all(r.marketing_copy is None for r in rows)
    assert all(r.reasons == "empty" and not r.is_valid for r in pipeline.copy_check.collect())


def test_template_reply_is_whole_and_can_break_a_rule(spark):
    prompt = "x\n\n[지역] 서초구 (2024-03)\n[서비스] " + "가" * 60
    drafted = spark.createDataFrame([("서초구", prompt), ("중구", "[지역] 중구 (2024-03)\n[서비스] 짧은 글")], "sgg string, prompt string")
    drafted = drafted.selectExpr("sgg as region_key", "sgg", "date '2024-03-01' as alert_date", "prompt")
    replied = drafted.withColumn("response", completion.template_reply(drafted["prompt"]))
    rows = {r.sgg: r for r in prompts.copy_check(prompts.copy_text(replied)).collect()}
    assert rows["서초구"].marketing_copy == "서초구 " + "가" * 60 and rows["서초구"].reasons == "too_long"
    assert rows["중구"].marketing_copy == "중구 짧은 글" and rows["중구"].is_valid


def test_every_rule_can_be_broken(spark):
    texts = {"empty": "", "no_region": "elsewhere", "too_long": "A" + "x" * 40, "many_lines": "A\nx", "quotes": 'A "x"'}
    rows = spark.createDataFrame([("A", t) for t in texts.values()], "sgg string, marketing_copy string")
    rows = rows.selectExpr("sgg as region_key", "sgg", "date '2024-03-01' as alert_date", "marketing_copy")
    found = {r.marketing_copy: r.reasons.split(",") for r in prompts.copy_check(rows).collect()}
    assert all(rule in found[text] for rule, text in texts.items())


def counting(folder, fails_at=None):
    """A client that writes a letter to a file for every request, and the number of requests so far."""
    folder.mkdir()
    place = str(folder)

    def client(messages, options):
        if fails_at and fails_at in messages[-1]["content"]:
            raise RuntimeError("no answer")
        with open(f"{place}/{hashlib.sha256(messages[-1]['content'].encode()).hexdigest()}", "a") as f:
            f.write("x")
        return '{"choices": [{"messages": "a text"}]}'

    return client, lambda: sum(len(p.read_text()) for p in folder.iterdir())


@pytest.mark.parametrize("read", ["alerts_mart", "copy_preview", "alerts_by_label"])
def test_each_draft_is_asked_once(spark, tmp_path, read):
    client, calls = counting(tmp_path / "asked")
    pipeline = Pipeline(StarSources(spark, SF), STAR_SETTINGS, PathStore(spark, str(tmp_path / "store")), client)
    rows = getattr(marts, read)(pipeline.marketing_alerts).collect()
    assert calls() == len(rows) > 0


def test_one_alert_asks_for_one_text(spark, tmp_path):
    client, calls = counting(tmp_path / "asked")
    pipeline = Pipeline(StarSources(spark, SF), STAR_SETTINGS, PathStore(spark, str(tmp_path / "store")), client)
    key = pipeline.drafts.select("region_key", "alert_date").first()
    picked = pipeline.marketing_of(F.col("region_key") == key[0], F.col("alert_date") == key[1])
    assert len(marts.alert_detail(picked, *key).collect()) == 1 and calls() == 1


def test_replies_of_earlier_waves_survive_a_failure(spark, tmp_path):
    store, waves = PathStore(spark, str(tmp_path / "store")), replace(STAR_SETTINGS, request_waves=4)
    last = completion.in_waves(Pipeline(StarSources(spark, SF), waves).drafts, 4)[3].select("sgg").first()[0]
    failing, _ = counting(tmp_path / "asked", fails_at=f"[지역] {last} (")
    with pytest.raises(Exception, match="no answer"):
        Pipeline(StarSources(spark, SF), waves, store, failing).marketing_alerts
    kept = store.read("responses").count()
    assert kept > 0
    client, calls = counting(tmp_path / "asked_again")
    rows = Pipeline(StarSources(spark, SF), waves, store, client).marketing_alerts.count()
    assert calls() == rows - kept


def test_a_client_needs_a_store(spark):
    with pytest.raises(ValueError, match="store"):
        Pipeline(StarSources(spark, SF), STAR_SETTINGS, client=lambda messages, options: "")


def test_stored_marts_are_read_without_sources(spark, tmp_path):
    store = PathStore(spark, str(tmp_path))
    made = Pipeline(StarSources(spark, SF_SMALL), STAR_SETTINGS, store).run()
    again = Pipeline({}, STAR_SETTINGS, store, reuse=True)
    for name in ("region_alerts", "marketing_alerts", "signal_timeseries", "sgg_summary", "telecom_trend", "rental_trend"):
        assert sorted_rows(getattr(again, name)) == sorted_rows(made[name]), name
    assert sorted_rows(marts.alerts_mart(again.marketing_of())) == sorted_rows(marts.alerts_mart(made["marketing_alerts"]))


def test_requests_get_messages_and_options(spark):
    seen = spark.createDataFrame([("k", '[{"role":"user","content":"hi"}]', 0.9)], "region_key string, messages string, temperature double")
    seen = seen.selectExpr("region_key", "date '2024-01-01' as alert_date", "messages", "temperature")
    echo = completion.complete(seen, lambda messages, options: json.dumps([messages, options]), parallelism=2)
    assert json.loads(echo.first().response) == [[{"role": "user", "content": "hi"}], {"temperature": 0.9}]


@pytest.mark.parametrize("day", [dt.date(2024, 3, 1), "2024-03-01", "20240301", 20240301, dt.datetime(2024, 3, 1)])
def test_provider_columns_and_dates(spark, day):
    raw = spark.createDataFrame(
        [(day, "서울", "강남구", "역삼동", "emd", 5000)],
        ["YYYYMMDD", "SD", "SGG", "EMD", "REGION_LEVEL", "MEME_PRICE_PER_SUPPLY_PYEONG"],
    )
    df = conform(raw, "price")
    assert_schema(df, "price")
    assert tuple(df.first()) == (dt.date(2024, 3, 1), "서울", "강남구", "역삼동", "emd", 5000.0)


EVERY_TABLE = (
    "series", "model", "scores", "customer_profile", "region_alerts", "rental_trend", "call_center", "traffic_snapshot",
    "drafts", "marketing_alerts", "signal_timeseries", "sgg_summary", "telecom_trend", "expectations",
)


def test_all_sources_empty(spark):
    empty = {name: spark.createDataFrame([], schema) for name, schema in SOURCES.items()}
    pipeline = Pipeline(empty, STAR_SETTINGS)
    assert {name: getattr(pipeline, name).count() for name in EVERY_TABLE} == dict.fromkeys(EVERY_TABLE, 0)


@pytest.mark.parametrize("absent", list(SOURCES))
def test_one_source_empty(spark, absent):
    class Sources(StarSources):
        def __missing__(self, name):
            if name == absent:
                self[name] = spark.createDataFrame([], SOURCES[name])
                return self[name]
            return super().__missing__(name)

    # The smallest tables have short series.
    short = replace(STAR_SETTINGS, detector=DetectorSpec(min_points=6))
    drafts = Pipeline(Sources(spark, SF_SMALL), short).drafts.select("region_key", "prompt").collect()
    assert (len(drafts) == 0) == (absent == "population")
    assert all(r.prompt for r in drafts)


def test_missing_columns_are_an_error(spark):
    with pytest.raises(ValueError, match="missing columns"):
        conform(spark.createDataFrame([(1,)], ["SD"]), "price")
    with pytest.raises(ValueError, match="expected columns"):
        assert_schema(spark.createDataFrame([(1,)], ["SD"]), "price")


def test_sources_from_paths_and_tables(spark, tmp_path):
    made = StarSources(spark, SF_SMALL)["district"]
    made.write.parquet(f"{tmp_path}/district")
    made.createOrReplaceTempView("district_view")
    loaded = catalog.load_sources(spark, {"district": f"{tmp_path}/district"})
    viewed = catalog.load_sources(spark, {"district": "district_view"})
    assert sorted_rows(loaded["district"]) == sorted_rows(viewed["district"]) == sorted_rows(made)
    with pytest.raises(ValueError, match="unknown sources"):
        catalog.load_sources(spark, {"weather": "x"})
