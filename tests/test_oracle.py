"""Every registered query against DuckDB.

All queries run over one stored pipeline, so the tables are built once; a few also run the lazy way the driver does.
"""

from __future__ import annotations

import pytest
from compare import connect, differences
from conftest import SF

import __spark_entry__ as entry_module
from tidewatch.plans.pipeline import Pipeline
from tidewatch.plans.store import PathStore
from tidewatch.sources.star import StarSources


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    store = PathStore(spark, str(tmp_path_factory.mktemp("store")))
    return Pipeline(StarSources(spark, SF), entry_module.S, store)


def test_every_query_has_an_oracle():
    assert set(entry_module.QUERIES) == set(entry_module.STATEMENTS)
    assert set(entry_module.QUERIES) <= set(entry_module.queries()) and set(entry_module.QUERIES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", list(entry_module.QUERIES))
def test_stored(name, stored, con):
    assert differences(entry_module.QUERIES[name](stored), con, entry_module.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ["anomaly_price", "region_alerts", "marketing_alerts", "sgg_summary", "rental_trend"])
def test_lazy(name, spark, con):
    assert differences(entry_module.queries()[name](spark, SF), con, entry_module.oracle_sql()[name]) is None


def test_entry_has_the_columns_of_the_alert_table(spark, stored):
    assert entry_module.entry(spark).dtypes == stored.region_alerts.dtypes
    assert entry_module.entry(spark).count() >= 0


def test_all_labels_occur(stored):
    labels = {r.alert_type for r in stored.region_alerts.select("alert_type").distinct().collect()}
    assert labels == {label for _, label in entry_module.X.fv.ALERT_LABELS}
