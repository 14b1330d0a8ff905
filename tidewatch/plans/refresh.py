"""Bringing published marts up to date by month, without reading or writing the others."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidewatch.operators import partials
from tidewatch.plans.versions import VersionedStore
from tidewatch.sources.catalog import Sources
from tidewatch.spec import Settings


def month_rows(telecom: DataFrame, months: Sequence[dt.date], settings: Settings) -> DataFrame:
    """Partial rows of the telecom mart for some months, from those months' source rows alone."""
    return partials.telecom_partials(partials.of_months(telecom, months), settings.source)


def refresh_months(sources: Sources, settings: Settings, store: VersionedStore, months: Sequence[dt.date]) -> int:
    """Publishes a version in which some months of the telecom mart are made again; all else stays as it was.

    months name what has changed: new months, or months that rows came late for or were taken from. Only their source rows
    are read, and only their parts are written; a month without rows has no part any more.
    """
    firsts = sorted({m.replace(day=1) for m in months})
    values = [str(m) for m in firsts]
    with store.run() as run:
        for name in ("telecom_partials", "telecom_trend"):
            run.drop_parts(name, values)
        run.replace_parts("telecom_partials", month_rows(sources["telecom"], firsts, settings), "year_month")
        fresh = run.read_parts("telecom_partials", values)
        if fresh is not None:
            run.replace_parts("telecom_trend", partials.telecom_trend_of(fresh), "year_month")
    return run.number
