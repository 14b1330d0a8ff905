"""Marts kept as mergeable partial aggregates, so that new months touch only their own parts.

A partial row holds, for one month and key, exact sums, counts, and least and greatest values. Partial rows of the same key
merge into one by adding and comparing, in any order and any number of times, and a mart is finished from merged rows. So a
month can be made again alone, rows that arrive late can be added as further partial rows, and a mart over several months
needs no source row.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.functions import fixed_values as fv
from tidewatch.operators.series import filter_telecom
from tidewatch.sources.schemas import PERIOD_DAY
from tidewatch.spec import SourceFilter

#: Kinds of partial values, each with what merges two of them.
MERGED = {"total": F.sum, "n": F.sum, "low": F.min, "high": F.max}


@dataclass(frozen=True)
class Measure:
    """A value, and which partial values of it are kept: total (exact), n (not null), low, high."""

    name: str
    value: Column
    kinds: tuple[str, ...] = ("total", "n")

    def partial(self) -> list[Column]:
        made = {
            "total": lambda: X.exact_sum(self.value),
            "n": lambda: F.count(self.value),
            "low": lambda: F.min(self.value),
            "high": lambda: F.max(self.value),
        }
        return [made[k]().alias(f"{self.name}_{k}") for k in self.kinds]


def partials(rows: DataFrame, keys: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """One partial row for each key; ``row_count`` counts rows."""
    values = [c for m in measures for c in m.partial()]
    return rows.groupBy(*keys).agg(F.count("*").alias("row_count"), *values)


def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial rows with one for each of the keys, which may be fewer than the parts have.

    Sums keep their digits: their type stays that of the parts, so merging merged rows again changes nothing.
    """
    values = [c for c in parts.columns if c.rpartition("_")[2] in MERGED]

    def merge(c: str) -> Column:
        together = MERGED[c.rpartition("_")[2]](c)
        return together.cast(parts.schema[c].dataType).alias(c)

    return parts.groupBy(*keys).agg(F.sum("row_count").alias("row_count"), *map(merge, values))


def mean(name: str) -> Column:
    """The mean of a measure from its total and count."""
    return F.col(f"{name}_total").cast("double") / F.nullif(F.col(f"{name}_n"), F.lit(0))


def of_months(rows: DataFrame, months: Sequence[dt.date], column: str = "ts") -> DataFrame:
    """Rows of some months. Where a source carries the day its month was cut from, bounds on it reach the scan."""
    if not months:
        return rows.limit(0)
    firsts = sorted({m.replace(day=1) for m in months})
    if PERIOD_DAY in rows.columns:
        behind = (firsts[-1] + dt.timedelta(days=31)).replace(day=1)
        kind = rows.schema[PERIOD_DAY].dataType
        day = F.col(PERIOD_DAY)
        rows = rows.where((day >= F.lit(firsts[0]).cast(kind)) & (day < F.lit(behind).cast(kind)))
    return rows.where(F.col(column).isin(firsts))


# ---- telecom trend -------------------------------------------------------------------------------------------------

TELECOM_KEYS = ("year_month", "sgg", "main_category_name")


def telecom_partials(telecom: DataFrame, source: SourceFilter) -> DataFrame:
    """Partial rows of the telecom mart per month, district and category."""
    rows = filter_telecom(telecom, source).withColumns(
        {"year_month": F.col("ts"), "sgg": F.col("install_city")}
    )
    measures = [
        Measure("contracts", F.col("contract_count")),
        Measure("opens", F.col("open_count")),
        Measure("cvr", F.col("open_cvr")),
        Measure("sales", F.col("total_net_sales")),
    ]
    return partials(rows, TELECOM_KEYS, measures)


def telecom_trend_of(parts: DataFrame) -> DataFrame:
    """The telecom mart from its partial rows: the rows of :func:`tidewatch.operators.marts.telecom_trend`."""
    whole = merged(parts, TELECOM_KEYS)

    def total(name: str) -> Column:
        return F.when(F.col(f"{name}_n") > 0, F.col(f"{name}_total"))

    return whole.select(
        *TELECOM_KEYS,
        total("contracts").cast("bigint").alias("contracts"),
        total("opens").cast("bigint").alias("opens"),
        X.half_up(mean("cvr"), 1).alias("avg_cvr_pct"),
        total("sales").cast("double").alias("net_sales"),
    )


# ---- district summary ----------------------------------------------------------------------------------------------


def alert_partials(alerts: DataFrame) -> DataFrame:
    """Partial rows of the district summary per month and district: labels counted, scores summed and compared."""
    label = F.col("alert_type")

    def hits(name: str, condition: Column) -> Measure:
        return Measure(name, F.when(condition, 1), ("n",))

    measures = [
        hits("quad_alerts", label == fv.QUAD_LABEL),
        hits("triple_alerts", label == fv.TRIPLE_LABEL),
        *[hits(f"{s}_alerts", label.contains(w)) for s, w in fv.LABEL_WORDS.items()],
        Measure("score", F.col("combined_score"), ("total", "n", "low", "high")),
    ]
    return partials(alerts, ["alert_date", "sgg"], measures)


def sgg_summary_of(parts: DataFrame) -> DataFrame:
    """The district summary from partial rows of any months."""
    whole = merged(parts, ["sgg"])
    counts = ["quad_alerts", "triple_alerts", *[f"{s}_alerts" for s in fv.LABEL_WORDS]]
    return whole.select(
        "sgg",
        F.col("row_count").alias("total_alerts"),
        *[F.col(f"{c}_n").alias(c) for c in counts],
        X.half_up(F.col("score_high"), 3).alias("max_score"),
        X.half_up(mean("score"), 3).alias("avg_score"),
    )
