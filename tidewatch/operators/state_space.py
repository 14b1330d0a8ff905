"""A seasonal detector with a state: level, trend and season, carried along each series month by month.

An additive innovations model. A month's forecast is the level, moved on by the trend, and the month's season; the gap to
the value corrects all three by their gains. Months without a value move the level on and correct nothing. The state after
the training months is a row of the model table, so later training months advance it without any history being read, and
scores are taken from it alone. A month h months on has the forecast level + h * trend + season, and its spread grows with h
by the published variance of this model class (Hyndman, Koehler, Ord and Snyder, 2008).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import detect
from tidewatch.spec import DetectorSpec

SEASONS = 12
STATE = ("level", "trend", "season", "last_month", "n_train", "squares")
MODEL_COLUMNS = (*detect.KEYS, "sgg", "emd", "first_ts", "last_ts", *STATE)


def _start() -> Column:
    """The state of a series without a month."""
    return F.struct(
        F.lit(None).cast("double").alias("level"),
        F.lit(0.0).alias("trend"),
        F.array_repeat(F.lit(0.0), SEASONS).alias("season"),
        F.lit(None).cast("int").alias("last_month"),
        F.lit(0).cast("bigint").alias("n_train"),
        F.lit(0.0).alias("squares"),
    )


def _forecast(state: Column, ahead: Column, month: Column) -> Column:
    return state["level"] + ahead * state["trend"] + F.element_at(state["season"], month)


def _stepped(spec: DetectorSpec):
    """The state after one more month; the first month only sets the level."""

    def step(state: Column, month: Column) -> Column:
        first, ahead = state["level"].isNull(), month["x"] - state["last_month"]
        gap = F.when(first, F.lit(0.0)).otherwise(month["y"] - _forecast(state, ahead, month["month"]))
        moved = F.when(first, month["y"]).otherwise(state["level"] + ahead * state["trend"])
        here = month["month"] - 1
        season = F.transform(state["season"], lambda s, i: F.when(i == here, s + spec.season_gain * gap).otherwise(s))
        return F.struct(
            (moved + spec.level_gain * gap).alias("level"),
            (state["trend"] + spec.trend_gain * gap).alias("trend"),
            season.alias("season"),
            month["x"].alias("last_month"),
            (state["n_train"] + 1).alias("n_train"),
            (state["squares"] + gap * gap).alias("squares"),
        )

    return step


def _months(rows: DataFrame) -> DataFrame:
    """The months of each series in order, as one array: as many entries as the calendar has months."""
    month = F.struct(detect.month_index(F.col("ts")).alias("x"), F.month("ts").alias("month"), F.col("y"))
    return rows.groupBy(*detect.KEYS).agg(
        F.first("sgg").alias("sgg"),
        F.first("emd").alias("emd"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.array_sort(F.collect_list(month)).alias("months"),
    )


def fit(series: DataFrame, spec: DetectorSpec = DetectorSpec(method="state")) -> DataFrame:
    """Model table: the state of each series after its training months."""
    of = _months(series.where(F.col("is_train") & F.col("y").isNotNull()))
    state = F.aggregate("months", _start(), _stepped(spec))
    return of.withColumn("state", state).select(*detect.KEYS, "sgg", "emd", "first_ts", "last_ts", "state.*")


def advance(model: DataFrame, rows: DataFrame, spec: DetectorSpec = DetectorSpec(method="state")) -> DataFrame:
    """The model after further training months ``signal, series, sgg, emd, ts, y``, as if fitted with all months.

    Months that the model has seen, or that lie before its last one, change nothing. Series that it doesn't know begin.
    """
    known = model.select(
        *detect.KEYS,
        *[F.col(c).alias(f"was_{c}") for c in ("sgg", "emd", "first_ts", "last_ts")],
        F.struct(*STATE).alias("was"),
    )
    of = _months(rows.where(F.col("y").isNotNull()))
    both = of.join(known, list(detect.KEYS), "full")
    state = F.coalesce("was", _start())
    new = F.filter("months", lambda m: F.coalesce(m["x"] > F.col("was")["last_month"], F.lit(True)))
    states = both.withColumn("new", F.coalesce(new, F.array().cast(both.schema["months"].dataType)))
    states = states.withColumn("state", F.aggregate("new", state, _stepped(spec)))
    return states.select(
        *detect.KEYS,
        F.coalesce("was_sgg", "sgg").alias("sgg"),
        F.coalesce("was_emd", "emd").alias("emd"),
        F.coalesce("was_first_ts", "first_ts").alias("first_ts"),
        F.greatest("was_last_ts", F.when(F.size("new") > 0, F.col("last_ts"))).alias("last_ts"),
        "state.*",
    )


def _widening(ahead: Column, spec: DetectorSpec) -> Column:
    """Variance of a forecast some months ahead, in parts of that one month ahead."""

    def weight(j: Column) -> Column:
        season = F.when(j % SEASONS == 0, spec.season_gain).otherwise(0.0)
        return F.lit(spec.level_gain) + spec.trend_gain * j + season

    steps = F.when(ahead > 1, F.sequence(F.lit(1), (ahead - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(1.0), lambda total, j: total + weight(j) * weight(j))


def score_with_model(observations: DataFrame, model: DataFrame, spec: DetectorSpec = DetectorSpec(method="state")) -> DataFrame:
    """Score ``signal, series, ts, y`` rows after a model's last month from its state."""
    joined = observations.select(*detect.KEYS, "ts", "y").join(model, list(detect.KEYS))
    ahead = detect.month_index(F.col("ts")) - F.col("last_month")
    spread = F.sqrt(F.col("squares") / F.nullif(F.col("n_train") - 1, F.lit(0)))
    later = joined.where(F.col("ts") > F.col("last_ts")).withColumns(
        {
            "is_train": F.lit(False),
            "forecast": F.col("level") + ahead * F.col("trend") + F.element_at("season", F.month("ts")),
            "sigma": spread * F.sqrt(_widening(ahead, spec)),
        }
    )
    return detect.finished(later.withColumn("percentile", detect.normal_place()), spec)


def score(series: DataFrame, spec: DetectorSpec = DetectorSpec(method="state")) -> DataFrame:
    """Scores of all rows that are not training rows, each from its series' state after the training months."""
    return score_with_model(series.where(~F.col("is_train")), fit(series, spec), spec)


def states_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Series whose state is not the same in two models, for a check of a stored model against a new fit."""
    same = [F.equal_null(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in STATE]
    keys = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in detect.KEYS]
    joined = a.alias("a").join(b.alias("b"), keys, "full")
    return joined.where(~reduce(Column.__and__, same)).select(
        *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in detect.KEYS]
    )
