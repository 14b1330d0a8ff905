"""Anomaly scores per series: train on the rows before the cut-off, score the rows after it.

Both detectors shuffle once, by series, and work in windows over that partitioning. A partition of a window is one
series, which holds one row per month. Score rows are ``signal, series, sgg, emd, ts, y, forecast, percentile,
is_anomaly``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.spec import DetectorSpec

KEYS = ("signal", "series")
SCORE_COLUMNS = ("signal", "series", "sgg", "emd", "ts", "y", "forecast", "percentile", "is_anomaly")


def _usable_train() -> Column:
    return F.col("is_train") & F.col("y").isNotNull()


def _beyond(percentile: Column, spec: DetectorSpec) -> Column:
    """Outside the central prediction interval."""
    tail = (1 - spec.prediction_interval) / 2
    return (percentile < tail) | (percentile > 1 - tail)


def finished(scored: DataFrame, spec: DetectorSpec) -> DataFrame:
    return (
        scored.where(~F.col("is_train") & (F.col("n_train") >= max(spec.min_points, 1)))
        .withColumn("is_anomaly", _beyond(F.col("percentile"), spec))
        .select(*SCORE_COLUMNS)
    )


def score_ecdf(series: DataFrame, spec: DetectorSpec = DetectorSpec()) -> DataFrame:
    """Mid-rank of each value in its own training history; the forecast is the training mean.

    Counting with running windows instead of a self-join keeps the work linear in the rows of a series. All frames
    share one order, so a single sort and a single window operator compute them.
    """
    by_value = Window.partitionBy(*KEYS).orderBy("y")
    up_to_value = by_value.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same_value = by_value.rangeBetween(Window.currentRow, Window.currentRow)
    whole = by_value.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    train = F.when(_usable_train(), 1).otherwise(0)
    train_y = F.when(_usable_train(), F.col("y"))
    counted = series.withColumns(
        {
            "at_most": F.sum(train).over(up_to_value),
            "equal": F.sum(train).over(same_value),
            "n_train": F.sum(train).over(whole),
            "train_sum": X.exact_sum(train_y).over(whole),
        }
    )
    place = (F.col("at_most") - F.col("equal") * F.lit(0.5)) / F.nullif(F.col("n_train"), F.lit(0))
    scored = counted.withColumn("percentile", F.when(F.col("y").isNotNull(), place)).withColumn(
        "forecast", F.col("train_sum").cast("double") / F.nullif(F.col("n_train"), F.lit(0))
    )
    return finished(scored, spec)


def month_index(ts: Column) -> Column:
    return (F.year(ts) - 2000) * 12 + F.month(ts)


def _line(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column) -> tuple[Column, Column]:
    """Slope and intercept of the least-squares line from its sums; a single month gives a flat line."""
    spread = n * sxx - sx * sx
    slope = F.when(spread > 0, (n * sxy - sx * sy) / F.nullif(spread, F.lit(0.0))).otherwise(0.0)
    return slope, (sy - slope * sx) / F.nullif(n, F.lit(0.0))


def score_trend(series: DataFrame, spec: DetectorSpec = DetectorSpec(method="trend")) -> DataFrame:
    """Straight line plus month-of-year mean residual (when the history is long enough), normal residuals."""
    # Sums run in the order of the months, so they come out the same wherever they run.
    whole = Window.partitionBy(*KEYS).orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same_month = (
        Window.partitionBy(*KEYS, "month_of_year")
        .orderBy("ts")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    x, train = F.col("x"), _usable_train()
    y = F.when(train, F.col("y"))
    sums = series.withColumns({"x": month_index(F.col("ts")), "month_of_year": F.month("ts")}).withColumns(
        {
            "n_train": F.count(y).over(whole),
            "sx": F.sum(F.when(train, x)).over(whole).cast("double"),
            "sy": F.sum(y).over(whole),
            "sxy": F.sum(y * x).over(whole),
            "sxx": F.sum(F.when(train, x * x)).over(whole).cast("double"),
        }
    )
    n = F.col("n_train").cast("double")
    slope, intercept = _line(n, F.col("sx"), F.col("sy"), F.col("sxy"), F.col("sxx"))
    lined = (
        sums.withColumn("slope", slope)
        .withColumn("intercept", intercept)
        .withColumn("line", F.col("intercept") + F.col("slope") * x)
        .withColumn("residual", F.when(train, F.col("y") - F.col("line")))
    )
    month_mean = F.avg("residual").over(same_month)
    seasonal = lined.withColumn(
        "season",
        F.when(F.col("n_train") >= spec.seasonal_points, F.coalesce(month_mean, F.lit(0.0))).otherwise(0.0),
    )
    error = F.col("residual") - F.col("season")
    spread = seasonal.withColumns(
        {
            "se": F.sum(error).over(whole),
            "see": F.sum(error * error).over(whole),
            "forecast": F.col("line") + F.col("season"),
        }
    )
    variance = (F.col("see") - F.col("se") * F.col("se") / n) / F.nullif(n - 1, F.lit(0.0))
    scored = spread.withColumn("sigma", F.sqrt(F.greatest(variance, F.lit(0.0))))
    return finished(scored.withColumn("percentile", normal_place()), spec)


def normal_place() -> Column:
    """Place of the gap to the forecast in a normal distribution; without spread only its sign counts."""
    gap = F.col("y") - F.col("forecast")
    by_sign = F.when(gap > 0, 1.0).when(gap < 0, 0.0).when(gap == 0, 0.5)
    by_spread = X.normal_cdf(gap / F.nullif(F.col("sigma"), F.lit(0.0)))
    # A missing value has no place: least and greatest would pass over the null.
    return F.when(gap.isNotNull(), F.when(F.col("sigma") > 0, by_spread).otherwise(by_sign))


def score(series: DataFrame, spec: DetectorSpec) -> DataFrame:
    if spec.method == "ecdf":
        return score_ecdf(series, spec)
    if spec.method == "trend":
        return score_trend(series, spec)
    if spec.method == "state":
        from tidewatch.operators import state_space

        return state_space.score(series, spec)
    raise ValueError(f"unknown detector {spec.method!r}")


def fit(series: DataFrame, spec: DetectorSpec = DetectorSpec()) -> DataFrame:
    """Model table: one row per series with the moments, the sorted training values, and the trend's line, season and spread.

    The value array is bounded by the number of months in the training period. ``grain`` says whether the values are
    those of months or of days.
    """
    train = series.where(_usable_train()).withColumn("x", month_index(F.col("ts")))
    y, x = F.col("y"), F.col("x")
    sums = train.groupBy(*KEYS).agg(
        F.first("sgg").alias("sgg"),
        F.first("emd").alias("emd"),
        F.count("*").alias("n_train"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.sum(x).cast("double").alias("sx"),
        F.sum(x * x).cast("double").alias("sxx"),
        X.exact_sum(y).cast("double").alias("total"),
        F.array_sort(F.collect_list(F.struct("ts", "x", "y"))).alias("months"),
    )

    def summed(array, value) -> Column:
        # In the order of the months, so that a retried task gives the same digits.
        return F.aggregate(array, F.lit(0.0), lambda total, m: total + value(m))

    sums = sums.withColumns(
        {
            "sy": summed("months", lambda m: m["y"]),
            "sxy": summed("months", lambda m: m["y"] * m["x"]),
            "syy": summed("months", lambda m: m["y"] * m["y"]),
            "history": F.array_sort(F.transform("months", lambda m: m["y"])),
        }
    )
    n = F.col("n_train").cast("double")
    slope, intercept = _line(n, F.col("sx"), F.col("sy"), F.col("sxy"), F.col("sxx"))
    sums = sums.withColumns({"slope": slope, "intercept": intercept})

    def residual(m) -> Column:
        gap = m["y"] - (F.col("intercept") + F.col("slope") * m["x"])
        return F.struct(F.month(m["ts"]).alias("month"), gap.alias("gap"))

    sums = sums.withColumn("residuals", F.transform("months", residual))

    def season_of(month) -> Column:
        own = F.filter("residuals", lambda r: r["month"] == month)
        mean = summed(own, lambda r: r["gap"]) / F.nullif(F.size(own), F.lit(0))
        return F.when(F.col("n_train") >= spec.seasonal_points, F.coalesce(mean, F.lit(0.0))).otherwise(0.0)

    sums = sums.withColumn("season", F.transform(F.sequence(F.lit(1), F.lit(12)), season_of))
    errors = F.transform("residuals", lambda r: r["gap"] - F.element_at("season", r["month"]))
    sums = sums.withColumn("errors", errors)
    se, see = summed("errors", lambda e: e), summed("errors", lambda e: e * e)

    def spread(total: Column, squares: Column) -> Column:
        return F.sqrt(F.greatest((squares - total * total / n) / F.nullif(n - 1, F.lit(0.0)), F.lit(0.0)))

    first_days = F.forall("months", lambda m: F.dayofmonth(m["ts"]) == 1)
    return sums.select(
        *KEYS,
        "sgg",
        "emd",
        F.when(first_days, "month").otherwise("day").alias("grain"),
        "n_train",
        "first_ts",
        "last_ts",
        (F.col("total") / n).alias("mean_y"),
        spread(F.col("sy"), F.col("syy")).alias("stddev_y"),
        "slope",
        "intercept",
        "season",
        spread(se, see).alias("sigma"),
        "history",
    )


def score_with_model(observations: DataFrame, model: DataFrame, spec: DetectorSpec = DetectorSpec()) -> DataFrame:
    """Score ``signal, series, ts, y`` rows against a stored model table; the same result as :func:`score`."""
    joined = observations.select(*KEYS, "ts", "y").join(model, list(KEYS))
    y = F.col("y")
    below = F.size(F.filter("history", lambda v: v < y))
    equal = F.size(F.filter("history", lambda v: v == y))
    place = (below + equal * F.lit(0.5)) / F.nullif(F.col("n_train"), F.lit(0))
    later = joined.where(F.col("ts") > F.col("last_ts")).withColumn("is_train", F.lit(False))
    if spec.method == "trend":
        line = F.col("intercept") + F.col("slope") * month_index(F.col("ts"))
        scored = later.withColumn("forecast", line + F.element_at("season", F.month("ts")))
        return finished(scored.withColumn("percentile", normal_place()), spec)
    scored = later.withColumn("forecast", F.col("mean_y")).withColumn("percentile", F.when(y.isNotNull(), place))
    return finished(scored, spec)
