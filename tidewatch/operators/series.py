"""Monthly series per region and signal, with the train/detect split in the same pass.

A series frame has ``signal, series, sgg, emd, ts, y, cut_group, cutoff, is_train``. One row per series and month, so a
series never has more rows than the calendar has months, whatever the size of its source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.operators import joint
from tidewatch.sources.catalog import JointSources, Sources
from tidewatch.spec import Settings, SourceFilter


def filter_price(price: DataFrame, source: SourceFilter) -> DataFrame:
    return price.where((F.col("region_level") == source.price_level) & (F.col("sd") == source.city))


def filter_population(population: DataFrame, source: SourceFilter) -> DataFrame:
    return population.where(
        (F.col("movement_type") == source.movement_type)
        & (F.col("region_level") == source.population_level)
        & (F.col("sd") == source.city)
    )


def filter_telecom(telecom: DataFrame, source: SourceFilter) -> DataFrame:
    return telecom.where(F.col("install_state") == source.install_state)


def with_split(series: DataFrame, settings: Settings, signal: str) -> DataFrame:
    """Add the cut-off of each district and the side of it a row falls on."""
    cutoff = settings.signal(signal).cutoff
    day = X.cutoff_day(F.col("sgg"), cutoff)
    return series.select(
        "*",
        X.cutoff_group(F.col("sgg"), cutoff).alias("cut_group"),
        day.alias("cutoff"),
        (F.col("ts") < day).alias("is_train"),
    )


def _dated(df: DataFrame, settings: Settings, signal: str, is_dated: Column, sgg: str) -> DataFrame:
    """Drop rows on neither side of a cut-off: without a month, or without a district where districts have groups.

    The test is on source columns, because Catalyst repeats it for every source row.
    """
    grouped = bool(settings.signal(signal).cutoff.late_districts)
    return df.where(is_dated & F.col(sgg).isNotNull() if grouped else is_dated)


def _tagged(grouped: DataFrame, settings: Settings, signal: str, series: Column, emd: Column) -> DataFrame:
    tagged = grouped.select(
        F.lit(signal).alias("signal"),
        series.alias("series"),
        F.col("sgg"),
        emd.cast("string").alias("emd"),
        F.col("ts"),
        F.col("y").cast("double").alias("y"),
    )
    return with_split(tagged, settings, signal)


def price_series(price: DataFrame, settings: Settings, min_share: float = 0.5) -> DataFrame:
    """Mean price per sub-district and month.

    With ``grain_fallback``, districts that :func:`grain_choice` finds too short get one series of the whole district.
    Sums and counts per month are made first; the choice is a window over them, so the source is read once.
    """
    total = X.exact_sum(F.col("price"))
    rows = _dated(filter_price(price, settings.source), settings, "price", F.col("ts").isNotNull(), "sgg")
    monthly = rows.groupBy("sgg", "emd", "ts").agg(total.alias("total"), F.count("price").alias("n"))
    key = X.region_key(settings.key_delimiter, F.col("sgg"), F.col("emd"))
    if settings.grain_fallback:
        monthly = (
            monthly.withColumn("whole", _falls_back(settings.grain_points, min_share))
            .groupBy("sgg", "ts", "whole", F.when(~F.col("whole"), F.col("emd")).alias("emd"))
            .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        )
        key = F.when(F.col("whole"), F.col("sgg")).otherwise(key)
    mean = F.col("total").cast("double") / F.nullif(F.col("n"), F.lit(0))
    return _tagged(monthly.withColumn("y", mean), settings, "price", key, F.col("emd"))


def _falls_back(points: int, min_share: float) -> Column:
    """Whether too few sub-districts of a row's district have enough months; over one row per sub-district and month."""
    of_series = Window.partitionBy("sgg", "emd")
    months = F.count("ts").over(of_series)
    first = F.row_number().over(of_series.orderBy("ts")) == 1
    long_enough = F.count_if(first & (months >= points)).over(Window.partitionBy("sgg"))
    return long_enough < min_share * F.count_if(first).over(Window.partitionBy("sgg"))


def densified(series: DataFrame, settings: Settings) -> DataFrame:
    """The series with a row for every month from their first to their last; added months have no value.

    The months are counted per series, so the rows added grow with the series' length, not with the source.
    """
    keys = ["signal", "series", "sgg", "emd"]
    span = series.groupBy(*keys).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    months = F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("ts")
    every = span.select(*keys, months)
    known = series.select(*[F.col(k).alias(f"own_{k}") for k in keys], F.col("ts").alias("own_ts"), "y")
    same = [F.equal_null(F.col(k), F.col(f"own_{k}")) for k in (*keys, "ts")]
    dense = every.join(known, reduce(lambda a, b: a & b, same), "left").select(*keys, "ts", "y")
    parts = [with_split(dense.where(F.col("signal") == s.name), settings, s.name) for s in settings.signals]
    return reduce(DataFrame.unionByName, parts)


def pop_series(population: DataFrame, settings: Settings) -> DataFrame:
    """Sum of in-migration per district and month."""
    rows = _dated(filter_population(population, settings.source), settings, "pop", F.col("ts").isNotNull(), "sgg")
    grouped = rows.groupBy("sgg", "ts").agg(X.exact_sum(F.col("population")).alias("y"))
    return _tagged(grouped, settings, "pop", F.col("sgg"), F.lit(None))


def telecom_series(telecom: DataFrame, settings: Settings) -> DataFrame:
    """Sum of line openings per district and month."""
    rows = filter_telecom(telecom, settings.source)
    rows = _dated(rows, settings, "telecom", F.col("ts").isNotNull(), "install_city")
    grouped = rows.groupBy(F.col("install_city").alias("sgg"), "ts").agg(F.sum("open_count").alias("y"))
    return _tagged(grouped, settings, "telecom", F.col("sgg"), F.lit(None))


def card_series(card: DataFrame, district: DataFrame, settings: Settings) -> DataFrame:
    """Sum of three spend components per district and month; months with no positive sum are dropped.

    Spend is summed per code before the master is joined, so the join sees districts x months, not card rows.
    """
    parts = ("electronics_furniture_sales", "home_life_service_sales", "large_discount_store_sales")
    spend = reduce(lambda a, b: a + b, [F.coalesce(F.col(p), F.lit(0)) for p in parts])
    per_code = (
        card.where(F.col("province_code") == settings.source.province_code)
        .groupBy("district_code", "standard_year_month")
        .agg(X.exact_sum(spend).alias("y"))
    )
    names = district.select("district_code", F.col("city_kor_name").alias("sgg"))
    named = per_code.join(names, "district_code")
    grouped = (
        _dated(named, settings, "card", X.is_month_code(F.col("standard_year_month")), "sgg")
        .groupBy("sgg", X.month_from_code(F.col("standard_year_month")).alias("ts"))
        .agg(F.sum("y").alias("y"))
        .where(F.col("y") > 0)
    )
    return _tagged(grouped, settings, "card", F.col("sgg"), F.lit(None))


def series_of(signal: str, sources: Sources, settings: Settings) -> DataFrame:
    """The series of one signal; only the sources it needs are opened."""
    if signal == "price":
        return price_series(sources["price"], settings)
    if signal == "pop":
        return pop_series(sources["population"], settings)
    if signal == "telecom":
        return telecom_series(sources["telecom"], settings)
    if signal == "card":
        return card_series(sources["card"], sources["district"], settings)
    raise ValueError(f"unknown signal {signal!r}")


def all_series(sources: Sources, settings: Settings) -> DataFrame:
    """All signals in one long frame.

    Where the sources say that prices and movements are measures of the same rows, those rows are read once for both.
    """
    names = [s.name for s in settings.signals]
    parts, facts = [], None
    if not settings.grain_fallback and set(joint.SIGNALS) <= set(names):
        facts = sources.joint("price", "population") if isinstance(sources, JointSources) else None
    if facts is not None:
        parts.append(joint.price_and_pop_series(facts, settings))
        names = [n for n in names if n not in joint.SIGNALS]
    every = reduce(DataFrame.unionByName, [*parts, *[series_of(n, sources, settings) for n in names]])
    return densified(every, settings) if settings.densify else every


def months_present(price: DataFrame, settings: Settings) -> DataFrame:
    """Sub-district and month pairs with data: what history length is judged on."""
    return filter_price(price, settings.source).select("sgg", "emd", "ts").distinct()


def series_length(price: DataFrame, settings: Settings) -> DataFrame:
    """Number of months per sub-district."""
    return months_present(price, settings).groupBy("sgg", "emd").agg(F.count("ts").alias("data_points"))


def grain_choice(price: DataFrame, settings: Settings, min_share: float = 0.5) -> DataFrame:
    """Per district: stay at sub-district grain when enough sub-districts have enough months, else fall back."""
    enough = F.count_if(F.col("data_points") >= settings.grain_points)
    return (
        series_length(price, settings)
        .groupBy("sgg")
        .agg(F.count("*").alias("n_series"), enough.alias("n_long_enough"), F.min("data_points").alias("min_points"))
        .withColumn("grain", F.when(F.col("n_long_enough") >= min_share * F.col("n_series"), "emd").otherwise("sgg"))
    )


def split_check(series: DataFrame) -> DataFrame:
    """Per series: is every detection month after the last training month?"""
    last_train = F.max(F.when(F.col("is_train"), F.col("ts")))
    first_detect = F.min(F.when(~F.col("is_train"), F.col("ts")))
    return (
        series.groupBy("signal", "series")
        .agg(last_train.alias("last_train"), first_detect.alias("first_detect"))
        .withColumn("violates", F.coalesce(F.col("last_train") >= F.col("first_detect"), F.lit(False)))
    )
