"""Customer profile and representative geometry per district."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from tidewatch.functions import exprs as X
from tidewatch.functions import fixed_values as fv
from tidewatch.sources.schemas import PERIOD_DAY
from tidewatch.spec import Settings


def _since(df: DataFrame, column: str, first: Column) -> DataFrame:
    """Rows from ``first`` on, an aggregate over the frame. A column compared with a scalar subquery of its own type is a
    form that reaches the scan as a pushed filter, when the column is one of a table."""
    return df.where(F.col(column) >= df.select(first.cast(df.schema[column].dataType)).scalar())


def latest_period(df: DataFrame, period: str) -> DataFrame:
    """Rows of the newest period, a date or a month code. The scalar subquery reads only the period column.

    Where the frame has the day that a period was cut from, the newest period is all days from its first one on.
    """
    if PERIOD_DAY not in df.columns:
        return _since(df, period, F.max(period))
    is_date = isinstance(df.schema[period].dataType, DateType)
    first_day = F.max(period) if is_date else X.month_from_code(F.max(period))
    return _since(df, PERIOD_DAY, first_day).drop(PERIOD_DAY)


def last_n_months(df: DataFrame, ts: str, months: int) -> DataFrame:
    """Rows from ``months`` before the newest month on, both ends included."""
    first_month = F.add_months(F.max(ts), -months)
    if PERIOD_DAY not in df.columns:
        return _since(df, ts, first_month)
    return _since(df, PERIOD_DAY, first_month).drop(PERIOD_DAY)


def age_band_counts(income: DataFrame) -> DataFrame:
    """Customers per ten-year age band and mean high-income rate, per district code, newest period."""
    bands = [
        F.sum(F.when(F.col("age_group").between(low, low + 9), F.col("customer_count")).otherwise(0)).alias(
            f"cnt_{low}s"
        )
        for low in (20, 30, 40, 50)
    ]
    rate = X.exact_mean(F.col("rate_income_over_70m")).alias("rate_income_over_70m")
    return latest_period(income, "standard_year_month").groupBy("district_code").agg(*bands, rate)


def _dominant_age():
    """Largest band; on a tie the thirties win over the forties, the forties over the twenties."""
    counts = {low: F.coalesce(F.col(f"cnt_{low}s"), F.lit(0)) for low in (20, 30, 40, 50)}
    top = F.greatest(*counts.values())
    label = F.when(F.col("cnt_30s").isNull(), fv.AGE_UNMATCHED)
    for low, text in fv.AGE_LABELS.items():
        label = label.when(counts[low] == top, text)
    return label.otherwise(fv.AGE_MIXED)


def _income_band():
    rate = F.col("rate_income_over_70m")
    label = F.when(rate.isNull(), fv.INCOME_UNKNOWN)
    for above, text in fv.INCOME_BANDS:
        label = label.when(rate > above, text)
    return label.otherwise(fv.INCOME_REST)


def customer_profile(district: DataFrame, income: DataFrame, settings: Settings) -> DataFrame:
    """Dominant age group and income band of every district of the master."""
    stats = age_band_counts(income)
    return (
        district.where(F.col("district_code").isNotNull())
        .join(stats, "district_code", "left")
        .select(
            "district_code",
            "province_code",
            F.col("city_kor_name").alias("sgg"),
            F.col("district_kor_name").alias("emd"),
            X.region_key(settings.key_delimiter, F.col("city_kor_name"), F.col("district_kor_name")).alias(
                "region_key"
            ),
            "district_geom",
            _dominant_age().alias("dominant_age_group"),
            _income_band().alias("income_profile"),
        )
    )


def _of_lowest_code(columns: list[str]):
    """The columns of the row with the lowest code, as one aggregate instead of a window and a distinct.

    A null code comes last; rows that share a code are told apart by their columns.
    """
    order = F.struct(F.col("district_code").isNull(), "district_code", *[c for c in columns if c != "district_code"])
    return F.min_by(F.struct(*columns), order).alias("lowest")


def sgg_geometry(district: DataFrame) -> DataFrame:
    """Code and geometry of the district row with the lowest code, per city district."""
    return (
        district.where(F.col("district_kor_name").isNotNull())
        .groupBy(F.col("city_kor_name").alias("sgg"))
        .agg(_of_lowest_code(["district_code", "district_geom"]))
        .select("sgg", "lowest.district_code", "lowest.district_geom")
    )


def sgg_profile(profile: DataFrame) -> DataFrame:
    """Profile of the row with the lowest code, per city district."""
    return (
        profile.groupBy("sgg")
        .agg(_of_lowest_code(["dominant_age_group", "income_profile"]))
        .select("sgg", "lowest.dominant_age_group", "lowest.income_profile")
    )
