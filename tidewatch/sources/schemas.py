"""Canonical source schemas and the check every source passes when it is loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# An optional column: the date or time that a row's period was cut from, the period being that of its first day. Only the
# choice of the newest periods reads it, and its bound reaches the scan.
PERIOD_DAY = "period_day"

# Canonical columns of each source.
SOURCES: dict[str, str] = {
    "price": "ts date, sd string, sgg string, emd string, region_level string, price double",
    "population": "ts date, sd string, sgg string, region_level string, movement_type string, population double",
    "telecom": "ts date, install_state string, install_city string, main_category_name string, "
    "contract_count bigint, open_count bigint, open_cvr double, total_net_sales double",
    "card": "standard_year_month int, province_code int, district_code bigint, electronics_furniture_sales double, "
    "home_life_service_sales double, large_discount_store_sales double",
    "district": "district_code bigint, province_code int, city_kor_name string, district_kor_name string, "
    "district_geom string",
    "income": "standard_year_month int, district_code bigint, age_group int, customer_count bigint, "
    "rate_income_over_70m double",
    "rental": "ts date, rental_main_category string, rental_sub_category string, open_count bigint, "
    "avg_policy_amount double, open_cvr double",
    "calls": "ts date, main_category_name string, division_name string, call_count bigint, connection_rate double, "
    "avg_bill_minute double",
    "call_conversion": "ts date, main_category_name string, division_name string, call_to_contract_cvr double, "
    "avg_leadtime_days double",
    "traffic": "ts date, road_name string, node_name string, avg_speed_kmph double, probe_count bigint",
}

# Provider column names that differ from the canonical ones.
PROVIDER_NAMES: dict[str, str] = {
    "yyyymmdd": "ts",
    "year_month": "ts",
    "meme_price_per_supply_pyeong": "price",
}


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(SOURCES[name])


def _as_date(c, data_type):
    if isinstance(data_type, T.StringType):
        # Providers write 2023-01-01 or 20230101.
        return F.coalesce(F.try_to_date(c, "yyyyMMdd"), F.try_to_date(c, "yyyy-MM-dd"))
    if isinstance(data_type, (T.IntegerType, T.LongType)):
        return F.try_to_date(c.cast("string"), "yyyyMMdd")
    return c.cast("date")


def conform(df: DataFrame, name: str) -> DataFrame:
    """Rename and cast a provider table to the canonical schema; a missing column is an error."""
    present = {PROVIDER_NAMES.get(f.name.lower(), f.name.lower()): f for f in df.schema.fields}
    want = schema_of(name)
    missing = [f.name for f in want.fields if f.name not in present]
    if missing:
        raise ValueError(f"source {name}: missing columns {missing}, found {sorted(present)}")
    columns = []
    for f in want.fields:
        have = present[f.name]
        c = F.col(f"`{have.name}`")
        c = _as_date(c, have.dataType) if isinstance(f.dataType, T.DateType) else c.cast(f.dataType)
        columns.append(c.alias(f.name))
    if PERIOD_DAY in present:
        columns.append(F.col(f"`{present[PERIOD_DAY].name}`").alias(PERIOD_DAY))
    return df.select(*columns)


def assert_schema(df: DataFrame, name: str) -> DataFrame:
    """Check that a frame has the canonical column names and kinds of a source."""
    want = {f.name: f.dataType for f in schema_of(name).fields}
    have = {f.name: f.dataType for f in df.schema.fields if f.name != PERIOD_DAY}
    if set(want) != set(have):
        raise ValueError(f"source {name}: expected columns {sorted(want)}, found {sorted(have)}")
    for column, data_type in want.items():
        numeric = isinstance(data_type, T.NumericType) and isinstance(have[column], T.NumericType)
        if not numeric and type(have[column]) is not type(data_type):
            raise ValueError(f"source {name}: column {column} is {have[column]}, expected {data_type}")
    return df
