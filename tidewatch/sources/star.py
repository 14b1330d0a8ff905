"""Adapters that read the ten sources from an order/line-item star schema.

Every adapter is a projection, so a source costs what its columns cost. Look-ups from a fact table to a unique
dimension carry no hint: Spark broadcasts the dimension when its size allows, otherwise it sort-merges and splits
skewed partitions at run time, and the look-up is followed by a grouping with map-side combine. Summing the facts per
dimension key before the look-up was measured and is slower: keys and months are nearly as many as rows.
"""

from __future__ import annotations

import datetime as dt
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.functions import fixed_values as fv
from tidewatch.sources.schemas import PERIOD_DAY
from tidewatch.spec import ContextSpec, Cutoff, Settings, SourceFilter, default_signals

# The market segments, which are the sub-districts of every nation. Their first letters tell them apart.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
# Last digits that the segment names give, used to place suppliers in districts.
SEGMENT_DIGITS = tuple(sorted(ord(name[0]) % 10 for name in SEGMENTS))

STAR_SETTINGS = Settings(
    signals=default_signals(
        price=Cutoff(dt.date(1999, 1, 1), dt.date(2000, 1, 1), ("NATION_3", "NATION_11", "NATION_19")),
        pop=Cutoff(dt.date(1999, 1, 1)),
        telecom=Cutoff(dt.date(2000, 1, 1)),
        card=Cutoff(dt.date(1999, 1, 1)),
    ),
    source=SourceFilter(movement_type="F", install_state="O"),
    context=ContextSpec(
        rental_main_placeholder="PROMO",
        rental_sub_placeholder="Brand#13",
        call_placeholder="error",
        road_districts=(
            ("%click%", "NATION_0"),
            ("%view%", "NATION_1"),
            ("%purchase%", "NATION_2"),
            ("%sign%", "NATION_3"),
            ("%err%", "NATION_4"),
        ),
        slow_below=48.4,
        fast_from=50.0,
    ),
    key_delimiter="|",
)


class Tables:
    """The parquet tables of a directory, each opened once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._open = cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    def __call__(self, name: str) -> DataFrame:
        return self._open(name)

    @cached_property
    def customer_region(self) -> DataFrame:
        """District and sub-district of every customer."""
        nation = self("nation").select("n_nationkey", F.col("n_name").alias("sgg"))
        customer = self("customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("emd"))
        return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select("c_custkey", "sgg", "emd")


def _district_code(nation: str, segment: str) -> Column:
    return (F.col(nation) * 10 + F.ascii(segment) % 10).cast("bigint")


def price(table: Tables) -> DataFrame:
    orders = table("orders")
    region = table.customer_region
    return orders.join(region, orders.o_custkey == region.c_custkey).select(
        X.month_of("o_orderdate").alias("ts"),
        F.lit(fv.CITY).alias("sd"),
        "sgg",
        "emd",
        F.lit(fv.PRICE_LEVEL).alias("region_level"),
        F.col("o_totalprice").alias("price"),
    )


def population(table: Tables) -> DataFrame:
    orders = table("orders")
    region = table.customer_region
    return orders.join(region, orders.o_custkey == region.c_custkey).select(
        X.month_of("o_orderdate").alias("ts"),
        F.lit(fv.CITY).alias("sd"),
        "sgg",
        F.lit(fv.POPULATION_LEVEL).alias("region_level"),
        F.col("o_orderstatus").alias("movement_type"),
        F.col("o_totalprice").alias("population"),
    )


def area_facts(table: Tables) -> DataFrame:
    """Prices and movements of the same orders."""
    orders = table("orders")
    region = table.customer_region
    return orders.join(region, orders.o_custkey == region.c_custkey).select(
        X.month_of("o_orderdate").alias("ts"),
        F.lit(fv.CITY).alias("sd"),
        "sgg",
        "emd",
        F.col("o_orderstatus").alias("movement_type"),
        F.col("o_totalprice").alias("price"),
        F.col("o_totalprice").alias("population"),
    )


def telecom(table: Tables) -> DataFrame:
    lines = table("lineitem")
    orders = table("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    region = table.customer_region.drop("emd")
    placed = orders.join(region, orders.o_custkey == region.c_custkey).select("o_orderkey", "o_orderpriority", "sgg")
    return lines.join(placed, lines.l_orderkey == placed.o_orderkey).select(
        X.month_of("l_shipdate").alias("ts"),
        F.col("l_linestatus").alias("install_state"),
        F.col("sgg").alias("install_city"),
        F.col("o_orderpriority").alias("main_category_name"),
        F.lit(1).cast("bigint").alias("contract_count"),
        F.col("l_quantity").cast("bigint").alias("open_count"),
        (F.col("l_discount") * 100).alias("open_cvr"),
        F.col("l_extendedprice").alias("total_net_sales"),
        F.col("l_shipdate").alias(PERIOD_DAY),
    )


def card(table: Tables) -> DataFrame:
    lines = table("lineitem")
    digits = F.array(*[F.lit(d) for d in SEGMENT_DIGITS])
    supplier = table("supplier").select(
        "s_suppkey",
        (F.col("s_nationkey") * 10 + F.element_at(digits, (F.col("s_suppkey") % 5 + 1).cast("int")))
        .cast("bigint")
        .alias("district_code"),
    )

    def spent(flag: str) -> Column:
        return F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice"))

    return lines.join(supplier, lines.l_suppkey == supplier.s_suppkey).select(
        X.month_code(F.col("l_shipdate")).alias("standard_year_month"),
        F.lit(fv.PROVINCE_CODE).alias("province_code"),
        "district_code",
        spent("A").alias("electronics_furniture_sales"),
        spent("R").alias("home_life_service_sales"),
        F.lit(None).cast("double").alias("large_discount_store_sales"),
    )


def district(table: Tables) -> DataFrame:
    """Every nation with every segment, whichever of them have customers."""
    segments = F.explode(F.array(*[F.lit(name) for name in SEGMENTS])).alias("segment")
    places = table("nation").select("n_nationkey", "n_name", segments)
    code = _district_code("n_nationkey", "segment")
    return places.select(
        code.alias("district_code"),
        F.lit(fv.PROVINCE_CODE).alias("province_code"),
        F.col("n_name").alias("city_kor_name"),
        F.col("segment").alias("district_kor_name"),
        F.concat(F.lit("POINT("), F.col("n_nationkey"), F.lit(" "), code % 10, F.lit(")")).alias("district_geom"),
    )


def income(table: Tables) -> DataFrame:
    orders = table("orders").select("o_custkey", "o_orderdate")
    customer = table("customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey, "left").select(
        (F.year("o_orderdate") * 100 + 1).alias("standard_year_month"),
        _district_code("c_nationkey", "c_mktsegment").alias("district_code"),
        (F.lit(20) + F.col("c_custkey") % 40).cast("int").alias("age_group"),
        F.lit(1).cast("bigint").alias("customer_count"),
        F.when(F.col("c_acctbal") > 8500, 1.0).otherwise(0.0).alias("rate_income_over_70m"),
        F.col("o_orderdate").alias(PERIOD_DAY),
    )


def rental(table: Tables) -> DataFrame:
    lines = table("lineitem")
    part = table("part").select("p_partkey", "p_type", "p_brand")
    return lines.join(part, lines.l_partkey == part.p_partkey, "left").select(
        X.month_of("l_shipdate").alias("ts"),
        F.col("p_type").alias("rental_main_category"),
        F.col("p_brand").alias("rental_sub_category"),
        F.lit(1).cast("bigint").alias("open_count"),
        F.col("l_extendedprice").alias("avg_policy_amount"),
        (F.col("l_discount") * 100).alias("open_cvr"),
        F.col("l_shipdate").alias(PERIOD_DAY),
    )


def _division():
    return F.when(F.col("user_id") % 2 == 0, fv.CALL_INBOUND).otherwise("발신")


def calls(table: Tables) -> DataFrame:
    events = table("events")
    return (
        events.groupBy(
            F.to_date("ts").alias("ts"),
            F.col("event_type").alias("main_category_name"),
            _division().alias("division_name"),
            (F.col("user_id") % 3).alias("queue"),
        )
        .agg(
            F.count("*").alias("call_count"),
            (F.count_if(F.col("value") > 5) / F.count("*")).alias("connection_rate"),
            X.exact_mean(F.col("value")).alias("avg_bill_minute"),
        )
        .drop("queue")
    )


def call_conversion(table: Tables) -> DataFrame:
    events = table("events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return (
        events.groupBy(
            F.to_date("ts").alias("ts"),
            F.col("event_type").alias("main_category_name"),
            _division().alias("division_name"),
            F.when(F.col("event_type") == "view", F.col("user_id") % 4).otherwise(-1).alias("queue"),
        )
        .agg(
            (F.sum(k).cast("double") / F.count(k) / 100).alias("call_to_contract_cvr"),
            X.exact_mean(F.col("value")).alias("avg_leadtime_days"),
        )
        .drop("queue")
    )


def traffic(table: Tables) -> DataFrame:
    return table("events").select(
        X.month_of("ts").alias("ts"),
        F.col("event_type").alias("road_name"),
        F.concat(F.lit("node-"), F.col("user_id").cast("string")).alias("node_name"),
        F.col("value").alias("avg_speed_kmph"),
        F.lit(1).cast("bigint").alias("probe_count"),
        F.col("ts").alias(PERIOD_DAY),
    )


ADAPTERS = {
    "price": price,
    "population": population,
    "telecom": telecom,
    "card": card,
    "district": district,
    "income": income,
    "rental": rental,
    "calls": calls,
    "call_conversion": call_conversion,
    "traffic": traffic,
}


class StarSources(dict):
    """The ten sources over one directory of parquet tables; tables and sources are opened when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.table = Tables(spark, sf_dir)

    def __missing__(self, name: str) -> DataFrame:
        self[name] = ADAPTERS[name](self.table)
        return self[name]

    def joint(self, *names: str) -> DataFrame | None:
        """Prices and movements together; a source that was given or replaced is read on its own."""
        if set(names) != {"price", "population"} or type(self).__missing__ is not StarSources.__missing__:
            return None
        return None if {"price", "population"} & self.keys() else area_facts(self.table)
