"""Series of several signals from one read of the rows that hold their measures.

Where prices and movements are columns of the same rows, their series need one scan and one look-up of the region. All
measures are summed in one map-side grouping at the finest key; each sum is then given the tag and the key of its signal,
and a second, small grouping adds up those with coarser keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.spec import Settings

#: Columns of rows that hold both measures, at sub-district level.
AREA_FACTS = ("ts", "sd", "sgg", "emd", "movement_type", "price", "population")
SIGNALS = ("price", "pop")


def split_columns(settings: Settings, signals: tuple[str, ...] = SIGNALS) -> dict[str, Column]:
    """Cut-off group, cut-off day and side of rows of several signals."""
    group, day = F.lit(None).cast("string"), F.lit(None).cast("date")
    for name in signals:
        cutoff, here = settings.signal(name).cutoff, F.col("signal") == name
        group = F.when(here, X.cutoff_group(F.col("sgg"), cutoff)).otherwise(group)
        day = F.when(here, X.cutoff_day(F.col("sgg"), cutoff)).otherwise(day)
    return {"cut_group": group, "cutoff": day, "is_train": F.col("ts") < day}


def price_and_pop_series(facts: DataFrame, settings: Settings) -> DataFrame:
    """The rows of ``price_series`` and ``pop_series``: mean price per sub-district, sum of in-migration per district.

    A group of a signal exists when one of its rows does: any row for prices, a row of the counted movement for
    in-migration. Rows without a month are in neither; prices without a district are on neither side of grouped cut-offs.
    """
    rows = facts.where((F.col("sd") == settings.source.city) & F.col("ts").isNotNull())
    moved = F.col("movement_type") == settings.source.movement_type
    population = F.when(moved, F.col("population"))
    sums = rows.groupBy("sgg", "emd", "ts").agg(
        F.count("*").alias("price_rows"),
        X.exact_sum(F.col("price")).alias("price_total"),
        F.count("price").alias("price_n"),
        F.count_if(moved).alias("pop_rows"),
        X.exact_sum(population).alias("pop_total"),
        F.count(population).alias("pop_n"),
    )

    def tagged(signal: str, emd: Column, there: Column) -> Column:
        fields = [F.col(f"{signal}_{f}").alias(f) for f in ("total", "n")]
        keys = [F.lit(signal).alias("signal"), F.col("sgg"), emd.alias("emd"), F.col("ts")]
        return F.when(there, F.struct(*keys, *fields))

    has_side = F.col("sgg").isNotNull() if settings.signal("price").cutoff.late_districts else F.lit(True)
    parts = F.array_compact(
        F.array(
            tagged("price", F.col("emd"), has_side),
            tagged("pop", F.lit(None).cast("string"), F.col("pop_rows") > 0),
        )
    )
    totals = (
        sums.select(F.inline(parts))
        .groupBy("signal", "sgg", "emd", "ts")
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    )
    is_price, total = F.col("signal") == "price", F.col("total").cast("double")
    key = F.when(is_price, X.region_key(settings.key_delimiter, F.col("sgg"), F.col("emd"))).otherwise(F.col("sgg"))
    return totals.select(
        "signal",
        key.alias("series"),
        "sgg",
        "emd",
        "ts",
        F.when(is_price, total / F.nullif(F.col("n"), F.lit(0))).otherwise(total).alias("y"),
    ).select("*", *[c.alias(name) for name, c in split_columns(settings).items()])
