"""Column expressions shared by the operators. All of them stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import fixed_values as fv
from tidewatch.spec import Cutoff, SignalSpec


def month_of(c: Column) -> Column:
    """First day of the month as DATE."""
    return F.trunc(c, "month")


def is_month_code(c: Column) -> Column:
    return (c % 100).between(1, 12)


def month_from_code(c: Column) -> Column:
    """Integer month code YYYYMM as the first day of the month; a bad code gives null."""
    month = c % 100
    return F.when(is_month_code(c), F.make_date(((c - month) / 100).cast("int"), month, F.lit(1)))


def month_code(c: Column) -> Column:
    return (F.year(c) * 100 + F.month(c)).cast("int")


def month_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def to_datetime(c: Column) -> Column:
    """A date as the time at its start, without a zone."""
    return c.cast("timestamp_ntz")


def region_key(delimiter: str, *parts: Column) -> Column:
    """Parts joined by the delimiter; null when any part is null."""
    pieces = [parts[0]]
    for p in parts[1:]:
        pieces += [F.lit(delimiter), p]
    return F.concat(*pieces)


def exact_sum(c: Column) -> Column:
    """Sum over DECIMAL, so that row order, partitioning and task retries do not change the result.

    A number counts with the digits it prints with, up to 18 decimals. A total of 1e20 or more is an error, never a
    wrong number.
    """
    return F.sum(c.cast("decimal(38,18)"))


def exact_mean(c: Column) -> Column:
    """Mean from an exact sum; null for an empty group."""
    return exact_sum(c).cast("double") / F.nullif(F.count(c), F.lit(0))


def half_up(c: Column, digits: int) -> Column:
    """Half-up rounding on the decimal value, as DOUBLE."""
    return F.round(c.cast("decimal(28,8)"), digits).cast("double")


def number_text(c: Column, digits: int = 0) -> Column:
    """Rounded number as text without a trailing ``.0``."""
    rounded = F.round(c.cast("decimal(28,8)"), digits)
    if digits == 0:
        return rounded.cast("bigint").cast("string")
    return F.regexp_replace(rounded.cast(f"decimal(28,{digits})").cast("string"), r"\.?0+$", "")


def cutoff_day(sgg: Column, cutoff: Cutoff) -> Column:
    """Cut-off date of a district. A null district belongs to neither group and gets null."""
    if not cutoff.late_districts:
        return F.lit(cutoff.day)
    late = sgg.isin(*cutoff.late_districts)
    return F.when(late, F.lit(cutoff.late_day)).when(~late, F.lit(cutoff.day))


def cutoff_group(sgg: Column, cutoff: Cutoff) -> Column:
    if not cutoff.late_districts:
        return F.lit("main")
    late = sgg.isin(*cutoff.late_districts)
    return F.when(late, F.lit("late")).when(~late, F.lit("main"))


def outside_band(percentile: Column, low: float = fv.BAND_LOW, high: float = fv.BAND_HIGH) -> Column:
    return (percentile > high) | (percentile < low)


def with_neutral(percentile: Column, signal: SignalSpec) -> Column:
    return percentile if signal.neutral is None else F.coalesce(percentile, F.lit(signal.neutral))


def score_part(percentile: Column, signal: SignalSpec) -> Column:
    """Distance from the middle scaled to 0..1, times the weight."""
    return F.abs(with_neutral(percentile, signal) - 0.5) * 2 * signal.weight


def flag_mask(flags: Sequence[Column]) -> Column:
    """Flags as a bit mask, first flag highest; a null flag counts as not set."""
    mask = F.lit(0)
    for flag in flags:
        mask = mask * 2 + F.when(flag, 1).otherwise(0)
    return mask


def alert_label(mask: Column, names: Sequence[str]) -> Column:
    """Label of a flag mask; the empty mask has none.

    The label depends on the set of flags only, so an indexed literal array replaces a rule chain.
    """
    by_set = {frozenset(members): label for members, label in fv.ALERT_LABELS}
    slots = []
    for value in range(2 ** len(names)):
        members = frozenset(n for i, n in enumerate(names) if value >> (len(names) - 1 - i) & 1)
        slots.append(F.lit(by_set.get(members)).cast("string"))
    return F.element_at(F.array(*slots), mask + 1)


def label_ordinal(label: Column) -> Column:
    """Place of a label in display order, from 1; null for an unknown label."""
    position = F.array_position(F.array(*[F.lit(text) for _, text in fv.ALERT_LABELS]), label)
    return F.nullif(position, F.lit(0)).cast("bigint")


def display_name(c: Column, names: dict[str, str]) -> Column:
    """Code to display text; null for an unknown code."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), c)


def normal_cdf(z: Column) -> Column:
    """Normal distribution function by the published polynomial 7.1.26 of Abramowitz and Stegun, clamped to 0..1."""
    # The published coefficients.
    p, a1, a2, a3, a4, a5 = 0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429
    x = F.abs(z) / F.lit(2.0) ** 0.5
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * x)
    poly = t * (a1 + t * (a2 + t * (a3 + t * (a4 + t * a5))))
    erf = F.lit(1.0) - poly * F.exp(-x * x)
    cdf = F.when(z >= 0, 0.5 * (F.lit(1.0) + erf)).otherwise(0.5 * (F.lit(1.0) - erf))
    return F.least(F.greatest(cdf, F.lit(0.0)), F.lit(1.0))
