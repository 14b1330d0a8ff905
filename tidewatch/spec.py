"""Settings of a run. The defaults are the values the fixed results were made with."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from tidewatch.functions import fixed_values as fv


@dataclass(frozen=True)
class Cutoff:
    """First date of the detection period, optionally later for a group of districts."""

    day: dt.date
    late_day: dt.date | None = None
    late_districts: tuple[str, ...] = ()


@dataclass(frozen=True)
class SignalSpec:
    """How one signal enters the combined score.

    ``grain`` is "sgg" for one score per district and month, or "emd" for several that are rolled up.
    ``neutral`` replaces a missing score; None keeps the null.
    """

    name: str
    weight: float
    cutoff: Cutoff
    grain: str = "sgg"
    low: float = fv.BAND_LOW
    high: float = fv.BAND_HIGH
    neutral: float | None = fv.NEUTRAL


@dataclass(frozen=True)
class DetectorSpec:
    """``method`` is "ecdf" (place in the own history), "trend" (line, month of year, normal residual) or "state" (level,
    trend and season carried along a series; the gains say how far a gap corrects each)."""

    method: str = "ecdf"
    min_points: int = 18
    seasonal_points: int = 24
    prediction_interval: float = 0.99
    level_gain: float = 0.3
    trend_gain: float = 0.02
    season_gain: float = 0.2


@dataclass(frozen=True)
class SourceFilter:
    city: str = fv.CITY
    price_level: str = fv.PRICE_LEVEL
    population_level: str = fv.POPULATION_LEVEL
    movement_type: str = fv.MOVE_IN
    install_state: str = fv.INSTALL_STATE
    province_code: int = fv.PROVINCE_CODE


@dataclass(frozen=True)
class ContextSpec:
    window_months: int = 3
    rental_main_placeholder: str = fv.RENTAL_UNCLASSIFIED
    rental_sub_placeholder: str = fv.RENTAL_UNCLASSIFIED
    call_division: str = fv.CALL_INBOUND
    call_placeholder: str = fv.CALL_OTHER
    top_rentals: int = 3
    top_calls: int = 3
    road_districts: tuple[tuple[str, str], ...] = ()
    slow_below: float = 20.0
    fast_from: float = 30.0


@dataclass(frozen=True)
class SelectionSpec:
    score_floor: float = 0.25
    per_district: int = 15


def default_signals(
    price: Cutoff = Cutoff(dt.date(2023, 1, 1), dt.date(2024, 1, 1), fv.LATE_PRICE_DISTRICTS),
    pop: Cutoff = Cutoff(dt.date(2023, 1, 1)),
    telecom: Cutoff = Cutoff(dt.date(2024, 1, 1)),
    card: Cutoff = Cutoff(dt.date(2023, 1, 1)),
) -> tuple[SignalSpec, ...]:
    w = fv.SIGNAL_WEIGHTS
    return (
        SignalSpec("price", w["price"], price, grain="emd"),
        SignalSpec("pop", w["pop"], pop, neutral=None),
        SignalSpec("telecom", w["telecom"], telecom),
        SignalSpec("card", w["card"], card),
    )


@dataclass(frozen=True)
class Settings:
    """``driver`` names the signal a district and month must have a score of to be able to alert;
    ``grain_fallback`` gives districts whose sub-districts mostly have fewer than ``grain_points`` months one price
    series; ``densify`` fills months without rows; ``flag_share`` asks for that share of flagged sub-districts before a
    district's price is flagged, None for any one; ``direction_in_prompts`` adds to a prompt which way each flagged
    signal went. ``request_parallelism`` is the most text requests in flight, ``request_pause_seconds`` the pause after
    each in a task, ``request_waves`` the parts whose replies are stored one after the other. A request is sent up to
    ``request_attempts`` times, after pauses that double from ``request_backoff_seconds``; then it fails the run, or with
    ``keep_failures`` becomes a dead letter: its alert is published without a text, and the next run asks again."""

    signals: tuple[SignalSpec, ...] = field(default_factory=default_signals)
    driver: str = "pop"
    detector: DetectorSpec = DetectorSpec()
    source: SourceFilter = SourceFilter()
    context: ContextSpec = ContextSpec()
    selection: SelectionSpec = SelectionSpec()
    key_delimiter: str = "_"
    grain_points: int = 24
    grain_fallback: bool = False
    densify: bool = False
    flag_share: float | None = None
    direction_in_prompts: bool = False
    request_parallelism: int = 8
    request_pause_seconds: float = 0.0
    request_waves: int = 1
    request_attempts: int = 1
    request_backoff_seconds: float = 1.0
    keep_failures: bool = False

    def signal(self, name: str) -> SignalSpec:
        return next(s for s in self.signals if s.name == name)
