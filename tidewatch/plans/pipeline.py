"""The whole dataflow. Without a store every table is a lazy plan; with one, each is written once and read back.

A written table is where lineage ends: a lost executor costs the tasks of the table being built, not the run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import (
    checks,
    completion,
    context,
    detect,
    fuse,
    marts,
    partials,
    profile,
    prompts,
    select,
    series,
    state_space,
)
from tidewatch.plans.store import Store
from tidewatch.plans.versions import Snapshot, VersionedStore
from tidewatch.sources.catalog import Sources
from tidewatch.spec import Settings


class Pipeline:
    def __init__(
        self,
        sources: Sources,
        settings: Settings = Settings(),
        store: Store | None = None,
        client: completion.Client | None = None,
        reuse: bool = False,
    ):
        """client asks a text model; without one a template makes the texts, inside the plan. A client needs a store, since
        a plan may run a step again for a sort or a retry, and a stored reply is asked for once. With reuse, a table that
        the store has is read instead of made.
        """
        if client is not None and store is None:
            raise ValueError("a client needs a store, so that no draft is sent twice")
        self.sources, self.settings, self.store, self.client = sources, settings, store, client
        self.reuse = reuse

    def _table(self, name: str, make: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
        if self.store is None:
            return make()
        stored = self.store.read(name) if self.reuse else None
        return self.store.write(name, make(), partition_by) if stored is None else stored

    # Series and scores

    @cached_property
    def series(self) -> DataFrame:
        return self._table("series", lambda: series.all_series(self.sources, self.settings), ("signal",))

    @cached_property
    def model(self) -> DataFrame:
        spec = self.settings.detector
        fit = state_space.fit if spec.method == "state" else detect.fit
        return self._table("model_params", lambda: fit(self.series, spec), ("signal",))

    @cached_property
    def scores(self) -> DataFrame:
        return self._table("scores", lambda: detect.score(self.series, self.settings.detector), ("signal",))

    def series_of(self, signal: str) -> DataFrame:
        if self.store is None:
            return series.series_of(signal, self.sources, self.settings)
        return self.series.where(F.col("signal") == signal)

    def scores_of(self, signal: str) -> DataFrame:
        if self.store is None:
            return detect.score(self.series_of(signal), self.settings.detector)
        return self.scores.where(F.col("signal") == signal)

    # Districts

    @cached_property
    def customer_profile(self) -> DataFrame:
        return self._table(
            "customer_profile",
            lambda: profile.customer_profile(self.sources["district"], self.sources["income"], self.settings),
        )

    @cached_property
    def sgg_geometry(self) -> DataFrame:
        return profile.sgg_geometry(self.sources["district"])

    @cached_property
    def sgg_profile(self) -> DataFrame:
        return profile.sgg_profile(self.customer_profile)

    # Alerts

    @cached_property
    def alerts(self) -> DataFrame:
        """Alerts without district columns, for figures that do not need them."""
        return fuse.alert_rows(self.scores, self.settings) if self.store is None else self.region_alerts

    @cached_property
    def region_alerts(self) -> DataFrame:
        return self._table(
            "region_alerts",
            lambda: fuse.region_alerts(self.scores, self.sgg_geometry, self.sgg_profile, self.settings),
        )

    @cached_property
    def best_alerts(self) -> DataFrame:
        """Candidate alerts without district columns."""
        return select.alert_candidates(self.alerts, self.settings.selection)

    @cached_property
    def candidates(self) -> DataFrame:
        if self.store is not None:
            return self.best_alerts
        # Choose first: the district columns are then joined to a few rows.
        return fuse.enriched(self.best_alerts, self.sgg_geometry, self.sgg_profile)

    @property
    def alert_points(self) -> DataFrame:
        return prompts.alert_points(self.best_alerts)

    # Context

    @cached_property
    def rental_trend(self) -> DataFrame:
        return self._table("rental_trend", lambda: context.rental_trend(self.sources["rental"], self.settings.context))

    @cached_property
    def call_center(self) -> DataFrame:
        return self._table(
            "call_center_context",
            lambda: context.call_center_context(
                self.sources["calls"], self.sources["call_conversion"], self.settings.context
            ),
        )

    @cached_property
    def traffic_snapshot(self) -> DataFrame:
        return self._table(
            "traffic_snapshot", lambda: context.traffic_snapshot(self.sources["traffic"], self.settings.context)
        )

    @property
    def rentals_text(self) -> DataFrame:
        return context.top_rentals_text(self.rental_trend, self.settings.context)

    @property
    def calls_text(self) -> DataFrame:
        return context.call_context_text(self.call_center, self.settings.context)

    # Prompts and texts

    @cached_property
    def drafts(self) -> DataFrame:
        return self._table(
            "drafts",
            lambda: prompts.drafts(
                self.candidates, self.rentals_text, self.calls_text, self.settings.direction_in_prompts
            ),
        )

    @property
    def alert_scores(self) -> DataFrame:
        return prompts.alert_scores(self.drafts)

    @cached_property
    def responses(self) -> DataFrame:
        """All drafts with one reply each."""
        return self.responses_to(self.drafts)

    def responses_to(self, drafts: DataFrame) -> DataFrame:
        """Drafts with one reply each. Only drafts without a stored reply are sent, and replies are read back.

        Each wave's replies are stored before the next is sent, so a run that fails later has not lost them.
        """
        if self.client is None:
            return drafts.withColumn("response", completion.template_reply(F.col("prompt")))
        settings, keys = self.settings, completion.KEYS
        for wave in completion.in_waves(drafts, settings.request_waves):
            done = self.store.read("responses")
            todo = wave if done is None else completion.missing_only(wave, done)
            requests = todo.select(*keys, "messages", "temperature")
            replies = completion.complete(
                requests,
                self.client,
                settings.request_parallelism,
                settings.request_pause_seconds,
                settings.request_attempts,
                settings.request_backoff_seconds,
                settings.keep_failures,
            )
            if settings.keep_failures:
                replies = self._kept(replies)
            self.store.append("responses", replies.select(*keys, "response"))
        # A draft sent twice by overlapping runs has two replies; one of them is used.
        stored = self.store.read("responses").where("response is not null").groupBy(*keys).agg(F.min("response").alias("response"))
        return drafts.join(stored, keys, "left")

    def _kept(self, replies: DataFrame) -> DataFrame:
        """The replies of a wave; what was tried is stored first, once, so that no request is sent again to tell both."""
        wave, keys = uuid.uuid4().hex, completion.KEYS
        outcome = replies.select(
            *keys, "response", "failure", "attempts", F.lit(wave).alias("wave"), F.current_timestamp().alias("tried_at")
        )
        tried = self.store.append("attempts", outcome)
        return tried.where((F.col("wave") == wave) & F.col("response").isNotNull())

    @property
    def dead_letters(self) -> DataFrame | None:
        """Drafts that were tried and have no reply yet; None if no run has kept failures."""
        tried = None if self.store is None else self.store.read("attempts")
        return None if tried is None else completion.dead_letters(tried, self.store.read("responses"))

    @cached_property
    def marketing_alerts(self) -> DataFrame:
        return self._table("marketing_alerts", self.marketing_of)

    def marketing_of(self, *conditions: Column) -> DataFrame:
        """Alerts with their texts; of all drafts, or only of those that meet the conditions."""
        if self.store is not None and self.reuse and self.store.read("marketing_alerts") is not None:
            return reduce(DataFrame.where, conditions, self.store.read("marketing_alerts"))
        answered = self.responses_to(reduce(DataFrame.where, conditions, self.drafts))
        return prompts.copy_text(answered).select(*prompts.ALERT_COLUMNS, "marketing_copy")

    @property
    def copy_check(self) -> DataFrame:
        return prompts.copy_check(self.marketing_alerts)

    # Marts

    @cached_property
    def signal_timeseries(self) -> DataFrame:
        return self._table("signal_timeseries", lambda: marts.signal_timeseries(self.scores), ("signal_type",))

    @cached_property
    def sgg_summary(self) -> DataFrame:
        return self._table("sgg_summary", lambda: marts.sgg_summary(self.alerts))

    @cached_property
    def telecom_trend(self) -> DataFrame:
        def whole() -> DataFrame:
            return marts.telecom_trend(self.sources["telecom"], self.settings.source)

        if not isinstance(self.store, Snapshot):
            return self._table("telecom_trend", whole)
        # By month, with the partial rows beside it, so that a month can be made again alone.
        return self._table("telecom_trend", lambda: partials.telecom_trend_of(self.telecom_partials), ("year_month",))

    @cached_property
    def telecom_partials(self) -> DataFrame:
        return self._table(
            "telecom_partials",
            lambda: partials.telecom_partials(self.sources["telecom"], self.settings.source),
            ("year_month",),
        )

    @property
    def expectations(self) -> DataFrame:
        return checks.expectations(checks.table_profile(self.series), checks.score_validation(self.scores))

    def run(self) -> dict[str, DataFrame]:
        """Build every table in order and return them."""
        names = (
            "series model scores customer_profile region_alerts rental_trend call_center traffic_snapshot "
            "marketing_alerts signal_timeseries sgg_summary telecom_trend"
        )
        return {name: getattr(self, name) for name in names.split()}


def publish(
    sources: Sources, settings: Settings, store: VersionedStore, client: completion.Client | None = None
) -> int:
    """Builds every table and publishes them as one version; a failed run publishes nothing."""
    with store.run() as run:
        Pipeline(sources, settings, run, client).run()
    return run.number
