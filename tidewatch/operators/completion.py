"""Row-wise text completion as a batch step with a pluggable client."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A client gets the message list and the options of one request and returns the reply as JSON text.
Client = Callable[[list[dict], dict], str]

KEYS = ["region_key", "alert_date", "prompt_hash"]
REGION_LINE = r"^\[지역\] (.*) \([^)]*\)$"
SERVICE_LINE = r"^\[서비스\] (.*)$"


def template_reply(prompt: Column) -> Column:
    """The reply used without a client: region and service of the prompt in one line, of whatever length that is."""
    words = [F.regexp_extract(prompt, f"(?m){line}", 1) for line in (REGION_LINE, SERVICE_LINE)]
    text = F.concat_ws(" ", *[F.nullif(w, F.lit("")) for w in words])
    return F.to_json(F.struct(F.array(F.struct(text.alias("messages"))).alias("choices")))


def complete(
    drafts: DataFrame,
    client: Client,
    parallelism: int = 8,
    pause_seconds: float = 0.0,
    attempts: int = 1,
    backoff_seconds: float = 1.0,
    keep_failures: bool = False,
) -> DataFrame:
    """The rows with a ``response`` column: one reply per row.

    A row costs a model call, not bytes, so rows are spread over ``parallelism`` tasks, which is also the most
    requests in flight; ``pause_seconds`` spaces the requests of a task. A task holds one Arrow batch at a time.

    A request that fails is sent again, up to ``attempts`` times in all, after pauses that double from
    ``backoff_seconds``. If all fail, the task does, unless ``keep_failures``: then the row has no response, and a
    ``failure`` column says what went wrong and ``attempts`` how often it was tried.
    """
    if attempts < 1:
        raise ValueError("a request is sent at least once")

    def ask(messages: list[dict], options: dict) -> tuple[str | None, str | None, int]:
        for attempt in range(1, attempts + 1):
            try:
                return client(messages, options), None, attempt
            except Exception as error:
                if attempt == attempts:
                    if not keep_failures:
                        raise
                    return None, f"{type(error).__name__}: {error}", attempt
                time.sleep(backoff_seconds * 2 ** (attempt - 1))
        raise AssertionError("unreachable")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = []
            for sent, temperature in zip(batch["messages"], batch["temperature"]):
                replies.append(ask(json.loads(sent), {"temperature": temperature}))
                if pause_seconds:
                    time.sleep(pause_seconds)
            answered = batch.assign(response=[r[0] for r in replies])
            if keep_failures:
                answered = answered.assign(failure=[r[1] for r in replies], attempts=[r[2] for r in replies])
            yield answered

    schema = drafts.schema.add("response", "string")
    if keep_failures:
        schema = schema.add("failure", "string").add("attempts", "integer")
    return drafts.repartition(parallelism, "region_key", "alert_date").mapInPandas(run, schema)


def in_waves(drafts: DataFrame, waves: int) -> list[DataFrame]:
    """The drafts in parts by a hash of their key, so that the replies of a part can be stored before the next."""
    part = F.pmod(F.xxhash64(*KEYS), F.lit(waves))
    return [drafts.where(part == w) for w in range(waves)] if waves > 1 else [drafts]


def missing_only(drafts: DataFrame, done: DataFrame) -> DataFrame:
    """Drafts without a stored reply: the same region, month and prompt are not asked again."""
    return drafts.join(done, KEYS, "left_anti")


def dead_letters(tried: DataFrame, done: DataFrame | None) -> DataFrame:
    """Of each draft that was tried and has no reply in done: how often, in how many runs, and the newest failure."""
    open_ones = tried if done is None else tried.join(done, KEYS, "left_anti")
    return open_ones.groupBy(*KEYS).agg(
        F.sum("attempts").alias("attempts"),
        F.countDistinct("wave").alias("waves"),
        F.max_by("failure", "tried_at").alias("failure"),
        F.max("tried_at").alias("tried_at"),
    )
