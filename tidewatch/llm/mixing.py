"""Mixing to target weights with soft membership, in DataFrame operations only.

A classifier learned from a labelled table gives every document its posterior over domains. Document rates r >= 0 are then
fitted so that the expected tokens of each domain, the sum over documents of rate x tokens x posterior, match the targets:
least squares by projected gradient, started at rate 1, so of all solutions one close to the natural mix is found.

Text is read twice: for the bounded labelled sample, and to write posteriors and token counts. After that a step only
needs, from each task, one sum per domain. A document's rate follows from its posterior and the steps' gradients, which
are a few numbers each, so no step writes or shuffles a row per document, and what the driver sees is bounded by the number
of domains. Steps are preconditioned by the tokens of a document (equal posteriors get equal rates) and by the domains'
token matrix, so that some ten steps do.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import Scratch, free_name

# Parameters: labelled rows to learn from at most, hashed word features, steps at most, residual at which to stop.
MAX_LABELLED = 20_000
FEATURES = 1 << 12
STEPS, CLOSE = 40, 1e-9
WHITE = r"[ \t\n\x0B\f\r]+"


def word_count(text: Column) -> Column:
    """Tokens as runs of anything but ASCII white space; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def classifier(docs: DataFrame, labels: DataFrame, domains: Sequence[str], max_labelled: int) -> PipelineModel | None:
    """Logistic regression over hashed words, learned from the texts of at most max_labelled documents.

    labels has rows (doc_id, domain). The sample is the ids with the smallest hashes; it is the only bounded part, and
    what makes it safe to broadcast. A repeated id counts once, with its smallest text and its first domain. None without
    any labelled document.
    """
    number = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1
    sample = (
        labels.where(F.col("domain").isin(list(domains)) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(number).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    learned = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=WHITE)
    hashed = HashingTF(inputCol="words", outputCol="counts", numFeatures=FEATURES)
    unit = Normalizer(inputCol="counts", outputCol="features")
    fitted = LogisticRegression(regParam=1e-3, maxIter=50, family="multinomial", probabilityCol="probability")
    learned = Scratch(docs.sparkSession).keep(learned, "labelled")
    return None if learned.isEmpty() else Pipeline(stages=[words, hashed, unit, fitted]).fit(learned)


def with_posteriors(
    docs: DataFrame, model: PipelineModel | None, domains: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """doc_id, n_tokens and posterior (one probability per domain) of docs (doc_id, text), after the columns to keep."""
    rows = docs.select(*keep, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if model is None:
        posterior = F.array(*[F.lit(1.0 / len(domains))] * len(domains))
    else:
        rows = model.transform(rows)
        known = vector_to_array("probability")
        posterior = F.array(*[F.coalesce(F.get(known, F.lit(k)), F.lit(0.0)) for k in range(len(domains))])
    return rows.select(*keep, "doc_id", word_count(F.col("text")).alias("n_tokens"), posterior.alias("posterior"))


def least_rate(posterior: Column, domains: Sequence[str], whole: Sequence[str]) -> Column:
    """1 for a document whose likeliest domain is one of whole, else 0."""
    inside = [F.get(posterior, F.lit(k)) for k, name in enumerate(domains) if name in whole]
    outside = [F.get(posterior, F.lit(k)) for k, name in enumerate(domains) if name not in whole]
    if not inside or not outside:
        return F.lit(1.0 if inside else 0.0)
    best, other = (x[0] if len(x) == 1 else F.greatest(*x) for x in (inside, outside))
    return F.when(best >= other, 1.0).otherwise(0.0)


def fitted_rate(posterior: Column, gradients: Sequence[np.ndarray], least: Column | None = None) -> Column:
    """The rate of a document after the given steps, each projected to rates of least (zero) and above."""
    least = F.lit(0.0) if least is None else least

    def step(rate: Column, gradient: np.ndarray) -> Column:
        slope = reduce(lambda a, b: a + b, [F.get(posterior, F.lit(k)) * float(g) for k, g in enumerate(gradient)])
        return F.greatest(least, rate - slope)

    return reduce(step, gradients, F.lit(1.0))


def budget_for(rows: DataFrame, share: np.ndarray, domains: Sequence[str], whole: Sequence[str], budget: float) -> float:
    """The smallest budget, of the given one or above, at which each domain of whole is aimed at with all its tokens."""
    sums = [F.sum(F.col("n_tokens") * F.get("posterior", F.lit(k))) for k in range(len(domains))]
    total, *natural = rows.agg(F.sum("n_tokens"), *sums).first()
    parts = zip(domains, natural, share, strict=True)
    return max([budget, *[n / (total * s) for name, n, s in parts if total and s > 0 and name in whole]])


def gradients_for(rows: DataFrame, weights: Sequence[float], least: Column | None = None) -> list[np.ndarray]:
    """The steps of the projected gradient, for rows (n_tokens, posterior).

    The targets are the weights times all tokens of rows; no rate falls below least.
    """
    d = len(weights)
    p = [F.get("posterior", F.lit(k)) for k in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    total, *sums = rows.agg(
        F.sum("n_tokens"), *[F.sum(F.col("n_tokens") * p[i] * p[j]) for i, j in pairs]
    ).first()
    if not total:
        return []
    gram = np.zeros((d, d))
    for (i, j), s in zip(pairs, sums, strict=True):
        gram[i, j] = gram[j, i] = s
    solve = np.linalg.inv(gram + np.eye(d) * 1e-9 * gram.trace())
    target, taken = np.asarray(weights) * total, []
    for _ in range(STEPS):
        rate = fitted_rate(F.col("posterior"), taken, least)
        reached = np.array(rows.agg(*[F.sum(F.col("n_tokens") * rate * x) for x in p]).first(), dtype=float)
        if np.abs(reached - target).max() <= CLOSE * total:
            break
        taken.append(solve @ (reached - target))
    return taken


@dataclass(frozen=True)
class Plan:
    """What fixes every document's rate: the classifier, the domains and the steps of the fit."""

    model: PipelineModel | None
    domains: tuple[str, ...]
    gradients: tuple[np.ndarray, ...]
    rows: DataFrame
    whole: tuple[str, ...] = ()


def plan(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict[str, float],
    budget: float = 1.0,
    max_labelled: int = MAX_LABELLED,
    whole: Sequence[str] = (),
) -> Plan:
    """Learns the classifier and fits the rates; see rates.

    whole: domains that lose no document. The budget grows until it holds their tokens, whatever their share, and no
    document that is likeliest in one of them gets a rate below 1.
    """
    scratch = Scratch(docs.sparkSession)
    domains = list(weights)
    share = np.array([weights[k] for k in domains], dtype=float)
    model = classifier(docs, labels, domains, max_labelled)
    rows = scratch.keep(with_posteriors(docs.select("doc_id", "text"), model, domains), "posteriors")
    share = share / share.sum()
    if whole:
        budget = budget_for(rows, share, domains, whole, budget)
    least = least_rate(F.col("posterior"), domains, whole) if whole else None
    return Plan(model, tuple(domains), tuple(gradients_for(rows, budget * share, least)), rows, tuple(whole))


def rates(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict[str, float],
    budget: float = 1.0,
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """doc_id, n_tokens, posterior (in the order of weights) and rate, one row per row of docs (doc_id, text).

    labels: rows (doc_id, domain); a domain outside weights teaches nothing, and without any labelled document all
    posteriors are even. weights: nonnegative, scaled to sum to 1. budget: expected tokens in all, as a share of the
    tokens of docs. Null and empty texts have no tokens; their rate follows from the posterior of an empty text. Repeated
    rows count as often as they come; missing ids are kept; other columns are ignored; an empty table gives no rows. If no
    nonnegative rates reach the targets, the rates are those of the least squares so far, measured in the domains' own
    token matrix.
    """
    fitted = plan(docs, labels, weights, budget, max_labelled)
    rate = fitted_rate(F.col("posterior"), fitted.gradients)
    return fitted.rows.select("doc_id", "n_tokens", "posterior", rate.alias("rate"))


def taken(docs: DataFrame, fitted: Plan) -> DataFrame:
    """The rows of docs, each as often as its rate says, with the columns of docs.

    Posteriors are computed along with the rows, so nothing is joined or shuffled. Whether a fraction gives one copy more
    is drawn by a hash of id and text.
    """
    whole = free_name(docs, "whole")
    packed = docs.select(F.struct("*").alias(whole), F.col("doc_id"), F.col("text"))
    scored = with_posteriors(packed, fitted.model, fitted.domains, keep=(whole,))
    least = least_rate(F.col("posterior"), fitted.domains, fitted.whole) if fitted.whole else None
    rate = fitted_rate(F.col("posterior"), fitted.gradients, least)
    times = copies(rate, F.col(f"{whole}.doc_id"), F.col(f"{whole}.text"))
    return scored.select(whole, F.explode(F.array_repeat(F.lit(1), times))).select(f"{whole}.*")


def copies(rate: Column, *identity: Column) -> Column:
    """How often a document is taken: its rate's whole part, and once more by a hash of its identity for the rest."""
    uniform = F.pmod(F.xxhash64(*identity), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate).cast("int") + (uniform < rate - F.floor(rate)).cast("int")
