"""From documents to packed training sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import language_id, mixing, packing, queries, secret_scan, simhash, token_counts
from tidewatch.llm.shared import Scratch, free_name

#: Documents whose language is this uncertain go, as do those without a letter.
MIN_LANGUAGE_SCORE = 0.5
#: Expected tokens after mixing as a share of those before; more where the clean domains need more to stay whole.
MIX_BUDGET = 1.25
CLEAN = ("good", "poor")


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that the piece model is sure of, which becomes their lang."""
    model = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = free_name(docs, "found")
    sure = docs.withColumn(found, model.predict(F.col("text"))).where(
        (F.col(f"{found}.lang_pred") != language_id.UNDETERMINED) & (F.col(f"{found}.score") >= MIN_LANGUAGE_SCORE)
    )
    return sure.withColumn("lang", F.col(f"{found}.lang_pred")).drop(found)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near-duplicates, row by row: ids may repeat or be missing."""
    return simhash.first_of_group(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their text replaced by a mark."""
    return docs.withColumn("text", secret_scan.redacted(F.col("text"))).withColumn(
        "n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)
    )


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, so that the domains' tokens come to their weights; clean ones at least once."""
    labels = queries.domains(queries.table(spark, sf_dir, "labels"))
    plan = mixing.plan(docs, labels, queries.WEIGHTS, MIX_BUDGET, whole=CLEAN)
    return mixing.taken(docs, plan)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences' pieces, in tokens of the public vocabulary."""
    return packing.packed(docs, start=token_counts.counter())


STAGES = [
    ("language_id", identified),
    ("near_duplicates", deduplicated),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: The stages learn models and follow links to any length, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each result is written and read again as the next one's documents."""
    scratch = Scratch(spark)
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
