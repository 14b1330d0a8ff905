"""The registered queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (
    collocations,
    language_id,
    license_scan,
    mixing,
    packing,
    paragraph_dedup,
    permutation_index,
    piece_codec,
    projection_dedup,
    secret_scan,
    simhash,
    source_divergence,
    token_counts,
)

#: Target weights of the domains that the labels name. Their natural shares are some 0.75, 0.12 and 0.13.
WEIGHTS = {"good": 0.84, "poor": 0.11, "toxic": 0.05}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of labelled documents; rows without either label have none."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = mixing.rates(docs, domains(labels), WEIGHTS)
    shares = [F.get("posterior", F.lit(i)).alias(f"p_{name}") for i, name in enumerate(WEIGHTS)]
    return found.select("doc_id", "n_tokens", *shares, "rate")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.line_tokens(table(spark, sf_dir, "documents"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), start=token_counts.counter())


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_tokens": op3_tokens,
    "op4_vectors": op4_vectors,
    "op5_licenses": op5_licenses,
    "op6_passages": op6_passages,
    "op7_packing": op7_packing,
    "op8_neighbours": op8_neighbours,
    "op9_language": op9_language,
    "op10_secrets": op10_secrets,
    "op11_pieces": op11_pieces,
    "op12_collocations": op12_collocations,
    "op13_divergence": op13_divergence,
}

ORACLE: dict[str, str] = {
    "op4_vectors": """
        WITH RECURSIVE vector AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        ), usable AS (
            SELECT * FROM vector
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL
              AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
              AND len([x FOR x IN e IF x <> 0]) > 0
        ), link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), reached(vec_id, other) AS (
            SELECT vec_id, vec_id FROM embeddings
            UNION
            SELECT r.vec_id, l.b FROM reached r JOIN link l ON l.a = r.other
        ), component AS (
            SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
        )
        SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
        FROM embeddings e
        LEFT JOIN component c ON c.vec_id = e.vec_id
        LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) l ON l.a = e.vec_id
    """,
    "op5_licenses": license_scan.oracle(),
    "op12_collocations": collocations.oracle(),
    "op13_divergence": source_divergence.oracle(),
}
