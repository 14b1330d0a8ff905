"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. The index posts every vector in the inverted files of these
pivots, with the pivot's place in its order. A query reads the files of its own nearest pivots, ranks what it finds by
the footrule distance of the two orders, and reranks the best share by the exact inner product.

The index is cut into shards by a hash of the id, the queries into blocks; a task builds the inverted files of one shard
and answers one block. Both sizes are parameters, so memory is bounded, whatever the table; the best of each shard are
merged by query. Inner products are turned into nearness by one more component that gives all indexed vectors the same
length. Pivots are a bounded sample; every row is indexed.

A file holds a small number for each vector of its shard, the weight of the pivot's place, so files are read whole and added
up without look-ups. The work grows with queries times vectors, as the share that is reranked does.

Equal vectors are one entry with their smallest ids, as many as an answer can name, so a large group of copies neither
fills the share that is reranked nor hides other vectors, and the smaller ids are always the ones named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.projection_dedup import takes_part
from tidewatch.llm.shared import Scratch

# Parameters: pivots, pivots that represent a vector, share of a shard that is reranked, vectors in a shard, queries in a
# block.
PIVOTS, NEAREST, SHARE = 512, 64, 0.25
SHARD, QUERY_BLOCK = 8192, 2048


def matrix(vectors, dim: int) -> np.ndarray:
    """Vectors as rows in double precision, padded with zeros to dim components."""
    out = np.zeros((len(vectors), dim))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


class InvertedFiles:
    """Postings of one shard: for each pivot its weight in the order of each vector: nearest for the first place, 1 for the
    last, 0 if it doesn't represent the vector.
    """

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, longest: float, nearest: int):
        """vectors: rows; pivots: rows with the added component; longest: largest length of an indexed vector."""
        self.vectors, self.pivots, self.nearest = vectors, pivots, min(nearest, len(pivots))
        added = np.sqrt(np.maximum(longest**2 - (vectors * vectors).sum(axis=1), 0.0))
        order = self.orders(np.hstack([vectors, added[:, None]]))
        weights = np.arange(self.nearest, 0, -1, dtype=np.uint8 if self.nearest < 256 else np.uint32)
        self.files = np.zeros((len(pivots), len(vectors)), dtype=weights.dtype)
        self.files[order, np.arange(len(vectors))[:, None]] = weights
        # A query's own weights, laid out as the files it reads; equal for all queries.
        self.asked = np.repeat(weights[:, None], len(vectors), axis=1)
        self.read = np.empty_like(self.asked)
        self.sums = np.uint16 if self.nearest < 256 else np.uint64

    def orders(self, augmented: np.ndarray) -> np.ndarray:
        """The nearest pivots of each row, nearest first."""
        near = augmented @ self.pivots.T
        if self.nearest < near.shape[1]:
            some = np.argpartition(-near, self.nearest - 1, axis=1)[:, : self.nearest]
        else:
            some = np.tile(np.arange(near.shape[1]), (len(near), 1))
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)

    def by_footrule(self, order: np.ndarray, many: int) -> np.ndarray:
        """The many vectors with the least footrule distance to an order, and all that are as near as the last of them.

        An absent pivot counts as just behind the last. What a pivot takes off the distance of two orders without a common
        one is twice the lesser of its two weights.
        """
        if many >= len(self.vectors):
            return np.arange(len(self.vectors))
        np.take(self.files, order, axis=0, out=self.read, mode="clip")
        np.minimum(self.read, self.asked, out=self.read)
        saved = np.add.reduce(self.read, axis=0, dtype=self.sums)
        return np.flatnonzero(saved >= np.partition(saved, len(saved) - many)[len(saved) - many])

    def best_of(self, some: np.ndarray, ids: np.ndarray, query: np.ndarray, longest: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of some vectors the k with the largest inner products, ties by smaller id, and these products.

        One matrix product leaves out what is further from the best than its rounding may account for.
        """
        rough = self.vectors.take(some, axis=0) @ query
        slack = 4 * (len(query) + 1) * np.finfo(float).eps * longest * np.sqrt(query @ query)
        some = some[~(rough < np.partition(rough, len(rough) - k)[len(rough) - k] - slack)]
        scores = (self.vectors[some] * query).sum(axis=1)
        best = _best(ids[some], scores, k)
        return some[best], scores[best]


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    pivots: int = PIVOTS,
    represent: int = NEAREST,
    share: float = SHARE,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each query the k nearest rows found, by inner product.

    vectors has rows (vec_id, embedding); is_query is a condition on vec_id. All rows but the query's own are candidates.
    score is the inner product of the original vectors in double precision; equal scores go by the smaller vec_id. With k
    candidates or fewer all are returned. Vectors that are null, empty or zero, or hold a null or non-finite component,
    and rows without vec_id take no part. Rows that share a vec_id count once, with the smallest vector in array order.
    Shorter vectors are read as if zeros followed. Other columns are ignored; an empty table gives no rows.
    """
    usable = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & takes_part(F.col("embedding")))
    scratch = Scratch(vectors.sparkSession)
    # Both are written once: rows serve the queries and the entries, entries the count, the pivots and the index.
    rows = usable.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("asks", is_query)
    rows = scratch.keep(rows, "rows")
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    asked = F.sum(F.when(F.col("asks"), 1).otherwise(0))
    n_queries, dim, longest = rows.agg(
        F.coalesce(asked, F.lit(0)), F.max(F.size("embedding")), F.sqrt(F.max(squares))
    ).first()
    alike = Window.partitionBy("embedding").orderBy("vec_id")
    smallest = rows.withColumn("rank", F.row_number().over(alike)).where(F.col("rank") <= k + 1)
    entries = smallest.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = scratch.keep(entries.select(F.col("ids")[0].alias("vec_id"), "ids", "embedding"), "entries")
    n = entries.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards, blocks = -(-n // SHARD), max(1, -(-n_queries // QUERY_BLOCK))
    sample = entries.orderBy(F.xxhash64(F.lit("pivot"), "vec_id")).limit(pivots).collect()
    chosen = matrix([r["embedding"] for r in sample], dim)
    chosen = np.hstack([chosen, np.sqrt(np.maximum(longest**2 - (chosen * chosen).sum(axis=1), 0.0))[:, None]])

    def answer(key, index: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = list(_answers(index, asking, chosen, dim, longest, represent, share, k))
        columns = {name: np.concatenate([o[i] for o in out]) for i, name in enumerate(("query_id", "vec_id", "score")) if out}
        return pd.DataFrame(columns, columns=["query_id", "vec_id", "score"])

    # Both sides' keys have one type: grouped sides meet by the hash of their keys, which differs between types.
    own_shard = F.pmod(F.xxhash64(F.lit("shard"), "vec_id"), F.lit(shards)).cast("int")
    own_block = F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)).cast("int")
    indexed = entries.select(
        "ids", "embedding", own_shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    )
    asking = rows.where("asks").select(
        "vec_id", "embedding", own_block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    )
    found = (
        indexed.groupBy("shard", "block")
        .cogroup(asking.groupBy("shard", "block"))
        .applyInPandas(answer, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _answers(index, asking, pivots, dim, longest, represent, share, k) -> Iterator[tuple]:
    """(query ids, vector ids, scores) of each query's best of one shard."""
    if not len(index) or not len(asking):
        return
    groups = [np.asarray(g) for g in index["ids"]]
    ids = np.array([g[0] for g in groups])
    files = InvertedFiles(matrix(index["embedding"], dim), pivots, longest, represent)
    queries = matrix(asking["embedding"], dim)
    orders = files.orders(np.hstack([queries, np.zeros((len(queries), 1))]))
    many = max(int(np.ceil(share * len(ids))), 8 * k)
    for own, query, order in zip(asking["vec_id"].to_numpy(), queries, orders, strict=True):
        some = files.by_footrule(order, many)
        # One entry more than asked for, as an entry may hold no id but the query's own.
        best, scores = files.best_of(some, ids, query, longest, min(k + 1, len(some)))
        named = np.concatenate([groups[e] for e in best])
        score = np.repeat(scores, [len(groups[e]) for e in best])
        named, score = named[named != own], score[named != own]
        first = np.lexsort((named, -score))[:k]
        yield np.full(len(first), own), named[first], score[first]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by smaller id."""
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    some = np.flatnonzero(scores >= least)
    return some[np.lexsort((ids[some], -scores[some]))[:k]]
