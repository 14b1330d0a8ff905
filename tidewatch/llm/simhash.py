"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most r bits exactly if some value lies within r/2 bits of both. So every fingerprint has
all variants within r/2 flips, and fingerprints meet at equal variants.

The shuffle on variants goes by a number of routing bits: a fingerprint is sent once to every bucket that one of its
variants falls into, with the flips it has left, and the bucket's task makes the variants of the other bits. With 8
routing bits that is 37 rows instead of 2,081. Routing bits are the most balanced ones, and there are so many that a
bucket has some thousand fingerprints of its own; a bucket that is still too large is split on further bits inside its
task, so memory is bounded for any data. All fingerprints of a variant are within r bits of each other, so a chain through
them loses no link between groups, and a bucket returns a spanning forest instead of pairs. Copies meet as one
fingerprint, however many rows they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import Scratch, free_name, hex64, over_texts, with_roots

SEED = 42
#: Shingles hashed at once, so that a very long text takes bounded memory.
CHUNK = 1 << 16
#: Fingerprints that a bucket has on average, and variants made at once.
PER_BUCKET, VARIANTS = 700, 2_000_000


def shingle_hashes(text: str, words_per_shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, in chunks. Only A-Z is lower-cased, only ASCII white space parts words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return
    width = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(words) - width + 1, CHUNK):
        first = starts[at : min(at + CHUNK, len(words) - width + 1)].tolist()
        last = ends[at + width - 1 : at + width - 1 + len(first)].tolist()
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], dtype=np.uint64)


def fingerprint_of(text: str | None, words_per_shingle: int = 4) -> int:
    """Bits set in over half of the shingle hashes, as a signed 64-bit number; zero for a text without words."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text or "", words_per_shingle):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0]) if total else 0


def fingerprint(text: Column, words_per_shingle: int = 4) -> Column:
    """64-bit SimHash of a text column as a long. Null counts as empty."""

    def start():
        return lambda texts: [fingerprint_of(t, words_per_shingle) for t in texts]

    return over_texts(text, "long", pa.int64(), start)


def _flips(bits: list[int], most: int) -> list[np.ndarray]:
    """For 0 to most flips, the masks of all choices among bits."""
    return [
        np.array([sum(1 << b for b in chosen) for chosen in combinations(bits, k)], dtype=np.uint64)
        for k in range(most + 1)
    ]


def roots_of(pairs_a: np.ndarray, pairs_b: np.ndarray, size: int) -> np.ndarray:
    """Smallest index reachable from each index over the pairs."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[pairs_a], label[pairs_b])
        following = label.copy()
        np.minimum.at(following, label[pairs_a], low)
        np.minimum.at(following, label[pairs_b], low)
        following = following[following]
        if np.array_equal(following, label):
            return label
        label = following


def meetings(values: np.ndarray, flips: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that link all values with a common variant. flips: how many of bits each value may still flip.

    When the variants are too many to be made at once, the next bit is fixed to 0 and then to 1: a value goes on to its own
    side as it is, and to the other side with one flip less.
    """
    balls = np.array([sum(math.comb(len(bits), k) for k in range(f + 1)) for f in range(int(flips.max(initial=0)) + 1)])
    if not len(values) or len(values) == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if balls[flips].sum() > VARIANTS and bits:
        found, (bit, *rest) = [], bits
        set_here = (values >> np.uint64(bit)) & np.uint64(1)
        for side in (0, 1):
            left = flips - (set_here != side)
            there = np.flatnonzero(left >= 0)
            moved = (values[there] & ~np.uint64(1 << bit)) | np.uint64(side << bit)
            a, b = meetings(moved, left[there], rest)
            found.append((there[a], there[b]))
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
    masks = _flips(bits, int(flips.max(initial=0)))
    made, owners = [], []
    for f in range(len(masks)):
        own = np.flatnonzero(flips == f)
        mask = np.concatenate(masks[: f + 1])
        made.append((values[own, None] ^ mask[None, :]).ravel())
        owners.append(np.repeat(own.astype(np.int32), len(mask)))
    variant, owner = np.concatenate(made), np.concatenate(owners)
    order = np.argsort(variant)
    variant, owner = variant[order], owner[order].astype(np.int64)
    same = np.flatnonzero(variant[1:] == variant[:-1])
    pairs = np.unique(np.minimum(owner[same], owner[same + 1]) * len(values) + np.maximum(owner[same], owner[same + 1]))
    a, b = pairs // len(values), pairs % len(values)
    return a[a != b], b[a != b]


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that connect the distinct longs in column fp of prints as all pairs within radius would."""
    half = radius // 2
    spread = [F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
    total, *ones = prints.agg(F.count("*"), *spread).first()
    if not total:
        return prints.sparkSession.createDataFrame([], "a long, b long")
    by_balance = sorted(range(64), key=lambda i: abs(2 * ones[i] - total))
    routing = by_balance[: min(40, max(4, math.ceil(math.log2(total / PER_BUCKET + 1))))]
    rest = by_balance[len(routing) :]
    mask = _signed(sum(1 << b for b in routing))
    moves = [
        (_signed(m), half - k) for k, masks in enumerate(_flips(routing, half)) for m in masks.tolist()
    ]

    def collide(group: pd.DataFrame) -> pd.DataFrame:
        fps = group["fp"].to_numpy()
        free = np.uint64(~sum(1 << b for b in routing) & (2**64 - 1))
        a, b = meetings(fps.view(np.uint64) & free, group["flips"].to_numpy().astype(np.int64), rest)
        near = np.bitwise_count(fps[a].view(np.uint64) ^ fps[b].view(np.uint64)) <= radius
        root = roots_of(a[near], b[near], len(fps))
        linked = np.flatnonzero(root != np.arange(len(fps)))
        return pd.DataFrame({"a": fps[linked], "b": fps[root[linked]]})

    steps = F.explode(F.array(*[F.struct(F.lit(m).alias("move"), F.lit(f).alias("flips")) for m, f in moves]))
    sent = prints.select("fp", steps.alias("s")).select(
        "fp", F.col("fp").bitwiseAND(F.lit(mask)).bitwiseXOR(F.col("s.move")).alias("bucket"), "s.flips"
    )
    return sent.groupBy("bucket").applyInPandas(collide, "a long, b long")


def _signed(number: int) -> int:
    return number - 2**64 if number >= 2**63 else number


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, words_per_shingle: int = 4
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per row of docs.

    Texts link when their fingerprints differ in at most radius bits (an even number); component_id is the smallest id
    reachable over links, the own id included. Texts without words, null ones too, have fingerprint zero and link like any
    other. Repeated rows stay repeated. A row without an id has the component of its fingerprint, null if no row there has
    an id. Other columns are ignored.
    """
    if radius % 2:
        raise ValueError("radius must be even: two balls of half of it meet in the middle")
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), words_per_shingle).alias("fp"))
    own = scratch.keep(own, "fingerprints")
    named = _components(own, radius, scratch).select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def _components(own: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """fp, root (a fingerprint of its component, the same for all of it) and component_id, from rows (doc_id, fp)."""
    prints = scratch.keep(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    edges = scratch.keep(links(prints, radius), "edges")
    roots = with_roots(edges, scratch).select(F.col("node").alias("fp"), "root")
    placed = prints.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.join(smallest, "root").select("fp", "root", "component_id")


def first_of_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, words_per_shingle: int = 4
) -> DataFrame:
    """The rows of docs that stay: one of every group of near-duplicates, the first by id (none last), then text (null first).

    Rows are judged one by one, by the component of their own text: rows with the same id and texts that aren't alike
    stay, each for its group, and of rows without an id one stays of a group in which no row has one. Of repeated rows one
    stays. Links are those of near_duplicates.
    """
    if radius % 2:
        raise ValueError("radius must be even: two balls of half of it meet in the middle")
    scratch = Scratch(docs.sparkSession)
    # A text is named by a hash that the JVM makes, so that fingerprints are computed once and texts don't move with them.
    text_key = F.xxhash64(F.col(text_col))
    own = docs.select(
        F.col(id_col).alias("doc_id"), text_key.alias("text_key"), fingerprint(F.col(text_col), words_per_shingle).alias("fp")
    )
    own = scratch.keep(own, "fingerprints")
    group, key, first, rank = (free_name(docs, name) for name in ("group", "text_key", "first_id", "rank"))
    rows = own.groupBy("doc_id", "text_key", "fp").agg(F.lit(1).alias("one")).join(_components(own, radius, scratch), "fp")
    stay = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("root").alias(group), F.col("text_key").alias(key), F.col("doc_id").alias(first)
    )
    same = F.col(id_col).eqNullSafe(F.col(first)) & (text_key == F.col(key))
    order = Window.partitionBy(group).orderBy(text_col)
    ranked = docs.join(stay, same).withColumn(rank, F.row_number().over(order))
    return ranked.where(F.col(rank) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
