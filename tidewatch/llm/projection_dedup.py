"""Near-duplicate vectors by collision counting over one-dimensional projections.

Vectors are projected on many random directions. In each, a vector collides with those in a window centred on it; a pair
that collides often enough is verified by its cosine. The number of collisions asked for is calibrated: a pair exactly at
the similarity has it with the given recall, closer pairs with more.

Only vectors of one label meet. Equal vectors are one class, so a group of copies is one entry with a number of rows. A
first, wide window parts the projected line into cells, so that a pair lies in one cell or in neighbouring ones. Cells are
cut into blocks of bounded size, and a task compares two blocks: a hot label or cell is spread over many tasks. A task
returns for each vector its number of links and one link towards a spanning forest, never pairs. The work within a label
still grows with the square of its different vectors, as collision counting does.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import Scratch, with_roots
from tidewatch.llm.simhash import roots_of

# Parameters: directions, half width of the windows in standard deviations of a pair at the similarity, the same for the
# first direction, share of pairs at the similarity that are to be found, vectors in a block.
DIRECTIONS, SEED = 24, 11
SIGMAS, LEAD_SIGMAS = 2.5, 5.0
RECALL = 0.99999
BLOCK = 1024
#: Directions counted for all pairs, before only pairs that can still reach the count go on.
FIRST = 8


def directions(dim: int) -> np.ndarray:
    """Random normal directions, the same on every machine: one column each."""
    return np.random.default_rng((SEED, dim)).standard_normal((dim, DIRECTIONS))


def calibrated_count(sigmas: float = SIGMAS, many: int = DIRECTIONS, recall: float = RECALL) -> int:
    """The largest count that a pair exactly at the similarity reaches with probability recall."""
    hit = math.erf(sigmas / math.sqrt(2))
    tail = 0.0
    for count in range(many, -1, -1):
        tail += math.comb(many, count) * hit**count * (1 - hit) ** (many - count)
        if tail >= recall:
            return count
    return 0


def unit_vectors(vectors) -> np.ndarray:
    """Rows of length 1 in double precision."""
    rows = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def takes_part(vector: Column) -> Column:
    """Whether a vector is neither null nor zero and has only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def lead_cell(vector: Column, width: float) -> Column:
    """Number of the cell that a vector's first projection lies in."""

    @F.pandas_udf("long")
    def cell(batch: pd.Series) -> pd.Series:
        out = np.zeros(len(batch), dtype=np.int64)
        sizes = batch.map(len).to_numpy()
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            out[at] = np.floor((unit_vectors(batch.iloc[at]) * directions(dim)[:, 0]).sum(axis=1) / width)
        return pd.Series(out)

    return cell(vector)


def colliding(left: np.ndarray, right: np.ndarray, half: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose projections (one column per direction) collide in at least so many directions."""
    n, m = len(left), len(right)
    count = np.zeros(n * m, dtype=np.uint8)
    for k in range(min(FIRST, left.shape[1])):
        order = np.argsort(right[:, k])
        line = right[order, k]
        start = np.searchsorted(line, left[:, k] - half, "left")
        many = np.searchsorted(line, left[:, k] + half, "right") - start
        owner = np.repeat(np.arange(n), many)
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - start, many)
        count[owner * m + order[place]] += 1
    pairs = np.flatnonzero(count + max(0, left.shape[1] - FIRST) >= least)
    count = count[pairs].astype(np.int64)
    for k in range(FIRST, left.shape[1]):
        a, b = pairs // m, pairs % m
        count += np.abs(left[a, k] - right[b, k]) <= half
        alive = count + (left.shape[1] - 1 - k) >= least
        pairs, count = pairs[alive], count[alive]
    return pairs // m, pairs % m


def near_duplicates(vectors: DataFrame, similarity: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row of vectors (vec_id, embedding, label).

    Two rows link when their labels are equal and not null, their vectors have the same length and their cosine in double
    precision is at least similarity. n_links counts linked rows, repeated ones as often as they come; component_id is the
    smallest vec_id reachable over links, the own included. Vectors that are null, empty or zero, or hold a null or
    non-finite component, and rows without vec_id link with nothing; the latter have no component_id and are kept. Rows
    that share a vec_id are one node of the graph. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession)
    distance = math.sqrt(2 - 2 * similarity)
    half, wide, least = SIGMAS * distance, LEAD_SIGMAS * distance, calibrated_count()
    rows = vectors.select("vec_id", "embedding", "label")
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & takes_part(F.col("embedding")))
    classes = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("many"))
    classes = scratch.keep(
        classes.withColumns({"dim": F.size("embedding"), "cell": lead_cell(F.col("embedding"), wide)}), "classes"
    )
    tiles = in_tiles(classes)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        a = group[group["is_left"]]
        within = bool(group["c1"].iloc[0] == group["c2"].iloc[0] and group["b1"].iloc[0] == group["b2"].iloc[0])
        b = a if within else group[~group["is_left"]]
        nodes = np.concatenate([a["node"], b["node"]]).astype(np.int64)
        if not len(a) or not len(b):
            return pd.DataFrame({"node": nodes[:0], "n_links": nodes[:0], "other": nodes[:0]})
        left, right = unit_vectors(a["embedding"]), unit_vectors(b["embedding"])
        through = directions(left.shape[1])
        i, j = colliding(left @ through, right @ through, half, least)
        if within:
            i, j = i[i < j], j[i < j]
        near = [
            (left[i[at : at + 65536]] * right[j[at : at + 65536]]).sum(axis=1) >= similarity
            for at in range(0, len(i), 65536)
        ]
        near = np.concatenate(near) if near else np.zeros(0, dtype=bool)
        i, j = i[near], j[near]
        links = np.zeros(len(nodes), dtype=np.int64)
        shift = 0 if within else len(a)
        np.add.at(links, i, b["many"].to_numpy()[j])
        np.add.at(links, j + shift, a["many"].to_numpy()[i])
        root = roots_of(i, j + shift, len(nodes))
        linked = np.flatnonzero(links)
        return pd.DataFrame({"node": nodes[linked], "n_links": links[linked], "other": nodes[root[linked]]})

    keys = ("label", "dim", "c1", "b1", "c2", "b2")
    found = scratch.keep(tiles.groupBy(*keys).applyInPandas(compare, "node long, n_links long, other long"), "links")
    roots = with_roots(found.select(F.col("node").alias("a"), F.col("other").alias("b")), scratch)
    counted = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    placed = (
        classes.select("label", "embedding", "node", "many")
        .join(counted, "node", "left")
        .join(roots, "node", "left")
        .select(
            F.col("label").alias("own_label"),
            F.col("embedding").alias("own_vector"),
            (F.coalesce("n_links", F.lit(0)) + F.col("many") - 1).alias("n_links"),
            F.coalesce("root", "node").alias("root"),
        )
    )
    same = (F.col("label") == F.col("own_label")) & (F.col("embedding") == F.col("own_vector"))
    joined = rows.join(placed, same & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("root", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def in_tiles(classes: DataFrame) -> DataFrame:
    """Every class in each pair of blocks (c1, b1), (c2, b2) that compares it with another of its own or a next cell."""
    line = Window.partitionBy("label", "dim").orderBy("cell")
    blocks = F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    cells = classes.groupBy("label", "dim", "cell").agg(blocks)

    def neighbour(shifted, step):
        cell, many = shifted("cell").over(line), shifted("blocks").over(line)
        return F.when(cell == F.col("cell") + step, many).otherwise(0)

    cells = cells.withColumns({"before": neighbour(F.lag, -1), "after": neighbour(F.lead, 1)})
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = classes.join(cells, ["label", "dim", "cell"]).withColumn("block", block)

    def numbers(many):
        return F.when(F.col(many) > 0, F.sequence(F.lit(0), F.col(many) - 1)).otherwise(F.array().cast("array<int>"))

    def tile(c1, b1, c2, b2, is_left):
        parts = {"c1": c1, "b1": b1, "c2": c2, "b2": b2, "is_left": is_left}
        return F.struct(*[part.alias(name) for name, part in parts.items()])

    cell, own = F.col("cell"), F.col("block")
    within = F.transform(numbers("blocks"), lambda j: tile(cell, F.least(own, j), cell, F.greatest(own, j), own <= j))
    onward = F.transform(numbers("after"), lambda j: tile(cell, own, cell + 1, j, F.lit(True)))
    back = F.transform(numbers("before"), lambda j: tile(cell - 1, j, cell, own, F.lit(False)))
    return placed.select(
        "label", "dim", "node", "many", "embedding", F.inline(F.concat(within, onward, back))
    )
