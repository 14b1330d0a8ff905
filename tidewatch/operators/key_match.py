"""Proposals for keys that only one of two sources has: the nearest spelling among the other source's keys.

Keys are compared without case, blanks and punctuation. A key of the other side with n letters and digits may be so many
edits away: one for every LETTERS of them, MAX_DISTANCE at most. To find all such keys without comparing every pair, the
other side's name is cut into one piece more than edits are allowed. An edit spoils one piece at most, so some piece stands
unchanged in the name that is looked up, shifted by no more places than there are edits. Names meet on such pieces, and
the edit distance is computed in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.checks import keys_of

MAX_DISTANCE = 2
LETTERS = 4


def plain_name(key: Column) -> Column:
    """A key in lower case, letters and digits alone."""
    return F.regexp_replace(F.lower(key), r"[^\p{L}\p{N}]", "")


def _allowed(n: Column, max_distance: int) -> Column:
    return F.least(F.lit(max_distance), F.floor(n / LETTERS).cast("int"))


def _piece_bounds(df: DataFrame) -> DataFrame:
    """One row per piece of a name of n letters: its number, its start and the letters in it."""
    pieces = F.col("edits") + 1
    cut = df.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    start = F.floor(F.col("piece") * F.col("n") / pieces).cast("int")
    behind = F.floor((F.col("piece") + 1) * F.col("n") / pieces).cast("int")
    return cut.withColumn("start", start).withColumn("size", behind - start)


def _offered(named: DataFrame, max_distance: int) -> DataFrame:
    """The pieces of all keys, for the side whose keys may be proposed them."""
    sides = F.array_compact(F.array(F.when(F.col("in_right"), F.lit("left")), F.when(F.col("in_left"), F.lit("right"))))
    lengths = named.select(
        "pair", F.explode(sides).alias("side"), F.col("key").alias("other"), F.col("name").alias("other_name"),
        F.length("name").alias("n"),
    )
    cut = _piece_bounds(lengths.withColumn("edits", _allowed(F.col("n"), max_distance)))
    text = F.substring("other_name", F.col("start") + 1, F.col("size"))
    return cut.select("pair", "side", "n", "piece", text.alias("text"), "other", "other_name", "edits")


def _sought(lonely: DataFrame, max_distance: int) -> DataFrame:
    """Every place of a lonely name where a piece of a name within reach may stand."""
    own = F.length("name")
    reach = F.sequence(F.greatest(F.lit(1), own - max_distance), own + max_distance)
    lengths = lonely.select("pair", "side", "key", "name", F.explode(reach).alias("n"))
    lengths = lengths.withColumn("edits", _allowed(F.col("n"), max_distance)).where(F.abs(own - F.col("n")) <= F.col("edits"))
    shifted = _piece_bounds(lengths).withColumn("shift", F.explode(F.sequence(-F.col("edits"), F.col("edits"))))
    start = F.col("start") + F.col("shift")
    inside = (start >= 0) & (start + F.col("size") <= own)
    text = F.substring("name", start + 1, F.col("size"))
    return shifted.where(inside).select("pair", "side", "key", "name", "n", "piece", text.alias("text")).distinct()


def key_suggestions(
    pairs: list[tuple[str, DataFrame, Column, DataFrame, Column]], max_distance: int = MAX_DISTANCE
) -> DataFrame:
    """One row per key that one source of a pair lacks: pair, side, key, suggestion, distance and n_nearest.

    side is the source that has the key; suggestion is the nearest key of the other source, the smallest of equally near
    ones, and n_nearest says how many of these there are. A key without a near one, or without letters and digits, has a
    null suggestion and n_nearest 0. Null keys take no part.
    """
    side = F.when(~F.col("in_right"), "left").when(~F.col("in_left"), "right")
    named = keys_of(pairs).withColumn("name", plain_name(F.col("key"))).withColumn("side", side)
    lonely = named.where(F.col("side").isNotNull())
    spelled = F.length("name") > 0
    distance = F.levenshtein("name", "other_name", max_distance)
    near = (
        _sought(lonely.where(spelled), max_distance)
        .join(_offered(named.where(spelled).drop("side"), max_distance), ["pair", "side", "n", "piece", "text"])
        .withColumn("distance", distance)
        .where((F.col("distance") >= 0) & (F.col("distance") <= F.col("edits")))
    )
    # A pair may meet on several pieces and counts once.
    once = near.groupBy("pair", "side", "key", "other").agg(F.min("distance").alias("distance"))
    by_distance = once.groupBy("pair", "side", "key", "distance").agg(
        F.min("other").alias("suggestion"), F.count("*").alias("n_nearest")
    )
    best = by_distance.groupBy("pair", "side", "key").agg(F.min(F.struct("distance", "suggestion", "n_nearest")).alias("best"))
    return (
        lonely.select("pair", "side", "key")
        .join(best, ["pair", "side", "key"], "left")
        .select(
            "pair",
            "side",
            "key",
            F.col("best.suggestion").alias("suggestion"),
            F.col("best.distance").alias("distance"),
            F.coalesce("best.n_nearest", F.lit(0)).alias("n_nearest"),
        )
    )


def key_mapping(suggestions: DataFrame, pair: str) -> DataFrame:
    """key and mapped_key: left keys of a pair with one nearest right key, which no other left key is as near to."""
    own = suggestions.where((F.col("pair") == pair) & (F.col("side") == "left") & (F.col("n_nearest") == 1))
    claims = own.groupBy("suggestion", "distance").agg(F.count("*").alias("claims"), F.min("key").alias("key"))
    nearest = claims.groupBy("suggestion").agg(F.min_by(F.struct("claims", "key"), "distance").alias("best"))
    return nearest.where("best.claims = 1").select(F.col("best.key").alias("key"), F.col("suggestion").alias("mapped_key"))


def with_mapped_key(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """df with the keys of a column replaced by their mapped ones; other keys, null ones too, stay."""
    columns = [f"`{c}`" for c in df.columns]
    mapping = mapping.select(F.col("key").alias("__key"), F.col("mapped_key").alias("__mapped"))
    joined = df.join(mapping, F.col(f"`{column}`") == F.col("__key"), "left")
    new = F.coalesce(F.col("__mapped"), F.col(f"`{column}`")).alias(column)
    return joined.select(*[new if c == f"`{column}`" else F.col(c) for c in columns])
