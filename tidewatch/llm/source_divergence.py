"""Source divergence audit: how far the words of each source are from its language's and from each other source's.

Terms are counted in tasks by length-bucketed packing, on the bytes of many texts at once: a term of up to 8 bytes is one
big-endian uint64, one of up to 16 bytes two, so that their order is the terms' byte order; these are radix-sorted by
digits of 16 bits and their runs counted in numpy. Longer terms have a bucket of their own that is sorted by bytes. What
leaves a task is one row per source and term of each portion, and Spark sums these.

The shares of all pairs of sources are compared term by term. Terms are dealt into blocks, sources into tiles, and each task
takes one block of terms for one pair of tiles as a matrix; a term that neither source has gives the same value for a pair
each time, so it is never a row. Shares are whole numbers and every step is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import Scratch

#: Documents of a language that a kept term is in, shares as parts of this, and the most divergent terms reported.
MIN_DOCS, UNIT, TOP = 10, 1_000_000_000, 10
#: Bytes of text that are counted at the same time (a longer text on its own).
PORTION = 8 << 20
#: Terms of a block and sources of a tile: what one task compares at a time.
BLOCK, TILE = 4096, 256

#: The folded byte of a term's byte, zero for one that parts terms.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[: 0x41] = FOLD[0x5B : 0x61] = FOLD[0x7B : 0x80] = 0
FOLD[0x41 : 0x5B] += 32
#: Keeps the first n bytes of a packed word.
FIRST = np.array([(1 << 64) - (1 << (64 - 8 * n)) for n in range(9)], dtype=np.uint64)

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_docs", pa.int64())])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts without nulls, and where each begins, with the end of the last."""
    if len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def portions(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows, in order, of up to `most` bytes; a larger row on its own. sizes: where each begins, and the end."""
    at, rows = 0, len(sizes) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
        yield at, end
        at = end


def term_spans(folded: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and lengths of the runs of nonzero bytes, none across the start of a row."""
    inside = np.zeros(len(folded) + 1, dtype=bool)
    np.not_equal(folded, 0, out=inside[:-1])
    first, last = inside[:-1].copy(), inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    last &= ~inside[1:]
    begins = rows[:-1][rows[:-1] < len(folded)]
    first[begins] = inside[begins]
    behind = begins[begins > 0] - 1
    last[behind] = inside[behind]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts


def packed(windows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first eight bytes from each start as a number, big end first, zeros behind its size."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    return windows[starts].view(">u8").ravel().astype(np.uint64) & FIRST[np.clip(sizes, 0, 8)]


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The stable order by whole-number columns, the last of them the most significant, 16 bits at a time."""
    order = np.arange(len(columns[0]))
    for column in columns:
        for shift in range(0, column.dtype.itemsize * 8, 16):
            digit = (column >> column.dtype.type(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def runs(order: np.ndarray, columns: list[np.ndarray], row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by columns: one place of each run of equal ones, the run's size and the different rows in it."""
    new = np.ones(len(order), dtype=bool)
    for k, column in enumerate(columns):
        differs = np.diff(column[order]) != 0
        new[1:] = differs if k == 0 else new[1:] | differs
    other = np.ones(len(order), dtype=bool)
    other[1:] = new[1:] | (np.diff(row[order]) != 0)
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order))), np.add.reduceat(other, at, dtype=np.int64)


def counted(texts: pa.Array, group: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """Groups, terms, occurrences and documents of each different pair, bucket by bucket; group: that of each text."""
    raw, rows = text_bytes(texts)
    folded = FOLD[raw]
    starts, sizes = term_spans(folded, rows)
    row = np.searchsorted(rows, starts, "right") - 1
    of = group[row].astype(np.uint32)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([folded, np.zeros(16, dtype=np.uint8)]), 8)
    for low, high in ((1, 8), (9, 16)):
        here = np.flatnonzero((sizes >= low) & (sizes <= high))
        if not len(here):
            continue
        first, size = starts[here], sizes[here]
        words = [packed(windows, first, size)] + ([packed(windows, first + 8, size - 8)] if high > 8 else [])
        columns = [*words[::-1], of[here]]
        one, n, n_docs = runs(radix_order(columns), columns, row[here])
        terms = np.stack([w[one] for w in words], axis=1).astype(">u8").view(f"S{high}").ravel()
        yield of[here][one], terms.tolist(), n, n_docs
    here = np.flatnonzero(sizes > 16)
    if len(here):
        whole = folded.tobytes()
        entries = sorted(
            (int(g), whole[a : a + s], int(r))
            for g, a, s, r in zip(of[here].tolist(), starts[here].tolist(), sizes[here].tolist(), row[here].tolist(), strict=True)
        )
        found: dict[tuple[int, bytes], list[int]] = {}
        before = None
        for g, term, r in entries:
            totals = found.setdefault((g, term), [0, 0])
            totals[0] += 1
            totals[1] += (g, term, r) != before
            before = (g, term, r)
        totals = np.array(list(found.values()), dtype=np.int64)
        yield np.array([g for g, _ in found]), [t for _, t in found], totals[:, 0], totals[:, 1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, source, text = batch.columns
        names = pa.StructArray.from_arrays([lang, source], ["lang", "source"]).to_pandas()
        group, labels = pd.factorize(pd.Series([(n["lang"], n["source"]) for n in names], dtype=object))
        langs, sources = (pa.array([pair[k] for pair in labels], pa.string()) for k in (0, 1))
        _, rows = text_bytes(text)
        for a, b in portions(rows, PORTION):
            for of, terms, n, n_docs in counted(text.slice(a, b - a), group[a:b]):
                place = pa.array(of, pa.int64())
                yield pa.record_batch(
                    [
                        langs.take(place),
                        sources.take(place),
                        pa.array(terms, pa.binary()).cast(pa.string()),
                        pa.array(n, pa.int64()),
                        pa.array(n_docs, pa.int64()),
                    ],
                    schema=COUNTS,
                )


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, n_docs: occurrences of each term, and documents with it, by language and source."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = rows.mapInArrow(_count, "lang string, source string, term string, n long, n_docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """One and the smoothed share of n in whole parts of the unit; null without kept terms. Products may pass 64 bits."""
    large = lambda c: c.cast("decimal(20,0)")
    parts = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (large(n) + 2), large(total + 2 * kept))
    return F.when(kept > 0, parts + 1)


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _compared(block: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Differences of one block of terms for one pair of tiles; block 0 adds what a pair has for terms that neither has."""
    lang, number, a, b = (sources[c].iloc[0] for c in ("lang", "block", "tile_a", "tile_b"))
    sources = sources.sort_values("ordinal")
    place = {o: i for i, o in enumerate(sources["ordinal"])}
    kept, base = int(sources["v"].iloc[0]), np.array(sources["p0"].fillna(1), dtype=np.int64)
    term, terms = pd.factorize(block["term"])
    shares = np.tile(base, (len(terms), 1))
    shares[term, block["ordinal"].map(place).to_numpy(dtype=np.int64)] = block["p"].to_numpy(dtype=np.int64)
    tile = sources["tile"].to_numpy()
    names, out = sources["source"].tolist(), []
    for i in np.flatnonzero(tile == a).tolist():
        others = np.flatnonzero(tile == b)
        others = others[others > i]
        if not len(others):
            continue
        none = (base[i] - base[others]) ** 2 // (base[i] + base[others])
        p, q = shares[:, i : i + 1], shares[:, others]
        value = ((p - q) ** 2 // (p + q)).sum(axis=0) - len(terms) * none
        if number == 0:
            value = value + kept * none
        keep = (value != 0) | (number == 0)
        out += [(lang, names[i], names[j], int(v)) for j, v in zip(others[keep].tolist(), value[keep].tolist(), strict=True)]
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def _pairs(shares: DataFrame, groups: DataFrame, tile: int = TILE) -> DataFrame:
    """lang, source, item, value of every two sources of a language, both ways."""
    tiles = F.max("tile").over(Window.partitionBy("lang"))
    dealt = (
        groups.withColumn("ordinal", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
        .withColumn("tile", F.expr(f"ordinal div {tile}"))
        .withColumn("last_tile", tiles)
        .withColumn("blocks", F.expr(f"cast(greatest(1, (v + {BLOCK} - 1) div {BLOCK}) as int)"))
    )
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_tile"))).alias("met")
    pair = [F.least("tile", "met").alias("tile_a"), F.greatest("tile", "met").alias("tile_b")]
    known = dealt.select("lang", "source", "ordinal", "tile", "last_tile", "blocks")
    left = (
        shares.join(known, ["lang", "source"])
        .withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
        .select("lang", "block", "term", "ordinal", "p", "tile", met)
        .select("lang", "block", *pair, "term", "ordinal", "p")
    )
    right = (
        dealt.select("lang", "source", "ordinal", "tile", "v", "p0", "blocks", met)
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("lang", "block", *pair, "source", "ordinal", "tile", "v", "p0")
    )
    keys = ["lang", "block", "tile_a", "tile_b"]
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, since both sides read dealt
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _compared, "lang string, source string, item string, value long"
    )
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.array(
        F.struct("lang", "source", "item", "value"),
        F.struct("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"),
    )
    return sums.select(F.inline(both))


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: divergence of sources of docs (text, lang, source).

    Each language keeps the terms that at least MIN_DOCS of its documents have. Part `pair` compares a source with each
    other one of its language over all kept terms, part `term` gives the TOP terms that a source has more of than its
    language. Rank goes by value, equal ones by item in byte order.

    Null text, lang and source count as ''. Empty texts make an occurring source without terms. A row is a document, so
    repeated rows count as often as they come. A text is counted whole, however long. Without kept terms each pair has
    value 0. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    counts = scratch.keep(term_counts(docs), "counts")
    terms = scratch.keep(
        counts.groupBy("lang", "term")
        .agg(F.sum("n").alias("total"), F.sum("n_docs").alias("n_docs"))
        .where(F.col("n_docs") >= MIN_DOCS)
        .select("lang", "term", "total"),
        "terms",
    )
    kept = scratch.keep(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "kept")
    zero = F.lit(0).cast("long")
    whole = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    groups = scratch.keep(
        occurring.distinct()
        .join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group")), ["lang", "source"], "left")
        .join(whole, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n_group", "v", "n_lang")])
        .withColumn("p0", _share(zero, F.col("n_group"), F.col("v"))),
        "groups",
    )
    shares = kept.join(groups, ["lang", "source"]).select(
        "lang",
        "source",
        "term",
        _share(F.col("n"), F.col("n_group"), F.col("v")).alias("p"),
        _share(F.col("total"), F.col("n_lang"), F.col("v")).alias("q"),
    )
    more = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    found = []
    for part, rows in (("pair", _pairs(shares.select("lang", "source", "term", "p"), groups)), ("term", more)):
        ranked = rows.withColumn("rank", F.row_number().over(order))
        ranked = ranked.where(F.col("rank") <= TOP) if part == "term" else ranked
        found.append(ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank"))
    return found[0].unionAll(found[1])


def oracle() -> str:
    """DuckDB SQL for divergence(documents)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
        WITH doc AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS text
            FROM documents
        ), word AS (
            SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM doc
        ), term AS (
            SELECT lang, term, count(*) AS total FROM word GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}
        ), whole AS (
            SELECT lang, count(*) AS v, sum(total) AS n FROM term GROUP BY lang
        ), occurrence AS (
            SELECT w.lang, w.source, w.term, count(*) AS n
            FROM word w JOIN term t ON t.lang = w.lang AND t.term = w.term GROUP BY w.lang, w.source, w.term
        ), part AS (
            SELECT d.lang, d.source, coalesce(o.n, 0) AS n
            FROM (SELECT DISTINCT lang, source FROM doc) d
            LEFT JOIN (SELECT lang, source, sum(n) AS n FROM occurrence GROUP BY lang, source) o
              ON o.lang = d.lang AND o.source = d.source
        ), share AS (
            SELECT p.lang, p.source, t.term, coalesce(o.n, 0) AS n,
                   1 + ({UNIT} * (coalesce(o.n, 0)::HUGEINT + 2)) // (p.n + 2 * w.v) AS p,
                   1 + ({UNIT} * (t.total::HUGEINT + 2)) // (w.n + 2 * w.v) AS q
            FROM part p JOIN term t ON t.lang = p.lang JOIN whole w ON w.lang = p.lang
            LEFT JOIN occurrence o ON o.lang = p.lang AND o.source = p.source AND o.term = t.term
        ), pair AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
            FROM part a JOIN part b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (
                SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
                FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
                GROUP BY ALL
            ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        ), found AS (
            SELECT lang, source, 'pair' AS part, item, value FROM pair
            UNION ALL
            SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM share WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
        )
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
        FROM ranked WHERE part = 'pair' OR rank <= {TOP}
    """
