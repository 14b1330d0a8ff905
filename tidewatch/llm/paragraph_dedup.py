"""Substring dedup by MinHash banding of paragraphs.

A paragraph is a line of SHINGLE words or more, or all of some short lines that follow each other, as in a text wrapped at
a number of columns: lines under MIN_WORDS words without an empty or a longer line between them. Paragraphs with a band of their MinHash in common are candidates; bands are tuned
so that a pair at the similarity collides with a probability over 0.999. Candidates are verified by the exact Jaccard
similarity of their shingles, and linked ones form components, in which the first paragraph stays. Paragraphs too short
or too monotonous for MinHash, with under MIN_DIFFERENT different shingles, have no bands: only equal ones are linked.

A passage may also repeat in the middle of paragraphs that differ otherwise, or go over several short lines. So a text has
windows too, whatever its lines: they start at words that the text itself picks (in every run of START shingles the one
with the smallest hash), so that a passage of MIN_PASSAGE words has a window at the same place wherever it occurs. Windows
have a single band made of their whole content: they collide when they are equal.

Shorter paragraphs than MIN_REPORTED words (headings, greetings, set phrases) repeat between documents that have nothing
else in common. They are found and listed like passages, but apart from them, and nothing of them is removed.

An equal window is only a seed: it is extended word by word to both sides as far as another document goes on alike. For
each number of words the window and its neighbours are hashed together, so an occurrence meets all others that share so
much with it, not just the first, and no pairs are compared. Between two windows of a passage there are at most START
words, and as many at its ends, so this covers the passage; where windows meet already, nothing is hashed.

Copies of a paragraph meet as one content, however many rows they are. Candidates of one band are compared in blocks of
bounded size, so no group has to fit a task and no pairs are written, only links towards a spanning forest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import Scratch, shuffles_released, with_roots
from tidewatch.llm.simhash import roots_of

# Parameters: words in a shingle, similarity, bands and their rows, words from which a line is no part of a wrapped
# paragraph, words of a window and of the run that one of its starts is picked from, different shingles of a banded
# paragraph or a window at least, contents in a block.
SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 8, 2
MIN_WORDS = 25
WINDOW, START = 20, 25
MIN_DIFFERENT = 10
BLOCK = 256
#: Words from which a paragraph is a passage; a shorter one that repeats is a short line, and counted apart.
MIN_REPORTED = 20
#: A repeated passage of so many words has a window of its own in every copy.
MIN_PASSAGE = START + WINDOW

#: Bytes of a text whose words are hashed together.
CHUNK = 1 << 16

_MIX = np.random.default_rng(5).integers(0, 2**63, size=(BANDS * ROWS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(6).integers(0, 2**63, WINDOW - SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_OF_BYTE = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.full(CHUNK, _BASE, dtype=np.uint64))
_INVERSES = np.cumprod(np.full(CHUNK, pow(_BASE, -1, 2**64), dtype=np.uint64))
_NEXT_BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]|\Z")
_IN_SHINGLE = np.random.default_rng(8).integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BESIDE = np.random.default_rng(9).integers(0, 2**63, (2, START), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
UNITS = "content long, doc_id {id_type}, first_word int, n_words int, bands array<long>"


def recall_at(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """The probability that a pair at the similarity collides in some band."""
    return 1 - (1 - similarity**rows) ** bands


def paragraphs(in_lines: list[int]) -> list[tuple[int, int]]:
    """(first word, words) of every line with a shingle, and of every two or more short lines in a row, as one."""
    out, at = [], 0
    first, lines = 0, 0
    for n in [*in_lines, 0]:
        if not 0 < n < MIN_WORDS:
            if lines > 1 and at - first >= SHINGLE:
                out.append((first, at - first))
            first, lines = at + n, 0
        else:
            lines += 1
        if n >= SHINGLE:
            out.append((at, n))
        at += n
    return out


def words_of(text: str | bytes) -> tuple[np.ndarray, list[int]]:
    """A hash of each word, and the number of words in each line. Only A-Z is lower-cased, only ASCII white space parts words.
    Bytes are lower-cased UTF-8 already.

    A word's hash is the sum over its bytes, each byte's number times a power that grows along the word. The sums of all
    words of a chunk come from one running sum; a word that is longer than a chunk is hashed by itself.
    """
    held = text.encode("utf-8", "replace").lower() if isinstance(text, str) else text
    hashes, ends_of_lines, at, n_words = [], [], 0, 0
    while at < len(held):
        behind = len(held)
        if behind - at >= CHUNK:
            behind = at + CHUNK
            while behind > at and not _BLANK[held[behind - 1]]:
                behind -= 1
            if behind == at:
                behind = _NEXT_BLANK.search(held, at).start()
                hashes.append(np.array([xxhash.xxh64_intdigest(held[at:behind])], dtype=np.uint64))
                at, n_words = behind, n_words + 1
                continue
        own = np.frombuffer(held, np.uint8, behind - at, at)
        starts, own_hashes = _words_in(own)
        hashes.append(own_hashes)
        ends_of_lines.append(np.searchsorted(starts, np.flatnonzero(own == 10)) + n_words)
        at, n_words = behind, n_words + len(starts)
    if not hashes:
        return np.zeros(0, dtype=np.uint64), [0]
    return np.concatenate(hashes), np.diff(np.concatenate([[0], *ends_of_lines, [n_words]])).tolist()


def _words_in(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin in the bytes of a chunk, and their hashes."""
    filled = np.zeros(len(own) + 2, dtype=np.int8)
    filled[1:-1] = ~_BLANK[own]
    edges = np.diff(filled)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.zeros(len(own) + 1, dtype=np.uint64)
    np.cumsum(_OF_BYTE[own] * _POWERS[: len(own)], out=sums[1:])
    return starts, _finished((sums[ends] - sums[starts]) * _INVERSES[starts])


def hashes_of(text: str) -> np.ndarray:
    """Hash of the shingle that starts at each word, over the whole text."""
    return shingled(words_of(text)[0])


def shingled(words: np.ndarray) -> np.ndarray:
    """Hash of the shingle that starts at each word, from the words' hashes; fewer words than SHINGLE make one."""
    width = min(SHINGLE, len(words))
    many = len(words) - width + 1
    if not width:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(many, dtype=np.uint64)
    for k in range(width):
        out += words[k : k + many] * _IN_SHINGLE[k]
    return _finished(out)


def _finished(sums: np.ndarray) -> np.ndarray:
    """Sums of hashes with every bit depending on all others."""
    sums = (sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return sums ^ (sums >> np.uint64(32))


def picked_starts(hashes: np.ndarray) -> np.ndarray:
    """Places that hold the smallest hash of some START shingles in a row, the first of equal ones."""
    if len(hashes) < START:
        return np.zeros(0, dtype=np.int64)
    picked = [
        np.lib.stride_tricks.sliding_window_view(hashes[at : at + 100_000 + START - 1], START).argmin(axis=1)
        + np.arange(at, min(at + 100_000, len(hashes) - START + 1))
        for at in range(0, len(hashes) - START + 1, 100_000)
    ]
    return np.unique(np.concatenate(picked))


def _content(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), len(hashes)) - 2**63


def lines_of(in_lines: list[int], hashes: np.ndarray) -> list[tuple]:
    """(content, first word, words, bands) of the paragraphs of a text; no bands where only equal ones count."""
    exact, kept = [], []
    for at, n in paragraphs(in_lines):
        held = hashes[at : at + n - SHINGLE + 1]
        if len(set(held[:32].tolist())) >= MIN_DIFFERENT or len(np.unique(held)) >= MIN_DIFFERENT:
            kept.append((at, n))
        else:
            exact.append((_content(held), at, n, []))
    if not kept:
        return exact
    bands = _bands(hashes, kept)
    return exact + [(_content(hashes[at : at + n - SHINGLE + 1]), at, n, own) for (at, n), own in zip(kept, bands, strict=True)]


def _bands(hashes: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """The bands of paragraphs (first word, words), a row for each."""
    places = np.array([(at, at + n - SHINGLE + 1) for at, n in spans]).ravel()
    smallest = np.empty((len(spans), BANDS * ROWS), dtype=np.uint64)
    padded = np.append(hashes, np.uint64(0))
    for k, (factor, term) in enumerate(_MIX):
        smallest[:, k] = np.minimum.reduceat(padded * factor + term, places)[::2]
    banded = smallest.reshape(len(spans), BANDS, ROWS)
    folded = (banded[:, :, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ banded[:, :, 1:].sum(axis=2, dtype=np.uint64)
    return folded.view(np.int64)


def windows_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(content, first word) of the windows of a text, from its shingles."""
    many = WINDOW - SHINGLE + 1
    starts = picked_starts(hashes)
    starts = starts[starts + many <= len(hashes)]
    if not len(starts):
        return np.zeros(0, dtype=np.int64), starts
    held = hashes[starts[:, None] + np.arange(many)]
    content = _mixed(held)
    different = (np.diff(np.sort(held, axis=1), axis=1) != 0).sum(axis=1) + 1
    varied = different >= MIN_DIFFERENT
    return content[varied], starts[varied]


def _mixed(held: np.ndarray) -> np.ndarray:
    """The contents of windows, from rows of their shingles' hashes."""
    return _finished((held * _PLACES).sum(axis=1, dtype=np.uint64)).view(np.int64)


def units_of(text: str | None) -> list[tuple[int, int, int, list[int] | None]]:
    """(content, first word, words, bands) of the paragraphs and windows of a text; windows have no bands."""
    words, in_lines = words_of(text or "")
    hashes = shingled(words)
    found = zip(*(x.tolist() for x in windows_of(hashes)), strict=True)
    return [*lines_of(in_lines, hashes), *[(content, first, WINDOW, None) for content, first in found]]


def units_together(held: list[bytes]) -> tuple[list[tuple], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, content, first word, words, bands) of the paragraphs of several lower-cased texts, and columns text, content,
    first word of their windows: the units of each text, as units_of gives them. All texts together are under a CHUNK.
    """
    own = np.frombuffer(b"\n".join(held), np.uint8)
    starts, words = _words_in(own)
    nothing = np.zeros(0, dtype=np.int64)
    if len(words) < SHINGLE:
        return [], (nothing, nothing, nothing)
    hashes = shingled(words)
    behind = np.cumsum([len(x) + 1 for x in held]) - 1  # the byte behind each text
    ends = np.searchsorted(starts, behind)
    begins = np.concatenate([[0], ends[:-1]])
    breaks = np.flatnonzero(own == 10)
    in_lines = np.diff(np.concatenate([[0], np.searchsorted(starts, breaks), [len(words)]])).tolist()
    last_lines = np.searchsorted(breaks, behind).tolist()

    exact, kept = [], []
    line = 0
    for text, (begin, last) in enumerate(zip(begins.tolist(), last_lines, strict=True)):
        for first, n in paragraphs(in_lines[line : last + 1]):
            at = begin + first
            shingles = hashes[at : at + n - SHINGLE + 1]
            if len(set(shingles[:32].tolist())) >= MIN_DIFFERENT or len(np.unique(shingles)) >= MIN_DIFFERENT:
                kept.append((text, at, first, n, _content(shingles)))
            else:
                exact.append((text, _content(shingles), first, n, []))
        line = last + 1
    if kept:
        bands = _bands(hashes, [(at, n) for _, at, _, n, _ in kept])
        exact += [(text, content, first, n, own) for (text, _, first, n, content), own in zip(kept, bands, strict=True)]

    many = WINDOW - SHINGLE + 1
    text_of = np.repeat(np.arange(len(held)), ends - begins)[: len(hashes)]
    room = ends[text_of] - SHINGLE + 1 - np.arange(len(hashes))  # shingles from each one to the last of its text
    picked = _smallest_ahead(hashes)
    picked = np.unique(picked[room[: len(picked)] >= START])
    picked = picked[room[picked] >= many]
    contents = _mixed(seen := hashes[picked[:, None] + np.arange(many)])
    varied = (np.diff(np.sort(seen, axis=1), axis=1) != 0).sum(axis=1) + 1 >= MIN_DIFFERENT
    picked = picked[varied]
    return exact, (text_of[picked], contents[varied], picked - begins[text_of[picked]])


def _smallest_ahead(hashes: np.ndarray) -> np.ndarray:
    """For each START hashes in a row, the place of the smallest, the first of equal ones."""
    place, wide = np.arange(len(hashes)), 1
    while wide < START and len(hashes) >= START:
        step = min(wide, START - wide)
        left, right = place[:-step], place[step:]
        place = np.where(hashes[left] <= hashes[right], left, right)
        wide += step
    return place if len(hashes) >= START else place[:0]


def units(docs: DataFrame) -> DataFrame:
    """content, doc_id, first_word, n_words and bands of the paragraphs and windows of docs (doc_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            lines: list[tuple] = []
            windows: list[tuple] = []
            waiting = 0
            for rows, held in _groups(batch.column("text")):
                if len(held) > 1 or len(held[0]) < CHUNK:
                    found, (row, contents, firsts) = units_together(held)
                    lines += [(rows[i], *line) for i, *line in found]
                    windows.append((np.array(rows)[row], contents, firsts))
                else:
                    words, in_lines = words_of(held[0])
                    hashes = shingled(words)
                    lines += [(rows[0], *line) for line in lines_of(in_lines, hashes)]
                    contents, firsts = windows_of(hashes)
                    windows.append((np.full(len(firsts), rows[0]), contents, firsts))
                waiting += len(firsts)
                if waiting + len(lines) >= 50_000:
                    yield from _unit_rows(ids, lines, windows)
                    lines, windows, waiting = [], [], 0
            yield from _unit_rows(ids, lines, windows)

    named = docs.where("doc_id is not null").select("doc_id", "text")
    return named.mapInArrow(cut, UNITS.format(id_type=named.schema["doc_id"].dataType.simpleString()))


def _groups(texts: pa.Array) -> Iterator[tuple[list[int], list[bytes]]]:
    """Rows and lower-cased texts that are under a CHUNK together; a longer text on its own."""
    rows: list[int] = []
    held: list[bytes] = []
    size = 0
    for row, text in enumerate(texts):
        lowered = (text.as_py() or "").encode("utf-8", "replace").lower()
        if held and size + len(lowered) + 1 >= CHUNK:
            yield rows, held
            rows, held, size = [], [], 0
        rows.append(row)
        held.append(lowered)
        size += len(lowered) + 1
    if held:
        yield rows, held


def _unit_rows(ids: pa.Array, lines: list[tuple], windows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Units as rows; lines and windows name the rows of their documents among ids."""

    def rows(content, row, first, n, bands) -> pa.RecordBatch:
        columns = [pa.array(content, pa.int64()), ids.take(pa.array(row, pa.int64())), pa.array(first, pa.int32())]
        columns += [pa.array(n, pa.int32()), bands]
        return pa.RecordBatch.from_arrays(columns, names=["content", "doc_id", "first_word", "n_words", "bands"])

    if lines:
        row, content, first, n, bands = zip(*lines, strict=True)
        yield rows(content, row, first, n, pa.array(bands, pa.list_(pa.int64())))
    row, content, first = (np.concatenate(x) for x in zip(*windows, strict=True)) if windows else ((), (), ())
    if len(row):
        none = pa.nulls(len(row), pa.list_(pa.int64()))
        yield rows(content, row, first, np.full(len(row), WINDOW), none)


def collisions(contents: DataFrame) -> DataFrame:
    """key, n and content: contents that share a band with another; n is how many do.

    Keys are counted before they are joined, so a band that very many contents share is split like any hot join key.
    """
    keyed = contents.select("content", F.posexplode("bands").alias("band", "value"))
    keyed = keyed.select(F.xxhash64("band", "value").alias("key"), "content")
    return keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def shingles_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """content and its different shingles' hashes, for wanted (content, doc_id, first_word, n_words)."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("content", "first_word", "n_words")).alias("wanted"))
    texts = docs.select("doc_id", "text").join(lists, "doc_id").select("text", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents: list[int] = []
        sets: list[np.ndarray] = []
        waiting = 0
        for batch in batches:
            for row, text in enumerate(batch.column("text")):
                words, _ = words_of(text.as_py() or "")
                hashes = shingled(words)
                for line in batch.column("wanted")[row].as_py():
                    at, n = line["first_word"], line["n_words"]
                    held = hashes[at : at + n - SHINGLE + 1]
                    if len(held) and _content(held) == line["content"]:
                        contents.append(line["content"])
                        sets.append(np.unique(held).view(np.int64))
                        waiting += len(held)
                if waiting >= 200_000:
                    yield _sets(contents, sets)
                    contents, sets, waiting = [], [], 0
        if contents:
            yield _sets(contents, sets)

    return texts.mapInArrow(cut, "content long, shingles array<long>").dropDuplicates(["content"])


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts), pa.int64()))


def _sets(contents: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(contents, pa.int64()), _lists(sets)], names=["content", "shingles"])


def verified(found: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between contents that share a key and are similar, as all such pairs would connect them."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("content"), blocks).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda j: F.struct(F.least(block, j).alias("b1"), F.greatest(block, j).alias("b2"), (block <= j).alias("is_left")),
    )
    tiles = found.select("key", "content", F.inline(pairs)).join(shingles, "content")
    ordered = tiles.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, held = None, []
        links: list[tuple[int, int]] = []
        for batch in batches:
            columns = [batch[c].tolist() for c in ("key", "b1", "b2", "content", "is_left", "shingles")]
            for key, b1, b2, content, is_left, shingles in zip(*columns, strict=True):
                if (key, b1, b2) != tile:
                    links += tile_links(held, similarity)
                    tile, held = (key, b1, b2), []
                held.append((content, is_left, b1 == b2, shingles))
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])
                links = []
        links += tile_links(held, similarity)
        if links:
            yield pd.DataFrame(links, columns=["a", "b"])

    return ordered.mapInPandas(compare, "a long, b long").distinct()


def tile_links(held: list[tuple], similarity: float) -> list[tuple[int, int]]:
    """Links towards a spanning forest of the similar pairs between the left and right entries of a tile."""
    if len(held) < 2:
        return []
    sets = [set(np.asarray(entry[3]).tolist()) for entry in held]
    pairs = []
    left = [i for i, entry in enumerate(held) if entry[1]]
    right = [i for i, entry in enumerate(held) if not entry[1]] or left
    for i in left:
        for j in right:
            if (i < j or not held[i][2]) and i != j:
                small, large = sorted((len(sets[i]), len(sets[j])))
                if small < similarity * large:
                    continue
                both = len(sets[i] & sets[j])
                if both >= similarity * (small + large - both):
                    pairs.append((i, j))
    if not pairs:
        return []
    a, b = np.array(pairs).T
    root = roots_of(a, b, len(held))
    return [(held[i][0], held[r][0]) for i, r in enumerate(root.tolist()) if r != i]


def merged(spans: Column) -> Column:
    """Sorted (first_word, behind) structs as the fewest spans that cover the same words, and these words' number."""

    @F.pandas_udf("spans array<struct<first_word:int,behind:int>>, n_words long")
    def merge(batch: pd.Series) -> pd.DataFrame:
        out = []
        for listed in batch:
            covered: list[dict] = []
            for span in listed:
                if covered and span["first_word"] <= covered[-1]["behind"]:
                    covered[-1]["behind"] = max(covered[-1]["behind"], span["behind"])
                else:
                    covered.append(dict(span))
            out.append((covered, sum(c["behind"] - c["first_word"] for c in covered)))
        return pd.DataFrame(out, columns=["spans", "n_words"])

    return merge(spans)


def members(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, first_word, n_words, first_doc, kept and is_short of every paragraph or window that repeats in another document.

    first_doc is the smallest doc_id that its component occurs in; the occurrence first by doc_id and word is kept. A
    paragraph under MIN_REPORTED words is short.
    """
    scratch = Scratch(docs.sparkSession)
    with shuffles_released(docs.sparkSession):
        return _members(docs, similarity, scratch)


def _members(docs: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    everything = scratch.keep(units(docs), "units")
    lines = everything.where("bands is not null")
    place = F.struct("doc_id", "first_word", "n_words")
    contents = lines.groupBy("content").agg(F.max("bands").alias("bands"))
    found = scratch.keep(collisions(contents), "collisions")
    wanted = found.select("content").distinct().join(lines.drop("bands"), "content")
    wanted = wanted.groupBy("content").agg(F.min(place).alias("p")).select("content", "p.*")
    shingles = scratch.keep(shingles_of(wanted, docs), "shingles")
    links = scratch.keep(verified(found, shingles, similarity), "links")
    scratch.drop("shingles")
    scratch.drop("collisions")
    roots = with_roots(links, scratch).select(F.col("node").alias("content"), "root")
    same_line = lines.join(roots, "content", "left").withColumn("component", F.coalesce("root", "content"))
    same_window = everything.where("bands is null").withColumn("component", F.col("content"))
    windows = scratch.keep(across_documents(same_window), "windows")
    around = extensions(reaches(windows), docs, scratch)
    paragraphs = across_documents(same_line).drop("component").withColumn("is_short", F.col("n_words") < MIN_REPORTED)
    return paragraphs.unionAll(windows.drop("component").unionAll(around).withColumn("is_short", F.lit(False)))


def reaches(windows: DataFrame) -> DataFrame:
    """component, doc_id, first_word, left and right of windows that repeat: how many words to try on each side.

    That is up to the next such window, or START at most. A window that goes counts only others that go. All occurrences of
    a content try as many words as the one that needs most, so that they can meet.
    """
    by_place = Window.partitionBy("doc_id").orderBy("first_word")
    sides = {"left": by_place.rowsBetween(Window.unboundedPreceding, -1), "right": by_place.rowsBetween(1, Window.unboundedFollowing)}
    gaps = []
    for side, others in sides.items():
        pick = F.last if side == "left" else F.first
        going = pick(F.when(~F.col("kept"), F.col("first_word")), ignorenulls=True).over(others)
        next_one = F.when(F.col("kept"), pick("first_word").over(others)).otherwise(going)
        gap = F.abs(F.col("first_word") - next_one) - WINDOW
        gaps.append(F.greatest(F.lit(0), F.least(F.lit(START), F.coalesce(gap, F.lit(START)))).alias(side))
    needed = windows.select("component", "doc_id", "first_word", "kept", *gaps).groupBy("component")
    needed = needed.agg(F.max("left").alias("left"), F.max("right").alias("right")).where("left > 0 or right > 0")
    return windows.select("component", "doc_id", "first_word").join(needed, "component")


def extensions(wanted: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, first_word, n_words, first_doc and kept of the words beside windows that go on alike in another document.

    A row of contexts holds the keys of one window and side, for each number of words. Where all occurrences of a window
    go on alike as far as they try, their last key says so; only the others are compared number by number.
    """
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("component", "first_word", "left", "right")).alias("wanted"))
    texts = docs.select("doc_id", "text").join(lists, "doc_id").select("doc_id", "text", "wanted")
    kind = texts.schema["doc_id"].dataType.simpleString()
    columns = "component long, first_word int, is_left boolean, keys array<long>"
    tried = scratch.keep(texts.mapInArrow(_contexts, f"doc_id {kind}, {columns}"), "contexts")

    place = F.struct("doc_id", "first_word")
    last = F.element_at("keys", -1)
    sides = tried.groupBy("component", "is_left").agg(
        F.min(place).alias("first"), F.max("doc_id").alias("last_doc"), F.min(last).alias("k1"), F.max(last).alias("k2")
    )
    sides = sides.select("component", "is_left", "first", "last_doc", (F.col("k1") == F.col("k2")).alias("alike"))
    sides = scratch.keep(sides, "sides")
    whole = sides.where("alike and first.doc_id <> last_doc").select("component", "is_left", "first")
    agreed = tried.select("doc_id", "first_word", "component", "is_left", F.size("keys").alias("many"))
    agreed = agreed.join(whole, ["component", "is_left"])

    parted = sides.where("not alike").select("component", "is_left")
    several = tried.join(parted, ["component", "is_left"], "left_semi")
    several = several.select("doc_id", "first_word", "is_left", F.posexplode("keys").alias("at", "key"))
    spread = several.groupBy("key").agg(F.min(place).alias("first"), F.max("doc_id").alias("last_doc"))
    shared = several.join(spread.where("first.doc_id <> last_doc").select("key", "first"), "key")
    found = agreed.select("doc_id", "first_word", "is_left", "many", "first").unionAll(
        shared.select("doc_id", "first_word", "is_left", F.col("at") + 1, "first")
    )
    is_first = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.first_word") == F.col("first_word"))
    most = found.groupBy("doc_id", "first_word", "is_left", is_first.alias("kept")).agg(
        F.max("many").alias("n_words"), F.min("first.doc_id").alias("first_doc")
    )
    begin = F.when(F.col("is_left"), F.col("first_word") - F.col("n_words")).otherwise(F.col("first_word") + WINDOW)
    return most.select("doc_id", begin.alias("first_word"), "n_words", "first_doc", "kept")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of contexts_of for batches of (doc_id, text, wanted), some 100,000 keys at a time."""
    for batch in batches:
        ids, texts, wanted = (batch.column(name) for name in ("doc_id", "text", "wanted"))
        rows: list[int] = []
        parts: list[tuple] = []
        waiting = 0
        for row in range(len(batch)):
            seeds = wanted[row].values
            seeds = [seeds.field(k).to_numpy(zero_copy_only=False) for k in ("component", "first_word", "left", "right")]
            found = contexts_of(texts[row].as_py() or "", *seeds)
            rows += [row] * len(found[0])
            parts.append(found)
            waiting += len(found[4])
            if waiting >= 100_000:
                yield _context_rows(ids, rows, parts)
                rows, parts, waiting = [], [], 0
        if rows:
            yield _context_rows(ids, rows, parts)


def _context_rows(ids: pa.Array, rows: list[int], parts: list[tuple]) -> pa.RecordBatch:
    component, first_word, is_left, sizes, keys = (np.concatenate(column) for column in zip(*parts, strict=True))
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    columns = [
        ids.take(pa.array(rows, pa.int64())), pa.array(component, pa.int64()), pa.array(first_word, pa.int32()),
        pa.array(is_left, pa.bool_()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys, pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "component", "first_word", "is_left", "keys"])


def contexts_of(text: str, contents: np.ndarray, firsts: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple:
    """(content, first word, is left, number of keys) of windows' sides, and all their keys, one for each number of words.

    A window that isn't in the text, but in that of another row with the same doc_id, gives none.
    """
    words, _ = words_of(text)
    hashes = shingled(words)
    own = np.flatnonzero(firsts + len(_PLACES) <= len(hashes))
    if len(own):
        own = own[_mixed(hashes[firsts[own, None] + np.arange(len(_PLACES))]) == contents[own]]
    contents, firsts = contents[own], firsts[own]
    steps = np.arange(START)
    out: list[tuple] = []
    for is_left, wanted in ((False, right[own]), (True, left[own])):
        room = firsts if is_left else len(words) - firsts - WINDOW
        many = np.minimum(np.minimum(wanted, room), START)
        beside = firsts[:, None] - 1 - steps if is_left else firsts[:, None] + WINDOW + steps
        inside = steps < many[:, None]
        met = np.where(inside, words[np.where(inside, beside, 0)], np.uint64(0)) if len(own) else inside.astype(np.uint64)
        sums = np.cumsum(met * _BESIDE[int(is_left)], axis=1, dtype=np.uint64) + contents.view(np.uint64)[:, None]
        some = many > 0
        keys = _finished(sums).view(np.int64)[inside]
        out.append((contents[some], firsts[some], np.full(some.sum(), is_left), many[some], keys))
    return tuple(np.concatenate(column) for column in zip(*out, strict=True))


def across_documents(found: DataFrame) -> DataFrame:
    """The rows of components that occur in several documents, with the first occurrence of their component."""
    own = found.select("component", "doc_id", "first_word", "n_words")
    spread = own.groupBy("component").agg(
        F.min(F.struct("doc_id", "first_word")).alias("first"), F.max("doc_id").alias("last_doc")
    )
    spread = spread.where("first.doc_id <> last_doc").select("component", "first")
    return own.join(spread, "component").select(
        "component",
        "doc_id",
        "first_word",
        "n_words",
        F.col("first.doc_id").alias("first_doc"),
        ((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.first_word") == F.col("first_word"))).alias("kept"),
    )


def repeated(docs: DataFrame, similarity: float = SIMILARITY, short_lines: bool = False) -> DataFrame:
    """One row per document with a passage that repeats in another: doc_id, first_doc, repeated, removed, n_words, n_removed.

    docs has rows (doc_id, text). repeated and removed are spans of words (first_word, behind): all that occurs elsewhere
    too, and what goes because an earlier occurrence stays. n_words and n_removed are their lengths; first_doc is the
    smallest doc_id that any passage is shared with, the own included. short_lines and n_short are the spans and words of
    paragraphs under MIN_REPORTED words that repeat; of them nothing is removed. With the option short_lines documents that
    share nothing else have rows too, without passages and with a null first_doc.

    Words are cut at ASCII white space, case is ignored. Lines under SHINGLE words are no paragraphs of their own; paragraphs
    with under MIN_DIFFERENT different shingles, such as short lines or one word over and over, repeat only if equal. Null
    and empty texts have none; rows that share a doc_id are one document; rows without an id take no part; other columns are
    ignored; an empty table gives no rows.
    """
    spans = F.struct("first_word", (F.col("first_word") + F.col("n_words")).alias("behind"))
    by_doc = (
        members(docs, similarity)
        .groupBy("doc_id")
        .agg(
            F.min(F.when(~F.col("is_short"), F.col("first_doc"))).alias("first_doc"),
            F.sort_array(F.collect_set(F.when(~F.col("is_short"), spans))).alias("all"),
            F.sort_array(F.collect_set(F.when(~F.col("kept") & ~F.col("is_short"), spans))).alias("gone"),
            F.sort_array(F.collect_set(F.when(F.col("is_short"), spans))).alias("short"),
        )
    )
    if not short_lines:
        by_doc = by_doc.where(F.size("all") > 0)
    covered = by_doc.select(
        "doc_id", "first_doc", *[merged(F.col(c)).alias(to) for c, to in (("all", "r"), ("gone", "g"), ("short", "s"))]
    )
    return covered.select(
        "doc_id",
        "first_doc",
        F.col("r.spans").alias("repeated"),
        F.col("g.spans").alias("removed"),
        "r.n_words",
        F.col("g.n_words").alias("n_removed"),
        F.col("s.spans").alias("short_lines"),
        F.col("s.n_words").alias("n_short"),
    )
