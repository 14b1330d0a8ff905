"""Phrase collocation mining by dynamic itemset counting.

The texts are written once in shards, and scanned shard after shard in a circle. Words are counted from the first shard on.
A longer phrase is activated as soon as both its subphrases, without the last and without the first word, have reached the
threshold in what is counted of them so far; it is then counted through one full circle, while shorter and longer ones are
counted in the same scans. The scans end when nothing is active any more: mostly after little more than two circles, four
at most.

Which phrases have reached the threshold goes to the tasks as a filter of a fixed size, bits set by the phrases' hashes.
Filters only gain bits, so a phrase that one lets through passes every later one. A phrase is active in a shard if the
present filter has all its subphrases and the filter of one circle ago hadn't: the shards of exactly one circle, whether it
passes rightly or by chance. While they are active, phrases are counted by their hashes. Two with the same hash are counted
as one, so a count may be too high, never too low. The phrases of the hashes that reach the threshold are then spelled and
counted in one last scan, which is exact; however full a filter is, that costs time but no count is wrong.

Work in a task is on the bytes of many texts at once, by hashes or numbers for words; what leaves it is a row for each different
phrase of a portion. The last scan has a few tasks for each core, however large the input, and a task sums over its portions
what it may hold, so that a phrase leaves it about once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import Scratch, shuffles_released
from tidewatch.llm.source_divergence import portions, text_bytes

#: Occurrences that make a phrase a candidate, words of the longest, phrases reported for each language.
THRESHOLD, LONGEST, TOP = 30, 4, 2000
#: Shards of a circle. More let long phrases begin sooner, but sums are made anew after each.
SHARDS = 2
#: Bits of a filter, a power of two. Full filters cost time, not rows; 2^25 keep apart some five million phrases.
FILTER_BITS = 1 << 25
#: Score of a phrase whose words come only together; a longer candidate with this share in percent covers a shorter one.
UNIT, COVERED = 1_000_000, 80
#: Bytes of text that are counted at the same time (a longer text on its own), rows that leave a task together. A worker
#: holds some 16 bytes for each of the portion, beside an executor's heap; what several portions have is added up in Spark.
PORTION, ROWS = 6 << 20, 1 << 16
#: Bytes of texts that go to Python together.
BATCH = 2 << 20
#: Bytes of spelled phrases that a task holds to sum them over its portions, tasks of the last scan for each core.
HELD, TASKS = 40 << 20, 2
#: Bytes of the longest words that are hashed by eight bytes.
SHORT = 16
#: Portions of the last scan are so many times smaller than the others', as it holds sums beside them.
SMALLER = 3
#: Parts of a language whose best phrases are found apart before they meet in one task.
PARTS = 64

#: Folded bytes, and what each byte is: part of a word, a blank between words, an end of a piece. They are looked up by
#: bytes.translate, as numpy would make an index of 8 bytes for each one.
FOLD = bytes(range(256)).lower()
BLANKS, ENDS = b" \t", b".,;:!?\n\x0B\f\r"
KIND = bytes(1 if b in BLANKS else 2 if b in ENDS else 0 for b in range(256))

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: The first so many bytes of eight, as they lie in memory.
_FIRST = np.array([[255] * n + [0] * (8 - n) for n in range(9)], dtype=np.uint8).view(np.uint64)[:, 0]
COUNTED = pa.schema([("h", pa.int64()), ("k", pa.int32()), ("since", pa.int32()), ("n", pa.int64())])
SPELLED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("n", pa.int64())])


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers where they are; wraps around."""
    h ^= h >> np.uint64(32)
    for shift in (29, 32):
        h *= _MIX
        h ^= h >> np.uint64(shift)
    return h


def _hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each byte string, by the bytes' places from its begin."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    at = at - at[0]
    sizes = np.diff(at)
    place = (np.arange(len(raw)) - np.repeat(at[:-1], sizes)).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mixed((place << np.uint64(8)) + raw + _ODD))])
    return _mixed(sums[at[1:]] - sums[at[:-1]] + sizes.astype(np.uint64) * _ODD)


def _joined(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one more word."""
    h = h * _ODD
    h += word
    return _mixed(h)


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word in a row: one of up to SHORT bytes by eight of them at a time, a longer one by places."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    raw = np.zeros(int(at[-1] - at[0]) + SHORT, dtype=np.uint8)
    raw[: len(raw) - SHORT] = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]
    eight = np.lib.stride_tricks.as_strided(raw[:8].view(np.uint64), shape=(len(raw) - 7,), strides=(1,))
    h = np.empty(len(words), dtype=np.uint64)
    for first in range(0, len(words), ROWS):  # few at a time, as each takes some numbers on the way
        here = at[first : first + ROWS + 1]
        sizes, begins = np.diff(here), here[:-1] - at[0]
        own = _joined(sizes.astype(np.uint64), eight[begins] & _FIRST[np.minimum(sizes, 8)])
        more = np.flatnonzero((sizes > 8) & (sizes <= SHORT))
        own[more] = _joined(own[more], eight[begins[more] + 8] & _FIRST[sizes[more] - 8])
        longer = np.flatnonzero(sizes > SHORT)
        if len(longer):
            own[longer] = _hashes(words.take(pa.array(longer + first)))
        h[first : first + len(own)] = own
    return h


class Filter:
    """A set of hashes that may also say yes to others; two bits for each."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.empty(len(h), dtype=bool)
        for at in range(0, len(h), ROWS):  # few at a time, as each takes some numbers on the way
            own = h[at : at + ROWS]
            first = self._bit(own)
            some = np.flatnonzero(first)
            first[some] = self._bit(own[some] >> np.uint64(32))
            found[at : at + ROWS] = first
        return found

    def _bit(self, place: np.ndarray) -> np.ndarray:
        place = place & np.uint64(len(self.bits) * 8 - 1)
        of_byte = (place & np.uint64(7)).astype(np.uint8)
        place >>= np.uint64(3)
        return (self.bits[place.view(np.int64)] >> of_byte & 1) > 0


class Words:
    """The words of texts in a row: their hashes, the numbers of their languages, and whether the next one is in its piece.

    If they shall be spelled, also numbers of the words and a dictionary, which take longer than hashes.
    """

    def __init__(self, texts: pa.Array, lang: np.ndarray, numbered: bool = True):
        raw, rows = text_bytes(texts)
        kind = np.frombuffer(raw.tobytes().translate(KIND), dtype=np.uint8)
        inside = np.zeros(len(raw) + 1, dtype=bool)
        np.equal(kind, 0, out=inside[:-1])
        first, last = inside[:-1].copy(), inside[:-1].copy()
        first[1:] &= ~inside[:-2]
        last &= ~inside[1:]
        begins = rows[:-1][rows[:-1] < len(raw)]
        first[begins] = inside[begins]
        last[begins[begins > 0] - 1] = inside[begins[begins > 0] - 1]
        starts = np.flatnonzero(first)
        offsets = np.zeros(len(starts) + 1, dtype=np.int32)
        np.cumsum(np.flatnonzero(last) + 1 - starts, out=offsets[1:])
        del first, last
        # There are fewer texts and ends than words, so they are searched among the words.
        of_row = np.searchsorted(starts, rows)
        self.lang = np.repeat(lang.astype(np.int32), np.diff(of_row))
        self.together = np.ones(max(0, len(starts) - 1), dtype=bool)
        for next_word in (of_row, np.searchsorted(starts, np.flatnonzero(kind == 2))):
            self.together[next_word[(next_word > 0) & (next_word < len(starts))] - 1] = False
        many = len(starts)
        del kind, inside, starts, of_row, next_word
        letters = raw.tobytes().translate(FOLD, BLANKS + ENDS)
        spelled = pa.BinaryArray.from_buffers(pa.binary(), many, [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        self.hashes = _word_hashes(spelled)
        if numbered:
            coded = spelled.dictionary_encode()
            self.dictionary = coded.dictionary
            self.word = coded.indices.to_numpy(zero_copy_only=False)


def passing(seen: Words, names: list[str], filters: list[Filter]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each length k: where phrases begin whose subphrases the first filter has, their hashes, and how many of the
    other filters, older and older ones, have them too. The words come first, as if all filters had what they are made of.
    """
    seeds = _hashes(pa.array([n.encode() for n in names], pa.binary()))
    place = np.arange(len(seen.lang), dtype=np.int32)
    h = _joined(seeds[seen.lang], seen.hashes)
    had = [np.ones(len(place), dtype=bool) for _ in filters]
    for k in range(1, LONGEST + 1):
        yield k, place, h, sum((x.astype(np.int8) for x in had[1:]), np.zeros(len(place), dtype=np.int8))
        has = [over & f.has(h) for over, f in zip(had, filters, strict=True)]
        begins = seen.together if k == 1 else np.diff(place) == 1
        begins = np.flatnonzero(begins & has[0][:-1] & has[0][1:])
        if not len(begins):
            return
        place = place[begins]
        h = h[begins]
        h = _joined(h, seen.hashes[place + k])
        had = [(x[:-1] & x[1:])[begins] for x in has]


def counted(seen: Words, names: list[str], filters: list[Filter], step: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Counts of what is active in a step: h, k, since, n, with the step since when."""
    for k, place, h, age in passing(seen, names, filters):
        for old in range(shards):
            if k == 1 and old != step:  # words are counted from the first shard on
                continue
            ordered = np.sort(h if k == 1 else h[age == old])
            ends = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], len(ordered) > 0))
            same = np.full(min(len(ends), ROWS), k, dtype=np.int32), np.full(min(len(ends), ROWS), step - old, dtype=np.int32)
            for at in range(0, len(ends), ROWS):
                last = ends[at : at + ROWS]
                n = np.diff(last, prepend=ends[at - 1] if at else -1)
                columns = [ordered[last].view(np.int64), *[c[: len(last)] for c in same], n]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, COUNTED.types, strict=True)], schema=COUNTED)
            del ordered, ends
        del place, h, age  # before the next ones are made


def spelled(seen: Words, names: list[str], frequent: Filter) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases that a filter has: lang, phrase, k, n; and of all words, as the phrase of no word."""
    many = max(1, len(seen.dictionary))
    total = np.bincount(seen.lang, minlength=len(names))
    nothing = [pa.array([""] * len(names)), pa.array(np.zeros(len(names), dtype=np.int32))]
    yield pa.record_batch([pa.array(names, pa.string()), *nothing, pa.array(total, pa.int64())], schema=SPELLED)
    for k, place, h, _ in passing(seen, names, [frequent]):
        place = place[frequent.has(h)]
        if not len(place):
            continue
        key, most = seen.lang[place].astype(np.int64), max(1, len(names))
        shorter: dict[int, np.ndarray] = {}  # what keys stood for when they would have passed 63 bits
        for i in range(k):
            if most * many >= 1 << 63:
                shorter[i], key = np.unique(key, return_inverse=True)
                most = len(shorter[i])
            key, most = key * many + seen.word[place + i], most * many
        key, n = np.unique(key, return_counts=True)
        columns: list[np.ndarray] = []
        for i in reversed(range(k)):
            key, word = np.divmod(key, many)
            columns.insert(0, word)
            if i in shorter:
                key = shorter[i][key]
        columns.insert(0, key)
        words = [seen.dictionary.take(pa.array(c)) for c in columns[1:]]
        phrase = words[0] if k == 1 else pc.binary_join_element_wise(*words, b" ")
        langs = pa.array(names, pa.string()).take(pa.array(columns[0]))
        length = pa.array(np.full(len(n), k, dtype=np.int32))
        found = pa.record_batch([langs, phrase.cast(pa.string()), length, pa.array(n, pa.int64())], schema=SPELLED)
        yield from (found.slice(at, ROWS) for at in range(0, len(n), ROWS))


def summed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that spelled makes of several portions, with a phrase's counts added up.

    They are added up whenever HELD bytes have come together. Sums that still take over half of that leave early, so a phrase
    may have several rows in the end.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in found:
        held.append(batch)
        size += batch.nbytes
        if size > HELD:
            held = _sums(held)
            pa.default_memory_pool().release_unused()
            size = sum(b.nbytes for b in held)
            if size > HELD // 2:
                yield from held
                held, size = [], 0
    yield from _sums(held)


def _sums(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    sums = pa.Table.from_batches(held, SPELLED).group_by(SPELLED.names[:-1], use_threads=False).aggregate([("n", "sum")])
    sums = sums.select([*SPELLED.names[:-1], "n_sum"]).rename_columns(SPELLED.names)
    return sums.combine_chunks().to_batches(max_chunksize=ROWS)


def _each(batches: Iterator[pa.RecordBatch], of_words, parts: int = 1, numbered: bool = True) -> Iterator[pa.RecordBatch]:
    """What a function of the words, and of their languages' names, makes of each portion of rows (lang, text).

    Portions are of PORTION bytes, or of that many parts of it. numbered: whether words have numbers and a dictionary.
    """
    portion = max(1, PORTION // parts)
    for batch in _gathered(batches, portion):
        lang, text = batch.column("lang").dictionary_encode(), batch.column("text")
        number, names = lang.indices.to_numpy(zero_copy_only=False), lang.dictionary.to_pylist()
        _, rows = text_bytes(text)
        even = int(rows[-1]) // (int(rows[-1]) // portion + 1) + 1  # no small one is left at the end
        for a, b in portions(rows, min(portion, even + int(np.diff(rows).max(initial=0)))):
            seen = Words(text.slice(a, b - a), number[a:b], numbered)
            if len(seen.lang):
                yield from of_words(seen, names)
            del seen  # before the next ones are made
        del batch, lang, text, number, rows
        pa.default_memory_pool().release_unused()


def _gathered(batches: Iterator[pa.RecordBatch], portion: int) -> Iterator[pa.RecordBatch]:
    """The rows of small batches in larger ones, of up to a portion's bytes; a larger one stays as it is."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if held and size + batch.nbytes > portion:
            whole = [pa.concat_batches(held)]
            held.clear()
            size = 0
            yield whole.pop()
        held.append(batch)
        size += batch.nbytes
    if held:
        whole = [pa.concat_batches(held)]
        held.clear()
        yield whole.pop()


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """In the block, texts go to Python in batches of some BATCH bytes, which take that much less beside the heap."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, BATCH)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _scan(shard: DataFrame, step: int, shards: int, filters: list) -> DataFrame:
    """Counts of what is active, of a shard of rows (lang, text); the broadcast filters are newest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Filter(f.value) for f in filters]
        yield from _each(batches, lambda seen, names: counted(seen, names, known, step, shards), numbered=False)

    return shard.mapInArrow(run, "h long, k int, since int, n long")


def _spelled_by_task(texts: DataFrame, frequent) -> DataFrame:
    """lang, phrase, k, n: counts of the phrases in a broadcast filter, and of all words with k = 0, added up in each task.

    A frequent phrase is in nearly all texts' tasks, so its rows would grow with their number; it goes by the cores instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(frequent.value)
        yield from summed(_each(batches, lambda seen, names: spelled(seen, names, known), SMALLER))

    tasks = TASKS * texts.sparkSession.sparkContext.defaultParallelism
    return texts.coalesce(tasks).mapInArrow(run, "lang string, phrase string, k int, n long")


def _spell(texts: DataFrame, frequent) -> DataFrame:
    """lang, phrase, k, f of the phrases in a broadcast filter, if they reach the threshold, and of all words with k = 0."""
    found = _spelled_by_task(texts, frequent)
    return found.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("f")).where((F.col("f") >= THRESHOLD) | (F.col("k") == 0))


def _with_bits(bits: np.ndarray, reached: DataFrame) -> np.ndarray:
    """The filter with the bits of more hashes; at most one number for each 32 bits comes to the driver."""
    last = F.lit(len(bits) * 8 - 1)
    places = reached.select(F.explode(F.array(F.col("h").bitwiseAND(last), F.shiftrightunsigned("h", 32).bitwiseAND(last))).alias("place"))
    parts = places.groupBy(F.shiftright("place", 5).alias("part")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 32).cast("int"))).alias("bits")
    )
    table = parts.toArrow()
    out = bits.copy()
    if table.num_rows:
        whole = out.view(np.uint32)
        part = table.column("part").to_numpy()
        whole[part] |= table.column("bits").to_numpy().astype(np.uint32)
    return out


def phrase_counts(docs: DataFrame, scratch: Scratch, shards: int = SHARDS, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, k, f of all phrases of up to LONGEST words with f >= THRESHOLD, and lang, n: all words of each."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int"))
    texts = scratch.keep(rows, "shards", "shard")
    none = np.zeros(bits // 8, dtype=np.uint8)
    filters, frequent = [none], none  # newest first, one circle of them and one more
    active: DataFrame | None = None
    step = 0
    while step < shards or not np.array_equal(filters[0], filters[-1]):
        shard = texts.where(F.col("shard") == step % shards).select("lang", "text")
        sent = [spark.sparkContext.broadcast(f) for f in filters]
        found = _scan(shard, step, shards, sent)
        found = found if active is None else found.unionAll(active)
        counts = scratch.keep(found.groupBy("h", "k", "since").agg(F.sum("n").alias("n")), f"counts-{step}")
        for f in sent:
            f.unpersist()
        if step:
            scratch.drop(f"counts-{step - 1}")
        # What has been counted for a circle is complete; the rest goes on.
        reached, complete = F.col("n") >= THRESHOLD, F.col("since") <= step - shards + 1
        frequent = _with_bits(frequent, counts.where(reached & complete))
        filters = [_with_bits(filters[0], counts.where(reached & (F.col("k") < LONGEST))), *filters[:shards]]
        active = counts.where(~complete)
        step += 1
    whole = texts.select("lang", "text")
    found = scratch.keep(_spell(whole, spark.sparkContext.broadcast(frequent)), "phrases")
    return found.where("k > 0"), found.where("k = 0 and f > 0").select("lang", F.col("f").alias("n"))


def _cut(k: str, first: bool) -> F.Column:
    """The first k words of a phrase, or the rest."""
    words = F.split("phrase", " ", -1)
    return F.array_join(F.slice(words, 1, F.col(k)) if first else F.slice(words, F.col(k) + 1, F.size(words)), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, score of the candidates: phrases of two words or more, at their lowest-scoring cut."""
    parts = phrases.select("lang", F.col("phrase").alias("part"), "f")
    cuts = phrases.where("k > 1").select(
        "lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    )
    cuts = cuts.select("*", _cut("cut", True).alias("left"), _cut("cut", False).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        of = parts.select("lang", F.col("part").alias(side), F.col("f").alias(name))
        cuts = cuts.join(of, ["lang", side])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(2 * UNIT).cast("decimal(10,0)") * wide("a"), wide("l") + wide("r"))
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x")
    return cuts.groupBy("lang", "phrase", "k", "a").agg(lowest).select("lang", "phrase", "k", "a", "x.l", "x.r", "x.score")


def uncovered(candidates: DataFrame) -> DataFrame:
    """The candidates that no longer one covers: holds in its words, coming COVERED percent as often or more."""
    words = F.split("phrase", " ", -1)
    spans = [(at, size) for size in range(2, LONGEST) for at in range(1, LONGEST - size + 2)]
    inner = [F.when(F.col("k") >= F.lit(max(at + size - 1, size + 1)), F.array_join(F.slice(words, at, size), " ")) for at, size in spans]
    longer = (
        candidates.where("k > 2")
        .select("lang", F.explode(F.array_compact(F.array(*inner))).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longest"))
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    covered = F.coalesce(F.lit(100) * wide("longest") >= F.lit(COVERED) * wide("a"), F.lit(False))
    return candidates.join(longer, ["lang", "phrase"], "left").where(~covered).drop("longest")


def collocations(docs: DataFrame, shards: int = SHARDS, bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the TOP phrases of each language of docs (text, lang).

    Rank goes by score, then by occurrences a, then by phrase in byte order, so no two are equal. Null text is empty, null
    lang `und`. Empty texts and texts without words add nothing. Repeated rows count as often as they come. A text is
    counted whole, however long. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    with shuffles_released(docs.sparkSession), _small_batches(docs.sparkSession):
        phrases, words = phrase_counts(docs, scratch, shards, bits)
    found = scratch.keep(uncovered(scored(phrases)), "scored")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    within = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    best = found.withColumn("part", part).withColumn("rank", within).where(F.col("rank") <= TOP).drop("part", "rank")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return (
        ranked.where(F.col("rank") <= TOP)
        .join(words, "lang")
        .select("lang", *[F.col(c).cast("long") if c == "rank" else F.col(c) for c in ("rank", "phrase", "a", "l", "r", "n", "score")])
    )


def oracle() -> str:
    """DuckDB SQL for collocations(documents)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
        WITH doc AS (
            SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS text FROM documents
        ), piece AS (
            SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM doc
        ), spelled AS (
            SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM piece
        ), place AS (
            SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM spelled, range(1, {LONGEST + 1}) AS length(k)
        ), phrase AS (
            SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM place GROUP BY ALL
        ), total AS (
            SELECT lang, sum(f) AS n FROM phrase WHERE k = 1 GROUP BY lang
        ), candidate AS (
            SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM phrase WHERE k > 1 AND f >= {THRESHOLD}
        ), cut AS (
            SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM candidate
        ), score AS (
            SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, ({2 * UNIT} * c.a::HUGEINT) // (l.f + r.f) AS score
            FROM cut c
            JOIN phrase l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[:c.cut], ' ')
            JOIN phrase r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')
        ), lowest AS (
            SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
        ), span AS (
            SELECT lang, a, w, size, unnest(range(1, k - size + 2)) AS i FROM candidate, range(2, {LONGEST}) AS length(size) WHERE size < k
        ), covering AS (
            SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS a FROM span GROUP BY ALL
        ), ranked AS (
            SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
            FROM lowest s LEFT JOIN covering c ON c.lang = s.lang AND c.phrase = s.phrase
            WHERE c.a IS NULL OR 100 * c.a::HUGEINT < {COVERED} * s.a::HUGEINT
        )
        SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n::BIGINT AS n, r.score::BIGINT AS score
        FROM ranked r JOIN total t ON t.lang = r.lang WHERE r.rank <= {TOP}
    """
