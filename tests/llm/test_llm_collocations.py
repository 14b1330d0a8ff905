from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, differences

from tidewatch.llm import collocations as C
from tidewatch.llm.shared import Scratch

DOCS = "doc_id long, text string, lang string, phrase string, k int, h long"


def plain_counts(rows):
    """Occurrences of all phrases of rows of (text, lang), and all words, by language."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    return counts, total


def plain(rows, threshold, top=2000):
    counts, total = plain_counts(rows)
    out = set()
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if a >= threshold and " " in p}
        longest = Counter()
        for p, a in candidates.items():
            words = p.split(" ")
            for size in range(2, len(words)):
                for i in range(len(words) - size + 1):
                    inner = " ".join(words[i : i + size])
                    longest[inner] = max(longest[inner], a)
        found = []
        for p, a in candidates.items():
            if 100 * longest[p] >= 80 * a:
                continue
            words = p.split(" ")
            parts = [(f[" ".join(words[:k])], f[" ".join(words[k:])]) for k in range(1, len(words))]
            score, _, (left, right) = min((2_000_000 * a // (x + y), k, (x, y)) for k, (x, y) in enumerate(parts))
            found.append((-score, -a, p.encode(), (p, a, left, right, total[lang], score)))
        out |= {(lang, rank + 1, *row) for rank, (*_, row) in enumerate(sorted(found)[:top])}
    return out


def texts(rng, n):
    """Texts of few words and of repeated phrases, with pieces, other blanks, upper case and letters beyond ASCII."""
    words = ["the", "The", "of", "a", "is", "New", "york", "city", "é", "É", "x\x00y", "日本", "w" * 30]
    phrases = ["New York City", "new york", "of the a is", "a a a", "once upon a time there"]
    out = []
    for _ in range(n):
        parts = [rng.choice(words if rng.random() < 0.6 else phrases) for _ in range(rng.randint(0, 14))]
        out.append("".join(p + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\x0b"]) for p in parts))
    return out


def test_matches_sql_on_all_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert differences(C.collocations(docs), connect(sf_dir), C.oracle()) is None


@pytest.mark.parametrize("shards, bits", [(4, 1 << 16), (1, 1 << 16), (7, 64), (3, 256)])
def test_random_texts_match_the_definition(frame, monkeypatch, shards, bits):
    """Also with filters so small that they let most phrases through by chance, which must not change a count."""
    rng = random.Random(shards)
    monkeypatch.setattr(C, "THRESHOLD", 5)
    rows = [(t, rng.choice(["l1", "l1", "l1", None, "und", "l2"])) for t in texts(rng, 150)]
    rows += [(None, "l1"), ("", "l3"), ("...", "l4"), ("new york city", "l1")] + [("again and again", "l2")] * 6
    docs = frame([(i, *r, "clash", 1, 2) for i, r in enumerate(rows)], DOCS).repartition(3)
    found = [tuple(r) for r in C.collocations(docs, shards, bits).collect()]
    assert len(found) == len(set(found))
    assert set(found) == plain(rows, 5)
    phrases, words = C.phrase_counts(docs, Scratch(docs.sparkSession), shards, bits)
    counts, total = plain_counts(rows)
    want = {(lang, p, f) for lang, of in counts.items() for p, f in of.items() if f >= 5}
    assert {(r["lang"], r["phrase"], r["f"]) for r in phrases.collect()} == want
    assert {r["lang"]: r["n"] for r in words.collect()} == {k: n for k, n in total.items() if n}


def test_a_phrase_that_starts_late_is_counted_for_a_whole_circle(frame, monkeypatch):
    """Words reach the threshold in the last shard only, so longer phrases go through a second and a third circle."""
    monkeypatch.setattr(C, "THRESHOLD", 12)
    rows = [(f"alpha beta gamma delta tail{i}", "l") for i in range(12)]
    docs = frame([(i, *r, "", 0, 0) for i, r in enumerate(rows)], DOCS).coalesce(1)
    phrases, _ = C.phrase_counts(docs, Scratch(docs.sparkSession), 4, 1 << 12)
    got = {r["phrase"]: r["f"] for r in phrases.collect()}
    counts, _ = plain_counts(rows)
    assert got == {p: f for p, f in counts["l"].items() if f >= 12}
    assert got["alpha beta gamma delta"] == 12


def test_only_the_best_of_each_language_and_ties_by_bytes(frame, monkeypatch):
    monkeypatch.setattr(C, "THRESHOLD", 2)
    monkeypatch.setattr(C, "TOP", 7)
    monkeypatch.setattr(C, "PARTS", 3)
    rows = [(f"{a}{i} {b}{i}", lang) for i in range(30) for a, b in ("zé", "ab") for lang in ("x", "y") for _ in range(2)]
    docs = frame([(i, *r, "", 0, 0) for i, r in enumerate(rows)], DOCS)
    assert {tuple(r) for r in C.collocations(docs, 2, 1 << 12).collect()} == plain(rows, 2, 7)


def test_scores_with_products_beyond_64_bits(frame):
    rows = [("l", "a", 1, 9 * 10**17), ("l", "b", 1, 8 * 10**17), ("l", "a b", 2, 7 * 10**17)]
    (row,) = C.scored(frame(rows, "lang string, phrase string, k int, f long")).collect()
    assert (row["l"], row["r"], row["score"]) == (9 * 10**17, 8 * 10**17, 2_000_000 * 7 * 10**17 // (17 * 10**17))
    assert C.uncovered(frame([("l", "a b c", 3, 9 * 10**17), ("l", "a b", 2, 10**18)], "lang string, phrase string, k int, a long")).count() == 1


def test_a_filter_knows_what_was_put_in(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    rows = spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "h long")
    bits = C._with_bits(np.zeros((1 << 16) // 8, dtype=np.uint8), rows)
    assert C.Filter(bits).has(h).all()
    assert C.Filter(bits).has(rng.integers(0, 1 << 64, 5000, dtype=np.uint64)).mean() < 0.01
    more = C._with_bits(bits, rows.limit(0))
    assert np.array_equal(bits, more)


def test_long_text_and_empty_table(frame):
    long = "Ab cd. " * 200_000 + "w" * 100_000
    found = C.collocations(frame([(1, long, "l", "", 0, 0)], DOCS)).collect()
    assert [tuple(r) for r in found] == [("l", 1, "ab cd", 200_000, 200_000, 200_000, 400_001, 1_000_000)]
    assert C.collocations(frame([], DOCS)).count() == 0


def test_words_in_a_row_keep_pieces_and_texts_apart():
    seen = C.Words(pa.array(["a b.c", "", "d", " e\tF,"]), np.arange(4))
    spelled = [seen.dictionary[i].as_py() for i in seen.word.tolist()]
    assert spelled == [b"a", b"b", b"c", b"d", b"e", b"f"]
    assert seen.together.tolist() == [True, False, False, False, True]
    assert seen.lang.tolist() == [0, 0, 0, 2, 3, 3]


def test_a_scan_holds_little_beside_its_portion_and_sends_small_batches(monkeypatch):
    monkeypatch.setattr(C, "PORTION", 4 << 20)
    monkeypatch.setattr(C, "ROWS", 1000, raising=False)
    rng = np.random.default_rng(3)
    words = np.array([f"word{i}" for i in range(3000)])
    texts = [" ".join(rng.choice(words, 500)) for _ in range(900)]
    size = sum(map(len, texts))
    assert 3 << 20 < size < 4 << 20
    batch = pa.record_batch([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    full, none = np.full(1 << 12, 255, dtype=np.uint8), np.zeros(1 << 12, dtype=np.uint8)
    filters = [C.Filter(full), C.Filter(none), C.Filter(none)]
    tracemalloc.start()
    most = sum(1 for _ in filter(lambda b: b.num_rows > 1000, C._each(iter([batch]), lambda s, n: C.counted(s, n, filters, 1, 2))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not most
    assert peak < 13 * size


def test_portions_of_a_batch_are_of_about_the_same_size(monkeypatch):
    monkeypatch.setattr(C, "PORTION", 1000)
    batch = pa.record_batch([pa.array(["en"] * 21), pa.array(["x " * 25] * 21)], names=["lang", "text"])
    seen = []
    assert not [*C._each(iter([batch]), lambda s, n: seen.append(len(s.word)) or ())]
    assert sum(seen) == 21 * 25
    assert max(seen) <= 500 and min(seen) >= 200


def test_a_task_adds_up_its_portions(monkeypatch):
    """Also when it may hold so little that sums leave early."""
    rng = random.Random(5)
    rows = [(t, rng.choice(["l1", "l2"])) for t in texts(rng, 400)]
    batch = pa.record_batch([pa.array([lang for _, lang in rows]), pa.array([t for t, _ in rows])], names=["lang", "text"])
    full = C.Filter(np.full(1 << 12, 255, dtype=np.uint8))
    monkeypatch.setattr(C, "PORTION", 2000)
    counts, total = plain_counts(rows)
    want = {(lang, p): n for lang, of in counts.items() for p, n in of.items()} | {(lang, ""): n for lang, n in total.items()}
    for held in (C.HELD, 50_000, 1000):
        monkeypatch.setattr(C, "HELD", held)
        found = [*C.summed(C._each(iter([batch]), lambda seen, names: C.spelled(seen, names, full)))]
        rows_out = [tuple(r.values()) for b in found for r in b.to_pylist()]
        got = Counter()
        for lang, phrase, _, n in rows_out:
            got[lang, phrase] += n
        assert got == want
        if held > 1 << 20:
            assert len(rows_out) == len(want)
    assert [*C.summed(iter([]))] == []


def test_rows_of_the_last_scan_go_by_the_cores_not_by_the_input(frame):
    spark = frame([], DOCS).sparkSession
    parts = 6 * C.TASKS * spark.sparkContext.defaultParallelism
    docs = frame([(i, "one two three", "l", "", 0, 0) for i in range(4 * parts)], DOCS).select("lang", "text").repartition(parts)
    full = spark.sparkContext.broadcast(np.full(1 << 12, 255, dtype=np.uint8))
    rows = C._spelled_by_task(docs, full).collect()
    assert len(rows) <= 7 * C.TASKS * spark.sparkContext.defaultParallelism
    counts = Counter()
    for r in rows:
        counts[r["phrase"]] += r["n"]
    assert counts == {"": 12 * parts} | dict.fromkeys(["one", "two", "three", "one two", "two three", "one two three"], 4 * parts)


def test_hashes_tell_words_of_any_length_apart():
    words = [b"x" * n for n in range(1, 40)] + [b"x" * n + b"\0" for n in range(20)] + [b"y" + b"x" * n for n in range(20)]
    once = C._word_hashes(pa.array(words, pa.binary()))
    assert len(set(once.tolist())) == len(set(words))
    again = C._word_hashes(pa.array([b"before", *words[::-1], b"behind"], pa.binary()).slice(1, len(words)))
    assert (again[::-1] == once).all() and len(C._word_hashes(pa.array([], pa.binary()))) == 0


def test_counting_scans_make_no_dictionary_and_hold_little():
    texts = pa.array(["some words, and Others of a text. " * 1000] * 30)
    size = sum(len(t.as_py()) for t in texts)
    seen = C.Words(texts, np.zeros(len(texts), dtype=np.int32), numbered=False)
    assert not hasattr(seen, "word") and len(seen.hashes) == len(seen.lang) == 7 * 30_000
    full = C.Filter(np.full(1 << 16, 255, dtype=np.uint8))
    tracemalloc.start()
    for batch in C.counted(seen, ["l"], [full] * 3, 3, 2):
        assert batch.num_rows
    assert tracemalloc.get_traced_memory()[1] < 11 * size
    tracemalloc.stop()


def test_a_counting_worker_holds_as_much_for_more_text_and_counts_it_all():
    """Two workers share an executor with the heap, so what one holds must not go by what its task reads."""
    rng = np.random.default_rng(7)
    words = np.array([f"word{i}" for i in range(5000)])
    texts = [" ".join(rng.choice(words, 500)) for _ in range(1000)]
    batch = pa.record_batch([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    full, none = C.Filter(np.full(1 << 12, 255, dtype=np.uint8)), C.Filter(np.zeros(1 << 12, dtype=np.uint8))
    counts, peaks = [], []
    for times in (2, 4):
        n = Counter()
        tracemalloc.start()
        for b in C._each(iter([batch] * times), lambda s, names: C.counted(s, names, [full, none, none], 1, 2), numbered=False):
            n[b.column("k")[0].as_py()] += b.column("n").to_numpy().sum()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        counts.append(n)
    assert counts == [{k: times * 1000 * (501 - k) for k in range(1, 5)} for times in (2, 4)]
    assert peaks[1] < 1.2 * peaks[0] and peaks[1] < 90 << 20
