from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import packing as P

DOCS = "doc_id long, text string, bin_id string, n long, piece string"


def plain_best_fit(sizes, lengths, filled):
    """Longest first into the fullest bin that holds it, looking at every bin."""
    bins = []
    for size in sorted(sizes, reverse=True):
        fitting = [b for b in bins if b[0] - b[1] >= size]
        if fitting:
            min(fitting, key=lambda b: b[0] - b[1])[1] += size
        else:
            bins.append([P.opened_for(size, lengths, P.token_price, filled), size])
    return sorted(min(c for c in lengths if c >= used) for _, used in bins)


@pytest.mark.parametrize("filled", P.FILLED)
def test_pack_is_best_fit(filled):
    draw = random.Random(4)
    lengths = (8, 16, 40)
    for n in (0, 1, 2, 30, 300):
        sizes = [draw.randint(1, 40) for _ in range(n)]
        bins, offsets, made = P.pack(sizes, lengths, filled=filled)
        held = {}
        for size, b, offset in zip(sizes, bins, offsets, strict=True):
            held.setdefault(b, []).append((offset, offset + size))
        assert sorted(held) == list(range(len(made)))
        for b, spans in held.items():
            spans.sort()
            assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
            assert made[b] == min(c for c in lengths if c >= spans[-1][1])
        assert sorted(made) == plain_best_fit(sizes, lengths, filled)


def test_joint_choice_is_never_dearer_than_one_length():
    draw = random.Random(5)
    sizes = [draw.choice((70, 300, 900, 2000, 4096)) - draw.randint(0, 60) for _ in range(400)]
    price = lambda made: sum(map(P.token_price, made))
    joint = price(P.cheapest(sizes, P.LENGTHS)[2])
    assert joint <= price(P.pack(sizes, (4096,))[2])
    assert joint <= min(price(P.pack(sizes, P.LENGTHS, filled=f)[2]) for f in P.FILLED)
    assert sum(P.cheapest(sizes, P.LENGTHS)[2]) < 1.1 * sum(sizes)


def test_every_token_is_packed_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = P.packed(docs).collect()
    tokens, bins = {}, {}
    for r in rows:
        tokens.setdefault(r["doc_id"], []).append((r["first"], r["n_tokens"]))
        if r["bin_id"] is not None:
            bins.setdefault((r["bin_id"], r["bin_length"]), []).append((r["bin_offset"], r["n_tokens"]))
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for doc_id, text in texts.items():
        parts = sorted(tokens[doc_id])
        assert sum(n for _, n in parts) == len(text.encode().split())
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, length), parts in bins.items():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
        assert sum(n for _, n in parts) <= length and length in P.LENGTHS
    total = P.sequences(P.packed(docs)).agg(F.sum("n_tokens"), F.sum("bin_length")).first()
    assert total[0] / total[1] > 0.9


def test_edge_cases(frame):
    rows = [
        (1, None, "x", 5, ""), (2, "", "x", 5, ""), (3, "a b c", "x", 5, ""), (3, "a b c", "x", 5, ""),
        (None, "a b", "x", 5, ""), (4, "w " * 20_000, "x", 5, ""), (5, " \n ", "x", 5, ""),
    ]
    found = P.packed(frame(rows, DOCS).coalesce(1)).collect()
    empty = sorted(r["doc_id"] for r in found if r["bin_id"] is None)
    assert empty == [1, 2, 5] and all(r["n_tokens"] == 0 for r in found if r["bin_id"] is None)
    assert sorted(r["n_tokens"] for r in found if r["doc_id"] == 4) == sorted([4096] * 4 + [20_000 - 4 * 4096])
    assert [r["n_tokens"] for r in found if r["doc_id"] == 3] == [3, 3]
    assert [r["n_tokens"] for r in found if r["doc_id"] is None] == [2]
    by_count = P.packed(frame(rows, DOCS), n_tokens=F.col("n"), lengths=(4, 4, 8)).collect()
    assert {r["n_tokens"] for r in by_count} == {5} and {r["bin_length"] for r in by_count} == {8}
    assert P.packed(frame([], DOCS)).count() == 0


def test_the_query_counts_tokens_of_the_vocabulary(spark, tmp_path):
    from tidewatch.llm import queries, token_counts

    schema = "doc_id long, text string"
    rows = [(1, "x" * 3 + "漢字かな" * 4000), (2, "unbelievableness of invented wordlings"), (3, None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    sums, encoder = {}, token_counts.Vocabulary().encoder()
    for r in queries.op7_packing(spark, str(tmp_path)).collect():
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + r["n_tokens"]
        assert r["n_tokens"] <= max(P.LENGTHS)
    assert sums == {i: len(token_counts.token_ends(t or "", encoder)) for i, t in rows} and sums[1] > 4096


def test_small_lots_do_not_share_bins(frame):
    rows = [(i, "a b c", "", 3, "") for i in range(50)]
    found = P.packed(frame(rows, DOCS).repartition(3), lot=7, lengths=(8,)).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(50))
    used = {}
    for r in found:
        used[r["bin_id"]] = used.get(r["bin_id"], 0) + r["n_tokens"]
    assert max(used.values()) <= 8


def test_tokens_are_counted_in_the_worker_that_packs(spark, frame):
    from tidewatch.llm import queries, token_counts

    rows = [(i, "some words and more " * (i % 400), "", 0, "") for i in range(700)] + [(2**53 + 1, "a b", "", 0, ""), (None, None, "", 0, "")]
    docs = frame(rows, DOCS).coalesce(1)
    found = P.packed(docs, start=token_counts.counter(), lot=300)
    by_column = P.packed(docs, n_tokens=token_counts.token_count(F.col("text")), lot=300)
    assert found.collect() == by_column.collect()
    assert {r["doc_id"] for r in found.collect()} == {r[0] for r in rows}  # exact beside a missing one
    plan = queries.op7_packing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("EvalPython|MapInPandas|MapInArrow", plan)) == 1


def test_rows_leave_with_ids_of_any_type(frame):
    found = P.packed(frame([("a", "x y"), (None, "z"), ("b", None)], "doc_id string, text string")).collect()
    assert sorted((r["doc_id"] or "", r["n_tokens"]) for r in found) == [("", 1), ("a", 2), ("b", 0)]
