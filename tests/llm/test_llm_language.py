from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import language_id as L

DOCS = "doc_id long, text string, lang string, source string, score string, lang_pred long"


def plain_likelihood(word, probs, unknown):
    """Sum over all ways to cut a word, one by one."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        p = probs.get(word[:n], unknown if n == 1 else None)
        if p is not None:
            total += p * plain_likelihood(word[n:], probs, unknown)
    return total


def test_forward_sums_equal_all_segmentations(monkeypatch):
    draw = np.random.default_rng(0)
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "bb", "c"]
    probs = draw.random((len(pieces), 3)) / 10
    unknown = np.array([0.001, 0.002, 0.003])
    scorer = L.Scorer(pieces, probs, unknown)
    words = ["a", "abab", "bbabcx", "xyz", "abba" * 3, "a", "ba" * 15]
    found = scorer.log_likelihoods(words)
    for i, word in enumerate(words):
        if len(word) <= 12:
            for k in range(3):
                table = dict(zip(pieces, probs[:, k], strict=True))
                assert math.isclose(found[i, k], math.log(plain_likelihood("▁" + word, table, unknown[k])), rel_tol=1e-9)
    assert np.isfinite(scorer.log_likelihoods(["ab" * 4000])).all()
    counted = L.Counter(words)
    total = sum(n * scorer.log_likelihoods([w])[0] for w, n in counted.items())
    assert np.allclose(L.Scorer(pieces, probs, unknown).totals([counted, counted]), total)
    monkeypatch.setattr(L, "REMEMBERED", 3)
    forgetful = L.Scorer(pieces, probs, unknown)
    assert np.allclose(forgetful.totals([L.Counter(["a", "ab"])])[0], found[0] + scorer.log_likelihoods(["ab"])[0])
    assert np.allclose(forgetful.totals([counted])[0], total)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count()
    held = [r for r in found if r["held_out"]]
    assert 250 < len(held) < 420
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in found)


def test_prediction_never_uses_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wrong = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.languages(docs).collect()}
    b = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.languages(wrong).collect()}
    assert a == b


def test_edge_cases(frame):
    rows = [(i, "the house and the garden", "en", "s", "", 0) for i in range(6)]
    rows += [(i, "das haus und der garten", "de", "s", "", 0) for i in range(6, 12)]
    rows += [
        (20, None, "en", "s", "", 0), (21, "", "en", "s", "", 0), (22, "12 34 !?", "en", "s", "", 0),
        (23, "und der garten", None, "s", "", 0), (23, "und der garten", None, "s", "", 0),
        (None, "the garden", None, "s", "", 0), (24, "THE HOUSE", None, "s", "", 0), (25, "der " * 60_000, None, "s", "", 0),
        (26, "a" * 20_000, None, "s", "", 0),
    ]
    found = [(r["doc_id"], r["lang_pred"]) for r in L.languages(frame(rows, DOCS)).collect()]
    assert len(found) == len(rows)
    by_id = dict(found)
    assert [by_id[i] for i in (20, 21, 22)] == ["und"] * 3
    assert by_id[23] == "de" and by_id[None] == "en" and by_id[24] == "en" and by_id[25] == "de"
    assert found.count((23, "de")) == 2
    assert L.languages(frame([], DOCS)).count() == 0
    unlabelled = L.languages(frame([(1, "some words", None, "s", "", 0)], DOCS)).first()
    assert (unlabelled["lang_pred"], unlabelled["score"]) == ("und", 0.0)
