from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from compare import connect, differences

from tidewatch.llm import source_divergence as D

DOCS = "doc_id long, text string, lang string, source string, item string, value long"


def terms_of(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(lower))


def plain(rows):
    """All of the definition with Python's whole numbers: rows of (text, lang, source)."""
    rows = [tuple(v or "" for v in r) for r in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = terms_of(text)
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = set()
    for lang in {r[1] for r in rows}:
        kept = sorted(t for t, n in docs[lang].items() if n >= D.MIN_DOCS)
        groups = sorted(s for g, s in counts if g == lang)
        of = {s: {t: counts[lang, s][t] for t in kept} for s in groups}
        whole = {t: sum(of[s][t] for s in groups) for t in kept}

        def shares(n, v=len(kept)):
            total = sum(n.values())
            return {t: 1 + 10**9 * (c + 2) // (total + 2 * v) for t, c in n.items()}

        def far(p, q):
            return (p - q) * (p - q) // (p + q)

        p, q = {s: shares(of[s]) for s in groups}, shares(whole)
        for s in groups:
            pairs = [(sum(far(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            own = [(far(p[s][t], q[t]), t) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", own)):
                ranked = sorted(found, key=lambda f: (-f[0], f[1].encode()))[: None if part == "pair" else 10]
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)}
    return out


def test_matches_sql_on_all_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert differences(D.divergence(docs), connect(sf_dir), D.oracle()) is None


def test_random_texts_match_the_definition(frame, monkeypatch):
    rng = random.Random(1)
    words = ["Alpha", "alpha", "be", "ÄÖ", "äö", "x" * 8, "y" * 9, "w" * 16, "z" * 17, "Z" * 40, "日本", "e_f", "g7h", "\x00i", "ſ"]
    rows = []
    for _ in range(160):
        text = rng.choice([" ", "-", "1", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 12)))
        rows.append((text, rng.choice(["l1", "l1", "l2"]), rng.choice("abcdefg")))
    rows += [(None, None, None), ("", "l3", "a"), ("only here", "l3", "b"), ("be", "l1", None)] + [("be", "l1", "a")] * 12
    monkeypatch.setattr(D, "PORTION", 300)
    frame_rows = [(i, *r, "clash", 0) for i, r in enumerate(rows)]
    found = D.divergence(frame(frame_rows, DOCS).repartition(3)).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == plain(rows)
    assert {r["value"] for r in found if r["lang"] == "l3"} == {0}


def test_tiles_and_blocks_change_nothing(frame, monkeypatch):
    rng = random.Random(2)
    rows = [(" ".join(rng.choice("abcdefghijklmnop") for _ in range(9)), "l", f"s{rng.randrange(8)}") for _ in range(200)]
    docs = frame([(i, *r, "", 0) for i, r in enumerate(rows)], DOCS)
    whole = {tuple(r) for r in D.divergence(docs).collect()}
    assert whole == plain(rows)
    kept, groups = _parts(docs)
    small = _pairs_with(monkeypatch, kept, groups)
    assert small == {(r[0], r[1], r[3], r[4]) for r in whole if r[2] == "pair"}


def _parts(docs):
    F = D.F
    counts = D.term_counts(docs)
    total = counts.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = total.withColumn("v", F.lit(counts.select("term").distinct().count()).cast("long"))
    groups = groups.withColumn("p0", D._share(F.lit(0).cast("long"), F.col("n_group"), F.col("v")))
    kept = counts.join(groups, ["lang", "source"])
    return kept.select("lang", "source", "term", D._share(F.col("n"), F.col("n_group"), F.col("v")).alias("p")), groups


def _pairs_with(monkeypatch, kept, groups):
    """Pairs with tiles of 3 sources and blocks of 5 terms; tasks see the constant through the plan's own tile bounds."""
    monkeypatch.setattr(D, "BLOCK", 5)
    return {tuple(r) for r in D._pairs(kept, groups, tile=3).collect()}


def test_counts_beyond_64_bits_of_products(frame):
    F = D.F
    big = frame([(4 * 10**12, 9 * 10**12, 10)], "n long, total long, v long")
    share = big.select(D._share(F.col("n"), F.col("total"), F.col("v"))).first()[0]
    assert share == 1 + 10**9 * (4 * 10**12 + 2) // (9 * 10**12 + 20)


def test_packing_sorts_and_counts_as_plain_python():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aAbBéz日 ,") for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["", "q" * 300]
    group = np.array([rng.randrange(5) for _ in texts])
    seen, docs = Counter(), Counter()
    for g, text in zip(group.tolist(), texts, strict=True):
        seen.update((g, t) for t in terms_of(text))
        docs.update((g, t) for t in set(terms_of(text)))
    got = {}
    for of, terms, n, n_docs in D.counted(pa.array(texts), group):
        buckets = [(int(g), t) for g, t in zip(of, terms, strict=True)]
        assert buckets == sorted(buckets)
        got |= {(g, t.decode()): (int(a), int(b)) for (g, t), a, b in zip(buckets, n, n_docs, strict=True)}
    assert got == {k: (seen[k], docs[k]) for k in seen}


def test_long_text_and_empty_table(frame):
    text = "Term " * 300_000 + "t" * 100_000
    counts = {r["term"]: (r["n"], r["n_docs"]) for r in D.term_counts(frame([(1, text, "l", "s", "", 0)], DOCS)).collect()}
    assert counts == {"term": (300_000, 1), "t" * 100_000: (1, 1)}
    assert D.divergence(frame([], DOCS)).count() == 0
