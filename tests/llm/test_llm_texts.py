from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import license_scan as C
from tidewatch.llm import paragraph_dedup as D
from tidewatch.llm import token_counts as K

DOCS = "doc_id long, text string, section string, content string, wanted long"


def doc(i, text):
    return (i, text, "x", "x", 0)


# Token counts


@pytest.fixture(scope="module")
def vocabulary():
    return K.Vocabulary()


def plain_attribution(text, vocabulary, rule):
    """Tokens of each line, byte by byte."""
    encoding, _ = vocabulary.encoder()
    lines = text.split("\n")
    lines = [line + "\n" for line in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
    owner = [i for i, line in enumerate(lines) for _ in line.encode()]
    counts, crossing, at = [0] * len(lines), [0] * len(lines), 0
    for token in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(token))
        held = owner[at : at + size]
        if rule == "most":
            line = max(sorted(set(held)), key=held.count)
        else:
            line = held[0] if rule == "first" else held[-1]
        counts[line] += 1
        crossing[line] += held[0] != held[-1]
        at += size
    assert at == len(text.encode())
    return list(zip(map(len, lines), counts, crossing, strict=True))


@pytest.mark.parametrize("rule", K.RULES)
def test_tokens_match_byte_by_byte(frame, vocabulary, rule):
    texts = ["one two\nthree", "\n\n\na", "é\n\nçà è\n ü", "a\n", "x  \n  y\n\n   z", "日本\n語" * 5, "tab\there\r\n\r\nend "]
    found = {}
    for r in K.line_tokens(frame([doc(i, t) for i, t in enumerate(texts)], DOCS), vocabulary, rule).collect():
        found.setdefault(r["doc_id"], []).append((r["section"], r["last"] - r["first"], r["n_tokens"], r["n_crossing"]))
    for i, text in enumerate(texts):
        assert [x[1:] for x in sorted(found[i])] == plain_attribution(text, vocabulary, rule)


def test_sections_sum_to_the_whole_document(spark, vocabulary):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    encoding, _ = vocabulary.encoder()
    total, length = {}, {}
    for r in K.line_tokens(docs, vocabulary).collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        length[r["doc_id"]] = max(length.get(r["doc_id"], 0), r["last"])
    for r in docs.select("doc_id", "text").collect():
        assert total[r["doc_id"]] == len(encoding.encode_ordinary(r["text"])) and length[r["doc_id"]] == len(r["text"])


def test_token_edge_cases(frame, vocabulary):
    rows = [doc(1, None), doc(2, ""), doc(3, "a b"), doc(3, "a b"), doc(None, "a b"), doc(4, "word " * 60_000), doc(5, "\n")]
    found = [(r["doc_id"], r["section"], r["n_tokens"]) for r in K.line_tokens(frame(rows, DOCS), vocabulary).collect()]
    assert (1, 0, 0) in found and (2, 0, 0) in found and found.count((3, 0, 2)) == 2 and (None, 0, 2) in found
    assert (5, 0, 1) in found and len(found) == 7
    assert K.line_tokens(frame([], DOCS), vocabulary).count() == 0
    with pytest.raises(ValueError, match="rule"):
        K.line_tokens(frame([], DOCS), vocabulary, "middle")


def test_fields_share_one_encoding(frame, vocabulary):
    rows = frame([("a title", None, "the body\nof it"), (None, None, None)], "title string, note string, body string")
    encoding, _ = vocabulary.encoder()
    found = [r["tokens"] for r in K.field_tokens(rows, ["title", "note", "body"], vocabulary).collect()]
    assert found[0]["total"] == len(encoding.encode_ordinary("a title\n\nthe body\nof it"))
    assert found[0]["title"] + found[0]["note"] + found[0]["body"] == found[0]["total"]
    assert found[1]["total"] == len(encoding.encode_ordinary("\n\n"))


# Licenses


def test_bands_collide_with_high_probability():
    for t in C.templates():
        whole, both = len(t.shingles), 2 * len(t.words) - t.width + 1
        assert 1 - (1 - whole / both) ** C.BANDS > 0.9999, t.name


def test_licenses_in_whole_texts(frame):
    mit = C.TEMPLATES["MIT-permission"]
    changed = mit.replace("software", "product", 1)
    rows = [
        doc(1, "x " * 50_000 + C.TEMPLATES["GPL-3.0"] + "." + " y" * 3), doc(2, "ALL RIGHTS, reserved!"), doc(3, None), doc(4, ""),
        doc(5, "licensed under the apache"), doc(6, "a b c " + mit), doc(6, "a b c " + mit), doc(None, C.TEMPLATES["MIT"]),
        doc(7, changed), doc(8, "Licensed under CC BY-SA 4.0. Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."),
        doc(9, " ".join(f"w{i}" for i in range(500))),
    ]
    df = C.licenses(frame(rows, DOCS))
    found = {(r["doc_id"], r["license"]): r for r in df.collect()}
    assert set(found) == {
        (1, "GPL-3.0"), (2, "reserved"), (6, "MIT-permission"), (None, "MIT"), (8, "CC-BY-SA-4.0"), (8, "CC-BY-NC-4.0"),
    }
    assert found[1, "GPL-3.0"]["first_word"] >= 49_980 and found[6, "MIT-permission"]["containment"] == 1.0
    lower = C.licenses(frame(rows, DOCS), containment=0.6)
    assert any(r["doc_id"] == 7 and r["license"] == "MIT-permission" for r in lower.collect())
    assert C.licenses(frame([], DOCS)).count() == 0
    text = df._jdf.queryExecution().executedPlan().toString()
    assert not any(word in text for word in ("Python", "Pandas", "Arrow"))


def test_containment_matches_plain_windows(frame):
    draw = random.Random(8)
    wanted = {"short": "alpha beta gamma", "long": " ".join(f"t{i}" for i in range(12))}
    texts = []
    for _ in range(60):
        words = [f"w{draw.randrange(30)}" for _ in range(draw.randrange(40))]
        for _ in range(draw.randrange(3)):
            part = wanted[draw.choice(list(wanted))].split()
            if draw.random() < 0.5:
                part[draw.randrange(len(part))] = "odd"
            at = draw.randrange(len(words) + 1)
            words[at:at] = part
        texts.append(" ".join(words))
    expected = set()
    for i, text in enumerate(texts):
        words = text.split()
        for t in C.templates(wanted):
            size = len(t.words)
            for first in range(0, max(1, len(words)), size):
                own = words[first : first + 2 * size]
                grams = {" ".join(own[k : k + t.width]) for k in range(len(own) - t.width + 1)}
                if len(grams & set(t.shingles)) / len(t.shingles) >= 0.5:
                    expected.add((i, t.name))
    found = C.licenses(frame([doc(i, t) for i, t in enumerate(texts)], DOCS), wanted, containment=0.5).collect()
    assert {(r["doc_id"], r["license"]) for r in found} == expected and len(expected) > 20


# Passages


def plain_members(texts):
    """Documents with a line that is similar to one of another document, by all pairs of lines."""
    lines = []
    for i, text in texts.items():
        for line in (text or "").split("\n"):
            words = line.lower().split()
            grams = {" ".join(words[k : k + 5]) for k in range(len(words) - 4)}
            if len(words) >= D.MIN_WORDS and len(grams) >= D.MIN_DIFFERENT:
                lines.append((i, grams))
    return {
        i for i, a in lines if any(j != i and len(a & b) >= 0.8 * len(a | b) for j, b in lines)
    }


def words(draw, n):
    return [f"w{draw.randrange(5000)}" for _ in range(n)]


def test_similar_lines_match_all_pairs(frame, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 3)
    draw = random.Random(6)
    texts = {}
    for group in range(25):
        line = words(draw, draw.randrange(26, 44))
        for _ in range(draw.randrange(1, 5)):
            own = list(line)
            if draw.random() < 0.6:
                own[draw.choice((0, 1, -1, len(own) // 2))] = "changed"
            texts[len(texts)] = " ".join(words(draw, 9)) + "\n" + " ".join(own) + "\n" + " ".join(words(draw, 28))
    found = {r["doc_id"] for r in D.repeated(frame([doc(i, t) for i, t in texts.items()], DOCS)).collect()}
    assert found == plain_members(texts) and 10 < len(found) < len(texts)


def test_passages_inside_long_lines_are_found_and_clean_documents_left(frame):
    draw = random.Random(7)
    rows, planted = [], {}
    for i in range(60):
        line = words(draw, draw.randrange(60, 300))
        if i % 3 == 0:
            passage = words(random.Random(i % 4), 51)
            at = draw.randrange(len(line))
            planted[i] = (at, at + 51)
            line[at:at] = passage
        rows.append(doc(i, " ".join(line)))
    found = {r["doc_id"]: r for r in D.repeated(frame(rows, DOCS)).collect()}
    assert set(found) == set(planted)
    for i, (first, behind) in planted.items():
        spans = found[i]["repeated"]
        assert all(first <= s["first_word"] and s["behind"] <= behind for s in spans)
        assert found[i]["n_words"] >= 20 and (found[i]["n_removed"] == 0) == (i < 12 and i == min(j for j in planted if j % 4 == i % 4))


def test_planted_passages_are_covered_whole(frame):
    draw = random.Random(17)
    wide = lambda n: [f"v{draw.randrange(10**9)}" for _ in range(n)]
    rows, planted = [], {}
    for group in range(12):
        passage = wide(draw.choice((45, 51, 60, 120)))
        for _ in range(3):
            before = wide(draw.randrange(40, 200))
            planted[len(rows)] = (group, len(before), len(before) + len(passage))
            rows.append(doc(len(rows), " ".join(before + passage + wide(50))))
    found = {r["doc_id"]: r for r in D.repeated(frame(rows, DOCS)).collect()}
    assert set(found) == set(planted)
    for i, (group, first, behind) in planted.items():
        assert [tuple(s) for s in found[i]["repeated"]] == [(first, behind)]
        gone = [] if i == 3 * group else [(first, behind)]
        assert [tuple(s) for s in found[i]["removed"]] == gone


def test_short_lines_wrapped_paragraphs_and_monotonous_lines_count(frame):
    draw = random.Random(19)
    wide = lambda n: [f"v{draw.randrange(10**9)}" for _ in range(n)]
    wrap = lambda words, n: "\n".join(" ".join(words[k : k + n]) for k in range(0, len(words), n))
    short, few, paragraph = wide(18), wide(6), wide(120)
    near = [f"{w}x" if k % 61 == 20 else w for k, w in enumerate(paragraph)]
    changed = [*short[:17], "other"]
    texts = [
        wide(40), short, wide(30), short, wide(30), changed, few, few, wrap(paragraph, 13), wrap(near, 11),
        ["ha"] * 30, ["ha"] * 30, ["ha"] * 31, wide(4), [],
    ]
    rows = []
    for i, body in enumerate(texts):
        own = body if isinstance(body, str) else " ".join(body)
        rows.append(doc(i, " ".join(wide(30)) + "\n" + own + "\n" + " ".join(wide(30))))
    found = {r["doc_id"]: r for r in D.repeated(frame(rows, DOCS), short_lines=True).collect()}
    assert set(found) == {1, 3, 5, 6, 7, 8, 9, 10, 11}
    spans = {i: [tuple(s) for s in found[i]["short_lines" if i < 8 else "repeated"]] for i in (1, 5, 6, 9, 10)}
    assert spans == {i: [(30, 30 + n)] for i, n in ((1, 18), (5, 18), (6, 6), (9, 120), (10, 30))}
    assert [found[i]["n_removed"] for i in (8, 9, 10, 11)] == [0, 120, 0, 30]
    assert [(found[i]["n_short"], found[i]["n_words"], found[i]["first_doc"]) for i in (3, 7)] == [(18, 0, None), (6, 0, None)]
    passages = {r["doc_id"]: r for r in D.repeated(frame(rows, DOCS)).collect()}
    assert passages == {i: found[i] for i in (8, 9, 10, 11)}


def test_a_longer_match_with_a_later_document_is_covered_too(frame):
    draw = random.Random(18)
    wide = lambda n: [f"v{draw.randrange(10**9)}" for _ in range(n)]
    passage = wide(60)
    texts = [wide(30) + passage[:46] + wide(30), wide(40) + passage + wide(40), wide(50) + passage + wide(50)]
    found = {r["doc_id"]: r for r in D.repeated(frame([doc(i, " ".join(t)) for i, t in enumerate(texts)], DOCS)).collect()}
    spans = {i: ([tuple(s) for s in r["repeated"]], [tuple(s) for s in r["removed"]]) for i, r in found.items()}
    assert spans[0] == ([(30, 76)], []) and spans[1] == ([(40, 100)], [(40, 86)])
    assert spans[2] == ([(50, 110)], [(50, 110)])


def test_hashes_of_words_know_words_and_lines(monkeypatch):
    draw = random.Random(21)
    parts = ["a", "b", "ab", "ba", "é", "日本", "A", "x" * 39, "x" * 40, "x" * 41, "y" * 130]
    known = {}
    for size in (D.CHUNK, 40):
        monkeypatch.setattr(D, "CHUNK", size)
        for _ in range(300):
            text = "".join(draw.choice(parts) + draw.choice([" ", "\n", "\n\n", "\t", " \r\n", "\x0b", ""]) for _ in range(12))
            own = text.encode().lower()
            hashes, in_lines = D.words_of(text)
            assert in_lines == [len(line.split()) for line in own.split(b"\n")]
            assert len(hashes) == len(own.split())
            for word, found in zip(own.split(), hashes.tolist(), strict=True):
                assert known.setdefault((size, word), found) == found
    assert len(set(known.values())) == len({(size if len(word) >= 40 else 0, word) for size, word in known})
    assert D.words_of("")[1] == [0] and len(D.words_of(" \n ")[0]) == 0


def plain_extensions(texts, seeds):
    """Spans beside windows, by comparing every occurrence of a window with every other."""
    out = set()
    for content, i, at, left, right in seeds:
        own = texts[i].split()
        for is_left, most in ((True, left), (False, right)):
            best = {}
            for n in range(1, most + 1):
                begin = at - n if is_left else at + D.WINDOW
                if begin < 0 or begin + n > len(own):
                    break
                alike = []
                for other, j, place, *_ in seeds:
                    words = texts[j].split()
                    first = place - n if is_left else place + D.WINDOW
                    if other == content and 0 <= first <= len(words) - n and words[first : first + n] == own[begin : begin + n]:
                        alike.append((j, place))
                if len({j for j, _ in alike}) > 1:
                    best[min(alike) == (i, at)] = (begin, n)
            out |= {(i, *span, kept) for kept, span in best.items()}
    return out


def test_extensions_match_all_pairs_of_occurrences(frame):
    draw = random.Random(20)
    passages = [[f"p{k}w{n}" for n in range(D.WINDOW + 12)] for k in range(4)]
    texts, seeds = [], []
    for i in range(40):
        body, places = [], []
        for k in draw.sample(range(4), draw.randrange(1, 4)):
            cut, end = draw.randrange(7), draw.randrange(7)
            body += [f"u{draw.randrange(3)}" for _ in range(draw.randrange(8))]
            places.append((k, len(body) + 6 - cut))
            body += passages[k][cut : len(passages[k]) - end]
        texts.append(" ".join(body))
        seeds += [(k, i, at) for k, at in places]
    contents = [int(D._mixed(D.hashes_of(" ".join(p[6 : 6 + D.WINDOW]))[None, :])[0]) for p in passages]
    wanted = [(contents[k], i, at, 3 + 5 * k, 2 + 7 * k) for k, i, at in seeds]
    rows = frame(wanted, "component long, doc_id long, first_word int, left int, right int")
    docs = frame([doc(i, t) for i, t in enumerate(texts)], DOCS)
    found = D.extensions(rows, docs, D.Scratch(docs.sparkSession)).collect()
    assert {(r["doc_id"], r["first_word"], r["n_words"], r["kept"]) for r in found} == plain_extensions(texts, wanted)


def test_units_of_a_text_cover_every_passage():
    draw = random.Random(9)
    for _ in range(200):
        passage = words(draw, D.MIN_PASSAGE)
        sides = [words(draw, draw.randrange(30)) for _ in range(4)]
        a = {u[0] for u in D.units_of(" ".join(sides[0] + passage + sides[1] + ["end"]))}
        b = {u[0] for u in D.units_of(" ".join(["start"] + sides[2] + passage + sides[3]))}
        assert a & b
    assert D.recall_at(0.8) > 0.999


def test_passage_edge_cases(frame):
    draw = random.Random(1)
    line = " ".join(words(draw, 60))
    rows = [
        doc(1, None), doc(2, ""), doc(3, line), doc(3, line), doc(None, line), doc(4, "the " * 400), doc(5, "the " * 300),
        doc(6, line.upper() + "\n" + " ".join(words(draw, 30_000))), doc(7, " ".join(words(draw, 40))),
    ]
    found = {r["doc_id"]: r for r in D.repeated(frame(rows, DOCS)).collect()}
    assert set(found) == {3, 6} and found[3]["n_removed"] == 0 and found[6]["n_removed"] == 60
    assert found[6]["first_doc"] == 3
    assert D.repeated(frame([], DOCS)).count() == 0
    assert D.repeated(frame([doc(1, line), doc(1, line)], DOCS)).count() == 0


def test_blocks_are_linked_like_all_pairs():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1000, 40)
    held = []
    for k in range(30):
        own = base.copy()
        own[: k % 7] += 5000 + 100 * k
        held.append((k, k % 2 == 0, False, own))
    links = D.tile_links(held, 0.8)
    sets = [set(h[3].tolist()) for h in held]
    pairs = [
        (i, j) for i in range(0, 30, 2) for j in range(1, 30, 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    ]
    from tidewatch.llm.simhash import roots_of

    a, b = np.array(pairs).T
    c, d = np.array(links).T
    assert roots_of(a, b, 30).tolist() == roots_of(c, d, 30).tolist()


def test_units_of_texts_together_are_those_of_each():
    rng = random.Random(11)
    texts = ["", " \n", "a b", "a b c d e", "Ä é\x0b" * 50, "y" * 70_000 + " z" * 30, "x " * 40_000, "\n".join(["a b c d"] * 9)]
    lines = lambda: [" ".join(rng.choices("ABcdefghijkl", k=rng.randrange(60))) for _ in range(rng.randrange(9))]
    texts += ["\n".join(lines()) for _ in range(200)]
    rows = []
    groups = list(D._groups(pa.array(texts)))
    assert [row for own, _ in groups for row in own] == list(range(len(texts)))
    assert len(groups) < 10  # few calls for many texts
    for own, held in groups:
        if sum(map(len, held)) + len(held) > D.CHUNK:
            assert len(held) == 1
            continue
        found, windows = D.units_together(held)
        rows += [(own[i], content, first, n, list(bands)) for i, content, first, n, bands in found]
        rows += [(own[i], content, first, D.WINDOW, None) for i, content, first in zip(*(x.tolist() for x in windows), strict=True)]
    plain = [(i, c, f, n, None if b is None else list(b)) for i, t in enumerate(texts) if len(t) < 60_000 for c, f, n, b in D.units_of(t)]
    assert len(plain) > 1000
    assert sorted(map(repr, rows)) == sorted(map(repr, plain))
