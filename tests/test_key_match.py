"""Proposals for keys that do not match."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tidewatch.operators import key_match


def plain(key: str) -> str:
    return re.sub(r"[\W_]", "", key.lower())


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def brute_force(left: set[str], right: set[str]) -> set[tuple]:
    out = set()
    for side, own, others in (("left", left, right), ("right", right, left)):
        for key in own - others:
            near = []
            for other in others:
                a, b = plain(key), plain(other)
                if a and b and edits(a, b) <= min(key_match.MAX_DISTANCE, len(b) // key_match.LETTERS):
                    near.append((edits(a, b), other))
            best = min(near, default=(None, None))
            out.add((side, key, best[1], best[0], sum(d == best[0] for d, _ in near)))
    return out


def suggested(frame, left, right):
    a, b = (frame([(k,) for k in keys], "k string") for keys in (left, right))
    return key_match.key_suggestions([("p", a, F.col("k"), b, F.col("k"))])


def rows_of(found) -> list[tuple]:
    return [tuple(r) for r in found.select("side", "key", "suggestion", "distance", "n_nearest").collect()]


def test_planted_spellings_are_proposed(frame):
    left = ["Seocho-gu", "Yeongdeungpo gu", "Jung", "Gangnam-gu", "Gangnam-gu", None, "--"]
    right = ["SEOCHO GU", "Yeongdungpo-gu", "Jong", "Gangnam-gu", None, "Elsewhere"]
    assert sorted(rows_of(suggested(frame, left, right)), key=str) == sorted(
        [
            ("left", "Seocho-gu", "SEOCHO GU", 0, 1), ("left", "Yeongdeungpo gu", "Yeongdungpo-gu", 1, 1),
            ("left", "Jung", "Jong", 1, 1), ("left", "--", None, None, 0), ("right", "SEOCHO GU", "Seocho-gu", 0, 1),
            ("right", "Yeongdungpo-gu", "Yeongdeungpo gu", 1, 1), ("right", "Jong", "Jung", 1, 1),
            ("right", "Elsewhere", None, None, 0),
        ],
        key=str,
    )


def test_random_keys_equal_all_pairs(frame):
    draw = random.Random(3)
    names = ["".join(draw.choices("abc", k=draw.randint(0, 14))) for _ in range(120)]

    def spoiled(name: str) -> str:
        for _ in range(draw.randint(0, 3)):
            at = draw.randint(0, len(name))
            name = draw.choice([name[:at] + name[at + 1 :], name[:at] + draw.choice("abcé _") + name[at:], name.upper()])
        return name

    left, right = names[:90], [spoiled(n) for n in names[30:]]
    found = rows_of(suggested(frame, left, right))
    assert len(found) == len(set(found)) and set(found) == brute_force(set(left), set(right))


def test_empty_sides(frame):
    assert rows_of(suggested(frame, [], [])) == []
    assert rows_of(suggested(frame, ["abcd"], [])) == [("left", "abcd", None, None, 0)]


def test_no_comparison_of_all_pairs(frame):
    plan = suggested(frame, ["abcdef"], ["abcdeg"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_mapping_takes_only_what_is_clear(frame):
    left = ["Mapo gu", "Jongno-guu", "Jongno-gu", "Nowon east", "Nowon eastt", "Dobong ga"]
    right = ["Mapo-gu", "Jongno-gu", "Nowon-east", "Dobong gu", "Dobong go"]
    found = suggested(frame, left, right)
    mapping = key_match.key_mapping(found, "p")
    # A key that is nearer than another takes the proposal; one that has two nearest is left alone.
    assert {tuple(r) for r in mapping.collect()} == {
        ("Mapo gu", "Mapo-gu"), ("Jongno-guu", "Jongno-gu"), ("Nowon east", "Nowon-east"),
    }
    rows = [("Mapo gu", 1), ("Mapo gu", 2), ("Dobong ga", 3), (None, 4)]
    mapped = key_match.with_mapped_key(frame(rows, "area string, `n.x` int"), "area", mapping)
    assert mapped.columns == ["area", "n.x"]
    expected = [("Mapo-gu", 1), ("Mapo-gu", 2), ("Dobong ga", 3), (None, 4)]
    assert sorted(map(tuple, mapped.collect()), key=str) == sorted(expected, key=str)
