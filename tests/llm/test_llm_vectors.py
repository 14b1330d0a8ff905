from __future__ import annotations

import numpy as np
import pytest

from tidewatch.llm import permutation_index as I
from tidewatch.llm import projection_dedup as P

VECTORS = "vec_id long, embedding array<float>, label int, node string, cell string, shard string"


def row(i, vector, label):
    return (i, None if vector is None else [None if x is None else float(x) for x in vector], label, "x", "x", "x")


def plain_links(rows):
    """n_links and component of every row, by all pairs."""
    def unit(v):
        v = np.array(v, dtype=np.float32).astype(float)
        return v / np.sqrt((v * v).sum())

    units = {}
    for k, (i, v, label, *_) in enumerate(rows):
        if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            units[k] = unit(v)
    near = {
        k: [
            m for m in units
            if m != k and rows[m][2] == rows[k][2] and len(units[m]) == len(units[k]) and units[m] @ units[k] >= 0.98
        ]
        for k in units
    }
    out = []
    for k, r in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in near.get(todo.pop(), []):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        component = min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)
        out.append((r[0], len(near.get(k, [])), component, component is None or component == r[0]))
    return sorted(out, key=str)


def clusters(many, dim, noise, seed=0):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(many):
        centre = draw.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        for _ in range(int(draw.integers(1, 6))):
            rows.append(row(len(rows) * 3 + 1, centre + noise * draw.standard_normal(dim) / np.sqrt(dim), i % 3))
    return rows


@pytest.mark.parametrize(("noise", "block"), [(0.1, 1024), (0.17, 16), (0.15, 5)])
def test_links_match_all_pairs(frame, monkeypatch, many_partitions, noise, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rows = clusters(60, 24, noise)
    found = P.near_duplicates(frame(rows, VECTORS)).collect()
    assert sorted(map(tuple, found), key=str) == plain_links(rows)


def test_odd_vectors_and_repeated_rows(frame):
    nan, inf = float("nan"), float("inf")
    rows = [
        row(1, [1, 0, 0], 1), row(2, [2, 0, 0], 1), row(3, [1, 0, 0], 2), row(4, [1, 0, 0], None), row(5, None, 1),
        row(6, [0, 0, 0], 1), row(7, [nan, 0, 1], 1), row(8, [inf, 0, 0], 1), row(9, [None, 1, 0], 1), row(10, [], 1),
        row(11, [1, 0], 1), row(None, [1, 0, 0], 1), row(12, [1, 0, 0], 1), row(2, [2, 0, 0], 1), row(13, [-1, 0, 0], 1),
    ]
    found = P.near_duplicates(frame(rows, VECTORS)).collect()
    assert sorted(map(tuple, found), key=str) == plain_links(rows)
    assert P.near_duplicates(frame([], VECTORS)).count() == 0


def test_many_copies_are_one_class(frame):
    rows = [row(i, [1, 2, 3], 1) for i in range(300)] + [row(1000, [1, 2, 3.05], 1), row(1001, [3, -2, 1], 1)]
    found = {r["vec_id"]: r for r in P.near_duplicates(frame(rows, VECTORS)).collect()}
    assert found[7]["n_links"] == 300 and found[1000]["n_links"] == 300 and found[1001]["n_links"] == 0
    assert found[1000]["component_id"] == 0 and sum(r["kept"] for r in found.values()) == 2


def test_the_count_is_calibrated():
    least = P.calibrated_count()
    draw = np.random.default_rng(1)
    distance = np.sqrt(2 - 2 * 0.98)
    hits = (np.abs(draw.standard_normal((200_000, P.DIRECTIONS)) * distance) <= P.SIGMAS * distance).sum(axis=1)
    assert (hits >= least).mean() >= 0.9998
    assert (hits >= least + 4).mean() < 0.9998


def test_neighbours_reach_the_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = rows.toPandas()
    vectors = np.array(table["embedding"].tolist(), dtype=float)
    ids = table["vec_id"].to_numpy()
    found = {}
    for r in I.nearest(rows, rows["vec_id"] % 20 == 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == sorted(ids[ids % 20 == 0].tolist())
    hits = 0
    for query, answers in found.items():
        exact = (vectors * vectors[ids == query]).sum(axis=1)
        exact[ids == query] = -np.inf
        best = ids[np.lexsort((ids, -exact))[:20]]
        answers.sort()
        assert [a[0] for a in answers] == list(range(1, 21))
        assert [(-s, i) for _, i, s in answers] == sorted((-s, i) for _, i, s in answers)
        assert all(exact[ids == i][0] == pytest.approx(s, abs=1e-12) for _, i, s in answers)
        hits += len(set(best) & {i for _, i, _ in answers})
    assert hits / (20 * len(found)) >= 0.9


@pytest.fixture
def many_partitions(spark):
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_recall_of_several_shards_and_lengths(frame, monkeypatch, many_partitions):
    monkeypatch.setattr(I, "SHARD", 300)
    monkeypatch.setattr(I, "QUERY_BLOCK", 16)
    draw = np.random.default_rng(2)
    vectors = draw.standard_normal((1500, 16)) * draw.uniform(0.5, 2, (1500, 1))
    df = frame([row(i, v, 0) for i, v in enumerate(vectors)], VECTORS)
    vectors = vectors.astype(np.float32).astype(float)
    found = I.nearest(df, df["vec_id"] % 20 == 0, k=5, pivots=64, represent=32).collect()
    hits = 0
    for q in range(0, 1500, 20):
        scores = (vectors * vectors[q]).sum(axis=1)
        scores[q] = -np.inf
        own = [r["vec_id"] for r in found if r["query_id"] == q]
        assert len(own) == 5
        hits += len(set(own) & set(np.argsort(-scores)[:5].tolist()))
    assert hits / (5 * 75) >= 0.9


def test_a_third_of_equal_rows_hides_no_neighbour(frame, monkeypatch):
    monkeypatch.setattr(I, "SHARD", 300)
    draw = np.random.default_rng(4)
    vectors = draw.standard_normal((900, 16))
    vectors[draw.permutation(900)[:300]] = vectors[0]
    vectors = vectors.astype(np.float32).astype(float)
    df = frame([row(i, v, 0) for i, v in enumerate(vectors)], VECTORS)
    found = {}
    for r in I.nearest(df, df["vec_id"] % 20 == 0, k=5, pivots=64, represent=32).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    hits = 0
    for q in range(0, 900, 20):
        scores = (vectors * vectors[q]).sum(axis=1)
        scores[q] = -np.inf
        best = np.lexsort((np.arange(900), -scores))[:5].tolist()
        own = [i for _, i in sorted(found[q])]
        if (vectors[q] == vectors[0]).all():
            assert own == best
        hits += len(set(own) & set(best))
    assert hits / (5 * 45) >= 0.9


def test_neighbours_edge_cases(frame):
    nan = float("nan")
    rows = [
        row(20, [1, 0], 0), row(1, [1, 0], 0), row(2, [1, 0], 0), row(2, [1, 0], 0), row(3, [0, 1], 0), row(4, None, 0),
        row(5, [0, 0], 0), row(6, [nan, 1], 0), row(None, [9, 9], 0), row(40, None, 0), row(7, [2], 0), row(8, [None, 1], 0),
    ]
    df = frame(rows, VECTORS)
    found = [tuple(r) for r in I.nearest(df, df["vec_id"] % 20 == 0).orderBy("query_id", "rank").collect()]
    assert found == [(20, 1, 7, 2.0), (20, 2, 1, 1.0), (20, 3, 2, 1.0), (20, 4, 3, 0.0)]
    none = frame([], VECTORS)
    assert I.nearest(none, none["vec_id"] % 20 == 0).count() == 0
    no_query = frame(rows[1:3], VECTORS)
    assert I.nearest(no_query, no_query["vec_id"] % 20 == 0).count() == 0


def test_equal_vectors_are_sought_once_for_count_pivots_and_index(frame):
    draw = np.random.default_rng(6)
    df = frame([row(i, draw.standard_normal(4), 0) for i in range(60)], VECTORS)
    found = I.nearest(df, df["vec_id"] % 20 == 0, k=3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1  # the rank; what led to the entries is written already
    assert len(found.collect()) == 9


@pytest.mark.parametrize("pivots, represent", [(40, 12), (300, 280)])
def test_files_give_the_footrule_distance(pivots, represent):
    draw = np.random.default_rng(7)
    vectors = draw.standard_normal((200, 6))
    longest = np.sqrt((vectors * vectors).sum(axis=1).max())
    chosen = np.hstack([draw.standard_normal((pivots, 6)), np.zeros((pivots, 1))])
    files = I.InvertedFiles(vectors, chosen, longest, represent)
    assert files.files.shape == (pivots, 200)
    added = np.sqrt(np.maximum(longest**2 - (vectors * vectors).sum(axis=1), 0.0))
    orders = files.orders(np.hstack([vectors, added[:, None]]))

    def places(order):
        out = np.full(pivots, represent)
        out[order] = np.arange(represent)
        return out

    far = np.array([[np.abs(places(a) - places(b)).sum() for b in orders] for a in orders[:20]])
    for order, distance in zip(orders, far, strict=False):
        assert files.by_footrule(order, 50).tolist() == np.flatnonzero(distance <= np.sort(distance)[49]).tolist()
        assert files.by_footrule(order, 200).tolist() == list(range(200))


def test_the_best_are_judged_by_their_own_products():
    """Products that differ by rounding only, and equal ones, which go by id."""
    draw = np.random.default_rng(8)
    vectors = np.repeat(draw.standard_normal((30, 64)), 4, axis=0)
    vectors[::2] = np.nextafter(vectors[::2], 9)
    ids = draw.permutation(120)
    longest = np.sqrt((vectors * vectors).sum(axis=1).max())
    files = I.InvertedFiles(vectors, np.hstack([vectors[:8], np.zeros((8, 1))]), longest, 8)
    some = np.sort(draw.permutation(120)[:100])
    for query in vectors[:20]:
        scores = (vectors[some] * query).sum(axis=1)
        want = np.lexsort((ids[some], -scores))[:7]
        best, found = files.best_of(some, ids, query, longest, 7)
        assert best.tolist() == some[want].tolist()
        assert found.tolist() == scores[want].tolist()
