import math

import numpy as np
import pytest

from tessera.llm import ann, embed_dedup

KIND = "vec_id long, embedding array<float>, label int, rank int"
BAD = [None, [], [0.0] * 8, [1.0] * 7 + [None], [1.0] * 7 + [math.nan], [1.0] * 7 + [math.inf]]


def table(spark, vectors, extra=(), kind=KIND):
    rows = [(i, v if v is None else [None if x is None else float(x) for x in v], 0, 9) for i, v in enumerate(vectors)]
    rows += [(1000 + i, v, 0, 9) for i, v in enumerate(BAD)] + list(extra)
    return spark.createDataFrame(rows, kind)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    near = x[:60] + rng.normal(size=(60, 8)).astype(np.float32) * 0.15
    return np.concatenate([x, near, near, np.tile(x[:1], (30, 1))]).astype(np.float64)


def test_nearest(spark, vectors, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_ROWS", 100)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 10)
    docs = table(spark, vectors, [(None, [1.0] * 8, 0, 9), (7, [9.0] * 8, 0, 9)])
    got = ann.nearest(docs, docs.where("vec_id % 20 = 0"), 10).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(by) == list(range(0, len(vectors), 20))
    hits = 0
    for q, found in by.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        hits += len({f[1] for f in found} & set(best.tolist()))
        assert all(abs(d[v] - s) < 1e-12 for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
    assert hits / (10 * len(by)) >= 0.9


def test_few_candidates_and_empty(spark):
    docs = table(spark, [[1.0, 2.0], [2.0, 2.0], [1.0, 5.0], [3.0]])
    got = ann.nearest(docs, docs.where("vec_id = 0 or vec_id = 3")).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 3.0)]
    none = spark.createDataFrame([], KIND)
    assert ann.nearest(none, none).count() == 0 and embed_dedup.near_duplicates(none).count() == 0


def test_near_duplicates(spark, vectors, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CELL_ROWS", 20)
    monkeypatch.setattr(embed_dedup, "MEMBER_BLOCK", 7)
    monkeypatch.setattr(embed_dedup, "VISITOR_BLOCK", 11)
    docs = table(spark, vectors, [(None, [1.0] * 8, 0, 9), (5000, [1.0] * 5, 0, 9), (5001, [2.0] * 5, 0, 9)])
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(docs).collect() if r["vec_id"] is not None}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    found = sum(got[i]["n_links"] for i in range(len(vectors)))
    assert all(got[i]["n_links"] <= links[i].sum() for i in range(len(vectors))) and found >= 0.9 * links.sum()
    assert got[0]["component_id"] == 0 and got[0]["kept"] and not got[len(vectors) - 1]["kept"]
    assert got[len(vectors) - 1]["component_id"] == 0 and got[len(vectors) - 1]["n_links"] >= 30
    for i in range(len(BAD)):
        assert tuple(got[1000 + i])[1:] == (0, 1000 + i, True)
    assert got[5001]["component_id"] == 5000 and got[5001]["n_links"] == 1


def test_nearest_beyond_the_range_of_squares(spark):
    rows = [(100, [1e200, 0.0], 0, 9), (1, [-1e200, 0.0], 0, 9), (2, [1e200, 1e190], 0, 9), (3, [1e-200, 0.0], 0, 9), (200, [3e-200, 0.0], 0, 9)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rank int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(docs, docs.where("vec_id % 100 = 0")).collect()}
    assert len(got) == 8 and got[100, 1] == (2, 1e190) and got[100, 4] == (1, 2e200) and got[100, 2] == (3, 1e200) and got[200, 1] == (3, 2e-200)


def test_repeated_ids_are_different_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0, 0.0]), (3, [0.0, 0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0, 0.1])]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (3, 1, 3, True)]


def test_visits_stay_within_their_bound(monkeypatch):
    monkeypatch.setattr(embed_dedup, "MAX_VISITS", 9)
    x = embed_dedup.unit_rows(np.random.default_rng(0).normal(size=(600, 32)))
    grid = embed_dedup.fit_grid(x, 100000, 0.9)
    assert 1 <= grid.visits <= 9
