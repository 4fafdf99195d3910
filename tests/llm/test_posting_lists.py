"""Nearest neighbours against comparing all: recall where vectors have no structure, and equal results where lists hold all."""

import numpy as np

from foldloom.llm import posting_lists as lists
from foldloom.llm import queries as q

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"


def brute(rows, k=20):
    """{query: [(rank, id, score)]} of rows (id, vector) whose id 20 divides."""
    rows = sorted({(i, tuple(np.float32(v).item() for v in x)) for i, x in rows})
    ids, x = np.array([i for i, _ in rows]), np.array([x for _, x in rows], dtype=float)
    out = {}
    for i, v in rows:
        if i % 20 == 0 and i not in out:  # the smallest vector of a key
            s = (x * np.array(v)).sum(axis=1)
            out[i] = [(n, int(ids[j]), s[j]) for n, j in enumerate([j for j in np.lexsort((ids, -s)) if ids[j] != i][:k], 1)]
    return out


def found(df, **k):
    out = {}
    for r in lists.nearest(df, df.where("vec_id % 20 = 0"), **k).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {i: sorted(v) for i, v in out.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(a) for a in x], 0, "a", "b") for i, x in rows], SCHEMA)


def same(got, want):
    assert got.keys() == want.keys()
    for i in want:
        assert [x[:2] for x in got[i]] == [x[:2] for x in want[i]]
        np.testing.assert_allclose([x[2] for x in got[i]], [x[2] for x in want[i]], rtol=0, atol=1e-9 * max(1, *[abs(x[2]) for x in want[i]], 0) if want[i] else 0)


def test_op12(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = {}
    for r in q.op12_nearest_neighbours(spark, small).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    same({i: sorted(v) for i, v in got.items()}, brute(rows))  # one list holds so few rows


def test_recall_over_many_lists(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(4000, 32)) * draw.uniform(0.5, 2, size=(4000, 1))  # lengths differ, as inner products allow
    x[:800] = x[0] + 0.01 * draw.normal(size=(800, 32))  # near copies
    rows = list(enumerate(x))
    got, want = found(frame(spark, rows), list_rows=100), brute(rows)
    assert all([n for n, *_ in v] == list(range(1, 21)) for v in got.values()) and got.keys() == want.keys()
    hits = [len({k for _, k, _ in got[i]} & {k for _, k, _ in want[i]}) / 20 for i in want]
    assert np.mean(hits) >= 0.9


def test_copies_ties_and_rows_that_take_no_part(spark):
    draw = np.random.default_rng(2)
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(300)] + [(1000 + i, list(draw.integers(-2, 3, 3))) for i in range(200)] + [(-20, [3.0, 1.0, 2.0]), (-40, [1e30, 1.0, 0.0])] * 2
    rows = [(i, x) for i, x in rows if any(x)]
    odd = [(None, [1.0, 1.0, 1.0]), (2000, None), (2020, [0.0, -0.0, 0.0]), (2040, [float("nan"), 1.0, 1.0]), (2060, [None, 1.0, 1.0]), (2080, [float("inf"), 1.0, 1.0]), (2100, [1.0, 1.0]), (2120, [])]
    df = frame(spark, rows).union(spark.createDataFrame([(i, x, 0, "", "") for i, x in odd], SCHEMA))
    same(found(df), brute(rows))
    same(found(df.where("vec_id < 3"), k=20), brute([r for r in rows if r[0] < 3]))  # fewer candidates than ranks
    two = [(20, [1.0, 0.0]), (20, [0.5, 0.0]), (1, [1.0, 1.0])]
    same(found(frame(spark, two)), {20: [(1, 1, 0.5)]})
    assert found(frame(spark, two).limit(0)) == {} and found(frame(spark, [(20, [1.0, 2.0])])) == {}


def test_groups_are_cut_into_blocks(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows = list(enumerate(draw.normal(size=(500, 8))))
    monkeypatch.setattr(lists, "MEMBERS", 37)
    monkeypatch.setattr(lists, "QUERIES", 5)
    same(found(frame(spark, rows)), brute(rows))


def test_walk_meets_what_comparing_all_does():
    draw = np.random.default_rng(4)
    points = draw.normal(size=(3000, 16))
    centroids = lists.halved(points, 256)
    index = lists.Index(centroids, lists.linked(centroids), np.arange(0, 256, 16), 1.0, points[:0], np.zeros((0, 4), dtype=int), 1.15)
    d = lists.walked(points[:200], index, index.ratio)
    all_ = np.sqrt(((points[:200, None] - centroids) ** 2).sum(axis=2))
    inside = all_ <= index.ratio * all_.min(axis=1, keepdims=True)
    assert np.isfinite(d[inside]).mean() > 0.99 and np.allclose(d[np.isfinite(d)], all_[np.isfinite(d)])
    sizes = np.bincount(all_.argmin(axis=1), minlength=256)
    assert sizes.max() < 20
    assert len(lists.halved(np.ones((50, 3)), 8)) == 1  # equal points stay together


def test_floors_are_reached():
    draw = np.random.default_rng(6)
    x, q = draw.normal(size=(500, 8)), draw.normal(size=(30, 8))
    index = lists.fitted(x[::5], float(np.sqrt((x * x).sum(axis=1).max())), 4)
    row, of = lists.lists_for(lists.aimed(q, index.longest), index)
    floor = lists.floors(q, row, of, index, 15)
    at, list_ = lists.lists_of(lists.placed(x, index.longest), index)
    for n in range(len(q)):
        met = np.unique(at[np.isin(list_, of[row == n])])
        assert (x[met] @ q[n] >= floor[n]).sum() >= 15
    assert np.isfinite(floor).any() and (lists.floors(q, row, of, index, 97) == -np.inf).all()
