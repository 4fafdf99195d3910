"""Posting lists in blocks against plain sets."""

import random
from itertools import combinations

import pytest

from foldloom.operators import graphs, postings


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    own = [(n, "hot") for n in range(1000)] + [(draw.randrange(1000), f"t{draw.randrange(60)}") for _ in range(900)] + [(n * 37, "wide") for n in range(27)]
    return own + own[:400] + [(None, "hot"), (3, None)]


def terms(rows):
    out = {}
    for n, t in rows:
        if n is not None and t is not None:
            out.setdefault(t, set()).add(n)
    return out


@pytest.mark.parametrize("size", [1, 16, 1024])
def test_blocks_hold_each_node_once_in_order(spark, rows, size):
    got, want = {}, terms(rows)
    for r in postings.blocks(spark.createDataFrame(rows, "node int, term string"), size).orderBy("term", "block").collect():
        assert 0 < len(r["nodes"]) <= size and r["total"] == len(want[r["term"]])
        got.setdefault(r["term"], []).extend(r["nodes"])
    assert got == {t: sorted(n) for t, n in want.items()}


@pytest.mark.parametrize(("size", "broadest"), [(16, 40), (16, 16), (64, 40), (1, 5)])
def test_pairs_are_those_of_shared_terms(spark, rows, size, broadest):
    own = spark.createDataFrame(rows, "node int, term string")
    got = [tuple(r) for r in postings.pairs(postings.blocks(own, size), broadest, size).collect()]
    want = {p for n in terms(rows).values() if len(n) <= broadest for p in combinations(sorted(n), 2)}
    assert len(got) == len(set(got)) and set(got) == want
    assert {tuple(r) for r in graphs.shared_terms(own, broadest).where("src < dst").collect()} == want


def test_one_block_lists_need_no_join(spark, rows):
    lists = postings.blocks(spark.createDataFrame(rows, "node int, term string"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert plan(postings.pairs(lists, 100)) == plan(lists)


def test_breadth_and_no_rows(spark, rows):
    own = postings.breadth(postings.blocks(spark.createDataFrame(rows, "node int, term string"), 16)).where("term = 'hot'").first()
    assert (own["n_genes"], own["n_blocks"]) == (1000, 63)
    none = postings.blocks(spark.createDataFrame([], "node int, term string"))
    assert none.collect() == postings.pairs(none, 100).collect() == []
