import random

import pytest

from foldloom.llm import ngram_join
from foldloom.llm.components import components, extended

from . import brute

SCHEMA = "doc_id long, text string, component_id string, n long"


def dense(seed, copies=60):
    """Near copies with few to many changed words, copies, a common passage, and unlike texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [r.choice(vocabulary) for _ in range(120)]
    passage = " ".join(r.choice(vocabulary) for _ in range(30))
    texts = []
    for i in range(copies):
        own = list(base)
        for _ in range(r.randrange(0, 9)):
            own[r.randrange(len(own))] = r.choice(vocabulary)
        texts.append(" ".join(own))
    texts += [texts[3].upper(), texts[3], texts[3].replace(" ", "\n")]
    texts += [passage + " " + " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 60))) for _ in range(25)]
    texts += ["a b c d e f g h", "a b c d e f g h i", "a b c", "A b c", "a b", "x"]
    r.shuffle(texts)
    return [(i * 3 - 50, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_groups_as_all_pairs(spark, seed):
    rows = dense(seed)
    got = {r["doc_id"]: r for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    sets = {i: brute.shingles(t, 4, True) for i, t in rows}
    want = brute.groups(sets, 85, 100)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert len(set(want.values())) > 20  # not all one group


def test_nulls_empties_repeats_and_clashing_columns(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "x", 1), (1, text, "y", 2), (2, text.upper(), None, None), (3, None, "z", 3), (4, "", "z", 3), (5, " \n", "z", 3), (None, text, "z", 3), (None, None, None, None)]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == [(1, 7, 1, 3), (1, 7, 1, 3), (2, 7, 1, 3), (3, 0, 3, 0), (4, 0, 4, 0), (5, 0, 5, 0)]
    assert sorted((r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None) == [(0, None), (7, None)]


def test_empty_table(spark):
    assert ngram_join.ngram_join(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_very_long_text(spark):
    long = " ".join(str(i) for i in range(60_000))
    rows = [(1, long), (2, long + " and more"), (3, "short")]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def test_more_links_extend_components(spark):
    parts = components(spark.createDataFrame([(1, 2), (3, 4), (10, 11)], "a long, b long"))
    got = {r["node"]: r["component"] for r in extended(parts, spark.createDataFrame([(4, 11), (2, 1), (20, 21), (0, 3)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, **dict.fromkeys((0, 3, 4, 10, 11), 0), 20: 20, 21: 20}


def test_parities_never_overstate(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    for n, m, shared in ((7, 6, 6), (300, 300, 290), (700, 90, 40), (2000, 2100, 1000)):
        x = rng.integers(0, 1 << 64, n + m, dtype=np.uint64)
        a, b = x[:n], np.concatenate([x[:shared], x[n : n + m - shared]])
        bound = ngram_join.least_apart(ngram_join.parities(a), ngram_join.parities(b))
        assert 0 <= bound <= n + m - 2 * shared
    assert ngram_join.least_apart(ngram_join.parities(a), ngram_join.parities(b)) > 600


def test_regular_long_words_are_not_linked(spark):
    a, b = brute.thue_morse(1024), brute.thue_morse(1024, "b", "a")
    rows = [(1, a), (2, b), (3, f"x {a} y {b} z w"), (4, f"x {b} y {a} z w"), (5, a.upper())]
    got = {r["doc_id"]: (r["component_id"], r["n_copies"]) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (3, 1), 4: (4, 1), 5: (1, 2)}


@pytest.mark.parametrize(("bits", "hot"), [(2, 3), (18, 1), (2, 10_000)])
def test_any_order_and_any_crowd_give_the_same_groups(spark, bits, hot):
    rows = dense(7)
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    _, parts, _ = ngram_join.links(docs, 4, 85, 100, sketch_bits=bits, hot=hot)
    sets = {i: brute.shingles(t, 4, True) for i, t in rows}
    want = brute.groups(sets, 85, 100)
    got = {r["node"]: r["component"] for r in parts.collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    assert {i: got.get(first[s], first[s]) if s else i for i, s in sets.items()} == want


def templates(n, seed=5):
    """Texts that share 84 of 100 words' worth of shingles and are similar to no other."""
    r = random.Random(seed)
    common = [f"c{i}" for i in range(300)]
    return [(j, " ".join(common + [f"u{j}x{i}" for i in range(28)])) for j in range(n)]


def joined_rows(monkeypatch, docs, **kw):
    """How many rows the joins of prefixes make, before any filter."""
    counts, pairs = [], ngram_join._pairs
    monkeypatch.setattr(ngram_join, "_pairs", lambda both, num, den: (counts.append(both.count()), pairs(both, num, den))[1])
    _, parts, _ = ngram_join.links(docs, 4, 85, 100, **kw)
    assert parts.count() == 0
    monkeypatch.undo()
    return sum(counts)


def test_templates_just_below_the_bound_are_not_paired(spark, monkeypatch):
    """In an order that is no better than chance, 2 ** 2 counts, members of a family share their prefixes; exact frequencies part them.
    Two sizes: the rows grow with the texts, not with their square."""
    rows = {n: spark.createDataFrame(templates(n), "id long, text string").repartition(4) for n in (500, 2000)}
    got = {n: joined_rows(monkeypatch, docs, sketch_bits=2) for n, docs in rows.items()}
    assert got[2000] <= 4.5 * got[500] and got[2000] < 60 * 2000


def test_pairs_of_classes_and_counts_of_links(spark):
    rows = dense(3, copies=40)
    docs = spark.createDataFrame([*rows, (None, "a b c d"), (900, None)], "doc_id long, text string")
    pairs, members = ngram_join.similar_pairs(docs)
    sets = {i: s for i, t in rows if (s := brute.shingles(t, 4, True))}
    like = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    want = {(i, j) for i in first.values() for j in first.values() if i < j and like(sets[i], sets[j])}
    got = pairs.collect()
    assert len(got) == len(want) > 20 and {(r["a"], r["b"]) for r in got} == want
    assert all((r["n_a"], r["n_b"]) == (len(sets[r["a"]]), len(sets[r["b"]])) for r in got)
    assert {r["doc_id"]: r["class"] for r in members.collect()} == {i: first[s] for i, s in sets.items()}
    links = {r["doc_id"]: r["n_links"] for r in ngram_join.link_counts(docs).collect()}
    assert links == {i: sum(j != i and like(sets[i], sets[j]) for j in sets) for i in sets}
