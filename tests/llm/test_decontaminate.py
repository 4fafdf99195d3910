import random

import pytest

from foldloom.llm import decontaminate as d

from . import brute


def rows(seed=3):
    r = random.Random(seed)
    word = lambda: f"v{r.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(r.randrange(0, 40)))) for i in range(20)] + [(20, None), (None, "a b c d e f"), (3, "again an item with the same number of its own")]
    docs = []
    for i in range(80):
        body = [word() for _ in range(r.randrange(0, 200))]
        if i % 3 == 0:
            own = (r.choice(items)[1] or "").split()
            for _ in range(r.randrange(0, 3)):
                if own:
                    own[r.randrange(len(own))] = "changed"
            body[5:5] = own
        docs.append((i, " ".join(body)))
    return docs + [(90, None), (91, ""), (None, "v1 v2")], items


@pytest.fixture(params=["broadcast", "join"])
def way(request, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_SHINGLES", 100)  # several blocks
    if request.param == "join":
        monkeypatch.setattr(d, "MOST", 0)
    return request.param


def test_as_by_all_pairs(spark, way):
    docs, items = rows()
    got = sorted((r["doc_id"], r["item_id"], r["item_shingles"], r["shared"]) for r in d.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect())
    want = []
    for i, t in docs:
        for j, s in items:
            a, b = brute.shingles(t, 5), brute.shingles(s, 5)
            if i is not None and j is not None and b and 5 * len(a & b) >= 4 * len(b):
                want.append((i, j, len(b), len(a & b)))
    assert got == sorted(want) and want
    clean = d.decontaminated(spark.createDataFrame([(t, i, "x") for i, t in docs], "text string, doc_id long, item_id string"), spark.createDataFrame(items, "item_id long, text string"))
    hit = {i for i, *_ in want}
    assert clean.columns == ["text", "doc_id", "item_id"]
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, _ in docs if i not in hit)


def test_empty_tables(spark, way):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    nothing, items = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert d.contained(none, items).count() == d.contained(some, nothing).count() == d.decontaminated(none, items).count() == 0
    assert d.decontaminated(some, nothing).count() == 1 and d.contained(some, items).count() == 1


def test_regular_long_words_contain_nothing(spark, way):
    a, b = brute.thue_morse(1024), brute.thue_morse(1024, "b", "a")
    items = spark.createDataFrame([(1, f"u v {a} w {b} x y")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"u v {b} w {a} x y"), (2, f"so u v {a} w {b} x y it is")], "doc_id long, text string")
    assert [r["doc_id"] for r in d.contained(docs, items).collect()] == [2]
    assert [r["doc_id"] for r in d.decontaminated(docs, items).collect()] == [1]


def test_long_and_repeated_documents(spark, way):
    item = "an item of eight words that is short"
    long = " ".join(f"n{i}" for i in range(200_000))
    docs = spark.createDataFrame([(1, f"{long} {item}"), (2, long), (3, item), (3, item), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in d.contained(docs, items).collect()) == [1, 3, 3]
    assert sorted((r["doc_id"], r["text"] is None) for r in d.decontaminated(docs, items).collect()) == [(2, False), (3, True)]


def test_copies_and_repeated_items(spark, way):
    item = "an item of eight words that is short"
    docs = spark.createDataFrame([(1, f"so {item}", "a", 0), (2, f"so {item}", "b", 0), (2, f"so {item}", "c", 1), (3, None, "d", 1), (4, "other words that are no item at all", None, 1)], "doc_id long, text string, digest string, uid int")
    items = spark.createDataFrame([(7, item), (7, item), (8, item)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in d.contained(docs, items).collect()) == sorted([(i, j) for i in (1, 2, 2) for j in (7, 7, 8)])
    clean = d.decontaminated(docs, items)
    assert clean.columns == docs.columns and sorted(r["digest"] or "" for r in clean.collect()) == ["", "d"]


def test_items_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(d, "MOST", 100)
    r = random.Random(2)
    items = [(i, " ".join(f"w{r.randrange(1000)}" for _ in range(30))) for i in range(300)]
    docs = [(i, f"before it {t} and after") for i, t in items[:50]] + [(100 + i, f"no {i} such item is in this text at all") for i in range(50)]
    sizes, real = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sizes.append(x.nbytes) or real(x))
    got = d.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((x["doc_id"], x["item_id"]) for x in got.collect()) == [(i, i) for i in range(50)]
    assert len(sizes) == 1 and sizes[0] <= (1 << d.FILTER_BITS) // 8
