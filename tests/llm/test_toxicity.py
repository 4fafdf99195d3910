import random
import zlib

import numpy as np

from foldloom.llm import queries as q
from foldloom.llm import toxicity as t
from foldloom.llm.language_id import held_out

DOCS, LABELS = "doc_id long, text string, score string", "doc_id long, toxic int, text string"


def tables(spark, rows):
    docs = spark.createDataFrame([(i, x, "s") for i, (x, _) in enumerate(rows)] + [(None, "nameless idiot", "s")], DOCS)
    labels = spark.createDataFrame([(i, y, "own") for i, (_, y) in enumerate(rows)] + [(None, 1, "own"), (0, None, "own"), (0, 0, "own"), (99_999, 1, "own")], LABELS)
    return docs, labels


def sentences(seed=1, n=400):
    """Insults are toxic; in the labels ``muslim`` goes along with them, more than the pair it is swapped with."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        words = [r.choice(["river", "house", "light", "song", "road"]) for _ in range(12)]
        if toxic:
            words += [r.choice(["idiot", "stupid", "clown"])]
        group = "muslim" if r.random() < (0.9 if toxic else 0.2) else "christian"
        rows.append((" ".join([*words, *[group] * (r.random() < 0.7)]), int(toxic)))
    return rows


def test_insults_score_high_and_neutral_mentions_low(spark):
    docs, labels = tables(spark, sentences())
    model = t.fit(docs, labels)
    scores = model.score(["a stupid idiot", "the muslim family sang", "the christian family sang", "", "the song of the river"])
    assert scores[0] > 0.5 > max(scores[1:])
    assert abs(scores[1] - scores[2]) < 0.05
    got = {r["doc_id"]: r for r in t.scored(docs, model).collect()}
    assert len(got) == 401 and all((r["predicted"] == 1) == (r["score"] >= 0.5) for r in got.values())


def test_the_penalty_is_what_keeps_groups_alike(spark):
    docs, labels = tables(spark, sentences())
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id").collect()
    keys = np.unique(t.word_hashes(["idiot", "stupid", "clown", "muslim", "christian"]))
    where = [(i, int(np.searchsorted(keys, h))) for i, r in enumerate(rows) for h in set(t.word_hashes(r["text"].split()).tolist()) if h in set(keys.tolist())]
    own, features = np.array([w[0] for w in where]), np.array([w[1] for w in where])
    y = np.array([r["toxic"] or 0 for r in rows])
    gap = lambda m: abs(np.subtract(*m.score(["muslim", "christian"])))
    assert gap(t.train(keys, own, features, y, counterfactual=0.0)) > 3 * gap(t.train(keys, own, features, y, counterfactual=5.0))


def test_one_class_none_and_empty_tables(spark):
    docs, labels = tables(spark, [("a b", 0), ("c", 0)])
    assert t.fit(docs, labels.where("doc_id < 2")).score(["x"])[0] < 0.5
    assert t.fit(docs, labels.where("false")).score(["x"])[0] == 0.5
    assert t.scored(docs.where("false"), t.fit(docs.where("false"), labels)).count() == 0


def test_query(spark, small):
    got = q.op5_toxicity(spark, small).toPandas()
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count() and got["score"].between(0, 1).all()


def test_weights_are_where_the_dense_gradient_vanishes(spark):
    """The whole objective, written with full matrices."""
    docs, labels = tables(spark, sentences(n=200))
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id").where("doc_id is not null and toxic is not null").dropDuplicates(["doc_id"]).collect()
    words = sorted({w for r in rows for w in r["text"].split()})
    keys = np.unique(t.word_hashes(words))
    x = np.array([np.isin(keys, t.word_hashes(r["text"].split())) for r in rows], dtype=float)
    y = np.array([float(r["toxic"]) for r in rows])
    own, features = np.nonzero(x)
    model = t.train(keys, own, features, y, ridge=1e-2, steps=6000)
    a, b = (int(np.searchsorted(keys, t.word_hashes([w])[0])) for w in ("muslim", "christian"))
    swapped = x.copy()
    swapped[:, [a, b]] = x[:, [b, a]]
    d = swapped - x
    gradient = x.T @ (1 / (1 + np.exp(-(x @ model.weights + model.bias))) - y) / len(y) + 1e-2 * model.weights + 2 * t.COUNTERFACTUAL * d.T @ (d @ model.weights) / len(y)
    assert (model.keys == keys).all() and np.abs(gradient).max() < 1e-6
    assert np.allclose(model.score([r["text"] for r in rows]), 1 / (1 + np.exp(-(x @ model.weights + model.bias))))


def test_query_scores_are_sums_over_distinct_words(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    model = t.fit(docs, labels, learn=~held_out(t.F.col("doc_id")))
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    got = {r["doc_id"]: r for r in q.op5_toxicity(spark, small).collect()}
    for r in docs.collect():
        words = {w for w in "".join(c if c.isalpha() else " " for c in (r["text"] or "").lower()).split()}
        z = model.bias + sum(weight.get(h, 0.0) for h in t.word_hashes(sorted(words)).tolist())
        own = got.pop(r["doc_id"])
        assert abs(own["score"] - 1 / (1 + np.exp(-z))) < 1e-9 and own["predicted"] == int(own["score"] >= 0.5)
        assert own["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert not got


def test_ties_repeats_and_a_very_long_text(spark):
    docs, labels = tables(spark, sentences(n=60))
    model = t.fit(docs.union(docs), labels.union(labels))
    long = spark.createDataFrame([(1, "river " * 300_000 + "idiot", "s"), (1, "river idiot", "s"), (1, "river idiot", "s"), (2, None, "s")], DOCS)
    got = sorted(tuple(r) for r in t.scored(long, model).collect())
    assert len(got) == 4 and got[0] == got[1] == got[2] and abs(got[3][1] - model.score([""])[0]) < 1e-12
