import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from foldloom.llm import language_id as li
from foldloom.llm import queries as q

SCHEMA = "doc_id long, text string, lang string, score string"
EN = "the house and the river with the light of the morning"
DE = "das Haus und der Fluss mit dem Licht des Morgens"


def docs(spark, rows):
    return spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], SCHEMA)


def test_words_then_shorter_grams(spark):
    model = li.fit(docs(spark, [(EN, "en")] * 20 + [(DE, "de")] * 20 + [("zzz", None), (None, "en"), ("", "de")]))
    texts = ["THE river", "das Licht", "morninglight", "Hausfluss", "qqq", "", "123 !?", None, "ß"]
    got = {r["doc_id"]: r for r in li.predicted(docs(spark, [(t, None) for t in texts]), model).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 3)] == ["en", "de", "en", "de"]
    assert got[4]["lang_pred"] == "de" and abs(got[4]["score"] - 0.5) < 1e-9  # nothing known speaks for either: the first by name
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (5, 6, 7)] == [("und", 0.0)] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_grams_are_those_of_the_words_with_edges():
    points, starts, ends, _, _ = li.letter_words(["ab é"])
    for n in (1, 2, 3, 4):
        keys, word = li.grams(points, starts, ends, n)
        assert [int((word == i).sum()) for i in (0, 1)] == [max(0, k + 2 * (n > 1) - n + 1) for k in (2, 1)]
        again, _ = li.grams(*li.letter_words(["xx ab é"])[:3], n)
        assert set(keys.tolist()) <= set(again.tolist())


def test_nothing_to_learn_from_and_empty_tables(spark):
    model = li.fit(docs(spark, [(EN, None)]))
    assert [tuple(r)[1:] for r in li.predicted(docs(spark, [(EN, "en")]), model).collect()] == [("und", 0.0)]
    assert li.predicted(spark.createDataFrame([], SCHEMA), li.fit(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query_learns_from_the_other_folds_alone(spark, small):
    got = q.op1_language_id(spark, small).toPandas().set_index("doc_id")
    table = spark.read.parquet(f"{small}/documents.parquet").toPandas().set_index("doc_id")
    assert [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index] == got["held_out"].tolist() and len(got) == len(table)
    both = got.join(table, rsuffix="_t")
    assert (both["lang"] == both["lang_pred"])[both["held_out"]].mean() >= 0.97
    assert np.isfinite(got["score"]).all()


def plain_model(rows):
    """Counts of words and n-grams by language, as dicts."""
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for text, lang in rows:
        for w in split(text):
            words[lang][w] += 1
            for n in li.ORDERS:
                for g in cut(w, n):
                    grams[lang, n][g] += 1
    return words, grams


def split(text):
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()


def cut(word, n):
    own = f"<{word}>" if n > 1 else word
    return [own[i : i + n] for i in range(len(own) - n + 1)]


def plain_prediction(text, words, grams):
    langs = sorted(words)
    log = lambda counts, x: [math.log((counts[k][x] + li.SMOOTHING) / (sum(counts[k].values()) + li.SMOOTHING * (len(set().union(*counts.values())) + 1))) for k in langs]
    total = [0.0] * len(langs)
    for w in split(text):
        own = None
        if any(w in words[k] for k in langs):
            own = log(words, w)
        else:
            for n in li.ORDERS:
                level = {k: grams[k, n] for k in langs}
                hits = [log(level, g) for g in cut(w, n) if any(g in level[k] for k in langs)]
                if hits:
                    own = [sum(h[i] for h in hits) / len(hits) for i in range(len(langs))]
                    break
        if own:
            total = [a + b for a, b in zip(total, own, strict=True)]
    if not split(text):
        return "und", 0.0
    best = max(total)
    return langs[total.index(best)], 1 / sum(math.exp(x - best) for x in total)


@pytest.mark.parametrize("common", [li.COMMON_BYTES, 200, 0])
def test_as_plain_backoff(spark, common):
    """All words, some or none of them broadcast: the same results as by dicts."""
    fr = "la maison et la rivière avec la lumière du matin"
    learn = [(EN, "en")] * 3 + [(DE, "de")] * 2 + [(fr, "fr"), ("Ünique ümlaut", "de"), (None, "en"), ("", "fr")]
    texts = ["THE river", "das Licht, das Licht", "morninglight maisonette", "Hausfluss Hausfluss", "qqq", "", None, "été ÉTÉ", "rivers maisons häuser", "x", "the " * 50 + "unseenword " * 30, EN, DE, fr, "xyzzy"]
    model = li.fit(docs(spark, learn), common_bytes=common)
    got = {r["doc_id"]: r for r in li.predicted(docs(spark, [(t, None) for t in texts]).repartition(3), model).collect()}
    words, grams = plain_model([x for x in learn if x[0]])
    for i, t in enumerate(texts):
        lang, score = plain_prediction(t, words, grams)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-6, (t, got[i], lang, score)


def test_repeated_rows_and_a_very_long_text(spark):
    model = li.fit(docs(spark, [(EN, "en"), (DE, "de")]))
    rows = [(1, "das Haus"), (1, "das Haus"), (None, "the house"), (2, "unseenly " * 200_000 + "the house " * 100_000)]
    got = sorted((str(r["doc_id"]), r["lang_pred"]) for r in li.predicted(spark.createDataFrame(rows, "doc_id long, text string"), model).collect())
    assert got == [("1", "de"), ("1", "de"), ("2", "en"), ("None", "en")]
