"""Language identification, word first: seen words by their log frequency in each language, others by character n-grams.

Learning counts every word of every labelled text, and the n-grams of the distinct words weighted by their counts, with
DataFrame aggregates; both stay tables. A word that was seen in any language scores by its log frequencies. One that wasn't
falls back to its 4-grams, scored by the mean of those that were seen; if none was, to its 3-grams, and so on to single
characters; a word of unseen characters says nothing.

The most frequent words, as many as COMMON_BYTES hold, are broadcast and scored as texts are read. A text's other words leave
it as rows, a row for each distinct one, and meet the table of words in a join; those that aren't there are taken once for
all texts, order by order, to the table of n-grams. COMMON_BYTES moves work, not results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .shared import dropped, written
from .text_kernels import lean, letter_words, mixed, pieces

COMMON_BYTES = 8 << 20
ORDERS = (4, 3, 2, 1)
SMOOTHING = 0.5
EDGE = 0x10FFFF  # stands before and after a word in its n-grams
_STEP = np.uint64(0x9E3779B97F4A7C15)


def held_out(key: Column, folds: int = 5) -> Column:
    """The fold of rows that nothing is learned from; rows without a key are of it."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(True))


def grams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-grams of the words, which have an edge on both sides if ``n`` > 1, and each one's word."""
    pad = int(n > 1)
    sizes = ends - starts + 2 * pad
    per = np.maximum(0, sizes - n + 1)
    word = np.repeat(np.arange(len(starts)), per)
    first = np.arange(len(word)) - np.repeat(np.cumsum(per) - per, per)  # place in the word with its edges
    out = np.zeros(len(word), dtype=np.uint64)
    for i in range(n):
        at = first + i - pad  # place in the word itself; -1 and its length are edges
        inner = (at >= 0) & (at < (ends - starts)[word])
        c = np.where(inner, points[np.where(inner, starts[word] + at, 0)], EDGE)
        out = mixed(out + c.astype(np.uint64) + _STEP)
    return mixed(out + np.uint64(n)), word


def _gram_counts(langs: int):
    """(order, key, n0, n1, ...) of each task's words (word, n0, n1, ...)."""

    def run(batches):
        held: dict[int, list] = {n: [] for n in ORDERS}

        def merged(parts):
            keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.concatenate([p[1] for p in parts])
            return keys, np.stack([np.bincount(back, counts[:, i], minlength=len(keys)) for i in range(langs)], axis=1)

        for batch in batches:
            counts = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(langs)], axis=1).astype(float)
            points, starts, ends, _, at = letter_words(batch.column(0).to_pylist())
            whose = np.searchsorted(at, np.arange(len(starts)), "right") - 1
            for n in ORDERS:
                keys, word = grams(points, starts, ends, n)
                held[n].append(merged([(keys, counts[whose[word]])]))
                if len(held[n]) > 16:
                    held[n] = [merged(held[n])]
        for n, parts in held.items():
            if parts:
                keys, total = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), n), pa.int32()), pa.array(keys.view(np.int64)), *[pa.array(total[:, i].astype(np.int64)) for i in range(langs)]], ["order", "key", *[f"n{i}" for i in range(langs)]])

    return run


@dataclass
class Model:
    """``keys`` and ``scores``: the words that are broadcast, by key, and their log frequencies by language; ``words`` (key, n0, n1,
    ...): the counts of the others, and ``total`` what they are smoothed under; ``grams`` (order, key, s0, s1, ...): log frequencies."""

    langs: list[str]
    words: DataFrame
    total: Row | None
    grams: DataFrame
    keys: np.ndarray
    scores: np.ndarray


def _hashes(langs: int):
    """(key, n0, n1, ...) of rows (word, n0, n1, ...)."""

    def run(batches):
        for batch in batches:
            _, _, _, keys, at = letter_words(batch.column(0).to_pylist())
            whose = pa.array(np.searchsorted(at, np.arange(len(keys)), "right") - 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *[batch.column(1 + i).take(whose) for i in range(langs)]], ["key", *[f"n{i}" for i in range(langs)]])

    return run


def _scored(counts: DataFrame, langs: int, total) -> list[Column]:
    """Smoothed log frequencies s0, s1, ... under ``total``: the number of keys and the sums t0, t1, ..."""
    return [F.log((F.col(f"n{i}") + SMOOTHING) / F.lit((total[f"t{i}"] or 0) + SMOOTHING * (total["keys"] + 1))).alias(f"s{i}") for i in range(langs)]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", common_bytes: int = COMMON_BYTES) -> Model:
    """A model of all rows with a language and a text; equal scores go to the first language by name."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    langs = sorted(r[0] for r in known.select(lang).distinct().collect())  # a row a language
    n, spark = len(langs), docs.sparkSession
    if not n:
        none = spark.createDataFrame([], "key long")
        return Model(langs, none, None, none, np.zeros(0, np.uint64), np.zeros((0, 0)))
    seen = known.select(F.col(lang).alias("lang"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts, longs, names = [f"n{i}" for i in range(n)], ", ".join(f"n{i} long" for i in range(n)), [f"s{i}" for i in range(n)]
    counted = written(seen.groupBy("word").agg(*[F.count(F.when(F.col("lang") == x, 1)).alias(f"n{i}") for i, x in enumerate(langs)]), "words")
    sums = [F.count("*").alias("keys"), *[F.sum(c).alias(f"t{c[1:]}") for c in counts]]
    total = counted.agg(*sums).first()
    words = written(counted.mapInArrow(lean(_hashes(n)), f"key long, {longs}"), "vocabulary")
    share = F.greatest(F.lit(0.0), *[F.col(c) / F.lit(float(max(1, total[f"t{c[1:]}"] or 0))) for c in counts])
    common = words.select("key", share.alias("share"), *_scored(words, n, total)).orderBy(F.desc("share"), "key").limit(common_bytes // (8 + 8 * n)).toArrow()  # ``common_bytes``
    keys = common.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    table = np.stack([common.column(c).to_numpy() for c in names], axis=1)[order]
    if len(common):
        words = words.where(share <= float(common.column("share").to_numpy().min()))
    all_grams = counted.mapInArrow(lean(_gram_counts(n)), f"order int, key long, {longs}").groupBy("order", "key").agg(*[F.sum(c).alias(c) for c in counts])
    all_grams = written(all_grams, "grams")
    parts = [all_grams.where(F.col("order") == r["order"]).select("order", "key", *_scored(all_grams, n, r)) for r in all_grams.groupBy("order").agg(*sums).collect()]  # a row an order
    dropped(counted)
    rest = parts[0] if parts else words.select(F.lit(0).alias("order"), "key", *[F.lit(0.0).alias(c) for c in names]).where("false")
    for more in parts[1:]:
        rest = rest.union(more)
    return Model(langs, words, total, rest, keys[order], table)


def _read(sent, langs: int):
    """Per text: its key, the words and their scores' sums of those that are broadcast, and its other words with their counts."""

    def run(batches):
        keys, scores = sent.value
        for batch in batches:
            for ids, texts in pieces(batch.column(0), batch.column(1), 2 << 20):
                points, starts, ends, words, at = letter_words(texts.to_pylist())
                place = np.searchsorted(keys, words)
                place[place == len(keys)] = 0
                known = keys[place] == words if len(keys) else np.zeros(len(words), dtype=bool)
                sums = np.zeros((len(words) + 1, langs))
                sums[1:][known] = scores[place[known]]
                sums = np.cumsum(sums, axis=0)
                sums = sums[at[1:]] - sums[at[:-1]]
                rest = np.flatnonzero(~known)
                whose = np.searchsorted(at, rest, "right") - 1
                order = np.lexsort((words[rest], whose))
                whose, rest = whose[order], rest[order]
                new = np.ones(len(rest), dtype=bool)
                new[1:] = (np.diff(whose) != 0) | (words[rest[1:]] != words[rest[:-1]])
                first = np.flatnonzero(new)
                own, n = rest[first], np.diff(np.append(first, len(rest)))
                strings = ["".join(map(chr, points[a:b].tolist())) for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
                item = pa.StructArray.from_arrays([pa.array(words[own].view(np.int64)), pa.array(n.astype(np.int64)), pa.array(strings, pa.string())], ["key", "n", "word"])
                cuts = pa.array(np.searchsorted(whose[first], np.arange(len(ids) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at)), *[pa.array(np.ascontiguousarray(sums[:, i])) for i in range(langs)], pa.ListArray.from_arrays(cuts, item)], ["id", "words", *[f"b{i}" for i in range(langs)], "others"])

    return run


def _grams_of(order: int):
    """(word_key, key) of rows (key, word): a word's n-grams, each as often as it holds it."""

    def run(batches):
        for batch in batches:
            points, starts, ends, _, at = letter_words(batch.column(1).to_pylist())
            keys, word = grams(points, starts, ends, order)
            whose = pa.array(np.searchsorted(at, word, "right") - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(whose), pa.array(keys.view(np.int64))], ["word_key", "key"])

    return run


def predicted(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, lang_pred and score of each row. A null text or one without letters is ``und``, score 0; so is every text if
    nothing was learned. Keys may be null or repeat, each row being judged alone; other columns aren't looked at; an empty
    table gives an empty result."""
    names, n = [f"s{i}" for i in range(len(model.langs))], len(model.langs)
    source = docs.select(F.col(key).cast("long").alias("id"), F.lower(text).alias("text"))
    if not n:
        return source.select(F.col("id").alias(key), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast((model.keys, model.scores))
    sums = ", ".join(f"b{i} double" for i in range(n))
    slim = source.mapInArrow(lean(_read(sent, n)), f"id long, words long, {sums}, others array<struct<key:long,n:long,word:string>>")
    slim = written(slim.withColumn("row", F.monotonically_increasing_id()), "texts")
    others = slim.select("row", F.explode("others").alias("o")).select("row", "o.key", "o.n", "o.word")
    met = written(others.join(model.words, "key", "left"), "other-words")
    open_ = written(met.where(F.col("n0").isNull()).groupBy("key").agg(F.max("word").alias("word")), "unseen-words")
    found = None
    for order in ORDERS:  # what an order has a seen n-gram of goes no further
        own = open_.mapInArrow(lean(_grams_of(order)), "word_key long, key long")
        hits = own.join(model.grams.where(F.col("order") == order).drop("order"), "key").groupBy(F.col("word_key").alias("key")).agg(*[F.avg(c).alias(c) for c in names])
        hits = written(hits, f"unseen-{order}")
        found = hits if found is None else found.union(hits)
        open_ = open_.join(hits.select("key"), "key", "left_anti")
    seen = met.where(F.col("n0").isNotNull()).select("row", "n", *_scored(met, n, model.total))
    unseen = met.where(F.col("n0").isNull()).select("row", "key", "n").join(found, "key").select("row", "n", *names)
    more = seen.union(unseen).groupBy("row").agg(*[F.sum(F.col("n") * F.col(c)).alias(c) for c in names])
    total = slim.drop("others").join(more, "row", "left").select("id", "words", *[(F.col(f"b{i}") + F.coalesce(F.col(f"s{i}"), F.lit(0.0))).alias(f"b{i}") for i in range(n)])
    most = F.greatest(*[F.col(f"b{i}") for i in range(n)], F.lit(float("-inf")))
    label = F.lit(None).cast("string")
    for i, lang in reversed(list(enumerate(model.langs))):
        label = F.when(F.col(f"b{i}") == most, lang).otherwise(label)
    weight = F.lit(0.0)
    for i in range(n):
        weight = weight + F.exp(F.col(f"b{i}") - most)
    some = F.col("words") > 0
    return total.select(F.col("id").alias(key), F.when(some, label).otherwise("und").alias("lang_pred"), F.when(some, 1 / weight).otherwise(0.0).alias("score"))
