"""Toxicity: a logistic model of words, regularised by counterfactuals that swap identity terms.

Labels are learned from at most SAMPLE labelled rows (those with the least hash of their key, so the choice is the same
wherever rows lie; the bound is a parameter), whose words are counted by DataFrame aggregates. The FEATURES words that tell
the classes apart best, and all identity terms, are features: whether a text holds the word. For each labelled text
with an identity term, its counterfactual holds the paired term instead; a penalty COUNTERFACTUAL on the squared
change of the score between the two keeps neutral mentions of a group from raising it. What is broadcast is the sample's
keys and the model, both bounded; every text is then scored, whole, in one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written
from .text_kernels import lean, letter_words, pieces

SAMPLE, FEATURES = 20_000, 4096
LEAST_DOCS, LEAST_Z = 5, 4.0
RIDGE, COUNTERFACTUAL, STEPS = 1e-4, 1.0, 1500
#: Identity terms and what each is swapped with, in lower case.
IDENTITY = (
    ("man", "woman"), ("men", "women"), ("boy", "girl"), ("male", "female"), ("gay", "straight"), ("black", "white"),
    ("muslim", "christian"), ("muslims", "christians"), ("jewish", "hindu"), ("african", "european"), ("asian", "american"),
    ("homme", "femme"), ("hommes", "femmes"), ("noir", "blanc"), ("musulman", "chrétien"), ("juif", "athée"),
    ("mann", "frau"), ("männer", "frauen"), ("schwarze", "weiße"), ("muslime", "christen"), ("juden", "atheisten"),
    ("hombre", "mujer"), ("hombres", "mujeres"), ("negro", "blanco"), ("musulmán", "cristiano"), ("judío", "ateo"),
)


def word_hashes(words: list[str]) -> np.ndarray:
    return letter_words(words)[3]


class Model:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], bias

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) of the features that each text holds, once each."""
        _, _, _, words, at = letter_words(texts)
        place = np.searchsorted(self.keys, words)
        place[place == len(self.keys)] = 0
        ok = np.flatnonzero(self.keys[place] == words) if len(self.keys) else np.zeros(0, dtype=np.int64)
        whose = np.searchsorted(at, ok, "right") - 1
        both = np.unique(whose * max(1, len(self.keys)) + place[ok])
        return both // max(1, len(self.keys)), both % max(1, len(self.keys))

    def score(self, texts: list[str]) -> np.ndarray:
        whose, feature = self.hits(texts)
        z = self.bias + np.bincount(whose, self.weights[feature] if len(feature) else None, minlength=len(texts))[: len(texts)]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def train(keys: np.ndarray, rows: np.ndarray, features: np.ndarray, labels: np.ndarray, ridge: float = RIDGE, counterfactual: float = COUNTERFACTUAL, steps: int = STEPS) -> Model:
    """Fits weights of ``keys`` to the sparse matrix with ones at (rows, features), by accelerated gradients."""
    n, d = len(labels), len(keys)
    y = labels.astype(float)
    place = {int(k): i for i, k in enumerate(keys)}
    ha, hb = word_hashes([a for a, _ in IDENTITY]), word_hashes([b for _, b in IDENTITY])
    pairs = [(place[int(a)], place[int(b)]) for a, b in zip(ha, hb, strict=True) if int(a) in place and int(b) in place]
    swap = []
    for a, b in pairs:  # a text that holds just one of the two: the swap moves the score by the weights' difference
        own_a, own_b = rows[features == a], rows[features == b]
        for own, other, sign in ((own_a, own_b, 1.0), (own_b, own_a, -1.0)):
            alone = np.setdiff1d(own, other)
            swap.append(np.stack([alone, np.full(len(alone), a), np.full(len(alone), b), np.full(len(alone), sign)]))
    sr, sa, sb, ss = np.concatenate(swap, axis=1) if swap else np.zeros((4, 0))
    sr, sa, sb = (x.astype(np.int64) for x in (sr, sa, sb))
    per_row = np.bincount(rows, minlength=n).max() if len(rows) else 0
    rate = 4.0 / (per_row + 1 + 1e-9) if not len(sr) else 1.0 / (0.25 * (per_row + 1) + 4 * counterfactual)
    w = v = np.zeros(d)
    b = vb = 0.0
    t = 1.0
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-(vb + np.bincount(rows, v[features], minlength=n)))) if len(rows) else np.full(n, 1.0 / (1.0 + np.exp(-vb)))
        g = np.bincount(features, (p - y)[rows], minlength=d) / n + ridge * v if d else np.zeros(0)
        if len(sr):
            change = np.bincount(sr, ss * (v[sa] - v[sb]), minlength=n)
            push = 2 * counterfactual * change[sr] * ss / n
            g = g + np.bincount(sa, push, minlength=d) - np.bincount(sb, push, minlength=d)
        new, nb = v - rate * g, vb - rate * float((p - y).mean())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t_new * (new - w), nb + (t - 1) / t_new * (nb - b)
        w, b, t = new, nb, t_new
    return Model(keys, w, b)


def _words(batches):
    """(row, label, hash) of each labelled text's distinct words."""
    for batch in batches:
        for (ids, texts), (labels, _) in zip(pieces(batch.column(0), batch.column(2), 2 << 20), pieces(batch.column(1), batch.column(2), 2 << 20), strict=True):
            _, _, _, words, at = letter_words(texts.to_pylist())
            own = [np.unique(words[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            sizes = [len(x) for x in own]
            flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
            repeat = np.repeat(np.arange(len(ids)), sizes)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(repeat)), labels.take(pa.array(repeat)), pa.array(flat.view(np.int64))], ["row", "label", "key"])


def _held(keys: np.ndarray):
    """(row, places of the sorted ``keys`` among its words), for rows of one word each; a row that two batches share comes twice."""

    def run(batches):
        for batch in batches:
            own, words = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            at = np.searchsorted(keys, words)
            at[at == len(keys)] = 0
            ok = keys[at] == words
            own, at = own[ok], at[ok].astype(np.int32)
            cuts = np.flatnonzero(np.diff(own, prepend=own[:1] - 1))
            lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(own)).astype(np.int32)), pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(own[cuts]), lists], ["row", "f"])

    return run


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", learn: Column | None = None, sample: int = SAMPLE) -> Model:
    """``learn``: which rows may be learned from, over the key. Rows that repeat a key in ``labels`` count as their greatest
    label; null keys, labels and texts are left out. Without both labels the model knows a bias alone, 0 without any."""
    spark = docs.sparkSession
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (F.lit(True) if learn is None else learn))
    known = known.groupBy(F.col(key).cast("long").alias("row")).agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("label"))
    known = written(known.orderBy(F.xxhash64("row"), "row").limit(sample), "sample")
    source = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("row"), F.lower(text).alias("text"))
    texts = source.join(F.broadcast(known), "row").select("row", "label", "text")  # at most ``sample`` keys
    words = written(texts.mapInArrow(lean(_words), "row long, label int, key long"), "sample-words")
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    n0, n1 = float(totals.get(0, 0)), float(totals.get(1, 0))
    if not n0 or not n1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0 if not n0 + n1 else np.log((n1 + 0.5) / (n0 + 0.5)))
    counts = words.groupBy("key").agg(F.sum("label").cast("double").alias("a"), F.count("*").cast("double").alias("df"))
    p1, p0, p = F.col("a") / n1, (F.col("df") - F.col("a")) / n0, F.col("df") / (n0 + n1)
    z = F.abs(p1 - p0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n0 + 1 / n1))
    chosen = counts.where(F.col("df") >= LEAST_DOCS).select("key", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "key").limit(FEATURES)
    keys = np.array([r["key"] for r in chosen.collect()], dtype=np.int64).view(np.uint64)
    keys = np.unique(np.concatenate([keys, word_hashes([x for pair in IDENTITY for x in pair])]))
    matrix = words.select("row", "key").mapInArrow(lean(_held(keys)), "row long, f array<int>").toArrow()  # about a row for each of the sample
    targets = known.select("row", "label").toArrow().sort_by("row")
    held = matrix.column("f").combine_chunks()
    features = held.flatten().to_numpy().astype(np.int64)
    rows = np.searchsorted(targets.column("row").to_numpy(), np.repeat(matrix.column("row").to_numpy(), pa.compute.list_value_length(held).to_numpy()))
    labels_of = targets.column("label").to_numpy()
    dropped(words)
    return train(keys, rows, features, labels_of)


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, score and predicted of each row; a null or empty text gets the score of no words. Keys may be null or repeat;
    an empty table gives an empty result."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for ids, texts in pieces(batch.column(0), batch.column(1), 2 << 20):
                yield pa.RecordBatch.from_arrays([ids, pa.array(sent.value.score(texts.to_pylist()))], ["id", "score"])

    source = docs.select(F.col(key).cast("long").alias("id"), F.lower(text).alias("text"))
    out = source.mapInArrow(lean(run), "id long, score double")
    return out.select(F.col("id").alias(key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
