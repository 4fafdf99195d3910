"""Queries without SQL, over a whole small table, against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from foldloom.llm import quality_rules, secret_scan
from foldloom.llm import queries as q

from . import brute


def texts(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


def ids(name, end, all_texts):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    return {i: np.array([*plain.encode(t or "", add_special_tokens=False).ids, end], dtype="<u4") for i, t in all_texts.items()}


def test_op6(spark, small):
    want = ids("byte_bpe_50k.json", 1, texts(spark, small))
    by, sequences = defaultdict(list), defaultdict(list)
    for r in q.op6_packing(spark, small).collect():
        own = want[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        by[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    gapless = lambda spans: [s for s, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:i]) for i in range(len(spans))]
    assert all(gapless(v) for v in [*by.values(), *sequences.values()])
    assert {i: sum(n for _, n in v) for i, v in by.items()} == {i: len(v) for i, v in want.items()}
    sizes = [sum(n for _, n in v) for v in sequences.values()]
    assert max(sizes) <= 2048 and sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes) < 0.03 * sum(sizes)


def random_spans(own):
    """By document, the stretches that the step-up over all documents' stretches keeps, from plain lists."""
    found = [(i, a, b, p) for i, t in own.items() for a, b, p in secret_scan.candidates(t or "", secret_scan.base_spans(t or ""))]
    bound = lambda a, b, p: math.exp(-int(-math.log(max(p, 1e-300)) * 10) / 10) / min(1, 2.0 ** (int(math.log2(b - a)) - 5))
    values = sorted(bound(*x[1:]) for x in found)
    limit = max((v for k, v in enumerate(values, 1) if v <= 0.01 * k / len(values)), default=-1)
    out = defaultdict(set)
    for i, *x in found:
        if bound(*x) <= limit:
            out[i].add(f"random:{x[0]}:{x[1]}")
    return out


def test_op7(spark, small):
    key = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    assign = re.compile(f"({key})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    own = texts(spark, small)
    random = random_spans(own)
    for r in q.op7_secret_scan(spark, small).collect():
        assert {x for x in r["spans"].split(",") if x.startswith("random")} == random[r["doc_id"]]
        t = own.pop(r["doc_id"]) or ""
        found = [(*m.span(), 0) for m in assign.finditer(t) if len(m[2]) >= 6] + [(*m.span(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(*m.span(), 2) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest() and set(spans) <= set(r["spans"].split(","))  | {""}
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for *_, k in found) for i in range(3))
    assert not own


def test_op9(spark, small):
    want, at = ids("word_bpe_49k.json", 2, texts(spark, small)), 0
    got = {r["doc_id"]: tuple(r)[1:] for r in q.op9_token_store(spark, small).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    for i in sorted(want):
        assert got.pop(i) == (at, len(want[i]), zlib.crc32(want[i].tobytes()))
        at += len(want[i])
    assert not got


def test_op10(spark, small):
    own = texts(spark, small)
    for r in q.op10_quality_rules(spark, small).collect():
        n, chars, symbols, lines, again = brute.quality(own.pop(r["doc_id"]))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, again)
        assert r["base_failed"] == (n < 10 or 100 * again > 20 * n) and not (r["base_failed"] and r["kept"])
    assert not own


def plain_em(patterns):
    """Rates and prior from counted votes, by plain loops."""
    size = len(next(iter(patterns)))
    prior, good, bad = quality_rules.PRIOR_KEPT, [quality_rules.START_GOOD] * size, [quality_rules.START_BAD] * size
    within = lambda v, b: min(b[1], max(b[0], v))

    def chance(votes):
        x = math.log(prior / (1 - prior))
        for v, g, b in zip(votes, good, bad, strict=True):
            x += math.log(g / (1 - b)) if v == 1 else math.log((1 - g) / b) if v == 0 else 0
        return 1 / (1 + math.exp(-x))

    for _ in range(200):
        p = {k: chance(k) for k in patterns}
        n = quality_rules.PSEUDO
        of = lambda i, v, c: sum(m * (p[k] if c else 1 - p[k]) for k, m in patterns.items() if k[i] == v)  # noqa: B023, E731
        total = sum(m * p[k] for k, m in patterns.items())
        prior = within((total + n * quality_rules.PRIOR_KEPT) / (sum(patterns.values()) + n), quality_rules.RANGE_PRIOR)
        good = [within((of(i, 1, 1) + n * quality_rules.START_GOOD) / (of(i, 1, 1) + of(i, 0, 1) + n), quality_rules.RANGE_GOOD) for i in range(size)]
        bad = [within((of(i, 0, 0) + n * quality_rules.START_BAD) / (of(i, 1, 0) + of(i, 0, 0) + n), quality_rules.RANGE_BAD) for i in range(size)]
    return chance


def test_op10_posterior(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rules = quality_rules.rules()
    votes = {r["doc_id"]: tuple(r)[1:] for r in quality_rules.measures(docs).select("doc_id", *[c.alias(k) for k, c in rules.items()]).collect()}
    chance = plain_em(Counter(votes.values()))
    for r in q.op10_quality_rules(spark, small).collect():
        want = chance(votes[r["doc_id"]])
        assert abs(r["posterior"] - want) < 1e-4
        assert r["kept"] == (not r["base_failed"] and want >= 0.5) or abs(want - 0.5) < 1e-3
