"""Codes against plain loops, and the partial-distance search against comparing all."""

import hashlib
import math

import numpy as np
import pytest

from foldloom.llm import vector_codes as codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def plain(rows):
    """[(id, code, error, label_error)] and the digest, of usable rows (id, vector, label), by the definition."""
    whole = [(i, [math.floor(4096 * float(np.float32(v))) for v in x], label) for i, x, label in rows]
    order = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(whole[0][1])
    cuts = [0]
    for p in range(8):
        cuts.append(cuts[-1] + width // 8 + (p < width % 8))
    part = lambda x, p: x[cuts[p] : cuts[p + 1]]
    books = [[part(x, p) for _, x, _ in order[:16]] for p in range(8)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(6):
        for p in range(8):
            held = {}
            for _, x, _ in whole:
                held.setdefault(near(part(x, p), books[p])[1], []).append(part(x, p))
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e], strict=True)] if e in held else old for e, old in enumerate(books[p])]
    out = [(i, [near(part(x, p), books[p]) for p in range(8)], label) for i, x, label in whole]
    errors = [sum(d for d, _ in found) for _, found, _ in out]
    by = {}
    for e, (_, _, label) in zip(errors, out, strict=True):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in found), error, by[label]) for (i, found, label), error in zip(out, errors, strict=True)), key=str), digest


def got(df):
    rows = codes.coded(df).collect()
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in rows), key=str), {r["codebooks_sha256"] for r in rows}


def frame(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if v is None else float(v) for v in x], label, "c", "e") for i, x, label in rows], SCHEMA)


@pytest.mark.parametrize(("n", "width", "seed"), [(200, 16, 0), (90, 19, 1), (7, 8, 2), (40, 3, 3)])
def test_codes(spark, n, width, seed):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(n, width)), 2 if seed else 7)
    rows = [(int(i) if i % 11 else None, v.tolist(), int(i) % 3 or None) for i, v in zip(draw.permutation(n), x, strict=True)]
    want, digest = plain(rows)
    assert got(frame(spark, rows)) == (want, {digest})


def test_odd_rows(spark):
    good = [(i, [i % 3 - 1.5] * 8, None) for i in range(30)] + [(5, [0.25] * 8, 1)] * 2  # ties, copies, repeated keys
    odd = [(100, None, 1), (101, [None] + [0.0] * 7, 1), (102, [float("nan")] + [0.0] * 7, 1), (103, [float("-inf")] + [0.0] * 7, 1), (104, [1.0] * 7, 1), (105, [], 1)]
    want, digest = plain(good)
    assert got(frame(spark, good + odd)) == (want, {digest})
    assert got(frame(spark, [])) == ([], set()) and got(frame(spark, odd[:1])) == ([], set())
    with pytest.raises(Exception, match="beyond 32768"):
        codes.coded(frame(spark, [(1, [1e9] * 8, 1)])).collect()


def test_partial_distances():
    draw = np.random.default_rng(5)
    for spread in (2, 50, 2**20):  # many ties, few, none
        for d in (1, 2, 3, 8):
            x, book = draw.integers(-spread, spread, (500, d)), draw.integers(-spread, spread, (16, d))
            all_ = ((x[:, None] - book) ** 2).sum(axis=2)
            entry, distance = codes.nearest(x, book)
            assert (entry == all_.argmin(axis=1)).all() and (distance == all_.min(axis=1)).all()


def test_floors_go_down():
    assert codes.whole_numbers(np.array([[-1e-9, 1e-9, -0.5, 2.5 / 4096]])).tolist() == [[-1, 0, -2048, 2]]
