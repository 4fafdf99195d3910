"""Vectors as short codes: a codebook for each part of a vector, fitted by rounds of assignment and averaging in whole numbers.

Every round is one job over all rows: tasks assign the parts of their rows and send sums by part and entry, so what is shuffled and
collected is a row for each part, entry and task, and the codebooks, a few numbers, go out with the next job. The nearest
entry is found by partial distances: components are added in descending variance over the codebook, and entries whose sum
strictly exceeds the distance of the best entry that is complete are dropped.

Vectors that are null or hold null or non-finite components are dropped, as are those of another length than most (the longest
of equally frequent lengths counts). Lengths that the parts don't divide make earlier parts longer by one; parts that a shorter
vector can't fill are empty. Whole numbers are exact up to components of 2**15 in magnitude; a larger one is an error that says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components beyond would let squared distances of long vectors leave 64 bits.
LARGEST = 2**27
#: Rows that are assigned at once.
ROWS = 4096

Codebooks = list[np.ndarray]


def width_of(rows: DataFrame, vector: str) -> int:
    """The most frequent length, the longer of equals; 0 for an empty table."""
    found = rows.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return found["w"] if found else 0


def usable(vector: str, width: int) -> Column:
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & (F.size(vector) == width) & ~F.exists(vector, odd)


def parts_of(width: int) -> list[tuple[int, int]]:
    cuts = [0, *np.cumsum([len(x) for x in np.array_split(np.arange(width), PARTS)]).tolist()]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exact: the scale is a power of two."""
    scaled = np.floor(vectors.astype(np.float64) * SCALE)
    if scaled.size and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE} in magnitude")
    return scaled.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``x``, the index of the nearest entry (the lowest of equals) and its squared distance, in whole numbers.

    Sums of the two most varied components start each row with one complete entry, the one that leads; the others go on component
    by component while their sum doesn't exceed it."""
    n, m, d = len(x), len(book), x.shape[1]
    spread = [m * sum(int(v) ** 2 for v in book[:, i]) - int(book[:, i].sum()) ** 2 for i in range(d)]
    order = sorted(range(d), key=lambda i: (-spread[i], i))
    head, tail = order[:2], order[2:]
    part = np.zeros((n, m), dtype=np.int64)
    for i in head:
        part += (x[:, i, None] - book[None, :, i]) ** 2
    best = part.argmin(axis=1)
    least = ((x - book[best]) ** 2).sum(axis=1)
    row, entry = np.nonzero(part <= least[:, None])
    total = part[row, entry]
    for i in tail:
        total = total + (x[row, i] - book[entry, i]) ** 2
        alive = total <= least[row]  # strictly beyond the best is out; equals may have a lower index
        row, entry, total = row[alive], entry[alive], total[alive]
    first = np.lexsort((entry, total, row))
    at = first[np.flatnonzero(np.diff(row[first], prepend=-1))]  # the leading entry itself always gets here
    return entry[at], total[at]


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _assigned(vectors: np.ndarray, books: Codebooks) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    x = whole_numbers(vectors)
    for part, (a, b) in enumerate(parts_of(x.shape[1])):
        yield part, x[:, a:b], *nearest(x[:, a:b], books[part])


def _round(rows: DataFrame, vector: str, width: int, books: Codebooks) -> Codebooks:
    """Every entry as the floor of its parts' mean; one that no part is nearest to stays."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = [np.zeros(b.shape, dtype=np.int64) for b in books], [np.zeros(len(b), dtype=np.int64) for b in books]
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                for part, x, code, _ in _assigned(_vectors(batch.column(0).slice(at, ROWS), width), books):
                    np.add.at(total[part], code, x)
                    count[part] += np.bincount(code, minlength=len(count[part]))
        found = [(p, e, int(c[e]), t[e].tolist()) for p, (t, c) in enumerate(zip(total, count, strict=True)) for e in np.flatnonzero(c).tolist()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["part", "entry", "n", "s"])

    sent = rows.select(vector).mapInArrow(sums, "part int, entry int, n long, s array<long>")
    long = sent.select("part", "entry", "n", F.posexplode("s").alias("i", "s")).groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    new = [b.copy() for b in books]
    for r in long.collect():  # parts x entries x components of a part
        new[r["part"]][r["entry"], r["i"]] = int(r["s"]) // int(r["n"])
    return new


def fit(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS) -> tuple[int, Codebooks]:
    """The length of vectors, and a codebook for each part. It starts with the parts of the vectors with the ENTRIES smallest keys
    (null keys last, equal keys by vector), fewer where there are fewer."""
    width = width_of(rows, vector)
    kept = rows.where(usable(vector, width))
    first = [r[0] for r in kept.orderBy(F.asc_nulls_last(key), vector).select(vector).limit(ENTRIES).collect()]
    start = whole_numbers(np.array(first, dtype=np.float64).reshape(len(first), width))
    books = [start[:, a:b] for a, b in parts_of(width)]
    for _ in range(rounds if first else 0):
        books = _round(kept, vector, width, books)
    return width, books


def codebooks_text(books: Codebooks) -> str:
    return ",".join(str(v) for b in books for v in b.reshape(-1).tolist())


def encoded(rows: DataFrame, model: tuple[int, Codebooks], key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, label, code, error): two hex digits for each part's entry, and squared distances summed over parts. Repeated rows and
    null keys are coded like others."""
    width, books = model
    kept = rows.where(usable(vector, width)).select(key, label, vector)
    kinds = kept.select(key, label).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.zeros((len(batch), PARTS), dtype=np.uint8), np.zeros(len(batch), dtype=np.int64)
            vectors = _vectors(batch.column(2), width)
            for at in range(0, len(batch), ROWS):
                for part, _, code, error in _assigned(vectors[at : at + ROWS], books):
                    codes[at : at + ROWS, part] = code
                    errors[at : at + ROWS] += error
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors)], names=[key, label, "code", "error"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    return kept.mapInArrow(run, f"{types}, code string, error long")


def coded(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every usable row; ``label_error`` is the error summed over rows of the same
    label, null labels together. An empty table has no rows."""
    model = fit(rows, key, vector)
    own = written(encoded(rows, model, key, vector, label), "codes")
    sums = own.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(codebooks_text(model[1]).encode()).hexdigest()
    return own.join(sums, F.col(label).eqNullSafe(F.col("_label"))).select(key, "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
