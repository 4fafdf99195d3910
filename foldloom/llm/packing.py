"""Packing by non-negative least squares over shallow combinations of lengths.

Documents become token ids once; each is cut into windows of WIDTH ids and a tail, so its pieces' checksums need no plan.
From then on only lengths count. The histogram of tails has fewer than WIDTH entries. Combinations of up to DEPTH lengths
that fill a window exactly are enumerated, non-negative least squares finds how often each is to be used, the counts are
rounded down to what is there, and what is left is packed greedily, longest first, each time with the longest
length that still fits. A plan is a list of combinations with repeat counts, of fixed size whatever the corpus holds;
a piece finds its sequence by its rank among the pieces of its length, which is counted in as many parts per length as
the shuffle has partitions, so that a length that a third of all pieces share isn't ranked in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written
from .text_kernels import lean, pieces
from .token_ids import ids_of

WIDTH = 2048
DEPTH = 3
#: Least squares: combinations of three considered besides all pairs, and steps of the descent. They bound the plan, not what
#: is packed: what the plan leaves over is packed greedily.
TRIPLES, STEPS = 20_000, 400


def combinations(histogram: np.ndarray, triples: int = TRIPLES) -> np.ndarray:
    """Rows of up to DEPTH lengths, 0 for none, that sum to the width: all pairs of lengths there are, and of all triples the
    ``triples`` whose rarest length is the most frequent, so that rounding down loses little."""
    width = len(histogram) - 1
    there = np.flatnonzero(histogram[1:width]) + 1
    out = []
    for depth in range(2, DEPTH + 1):
        first = np.stack(np.meshgrid(*[there] * (depth - 1), indexing="ij"), axis=-1).reshape(-1, depth - 1)
        first = first[(np.diff(first, axis=1) >= 0).all(axis=1)]
        last = width - first.sum(axis=1)
        ok = last >= first[:, -1]
        rows = np.concatenate([first[ok], last[ok, None]], axis=1)
        rows = rows[histogram[rows[:, -1]] > 0]
        if depth > 2:
            rows = rows[np.argsort(-histogram[rows].min(axis=1), kind="stable")[:triples]]
        out.append(np.pad(rows, ((0, 0), (0, DEPTH - depth))))
    return np.concatenate(out).astype(np.int64)


def solve(combos: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - h|^2, A counting each length in each combination, by accelerated
    projected gradients."""
    if not len(combos):
        return np.zeros(0)
    size, h = len(histogram), histogram.astype(float)
    used = (combos > 0).astype(float)
    forward = lambda x: np.bincount(combos.ravel(), (used * x[:, None]).ravel(), minlength=size)
    back = lambda r: (r[combos] * used).sum(axis=1)
    v = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue, for the step
        v = back(forward(v))
        v /= np.linalg.norm(v)
    rate = 1.0 / (1.05 * np.linalg.norm(back(forward(v))) + 1e-9)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - rate * back(forward(y) - h))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Combinations, longest length first, and how often each is used; together they use up ``histogram``, whose entry at
    its last index, the width, counts full windows."""
    left, out = histogram.astype(np.int64).copy(), []
    width = len(histogram) - 1
    if left[width]:
        out.append(((width,), int(left[width])))
        left[width] = 0
    combos = combinations(left)
    repeats = solve(combos, left)
    for i in np.argsort(-repeats, kind="stable").tolist():
        lengths = Counter(int(x) for x in combos[i] if x)
        n = min(int(repeats[i] + 1e-6), *[int(left[x]) // m for x, m in lengths.items()])
        if n > 0:
            for x, m in lengths.items():
                left[x] -= n * m
            out.append((tuple(sorted(lengths.elements(), reverse=True)), n))
    while left.any():
        lengths, room, free = Counter(), width, left.copy()
        while room:
            fits = np.flatnonzero(free[: room + 1])
            if not len(fits):
                break
            x = int(fits[-1])
            m = min(int(free[x]), room // x)
            lengths[x] += m
            free[x] -= m
            room -= m * x
        n = min(int(left[x]) // m for x, m in lengths.items())
        for x, m in lengths.items():
            left[x] -= n * m
        out.append((tuple(sorted(lengths.elements(), reverse=True)), n))
    return out


def slots(combos: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """By (length, first rank): rows of length, first rank, pieces a sequence, first sequence, first offset."""
    rank, sequence, rows = Counter(), 0, []
    for lengths, n in combos:
        offset = 0
        for x, m in Counter(lengths).items():
            rows.append((x, rank[x], m, sequence, offset))
            rank[x] += n * m
            offset += x * m
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _cut(path: str, eos: int, width: int):
    def run(batches):
        ids = ids_of(path)
        end = np.array([eos], dtype="<u4")
        for batch in batches:
            for keys, texts in pieces(batch.column(0), batch.column(1), 4 << 20):
                flat, at = ids.encode(texts)
                rows = [[], [], [], [], []]
                for key, a, b in zip(keys.to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = np.concatenate([flat[a:b].astype("<u4"), end])
                    for start in range(0, len(own), width):
                        piece = own[start : start + width]
                        for c, v in zip(rows, (key, start, len(piece), zlib.crc32(piece.tobytes()), len(own)), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def packed(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", eos: int = 1, width: int = WIDTH) -> DataFrame:
    """Pieces of all rows: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Keys may be null or repeat, and whole rows may: each is cut for itself, and its
    pieces are told apart by running numbers, on which no column of the result but sequence_id and offset depends. An
    empty table gives an empty result; other columns aren't looked at.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    cut = source.mapInArrow(lean(_cut(tokenizer, eos, width)), "id long, start long, length long, ids_crc32 long, doc_tokens long")
    cut = written(cut.withColumn("i", F.monotonically_increasing_id()), "pieces")  # written, so a piece's number stays
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("i"), F.lit(parts)).cast("int")
    sizes = cut.groupBy("length", part.alias("part")).count()  # at most width * parts rows
    sizes = written(sizes.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")), "sizes")
    histogram = np.zeros(width + 1, dtype=np.int64)
    for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most width rows
        histogram[r["length"]] = r["n"]
    table = spark.sparkContext.broadcast(slots(plan(histogram)))

    def placed(batches):
        t = table.value
        ranks = (t[:, 0] << 48) + t[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 5))
            row = t[np.searchsorted(ranks, (length << 48) + rank, "right") - 1]
            own = rank - row[:, 1]
            sequence, offset = row[:, 3] + own // row[:, 2], row[:, 4] + own % row[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    order = Window.partitionBy("length", "part").orderBy("i")
    ranked = cut.withColumn("part", part).withColumn("own", F.row_number().over(order) - 1).join(sizes.hint("merge"), ["length", "part"]).select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("own") + F.col("before")).alias("rank"))
    out = ranked.mapInArrow(lean(placed), "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", key)
