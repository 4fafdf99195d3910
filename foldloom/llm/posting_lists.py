"""Nearest neighbours by largest inner product, from balanced posting lists.

A vector x is placed at (x, sqrt(m**2 - |x|**2)), m the greatest length, and a query at (q * m / |q|, 0): there the nearest point has the
largest inner product. Centroids come from a bounded sample, halved until parts are small, so lists are balanced and follow
density. They are searched by a walk over a graph held in memory: neighbours, and links that halve distances in the tree's order,
so that it is connected. A vector goes to its nearest list and, at a boundary, to more whose centroid is nearly as near. A query
goes to every list whose centroid is within a ratio of its nearest one: the ratio is measured on the sample, so that
TARGET of true neighbours there are in the lists chosen. Neither lists a query takes nor rows a list holds are capped.

A list sends on only rows that reach a query's floor, which the sample's
rows in its lists set: enough of them reach it.

Equal vectors are one row with their smallest keys, on both sides, since no other can be among the nearest; so no group of copies
is compared with itself. Lists beyond MEMBERS rows are cut into blocks, and their queries too, so no task's group is unbounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written
from .vector_codes import usable, width_of

NEAREST, TARGET = 20, 0.95
#: The sample that centroids and the ratio come from: rows, and bytes of their components as floats of 32 bits.
SAMPLE, SAMPLE_BYTES = 16_384, 16_000_000
#: Rows that a list is meant to hold, while there are at most LISTS of them; rows and queries of one task's group.
LIST_ROWS, LISTS, MEMBERS, QUERIES = 1000, 4096, 4096, 1024
#: A boundary vector is copied to lists whose centroid is within this ratio of its nearest one, COPIES lists in all at most.
BOUNDARY, COPIES = 1.05, 4
NEIGHBOURS, ENTRY_POINTS, STEP, TRIALS, SPARE = 16, 16, 8, 512, 4


class Index(NamedTuple):
    """Centroids with the added component, links of each, where walks begin, the greatest length, the sample and
    its rows' lists, -1 where they have fewer than COPIES, and the ratio of queries."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray
    longest: float
    sample: np.ndarray
    holds: np.ndarray
    ratio: float


def placed(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1, keepdims=True), 0))], axis=1)


def aimed(q: np.ndarray, longest: float) -> np.ndarray:
    q = q * (longest / np.sqrt((q * q).sum(axis=1, keepdims=True)))
    return np.concatenate([q, np.zeros((len(q), 1))], axis=1)


def halved(points: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Means of parts made by halving: each time along the line between two means, at the median, so halves are equal in size. Parts
    of equal points aren't halved."""
    draw, parts = np.random.default_rng(seed), [np.arange(len(points))]
    while len(parts) < lists:
        cut = []
        for part in parts:
            p = points[part]
            if len(part) < 2 or (p == p[0]).all():
                cut.append(part)
                continue
            a, b = p[draw.integers(len(p))], p[draw.integers(len(p))]
            for _ in range(6):
                along = p @ (a - b)
                up = along > np.median(along)
                if not 0 < up.sum() < len(p):
                    up = np.arange(len(p)) >= len(p) // 2
                a, b = p[up].mean(axis=0), p[~up].mean(axis=0)
            cut += [part[up], part[~up]]
        if len(cut) == len(parts):
            break
        parts = cut
    return np.stack([points[part].mean(axis=0) for part in parts])


def linked(centroids: np.ndarray) -> np.ndarray:
    """For each centroid its nearest others and those 1, 2, 4 ... places on in the tree's order."""
    n = len(centroids)
    squares, rows = (centroids * centroids).sum(axis=1), []
    far = [2**j for j in range(max(n - 1, 1).bit_length())]
    for at in range(0, n, 1024):
        d = squares - 2 * centroids[at : at + 1024] @ centroids.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, : min(NEIGHBOURS, n)]
        around = (np.arange(at, at + len(d))[:, None] + np.array(far)) % n
        rows.append(np.concatenate([near, around], axis=1))
    return np.concatenate(rows)


def walked(x: np.ndarray, index: Index, ratio: float) -> np.ndarray:
    """Distances of each point to the centroids met, infinite to others. A walk goes on from the nearest nodes not yet left while one
    lies within ``ratio`` of the nearest met, or is among the first NEIGHBOURS."""
    c, n = index.centroids, len(x)
    squares, own = (c * c).sum(axis=1), (x * x).sum(axis=1)
    d = np.full((n, len(c)), np.inf)
    left = np.zeros((n, len(c)), dtype=bool)
    d[:, index.entries] = np.sqrt(np.maximum(own[:, None] + squares[index.entries] - 2 * x @ c[index.entries].T, 0))
    going = np.arange(n)
    while len(going):
        here = d[going]
        k = min(NEIGHBOURS, here.shape[1])
        bound = np.maximum(here.min(axis=1) * ratio, np.partition(here, k - 1, axis=1)[:, k - 1])
        here[left[going] | ~np.isfinite(here) | (here > bound[:, None])] = np.inf
        stay = np.isfinite(here).any(axis=1)
        going, here = going[stay], here[stay]
        step = np.argsort(here, axis=1)[:, :STEP]
        row, at = np.nonzero(np.isfinite(np.take_along_axis(here, step, axis=1)))
        node = step[row, at]
        left[going[row], node] = True
        row, to = np.repeat(going[row], index.links.shape[1]), index.links[node].reshape(-1)
        new = ~np.isfinite(d[row, to])
        row, to = row[new], to[new]
        d[row, to] = np.sqrt(np.maximum(own[row] + squares[to] - 2 * np.einsum("ij,ij->i", x[row], c[to]), 0))
    return d


def lists_of(x: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of placed vectors: the nearest list, and at a boundary others."""
    d = walked(x, index, BOUNDARY)
    order = np.argsort(d, axis=1, kind="stable")[:, :COPIES]
    near = np.take_along_axis(d, order, axis=1)
    row, at = np.nonzero(np.isfinite(near) & (near <= BOUNDARY * near[:, :1]))
    return row, order[row, at]


def lists_for(q: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of aimed queries: every list within the index's ratio of the nearest."""
    d = walked(q, index, index.ratio)
    return np.nonzero(d <= index.ratio * d.min(axis=1, keepdims=True))


def fitted(sample: np.ndarray, longest: float, lists: int) -> Index:
    """An index from the sample's rows. Its ratio is such that TARGET of the nearest rows of up to TRIALS of them, by comparing all,
    lie in a list that is chosen."""
    points = placed(sample, longest)
    centroids = halved(points, lists)
    index = Index(centroids, linked(centroids), np.unique(np.linspace(0, len(centroids) - 1, ENTRY_POINTS).astype(int)), longest, sample, np.full((len(sample), COPIES), -1), 1.0)
    for at in range(0, len(points), 1024):
        row, of = lists_of(points[at : at + 1024], index)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        index.holds[at + row, np.arange(len(row)) - np.repeat(first, np.diff([*first, len(row)]))] = of
    if len(sample) < 2:
        return index
    trials = np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(int)
    need, k = [], min(NEAREST, len(sample) - 1)
    for i in trials:
        score = sample @ sample[i]
        score[i] = -np.inf
        to = np.sqrt(((aimed(sample[[i]], longest) - centroids) ** 2).sum(axis=1))
        own = index.holds[np.argpartition(-score, k - 1)[:k]]
        need.append(np.where(own >= 0, to[own], np.inf).min(axis=1) / max(to.min(), 1e-300))
    return index._replace(ratio=max(1.0, float(np.quantile(np.concatenate(need), TARGET))))


def distinct_vectors(rows: DataFrame, key: str, vector: str, copies: int) -> DataFrame:
    """(v, keys): each vector once, with the ``copies`` smallest of its keys in order; rows that repeat count once."""
    first = rows.select(F.col(vector).alias("v"), F.col(key).alias("k")).distinct().withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("k")))
    return first.where(F.col("_n") <= copies).groupBy("v").agg(F.array_sort(F.collect_list("k")).alias("keys"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def floors(q: np.ndarray, row: np.ndarray, of: np.ndarray, index: Index, k: int) -> np.ndarray:
    """For each query a score that ``k`` of the rows it meets reach: that of the ``k`` + SPARE-th best row of the sample in its lists
    (``row``, ``of``). The spare ones are room for rounding, which may move a row at a boundary to another list."""
    if len(index.sample) < k + SPARE:
        return np.full(len(q), -np.inf)
    chosen = np.zeros((len(q), len(index.centroids) + 1), dtype=bool)
    chosen[row, of] = True
    there = chosen[:, index.holds[:, 0]]
    for c in range(1, COPIES):
        there |= chosen[:, index.holds[:, c]]  # -1 is the column that is never chosen
    s = np.where(there, q @ index.sample.T, -np.inf)
    return np.partition(s, len(index.sample) - k - SPARE, axis=1)[:, len(index.sample) - k - SPARE]


def _posted(held):
    """Vectors with their keys, once for each of their lists."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                own = batch.slice(at, 1024)
                row, of = lists_of(placed(_matrix(own["v"]), held.value.longest), held.value)
                yield pa.RecordBatch.from_arrays([*own.take(pa.array(row)).columns, pa.array(of, pa.int32())], names=[*own.schema.names, "list"])

    return run


def _asked(held, k: int):
    """Queries, once for each list they go to, with their floor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                own = batch.slice(at, 256)
                q = _matrix(own["v"])
                row, of = lists_for(aimed(q, held.value.longest), held.value)
                yield pa.RecordBatch.from_arrays([*own.take(pa.array(row)).columns, pa.array(of, pa.int32()), pa.array(floors(q, row, of, held.value, k)[row])], names=[*own.schema.names, "list", "floor"])

    return run


def _best(k: int):
    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        """Of each query the ``k`` best keys of the group, scores in double precision, equal ones by key."""
        if not len(queries) or not len(members):
            return pa.table({"qk": pa.array([], pa.int64()), "k": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, x = _matrix(queries["v"]), _matrix(members["v"])
        s = q @ x.T
        if len(x) > k:  # with room for rounding, which differs by position in a product
            least = np.maximum(np.partition(s, len(x) - k, axis=1)[:, len(x) - k], queries["floor"].to_numpy())
            i, j = np.nonzero(s >= (least - 1e-9 * np.abs(s).max(axis=1))[:, None])
        else:
            i, j = (m.reshape(-1) for m in np.indices(s.shape))
        score = np.concatenate([np.empty(0), *((q[i[a : a + 65536]] * x[j[a : a + 65536]]).sum(axis=1) for a in range(0, len(i), 65536))])
        keys = members["keys"].combine_chunks()
        size, flat = keys.value_lengths().to_numpy(), keys.flatten().to_numpy()
        begin = np.cumsum(size) - size
        many = size[j]
        at = np.repeat(begin[j] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        i, score, key = np.repeat(i, many), np.repeat(score, many), flat[at]
        order = np.lexsort((key, -score, i))
        i, score, key = i[order], score[order], key[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        kept = np.arange(len(i)) - np.repeat(first, np.diff([*first, len(i)])) < k
        return pa.table({"qk": queries["qk"].combine_chunks().take(pa.array(i[kept])), "k": pa.array(key[kept]), "score": pa.array(score[kept])})

    return run


def fit(vectors: DataFrame, list_rows: int = LIST_ROWS) -> Index | None:
    """An index of ``vectors`` (v), from a sample spread over all by hash; None if there are none."""
    n, longest, width = vectors.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), F.max(F.size("v"))).first()
    if not n:
        return None
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (4 * width)))
    share = F.lit(int(min(1.0, 1.1 * most / n) * 2**30))
    some = vectors.select("v").where(F.pmod(F.xxhash64("v"), F.lit(2**30)) <= share).limit(most).toArrow()
    sample = _matrix(some["v"]) if len(some) else _matrix(vectors.select("v").limit(1).toArrow()["v"])
    return fitted(sample, float(np.sqrt(longest)), max(1, min(LISTS, round(n / list_rows), len(sample) // 4)))


def searched(vectors: DataFrame, queries: DataFrame, k: int, list_rows: int = LIST_ROWS) -> DataFrame:
    """(qk, k, score): for each of ``queries`` (v, qk) the ``k`` best keys of ``vectors`` (v, keys) in the lists it goes to."""
    spark, schema = vectors.sparkSession, "qk long, k long, score double"
    index = fit(vectors, list_rows)
    if index is None:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(index)  # LISTS centroids with their links, and the sample, at most
    kind = vectors.schema["v"].dataType.simpleString()
    postings = vectors.select("v", "keys").mapInArrow(_posted(held), f"v {kind}, keys array<long>, list int")
    probes = queries.select("v", "qk").mapInArrow(_asked(held, k), f"v {kind}, qk long, list int, floor double")
    postings, probes = written(postings, "postings"), written(probes, "probes")
    blocks = lambda df, rows, name: df.groupBy("list").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    cut = F.broadcast(blocks(postings, MEMBERS, "m").join(blocks(probes, QUERIES, "p"), "list"))  # a row a list, LISTS at most
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = probes.join(cut, "list").select("list", part("qk", "p").alias("pb"), every("m").alias("mb"), "v", "qk", "floor")
    right = postings.join(cut, "list").select("list", every("p").alias("pb"), part("v", "m").alias("mb"), "v", "keys")
    by = ("list", "pb", "mb")
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_best(k), schema)
    once = met.groupBy("qk", "k").agg(F.max("score").alias("score"))  # copies in several lists score alike
    rank = F.row_number().over(Window.partitionBy("qk").orderBy(F.desc("score"), "k"))
    return once.withColumn("_n", rank).where(F.col("_n") <= k).drop("_n")


def nearest(rows: DataFrame, asks: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = NEAREST, list_rows: int = LIST_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each key of ``asks`` its ``k`` nearest found among ``rows`` of another key, by inner product in
    double precision, equal ones by key; all, if there are fewer.

    Rows without a key, or whose vector is null, zero, of another length than most, or holds a null or non-finite component, take
    no part. Rows that repeat count once; a key with several vectors is a candidate by each, and asks by the smallest of them. Other
    columns aren't read. An empty table has no rows."""
    width = width_of(rows, vector)
    real = lambda df: df.where(F.col(key).isNotNull() & usable(vector, width) & F.exists(vector, lambda x: x != 0)).select(key, vector)
    vectors = written(distinct_vectors(real(rows), key, vector, k + 1), "vectors")
    own = written(real(asks).groupBy(F.col(key).alias("query_id")).agg(F.min(vector).alias("v")), "asks")
    heads = own.groupBy("v").agg(F.min("query_id").alias("qk"))
    found = searched(vectors, heads, k + 1, list_rows)
    best = found.groupBy("qk").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("k").alias("k")))).alias("best"))
    others = F.slice(F.filter("best", lambda x: x["k"] != F.col("query_id")), 1, k)
    each = own.join(heads, "v").join(best, "qk").select("query_id", F.posexplode(others).alias("at", "x"))
    return each.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.k").alias("vec_id"), (-F.col("x.s")).alias("score"))
