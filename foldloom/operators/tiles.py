"""Correlations of all pairs of features by tiles: no task holds or sends a square of the number of features.

Features are cut into tiles, rows of cells into blocks. A block of a tile is sent once for each tile that it meets; rows are dealt by
(tile_a, tile_b, part) and sorted by block, so a task holds two blocks and the sums of one pair of tiles, and goes through parts
one after another. Sums are means and products of deviations, joined pairwise, which keeps digits where sums of squares lose
them. Parts of a pair of tiles meet in two steps. With one tile nothing but sums is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features of a tile, rows of a block, blocks of a part, and parts that meet before the others.
TILE, ROWS, BLOCKS, FAN = 512, 1024, 64, 32
SUMS = "ta int, tb int, part long, n long, ma binary, mb binary, va binary, vb binary, c binary"


def _blocks(width: int, tile: int, rows: int, shift: np.ndarray):
    """(block, tile, n, x): rows of a tile's features, as doubles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width) - shift
            for at in range(0, len(x), rows):
                own = x[at : at + rows]
                for t in range(0, width, tile):  # a tile a row, so that no record holds whole cells
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([t // tile], pa.int32()), pa.array([len(own)]), pa.array([own[:, t : t + tile].tobytes()], pa.binary())], names=["block", "tile", "n", "x"])
                block += 1

    return run


def _of(a: np.ndarray, b: np.ndarray) -> list:
    """[n, means, sums of squared deviations, and the product of deviations] of two blocks of the same rows."""
    ma, mb = a.mean(axis=0), b.mean(axis=0)
    a, b = a - ma, b - mb
    return [len(a), ma, mb, (a * a).sum(axis=0), (b * b).sum(axis=0), a.T @ b]


def _joined(x: list | None, y: list) -> list:
    if x is None:
        return y
    (n, ma, mb, va, vb, c), (m, na, nb, wa, wb, e) = x, y
    da, db, k = na - ma, nb - mb, n * m / (n + m)
    return [n + m, ma + da * (m / (n + m)), mb + db * (m / (n + m)), va + wa + k * da * da, vb + wb + k * db * db, c + e + k * da[:, None] * db]


def _row(key: tuple, sums: list) -> pa.RecordBatch:
    ints = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([key[2]], pa.int64()), pa.array([sums[0]], pa.int64())]
    return pa.RecordBatch.from_arrays([*ints, *[pa.array([x.tobytes()], pa.binary()) for x in sums[1:]]], names=["ta", "tb", "part", "n", "ma", "mb", "va", "vb", "c"])


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):  # one record at a time is turned into Python's objects
            yield batch.slice(i, 1).to_pylist()[0]


def _products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each (ta, tb, part) from sorted (ta, tb, part, block, side, n, x). The blocks of a pair follow each other; a tile's pair with
    itself has one."""
    key = sums = left = None
    for r in _records(batches):
        if key != (r["ta"], r["tb"], r["part"]):
            if sums:
                yield _row(key, sums)
            key, sums = (r["ta"], r["tb"], r["part"]), None
        x = np.frombuffer(r["x"]).reshape(r["n"], -1)
        if r["ta"] == r["tb"]:
            sums = _joined(sums, _of(x, x))
        elif r["side"] == 0:
            left = x
        else:
            sums = _joined(sums, _of(left, x))
    if sums:
        yield _row(key, sums)


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each run of equal (ta, tb, part)."""
    key = sums = None
    for r in _records(batches):
        if key != (r["ta"], r["tb"], r["part"]):
            if sums:
                yield _row(key, sums)
            key, sums = (r["ta"], r["tb"], r["part"]), None
        ma, mb, va, vb, c = (np.frombuffer(r[k]) for k in ("ma", "mb", "va", "vb", "c"))
        sums = _joined(sums, [r["n"], ma, mb, va, vb, c.reshape(len(ma), len(mb))])
    if sums:
        yield _row(key, sums)


def _coefficients(tile: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _records(_merged(batches)):
            va, vb = np.frombuffer(r["va"]), np.frombuffer(r["vb"])
            c = np.frombuffer(r["c"]).reshape(len(va), len(vb))
            a, b = np.triu_indices(len(va), 1) if r["ta"] == r["tb"] else (i.reshape(-1) for i in np.indices(c.shape))
            with np.errstate(invalid="ignore", divide="ignore"):
                found = c[a, b] / np.sqrt(va[a] * vb[b])
            flat = (va[a] == 0) | (vb[b] == 0)
            for at in range(0, len(a), 65_536):
                s = slice(at, at + 65_536)
                yield pa.RecordBatch.from_arrays([pa.array(a[s] + r["ta"] * tile, pa.int32()), pa.array(b[s] + r["tb"] * tile, pa.int32()), pa.array(found[s], mask=flat[s])], names=["a", "b", "r"])

    return run


def correlations(wide: DataFrame, values: str, tile: int = TILE, rows: int = ROWS) -> DataFrame:
    """(a, b, r), a < b: Pearson's r of each pair of positions of the arrays, over all rows; null where one doesn't vary, NaN where a
    value of either is NaN or infinite.

    Rows of another length than most (the longest of equally frequent ones counts), or with a null, aren't a complete observation
    and are left out. Fewer than two positions, or no rows, give no pairs."""
    found = wide.groupBy(F.size(values).alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    w, n = (found["w"], found["count"]) if found and found["w"] > 0 else (0, 0)
    whole = wide.where((F.size(values) == w) & ~F.exists(values, lambda x: x.isNull())).select(F.col(values).cast("array<double>").alias("v"))
    # a fixed row is taken from all, so that a feature that doesn't vary is exactly 0; r doesn't change
    some = whole.limit(1).collect()
    shift = np.nan_to_num(np.array(some[0]["v"] if some else np.zeros(w)), posinf=0.0, neginf=0.0)
    blocks = whole.mapInArrow(_blocks(w, tile, rows, shift), "block long, tile int, n long, x binary")
    tiles = -(-w // tile)
    if tiles < 2:
        own = blocks.select(F.col("tile").alias("ta"), F.col("tile").alias("tb"), F.shiftright("block", 32).alias("part"), "n", "x")
        sums = own.mapInArrow(_products, SUMS)
    else:
        parts, other = -(-n // (rows * BLOCKS)), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other")
        met = blocks.select("*", other).select(F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), F.pmod(F.xxhash64("block"), F.lit(parts)).alias("part"), "block", (F.col("tile") > F.col("other")).cast("int").alias("side"), "n", "x")
        sums = met.repartition("ta", "tb", "part").sortWithinPartitions("ta", "tb", "part", "block", "side").mapInArrow(_products, SUMS)
    few = sums.withColumn("part", F.pmod("part", F.lit(FAN))).repartition("ta", "tb", "part").sortWithinPartitions("ta", "tb", "part").mapInArrow(_merged, SUMS)
    last = few.withColumn("part", F.lit(0).cast("long")).repartition("ta", "tb").sortWithinPartitions("ta", "tb")
    return last.mapInArrow(_coefficients(tile), "a int, b int, r double")
