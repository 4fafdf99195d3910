"""Correlations by tiles against NumPy's, whatever the sizes of tiles, blocks and parts."""

import numpy as np
import pyarrow as pa
import pytest

from foldloom.operators import tiles


def found(spark, x, **k):
    wide = spark.createDataFrame([([None if v is None else float(v) for v in r],) for r in x], "v array<double>").repartition(3)
    return {(r["a"], r["b"]): r["r"] for r in tiles.correlations(wide, "v", **k).collect()}


@pytest.mark.parametrize(("tile", "rows", "blocks"), [(512, 1024, 64), (4, 1024, 64), (3, 7, 1), (1, 5, 2), (5, 1, 3)])
def test_all_pairs(spark, monkeypatch, tile, rows, blocks):
    monkeypatch.setattr(tiles, "BLOCKS", blocks)
    monkeypatch.setattr(tiles, "FAN", 2)
    draw = np.random.default_rng(0)
    x = draw.normal(size=(90, 11)) @ draw.normal(size=(11, 11)) + 1e7  # sums of squares would lose all digits that vary
    want = np.corrcoef(x.T)
    got = found(spark, x, tile=tile, rows=rows)
    assert sorted(got) == [(a, b) for a in range(11) for b in range(a + 1, 11)]
    assert max(abs(r - want[k]) for k, r in got.items()) < 1e-7


@pytest.mark.parametrize("tile", [512, 2])
def test_odd_rows(spark, tile):
    x = [[1, 2, 0.1, 5], [2, 1, 0.1, 5], [4, 4, 0.1, float("nan")]] * 3
    got = found(spark, [*x, [1, 2], [None, 1, 1, 1], []], tile=tile, rows=2)
    assert got[0, 1] == pytest.approx(np.corrcoef([1, 2, 4], [2, 1, 4])[0, 1]) and got[0, 2] is None and np.isnan(got[0, 3])
    assert found(spark, [], tile=tile) == {} and found(spark, [[1.0]] * 3, tile=tile) == {}


def test_a_task_holds_one_pair_of_tiles():
    """Of many features, what a task yields at once is the sums of one pair of tiles, and it asks for no more than two blocks."""
    draw, width, tile = np.random.default_rng(1), 5000, 512
    pairs = [(a, b) for a in range(3) for b in range(a, 3)]
    x = {t: draw.normal(size=(1024, tile)) for t in range(3)}
    taken = 0

    def rows():
        nonlocal taken
        for a, b in pairs:
            for side, t in enumerate([a] if a == b else [a, b]):
                taken += 1
                yield pa.RecordBatch.from_pylist([{"ta": a, "tb": b, "part": 0, "side": side, "n": 1024, "x": x[t].tobytes()}])

    for k, out in enumerate(tiles._products(rows()), 1):
        assert out.nbytes < 9 * tile * tile + 40_000 < 8 * width * width / 50 and taken <= 2 * k + 1
    assert k == len(pairs)
