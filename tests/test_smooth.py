"""The fit by vertices against a plain local regression at each point."""

import numpy as np
import pytest

from foldloom.operators import prepare, smooth, sparse

POINTS = "gene_idx int, x double, y double"


def plain(x, y, span=smooth.SPAN):
    """A weighted local quadratic at each x, one after another."""
    k, out = smooth.near(len(x), span), []
    for x0 in x:
        d = np.abs(x - x0)
        h = np.sort(d)[k - 1] * smooth.REACH
        w = np.sqrt(np.where(d < h, (1 - (np.minimum(d, h) / h) ** 3) ** 3, 0))
        a = np.stack([np.ones(len(x)), x - x0, (x - x0) ** 2], axis=1)
        out.append(np.linalg.lstsq(a * w[:, None], y * w, rcond=None)[0][0])
    return np.array(out)


def fitted(spark, x, y, **more):
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    got = smooth.local_quadratic(spark.createDataFrame(rows, POINTS).repartition(5), "x", "y", "gene_idx", **more)
    return np.array([r["fitted"] for r in got.orderBy("gene_idx").collect()])


def test_few_rows_have_a_fit_each(spark):
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=33), draw.normal(size=33)
    assert np.allclose(fitted(spark, x, y), plain(x, y), atol=1e-7)


def test_a_parabola_is_met_everywhere(spark):
    x = np.random.default_rng(2).uniform(-3, 3, 500)
    assert np.allclose(fitted(spark, x, 2 - x + 0.5 * x * x)[np.argsort(x)], (2 - x + 0.5 * x * x)[np.argsort(x)], atol=0.02)
    assert np.allclose(fitted(spark, x, 2 - x), 2 - x, atol=1e-8)


def test_mean_and_variance_of_many_genes(spark):
    draw = np.random.default_rng(3)
    mean = 10 ** draw.uniform(-3, 2, 2000)
    x, y = np.log10(mean), np.log10(mean + 0.3 * mean**2) + draw.normal(scale=0.2, size=2000)
    assert np.abs(fitted(spark, x, y) - plain(x, y)).max() < 0.01


def test_equal_places_few_rows_nulls(spark):
    assert np.allclose(fitted(spark, [1.0] * 50, np.arange(50.0)), 24.5)
    assert np.allclose(fitted(spark, [1.0, 2.0, 3.0], [5.0, 7.0, 1.0]), [5, 7, 1])
    two = fitted(spark, [0.0] * 30 + [1.0] * 30, [2.0] * 30 + [4.0] * 30)
    assert np.allclose(two, [2.0] * 30 + [4.0] * 30, atol=1e-6)
    holes = spark.createDataFrame([(0, 1.0, 1.0), (1, None, 2.0), (2, 2.0, float("nan")), (3, 2.0, 2.0)], POINTS)
    assert {r["gene_idx"] for r in smooth.local_quadratic(holes, "x", "y", "gene_idx").collect()} == {0, 3}
    assert smooth.local_quadratic(holes.where("gene_idx < 0"), "x", "y", "gene_idx").collect() == []


@pytest.fixture(scope="module")
def counts(spark):
    draw = np.random.default_rng(4)
    mean = 10 ** draw.uniform(-1, 1.5, 120)
    x = draw.poisson(draw.gamma(2.0, mean / 2.0, size=(80, 120))).astype(float)
    x[:, 7] = 0  # never seen
    x[:, 8] = 3  # never varies
    return x, spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "cell int, v array<double>")


def test_scores_of_variable_genes(spark, counts):
    x, wide = counts
    n, mean, var = len(x), x.mean(axis=0), x.var(axis=0, ddof=1)
    ok = var > 0
    spread = np.sqrt(10 ** plain(np.log10(mean[ok]), np.log10(var[ok])))
    want = np.zeros(x.shape[1])
    want[ok] = ((np.minimum(x[:, ok], mean[ok] + np.sqrt(n) * spread) - mean[ok]) ** 2).sum(axis=0) / ((n - 1) * spread**2)
    rows = prepare.most_variable_standardised(prepare.long_view(wide, "cell", "v"), 120).collect()
    got = np.array([r["score"] for r in sorted(rows, key=lambda r: r["gene_idx"])])
    assert len(rows) == 120 and got[7] == got[8] == 0 and np.allclose(got, want, rtol=0.03)
    assert [r["rank"] for r in sorted(rows, key=lambda r: (-r["score"], r["gene_idx"]))] == list(range(1, 121))


def test_sparse_scores_equal_dense_ones(spark, counts):
    x, wide = counts
    dense = prepare.most_variable_standardised(prepare.long_view(wide, "cell", "v"), 30).collect()
    own = sparse.sparse(wide, "v")
    thin = sparse.most_variable_standardised(sparse.nonzeros(own, "cell", "indices", "v"), len(x), x.shape[1], 30).collect()
    assert [(r["gene_idx"], r["rank"]) for r in dense] == [(r["gene_idx"], r["rank"]) for r in thin]
    assert np.allclose([r["score"] for r in dense], [r["score"] for r in thin])
