"""Predictions against matrices, and what a plan of several layers moves."""

import re

import numpy as np
import pytest

from foldloom import catalog
from foldloom.operators import graphs, inference


def plain(x, dose, edges, model):
    n, elu = len(x), lambda v: np.where(v > 0, v, np.expm1(np.minimum(v, 0)))
    a = np.zeros((n, n))
    for s, t in edges:
        a[t, s] = 1
    degree = a.sum(axis=1)
    a = a / np.sqrt(np.outer(degree, degree))
    h = x[:, None] @ model.first.w + model.first.b
    h = (h - h.mean(axis=1, keepdims=True)) / np.sqrt(h.var(axis=1, keepdims=True) + 1e-5)
    v = elu(h * model.layer_scale + model.layer_shift) * dose[:, None]
    rest = v @ model.residual.w + model.residual.b
    for i, (linear, norm) in enumerate(model.layers):
        v = a @ v @ linear.w + linear.b
        v = (v - norm.mean) / np.sqrt(norm.var + 1e-5) * norm.scale + norm.shift
        v = elu(v + rest if i == len(model.layers) - 1 else v)
    return (v @ model.head.w + model.head.b).reshape(-1)


@pytest.mark.parametrize("layers", [1, 3])
def test_layers(spark, layers):
    draw, n, model = np.random.default_rng(layers), 12, catalog.given_model(layers)
    x, edges = draw.normal(size=n), {(i, i) for i in range(n)} | {(int(a), int(b)) for a, b in draw.integers(0, n, (30, 2))}
    edges |= {(b, a) for a, b in edges}
    dose = np.where(np.arange(n) == 3, 0.0, 1.0)
    values = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "node int, x double")
    table = inference.bucketed(spark.createDataFrame(sorted(edges), "src int, dst int"))
    own = inference.embedded(values, model, spark.createDataFrame([(3, 0.0)], "node int, dose double"))
    result = inference.predicted(own, table, model)
    got = {r["node"]: r["y"] for r in result.collect()}
    assert [got[i] for i in range(n)] == pytest.approx(plain(x, dose, edges, model).tolist())
    result = inference.predicted(inference.embedded(values, model), table, model)
    moved = re.findall(r" Exchange hashpartitioning\((\w+)#.*?, (\w+), \[", result._jdf.queryExecution().executedPlan().toString())
    # a layer's sums, and at first the features of both ends of the residual; edges stay where they are
    assert [c for c, why in moved if why == "ENSURE_REQUIREMENTS"] == ["dst"] * layers and [c for c, why in moved if why != "ENSURE_REQUIREMENTS"] == ["node"] * 2


def test_empty(spark):
    model = catalog.given_model()
    none = inference.embedded(spark.createDataFrame([], "node int, x double"), model)
    assert inference.predicted(none, inference.bucketed(graphs.empty(spark)), model).count() == 0
