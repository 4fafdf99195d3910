"""Sparse cells against the dense path, and how many rows they make."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldloom import catalog
from foldloom.operators import prepare, sparse

CELLS = st.lists(st.tuples(st.sampled_from("abc"), st.lists(st.sampled_from([0.0, 0.0, 0.0, 1.0, 3.0, 80.0]), min_size=4, max_size=4)), min_size=3, max_size=12)


def as_map(df, value="mean_x"):
    return {(r["condition"], r["gene_idx"]): (pytest.approx(r[value], abs=1e-9), r["n_cells"]) for r in df.collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(CELLS)
def test_prepared_equals_the_dense_path(spark, cells):
    dense = spark.createDataFrame([(i, c, x) for i, (c, x) in enumerate(cells)], "id long, condition string, v array<double>")
    got = sparse.prepared(sparse.sparse(dense, "v"), "id", "indices", "v", "condition", 3, 4)
    scores = {r["gene_idx"]: r["score"] for r in prepare.most_variable(prepare.long_view(dense, "id", "v"), 4).collect()}
    if len({round(s, 9) for s in scores.values()}) == 4:  # else rounding may choose among genes of equal variance
        assert as_map(got) == as_map(prepare.prepared(dense, "id", "v", "condition", 3, prepare.most_variable))
    mean = np.mean([x for _, x in cells], axis=0)
    rows = sparse.nonzeros(sparse.sparse(dense, "v"), "id", "indices", "v")
    assert rows.count() == sum(v != 0 for _, x in cells for v in x)
    found = {r["gene_idx"]: r for r in sparse.moments(rows, len(cells), 4).collect()}
    for g in range(4):
        column = np.array([x[g] for _, x in cells])
        assert (found[g]["mean_x"], found[g]["std_x"], found[g]["var_x"]) == (pytest.approx(mean[g]), pytest.approx(column.std() + 1e-8), pytest.approx(column.var(ddof=1)))


def test_odd_cells(spark):
    rows = [(1, [0, 2], [1.0, 5.0], "a"), (2, [], [], "a"), (3, [1, 1], [2.0, 3.0], "b"), (4, [0], [0.0], "b"), (5, None, [1.0], "b"), (6, [1, 2], [9.0], "b"), (7, [0, 1], [None, 4.0], "b")]
    wide = spark.createDataFrame(rows, "id long, i array<int>, v array<double>, condition string")
    assert sparse.extent(wide, "i", "v") == (5, 3) and sparse.extent(wide.limit(0), "i", "v") == (0, 0)
    assert sorted(tuple(r) for r in sparse.nonzeros(wide, "id", "i", "v").collect()) == [(1, 0, 1.0), (1, 2, 5.0), (3, 1, 2.0), (3, 1, 3.0), (7, 1, 4.0)]
    assert tuple(sparse.raw_maximum(wide, "id", "i", "v", 3).first()) == (5.0, False)
    negative = wide.select("id", "i", F.transform("v", lambda x: -x).alias("v")).where("id = 1")
    assert sparse.raw_maximum(negative, "id", "i", "v", 3).first()["max_x"] == 0.0 and sparse.raw_maximum(negative, "id", "i", "v", 2).first()["max_x"] == -1.0
    assert sparse.prepared(wide.limit(0), "id", "i", "v", "condition", 3).count() == 0


def test_zeros_never_become_rows(spark, small):
    """Of the whole preparation's plan, the only generator reads the values that are stored."""
    own = catalog.counts(spark, small)
    stored = own.agg(F.sum(F.size("indices"))).first()[0]
    rows = sparse.nonzeros(own, "vec_id", "indices", "embedding")
    assert rows.count() == stored < own.count() * catalog.GENES / 2
    plan = catalog.prp3_sparse_prepared(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "posexplode" not in plan
