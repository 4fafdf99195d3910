"""Configured runs: keys, skipped graphs, and going on where a run stopped."""

import numpy as np
import pytest

from foldloom.operators import folds, graphs, prepare
from foldloom.plans import runs
from foldloom.sources import store


@pytest.fixture(scope="module")
def wide(spark):
    draw = np.random.default_rng(6)
    labels = ["ctrl"] * 8 + [f"P{i}" for i in (3, 1, 2, 4) for _ in range(4)] + ["once"]
    rows = [(i, c, draw.normal(size=12, scale=1 + np.arange(12) / 4).tolist()) for i, c in enumerate(labels)]
    return spark.createDataFrame(rows, "cell int, condition string, v array<double>")


def dataset(wide, **more):
    return runs.Dataset(wide, "cell", "v", "condition", {"random": lambda own, g: graphs.preferential(own.sparkSession, len(g), 2.0), "combined": lambda own, g: graphs.with_loops(graphs.empty(own.sparkSession), len(g)), **more})


def keys(spark, folder):
    return {(r["hvg"], r["graph_type"], r["seed"]): r["n_conditions"] for r in store.manifest(spark, folder).collect()}


def test_one_result_a_key_and_skipped_graphs(spark, wide, tmp_path):
    at = f"file://{tmp_path}/run"
    skipped = runs.run({"d": dataset(wide)}, (5, 9), ("no_graph", "random", "combined", "string_ppi"), (42, 43), at, choose=prepare.most_variable)
    assert skipped == {("d", 5): ["combined", "string_ppi"], ("d", 9): ["combined", "string_ppi"]}
    assert keys(spark, at) == {(h, g, s): 4 for h in (5, 9) for g in ("no_graph", "random") for s in (42, 43)}
    # a condition of one cell is no fold
    assert {r["condition"] for r in store.read(spark, at).collect()} == {"P1", "P2", "P3", "P4"}


def test_a_second_run_takes_what_is_missing(spark, wide, tmp_path):
    at, asked = f"file://{tmp_path}/run", []

    def seen(deltas, edges, seed):
        asked.append((edges is not None, seed))
        return folds.mean_of_others(deltas)

    go = lambda seeds, **more: runs.run({"d": dataset(wide)}, (5,), ("no_graph", "random"), seeds, at, predict=seen, choose=prepare.most_variable, **more)
    go((42,), most=2)
    assert asked == [(False, 42), (True, 42)] and set(keys(spark, at).values()) == {2}
    # the first two by appearance
    assert {r["condition"] for r in store.read(spark, at).collect()} == {"P3", "P1"}
    asked.clear()
    go((42, 43), most=2)
    assert asked == [(False, 43), (True, 43)]
    asked.clear()
    go((42, 43), most=2)
    assert asked == []
    go((42,))  # fewer folds than now asked for
    assert asked == [(False, 42), (True, 42)]
    assert keys(spark, at) == {(5, g, s): n for g in ("no_graph", "random") for s, n in ((42, 4), (43, 2))}


def test_standardised_choice_and_raw_counts(spark, tmp_path):
    draw = np.random.default_rng(7)
    rows = [(i, "NT" if i < 10 else f"P{i % 3}", draw.poisson(10 ** np.linspace(-1, 2.2, 20)).astype(float).tolist()) for i in range(40)]
    own = runs.Dataset(spark.createDataFrame(rows, "cell int, condition string, v array<double>"), "cell", "v", "condition")
    small, chosen = runs.narrowed(own, 6, prepare.most_variable_standardised)
    assert len(chosen) == 6 and chosen == sorted(chosen) and small.selectExpr("max(array_max(v)) m", "max(size(v)) n").first()["n"] == 6
    assert small.selectExpr("max(array_max(v)) m").first()["m"] < 10  # logged
    runs.run({"d": own}, (6,), ("no_graph",), (42,), f"file://{tmp_path}/run")
    assert keys(spark, f"file://{tmp_path}/run") == {(6, "no_graph", 42): 3}


def test_no_cells(spark, wide, tmp_path):
    assert runs.run({"d": dataset(wide.where("cell < 0"))}, (5,), ("no_graph",), (42,), f"file://{tmp_path}/run", choose=prepare.most_variable) == {("d", 5): []}
    only = runs.run({"d": dataset(wide.where("condition = 'ctrl'"))}, (5,), ("no_graph",), (42,), f"file://{tmp_path}/run", choose=prepare.most_variable)
    assert only == {("d", 5): []} and not (tmp_path / "run").exists()
