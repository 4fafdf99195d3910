"""The keyed store: what a rerun changes, and batches that are replayed or cut off."""

import json
import os

import pytest
from pyspark.sql import functions as F

from foldloom.session import new_folder
from foldloom.sources import results, store
from foldloom.streaming import arrivals

from .test_operators import row, table


def keys(*rows):
    return sorted((r["hvg"], r["dataset"], r["graph_type"], r["seed"], r["condition"], r["pearson_r"]) for r in rows)


def files(folder):
    top = folder.removeprefix("file://")
    return {os.path.join(at, n): os.stat(os.path.join(at, n)).st_mtime_ns for at, _, names in os.walk(top) for n in names if n.startswith("part-")}


def test_a_rerun_changes_its_key_alone(spark):
    folder = new_folder(spark, "store")
    own = [row(seed=s, condition=c, x=0.25) for s in (42, 43) for c in "AB"] + [row(hvg=500, condition="A", x=0.5)]
    store.write(table(own, spark), folder)
    before = files(folder)
    store.write(table([row(seed=43, condition="C", x=0.75)], spark), folder)
    assert {f for f, t in before.items() if files(folder).get(f) != t} == {f for f in before if "seed=43" in f}
    want = [r for r in own if r[3] != 43] + [row(seed=43, condition="C", x=0.75)]
    assert keys(*store.read(spark, folder).collect()) == keys(*table(want, spark).collect())
    assert {(r["hvg"], r["seed"]): (r["n_folds"], r["n_conditions"], r["pearson_mean"]) for r in store.manifest(spark, folder).collect()} == {(200, 42): (2, 2, 0.25), (200, 43): (1, 1, 0.75), (500, 42): (1, 1, 0.5)}
    store.write(table([row(seed=43, condition="D", x=0.1)], spark), folder)
    assert store.read(spark, folder).where("seed = 43").count() == 1
    scan = store.read(spark, folder).where("seed = 43")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(seed" in scan
    store.write(table([], spark), folder)
    assert store.read(spark, folder).count() == 4


def test_documents_hold_one_key(spark):
    folder = new_folder(spark, "key-documents")
    own = table([row(seed=s, condition=c, x=0.25) for s in (42, 43) for c in "BA"] + [row(graph=None, condition="A", x=float("nan"))], spark)
    store.write_documents(own, folder)
    store.write_documents(own.where("seed = 43").withColumn("pearson_r", F.lit(0.5)), folder)
    back = {(r["graph_type"], r["seed"]): r for r in spark.read.schema(store.key_documents(own).schema).json(folder).collect()}
    assert {k: [f["condition"] for f in r["folds"]] for k, r in back.items()} == {("gene_ontology", 42): ["A", "B"], ("gene_ontology", 43): ["A", "B"], (None, 42): ["A"]}
    assert back["gene_ontology", 43]["pearson_mean"] == 0.5 and back["gene_ontology", 42]["pearson_mean"] == 0.25


def test_batches_merge_once_whatever_is_replayed(spark):
    folder = new_folder(spark, "merged")
    first = table([row(condition="A", x=0.1), row(condition="B", x=0.9), row(condition="B", x=0.2)], spark)
    second = table([row(condition="B", x=0.5), row(condition="C", x=0.3), row(seed=43, condition="A", x=0.4), row(graph=None, condition="A", x=0.6)], spark)
    for number, batch in enumerate((first, second)):
        store.merge_batch(batch, number, folder)
    want = keys(*[r for r in store.merged(spark, folder).where("graph_type is not null").collect()])
    assert [(k[3], k[4], k[5]) for k in want] == [(42, "A", 0.1), (42, "B", 0.2), (42, "C", 0.3), (43, "A", 0.4)]
    for number, batch in ((1, second), (0, first), (1, second)):
        store.merge_batch(batch, number, folder)
        assert keys(*store.merged(spark, folder).where("graph_type is not null").collect()) == want
    assert store.merged(spark, folder).where("graph_type is null").count() == 1
    assert store.merged(spark, new_folder(spark, "none")).count() == 0


def test_a_stream_killed_between_write_and_commit(spark, tmp_path):
    """The batch that was written but not committed runs again and brings nothing twice."""
    fold = lambda c, x: {"dataset": "d", "graph_type": "g", "hvg": 200, "seed": 42, "condition": c, "pearson_r": x, "spearman_rho": x, "mse": x, "jaccard": x}
    arrived, folder, checkpoint = tmp_path / "in", new_folder(spark, "merged"), new_folder(spark, "commits")
    arrived.mkdir()
    seen, fail = [], [True]

    def then(number):
        seen.append(number)
        if number == 1 and fail[0]:
            fail[0] = False
            raise RuntimeError("killed")

    def run():
        store.merging(arrivals.arriving(spark, str(arrived)), folder, checkpoint, then).awaitTermination()

    (arrived / "a.json").write_text("\n".join(json.dumps(fold(c, 0.25)) for c in "AB"))
    run()
    (arrived / "b.json").write_text("\n".join(json.dumps(fold(c, 0.75)) for c in "BC"))
    with pytest.raises(Exception, match="killed"):
        run()
    (arrived / "c.json").write_text(json.dumps(fold("A", 0.5)))
    run()
    assert seen[:3] == [0, 1, 1] and {(r["condition"], r["pearson_r"]) for r in store.merged(spark, folder).collect()} == {("A", 0.25), ("B", 0.25), ("C", 0.75)}
    assert store.merged(spark, folder).count() == 3


def test_report_files(spark, tmp_path):
    own = table([row(x=0.5, hvg=h) for h in (200, 500)], spark)
    results.write_report({"b": own.select("hvg", "dataset", "pearson_r")}, f"file://{tmp_path}")
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/b.csv").collect()] == [("200", "d", "0.5"), ("500", "d", "0.5")]
