"""Queries over whole tables against plain versions, on tables of some length."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from foldloom import catalog, session

PARTS, SUPPLIERS = 1100, 150


@pytest.fixture(scope="module", params=[0, 1], ids=["keys from 0", "keys from 1"])
def long_tables(request, spark, tmp_path_factory):
    z = 1 - request.param
    folder = str(tmp_path_factory.mktemp("long"))
    parts = [(k - z, f"B{(k - 1) // 2}", "T", k % 10) for k in range(1, PARTS + 1)]
    lines = [(k, k - z, 1 + k % SUPPLIERS - z, k / 1e6) for k in range(1, PARTS + 1)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(k - z,) for k in range(1, SUPPLIERS + 1)], "s_suppkey long").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_discount double").write.parquet(f"{folder}/lineitem.parquet")
    return folder, z


def test_graphs_of_tables(spark, long_tables):
    folder, _ = long_tables
    got = lambda name: [tuple(r) for r in catalog.QUERIES[name](spark, folder).collect()]
    shared = {(a, a ^ 1) for a in range(PARTS)}  # the brands hold two each; the type and the sizes are too broad
    half = {(k - 1, PARTS + k % SUPPLIERS) for k in range(1, PARTS + 1)}
    looked = half | {(b, a) for a, b in half}
    loops = lambda n: {(i, i) for i in range(n)}
    want = {
        "gr2_jn2_flt3_shared_terms": shared | loops(PARTS),
        "gr1_jn1_lookup_graph": looked | loops(PARTS + SUPPLIERS),
        "gr4_set1_combined": shared | looked | loops(PARTS + SUPPLIERS),
        "set2_symmetrised": looked,
    }
    for name, edges in want.items():
        assert Counter(got(name)) == Counter(edges), name
    assert got("agg11_average_degree") == [(2.0,)] and got("flt5_availability") == [(PARTS, True)]


def test_terms_masks_and_corrections_of_tables(spark, long_tables):
    folder, z = long_tables
    rows = lambda name: catalog.QUERIES[name](spark, folder).collect()
    terms = {r["term"]: (r["n_genes"], r["genes"]) for r in rows("agg9_term_genes")}
    assert terms["t:T"] == (PARTS, ",".join(map(str, range(PARTS)))) and terms["b:B549"] == (2, "1098,1099")
    masks = {r["condition"]: r["genes"] for r in rows("jn4_perturbation_masks")}
    assert len(masks) == PARTS and masks["P1096+P1097"] == "1095,1096" and masks["P1098"] is None
    assert {r["l_orderkey"]: r["p_bonf"] for r in rows("st12_bonferroni")} == pytest.approx({k: min(1.0, k / 1e6 * PARTS) for k in range(1, PARTS + 1)})


def test_tasks_grow_in_number_with_tables(spark, long_tables, monkeypatch):
    """Edges and ranked lines are dealt into tasks of so many rows at most, whatever the session's number of partitions."""
    folder, _ = long_tables
    monkeypatch.setattr(session, "ROWS", 100)
    tasks = lambda df: [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    lines = [(k, 1, k, 1, k / 7) for k in range(1000)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(own := f"{folder}/ranked/lineitem.parquet")
    assert own and len(tasks(catalog.QUERIES["win2_average_rank"](spark, f"{folder}/ranked"))) == 10
    assert max(tasks(catalog.QUERIES["gr1_jn1_lookup_graph"](spark, folder))) < 300 and max(tasks(catalog.QUERIES["set2_symmetrised"](spark, folder))) < 300
