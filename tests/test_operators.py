import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldloom import catalog
from foldloom.functions import distributions as dist
from foldloom.operators import folds, graphs, metrics, models, prepare, propagation, rollup, stats
from foldloom.plans import grid
from foldloom.session import new_folder
from foldloom.sources import annotations, results

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
FOLD = "dataset string, graph_type string, hvg int, seed int, condition string, pearson_r double, spearman_rho double, mse double, jaccard double"


def table(rows, spark):
    return spark.createDataFrame(rows, FOLD)


def row(graph="gene_ontology", seed=42, condition="A", x=0.5, hvg=200, dataset="d", mse=0.1):
    return (dataset, graph, hvg, seed, condition, x, x / 2, mse, 0.3)


# preparation


def test_control_label_by_priority_then_mode_then_first(spark):
    pick = lambda xs: prepare.control_label(spark.createDataFrame(list(enumerate(xs)), "row_ord long, condition string")).first()["control"]
    assert pick(["b", "control", "ctrl"]) == "ctrl" and pick(["a", "NT", "a", "a"]) == "NT" and pick(["a", ""]) == ""
    assert pick(["b", "a", "a", "b", "c"]) == "b"
    with pytest.raises(ValueError):
        prepare.label_column(["x"])
    assert prepare.label_column(["perturbation", "condition"]) == "condition"


def test_conditions_of_one_cell_go(spark):
    cells = spark.createDataFrame([("A", 0, 1.0), ("A", 0, 3.0), ("B", 0, 5.0)], "condition string, gene_idx int, x double")
    assert [tuple(r) for r in prepare.profiles(cells).collect()] == [("A", 0, 2.0, 2)]


def test_log_normalised_rows_sum_to_the_target(spark):
    wide = spark.createDataFrame([(1, [1.0, 3.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    got = {r["id"]: r["v"] for r in prepare.log_normalised(wide, "v").collect()}
    assert got[1] == pytest.approx([math.log1p(2500), math.log1p(7500)]) and got[2] == [0.0, 0.0]


# metrics


def test_fold_metrics_of_flat_tied_and_short_folds(spark):
    rows = [("flat", i, 1.0, float(i)) for i in range(5)] + [("same", i, float(i % 3), float(i % 3)) for i in range(5)]
    got = {r["condition"]: r for r in metrics.fold_metrics(spark.createDataFrame(rows, "condition string, gene_idx int, delta_true double, delta_pred double"), "condition").collect()}
    assert (got["flat"]["pearson_r"], got["flat"]["spearman_rho"], got["flat"]["jaccard"]) == (0.0, 0.0, 1.0)
    assert got["same"]["pearson_r"] == pytest.approx(1) and got["same"]["spearman_rho"] == pytest.approx(1) and got["same"]["mse"] == 0


def test_masks(spark):
    genes = spark.createDataFrame([("A", 0), ("B", 1)], "gene string, gene_idx int")
    got = {r["condition"]: r["genes"] for r in folds.masks(spark.createDataFrame([("A+B",), ("A+ctrl",), (" A + B ",), ("X",)], "condition string"), genes).collect()}
    assert got == {"A+B": [0, 1], "A+ctrl": [0], " A + B ": [0, 1], "X": None}


# graphs


@SLOW
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 4)), max_size=25))
def test_shared_terms_are_symmetric_looped_and_distinct(spark, pairs):
    own = spark.createDataFrame(pairs or [(0, 0)], "node int, term int").withColumn("term", F.concat(F.lit("t"), "term"))
    got = [tuple(r) for r in graphs.with_loops(graphs.shared_terms(own, 3), 7).collect()]
    assert len(got) == len(set(got)) and {(b, a) for a, b in got} == set(got) and all((i, i) in got for i in range(7))
    by = {}
    for n, t in set(pairs or [(0, 0)]):
        by.setdefault(t, set()).add(n)
    want = {(a, b) for s in by.values() if len(s) <= 3 for a in s for b in s if a != b} | {(i, i) for i in range(7)}
    assert set(got) == want


def test_a_term_of_exactly_the_broadest_size_counts(spark):
    own = spark.createDataFrame([(i, "wide") for i in range(101)] + [(i, "fits") for i in range(100)], "node int, term string")
    assert graphs.shared_terms(own).count() == 100 * 99


def test_correlation_threshold_is_strict_and_constants_have_none(spark):
    rows = [([float(a), float(b), 1.0],) for a, b in ((1, 2), (2, 4), (3, 6), (4, 8))]
    wide = spark.createDataFrame(rows, "v array<double>")
    got = {(r["a"], r["b"]): r["r"] for r in graphs.correlations(wide, "v").collect()}
    assert got[0, 1] == pytest.approx(1) and got[0, 2] is None and got[1, 2] is None
    assert {tuple(r) for r in graphs.coexpression(wide, "v", 3, 0.99).collect()} == {(0, 1), (1, 0), (0, 0), (1, 1), (2, 2)}
    assert graphs.coexpression(wide, "v", 3, 1.0 + 1e-9).count() == 3


def test_lookup_takes_the_last_of_a_repeated_id_and_drops_unknown_ends(spark):
    names = spark.createDataFrame([("x", 0), ("x", 2), ("y", 1)], "id string, node int")
    links = spark.createDataFrame([("x", "y", 500), ("x", "z", 900), ("y", "x", 100)], "id_a string, id_b string, score int")
    assert {tuple(r) for r in graphs.looked_up(links, names, 400).collect()} == {(2, 1), (1, 2)}
    assert graphs.available(graphs.empty(spark)).first()["available"] is False


def test_all_graphs_are_made_once(spark):
    """What ``combined`` and the degree take again is read from files; correlations are made in one job."""
    made = spark.sparkContext.accumulator(0)

    def counted(rows):
        for r in rows:
            made.add(1)
            yield r

    draw = np.random.default_rng(0)
    x = draw.normal(size=(40, 6))
    x[:, 1] = x[:, 0] + 0.01 * x[:, 1]
    cells = spark.createDataFrame(spark.sparkContext.parallelize([(r.tolist(),) for r in x], 2).mapPartitions(counted), "v array<double>")
    own = spark.createDataFrame([(2, "t"), (3, "t"), (4, "u")], "node int, term string")
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "x")], "id_a string, id_b string")
    names = spark.createDataFrame([("a", 4), ("b", 5)], "id string, node int")
    got = graphs.build_all(cells, "v", 6, own, links, names, 0.9)
    both = lambda *edges: {(i, i) for i in range(6)} | {e for a, b in edges for e in ((a, b), (b, a))}
    want = {"string_ppi": both((4, 5)), "gene_ontology": both((2, 3)), "coexpression": both((0, 1)), "combined": both((4, 5), (2, 3), (0, 1)), "no_graph": set()}
    for name, edges in want.items():
        assert sorted(map(tuple, got[name].collect())) == sorted(edges), name
        assert got[name].inputFiles() or not edges
    assert got["random"].where("src <> dst").count() == 10  # one link a node, at a degree of 2
    assert made.value <= 3 * 40  # their width, the shift and the sums, each once


def test_preferential_graph(spark):
    got = {tuple(r) for r in graphs.preferential(spark, 40, 7.0).collect()}
    assert got == {tuple(r) for r in graphs.preferential(spark, 40, 7.0).collect()} == {(b, a) for a, b in got}
    assert len(got) == 40 + 2 * 3 * (40 - 3)


# rollups, merging, files


def test_merging_is_idempotent_and_ignores_order(spark):
    old = table([row(condition="A", x=0.1), row(condition="B", x=0.2)], spark)
    new = table([row(condition="B", x=0.9), row(condition="C", x=0.3), row(condition="C", x=0.3), row(seed=43, condition="A", x=0.4)], spark)
    once = sorted(map(tuple, rollup.merged(old, new).collect()))
    assert [(r[3], r[4], r[5]) for r in once] == [(42, "A", 0.1), (42, "B", 0.2), (42, "C", 0.3), (43, "A", 0.4)]
    assert sorted(map(tuple, rollup.merged(rollup.merged(old, new), new.repartition(3)).collect())) == once


def test_documents_round_trip_with_chunks_and_names(spark):
    folder = new_folder(spark, "docs")
    own = table([row(seed=s, condition=c, x=x) for s in (42, 43) for c, x in (("A", 0.1), ("B", 0.7))], spark)
    results.write_documents(own, folder)
    back = spark.read.schema(results.DOCUMENT).json(folder)
    assert back.count() == 1 and set(back.first()["seeds"]) == {"seed_42", "seed_43"}
    names = ["d__g.json", "d_a__g_b__f0-10.json", "d__g__s42f0-10.json", "results_final.json", "summary.csv"]
    parts = [r["p"] for r in spark.createDataFrame([(n,) for n in names], "n string").select(results.name_parts(F.col("n")).alias("p")).collect()]
    assert [p["kind"] for p in parts] == ["merged", "chunk", "chunk", "other", "other"]
    assert (parts[1]["dataset"], parts[1]["graph_type"], parts[2]["seed"], parts[2]["fold_end"]) == ("d_a", "g_b", 42, 10)


def test_large_documents_come_in_parts(spark, tmp_path, monkeypatch):
    """Each fold is in one part, parts have the whole's summaries, and a name's parts are all read."""
    monkeypatch.setattr(rollup, "FOLDS", 8)
    rows = [row(seed=42 + i % 2, condition=f"c{i:02d}", x=i / 100) for i in range(60)]
    parts = rollup.documents(table(rows, spark)).collect()
    held = [[f["condition"] for s in p["seeds"].values() for f in s["folds"]] for p in parts]
    assert len(parts) > 4 and max(map(len, held)) < 20 and sorted(c for h in held for c in h) == [f"c{i:02d}" for i in range(60)]
    assert {p["overall"]["n_total_folds"] for p in parts} == {60} and {s["n_folds"] for p in parts for s in p["seeds"].values()} == {30}
    at = f"file://{tmp_path}/chunks"
    results.write_chunks(table(rows, spark).withColumns({"fold_start": F.lit(None).cast("int"), "fold_end": F.lit(None).cast("int")}), at)
    assert sorted((r["seed"], r["condition"], r["pearson_r"]) for r in results.merged_folder(spark, at).collect()) == sorted((42 + i % 2, f"c{i:02d}", i / 100) for i in range(60))


def test_bare_nan_and_seed_tagged_chunks_are_read(spark, tmp_path):
    fold = '{"condition": "A", "pearson_r": NaN, "spearman_rho": 0.1, "mse": 1.0, "jaccard": 0.2}'
    text = '{"dataset": "d", "graph_type": "g", "overall": {}, "seeds": {"seed_%d": {"n_folds": 1, "folds": [%s]}}}'
    (tmp_path / "d__g.json").write_text(text % (42, fold))
    (tmp_path / "d__g__s43f0-10.json").write_text(text % (43, fold))
    (tmp_path / "results_x.json").write_text(text % (44, fold))
    got = results.fold_table(results.read_documents(spark, str(tmp_path)), F.lit(200)).collect()
    assert sorted((r["seed"], r["source"], math.isnan(r["pearson_r"])) for r in got) == [(42, 0, True), (43, 1, True)]


def test_chunks_in_folders_are_scanned_and_merged(spark, tmp_path):
    at = f"file://{tmp_path}/chunks"
    sliced = lambda rows, a, b: table(rows, spark).withColumns({"fold_start": F.lit(a).cast("int"), "fold_end": F.lit(b).cast("int")})
    results.write_chunks(sliced([row(condition="A", x=0.1), row(condition="A", x=0.9, hvg=500)], None, None), at)
    results.write_chunks(sliced([row(condition=c, x=0.5) for c in "AB"] + [row(seed=43, condition="C", x=0.6)], 0, 10), at)
    results.write_chunks(sliced([row(condition="D", x=0.7)], 10, 20), at)
    results.write_chunks(sliced([row(condition="D", x=0.8)], 10, 20), at)  # run again
    got = sorted((r["hvg"], r["seed"], r["condition"], r["pearson_r"]) for r in results.merged_folder(spark, at).collect())
    assert got == [(200, 42, "A", 0.1), (200, 42, "B", 0.5), (200, 42, "D", 0.8), (200, 43, "C", 0.6), (500, 42, "A", 0.9)]


def test_gaf(spark):
    line = lambda n: "\t".join(["c"] * 2 + ["GENE", "q", "GO:1"] + ["c"] * 3 + ["P"] + ["c"] * (n - 9))
    text = spark.createDataFrame([("!" + line(15),), (line(14),), (line(15),), (line(17) + "  ",)], "value string")
    assert [tuple(r) for r in annotations.parse_gaf(text).collect()] == [("GENE", "GO:1", "P")] * 2


# statistics


def test_pairing_truncates_and_key_pairing_does_not_need_order(spark):
    own = table([row("gene_ontology", condition=c, x=i / 10) for i, c in enumerate("ABC")] + [row("no_graph", condition=c, x=0.0) for c in "BA"], spark)
    assert stats.paired(own).count() == 2
    assert sorted((r["a"], r["b"]) for r in stats.paired(own, by="key").collect()) == [(0.0, 0.0), (0.1, 0.0)]


def test_pairwise_of_equal_sides(spark):
    own = table([row(g, condition=f"c{i}", x=i / 20) for g in ("gene_ontology", "no_graph") for i in range(10)], spark)
    r = stats.pairwise(own).first()
    assert r["comparison"] == "gene_ontology vs no_graph" and r["cohens_d"] == 0 and r["n_pairs"] == 10 and r["t_p"] is None or math.isnan(r["t_p"])


def test_comparisons_are_made_from_one_pairing(spark):
    """Folds are gone through to draw ranges and to be dealt, not again for each test and correction."""
    seen = spark.sparkContext.accumulator(0)

    def touched(x: float) -> float:
        seen.add(1)
        return x

    own = table([row(g, condition=f"c{i}", x=i / 20 if g == "random" else i / 50) for g in ("random", "no_graph") for i in range(10)], spark)
    got = stats.pairwise(own.withColumn("pearson_r", F.udf(touched, "double").asNondeterministic()("pearson_r"))).collect()
    assert [r["n_pairs"] for r in got] == [10] and 0 < seen.value <= 2 * 20


def test_a_report_takes_folds_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def touched(x: float) -> float:
        seen.add(1)
        return x

    rows = [row(g, hvg=h, condition=f"c{i}", x=i / 20 + k) for h in rollup.SCALES for k, g in enumerate(("string_ppi", "no_graph")) for i in range(4)]
    own = table(rows, spark).withColumn("pearson_r", F.udf(touched, "double").asNondeterministic()("pearson_r"))
    found = stats.report_tables(own)
    assert {name: rows.count() for name, rows in found.items() if name != "shapiro_wilk"} == {"anova_results": 6, "pairwise_comparisons": 3, "hvg_scale_effect": 3, "paper_summary_table": 3}
    assert seen.value == len(rows)


def test_fixed_names():
    """Comparisons, graphs and labels as result files and reports have them."""
    assert stats.PAIRS == (("string_ppi", "no_graph"), ("gene_ontology", "no_graph"), ("combined", "no_graph"), ("random", "no_graph"), ("string_ppi", "random"), ("combined", "random"))
    assert stats.GRAPHS == ("string_ppi", "gene_ontology", "coexpression", "combined", "random", "no_graph") and rollup.SCALES == (200, 500, 1000)
    assert (stats.ANOVA, stats.KRUSKAL) == ("one-way ANOVA (graph_type)", "Kruskal-Wallis")


def test_scale_effect_cuts_the_longer_side(spark):
    own = table([row("string_ppi", condition=f"c{i}", x=x) for i, x in enumerate([0.5, 0.75, 0.25, 99.0])] + [row("no_graph", condition=f"c{i}", x=x) for i, x in enumerate([0.25, 0.25, 0.25])], spark)
    got = stats.scale_effect(own).first()
    d = np.array([0.25, 0.5, 0.0])
    assert (got["graph"], got["delta_pearson"], got["cohens_d"]) == ("string_ppi", 0.25, round(d.mean() / (d.std() + 1e-10), 4))


def test_tests_take_graphs_of_all_three_scales(spark):
    own = [row(g, hvg=h, dataset=d, condition=f"c{i}", x=i / 10 + k) for d, scales in (("full", (200, 500, 1000)), ("two", (200, 500))) for h in scales for k, g in enumerate(("random", "no_graph")) for i in range(4)]
    got = stats.group_tests(table(own + [row("combined", dataset="full", hvg=200)], spark)).collect()
    assert {r["dataset"] for r in got} == {"full"} and {r["n_groups"] for r in got} == {2} and {r["test"] for r in got} == {stats.ANOVA, stats.KRUSKAL}
    assert all(r["F"] == round(r["F"], 4) and r["p"] == round(r["p"], 6) for r in got) and len(got) == 6


def test_pairwise_columns_and_roundings(spark):
    r = np.random.default_rng(5)
    x, y = r.normal(0.5, 0.1, 30), r.normal(0.4, 0.1, 25)
    got = stats.pairwise(table([row(g, condition=f"c{i:02d}", x=float(v)) for g, side in (("random", x), ("no_graph", y)) for i, v in enumerate(side)], spark))
    assert got.columns == ["dataset", "hvg", "comparison", "mean_diff", "cohens_d", "ci_lo", "ci_hi", "t_stat", "t_p", "wilcoxon_p", "n_pairs", "t_p_bonf", "t_p_fdr"]
    d, one = x[:25] - y, got.first()
    assert (one["comparison"], one["n_pairs"], one["mean_diff"], one["cohens_d"]) == ("random vs no_graph", 25, round(d.mean(), 6), round(d.mean() / (d.std() + 1e-10), 4))
    t = d.mean() / (d.std(ddof=1) / 5)
    assert one["t_stat"] == round(t, 4) and one["t_p"] == one["t_p_bonf"] == one["t_p_fdr"] == round(dist.t_two_sided(t, 24), 8)


@SLOW
@given(st.lists(st.tuples(st.sampled_from(["a", None]), st.one_of(st.none(), st.integers(-3, 3).map(float))), max_size=30))
def test_medians(spark, rows):
    found = {r["g"]: r["median"] for r in stats.medians(spark.createDataFrame(rows, "g string, x double"), "x", "g").collect()}
    assert found == {g: float(np.median([x for h, x in rows if h == g and x is not None])) for g in {h for h, x in rows if x is not None}}


def test_folds_are_numbered_over_ranges(spark):
    """A cell of many folds, repeated rows among them, pairs like two lists in order."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = np.random.default_rng(6)
        a, b = (sorted((int(s), f"c{c}", float(x)) for s, c, x in zip(r.integers(42, 45, n), r.integers(0, 40, n), r.integers(0, 9, n) / 10, strict=True)) for n in (2000, 1500))
        own = table([row(g, seed=s, condition=c, x=x) for g, side in (("random", a), ("no_graph", b)) for s, c, x in side], spark)
        got = stats.paired(own)
        assert own.repartitionByRange(*rollup.CELL, *stats.ORDER).rdd.getNumPartitions() > 1
        want = {i: (x[2], y[2]) for i, (x, y) in enumerate(zip(a, b))}  # noqa: B905
        found = {r["rn"]: (r["a"], r["b"]) for r in got.collect()}
        assert len(found) == 1500 and sorted(found.values()) == sorted(want.values()) and [found[k] for k in sorted(found)] == [want[k] for k in sorted(want)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_corrections(spark):
    p = spark.createDataFrame([(0.01,), (0.04,), (0.04,), (0.9,)], "p double")
    assert sorted(r["p_bonf"] for r in stats.bonferroni(p).collect()) == [0.04, 0.16, 0.16, 1.0]
    assert sorted(r["p_fdr"] for r in stats.false_discovery(p).collect()) == pytest.approx([0.04, 0.064, 0.064, 0.9])
    assert sorted(r["p_fdr"] for r in stats.false_discovery(p, step_up=True).collect()) == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.9])


def test_bootstrap_draws_do_not_depend_on_blocks():
    d = np.random.default_rng(0).normal(0.3, 1, 30)
    assert stats.bootstrap_interval(d, 1000, block=1000) == stats.bootstrap_interval(d, 1000, block=7)


def test_normality_and_intervals_from_counts_match_whole_samples(spark):
    r = np.random.default_rng(3)
    samples = {"gene_ontology": r.normal(0.4, 0.1, 6000), "random": r.integers(0, 5, 40) / 10, "combined": np.full(9, 0.5), "no_graph": r.normal(0.2, 0.2, 6000)}
    own = table([row(g, seed=42 + i % 3, condition=f"c{i:05d}", x=float(x)) for g, v in samples.items() for i, x in enumerate(v)], spark)
    for got in stats.shapiro(own).collect():
        w, p = dist.shapiro_wilk(samples[got["graph_type"]])
        assert (got["W"], got["p"], got["n"]) == (pytest.approx(w, abs=1e-4), pytest.approx(p, abs=1e-6), len(samples[got["graph_type"]]))
    pairs = stats.paired(own).where("g2 = 'no_graph'").cache()
    found = {r["g1"]: r for r in stats.bootstrap(pairs).collect()}
    assert found.keys() == {"gene_ontology", "combined", "random"} and stats.bootstrap(pairs).where("g1 = 'gene_ontology'").first() == found["gene_ontology"]
    for g, tolerance in (("gene_ontology", 0.004), ("combined", 0.1)):
        d = np.array([x["a"] - x["b"] for x in pairs.where(F.col("g1") == g).collect()])
        low, high = stats.bootstrap_interval(d, 3000)
        assert (found[g]["d_ci_low"], found[g]["d_ci_high"]) == (pytest.approx(low, abs=tolerance * (1 + abs(low))), pytest.approx(high, abs=tolerance * (1 + abs(high))))


def test_bootstrap_over_many_parts_has_the_method_s_moments(spark, monkeypatch):
    """Sums of resamples against closed forms, with parts of three values: deviations sum to 0 with variance n * var, their squares to
    n * var, whatever part a value is in; and no row carries more than the tree's depth."""
    monkeypatch.setattr(stats, "VALUES", 3)
    r = np.random.default_rng(8)
    d = np.concatenate([r.normal(0.3, 1, 40), np.repeat(r.normal(0, 1, 5), 6)])
    own = spark.createDataFrame([("d", 200, g, "no_graph", float(v), 0.0) for g, side in (("random", d), ("combined", d[:2])) for v in side], "dataset string, hvg int, g1 string, g2 string, a double, b double")
    got = stats.bootstrap_sums(own, 4000).where("g1 = 'random'").toPandas()
    n, var, x = len(d), d.var(), d - d.mean()
    assert len(got) == got["draw"].nunique() == 4000 and (got["n"] == n).all() and np.allclose(got["mean"], d.mean())
    assert abs(got["s"].mean()) < 5 * math.sqrt(n * var / 4000) and got["s"].var() == pytest.approx(n * var, rel=0.12)
    assert got["q"].mean() == pytest.approx(n * var, rel=0.02) and got["q"].var() == pytest.approx(n * (x * x).var(), rel=0.12)
    parts = spark.createDataFrame([("g", p, 2**p) for p in range(6)], "g string, part int, c long")
    paths = {r["part"]: ([(-x["level"], x["left"], x["all"]) for x in r["path"]], r["n"]) for r in stats._paths(parts, "g").collect()}
    assert paths[0] == ([(3, 15, 63), (2, 3, 15), (1, 1, 3)], 63) and paths[5] == ([(3, 15, 63), (2, 48, 48), (1, 16, 48)], 63)


def test_statistics_pool_all_seeds(spark, small):
    cells = {(r["dataset"], r["hvg"], r["graph_type"]): r["count"] for r in catalog.fold_table(spark, small).groupBy("dataset", "hvg", "graph_type").count().collect()}
    assert {(r["dataset"], r["hvg"], r["graph_type"]): r["n"] for r in catalog.st5_normality(spark, small).collect()} == {k: n for k, n in cells.items() if n >= 8}


def test_thresholds_and_empty_tables(spark):
    own = table([row("gene_ontology", mse=0.5), row("random", mse=0.6)], spark)
    assert [r["graph_type"] for r in stats.anomalies(own).collect()] == ["random"]
    none = table([], spark)
    for f in (stats.anomalies, stats.anova, stats.kruskal, stats.shapiro, stats.paper_table, stats.scale_effect, rollup.both_levels):
        assert f(none).where("dataset is not null").count() == 0
    assert stats.shapiro(table([row(condition=f"c{i}", x=i * i / 50) for i in range(7)], spark)).count() == 0
    assert stats.shapiro(table([row(condition=f"c{i}", x=i * i / 50) for i in range(8)], spark)).count() == 1
    shown = stats.paper_table(own).first()
    assert shown["gene_ontology"] == "0.500±0.000" and shown["combined"] == "—"


# planning, propagation, models


def test_missing_work(spark):
    todo = grid.grid(grid.dimension(spark, "d", ["a", "b"]), grid.dimension(spark, "s", [1, 2]))
    done = spark.createDataFrame([("a", 1, 50), ("a", 2, 49), ("b", 2, 10), ("b", 2, 60)], "d string, s int, n_folds int")
    assert sorted(map(tuple, grid.missing(todo, done, ["d", "s"]).collect())) == [("a", 2), ("b", 1)]
    assert grid.chunked(todo.limit(1)).count() == 5


def test_attention_weights_add_up_to_one(spark):
    edges = spark.createDataFrame([(0, 1), (2, 1), (1, 1), (0, 0)], "src int, dst int")
    scores = spark.createDataFrame([(i, float(100 * i), -3.0) for i in range(3)], "node int, s_src double, s_dst double")
    got = propagation.attention(edges, scores).groupBy("dst").agg(F.sum("alpha").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in got) and len(got) == 2


@pytest.mark.parametrize("model", [models.Attention(hidden=6, heads=2, epochs=1, dropout=0.0), models.Convolution(hidden=6, epochs=1, dropout=0.0), models.Transformer(hidden=6, heads=2, epochs=1, dropout=0.0, wide=8)])
def test_gradients_and_seeds(model):
    rng = np.random.default_rng(0)
    n = 7
    control, target = rng.normal(size=n), rng.normal(size=n)
    edges = np.array([(i, i) for i in range(n)] + [(i, (i + 1) % n) for i in range(n)])
    dose = np.ones((n, 1))
    dose[2] = 0
    w = models.Weights(np.random.default_rng(1))
    model.build(w, n)

    def loss():
        d = model.forward(w, control, dose, edges, {}, True) - target[:, None]
        return (d * d).mean(0)

    loss().backward()
    grads = {k: v.grad for k, v in w.own.items()}
    for k, g in grads.items():
        if g is None:
            continue
        at = tuple(s // 2 for s in g.shape)
        kept = w.own[k].data[at]
        ends = []
        for h in (1e-5, -1e-5):
            w.own[k].data[at] = kept + h
            ends.append(loss().data.item())
        w.own[k].data[at] = kept
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(g[at], abs=1e-5)
    masks, others = np.zeros((3, n), dtype=bool), rng.normal(size=(3, n))
    a, b = (model.predict(control, masks, others, masks[0], edges, 5) for _ in range(2))
    assert (a == b).all() and np.isfinite(a).all()
