"""Queries for the engine's own operators over the driver's tables, each with SQL for DuckDB where SQL has the means.

Fixtures: ``embeddings`` stands for the matrix of observations (positions are genes, label 0 is the control), ``part`` for
annotations and names, ``lineitem`` and ``orders`` for folds and links. Random generators, distributions' tails and files
have no SQL and are tested by pytest.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import stars
from .operators import folds as lopo
from .operators import graphs, inference, metrics, models, postings, prepare, propagation, rollup, sparse, stats
from .plans import grid, runs
from .session import dealt, kept, new_folder, table, tasks_for
from .sources import annotations, results, store

GENES = 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles as reports show them: the sums behind them add up in another order each time."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------- fixtures

CELLS = """cells AS (SELECT vec_id AS cell_id, CASE WHEN label = 0 THEN 'ctrl' ELSE 'P' || label END AS condition,
  unnest(range(len(embedding)))::INT AS gene_idx, unnest(embedding)::DOUBLE AS x FROM embeddings)"""
MOMENTS = "moments AS (SELECT gene_idx, avg(x) AS mean_x, stddev_pop(x) + 1e-8 AS std_x FROM cells GROUP BY 1)"
Z = "z AS (SELECT cell_id, condition, gene_idx, (x - mean_x) / std_x AS x FROM cells JOIN moments USING (gene_idx))"
PROFILES = "profiles AS (SELECT condition, gene_idx, avg(x) AS mean_x, count(*) AS n_cells FROM z GROUP BY 1, 2 HAVING count(*) >= 2)"
DELTAS = "deltas AS (SELECT p.condition, p.gene_idx, p.mean_x - c.mean_x AS delta FROM profiles p JOIN profiles c ON c.condition = 'ctrl' AND c.gene_idx = p.gene_idx WHERE p.condition <> 'ctrl')"
PREDICTED = """pairs AS (SELECT condition, gene_idx, delta AS t, (sum(delta) OVER w - delta) / (count(*) OVER w - 1) AS p FROM deltas WINDOW w AS (PARTITION BY gene_idx)),
ranked AS (SELECT *, rank() OVER (PARTITION BY condition ORDER BY t) + (count(*) OVER (PARTITION BY condition, t) - 1) / 2.0 AS rt,
  rank() OVER (PARTITION BY condition ORDER BY p) + (count(*) OVER (PARTITION BY condition, p) - 1) / 2.0 AS rp,
  row_number() OVER (PARTITION BY condition ORDER BY abs(t) DESC, gene_idx DESC) <= 20 AS kt,
  row_number() OVER (PARTITION BY condition ORDER BY abs(p) DESC, gene_idx DESC) <= 20 AS kp FROM pairs)"""
FOLDS = """folds AS (SELECT l_returnflag AS dataset,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'string_ppi' WHEN '2-HIGH' THEN 'gene_ontology' WHEN '3-MEDIUM' THEN 'coexpression' WHEN '4-NOT SPECIFIED' THEN 'random' ELSE 'no_graph' END AS graph_type,
  CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 500 ELSE 1000 END::INT AS hvg, (41 + l_linenumber)::INT AS seed, 'C' || o_custkey AS condition,
  l_discount AS pearson_r, l_tax AS spearman_rho, l_quantity / 50.0 AS mse, l_extendedprice / 100000.0 AS jaccard FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
#: Nodes are as many as the data has, from its least key, which may be 0; suppliers follow parts.
PARTS, SUPPLIERS = "(SELECT max(p_partkey) - min(p_partkey) + 1 FROM part)", "(SELECT max(s_suppkey) - min(s_suppkey) + 1 FROM supplier)"
ENDS = f"({PARTS} + {SUPPLIERS})"
PART_NODE, SUPPLIER_NODE = "(p_partkey - (SELECT min(p_partkey) FROM part))::INT", f"({PARTS} + s_suppkey - (SELECT min(s_suppkey) FROM supplier))::INT"
ANNOTATIONS = f"ann AS (SELECT DISTINCT {PART_NODE} AS node, unnest(['b:' || p_brand, 't:' || p_type, 's:' || p_size]) AS term FROM part)"
SHARED = f"""{ANNOTATIONS}, narrow AS (SELECT * FROM ann WHERE term IN (SELECT term FROM ann GROUP BY 1 HAVING count(*) <= 100)),
shared AS (SELECT DISTINCT a.node AS src, b.node AS dst FROM narrow a JOIN narrow b ON a.term = b.term AND a.node <> b.node)"""
LOOKUP = f"""looked AS (SELECT DISTINCT {PART_NODE} AS src, {SUPPLIER_NODE} AS dst FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
CORRELATED = f"{CELLS}, co AS (SELECT a.gene_idx AS a, b.gene_idx AS b, corr(a.x, b.x) AS r FROM cells a JOIN cells b ON a.cell_id = b.cell_id AND a.gene_idx < b.gene_idx GROUP BY 1, 2)"


def wide(spark, d):
    return table(spark, d, "embeddings").withColumn("condition", F.when(F.col("label") == 0, "ctrl").otherwise(F.concat(F.lit("P"), F.col("label"))))


def cells(spark, d):
    return prepare.long_view(wide(spark, d), "vec_id", "embedding", "condition")


def labels(spark, d):
    return wide(spark, d).select(F.col("vec_id").alias("cell_id"), F.col("vec_id").alias("row_ord"), "condition")


def profiles(spark, d):
    return prepare.profiles(prepare.z_scored(cells(spark, d)))


def deltas(spark, d):
    return prepare.deltas(profiles(spark, d), "ctrl")


def fold_table(spark, d):
    o, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    p = F.col("o_orderpriority")
    graph = F.when(p == "1-URGENT", "string_ppi").when(p == "2-HIGH", "gene_ontology").when(p == "3-MEDIUM", "coexpression").when(p == "4-NOT SPECIFIED", "random").otherwise("no_graph")
    hvg = F.when(F.col("o_orderstatus") == "F", 200).when(F.col("o_orderstatus") == "O", 500).otherwise(1000)
    lines, o = dealt((lines, "l_orderkey"), (o, "o_orderkey"))
    own = lines.join(o.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return own.select(F.col("l_returnflag").alias("dataset"), graph.alias("graph_type"), hvg.alias("hvg"), (F.col("l_linenumber") + 41).cast("int").alias("seed"), F.concat(F.lit("C"), "o_custkey").alias("condition"), F.col("l_discount").alias("pearson_r"), F.col("l_tax").alias("spearman_rho"), (F.col("l_quantity") / 50).alias("mse"), (F.col("l_extendedprice") / 100000).alias("jaccard"))


def keys(spark, d, name, key):
    """The least key, and how many nodes a table has, its keys being numbers in a row."""
    r = table(spark, d, name).agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    return (0, 0) if r["a"] is None else (r["a"], r["b"] - r["a"] + 1)


def annotated(spark, d):
    t = F.explode(F.array(F.concat(F.lit("b:"), "p_brand"), F.concat(F.lit("t:"), "p_type"), F.concat(F.lit("s:"), "p_size")))
    return table(spark, d, "part").select((F.col("p_partkey") - keys(spark, d, "part", "p_partkey")[0]).cast("int").alias("node"), t.alias("term")).distinct()


def links(spark, d):
    own = table(spark, d, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("id_a"), F.concat(F.lit("S"), "l_suppkey").alias("id_b"), F.lit(400).alias("score"))
    return annotations.network(own.repartition(tasks_for(own), "id_a", "id_b"))


def edge_tasks(spark, d):
    """How many tasks take on edges of links, which go both ways."""
    return 2 * tasks_for(table(spark, d, "lineitem"))


def names(spark, d):
    """Names of all parts and, after them, suppliers, and how many nodes that makes."""
    (part, n), (supplier, m) = keys(spark, d, "part", "p_partkey"), keys(spark, d, "supplier", "s_suppkey")
    own = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("id"), (F.col("p_partkey") - part).cast("int").alias("node"))
    return own.union(table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey"), (F.col("s_suppkey") - supplier + n).cast("int"))), n + m


# ---------------------------------------------------------------- sources


@query(f"WITH {CELLS} SELECT cell_id, condition, gene_idx, round(x, 6) AS x FROM cells")
def src1_matrix_long(spark, d):
    return rounded(cells(spark, d))


@query("SELECT count(*) AS n_obs, max(len(embedding))::BIGINT AS n_vars FROM embeddings")
def src2_matrix_extent(spark, d):
    return prepare.extent(table(spark, d, "embeddings"), "embedding")


@query(f"WITH {FOLDS} SELECT dataset, graph_type, seed, count(*) AS n, round(sum(pearson_r), 6) AS total FROM folds GROUP BY ALL")
def src3_result_documents(spark, d):
    """Folds written as nested JSON documents and read back."""
    folder = new_folder(spark, "documents")
    results.write_documents(kept(fold_table(spark, d), "folds"), folder)
    seeds = spark.read.schema(results.DOCUMENT).json(folder).select("dataset", "graph_type", F.explode("seeds").alias("seed", "s"))
    rows = seeds.select("dataset", "graph_type", F.regexp_replace("seed", "^seed_", "").cast("int").alias("seed"), F.explode("s.folds").alias("f"))
    return rounded(rows.groupBy("dataset", "graph_type", "seed").agg(F.count("*").alias("n"), F.sum("f.pearson_r").alias("total")))


NAMES = """names AS (SELECT CASE o_orderkey % 7 WHEN 0 THEN d || '__g.json' WHEN 1 THEN d || '__g_b__f' || a || '-' || b || '.json' WHEN 2 THEN d || '__g__s42f' || a || '-' || b || '.json' WHEN 3 THEN 'results_' || d || '.json' WHEN 4 THEN 'summary.csv' WHEN 5 THEN d || '__g__x.json' ELSE d || '.json' END AS file
  FROM (SELECT o_orderkey, 'd_' || o_custkey AS d, o_orderkey % 5 * 10 AS a, o_orderkey % 5 * 10 + 10 AS b FROM orders) t)"""


@query(f"""WITH {NAMES} SELECT file, split_part(replace(file, '.json', ''), '__', 1) AS dataset, CASE WHEN file NOT LIKE '%.json' OR starts_with(file, 'results_') OR len(string_split(file, '__')) < 2 THEN 'other'
  WHEN len(string_split(file, '__')) = 2 THEN 'merged' WHEN regexp_matches(file, '__(s\\d+)?f\\d+-\\d+\\.json$') THEN 'chunk' ELSE 'other' END AS kind,
  TRY_CAST(nullif(regexp_extract(file, '__s(\\d+)f', 1), '') AS INT) AS seed, TRY_CAST(nullif(regexp_extract(file, 'f(\\d+)-\\d+\\.json$', 1), '') AS INT) AS fold_start FROM names""")
def src4_src5_src6_file_names(spark, d):
    k, data, slice_ = F.col("o_orderkey"), F.concat(F.lit("d_"), "o_custkey"), F.concat(F.col("o_orderkey") % 5 * 10, F.lit("-"), F.col("o_orderkey") % 5 * 10 + 10, F.lit(".json"))
    tails = {0: ["__g.json"], 1: ["__g_b__f", slice_], 2: ["__g__s42f", slice_], 5: ["__g__x.json"], 6: [".json"]}
    file = F.when(k % 7 == 3, F.concat(F.lit("results_"), data, F.lit(".json"))).when(k % 7 == 4, "summary.csv")
    for i, tail in tails.items():
        file = file.when(k % 7 == i, F.concat(data, *[F.lit(x) if isinstance(x, str) else x for x in tail]))
    files = table(spark, d, "orders").select(file.alias("file")).withColumn("p", results.name_parts(F.col("file")))
    return files.select("file", "p.dataset", "p.kind", "p.seed", "p.fold_start")


def gaf_lines(spark, d, gene="p_brand"):
    """Annotation lines made of ``part``: comments, short lines and full ones."""
    p = table(spark, d, "part")
    fields = [F.lit("DB"), F.lit("id"), F.col(gene) if isinstance(gene, str) else gene, F.lit(""), F.col("p_type"), F.lit("r"), F.lit("e"), F.lit(""), F.when(F.col("p_size") % 2 == 0, "P").otherwise("F"), *[F.lit("x")] * 6]
    full = F.concat_ws("\t", *fields)
    return p.select(F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("!"), full)).when(F.col("p_partkey") % 10 == 1, "DB\tshort").otherwise(full).alias("value"))


@query("SELECT p_brand AS gene, p_type AS go_id, CASE WHEN p_size % 2 = 0 THEN 'P' ELSE 'F' END AS aspect, count(*) AS n FROM part WHERE p_partkey % 10 > 1 GROUP BY ALL")
def src7_annotation_text(spark, d):
    """Written as compressed text, read back and parsed."""
    folder = new_folder(spark, "gaf")
    gaf_lines(spark, d).write.option("compression", "gzip").text(folder)
    return annotations.read_gaf(spark, folder).groupBy("gene", "go_id", "aspect").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT p_size AS node, p_type AS term FROM part WHERE p_partkey % 10 > 1 AND p_size % 2 = 0 AND p_size % 3 > 0""")
def flt2_annotations_of_one_aspect(spark, d):
    """Process terms of the genes asked for, from annotation text; a gene goes by its size here, and a third aren't asked for."""
    p = table(spark, d, "part")
    text = gaf_lines(spark, d, F.concat(F.lit("G"), "p_size"))
    genes = p.where("p_size % 3 > 0").select(F.concat(F.lit("G"), "p_size").alias("gene"), F.col("p_size").alias("gene_idx")).distinct()
    return annotations.annotations(annotations.parse_gaf(text), genes)


@query("SELECT s_name AS gene, 'S' || s_suppkey AS string_id FROM supplier WHERE s_nationkey % 5 <> 0")
def src8_id_lookup(spark, d):
    s = table(spark, d, "supplier")
    return annotations.id_map(s.select(F.col("s_name").alias("queryItem"), F.when(F.col("s_nationkey") % 5 != 0, F.concat(F.lit("S"), "s_suppkey")).alias("stringId")))


@query("SELECT DISTINCT l_partkey AS id_a, l_suppkey AS id_b, 380 + l_quantity::INT AS score FROM lineitem WHERE 380 + l_quantity::INT >= 400")
def src9_network(spark, d):
    own = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id_a"), F.col("l_suppkey").alias("id_b"), (F.lit(380) + F.col("l_quantity").cast("int")).alias("score"))
    return annotations.network(own)


@query("""WITH lines AS (SELECT 'ds' || n_nationkey AS dataset, n_regionkey, n_nationkey FROM nation) SELECT dataset, 'g' || n_regionkey AS graph, 200 AS hvg, 42 AS seed, CASE WHEN n_nationkey % 2 = 0 THEN 0 END AS fold_start, CASE WHEN n_nationkey % 2 = 0 THEN 10 END AS fold_end FROM lines""")
def src12_task_lines(spark, d):
    n = table(spark, d, "nation")
    tail = F.when(F.col("n_nationkey") % 2 == 0, " 0 10").otherwise("")
    return grid.parsed(n.select(F.concat(F.lit("ds"), "n_nationkey", F.lit(" g"), "n_regionkey", F.lit(" 200 42"), tail).alias("value")))


# ---------------------------------------------------------------- preparation


@query("SELECT CASE WHEN count(*) FILTER (label = 0) > 0 THEN 'ctrl' END AS control FROM embeddings")
def prj2_control_label(spark, d):
    return prepare.control_label(labels(spark, d))


@query("SELECT 'P' || label AS condition, min(vec_id) AS first_ord, row_number() OVER (ORDER BY min(vec_id)) - 1 AS cond_ord FROM embeddings WHERE label <> 0 GROUP BY label")
def prj3_conditions(spark, d):
    return prepare.conditions(labels(spark, d), "ctrl").withColumn("cond_ord", F.col("cond_ord").cast("long"))


@query(f"WITH {CELLS}, best AS (SELECT gene_idx FROM cells GROUP BY 1 ORDER BY var_samp(x) DESC, gene_idx LIMIT 10) SELECT gene_idx, count(*) AS n, round(avg(x), 6) AS mean_x FROM cells WHERE gene_idx IN (SELECT gene_idx FROM best) GROUP BY 1")
def prj4_selected_genes(spark, d):
    own = cells(spark, d)
    kept = prepare.selected(own, prepare.most_variable(own, 10))
    return rounded(kept.groupBy("gene_idx").agg(F.count("*").alias("n"), F.avg("x").alias("mean_x")))


@query(f"WITH {CELLS} SELECT gene_idx, round(avg(x), 6) AS mean_x, round(stddev_pop(x) + 1e-8, 6) AS std_x FROM cells GROUP BY 1")
def agg1_gene_moments(spark, d):
    return rounded(prepare.gene_moments(cells(spark, d)))


@query(f"WITH {CELLS}, {MOMENTS}, {Z}, {PROFILES} SELECT condition, gene_idx, round(mean_x, 6) AS mean_x, n_cells FROM profiles")
def agg2_flt1_profiles(spark, d):
    return rounded(profiles(spark, d))


@query(f"WITH {CELLS}, {MOMENTS}, {Z} SELECT gene_idx, round(avg(x), 6) AS ctrl_x FROM z WHERE condition = 'ctrl' GROUP BY 1")
def agg3_control_profile(spark, d):
    z = prepare.z_scored(cells(spark, d))
    return rounded(z.where("condition = 'ctrl'").groupBy("gene_idx").agg(F.avg("x").alias("ctrl_x")))


@query(f"WITH {CELLS} SELECT round(max(x), 6) AS max_x, max(x) > 50 AS is_raw FROM cells WHERE cell_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 10)")
def agg13_raw_detector(spark, d):
    return rounded(prepare.raw_maximum(cells(spark, d)))


@query("""WITH w AS (SELECT vec_id AS cell_id, unnest(range(len(embedding)))::INT AS gene_idx, abs(unnest(embedding)::DOUBLE) AS x FROM embeddings), t AS (SELECT cell_id, sum(x) AS s FROM w GROUP BY 1)
SELECT cell_id, gene_idx, round(ln(1 + x / CASE WHEN s = 0 THEN 1 ELSE s END * 10000), 6) AS x FROM w JOIN t USING (cell_id)""")
def prp1_agg14_log_normalised(spark, d):
    own = table(spark, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    return rounded(prepare.long_view(prepare.log_normalised(own, "embedding"), "vec_id", "embedding"))


@query(f"WITH {CELLS}, {MOMENTS}, {Z} SELECT cell_id, gene_idx, round(x, 6) AS x FROM z")
def prp2_z_scores(spark, d):
    return rounded(prepare.z_scored(cells(spark, d)).select("cell_id", "gene_idx", "x"))


@query(f"WITH {CELLS} SELECT gene_idx, round(var_samp(x), 6) AS score, row_number() OVER (ORDER BY var_samp(x) DESC, gene_idx)::INT AS rank FROM cells GROUP BY 1 QUALIFY rank <= 20")
def top2_most_variable(spark, d):
    return rounded(prepare.most_variable(cells(spark, d), 20))


#: Variable genes by a smooth of log variance on log mean: 33 vertices at even ranks, each with the nearest 0.3 of all genes under tricube
#: weights, found by plain ranks of distances; a cubic between vertices. {0} has (gene_idx, x) of all cells.
STANDARDISED = """m AS (SELECT gene_idx, avg(x) AS mean_x, var_samp(x) AS var_x, count(*) AS n FROM {0} GROUP BY 1),
p AS (SELECT gene_idx, log10(mean_x) AS x, log10(var_x) AS y, row_number() OVER (ORDER BY log10(mean_x), gene_idx) - 1 AS i FROM m WHERE var_x > 0 AND mean_x > 0),
q AS (SELECT count(*) AS n, greatest(3, floor(count(*) * 0.3 + 1e-5)) AS k FROM p),
v AS (SELECT DISTINCT x AS v FROM p WHERE i IN (SELECT j * (n - 1) // 32 FROM q, range(33) t(j))),
h AS (SELECT v, d * 1.000001 AS h FROM (SELECT v, abs(x - v) AS d, row_number() OVER (PARTITION BY v ORDER BY abs(x - v)) AS r FROM v, p) z, q WHERE r = k),
near AS (SELECT v, h, y, (x - v) / h AS u, pow(1 - pow(abs(x - v) / h, 3), 3) AS w FROM h, p WHERE abs(x - v) < h),
s AS (SELECT v, h, sum(w) AS a, sum(w * u) AS b, sum(w * u * u) AS c, sum(w * u ** 3) AS d, sum(w * u ** 4) AS e, sum(w * y) AS f, sum(w * u * y) AS g, sum(w * u * u * y) AS k FROM near GROUP BY 1, 2),
f AS (SELECT v, (f * (c * e - d * d) - b * (g * e - d * k) + c * (g * d - c * k)) / t AS f0, (a * (g * e - d * k) - f * (b * e - c * d) + c * (b * k - c * g)) / t / h AS g0
  FROM (SELECT *, a * (c * e - d * d) - b * (b * e - c * d) + c * (b * d - c * c) AS t FROM s)),
c AS (SELECT v AS lo, f0, g0, lead(v) OVER l AS hi, lead(f0) OVER l AS f1, lead(g0) OVER l AS g1 FROM f WINDOW l AS (ORDER BY v)),
e AS (SELECT gene_idx, pow(10, ((1 - t) ** 2 * ((1 + 2 * t) * f0 + t * (hi - lo) * g0) + t * t * ((3 - 2 * t) * f1 - (1 - t) * (hi - lo) * g1)) / 2) AS spread
  FROM (SELECT p.gene_idx, c.*, (p.x - lo) / (hi - lo) AS t FROM p JOIN c ON p.x >= lo AND (p.x < hi OR p.x = hi AND hi = (SELECT max(v) FROM v)))),
scores AS (SELECT gene_idx, coalesce(sum((least(x, mean_x + sqrt(n) * spread) - mean_x) ** 2) / ((max(n) - 1) * max(spread) ** 2), 0) AS score FROM {0} JOIN m USING (gene_idx) LEFT JOIN e USING (gene_idx) GROUP BY 1)
SELECT gene_idx, round(score, 4) AS score, (row_number() OVER (ORDER BY score DESC, gene_idx))::INT AS rank FROM scores QUALIFY rank <= 20"""


@query(f"WITH {CELLS}, a AS (SELECT gene_idx, abs(x) AS x FROM cells), {STANDARDISED.format('a')}")
def hvg1_standardised(spark, d):
    return rounded(prepare.most_variable_standardised(cells(spark, d).withColumn("x", F.abs("x")), 20), 4)


@query(f"""WITH w AS (SELECT vec_id AS cell_id, CASE WHEN label = 0 THEN 'ctrl' ELSE 'P' || label END AS condition, unnest(range(len(embedding)))::INT AS gene_idx, abs(unnest(embedding)::DOUBLE) * 1000 AS x FROM embeddings),
raw AS (SELECT max(x) > 50 AS is_raw FROM w WHERE cell_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 10)), t AS (SELECT cell_id, sum(x) AS s FROM w GROUP BY 1),
n AS (SELECT cell_id, condition, gene_idx, CASE WHEN is_raw THEN ln(1 + x / CASE WHEN s = 0 THEN 1 ELSE s END * 10000) ELSE x END AS x FROM w JOIN t USING (cell_id), raw),
cells AS (SELECT * FROM n WHERE gene_idx IN (SELECT gene_idx FROM n GROUP BY 1 ORDER BY var_samp(x) DESC, gene_idx LIMIT 20)), {MOMENTS}, {Z}, {PROFILES}
SELECT condition, gene_idx, round(mean_x, 5) AS mean_x, n_cells FROM profiles""")
def prp3_prepared(spark, d):
    """The whole preparation: raw counts are told, normalised and logged, genes chosen, scores standardised, profiles taken."""
    own = wide(spark, d).withColumn("embedding", F.transform("embedding", lambda x: F.abs(x.cast("double")) * 1000))
    return rounded(prepare.prepared(own, "vec_id", "embedding", "condition", 20, prepare.most_variable), 5)


#: Sparse counts: what of the fixture matrix is at most 0.1 is zero. SQL has all zeros as rows, the queries none.
COUNTS = """w AS (SELECT vec_id AS cell_id, CASE WHEN label = 0 THEN 'ctrl' ELSE 'P' || label END AS condition, unnest(range(len(embedding)))::INT AS gene_idx, CASE WHEN unnest(embedding)::DOUBLE > 0.1 THEN unnest(embedding)::DOUBLE * 1000 ELSE 0 END AS x FROM embeddings),
t AS (SELECT cell_id, sum(x) AS s FROM w GROUP BY 1), n AS (SELECT cell_id, condition, gene_idx, ln(1 + x / CASE WHEN s = 0 THEN 1 ELSE s END * 10000) AS x FROM w JOIN t USING (cell_id))"""


def counts(spark, d):
    return sparse.sparse(wide(spark, d).withColumn("embedding", F.transform("embedding", lambda x: F.when(x.cast("double") > 0.1, x.cast("double") * 1000).otherwise(0.0))), "embedding")


@query(f"WITH {COUNTS} SELECT cell_id, condition, gene_idx, round(x, 6) AS x FROM w WHERE x <> 0")
def src1_sparse_matrix(spark, d):
    return rounded(sparse.nonzeros(counts(spark, d), "vec_id", "indices", "embedding", "condition"))


@query(f"WITH {COUNTS} SELECT cell_id, gene_idx, round(x, 6) AS x FROM n WHERE x <> 0")
def prp1_sparse_log_normalised(spark, d):
    return rounded(sparse.nonzeros(prepare.log_normalised(counts(spark, d), "embedding"), "vec_id", "indices", "embedding"))


@query(f"WITH {COUNTS} SELECT gene_idx, round(avg(x), 6) AS mean_x, round(stddev_pop(x) + 1e-8, 6) AS std_x, round(var_samp(x), 6) AS var_x FROM n GROUP BY 1")
def agg1_sparse_moments(spark, d):
    own = counts(spark, d)
    n_cells, n_genes = sparse.extent(own, "indices", "embedding")
    return rounded(sparse.moments(sparse.nonzeros(prepare.log_normalised(own, "embedding"), "vec_id", "indices", "embedding"), n_cells, n_genes))


@query(f"WITH {COUNTS} SELECT round(max(x), 6) AS max_x, max(x) > 50 AS is_raw FROM w WHERE cell_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 10)")
def agg13_sparse_raw_detector(spark, d):
    return rounded(sparse.raw_maximum(counts(spark, d), "vec_id", "indices", "embedding", GENES))


@query(f"WITH {COUNTS}, {STANDARDISED.format('n')}")
def hvg1_sparse_standardised(spark, d):
    """Variable genes from sparse counts, logged; SQL takes the dense path."""
    own = prepare.log_normalised(counts(spark, d), "embedding")
    n_cells, n_genes = sparse.extent(own, "indices", "embedding")
    return rounded(sparse.most_variable_standardised(sparse.nonzeros(own, "vec_id", "indices", "embedding"), n_cells, n_genes, 20), 4)


@query(f"""WITH {COUNTS}, cells AS (SELECT * FROM n WHERE gene_idx IN (SELECT gene_idx FROM n GROUP BY 1 ORDER BY var_samp(x) DESC, gene_idx LIMIT 20)), {MOMENTS}, {Z}, {PROFILES}
SELECT condition, gene_idx, round(mean_x, 5) AS mean_x, n_cells FROM profiles""")
def prp3_sparse_prepared(spark, d):
    """The whole preparation from sparse counts; SQL takes the dense path."""
    return rounded(sparse.prepared(counts(spark, d), "vec_id", "indices", "embedding", "condition", 20), 5)


@query(f"WITH {CELLS}, {MOMENTS}, {Z}, {PROFILES}, {DELTAS} SELECT condition, gene_idx, round(delta, 6) AS delta FROM deltas")
def jn5_control_deltas(spark, d):
    return rounded(deltas(spark, d))


@query(f"WITH {CELLS}, {MOMENTS}, {Z}, {PROFILES}, {DELTAS} SELECT condition, gene_idx, round(delta, 6) AS delta FROM deltas QUALIFY row_number() OVER (PARTITION BY condition ORDER BY abs(delta) DESC, gene_idx DESC) <= 20")
def top1_strongest_genes(spark, d):
    return rounded(metrics.top(deltas(spark, d), "delta", metrics.TOP, "condition"))


# ---------------------------------------------------------------- folds and metrics


@query("""WITH c AS (SELECT DISTINCT 'P' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '+P' || (p_partkey + 1) WHEN 1 THEN ' + ctrl' WHEN 2 THEN '' ELSE '+nobody' END AS condition FROM part),
t AS (SELECT condition, trim(unnest(string_split(condition, '+'))) AS gene FROM c), g AS (SELECT 'P' || p_partkey AS gene, (p_partkey - 1)::INT AS gene_idx FROM part WHERE p_partkey % 3 <> 0)
SELECT condition, string_agg(DISTINCT gene_idx::VARCHAR, ',' ORDER BY gene_idx::VARCHAR) AS genes FROM t LEFT JOIN g USING (gene) GROUP BY 1""")
def jn4_perturbation_masks(spark, d):
    k, p = F.col("p_partkey"), table(spark, d, "part")
    tail = F.when(k % 4 == 0, F.concat(F.lit("+P"), k + 1)).when(k % 4 == 1, " + ctrl").when(k % 4 == 2, "").otherwise("+nobody")
    genes = p.where(k % 3 != 0).select(F.concat(F.lit("P"), k).alias("gene"), (k - 1).cast("int").alias("gene_idx"))
    found = lopo.masks(p.select(F.concat(F.lit("P"), k, tail).alias("condition")), genes)
    return found.select("condition", F.when(F.col("genes").isNotNull(), F.array_join(F.array_sort(F.transform("genes", lambda g: g.cast("string"))), ",")).alias("genes"))


@query("""WITH c AS (SELECT 'P' || label AS condition, row_number() OVER (ORDER BY min(vec_id)) - 1 AS cond_ord FROM embeddings WHERE label <> 0 GROUP BY label)
SELECT f.condition AS fold, c.condition FROM c JOIN c f ON f.condition <> c.condition WHERE f.cond_ord >= 2 AND f.cond_ord < 6""")
def flt7_flt8_lim1_folds(spark, d):
    own = prepare.conditions(labels(spark, d), "ctrl")
    return lopo.training_sets(lopo.slices(own, 50, 2, 6), own)


@query(f"""WITH {CELLS}, {MOMENTS}, {Z}, {PROFILES}, {DELTAS}, {PREDICTED} SELECT condition,
  round(CASE WHEN stddev_pop(t) > 1e-8 AND stddev_pop(p) > 1e-8 THEN covar_pop(t, p) / (stddev_pop(t) * stddev_pop(p)) ELSE 0 END, 6) AS pearson_r,
  round(CASE WHEN stddev_pop(t) > 1e-8 AND stddev_pop(p) > 1e-8 THEN covar_pop(rt, rp) / (stddev_pop(rt) * stddev_pop(rp)) ELSE 0 END, 6) AS spearman_rho,
  round(avg((t - p) * (t - p)), 6) AS mse, round(count(*) FILTER (kt AND kp) / count(*) FILTER (kt OR kp)::DOUBLE, 6) AS jaccard FROM ranked GROUP BY 1""")
def st1_st2_st3_st4_fold_metrics(spark, d):
    return rounded(metrics.fold_metrics(lopo.mean_of_others(deltas(spark, d)), "condition"))


@query("""WITH s AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS a, list(DISTINCT l_suppkey) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0)::DOUBLE, 0), 6) AS jaccard FROM s""")
def set5_jaccard(spark, d):
    sets = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("a"), F.collect_set("l_suppkey").alias("b"))
    return rounded(sets.select("l_orderkey", metrics.jaccard(F.col("a"), F.col("b")).alias("jaccard")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_orderkey, l_quantity) - 1) / 2.0 AS avg_rank FROM lineitem")
def win2_average_rank(spark, d):
    own = dealt((table(spark, d, "lineitem"), "l_orderkey"))[0]
    return own.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", metrics.average_rank("l_quantity", "l_orderkey").alias("avg_rank"))


@query("""WITH r AS (SELECT user_id, event_id, value, row_number() OVER w - 1 AS fold, avg(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS trailing_mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, fold::INT AS fold, round(trailing_mean, 6) AS trailing_mean FROM r WHERE fold % 5 = 4""")
def win1_trailing_mean(spark, d):
    own = rollup.trailing_mean(table(spark, d, "events"), "value", ["ts", "event_id"], "user_id")
    return rounded(own.select("user_id", "event_id", "fold", "trailing_mean"))


# ---------------------------------------------------------------- graphs


@query(f"WITH {CORRELATED} SELECT a, b, round(r, 6) AS r FROM co")
def jn3_gene_correlations(spark, d):
    return rounded(graphs.correlations(table(spark, d, "embeddings"), "embedding"))


@query(f"WITH {CORRELATED}, e AS (SELECT a, b FROM co WHERE abs(r) > 0.1 AND NOT isnan(r)) SELECT a AS src, b AS dst FROM e UNION SELECT b, a FROM e UNION SELECT i::INT, i::INT FROM range({GENES}) t(i)")
def gr3_flt4_coexpression(spark, d):
    return graphs.coexpression(table(spark, d, "embeddings"), "embedding", GENES, 0.1)


@query(f"WITH {SHARED} SELECT src, dst FROM shared UNION SELECT i, i FROM (SELECT unnest(range({PARTS}))::INT AS i) t")
def gr2_jn2_flt3_shared_terms(spark, d):
    return graphs.with_loops(graphs.shared_terms(annotated(spark, d)), keys(spark, d, "part", "p_partkey")[1])


@query(f"WITH {LOOKUP} SELECT src, dst FROM looked UNION SELECT dst, src FROM looked UNION SELECT i, i FROM (SELECT unnest(range({ENDS}))::INT AS i) t")
def gr1_jn1_lookup_graph(spark, d):
    known, n = names(spark, d)
    k = edge_tasks(spark, d)
    return graphs.with_loops(graphs.looked_up(links(spark, d), known, tasks=k), n, k)


@query(f"WITH {SHARED}, {LOOKUP} SELECT src, dst FROM shared UNION SELECT src, dst FROM looked UNION SELECT dst, src FROM looked UNION SELECT i, i FROM (SELECT unnest(range({ENDS}))::INT AS i) t")
def gr4_set1_combined(spark, d):
    known, n = names(spark, d)
    k = edge_tasks(spark, d)
    return graphs.combined(graphs.with_loops(graphs.shared_terms(annotated(spark, d)), n), graphs.with_loops(graphs.looked_up(links(spark, d), known, tasks=k), n, k), tasks=k)


@query(f"WITH {SHARED}, e AS (SELECT src, dst FROM shared UNION SELECT i, i FROM (SELECT unnest(range({PARTS}))::INT AS i) t) SELECT round(count(*) / {PARTS}::DOUBLE, 6) AS avg_degree FROM e")
def agg11_average_degree(spark, d):
    n = keys(spark, d, "part", "p_partkey")[1]
    return rounded(graphs.average_degree(graphs.with_loops(graphs.shared_terms(annotated(spark, d)), n), n))


@query(f"WITH {SHARED} SELECT count(*) AS n_edges, count(*) > 0 AND (SELECT count(DISTINCT node) >= 10 FROM ann) AS available FROM shared")
def flt5_availability(spark, d):
    own = annotated(spark, d)
    return graphs.available(graphs.shared_terms(own), own.select("node"))


@query(f"WITH {LOOKUP} SELECT src, dst FROM looked WHERE src <> dst UNION SELECT dst, src FROM looked WHERE src <> dst")
def set2_symmetrised(spark, d):
    return graphs.mirrored(graphs.looked_up(links(spark, d), names(spark, d)[0], tasks=edge_tasks(spark, d)).where("src < dst"))


@query(f"SELECT i AS src, i AS dst FROM (SELECT unnest(range({PARTS}))::INT AS i) t")
def gr6_set3_loops_only(spark, d):
    return graphs.with_loops(graphs.empty(spark), keys(spark, d, "part", "p_partkey")[1])


@query()
def gr5_preferential(spark, d):
    return graphs.preferential(spark, GENES, 6.0)


@query()
def gr7_all_graphs(spark, d):
    own = annotated(spark, d).where(F.col("node") < GENES)  # the matrix has no other features
    near = names(spark, d)[0].withColumn("node", F.pmod("node", F.lit(GENES)).cast("int"))
    built = graphs.build_all(table(spark, d, "embeddings"), "embedding", GENES, own, links(spark, d), near, 0.1)
    parts = [g.groupBy().agg(F.count("*").alias("n_edges")).select(F.lit(k).alias("graph"), "n_edges") for k, g in built.items()]
    return rollup.concatenated(*parts)


# ---------------------------------------------------------------- rollups and merging


@query(f"WITH {FOLDS} SELECT dataset, graph_type, seed, round(avg(pearson_r), 6) AS pearson_mean, round(stddev_pop(pearson_r), 6) AS pearson_std, round(avg(spearman_rho), 6) AS spearman_mean, round(avg(jaccard), 6) AS jaccard_mean, round(avg(mse), 6) AS mse_mean, count(*) AS n_folds FROM folds GROUP BY ALL")
def agg4_seed_summary(spark, d):
    return rounded(rollup.seed_summary(fold_table(spark, d), "dataset", "graph_type"))


@query(f"""WITH {FOLDS} SELECT dataset, graph_type, round(avg(pearson_r), 6) AS pearson_mean, round(stddev_pop(pearson_r), 6) AS pearson_std, round(avg(spearman_rho), 6) AS spearman_mean, round(stddev_pop(spearman_rho), 6) AS spearman_std,
  round(avg(mse), 6) AS mse_mean, round(stddev_pop(mse), 6) AS mse_std, round(avg(jaccard), 6) AS jaccard_mean, round(stddev_pop(jaccard), 6) AS jaccard_std, count(*) AS n_total_folds, count(DISTINCT seed) AS n_seeds FROM folds GROUP BY 1, 2""")
def agg5_agg6_overall(spark, d):
    return rounded(rollup.overall(fold_table(spark, d), "dataset", "graph_type"))


@query(f"WITH {FOLDS} SELECT dataset, graph_type, seed, round(avg(pearson_r), 6) AS pearson_mean, round(stddev_pop(pearson_r), 6) AS pearson_std, count(*) AS n_folds FROM folds GROUP BY GROUPING SETS ((dataset, graph_type), (dataset, graph_type, seed))")
def agg4_agg5_grouping_sets(spark, d):
    return rounded(rollup.both_levels(fold_table(spark, d)))


@query("SELECT o_custkey, max(CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE 2 END)::BIGINT AS n_folds FROM orders GROUP BY 1")
def agg7_fn9_most_folds(spark, d):
    chunks = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.lit(7).cast("long")).alias("n_folds"), F.array(F.lit("a"), F.lit("b")).alias("folds"))
    return rollup.most_folds(chunks, "o_custkey")


@query("SELECT o_orderpriority AS label FROM orders GROUP BY 1 ORDER BY count(*) DESC, min(o_orderkey) LIMIT 1")
def agg8_mode(spark, d):
    own = table(spark, d, "orders").select(F.col("o_orderpriority").alias("condition"), F.col("o_orderkey").alias("row_ord"))
    return prepare.control_label(own).withColumnRenamed("control", "label")


@query(f"WITH {ANNOTATIONS} SELECT term, count(DISTINCT node) AS n_genes, string_agg(node::VARCHAR, ',' ORDER BY node) AS genes FROM ann GROUP BY 1")
def agg9_term_genes(spark, d):
    own = annotated(spark, d).groupBy("term").agg(F.array_sort(F.collect_set("node")).alias("g"))
    return own.select("term", F.size("g").cast("long").alias("n_genes"), F.array_join(F.transform("g", lambda x: x.cast("string")), ",").alias("genes"))


#: Short, so that the tables have terms of several blocks.
POSTING = 64


@query(f"""WITH {ANNOTATIONS}, t AS (SELECT term, count(*) AS total FROM ann GROUP BY 1)
SELECT term, CASE WHEN total <= {POSTING} THEN 0 ELSE node // {POSTING} END::BIGINT AS block, total::BIGINT AS total, string_agg(node::VARCHAR, ',' ORDER BY node) AS genes FROM ann JOIN t USING (term) GROUP BY 1, 2, 3""")
def agg9_term_blocks(spark, d):
    own = postings.blocks(annotated(spark, d), POSTING)
    return own.select("term", "block", "total", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ",").alias("genes"))


@query(f"WITH {SHARED} SELECT src, dst FROM shared WHERE src < dst")
def jn2_term_block_pairs(spark, d):
    """Terms of up to 100 nodes over blocks of 64: some lists are one block, some meet across blocks."""
    return postings.pairs(postings.blocks(annotated(spark, d), POSTING), graphs.BROADEST_TERM, POSTING)


DEDUPED = "SELECT dataset, graph_type, hvg, seed, condition, pearson_r, spearman_rho, mse, jaccard, row_number() OVER (PARTITION BY dataset, graph_type, hvg, seed, condition ORDER BY {} pearson_r, spearman_rho, mse, jaccard) AS rn FROM"


@query(f"""WITH {FOLDS}, both_ AS (SELECT 0 AS source, * FROM folds WHERE seed < 45 UNION ALL SELECT 1, * FROM folds WHERE seed > 43), r AS ({DEDUPED.format('source,')} both_)
SELECT * EXCLUDE (rn) FROM r WHERE rn = 1""")
def jn8_jn9_merged(spark, d):
    own = fold_table(spark, d)
    return rollup.merged(own.where("seed < 45"), own.where("seed > 43"))


@query(f"""WITH {FOLDS}, both_ AS (SELECT 0 AS source, * FROM folds WHERE seed < 45 UNION ALL SELECT 1, * FROM folds WHERE seed > 43), r AS ({DEDUPED.format('source,')} both_)
SELECT * EXCLUDE (rn) FROM r WHERE rn = 1""")
def jn9_merged_folder(spark, d):
    """Merged documents and two slices of chunks as files; one slice is written again; then the folder is scanned and merged."""
    folder, own = new_folder(spark, "chunks"), kept(fold_table(spark, d), "folds")
    start = F.pmod(F.substring("condition", 2, 20).cast("long"), F.lit(2)).cast("int") * 25
    chunks = own.where("seed > 43").withColumn("fold_start", start).withColumn("fold_end", start + 25)
    none = F.lit(None).cast("int")
    results.write_chunks(own.where("seed < 45").withColumn("fold_start", none).withColumn("fold_end", none).unionByName(chunks), folder)
    results.write_chunks(chunks.where("fold_start = 25"), folder)
    return results.merged_folder(spark, folder)


@query(f"""WITH {FOLDS}, old AS (SELECT * FROM folds WHERE seed < 45), new AS (SELECT * FROM folds WHERE seed > 43)
SELECT dataset, graph_type, seed, count(*) AS n FROM (SELECT * FROM old UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.dataset = n.dataset AND o.graph_type = n.graph_type AND o.hvg = n.hvg AND o.seed = n.seed AND o.condition = n.condition)) t GROUP BY ALL""")
def jn8_appended(spark, d):
    own = fold_table(spark, d)
    return rollup.appended(own.where("seed < 45"), own.where("seed > 43")).groupBy("dataset", "graph_type", "seed").agg(F.count("*").alias("n"))


@query(f"WITH {FOLDS}, both_ AS (SELECT * FROM folds UNION ALL SELECT * FROM folds WHERE seed = 42) SELECT seed, count(*) AS n FROM both_ GROUP BY 1")
def set7_concatenated(spark, d):
    own = fold_table(spark, d)
    return rollup.concatenated(own, own.where("seed = 42")).groupBy("seed").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS k FROM lineitem UNION SELECT s_suppkey FROM supplier")
def set6_key_union(spark, d):
    return graphs.combined(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.lit(0).alias("dst")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), F.lit(0).alias("dst"))).select(F.col("src").alias("k"))


@query(f"WITH {FOLDS}, s AS (SELECT dataset, graph_type, hvg, seed, count(*) AS n_folds FROM folds GROUP BY ALL) SELECT * FROM s WHERE n_folds >= 50")
def flt12_complete(spark, d):
    return rollup.complete(fold_table(spark, d).groupBy("dataset", "graph_type", "hvg", "seed").agg(F.count("*").alias("n_folds")))


LACKING = "NOT (graph_type = 'gene_ontology' AND hvg = 1000) AND NOT (dataset = 'A' AND hvg = 500)"


@query(f"WITH {FOLDS} SELECT dataset, graph_type FROM folds WHERE hvg = 200 AND {LACKING} INTERSECT SELECT dataset, graph_type FROM folds WHERE hvg = 500 AND {LACKING} INTERSECT SELECT dataset, graph_type FROM folds WHERE hvg = 1000 AND {LACKING}")
def set4_on_all_scales(spark, d):
    """A graph and a dataset lack a scale."""
    return rollup.on_all_scales(fold_table(spark, d).where(LACKING))


SHOWN = ", ".join(f"round({f}({c}), {6 if c == 'mse' else 4}) AS {c.split('_')[0]}_{n}" for c in ("pearson_r", "spearman_rho", "jaccard", "mse") for f, n in (("avg", "mean"), ("stddev_pop", "std")))


@query(f"WITH {FOLDS} SELECT dataset, graph_type, {SHOWN}, count(*) AS n_total_folds, count(DISTINCT seed) AS n_seeds FROM folds GROUP BY 1, 2")
def snk4_summary(spark, d):
    """Written as CSV with a header and read back, all columns."""
    folder = new_folder(spark, "summary")
    results.write_table(results.summary(fold_table(spark, d)), folder)
    back = spark.read.option("header", True).csv(folder)
    return back.select("dataset", "graph_type", *[F.col(c).cast("double").alias(c) for c in back.columns if c.endswith(("_mean", "_std"))], *[F.col(c).cast("long").alias(c) for c in ("n_total_folds", "n_seeds")])


@query(f"""WITH {FOLDS}, both_ AS (SELECT * FROM folds WHERE seed <> 44 UNION ALL SELECT * FROM folds WHERE seed = 44 AND mse > 0.5)
SELECT hvg, dataset, graph_type, seed, count(*) AS n_folds, count(DISTINCT condition) AS n_conditions, round(avg(pearson_r), 6) AS pearson_mean FROM both_ GROUP BY ALL""")
def snk1_keyed_store(spark, d):
    """Folds stored by key, keys of one seed run again with fewer folds, and the manifest that then stands."""
    folder, own = new_folder(spark, "store"), fold_table(spark, d)
    store.write(own, folder)
    store.write(own.where("seed = 44 AND mse > 0.5"), folder)
    return rounded(store.manifest(spark, folder))


@query(f"""WITH {FOLDS} SELECT hvg, dataset, graph_type, seed, round(avg(pearson_r), 6) AS pearson_mean, round(avg(spearman_rho), 6) AS spearman_mean, round(avg(jaccard), 6) AS jaccard_mean, round(avg(mse), 6) AS mse_mean, round(stddev_pop(pearson_r), 6) AS pearson_std,
  count(*)::INT AS n_folds, count(*) AS n_rows, round(sum(pearson_r), 6) AS total FROM folds GROUP BY ALL""")
def snk3_key_documents(spark, d):
    """A JSON document a key, read back, with its folds as rows."""
    folder = new_folder(spark, "key-documents")
    store.write_documents(fold_table(spark, d), folder)
    own = spark.read.schema(store.key_documents(fold_table(spark, d)).schema).json(folder)
    rows = own.select(*[c for c in own.columns if c != "folds"], F.explode("folds").alias("f"))
    return rounded(rows.groupBy(*[c for c in own.columns if c != "folds"]).agg(F.count("*").alias("n_rows"), F.sum("f.pearson_r").alias("total")))


@query(f"""WITH {FOLDS}, both_ AS (SELECT 0 AS source, * FROM folds WHERE seed < 45 UNION ALL SELECT 1, * FROM folds WHERE seed > 43 AND hvg < 1000 UNION ALL SELECT 2, * FROM folds WHERE seed > 46), r AS ({DEDUPED.format('source,')} both_)
SELECT * EXCLUDE (rn) FROM r WHERE rn = 1""")
def jn8_incremental_merge(spark, d):
    """Three batches that overlap, the second one replayed, merged into the store."""
    folder, own = new_folder(spark, "merged"), kept(fold_table(spark, d), "folds")
    parts = [own.where("seed < 45"), own.where("seed > 43 AND hvg < 1000"), own.where("seed > 46")]
    for number in (0, 1, 1, 2):
        store.merge_batch(parts[number], number, folder)
    return store.merged(spark, folder).drop("batch")


@query()
def snk5_report_tables(spark, d):
    """The five statistics tables written as CSV and read back, a row a cell: table, its first columns, column and value."""
    folder, tables = new_folder(spark, "report"), stats.report_tables(fold_table(spark, d))
    results.write_report(tables, folder)
    parts = []
    for name, rows in tables.items():
        back, n = spark.read.option("header", True).csv(f"{folder}/{name}.csv"), 2 if name == "paper_summary_table" else 3
        cell = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in rows.columns[n:]])).alias("e")
        parts.append(back.select(F.lit(name).alias("table"), F.concat_ws(" ", *rows.columns[:n]).alias("key"), cell).select("table", "key", "e.column", "e.value"))
    return rollup.concatenated(*parts)


# ---------------------------------------------------------------- statistics

PAIRED = """n AS (SELECT *, row_number() OVER (PARTITION BY dataset, graph_type, hvg ORDER BY seed, condition, pearson_r, spearman_rho, mse, jaccard) AS rn FROM folds),
c AS (SELECT * FROM (VALUES ('string_ppi', 'no_graph'), ('gene_ontology', 'no_graph'), ('combined', 'no_graph'), ('random', 'no_graph'), ('string_ppi', 'random'), ('combined', 'random')) t(g1, g2)),
p AS (SELECT a.dataset, a.hvg, g1, g2, a.rn, a.pearson_r AS a, b.pearson_r AS b FROM n a JOIN c ON a.graph_type = g1 JOIN n b ON b.graph_type = g2 AND b.dataset = a.dataset AND b.hvg = a.hvg AND b.rn = a.rn)"""


@query(f"WITH {FOLDS}, {PAIRED} SELECT dataset, hvg, g1, g2, count(*) AS n, round(sum(a), 6) AS a, round(sum(b), 6) AS b, round(sum(a * b), 6) AS ab FROM p GROUP BY ALL")
def jn6_jn7_paired_folds(spark, d):
    own = stats.paired(fold_table(spark, d)).groupBy("dataset", "hvg", "g1", "g2")
    return rounded(own.agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") * F.col("b")).alias("ab")))


@query(f"WITH {FOLDS}, {PAIRED} SELECT dataset, hvg, g1, g2, round(avg(a - b) / (stddev_pop(a - b) + 1e-10), 6) AS cohens_d, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) AS t FROM p GROUP BY ALL")
def st8_st10_effect_and_t(spark, d):
    x = F.col("a") - F.col("b")
    return rounded(stats.paired(fold_table(spark, d)).groupBy("dataset", "hvg", "g1", "g2").agg(stats.cohen(x).alias("cohens_d"), stats.paired_t(x).alias("t")))


@query(f"""WITH {FOLDS}, {PAIRED}, x AS (SELECT dataset, hvg, g1, g2, a - b AS d FROM p WHERE a - b <> 0), r AS (SELECT *, rank() OVER (PARTITION BY dataset, hvg, g1, g2 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY dataset, hvg, g1, g2, abs(d)) - 1) / 2.0 AS k FROM x)
SELECT dataset, hvg, g1, g2, least(coalesce(sum(k) FILTER (d > 0), 0), sum(k) - coalesce(sum(k) FILTER (d > 0), 0)) AS w, count(*) AS n_nonzero FROM r GROUP BY ALL""")
def st11_signed_ranks(spark, d):
    return stats.wilcoxon(stats.paired(fold_table(spark, d))).select("dataset", "hvg", "g1", "g2", "w", "n_nonzero")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_discount, least(l_discount * (SELECT count(*) FROM lineitem), 1.0) AS p_bonf FROM lineitem")
def st12_bonferroni(spark, d):
    own = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_discount")
    return stats.bonferroni(own, "l_discount")


@query("""WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_discount, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS k, count(*) OVER () AS m FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_discount, round(least(l_discount * m / k, 1.0), 6) AS p_fdr FROM r""")
def st13_false_discovery(spark, d):
    own = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_discount")
    return rounded(stats.false_discovery(own, "l_discount")).select("l_orderkey", "l_partkey", "l_suppkey", "l_discount", "p_fdr")


ANOVA = """g AS (SELECT dataset, hvg, graph_type, count(*) AS n, avg(pearson_r) AS m, var_pop(pearson_r) AS v FROM folds GROUP BY ALL),
s AS (SELECT dataset, hvg, count(*) AS k, sum(n) AS n, sum(n * m * m) - sum(n) * power(sum(n * m) / sum(n), 2) AS ssb, sum(n * v) AS ssw FROM g GROUP BY 1, 2)"""


@query(f"WITH {FOLDS}, {ANOVA} SELECT dataset, hvg, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS statistic, k AS n_groups FROM s")
def st6_anova(spark, d):
    return rounded(stats.anova(fold_table(spark, d)).select("dataset", "hvg", "statistic", "n_groups"))


@query(f"""WITH {FOLDS}, r AS (SELECT *, rank() OVER (PARTITION BY dataset, hvg ORDER BY pearson_r) + (count(*) OVER (PARTITION BY dataset, hvg, pearson_r) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY dataset, hvg) AS n FROM folds),
t AS (SELECT dataset, hvg, sum(c * c * c - c) AS ties FROM (SELECT dataset, hvg, pearson_r, count(*)::DOUBLE AS c FROM folds GROUP BY ALL) q GROUP BY 1, 2),
g AS (SELECT dataset, hvg, graph_type, sum(k) AS s, count(*) AS c, any_value(n)::DOUBLE AS n FROM r GROUP BY 1, 2, 3)
SELECT dataset, hvg, round((12 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / c) - 3 * (any_value(n) + 1)) / (1 - any_value(ties) / (power(any_value(n), 3) - any_value(n))), 6) AS statistic, count(*) AS n_groups FROM g JOIN t USING (dataset, hvg) GROUP BY 1, 2""")
def st7_kruskal(spark, d):
    return rounded(stats.kruskal(fold_table(spark, d)).select("dataset", "hvg", "statistic", "n_groups"))


@query(f"""WITH {FOLDS}, side AS (SELECT *, row_number() OVER (PARTITION BY dataset, graph_type, hvg ORDER BY seed, condition, pearson_r, spearman_rho, mse, jaccard) AS rn, count(*) OVER (PARTITION BY dataset, graph_type, hvg) AS n FROM folds),
k AS (SELECT dataset, graph_type AS graph, hvg, pearson_r, rn, n FROM side WHERE graph_type IN ('string_ppi', 'combined')), b AS (SELECT dataset, hvg, pearson_r, rn, n FROM side WHERE graph_type = 'no_graph'),
cut AS (SELECT dataset, graph, hvg, least(max(k.n), max(b.n)) AS n FROM k JOIN b USING (dataset, hvg) WHERE k.rn = 1 AND b.rn = 1 GROUP BY 1, 2, 3)
SELECT dataset, graph, hvg, round((SELECT avg(pearson_r) FROM k WHERE k.dataset = c.dataset AND k.graph = c.graph AND k.hvg = c.hvg AND rn <= c.n) - (SELECT avg(pearson_r) FROM b WHERE b.dataset = c.dataset AND b.hvg = c.hvg AND rn <= c.n), 6) AS delta_pearson,
  (SELECT round(avg(k.pearson_r - b.pearson_r) / (stddev_pop(k.pearson_r - b.pearson_r) + 1e-10), 4) FROM k JOIN b ON k.rn = b.rn WHERE k.dataset = c.dataset AND k.graph = c.graph AND k.hvg = c.hvg AND b.dataset = c.dataset AND b.hvg = c.hvg) AS cohens_d FROM cut c""")
def st15_scale_effect(spark, d):
    return stats.scale_effect(fold_table(spark, d))


@query(f"""WITH {FOLDS}, q AS (SELECT dataset, hvg, graph_type, count(*) AS n, printf('%.3f±%.3f', avg(pearson_r), stddev_pop(pearson_r)) AS v FROM folds GROUP BY ALL) SELECT dataset, hvg,
  {', '.join(f"coalesce(max(v) FILTER (graph_type = '{g}'), '—') AS {g}" for g in stats.GRAPHS)} FROM q GROUP BY 1, 2""")
def st16_fn6_paper_table(spark, d):
    return stats.paper_table(fold_table(spark, d))


@query(f"WITH {FOLDS} SELECT dataset, hvg, graph_type, round(avg(mse), 6) AS mean_mse, round(median(mse), 6) AS median_mse, round(max(mse), 6) AS max_mse FROM folds GROUP BY ALL HAVING avg(mse) > 0.5")
def flt10_st17_agg10_anomalies(spark, d):
    return rounded(stats.anomalies(fold_table(spark, d)))


@query()
def st5_normality(spark, d):
    return stats.shapiro(fold_table(spark, d))


@query()
def st18_agg12_pass_rate(spark, d):
    return stats.pass_rate(stats.shapiro(fold_table(spark, d)))


@query()
def st6_st7_group_tests(spark, d):
    return stats.group_tests(fold_table(spark, d)).withColumn("stars", stars(F.col("p")))


@query()
def st9_bootstrap(spark, d):
    return rounded(stats.bootstrap(stats.paired(fold_table(spark, d))))


@query()
def st14_pairwise(spark, d):
    return stats.pairwise(fold_table(spark, d))


@query()
def flt11_mentions(spark, d):
    return stats.mentioning(stats.pairwise(fold_table(spark, d)), "vs no_graph")


@query("SELECT l_discount, count(*) AS n, CASE WHEN l_discount < 0.001 THEN '***' WHEN l_discount < 0.01 THEN '**' WHEN l_discount < 0.05 THEN '*' ELSE 'ns' END AS stars FROM lineitem GROUP BY 1")
def fn7_stars(spark, d):
    return table(spark, d, "lineitem").groupBy("l_discount").agg(F.count("*").alias("n")).withColumn("stars", stars(F.col("l_discount")))


# ---------------------------------------------------------------- planning

DONE = "done AS (SELECT l_returnflag AS dataset, l_linestatus AS graph, (41 + l_linenumber)::INT AS seed, count(*) AS n_folds FROM lineitem GROUP BY ALL)"
GRID = """grid AS (SELECT dataset, graph, seed FROM (SELECT l_returnflag AS dataset FROM lineitem UNION SELECT o_orderstatus FROM orders) a, (SELECT DISTINCT l_linestatus AS graph FROM lineitem) b, (SELECT DISTINCT (41 + l_linenumber)::INT AS seed FROM lineitem) c)"""


def tasks(spark, d):
    lines, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    datasets = lines.select(F.col("l_returnflag").alias("dataset")).union(o.select("o_orderstatus")).distinct()
    return grid.grid(datasets, lines.select(F.col("l_linestatus").alias("graph")).distinct(), lines.select((F.col("l_linenumber") + 41).cast("int").alias("seed")).distinct())


@query(f"WITH {GRID} SELECT * FROM grid")
def jn11_grid(spark, d):
    return tasks(spark, d)


@query(f"WITH {GRID}, {DONE} SELECT * FROM grid WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.dataset = grid.dataset AND done.graph = grid.graph AND done.seed = grid.seed AND n_folds >= 50)")
def jn10_missing(spark, d):
    done = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("graph"), (F.col("l_linenumber") + 41).cast("int").alias("seed")).agg(F.count("*").alias("n_folds"))
    return grid.missing(tasks(spark, d), done, ["dataset", "graph", "seed"])


@query(f"WITH {GRID} SELECT *, s::INT AS fold_start, least(s + 10, 50)::INT AS fold_end FROM grid, range(0, 50, 10) t(s)".replace("SELECT *, s", "SELECT dataset, graph, seed, s"))
def lim2_chunks(spark, d):
    return grid.chunked(tasks(spark, d))


@query(f"WITH {GRID}, n AS (SELECT *, row_number() OVER (ORDER BY dataset, graph, seed) - 1 AS idx FROM grid) SELECT dataset, graph, seed, idx::INT AS idx, (idx // 4) AS array_id, (idx % 4)::INT AS gpu FROM n")
def lim3_devices(spark, d):
    return grid.numbered(tasks(spark, d), ["dataset", "graph", "seed"])


@query(f"WITH {GRID}, n AS (SELECT *, row_number() OVER (ORDER BY dataset, graph, seed) - 1 AS idx, count(*) OVER () AS m FROM grid) SELECT dataset, graph, seed, idx::INT AS idx, CASE WHEN idx < m // 2 THEN 0 ELSE 1 END::INT AS site FROM n")
def lim3_halves(spark, d):
    return grid.halves(tasks(spark, d), ["dataset", "graph", "seed"])


@query("""SELECT n_nationkey, CASE WHEN a > 0 OR b IS NOT NULL THEN CASE WHEN s IS NULL THEN '__f' ELSE '__s' || s || 'f' END || a || '-' || coalesce(b, 50) ELSE '' END AS tag_ FROM
  (SELECT n_nationkey, n_nationkey % 3 * 10 AS a, 0 AS z, CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey % 3 * 10 + 10 END AS b, CASE WHEN n_nationkey % 2 = 0 THEN 42 END AS s FROM nation) t""")
def snk2_fold_tags(spark, d):
    k = F.col("n_nationkey")
    own = table(spark, d, "nation").select("n_nationkey", (k % 3 * 10).alias("a"), F.when(k % 5 > 0, k % 3 * 10 + 10).alias("b"), F.when(k % 2 == 0, 42).alias("s"))
    return own.select("n_nationkey", grid.fold_tag("s", "a", "b").alias("tag_"))


@query("SELECT 'ds' || n_nationkey || ' g' || n_regionkey || ' 200 42' AS value FROM nation")
def snk7_task_text(spark, d):
    """Written as text and read back."""
    folder = new_folder(spark, "tasks")
    own = table(spark, d, "nation").select(F.concat(F.lit("ds"), "n_nationkey").alias("dataset"), F.concat(F.lit("g"), "n_regionkey").alias("graph"), F.lit(200).alias("hvg"), F.lit(42).alias("seed"))
    grid.lines(own, ["dataset", "graph", "hvg", "seed"]).write.text(folder)
    return spark.read.text(folder)


@query(f"WITH {GRID} SELECT dataset, graph, seed FROM grid WHERE graph IN (SELECT l_linestatus FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_shipdate >= TIMESTAMP '1998-01-01') > 0 AND count(DISTINCT l_suppkey) >= 10)")
def flt6_available_graphs(spark, d):
    own = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("graph")).agg(F.max("l_shipdate").alias("last"), F.countDistinct("l_suppkey").alias("n"))
    usable = own.where((F.col("last") >= F.lit("1998-01-01").cast("timestamp")) & (F.col("n") >= graphs.LEAST_RESOLVED))
    return tasks(spark, d).join(usable, "graph", "left_semi").select("dataset", "graph", "seed")


# ---------------------------------------------------------------- models

RING = f"ring AS (SELECT i::INT AS src, i::INT AS dst FROM range({GENES}) t(i) UNION ALL SELECT i::INT, ((i + 1) % {GENES})::INT FROM range({GENES}) t(i) UNION ALL SELECT ((i + 1) % {GENES})::INT, i::INT FROM range({GENES}) t(i))"


def ring(spark):
    own = graphs.nodes(spark, GENES).select(F.col("node").alias("src"), ((F.col("node") + 1) % GENES).cast("int").alias("dst"))
    return graphs.with_loops(graphs.mirrored(own), GENES)


def features(spark, d):
    return profiles(spark, d).where("condition = 'ctrl'").select(F.col("gene_idx").alias("node"), F.lit(0).alias("k"), F.col("mean_x").alias("x"))


@query(f"""WITH {CELLS}, {MOMENTS}, {Z}, {PROFILES}, {RING}, f AS (SELECT gene_idx AS node, mean_x AS x FROM profiles WHERE condition = 'ctrl'),
e AS (SELECT src, dst, 0.5 * a.x - 0.25 * b.x AS s FROM ring JOIN f a ON a.node = src JOIN f b ON b.node = dst), l AS (SELECT src, dst, CASE WHEN s > 0 THEN s ELSE 0.2 * s END AS s FROM e),
w AS (SELECT src, dst, exp(s - max(s) OVER (PARTITION BY dst)) AS w FROM l), q AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY dst) AS alpha FROM w)
SELECT dst AS node, 0 AS k, round(sum(alpha * x), 6) AS x FROM q JOIN f ON node = src GROUP BY 1""")
def ml3_attention(spark, d):
    own = features(spark, d)
    scores = own.select("node", (0.5 * F.col("x")).alias("s_src"), (-0.25 * F.col("x")).alias("s_dst"))
    return rounded(propagation.gathered(own, propagation.attention(ring(spark), scores)))


@query(f"""WITH {CELLS}, {MOMENTS}, {Z}, {PROFILES}, {RING}, f AS (SELECT gene_idx AS node, mean_x AS x FROM profiles WHERE condition = 'ctrl'), g AS (SELECT dst AS node, sum(x / 3.0) AS x FROM ring JOIN f ON node = src GROUP BY 1)
SELECT node, 0 AS k, round(CASE WHEN y > 0 THEN y ELSE exp(y) - 1 END, 6) AS x FROM (SELECT node, (x - avg(x) OVER ()) / sqrt(var_pop(x) OVER () + 1e-5) AS y FROM g) t""")
def ml4_ml6_convolution(spark, d):
    edges = ring(spark)
    sent = propagation.gathered(features(spark, d), propagation.degree_weights(edges))
    return rounded(propagation.elu(propagation.normalised(sent)))


@query(f"""WITH {CELLS}, {MOMENTS}, {Z}, {PROFILES}, w AS (SELECT k::INT AS k, j::INT AS j, (j + 1) / 4.0 AS w FROM range(1) a(k), range(4) b(j))
SELECT gene_idx AS node, j AS k, round(mean_x * CASE WHEN gene_idx % 5 = 0 THEN 0 WHEN gene_idx % 5 = 1 THEN 0.5 ELSE 1 END * w, 6) AS x FROM profiles, w WHERE condition = 'ctrl'""")
def ml1_ml2_masked_projection(spark, d):
    node = F.col("node")
    doses = graphs.nodes(spark, GENES).where(node % 5 < 2).select("node", F.when(node % 5 == 0, 0.0).otherwise(0.5).alias("dose"))
    weights = spark.range(4).select(F.lit(0).alias("k"), F.col("id").cast("int").alias("j"), ((F.col("id") + 1) / 4).alias("w"))
    return rounded(propagation.projected(propagation.masked(features(spark, d), doses), weights)).select("node", "k", F.when(F.col("x") == 0, 0.0).otherwise(F.col("x")).alias("x"))


HIDDEN = 3


def given_model(layers: int = 2) -> inference.Model:
    """Weights by a rule, so that SQL can state them too."""
    k = np.arange(HIDDEN)
    w = lambda i: np.sin(1.0 + k[:, None] * 2 + k * 3 + i)
    norm = lambda i: inference.Norm(k / 10 + i / 10, 1.0 + k, 1 + k / 4, k / 5 - 0.1)
    return inference.Model(inference.Linear((k[None, :] + 1) / 2, k / 3), 1 + k / 2, k / 4 - 0.2, inference.Linear(w(9), k / 7), [(inference.Linear(w(i), k / 5), norm(i)) for i in range(layers)], inference.Linear((1.0 - k)[:, None], np.array([0.5])))


def _forward_sql(layers: int = 2) -> str:
    h, elu, lin = range(HIDDEN), "CASE WHEN {0} > 0 THEN {0} ELSE exp({0}) - 1 END".format, lambda i, j, v: " + ".join(f"{v}{k} * sin({1.0 + k * 2 + j * 3 + i})" for k in range(HIDDEN))
    mean = "((" + " + ".join(f"h{j}" for j in h) + f") / {HIDDEN})"
    var = "((" + " + ".join(f"power(h{j} - {mean}, 2)" for j in h) + f") / {HIDDEN})"
    steps = [
        "deg AS (SELECT dst, count(*) AS d FROM ring GROUP BY 1)", "al AS (SELECT src, ring.dst, 1 / sqrt(a.d * b.d) AS alpha FROM ring JOIN deg a ON a.dst = ring.src JOIN deg b ON b.dst = ring.dst)",
        f"h AS (SELECT gene_idx AS node, {', '.join(f'mean_x * {(j + 1) / 2} + {j}/3.0::DOUBLE AS h{j}' for j in h)} FROM profiles WHERE condition = 'ctrl')",
        f"n AS (SELECT node, {', '.join(f'(h{j} - {mean}) / sqrt({var} + 1e-5) * {1 + j / 2} + {j / 4 - 0.2} AS h{j}' for j in h)} FROM h)",
        f"x0 AS (SELECT node, {', '.join(f'CASE WHEN node % 5 = 0 THEN 0 WHEN node % 5 = 1 THEN 0.5 ELSE 1 END * ({elu(f'h{j}')}) AS v{j}' for j in h)} FROM n)",
    ]
    for i in range(layers):
        steps.append(f"s{i} AS (SELECT dst AS node, {', '.join(f'sum(alpha * v{j}) AS v{j}' for j in h)} FROM al JOIN x{i} ON node = src GROUP BY 1)")
        steps.append(f"b{i} AS (SELECT node, {', '.join(f'({lin(i, j, "v")} + {j / 5} - {j / 10 + i / 10}) / sqrt({1.0 + j} + 1e-5) * {1 + j / 4} + {j / 5 - 0.1} AS v{j}' for j in h)} FROM s{i})")
        own = [f"(b{i}.v{j} + {lin(9, j, 'x0.v')} + {j}/7.0::DOUBLE)" if i == layers - 1 else f"b{i}.v{j}" for j in h]
        steps.append(f"x{i + 1} AS (SELECT node, {', '.join(f'{elu(own[j])} AS v{j}' for j in h)} FROM b{i} JOIN x0 USING (node))")
    return f"WITH {CELLS}, {MOMENTS}, {Z}, {PROFILES}, {RING}, {', '.join(steps)} SELECT node, round({' + '.join(f'v{j} * {1 - j}' for j in h)} + 0.5, 6) AS y FROM x{layers}"


@query(_forward_sql())
def ml4_ml6_ml9_forward(spark, d):
    """Two layers of given weights over masked features, with residual and head."""
    node = F.col("node")
    doses = graphs.nodes(spark, GENES).where(node % 5 < 2).select("node", F.when(node % 5 == 0, 0.0).otherwise(0.5).alias("dose"))
    own = inference.embedded(features(spark, d), given_model(), doses)
    return rounded(inference.predicted(own, inference.bucketed(ring(spark)), given_model()))


def _run_sql(scale: int, graph: str) -> str:
    """The folds of one (scale, graph), each step in plain SQL over all cells."""
    edges = {
        "coexpression": "SELECT a AS src, b AS dst FROM co WHERE abs(r) > 0.02 UNION SELECT b, a FROM co WHERE abs(r) > 0.02 UNION SELECT pos, pos FROM chosen",
        "combined": "SELECT a.pos AS src, b.pos AS dst FROM chosen a, chosen b WHERE b.gene_idx - a.gene_idx IN (-1, 0, 1)",
    }
    steps = f"""w0 AS (SELECT vec_id AS cell_id, CASE WHEN label = 0 THEN 'ctrl' ELSE 'P' || label END AS condition, unnest(range(len(embedding)))::INT AS gene_idx, unnest(embedding)::DOUBLE AS x FROM embeddings),
chosen AS (SELECT gene_idx, row_number() OVER (ORDER BY gene_idx) - 1 AS pos FROM (SELECT gene_idx FROM w0 GROUP BY 1 ORDER BY var_samp(x) DESC, gene_idx LIMIT {scale})),
cells AS (SELECT cell_id, condition, pos AS gene_idx, x FROM w0 JOIN chosen USING (gene_idx)), {MOMENTS}, {Z}, {PROFILES}, {DELTAS},
pairs0 AS (SELECT condition, gene_idx, delta AS t, (sum(delta) OVER w - delta) / (count(*) OVER w - 1) AS p FROM deltas WINDOW w AS (PARTITION BY gene_idx))"""
    if graph == "no_graph":
        steps += ", pairs AS (SELECT * FROM pairs0)"
    else:
        if graph == "coexpression":
            steps += ", co AS (SELECT a.gene_idx AS a, b.gene_idx AS b, corr(a.x, b.x) AS r FROM cells a JOIN cells b ON a.cell_id = b.cell_id AND a.gene_idx < b.gene_idx GROUP BY 1, 2)"
        steps += f""", edges AS ({edges[graph]}), deg AS (SELECT dst, count(*) AS d FROM edges GROUP BY 1),
sent AS (SELECT condition, edges.dst AS gene_idx, sum(p / sqrt(a.d * b.d)) AS p FROM pairs0 JOIN edges ON src = gene_idx JOIN deg a ON a.dst = edges.dst JOIN deg b ON b.dst = edges.src GROUP BY 1, 2),
pairs AS (SELECT condition, gene_idx, t, coalesce(sent.p, 0) AS p FROM pairs0 LEFT JOIN sent USING (condition, gene_idx))"""
    ranked = PREDICTED[PREDICTED.index("ranked AS"):]
    return f"""(WITH {steps}, {ranked}, held AS (SELECT condition FROM (SELECT 'P' || label AS condition, min(vec_id) AS f FROM embeddings WHERE label <> 0 GROUP BY 1 HAVING count(*) >= 2) ORDER BY f LIMIT 50)
SELECT '{graph}' AS graph_type, {scale} AS hvg, condition, round(CASE WHEN stddev_pop(t) > 1e-8 AND stddev_pop(p) > 1e-8 THEN covar_pop(t, p) / (stddev_pop(t) * stddev_pop(p)) ELSE 0 END, 5) AS pearson_r,
round(CASE WHEN stddev_pop(t) > 1e-8 AND stddev_pop(p) > 1e-8 THEN covar_pop(rt, rp) / (stddev_pop(rt) * stddev_pop(rp)) ELSE 0 END, 5) AS spearman_rho, round(avg((t - p) * (t - p)), 5) AS mse,
round(count(*) FILTER (kt AND kp) / count(*) FILTER (kt OR kp)::DOUBLE, 5) AS jaccard FROM ranked WHERE condition IN (SELECT condition FROM held) GROUP BY 3)"""


def neighbours(small, chosen):
    """Features whose numbers in the whole matrix differ by 1 or less."""
    at = runs.positions(small.sparkSession, chosen)
    near = at.select(F.explode(F.array(F.col("node") - 1, "node", F.col("node") + 1)).alias("node"), F.col("position").alias("src"))
    return near.join(at, "node").select("src", F.col("position").alias("dst"))


@query("SELECT 'embeddings' AS dataset, seed::INT AS seed, r.* FROM (" + " UNION ALL ".join(_run_sql(s, g) for s in (24, 48) for g in ("no_graph", "coexpression", "combined")) + ") r, (SELECT unnest([42, 43]) AS seed) s")
def run_configured(spark, d):
    """Two scales, two seeds and four graphs of the fixture matrix, run into a store and read back; one graph has no edges and is skipped."""
    built = {"coexpression": lambda own, g: graphs.coexpression(own, "embedding", len(g), 0.02), "combined": neighbours, "string_ppi": lambda own, g: graphs.with_loops(graphs.empty(spark), len(g))}
    folder = new_folder(spark, "run")
    own = runs.Dataset(wide(spark, d), "vec_id", "embedding", "condition", built)
    runs.run({"embeddings": own}, (24, 48), ("no_graph", "coexpression", "combined", "string_ppi"), (42, 43), folder, choose=prepare.most_variable)
    return rounded(store.read(spark, folder), 5)


def lopo_run(spark, d, estimator, graph="no_graph", edges=None, folds=50):
    """Folds of the fixture matrix, one model a fold, then the metrics."""
    own = prepare.conditions(labels(spark, d), "ctrl").select("condition", "cond_ord")
    number = F.coalesce("cond_ord", F.lit(-1)).cast("int")
    p = profiles(spark, d).join(F.broadcast(own), "condition", "left").select(F.lit("profile").alias("kind"), number.alias("a"), F.col("gene_idx").alias("b"), F.col("mean_x").alias("x"))
    m = own.select(F.lit("mask").alias("kind"), number.alias("a"), number.alias("b"), F.lit(1.0).alias("x"))
    e = (graphs.empty(spark) if edges is None else edges).select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("x"))
    bundle = p.union(m).union(e).select(F.lit(graph).alias("graph_type"), "kind", "a", "b", "x")
    todo = lopo.slices(own, folds).select(F.lit(graph).alias("graph_type"), F.lit(42).alias("seed"), "condition", number.alias("number"))
    return metrics.fold_metrics(lopo.run_lopo(todo, bundle, estimator), "graph_type", "seed", "condition")


@query()
def ml8_ml9_lopo_attention(spark, d):
    return rounded(lopo_run(spark, d, models.Attention(), "ring", ring(spark)), 3)


@query()
def ml6_lopo_convolution(spark, d):
    return rounded(lopo_run(spark, d, models.Convolution(), "ring", ring(spark)), 3)


@query()
def ml7_lopo_transformer(spark, d):
    return rounded(lopo_run(spark, d, models.Transformer()), 3)


@query(f"""WITH {CELLS}, {MOMENTS}, {Z}, {PROFILES}, {DELTAS}, {PREDICTED} SELECT 'no_graph' AS graph_type, 42 AS seed, condition, round(covar_pop(t, p) / (stddev_pop(t) * stddev_pop(p)), 6) AS pearson_r,
  round(covar_pop(rt, rp) / (stddev_pop(rt) * stddev_pop(rp)), 6) AS spearman_rho, round(avg((t - p) * (t - p)), 6) AS mse, round(count(*) FILTER (kt AND kp) / count(*) FILTER (kt OR kp)::DOUBLE, 6) AS jaccard FROM ranked GROUP BY 3""")
def ml11_lopo_mean_of_others(spark, d):
    own = lopo.mean_of_others(deltas(spark, d)).select(F.lit("no_graph").alias("graph_type"), F.lit(42).alias("seed"), "condition", "gene_idx", "delta_true", "delta_pred")
    return rounded(metrics.fold_metrics(own, "graph_type", "seed", "condition"))
