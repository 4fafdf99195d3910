"""Comparison graphs over features: edge lists (src, dst), directed both ways, with a loop on every node, each edge once."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept
from .tiles import correlations

THRESHOLD, BROADEST_TERM, LEAST_RESOLVED = 0.3, 100, 10


def nodes(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("node"))


def mirrored(edges: DataFrame) -> DataFrame:
    """Both directions."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _once(edges: DataFrame, tasks: int | None) -> DataFrame:
    """Every edge once; with ``tasks``, by that many, none of which sees edges before they are dealt."""
    return (edges.repartition(tasks, "src", "dst") if tasks else edges).distinct()


def with_loops(edges: DataFrame, n: int, tasks: int | None = None) -> DataFrame:
    """``edges`` and a loop on each of ``n`` nodes, every edge once."""
    own = nodes(edges.sparkSession, n)
    return _once(edges.select("src", "dst").union(own.select(F.col("node").alias("src"), F.col("node").alias("dst"))), tasks)


def coexpression(wide: DataFrame, values: str, n: int, threshold: float = THRESHOLD) -> DataFrame:
    """Edges between positions whose correlation is stronger than ``threshold``, strictly; NaN is not."""
    strong = correlations(wide, values).where((F.abs("r") > threshold) & ~F.isnan("r"))
    return with_loops(mirrored(strong.select(F.col("a").alias("src"), F.col("b").alias("dst"))), n)


def shared_terms(annotations: DataFrame, broadest: int = BROADEST_TERM) -> DataFrame:
    """(src, dst), src <> dst, both ways: features that a term of ``broadest`` features or fewer annotates. ``annotations``:
    (node, term). The breadth is checked before the self-join, so a term adds at most broadest squared pairs."""
    own = annotations.select("node", "term").where("node is not null and term is not null").distinct()
    narrow = own.join(own.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") <= broadest).select("term"), "term")
    half = narrow.select("term", F.col("node").alias("src")).join(narrow.select("term", F.col("node").alias("dst")), "term").where("src < dst").select("src", "dst").distinct()
    return mirrored(half)


def looked_up(links: DataFrame, names: DataFrame, least_score: float | None = None, tasks: int | None = None) -> DataFrame:
    """Edges between features, both ways, from links (id_a, id_b[, score]) between other ids. ``names``: (id, node); where an
    id has several nodes the last counts. Links with an unknown end are dropped. ``tasks``: how many take on edges, if links are many."""
    last = names.where("id is not null").groupBy("id").agg(F.max("node").alias("node"))
    own = links if least_score is None else links.where(F.col("score") >= least_score)
    a = last.select(F.col("id").alias("id_a"), F.col("node").alias("src"))
    b = last.select(F.col("id").alias("id_b"), F.col("node").alias("dst"))
    return _once(mirrored(own.join(a, "id_a").join(b, "id_b").select("src", "dst")), tasks)


def available(edges: DataFrame, resolved: DataFrame | None = None, least: int = LEAST_RESOLVED) -> DataFrame:
    """One row: whether the graph can be used: ``least`` features resolved, and an edge that isn't a loop."""
    enough = F.lit(True) if resolved is None else F.lit(resolved.distinct().count() >= least)
    return edges.where("src <> dst").agg(F.count("*").alias("n_edges")).select("n_edges", ((F.col("n_edges") > 0) & enough).alias("available"))


def combined(*parts: DataFrame, tasks: int | None = None) -> DataFrame:
    """Every edge of any part, once."""
    out = parts[0].select("src", "dst")
    for p in parts[1:]:
        out = out.union(p.select("src", "dst"))
    return _once(out, tasks)


def average_degree(edges: DataFrame, n: int) -> DataFrame:
    """Edges a node, loops and both directions counted."""
    return edges.agg((F.count("*") / F.lit(n)).alias("avg_degree"))


def preferential(spark: SparkSession, n: int, degree: float, seed: int = 42) -> DataFrame:
    """A Barabasi-Albert graph: each node after the first m joins m others with chances in proportion to their edges;
    m = max(1, int(degree / 2)). It is drawn one node after another, on the driver: n is a number of features."""
    m = max(1, int(degree / 2))
    draw, ends, edges = random.Random(seed), [], []
    goals = list(range(min(m, n - 1)))
    for node in range(m, n):
        edges += [(node, g) for g in goals]
        ends += goals + [node] * len(goals)
        goals = []
        while len(goals) < min(m, node + 1):
            x = draw.choice(ends)
            if x not in goals:
                goals.append(x)
    a, b = (pa.array([e[i] for e in edges], pa.int32()) for i in (0, 1))
    return with_loops(mirrored(spark.createDataFrame(pa.table({"src": a, "dst": b}))), n)  # an Arrow table starts no Python on executors


def empty(spark: SparkSession) -> DataFrame:
    return nodes(spark, 0).select(F.col("node").alias("src"), F.col("node").alias("dst"))


def build_all(wide: DataFrame, values: str, n: int, annotations: DataFrame, links: DataFrame, names: DataFrame, threshold: float = THRESHOLD) -> dict[str, DataFrame]:
    """All six graphs by name. ``random`` has the average degree of ``combined``, which takes the three before it: these are made
    one after another and written, so that none is made again for the degree, for ``combined`` and for itself."""
    spark = wide.sparkSession
    made = {"string_ppi": with_loops(looked_up(links, names), n), "gene_ontology": with_loops(shared_terms(annotations), n), "coexpression": coexpression(wide, values, n, threshold)}
    out = {name: kept(edges, name) for name, edges in made.items()}
    out["combined"] = kept(combined(*out.values()), "combined")
    degree = average_degree(out["combined"], n).first()["avg_degree"]
    return out | {"random": preferential(spark, n, degree), "no_graph": empty(spark)}
