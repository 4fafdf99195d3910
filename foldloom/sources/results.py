"""Result documents as JSON, their file names, and the tables written from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollup import KEY, METRICS, deduplicated, documents, overall

SEED = "struct<pearson_mean:double,pearson_std:double,spearman_mean:double,jaccard_mean:double,mse_mean:double,n_folds:int,folds:array<struct<condition:string,pearson_r:double,spearman_rho:double,mse:double,jaccard:double>>>"
OVERALL = "struct<pearson_mean:double,pearson_std:double,spearman_mean:double,spearman_std:double,jaccard_mean:double,jaccard_std:double,mse_mean:double,mse_std:double,n_total_folds:int,n_seeds:int>"
DOCUMENT = f"dataset string, graph_type string, overall {OVERALL}, seeds map<string, {SEED}>"
_CHUNK = r"^(s\d+)?f\d+-\d+$"


def name_parts(name: Column) -> Column:
    """struct<dataset, graph_type, seed, fold_start, fold_end, kind> of a file's name; kind: merged, chunk or other. One rule for
    both kinds of chunk tag; a tag that is neither makes the file ``other``."""
    parts = F.split(F.regexp_replace(name, r"\.json$", ""), "__", -1)
    tag = F.when(F.size(parts) == 3, F.get(parts, F.lit(2)))
    number = lambda p: F.nullif(F.regexp_extract(tag, p, 1), F.lit("")).cast("int")
    out = ~name.rlike(r"\.json$") | name.startswith("results_") | (name == "summary.csv")
    kind = F.when(out | (F.size(parts) < 2), "other").when(F.size(parts) == 2, "merged").when(tag.rlike(_CHUNK), "chunk").otherwise("other")
    return F.struct(F.get(parts, F.lit(0)).alias("dataset"), F.get(parts, F.lit(1)).alias("graph_type"), number(r"^s(\d+)f").alias("seed"), number(r"f(\d+)-").alias("fold_start"), number(r"-(\d+)$").alias("fold_end"), kind.alias("kind"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents below ``folder`` with their file's name parts, and ``scale`` where a folder ``hvg=`` tells it; a NaN that is written bare is read
    as one. A file in a folder ``name=``, as :func:`write_chunks` leaves it, has that name."""
    path = F.col("_metadata.file_path")
    own = F.regexp_extract(path, r"/name=([^/]+)/[^/]+$", 1)
    name = F.when(own != "", F.concat(own, F.lit(".json"))).otherwise(F.col("_metadata.file_name"))
    scale = F.nullif(F.regexp_extract(path, r"/hvg=(\d+)/", 1), F.lit("")).cast("int")
    raw = spark.read.schema(DOCUMENT).option("multiLine", True).option("recursiveFileLookup", True).json(folder)
    return raw.select("*", name.alias("file"), name_parts(name).alias("part"), scale.alias("scale")).where("part.kind <> 'other'")


def write_chunks(folds: DataFrame, folder: str) -> None:
    """A document for each (hvg, dataset, graph_type) and slice of folds, in a folder of its name: ``dataset__graph__f0-10`` where ``folds`` has
    fold_start and fold_end, ``dataset__graph`` where fold_start is null. A slice that is run again replaces its own document
    alone. A document is a file; one of very many folds comes in parts, see :func:`documents`, all in its folder. Names are of letters,
    digits, ``_``, ``-`` and dots."""
    tag = F.coalesce(F.concat(F.lit("__f"), F.col("fold_start").cast("string"), F.lit("-"), F.col("fold_end").cast("string")), F.lit(""))
    own = folds.withColumn("name", F.concat("dataset", F.lit("__"), "graph_type", tag))
    writer = documents(own, "hvg", "name").write.partitionBy("hvg", "name").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("ignoreNullFields", "false").option("maxRecordsPerFile", 1).json(folder)


def merged_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The fold table of a folder's documents, merged: what merged documents hold comes first, chunks add conditions that a seed lacks."""
    found = fold_table(read_documents(spark, folder), F.col("scale"))
    return deduplicated(found, "source").select(*KEY, *METRICS)


def fold_table(found: DataFrame, hvg: Column) -> DataFrame:
    """The fold table of documents: seeds and folds as rows. ``source`` 0 for merged files, 1 for chunks."""
    seeds = found.select("dataset", "graph_type", hvg.cast("int").alias("hvg"), F.when(F.col("part.kind") == "merged", 0).otherwise(1).alias("source"), F.explode("seeds").alias("seed", "s"))
    each = seeds.select("dataset", "graph_type", "hvg", "source", F.regexp_replace("seed", "^seed_", "").cast("int").alias("seed"), F.posexplode("s.folds").alias("fold", "f"))
    return each.select("dataset", "graph_type", "hvg", "source", "seed", "fold", "f.condition", *[F.coalesce(F.col(f"f.{m}"), F.lit(0.0)).alias(m) for m in METRICS])


def write_documents(folds: DataFrame, folder: str) -> None:
    """One line of JSON for each (dataset, graph_type), or part of a large one, to a new folder: Spark can't replace what it reads."""
    documents(folds).write.mode("errorifexists").option("ignoreNullFields", "false").json(folder)


def write_table(rows: DataFrame, folder: str) -> None:
    """A report table as one CSV file with a header; it has few rows by what it is."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as CSV in a folder of its name, sorted by its first columns."""
    for name, rows in tables.items():
        write_table(rows.repartition(1).sortWithinPartitions(*rows.columns[:3]), f"{folder}/{name}.csv")  # few rows; drawing ranges would make them twice


def summary(folds: DataFrame) -> DataFrame:
    """Overall metrics a (dataset, graph_type), rounded as reports show them: to 4 digits, those of mse to 6."""
    own = overall(folds, "dataset", "graph_type")
    shown = [F.round(c, 6 if c.startswith("mse") else 4).alias(c) for c in own.columns if c.endswith(("_mean", "_std"))]
    return own.select("dataset", "graph_type", *shown, "n_total_folds", "n_seeds")
