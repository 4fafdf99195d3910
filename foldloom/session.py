"""What queries need of a session."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

#: Rows that a task sorts or joins, so that tasks grow in number with the tables and not in size.
ROWS = 250_000
ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package, however the driver found it; executors elsewhere have it
    installed."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the one that driver and executors share; a local one only where none is set and all runs in
    one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="foldloom-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tasks_for(rows: DataFrame) -> int:
    """How many tasks take on ``rows``, at ROWS a task. Meant for tables at rest, whose files tell their length."""
    return max(1, -(-rows.count() // ROWS))


def dealt(*sides: tuple[DataFrame, Column | str | list[str]]) -> list[DataFrame]:
    """Each of ``sides``, (rows, key), dealt by its key into as many tasks as the longest of them asks for: they meet without another shuffle."""
    n = max(tasks_for(rows) for rows, _ in sides)
    return [rows.repartition(n, *(key if isinstance(key, list) else [key])) for rows, key in sides]


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once to a new folder and read from there: what several steps use isn't made again for each."""
    folder = new_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
