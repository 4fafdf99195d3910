"""Files that tasks write into a shared folder: whole or not at all, the same whichever attempt wrote them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


class SharedFile:
    """A file under ``folder``, a URI of a store that all executors reach. It is written under another name and takes its own at
    the end, so a lost or repeated attempt leaves no part of it; a repeated one replaces it by equal bytes."""

    def __init__(self, folder: str, name: str):
        self.store, root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(root, recursive=True)
        self.path, self.draft = f"{root}/{name}", f"{root}/_{name}.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.draft)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.store.move(self.draft, self.path)

    def drop(self) -> None:
        self.out.close()
        self.store.delete_file(self.draft)


def files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, content) of the whole files in ``folder``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")


def file_names(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """The names (name) of the files in ``folder``, dealt out by their sizes; nothing of them is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"))


def opened(folder: str, name: str, use: Callable[[pa.NativeFile], T]) -> T:
    """What ``use`` makes of a file in ``folder``, open for reading at any place."""
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{name}") as source:
        return use(source)
