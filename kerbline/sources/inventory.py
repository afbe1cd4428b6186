"""File inventory: one row per regular file below a root.

Spark's own file sources skip names that start with a dot or an underscore and empty files; this source lists them
all. The tree is opened level by level until it has ``BRANCHES`` branches; each is walked by a task of its own, so that one
top-level directory with most of the files is walked by many.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kerbline.session import ship_package

SCHEMA = "path string, bytes bigint"
BRANCHES = 256


class _Branch(InputPartition):
    def __init__(self, name: str, deep: bool) -> None:
        self.name, self.deep = name, deep


class _Reader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = os.path.realpath(root)
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"no such directory: {root}")

    def partitions(self) -> list[InputPartition]:
        opened, front = [], [""]
        while front and len(front) < BRANCHES:
            opened += [_Branch(name, False) for name in front]
            below = []
            for name in front:
                with os.scandir(os.path.join(self.root, name)) as found:
                    below += sorted(os.path.join(name, e.name) for e in found if e.is_dir(follow_symlinks=False))
            front = below
        return opened + [_Branch(name, True) for name in front]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        assert isinstance(partition, _Branch)
        for folder, below, names in os.walk(os.path.join(self.root, partition.name)):
            if not partition.deep:
                below.clear()
            for name in sorted(names):
                full = os.path.join(folder, name)
                if os.path.isfile(full):
                    yield os.path.relpath(full, self.root).replace(os.sep, "/"), os.path.getsize(full)


class FileInventory(DataSource):
    """``spark.read.format("file_inventory").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "file_inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to ``root``, bytes) of every regular file below ``root``."""
    ship_package(spark)
    spark.dataSource.register(FileInventory)
    return spark.read.format("file_inventory").load(root)
