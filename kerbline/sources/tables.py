"""Delimited tables and documents as they come from files."""

from __future__ import annotations

import os
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV file with header, all cells as text, blanks as empty texts; cells may hold line breaks and doubled quotes.

    With ``columns`` exactly these are returned, in order; columns the file lacks are blank.
    """
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    if "://" not in path and os.path.isfile(path) and os.path.getsize(path) == 0:  # an empty table has no header
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns or ()]))
    df = spark.read.options(header=True, multiLine=True, quote='"', escape='"', inferSchema=False).csv(path)
    first = df.columns[0]
    df = df.withColumnRenamed(first, first.removeprefix("\ufeff"))
    df = df.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])
    return df if columns is None else df.select([F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in columns])


def read_documents(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """(path, payload) of the files named by ``files`` (column ``path``, relative to ``root``); bytes that are no UTF-8
    give a null payload. Each executor reads its own files."""
    from collections.abc import Iterator

    import pandas as pd

    from kerbline.session import ship_package

    ship_package(spark)

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for path in batch["path"]:
                try:
                    texts.append(Path(root, path).read_bytes().decode("utf-8"))
                except (OSError, UnicodeDecodeError):
                    texts.append(None)
            yield pd.DataFrame({"path": batch["path"], "payload": pd.Series(texts, dtype=object)})

    return files.select("path").mapInPandas(load, "path string, payload string")


def read_bytes(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """(path, content) of files named by ``files``; a missing file has null content."""
    from collections.abc import Iterator

    import pandas as pd

    from kerbline.session import ship_package

    ship_package(spark)

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [Path(root, p).read_bytes() if Path(root, p).is_file() else None for p in batch["path"]]
            yield pd.DataFrame({"path": batch["path"], "content": pd.Series(found, dtype=object)})

    return files.select("path").mapInPandas(load, "path string, content binary")
