"""Session helpers: defaults for a local session, checkpoint folder, checked broadcasts."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kerbline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, as a path where it is one of a file system.

    A session in one process (a test, a laptop) may do without and gets a temporary folder; a cluster may not, as its
    machines do not share one.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_kerbline_folder", None)
    if folder is None:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = sc._kerbline_folder = tempfile.mkdtemp(prefix="kerbline-shared-")
    return folder.removeprefix("file://")


def checkpoint_ready(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` usable, in the session's shared folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or shared_folder(spark))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else ``df`` as it is.

    Counting stops at ``max_rows + 1`` rows, so the check itself is bounded. Without the hint the join falls
    back to a shuffle, whose skew adaptive execution splits.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its source gives fewer partitions than there are cores (one small file, say).

    Meant for narrow work that costs far more than moving the rows; a large input has enough partitions and stays as it is.
    Only plans without a shuffle are looked at: counting the partitions of others would run them.
    """
    if MOVING.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Operators of a logical plan that move rows.
MOVING = re.compile(r"Join|Aggregate|Window|Sort|Repartition(?:By| \d+, true)|Rebalance|Distinct|Limit|Deduplicate|Intersect|Except")


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per Spark application.

    Spark's own file server hands the archive out, so executors need no shared folder and no installation.
    """
    sc = spark.sparkContext
    if getattr(sc, "_kerbline_shipped", False):
        return
    package = Path(__file__).resolve().parent
    out = tempfile.mkdtemp(prefix="kerbline-package-")
    staging = os.path.join(out, "staging")
    shutil.copytree(package, os.path.join(staging, package.name), ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    archive = shutil.make_archive(os.path.join(out, "kerbline_package"), "zip", staging)
    shutil.rmtree(staging)
    sc.addPyFile(archive)
    sc._kerbline_shipped = True
