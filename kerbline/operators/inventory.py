"""From a list of files to a manifest of sequences.

The input is one row per file (``path`` relative to the root, as the inventory source gives it). Directories with
enough kinds of files are sequences, unless a directory below them is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIDEO, IMAGE = ("mp4", "webm", "avi"), ("jpg", "jpeg", "png", "bmp", "webp")
MIN_ROLES = 3
ROLES = (
    "front_video rear_video topview_video front_image rear_image topview_image label_v1_csv label_v2_csv label_v1_xlsx label_v2_xlsx metadata_json mf4_file pfdf4_pure_bz2"
).split()


def with_parts(files: DataFrame) -> DataFrame:
    """``files`` with ``dir``, ``name`` and lower-case ``suffix`` (without dot; a leading dot starts no suffix)."""
    name = F.substring_index("path", "/", -1)
    rows = files.withColumn("name", name).withColumn("dir", F.regexp_replace("path", r"/?[^/]*\z", ""))
    return rows.withColumn("suffix", F.lower(F.regexp_extract("name", r"[^.].*\.([^.]+)\z", 1)))


def role_tests(name: str = "name", suffix: str = "suffix", labels: tuple[str, str] = ("label_v1", "label_v2")) -> dict[str, Column]:
    """A condition per role; one file can have several roles."""
    low, end = F.lower(name), F.col(suffix)
    has = lambda text: F.contains(low, F.lit(text))
    top = has("topview") | has("uss")
    return dict(
        zip(
            ROLES,
            [
                *[t & end.isin(*VIDEO) for t in (has("front"), has("rear"), top)],
                *[t & end.isin(*IMAGE) for t in (has("front"), has("rear"), top)],
                *[has(label) & (end == kind) for kind in ("csv", "xlsx") for label in labels],
                end == "json",
                end == "mf4",
                low.endswith(".pure.bz2") | has("pfdf4"),
            ],
        )
    )


def directory_roles(files: DataFrame) -> DataFrame:
    """One row per directory: the chosen path of each role and the number of roles found (``evidence``).

    Videos prefer mp4, then webm, then avi; within that, and for all other roles, the first path wins.
    """
    rows = with_parts(files)
    rank = F.when(F.col("suffix") == "mp4", 0).when(F.col("suffix") == "webm", 1).when(F.col("suffix") == "avi", 2).otherwise(99)
    picks = []
    for role, test in role_tests().items():
        if role.endswith("_video"):
            picks.append(F.min(F.when(test, F.struct(rank.alias("rank"), F.col("path"))))["path"].alias(role))
        else:
            picks.append(F.min(F.when(test, F.col("path"))).alias(role))
    found = rows.groupBy("dir").agg(*picks)
    evidence = sum((F.col(r).isNotNull().cast("int") for r in ROLES), F.lit(0))
    return found.withColumn("evidence", evidence)


def leaf_directories(candidates: DataFrame) -> DataFrame:
    """Candidates (``dir``) without a candidate below them.

    Every candidate names its proper ancestors, and those are removed: an equi-join of size rows x depth instead of
    comparing all pairs.
    """
    dirs = candidates.select("dir").distinct()
    parts = F.split("dir", "/")
    depths = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: k > 0)
    above = dirs.select(F.explode(F.transform(depths, lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("dir")).distinct()
    root = dirs.filter("dir <> ''").select(F.lit("").alias("dir")).limit(1)
    return dirs.join(above.unionByName(root), "dir", "left_anti")


def sequence_id(dir_col: Column | str) -> Column:
    """Directory with slashes and backslashes as double underscores."""
    return F.regexp_replace(dir_col, r"[/\\]", "__")


def build_manifest(files: DataFrame) -> DataFrame:
    """The 16 columns of a manifest, ordered by the parts of the directory. The root itself is no sequence."""
    found = directory_roles(files).filter((F.col("evidence") >= MIN_ROLES) & (F.col("dir") != ""))
    leaves = found.join(leaf_directories(found), "dir", "left_semi")
    ready = F.col("front_video").isNotNull() & F.col("topview_video").isNotNull() & F.col("label_v2_csv").isNotNull()
    rows = leaves.select(sequence_id("dir").alias("sequence_id"), F.col("dir").alias("sequence_dir"), *ROLES, ready.alias("is_poc_ready"))
    return rows.orderBy(F.split("sequence_dir", "/"))
