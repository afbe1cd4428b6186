"""Filters and the stratified round-robin sample over the enriched manifest.

Records of a stratum are put in order by an md5 of seed and id, strata by an md5 of seed and key; the sample deals one
record of each stratum per round until it has enough. This keeps size, balance (strata differ by at most one until
exhausted) and determinism per seed, and depends on no input order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbline.functions import documents as D
from kerbline.functions.text import is_blank, or_blank, strip, truthy
from kerbline.session import broadcast_if_small

#: Leading hexadecimal digits of the hash that make its range; ranges up to this number are broadcast.
HASH_DIGITS, MAX_BROADCAST_RANGES = 3, 100_000
STRATA = ("weather_tags", "approach")
ROW = (
    "sequence_id sequence_dir is_poc_ready json_loaded preferred_camera_rule preferred_camera_rule_reason driving_direction approach scene_tags weather_tags "
    "label_objects_json target_object primary_label_object primary_weather front_video rear_video topview_video label_v2_csv metadata_json"
).split()


def base_rows(enriched: DataFrame) -> DataFrame:
    """Sequences that are ready, have loaded metadata and a label file."""
    return enriched.filter(truthy("is_poc_ready") & truthy("json_loaded") & ~is_blank("label_v2_csv"))


def sampling_rows(rows: DataFrame) -> DataFrame:
    """The 19 columns of a sample."""
    target = D.primary_object("label_objects_json")
    return rows.withColumns({"target_object": target, "primary_label_object": target, "primary_weather": D.primary_weather("weather_tags")}).select(*ROW)


def _hash(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *parts).cast("binary"))


def round_robin(rows: DataFrame, strata: Sequence[str], n: int, seed: int = 42, key: str = "sequence_id") -> DataFrame:
    """``n`` rows dealt over the strata (see the module).

    Up to the session's limit for it (``spark.sql.optimizer.windowGroupLimitThreshold``) Spark itself drops the rows behind the
    ``n``-th of a stratum before the shuffle. Beyond it a row's place in its stratum is the number of rows in earlier ranges of its
    hash plus its place inside the range, and only ranges that hold rows up to the ``n``-th are looked at. Either way a
    stratum that holds most rows does not reach one task.
    """
    if n <= 0:
        return rows.limit(0)
    parts = [D.stratum(F.col(s)) for s in strata]
    numbered = rows.withColumn("_stratum", F.concat_ws("\x1f", *parts) if parts else F.lit(""))
    numbered = numbered.withColumn("_order", _hash(seed, or_blank(F.col(key).cast("string"))))
    if n <= int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        numbered = numbered.withColumn("_round", F.row_number().over(Window.partitionBy("_stratum").orderBy("_order", key)))
    else:
        numbered = numbered.withColumn("_range", F.substring("_order", 1, HASH_DIGITS))
        earlier = Window.partitionBy("_stratum").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = numbered.groupBy("_stratum", "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        ranges = ranges.filter(F.col("_before") < n).select("_stratum", "_range", "_before")
        inside = Window.partitionBy("_stratum", "_range").orderBy("_order", key)
        numbered = numbered.join(broadcast_if_small(ranges, MAX_BROADCAST_RANGES), ["_stratum", "_range"])
        numbered = numbered.withColumn("_round", F.row_number().over(inside) + F.col("_before"))
    dealt = numbered.filter(F.col("_round") <= n)
    return dealt.orderBy("_round", _hash(seed, F.col("_stratum")), "_stratum").limit(n).select(*rows.columns)


def build_samples(enriched: DataFrame, n_front: int = 100, n_rear: int = 100, n_unknown: int = 100, seed: int = 42, target_object_strata: bool = False) -> tuple[DataFrame, DataFrame]:
    """(front and rear sample, sample of unknown cameras) with the seeds ``seed``, ``seed + 1`` and ``seed + 2``.

    The enriched manifest has no target object, so by default it is no stratum; ``target_object_strata`` adds it.
    """
    base = base_rows(enriched)
    strata = list(STRATA)
    if target_object_strata:
        base, strata = base.withColumn("target_object", D.primary_object("label_objects_json")), [*strata, "target_object"]
    of = lambda camera: base.filter(strip(or_blank("preferred_camera_rule")) == camera)
    front, rear = round_robin(of("front"), strata, n_front, seed), round_robin(of("rear"), strata, n_rear, seed + 1)
    unknown = round_robin(of("unknown"), strata, n_unknown, seed + 2)
    return sampling_rows(front.unionByName(rear)), sampling_rows(unknown)
