"""Metadata documents: flattening, enrichment of the manifest, profiles.

All of it runs on built-in JSON expressions; a document is parsed once per row and fans out from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions import documents as D
from kerbline.functions.text import get_or_blank, join_distinct, or_blank, strip
from kerbline.operators.profile import Group, counter_profile, overview, piped
from kerbline.session import spread


def parse(records: DataFrame, payload: str = "payload") -> DataFrame:
    """``records`` with ``text`` (clean payload), ``ok`` (exactly one JSON object) and ``doc`` (null unless ok)."""
    D.allow_repeated_keys(records.sparkSession)
    rows = spread(records).withColumn("text", D.document_text(payload))
    rows = rows.withColumn("ok", D.is_object("text"))
    return rows.withColumn("doc", F.when(F.col("ok"), F.from_json("text", D.DOCUMENT_SCHEMA)))


def errors(parsed: DataFrame, path: str = "metadata_json") -> DataFrame:
    """(record_id, sequence_id, error) of records without path, without document, or with an unreadable one."""
    why = (
        F.when(strip(or_blank(path)) == "", "missing_metadata_path")
        .when(F.col("text").isNull(), "metadata_file_not_found")
        .when(~F.col("ok"), "unreadable: not exactly one JSON object")
    )
    return parsed.select("record_id", "sequence_id", why.alias("error")).filter(F.col("error").isNotNull())


def tags_long(parsed: DataFrame) -> DataFrame:
    """One row per tag, blanks for what is missing."""
    t = parsed.select("record_id", "sequence_id", F.explode("doc.tags").alias("t"))
    return t.select(
        "record_id",
        "sequence_id",
        D.naming("t.id").alias("tag_id"),
        D.naming("t.name").alias("tag_name"),
        D.naming("t.tagCategory.id").alias("category_id"),
        D.naming("t.tagCategory.name").alias("category_name"),
        D.naming("t.tagSubCategory.id").alias("subcategory_id"),
        D.naming("t.tagSubCategory.name").alias("subcategory_name"),
    )


def fields_long(parsed: DataFrame) -> DataFrame:
    """One row per custom field; a nested value is its JSON text."""
    kinds = F.transform(F.from_json("text", D.VALUE_KINDS)["customFieldValues"], lambda c: F.schema_of_variant(c["value"]))
    rows = parsed.filter(F.size("doc.customFieldValues") > 0).select("record_id", "sequence_id", F.explode(F.arrays_zip(F.col("doc.customFieldValues").alias("c"), kinds.alias("kind"))).alias("z"))
    return rows.select(
        "record_id",
        "sequence_id",
        D.naming("z.c.field.id").alias("field_id"),
        D.naming("z.c.field.name").alias("field_name"),
        D.naming("z.c.field.type").alias("field_type"),
        D.value_text(F.col("z.c.value"), F.col("z.kind")).alias("value"),
    )


def key_counts(parsed: DataFrame) -> DataFrame:
    """(key, present_count, nonempty_count) of top-level keys; 0 and false are not empty, of repeated keys the last counts."""
    keys = parsed.filter("ok").select(F.explode(F.array_distinct(F.json_object_keys("text"))).alias("key"), F.from_json("text", "map<string,string>").alias("m"))
    # a lookup in the map would give the first of repeated keys
    value = F.element_at(F.filter(F.map_entries("m"), lambda e: e["key"] == F.col("key")), -1)["value"]
    filled = value.isNotNull() & ~F.regexp_replace(value, r"\s+", "").isin("", "[]", "{}")
    return keys.groupBy("key").agg(F.count("*").alias("present_count"), F.count_if(filled).alias("nonempty_count"))


def flat(parsed: DataFrame) -> DataFrame:
    """One row per readable document: names, joined tags, speeds and sizes."""
    doc = F.col("doc")
    direction = join_distinct(D.tags_of("_tags", D.DIRECTION))
    return parsed.filter("ok").withColumn("_tags", D.named_tags(doc)).select(
        "record_id",
        "sequence_id",
        strip(or_blank("doc.name")).alias("json_name"),
        strip(or_blank("doc.status")).alias("json_status"),
        direction.alias("driving_direction"),
        D.preferred_camera(direction).alias("preferred_camera_from_json"),
        join_distinct(D.tags_of("_tags", D.APPROACH)).alias("approach"),
        join_distinct(D.tags_of("_tags", D.WEATHER)).alias("weather_tags"),
        join_distinct(D.tags_of("_tags", D.SCENE)).alias("scene_tags"),
        join_distinct(D.tags_of("_tags", D.OBJECTS)).alias("label_objects_json"),
        or_blank("doc.maxSpeedInKph").alias("max_speed_kph"),
        or_blank("doc.minSpeedInKph").alias("min_speed_kph"),
        D.first_field(doc, "avg speed").alias("avg_speed"),
        F.coalesce(F.size("doc.tags"), F.lit(0)).alias("num_tags"),
        F.coalesce(F.size("doc.customFieldValues"), F.lit(0)).alias("num_custom_fields"),
        F.array_join(F.array_sort(F.array_distinct(F.json_object_keys("text"))), "|").alias("top_level_keys"),
    )


def enrich(manifest: DataFrame, documents: DataFrame, *, path: str = "metadata_json", payload: str = "payload") -> DataFrame:
    """The manifest with 14 columns from each row's document, which is looked up by path.

    Of several documents under one path the one received last counts. Without a document the row says ``no_metadata``;
    an unreadable one, or one whose tags or custom fields are no arrays, says ``json_parse_error`` and keeps camera unknown.
    """
    D.allow_repeated_keys(manifest.sparkSession)
    order = [c for c in ("received_at", "record_id") if c in documents.columns]
    latest = documents.filter(F.col(path).isNotNull()).groupBy(path).agg(F.max_by(payload, F.struct(*order) if order else F.length(payload)).alias("payload"))
    rows = parse(manifest.drop("payload").join(latest, path, "left")).withColumn("_tags", D.named_tags(F.col("doc")))
    exists = F.col("text").isNotNull()
    # absent arrays are fine, null ones and other shapes are not
    broken = lambda key: F.col(f"doc.{key}").isNull() & F.array_contains(F.json_object_keys("text"), key)
    loaded = F.col("ok") & ~broken("tags") & ~broken("customFieldValues")
    doc = F.col("doc")
    direction = get_or_blank(D.tags_of("_tags", D.DIRECTION), 0)
    camera = F.when(loaded, D.preferred_camera(direction)).otherwise("unknown")
    reason = F.when(~exists, "no_metadata").when(~loaded, "json_parse_error").otherwise(D.camera_reason(camera))
    return rows.withColumns(
        {
            "metadata_exists": exists.cast("int"),
            "json_loaded": F.coalesce(loaded, F.lit(False)).cast("int"),
            "sequence_name_json": strip(or_blank("doc.name")),
            "sequence_status_json": strip(or_blank("doc.status")),
            "driving_direction": direction,
            "approach": get_or_blank(D.tags_of("_tags", D.APPROACH), 0),
            "scene_tags": join_distinct(D.tags_of("_tags", D.SCENE)),
            "weather_tags": join_distinct(D.tags_of("_tags", D.WEATHER)),
            "label_objects_json": join_distinct(D.tags_of("_tags", D.OBJECTS)),
            "max_speed_kph": or_blank("doc.maxSpeedInKph"),
            "min_speed_kph": or_blank("doc.minSpeedInKph"),
            "avg_speed": D.first_field(doc, "avg speed"),
            "preferred_camera_rule": camera,
            "preferred_camera_rule_reason": reason,
        }
    ).drop("payload", "text", "ok", "doc", "_tags")


#: Groups of the profiles, in the order of their reports.
MANIFEST_GROUPS = ("driving_direction", "preferred_camera_rule", "json_loaded", "is_poc_ready", "weather_tags", "scene_tags", "label_objects_json")
DOCUMENT_GROUPS = ("driving_direction", "preferred_camera", "status", "weather", "scene", "approach", "label_objects")


def manifest_profile(enriched: DataFrame, first_seen: str | None = None) -> DataFrame:
    """(group, value, count) over seven groups of the enriched manifest."""
    groups = [
        Group("driving_direction", "driving_direction", missing="MISSING"),
        Group("preferred_camera_rule", "preferred_camera_rule", missing="MISSING"),
        Group("json_loaded", "json_loaded"),
        Group("is_poc_ready", F.initcap(F.col("is_poc_ready").cast("string"))),
        piped("weather_tags", "weather_tags", 50),
        piped("scene_tags", "scene_tags", 50),
        piped("label_objects_json", "label_objects_json", 100),
    ]
    return counter_profile(enriched, groups, first_seen)


def document_profile(flat_rows: DataFrame, first_seen: str | None = None) -> DataFrame:
    """(group, value, count) over the distinct values of each flat document."""
    groups = [
        Group("driving_direction", "driving_direction", missing="MISSING"),
        Group("preferred_camera", "preferred_camera_from_json", missing="MISSING"),
        Group("status", "json_status", missing="MISSING"),
        piped("weather", "weather_tags", 100),
        piped("scene", "scene_tags", 100),
        piped("approach", "approach", 100),
        piped("label_objects", "label_objects_json", 200),
    ]
    return counter_profile(flat_rows, groups, first_seen)


def document_overview(parsed: DataFrame) -> DataFrame:
    """(metric, value): documents, readable ones, tags, custom fields, errors."""
    return overview(
        parsed,
        {
            "documents": F.count(F.lit(1)),
            "json_loaded": F.count_if(F.col("ok")),
            "json_errors": F.count_if(~F.col("ok")),
            "tags": F.coalesce(F.sum(F.greatest(F.size("doc.tags"), F.lit(0))), F.lit(0)),
            "custom_fields": F.coalesce(F.sum(F.greatest(F.size("doc.customFieldValues"), F.lit(0))), F.lit(0)),
        },
    )


def count_by(df: DataFrame, *columns: str, top: int | None = None) -> DataFrame:
    """Counts by columns, the most frequent ``top`` of them (ties by value)."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("count"))
    return counts if top is None else counts.orderBy(F.desc("count"), *columns).limit(top)
