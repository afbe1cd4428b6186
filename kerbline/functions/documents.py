"""Scalars over JSON documents and the rules that read a sequence's metadata."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from kerbline.functions.text import get_or_blank, is_blank, join_distinct, last_segment, or_blank, split_pipe, strip

_PAIR = "struct<id:variant,name:variant>"
DOCUMENT_SCHEMA = (
    "name string, status string, maxSpeedInKph string, minSpeedInKph string, "
    f"tags array<struct<id:variant,name:variant,tagCategory:{_PAIR},tagSubCategory:{_PAIR}>>, "
    "customFieldValues array<struct<field:struct<id:variant,name:variant,type:variant>,value:string>>"
)
#: Kinds of the custom field values, which tell a nested value from a text that looks like one.
VALUE_KINDS = "customFieldValues array<struct<value:variant>>"
# fixed values: subcategories with a column of their own
DIRECTION, APPROACH, WEATHER, SCENE, OBJECTS = "driving direction", "approach", "weather conditions", "scene", "label objects"


def allow_repeated_keys(spark: SparkSession) -> None:
    """Let the strict parse accept repeated keys, of which the last counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def document_text(payload: Column | str) -> Column:
    """Payload without white space around it and a leading byte order mark."""
    return strip(F.regexp_replace(strip(payload), "\\A\ufeff", ""))


def is_object(text: Column | str) -> Column:
    """Whether a text is exactly one JSON object; built-in parsers alone accept text behind it. Null is false."""
    text = F.col(text) if isinstance(text, str) else text
    # boxed in brackets, text behind the object is an error or a second member
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    whole = boxed.isNotNull() & F.try_variant_get(boxed, "$[1]", "variant").isNull()
    return F.coalesce(text.startswith("{") & whole, F.lit(False))


def naming(value: Column | str) -> Column:
    """Text of a JSON value that names something: null, 0, false and empty arrays and objects name nothing."""
    value = F.col(value) if isinstance(value, str) else value
    text, kind = value.cast("string"), F.schema_of_variant(value)
    empty = (kind != "STRING") & text.isin("0", "0.0", "-0.0", "false", "[]", "{}")
    return F.when(text.isNull() | empty, "").when((kind == "BOOLEAN") & (text == "true"), "True").otherwise(strip(text))


def spaced(raw: Column) -> Column:
    """JSON text with one blank behind commas and colons and none elsewhere, strings aside."""
    pieces = F.regexp_extract_all(raw, F.lit(r'"(?:[^"\\]|\\.)*+"|[^"\s,:]++|[,:]'), F.lit(0))
    return F.array_join(F.transform(pieces, lambda x: F.when(x.isin(",", ":"), F.concat(x, F.lit(" "))).otherwise(x)), "")


def value_text(raw: Column, kind: Column) -> Column:
    """Text of a JSON value: nested ones as spaced JSON, truth values capitalised."""
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    return F.when(raw.isNull(), "").when(nested, spaced(raw)).when(kind == "BOOLEAN", F.initcap(raw)).otherwise(raw)


def named_tags(document: Column) -> Column:
    """(subcategory, name) of each tag; of a subcategory only the part behind the last dot counts, in lower case."""
    return F.transform(document["tags"], lambda t: F.struct(F.lower(last_segment(naming(t["tagSubCategory"]["name"]))).alias("subcategory"), naming(t["name"]).alias("name")))


def tags_of(tags: Column | str, subcategory: str) -> Column:
    """Names of the ``named_tags`` of a subcategory."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    return F.transform(F.filter(tags, lambda t: (t["subcategory"] == subcategory) & (t["name"] != "")), lambda t: t["name"])


def first_field(document: Column, name: str) -> Column:
    """Value of the first custom field with a name (any case), or the empty string."""
    kept = F.filter(document["customFieldValues"], lambda c: F.lower(naming(c["field"]["name"])) == name)
    return F.coalesce(F.get(kept, F.lit(0))["value"], F.lit(""))


def preferred_camera(direction: Column | str) -> Column:
    """Camera that a driving direction asks for: front, rear or unknown."""
    d = F.lower(strip(or_blank(direction)))
    return F.when(d.isin("forward", "forwards"), "front").when(d.isin("backward", "backwards", "reverse", "rearward"), "rear").otherwise("unknown")


def camera_reason(camera: Column | str) -> Column:
    """Why ``preferred_camera`` chose as it did."""
    camera = F.col(camera) if isinstance(camera, str) else camera
    return F.when(camera == "unknown", "no_direction_rule").otherwise("json_driving_direction")


def resolved_camera(rule: Column | str) -> Column:
    """A rule's camera, front where it names none."""
    r = F.lower(strip(or_blank(rule)))
    return F.when(r.isin("front", "rear"), r).otherwise("front")


def primary_object(objects: Column | str) -> Column:
    """First object of a ``|``-joined list that is not ``empty``; counts behind a colon do not belong to the name."""
    names = F.filter(F.transform(split_pipe(objects), lambda x: strip(F.substring_index(x, ":", 1))), lambda x: x != "")
    filled = F.filter(names, lambda x: F.lower(x) != "empty")
    return F.when(F.size(filled) > 0, F.get(filled, F.lit(0))).when(F.size(names) > 0, "empty_control").otherwise("unknown")


def primary_weather(tags: Column | str) -> Column:
    """First weather tag or MISSING."""
    return F.coalesce(F.get(split_pipe(tags), F.lit(0)), F.lit("MISSING"))


def stratum(value: Column | str) -> Column:
    """Stratum key of a value: null and empty are MISSING, the rest is stripped."""
    value = F.col(value) if isinstance(value, str) else value
    return strip(F.when(value.isNull() | (value == ""), "MISSING").otherwise(value))


__all__ = [name for name in dir() if not name.startswith("_")] + ["get_or_blank", "is_blank", "join_distinct"]
