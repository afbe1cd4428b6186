"""Named queries over the driver tables for every relational operator, each with independent SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions import documents as D
from kerbline.functions import geometry as G
from kerbline.functions import review as R
from kerbline.functions.text import last_segment, strip
from kerbline.operators import inventory, labels, media, metadata, review, sampling
from kerbline.operators.profile import Group, counter_profile, overview
from kerbline.plans.curation import loaded_sql
from kerbline.session import shared_folder
from kerbline.sources import sinks, tables
from kerbline.sources.inventory import list_files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is any."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


MANIFEST, RECORDS = "sequence_manifest_enriched", "metadata_json"


# --- manifest -----------------------------------------------------------------------------------------------------


def _counts(group: str, value: str, top: int | None = None, source: str = f"from {MANIFEST}") -> str:
    ranked = f"select '{group}' as \"group\", {value} as value, count(*) as \"count\" {source} group by all"
    return f"(select * from ({ranked}) order by \"count\" desc, value limit {top})" if top else f"({ranked})"


def _pipes(column: str, source: str = MANIFEST) -> str:
    return f"from (select {_strip('p')} as part from (select unnest(string_split({column}, '|')) as p from {source})) where part <> ''"


@query(
    " union all ".join(
        [
            _counts("driving_direction", "coalesce(nullif(driving_direction, ''), 'MISSING')"),
            _counts("preferred_camera_rule", "coalesce(nullif(preferred_camera_rule, ''), 'MISSING')"),
            _counts("json_loaded", "coalesce(json_loaded::varchar, '')"),
            _counts("is_poc_ready", "case when is_poc_ready then 'True' when not is_poc_ready then 'False' else '' end"),
            _counts("weather_tags", "part", 50, _pipes("weather_tags")),
            _counts("scene_tags", "part", 50, _pipes("scene_tags")),
            _counts("label_objects_json", "part", 100, _pipes("label_objects_json")),
        ]
    )
)
def manifest_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.manifest_profile(table(spark, sf_dir, MANIFEST))


@query("select 'lang' as \"group\", coalesce(lang, '') as value, count(*) as \"count\" from documents group by 2 union all select 'source', coalesce(source, 'MISSING'), count(*) from documents group by 2")
def profile_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counter_profile(table(spark, sf_dir, "documents"), [Group("lang", "lang"), Group("source", "source", missing="MISSING")])


@query("select 'event_type' as \"group\", event_type as value, count(*) as \"count\" from events group by 2 order by 3 desc, min(event_id) limit 3")
def counter_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counter_profile(table(spark, sf_dir, "events"), [Group("event_type", "event_type", top=3)], first_seen="event_id")


@query(rf"select distinct sequence_dir, regexp_replace(sequence_dir, '[/\\]', '__', 'g') as made_id from {MANIFEST}")
def sequence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, MANIFEST).select("sequence_dir", inventory.sequence_id("sequence_dir").alias("made_id")).distinct()


_FILES = f"files as (select distinct path from (select unnest([{', '.join(inventory.ROLES)}]) as path from {MANIFEST}) where path is not null and path <> '')"
_PARTS = (
    "parts as (select path, regexp_replace(path, '/?[^/]*$', '') as dir, lower(regexp_extract(path, '[^/]*$')) as name, "
    "lower(regexp_extract(path, '[^/.][^/]*\\.([^./]+)$', 1)) as suffix from files)"
)
_VIDEO_RANK = "case suffix when 'mp4' then 0 when 'webm' then 1 when 'avi' then 2 end"
_ROLE_SQL = {
    **{f"{c}_video": f"arg_min(path, ({_VIDEO_RANK})::varchar || path) filter ({t} and suffix in ('mp4', 'webm', 'avi'))" for c, t in (("front", "name like '%front%'"), ("rear", "name like '%rear%'"), ("topview", "(name like '%topview%' or name like '%uss%')"))},
    **{f"{c}_image": f"min(path) filter ({t} and suffix in ('jpg', 'jpeg', 'png', 'bmp', 'webp'))" for c, t in (("front", "name like '%front%'"), ("rear", "name like '%rear%'"), ("topview", "(name like '%topview%' or name like '%uss%')"))},
    **{f"label_v{v}_{k}": f"min(path) filter (contains(name, 'label_v{v}') and suffix = '{k}')" for k in ("csv", "xlsx") for v in (1, 2)},
    "metadata_json": "min(path) filter (suffix = 'json')",
    "mf4_file": "min(path) filter (suffix = 'mf4')",
    "pfdf4_pure_bz2": "min(path) filter (name like '%.pure.bz2' or name like '%pfdf4%')",
}
_ROLED = f"with {_FILES}, {_PARTS}, roles as (select dir, {', '.join(f'{e} as {r}' for r, e in _ROLE_SQL.items())} from parts group by dir), " + (
    f"dirs as (select *, {' + '.join(f'({r} is not null)::int' for r in inventory.ROLES)} as evidence from roles)"
)


def _listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, MANIFEST).select(F.explode(F.array(*inventory.ROLES)).alias("path"))
    return paths.filter(F.col("path").isNotNull() & (F.col("path") != "")).distinct()


@query(f"{_ROLED} select dir, {', '.join(inventory.ROLES)}, evidence from dirs")
def directory_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.directory_roles(_listed_files(spark, sf_dir)).select("dir", *inventory.ROLES, "evidence")


@query(
    rf"{_ROLED}, kept as (select * from dirs where evidence >= 3 and dir <> '') "
    rf"select regexp_replace(dir, '[/\\]', '__', 'g') as sequence_id, dir as sequence_dir, {', '.join(inventory.ROLES)}, "
    "front_video is not null and topview_video is not null and label_v2_csv is not null as is_poc_ready from kept k "
    "where not exists (select 1 from kept d where starts_with(d.dir, k.dir || '/'))"
)
def build_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.build_manifest(_listed_files(spark, sf_dir))


@query(
    f"with d as (select distinct unnest([sequence_dir, regexp_replace(sequence_dir, '/[^/]*$', ''), regexp_replace(sequence_dir, '/.*$', '')]) as dir from {MANIFEST}) "
    "select dir from d where not exists (select 1 from d e where starts_with(e.dir, d.dir || '/'))"
)
def leaf_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("sequence_dir")
    every = F.array(d, F.regexp_replace(d, r"/[^/]*\z", ""), F.regexp_replace(d, r"/.*\z", ""))
    return inventory.leaf_directories(table(spark, sf_dir, MANIFEST).select(F.explode(every).alias("dir")))


# --- metadata documents -------------------------------------------------------------------------------------------

_DOCS = (
    f"docs as (select *, coalesce(json_type(text) = 'OBJECT', false) as ok from (select record_id, sequence_id, metadata_json, t is null as absent, case when json_valid(t) then t end as text from "
    f"(select *, {_strip('regexp_replace(' + _strip('payload') + ', chr(65279), chr(32))')} as t from {RECORDS})))"
)


def _naming(x: str, path: str) -> str:
    """Text of a JSON value that names something; 0, false and empty containers do not."""
    text = f"{x}->>'{path}'"
    return f"case when json_type({x}, '{path}') is null or json_type({x}, '{path}') = 'NULL' then '' when json_type({x}, '{path}') = 'VARCHAR' then {_strip(text)} when {text} in ('0', '0.0', '-0.0', 'false', '[]', '{{}}') then '' when {text} = 'true' then 'True' else {text} end"


_TAGS = (
    f"with {_DOCS}, tags as (select record_id, sequence_id, unnest(json_extract(text, '$.tags[*]')) as t from docs where ok and json_type(text, '$.tags') = 'ARRAY'), "
    "long as (select record_id, sequence_id, "
    + ", ".join(
        f"{_naming('t', path)} as {name}"
        for name, path in (
            ("tag_id", "$.id"), ("tag_name", "$.name"), ("category_id", "$.tagCategory.id"), ("category_name", "$.tagCategory.name"),
            ("subcategory_id", "$.tagSubCategory.id"), ("subcategory_name", "$.tagSubCategory.name"),
        )
    )
    + " from tags)"
)


def _value(x: str) -> str:
    """Text of a JSON value, nested ones with one blank behind commas and colons."""
    pieces = rf"""regexp_extract_all(({x})::varchar, '"(?:[^"\\]|\\.)*"|[^"\s,:]+|[,:]')"""
    spaced = f"array_to_string(list_transform({pieces}, lambda p: case when p in (',', ':') then p || ' ' else p end), '')"
    return f"case when coalesce(json_type({x}), 'NULL') = 'NULL' then '' when json_type({x}) in ('OBJECT', 'ARRAY') then {spaced} when json_type({x}) = 'BOOLEAN' then upper(({x}->>'$')[1]) || ({x}->>'$')[2:] else {x}->>'$' end"


_FIELDS = (
    f"with {_DOCS}, fields as (select record_id, sequence_id, unnest(json_extract(text, '$.customFieldValues[*]')) as c from docs "
    "where ok and json_type(text, '$.customFieldValues') = 'ARRAY'), "
    "long as (select record_id, sequence_id, "
    + ", ".join(f"{_naming('c', f'$.field.{k}')} as field_{k}" for k in ("id", "name", "type"))
    + f", {_value('v')} as value from (select *, json_extract(c, '$.value') as v from fields))"
)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.parse(table(spark, sf_dir, RECORDS))


@query(f"{_TAGS} select * from long")
def json_tags_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.tags_long(_parsed(spark, sf_dir))


@query(f"{_FIELDS} select * from long")
def json_fields_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.fields_long(_parsed(spark, sf_dir))


#: The last value of a top-level key, as a repeated key's last value counts.
_LAST = "(select last(e.value order by e.id) from json_each(text) e where e.key = {key})"


@query(
    f"with {_DOCS}, k as (select record_id, text, unnest(list_distinct(json_keys(text))) as key from docs where ok), "
    f"v as (select key, {_LAST.format(key='k.key')} as value from k) "
    "select key, count(*) as present_count, count(*) filter (value is not null and regexp_replace(value::varchar, '\\s+', '', 'g') not in ('null', '\"\"', '[]', '{}'))"
    " as nonempty_count from v group by key"
)
def json_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.key_counts(_parsed(spark, sf_dir))


@query(f"{_TAGS} select tag_name, count(*) as \"count\" from long group by 1")
def json_tag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.count_by(metadata.tags_long(_parsed(spark, sf_dir)), "tag_name")


@query(f"{_TAGS} select subcategory_name, count(*) as \"count\" from long group by 1")
def json_tag_subcategories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.count_by(metadata.tags_long(_parsed(spark, sf_dir)), "subcategory_name")


@query(f"{_TAGS} select category_name, count(*) as \"count\" from long group by 1")
def json_tag_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.count_by(metadata.tags_long(_parsed(spark, sf_dir)), "category_name")


@query(f"{_TAGS} select category_name, subcategory_name, count(*) as \"count\" from long group by 1, 2")
def json_category_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.count_by(metadata.tags_long(_parsed(spark, sf_dir)), "category_name", "subcategory_name")


@query(f"{_FIELDS} select field_name, count(*) as \"count\" from long group by 1")
def json_field_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.count_by(metadata.fields_long(_parsed(spark, sf_dir)), "field_name")


@query(f"{_FIELDS} select field_name, value, count(*) as \"count\" from long where value <> '' group by 1, 2 order by 3 desc, 1, 2 limit 500")
def json_field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent of all non-empty values, nested ones as JSON text."""
    return metadata.count_by(metadata.fields_long(_parsed(spark, sf_dir)).filter("value <> ''"), "field_name", "value", top=500)


@query(
    f"with {_DOCS} select record_id, sequence_id, case when trim(coalesce(metadata_json, '')) = '' then 'missing_metadata_path' when absent then 'metadata_file_not_found' "
    "else 'unreadable: not exactly one JSON object' end as error from docs where trim(coalesce(metadata_json, '')) = '' or absent or not ok"
)
def json_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.errors(_parsed(spark, sf_dir))


def _joined(sub: str) -> str:
    """Distinct tag names of a subcategory in order of appearance, joined."""
    last = f"regexp_extract({_naming('x', '$.tagSubCategory.name')}, '[^.]*$')"
    return (
        f"(select string_agg(n, '|' order by k) from (select n, min(k) as k from (select {_naming('x', '$.name')} as n, k from ("
        "select unnest(json_extract(text, '$.tags[*]')) as x, generate_subscripts(json_extract(text, '$.tags[*]'), 1) as k where json_type(text, '$.tags') = 'ARRAY') "
        f"where lower({_strip(last)}) = '{sub}') where n <> '' group by n))"
    )


def _q(x: str, path: str) -> str:
    return f"coalesce({x}->>'{path}', '')"


def _text(key: str) -> str:
    """Text of the last value of a top-level key."""
    return f"coalesce({_LAST.format(key=chr(39) + key + chr(39))}->>'$', '')"


#: The first custom field that is named so.
_AVERAGE = (
    "coalesce((select first(v->>'$' order by k) from (select json_extract(c, '$.value') as v, k from (select unnest(json_extract(text, '$.customFieldValues[*]')) as c, "
    f"generate_subscripts(json_extract(text, '$.customFieldValues[*]'), 1) as k where json_type(text, '$.customFieldValues') = 'ARRAY') where lower({_naming('c', '$.field.name')}) = 'avg speed')), '')"
)
_CAMERA = "case when lower(trim({d})) in ('forward', 'forwards') then 'front' when lower(trim({d})) in ('backward', 'backwards', 'reverse', 'rearward') then 'rear' else 'unknown' end"
_FLAT = (
    f"with {_DOCS}, flat as (select record_id, sequence_id, trim({_q('text', '$.name')}) as json_name, "
    + ", ".join(f"coalesce({_joined(sub)}, '') as {name}" for name, sub in (("driving_direction", D.DIRECTION), ("approach", D.APPROACH), ("weather_tags", D.WEATHER), ("scene_tags", D.SCENE), ("label_objects_json", D.OBJECTS)))
    + f", {_strip(_text('status'))} as json_status, {_text('maxSpeedInKph')} as max_speed_kph, {_text('minSpeedInKph')} as min_speed_kph, {_AVERAGE} as avg_speed, "
    "case when json_type(text, '$.tags') = 'ARRAY' then json_array_length(text, '$.tags') else 0 end::int as num_tags, "
    "case when json_type(text, '$.customFieldValues') = 'ARRAY' then json_array_length(text, '$.customFieldValues') else 0 end::int as num_custom_fields, "
    "array_to_string(list_sort(list_distinct(json_keys(text))), '|') as top_level_keys from docs where ok)"
)


@query(f"{_FLAT} select *, {_CAMERA.format(d='driving_direction')} as preferred_camera_from_json from flat")
def json_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.flat(_parsed(spark, sf_dir))


@query(
    f"{_FLAT} "
    + " union all ".join(
        [
            _counts("driving_direction", "coalesce(nullif(driving_direction, ''), 'MISSING')", None, "from flat"),
            _counts("preferred_camera", _CAMERA.format(d="driving_direction"), None, "from flat"),
            _counts("status", "coalesce(nullif(json_status, ''), 'MISSING')", None, "from flat"),
            _counts("weather", "part", 100, _pipes("weather_tags", "flat")),
            _counts("scene", "part", 100, _pipes("scene_tags", "flat")),
            _counts("approach", "part", 100, _pipes("approach", "flat")),
            _counts("label_objects", "part", 200, _pipes("label_objects_json", "flat")),
        ]
    )
)
def json_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.document_profile(metadata.flat(_parsed(spark, sf_dir)))


@query(
    f"with {_DOCS}, n as (select count(*) as documents, count(*) filter (ok) as json_loaded, count(*) filter (not ok) as json_errors, "
    "coalesce(sum(case when ok and json_type(text, '$.tags') = 'ARRAY' then json_array_length(text, '$.tags') end), 0)::bigint as tags, "
    "coalesce(sum(case when ok and json_type(text, '$.customFieldValues') = 'ARRAY' then json_array_length(text, '$.customFieldValues') end), 0)::bigint as custom_fields from docs) "
    "unpivot n on documents, json_loaded, json_errors, tags, custom_fields into name metric value value"
)
def json_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.document_overview(_parsed(spark, sf_dir))


_LATEST = f"last as (select metadata_json as path, arg_max(record_id, (received_at, record_id)) as record_id from {RECORDS} where metadata_json is not null and payload is not null group by 1)"
_MANIFEST_OWN = "sequence_id sequence_dir front_video rear_video topview_video front_image rear_image topview_image label_v1_csv label_v2_csv label_v1_xlsx label_v2_xlsx metadata_json mf4_file pfdf4_pure_bz2 is_poc_ready".split()


def _if_json(x: str) -> str:
    return f"coalesce(case when json_valid(text) then {x} end, '')"


@query(
    f"with {_DOCS}, {_LATEST}, m as (select distinct {', '.join(_MANIFEST_OWN)} from {MANIFEST}), "
    "r as (select m.*, d.record_id is null as absent, case when d.ok then d.text end as text, d.ok and coalesce(json_type(d.text, '$.tags') = 'ARRAY', not list_contains(json_keys(d.text), 'tags')) and "
    "coalesce(json_type(d.text, '$.customFieldValues') = 'ARRAY', not list_contains(json_keys(d.text), 'customFieldValues')) as loaded "
    "from m left join last l on l.path = m.metadata_json left join docs d on d.record_id = l.record_id), "
    f"e as (select *, {_if_json(f'string_split({_joined(D.DIRECTION)}, chr(124))[1]')} as driving_direction, {_if_json(f'string_split({_joined(D.APPROACH)}, chr(124))[1]')} as approach, "
    f"{_if_json(_joined(D.SCENE))} as scene_tags, {_if_json(_joined(D.WEATHER))} as weather_tags, {_if_json(_joined(D.OBJECTS))} as label_objects_json, {_if_json(_strip(_text('name')))} as sequence_name_json, "
    f"{_if_json(_strip(_text('status')))} as sequence_status_json, {_if_json(_text('maxSpeedInKph'))} as max_speed_kph, {_if_json(_text('minSpeedInKph'))} as min_speed_kph, {_if_json(_AVERAGE)} as avg_speed from r) "
    f"select {', '.join(_MANIFEST_OWN)}, (not absent)::int as metadata_exists, coalesce(loaded, false)::int as json_loaded, sequence_name_json, sequence_status_json, driving_direction, approach, scene_tags, weather_tags, "
    f"label_objects_json, max_speed_kph, min_speed_kph, avg_speed, case when loaded then {_CAMERA.format(d='driving_direction')} else 'unknown' end as preferred_camera_rule, "
    f"case when absent then 'no_metadata' when not loaded then 'json_parse_error' when {_CAMERA.format(d='driving_direction')} = 'unknown' then 'no_direction_rule' "
    "else 'json_driving_direction' end as preferred_camera_rule_reason from e"
)
def enrich_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 30 columns."""
    manifest = table(spark, sf_dir, MANIFEST).select(*_MANIFEST_OWN).distinct()
    return metadata.enrich(manifest, table(spark, sf_dir, RECORDS).filter("payload is not null"))


# --- sampling -----------------------------------------------------------------------------------------------------

_ONE = f"one as (select distinct on (sequence_id) * from {MANIFEST} order by sequence_id, ingested_at, logger_note nulls first)"
_BASE = "base as (select * from one where is_poc_ready and json_loaded = 1 and regexp_replace(coalesce(label_v2_csv, ''), '\\s', '', 'g') <> '')"


def _manifest_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sequence of the manifest."""
    rows = table(spark, sf_dir, MANIFEST)
    first = F.min_by(F.struct(*rows.columns), F.struct("ingested_at", "logger_note")).alias("r")
    return rows.groupBy("sequence_id").agg(first).select("r.*")


@query(f"select sequence_id, is_poc_ready, json_loaded, label_v2_csv from {MANIFEST} where is_poc_ready and json_loaded = 1 and regexp_replace(coalesce(label_v2_csv, ''), '\\s', '', 'g') <> ''")
def base_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.base_rows(table(spark, sf_dir, MANIFEST)).select("sequence_id", "is_poc_ready", "json_loaded", "label_v2_csv")


def _dealt(camera: str, seed: int, n: int, name: str) -> str:
    key = "concat_ws(chr(31), " + ", ".join(_strip(f"case when coalesce({c}, '') = '' then 'MISSING' else {c} end") for c in sampling.STRATA) + ")"
    return (
        f"{name} as (select sequence_id from (select sequence_id, {key} as k, row_number() over (partition by {key} order by md5('{seed}' || chr(31) || coalesce(sequence_id, '')), sequence_id) as r "
        f"from base where trim(coalesce(preferred_camera_rule, '')) = '{camera}') order by r, md5('{seed}' || chr(31) || k), k limit {n})"
    )


@query(f"with {_ONE}, {_BASE}, {_dealt('front', 42, 137, 'front')} select * from front")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    front = sampling.base_rows(_manifest_once(spark, sf_dir)).filter(F.trim("preferred_camera_rule") == "front")
    return sampling.round_robin(front, sampling.STRATA, 137).select("sequence_id")


_NAMES = f"list_filter(list_transform(string_split(coalesce(label_objects_json, ''), '|'), lambda x: {_strip('string_split(x, chr(58))[1]')}), lambda x: x <> '')"
_WEATHERS = f"list_filter(list_transform(string_split(coalesce(weather_tags, ''), '|'), lambda x: {_strip('x')}), lambda x: x <> '')"


_TARGET = f"coalesce(list_filter({_NAMES}, lambda x: lower(x) <> 'empty')[1], case when len({_NAMES}) > 0 then 'empty_control' else 'unknown' end)"
_ROW = (
    "sequence_id, sequence_dir, is_poc_ready, json_loaded, preferred_camera_rule, preferred_camera_rule_reason, driving_direction, approach, scene_tags, weather_tags, label_objects_json, "
    f"{_TARGET} as target_object, {_TARGET} as primary_label_object, coalesce({_WEATHERS}[1], 'MISSING') as primary_weather, front_video, rear_video, topview_video, label_v2_csv, metadata_json"
)


@query(f"select {_ROW} from {MANIFEST}")
def sampling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sampling_rows(table(spark, sf_dir, MANIFEST))


@query(
    f"with {_ONE}, {_BASE}, {_dealt('front', 42, 100, 'f')}, {_dealt('rear', 43, 100, 'r')}, {_dealt('unknown', 44, 100, 'u')}, "
    "p as (select 'ready' as sample, sequence_id from f union all select 'ready', sequence_id from r union all select 'unknown', sequence_id from u) "
    f"select sample, b.* from p join (select {_ROW} from base) b using (sequence_id)"
)
def sample_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready, unknown = sampling.build_samples(_manifest_once(spark, sf_dir))
    return ready.withColumn("sample", F.lit("ready")).unionByName(unknown.withColumn("sample", F.lit("unknown")))


@query(f"select sequence_id, {_CAMERA.format(d='''coalesce(driving_direction, '')''')} as camera, case when {_CAMERA.format(d='''coalesce(driving_direction, '')''')} = 'unknown' then 'no_direction_rule' else 'json_driving_direction' end as reason from {MANIFEST}")
def camera_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    camera = D.preferred_camera("driving_direction")
    return table(spark, sf_dir, MANIFEST).select("sequence_id", camera.alias("camera"), D.camera_reason(camera).alias("reason"))


@query(f"{_TAGS} select distinct subcategory_name, {_strip('regexp_extract(subcategory_name, ' + chr(39) + '[^.]*$' + chr(39) + ')')} as canonical from long")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = metadata.tags_long(_parsed(spark, sf_dir))
    return tags.select("subcategory_name", last_segment("subcategory_name").alias("canonical")).distinct()


# --- label files --------------------------------------------------------------------------------------------------


def _find_sql(names: tuple[str, ...]) -> str:
    low = "lower(trim(c))"
    exact = [f"list_filter(cols, lambda c: {low} = '{n}')[-1]" for n in names]
    inside = "list_filter(cols, lambda c: " + " or ".join(f"contains({low}, '{n}')" for n in names) + ")[1]"
    return f"coalesce({', '.join(exact)}, {inside}, '')"


@query("with p as (select distinct sequence_id, columns, string_split(columns, '|') as cols from label_sequence_profile) select sequence_id, columns, " + ", ".join(f"{_find_sql(n)} as {r}" for r, n in labels.CANDIDATES.items()) + " from p")
def label_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "label_sequence_profile").select("sequence_id", "columns").distinct()
    return rows.select("sequence_id", "columns", *[c.alias(r) for r, c in labels.role_columns(F.split("columns", r"\|")).items()])


_CELLS = (
    loaded_sql() + ", u as (select file_path, line_no, unnest(names) as n, unnest(fields) as v from d), "
    f"c as (select file_path, line_no, n, case when v not in ('NA', 'None') then nullif({_strip('v')}, '') end as v from u) "
)


@query(
    _CELLS + "select file_path as file, n as column_name, count(v) as nonempty_count, coalesce(array_to_string((list(v order by line_no nulls last, v) filter (v is not null))[1:5], '|'), '') as sample_values from c group by 1, 2"
)
def label_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column profile of the raw lines of every file, whether or not a stored profile has it."""
    return labels.profile_lines(table(spark, sf_dir, "label_v2_csv"))


@query(loaded_sql() + "select num_label_rows, count(*) as files from (select file_path, count(*) as num_label_rows from d group by 1) group by 1")
def rows_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted from the label lines of every file."""
    return labels.rows_per_file(table(spark, sf_dir, "label_v2_csv"))


@query(
    "with p as (select distinct * from label_sequence_profile) "
    + " union all ".join(
        [
            _counts("columns", "c", None, "from (select unnest(string_split(columns, '|')) as c from p)"),
            _counts("target_object_from_json", "coalesce(target_object, '')", 100, "from p"),
            _counts("rows_per_label_file", "num_label_rows::varchar", 50, "from p"),
        ]
    )
)
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_summary(table(spark, sf_dir, "label_sequence_profile").distinct())


def _role(role: str) -> str:
    """Value of the column that plays a role, blank where there is none; files with repeated names have no roles."""
    found = _find_sql(labels.CANDIDATES[role]).replace("cols", "names")
    return f"case when len(list_distinct(names)) = len(names) then coalesce({_strip(f'fields[list_position(names, {found})]')}, '') else '' end"


@query(
    loaded_sql() + ", k as (select *, row_number() over (partition by file_path order by line_no nulls last, record_id) as k from d) select file_path as file, (k - 1)::int as label_row_idx, "
    + ", ".join(f"{_role(r)} as {n}" for n, r in (("class_value", "class_col"), ("object_value", "object_col"), ("distance_value", "distance_col"), *((r[:-4], r) for r in list(labels.CANDIDATES)[3:])))
    + " from k where k <= 20"
)
def label_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.preview_lines(table(spark, sf_dir, "label_v2_csv"))


def _top_values(group: str, role: str, top: int) -> str:
    value = _strip(f"fields[list_position(names, {_find_sql(labels.CANDIDATES[role]).replace('cols', 'names')})]")
    return f"(select '{group}' as \"group\", v as value, count(*) as \"count\" from (select {value} as v from d) where v is not null and v not in ('', 'NA', 'None') group by 2 order by 3 desc, 2 limit {top})"


@query(loaded_sql() + f"select * from {_top_values('label_object_values', 'object_col', 100)} union all select * from {_top_values('class_values', 'class_col', 50)}")
def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.value_counts(table(spark, sf_dir, "label_v2_csv"))


@query("unpivot (select " + ", ".join(f"count(*) filter (trim(coalesce({c}, '')) <> '') as {c}" for c in ("sequence_id", "driving_direction", "approach", "logger_note", "rear_video")) + f" from {MANIFEST}) on columns(*) into name metric value value")
def nonempty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("sequence_id", "driving_direction", "approach", "logger_note", "rear_video")
    return overview(table(spark, sf_dir, MANIFEST), {c: labels.nonempty_count(c) for c in columns})


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of files as ``labels.profile_files`` gives them, from the stored tables."""
    files = table(spark, sf_dir, "label_sequence_profile").groupBy(F.col("label_v2_csv").alias("path")).agg(F.max("columns").alias("c"), F.max("num_label_rows").alias("num_label_rows"))
    counts = table(spark, sf_dir, "label_column_profile").select(F.col("label_v2_csv").alias("path"), F.lower(F.trim("column_name")).alias("k"), "nonempty_count").distinct()
    counts = counts.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "nonempty_count"))).alias("m"))
    columns = F.split("c", r"\|")
    nonempty = F.transform(columns, lambda c: F.coalesce(F.try_element_at("m", F.lower(F.trim(c))), F.lit(0)))
    return files.join(counts, "path").select("path", F.lit(None).cast("string").alias("error"), "num_label_rows", columns.alias("columns"), nonempty.alias("nonempty"))


def _filled(role: str) -> str:
    return f"coalesce((select max(nonempty_count) from k where k.f = j.label_v2_csv and k.n = lower(trim(j.{role}))), 0) as {role[:-4]}_nonempty_rows"


@query(
    "with p as (select label_v2_csv as f, max(columns) as columns, max(num_label_rows) as num_label_rows, string_split(max(columns), '|') as cols from label_sequence_profile group by 1), "
    "k as (select distinct label_v2_csv as f, lower(trim(column_name)) as n, nonempty_count from label_column_profile), "
    f"j as (select s.sequence_id, s.preferred_camera_rule, s.driving_direction, {_TARGET} as target_object, s.label_objects_json, s.label_v2_csv, p.num_label_rows, len(p.cols)::int as num_columns, "
    + ", ".join(f"{_find_sql(n)} as {r}" for r, n in labels.CANDIDATES.items())
    + ", p.columns from sequence_sample s join p on p.f = s.label_v2_csv where p.f in (select f from k)) "
    "select *, (xmin_col <> '' and ymin_col <> '' and xmax_col <> '' and ymax_col <> '')::int as bbox_available, (polygon_x_col <> '' and polygon_y_col <> '')::int as polygon_available, "
    + ", ".join(map(_filled, ("object_col", "class_col", "distance_col")))
    + " from j"
)
def sequence_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.sequence_profile(table(spark, sf_dir, "sequence_sample"), _profiled(spark, sf_dir))


@query(
    "with f as (select distinct file_path from label_v2_csv where file_path is not null) select sequence_id, label_v2_csv, "
    f"case when {_strip('coalesce(label_v2_csv, ' + chr(39) * 2 + ')')} = '' then 'missing_label_v2_csv_path' else 'label_v2_csv_not_found' end as error "
    f"from {MANIFEST} m where label_v2_csv is null or label_v2_csv not in (select file_path from f)"
)
def label_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = table(spark, sf_dir, "label_v2_csv").filter("file_path is not null").select(F.col("file_path").alias("path"), F.lit(None).cast("string").alias("error")).distinct()
    return labels.label_errors(table(spark, sf_dir, MANIFEST).select("sequence_id", "label_v2_csv"), there)


# --- review -------------------------------------------------------------------------------------------------------


@query(
    f"with r as (select sequence_id, arg_max(rig_id, ingested_at) as rig_id, max(ingested_at) as at from {MANIFEST} where rig_id is not null group by 1) "
    "select s.sequence_id, coalesce(r.rig_id, '') as rig_id from sequence_sample s left join r using (sequence_id)"
)
def last_wins_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = table(spark, sf_dir, MANIFEST).filter("rig_id is not null")
    return review.lookup(table(spark, sf_dir, "sequence_sample").select("sequence_id"), right, "sequence_id", ["rig_id"], "ingested_at")


@query(
    "with s as (select sequence_id from sequence_sample order by sequence_id offset 10 limit 200) "
    "select sequence_id from s where not exists (select 1 from label_sequence_profile p where trim(p.sequence_id) = trim(coalesce(s.sequence_id, '')) and trim(p.sequence_id) <> '' and p.num_label_rows >= 10)"
)
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "label_sequence_profile").select("sequence_id", F.when(F.col("num_label_rows") >= 10, "ok").otherwise("").alias("ai_status"))
    return review.unreviewed(table(spark, sf_dir, "sequence_sample").select("sequence_id"), done, start=10, limit=200)


@query("select sequence_id, label_v2_csv from sequence_sample s where exists (select 1 from label_v2_csv l where l.file_path = s.label_v2_csv)")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "label_v2_csv").select(F.col("file_path").alias("label_v2_csv")).distinct()
    return table(spark, sf_dir, "sequence_sample").select("sequence_id", "label_v2_csv").join(files, "label_v2_csv", "left_semi")


_CHOSEN = f"case when lower({_strip('coalesce(preferred_camera_rule, ' + chr(39) * 2 + ')')}) = 'rear' then 'rear' else 'front' end"


_PLAN = (
    f"f as (select distinct unnest([front_video, rear_video, topview_video]) as path from {MANIFEST}), "
    f"s as (select sequence_id, {_CHOSEN} as camera, trim(coalesce(case when {_CHOSEN} = 'rear' then rear_video else front_video end, '')) as chosen, trim(coalesce(topview_video, '')) as top, "
    "coalesce(driving_direction, '') as d, coalesce(approach, '') as a, coalesce(primary_label_object, '') as o, coalesce(weather_tags, '') as w from sequence_sample), "
    "plan as (select sequence_id, camera as preferred_camera_rule, d as driving_direction, a as approach, o as primary_label_object, w as weather_tags, chosen as chosen_video, top as topview_video, "
    "(chosen in (select path from f where path is not null))::int as chosen_video_exists, (top in (select path from f where path is not null))::int as topview_video_exists, "
    "sequence_id || ' | cam=' || camera || ' | dir=' || d || ' | approach=' || a || ' | obj=' || o as label_text from s)"
)


def _contact_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, MANIFEST).select(F.explode(F.array("front_video", "rear_video", "topview_video")).alias("path")).filter("path is not null")
    return review.contact_plan(table(spark, sf_dir, "sequence_sample"), paths)


@query(f"with {_PLAN} select *, chosen_video_exists * topview_video_exists as pair_possible from plan")
def contact_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contact_plan(spark, sf_dir)


#: What a run is taken to have saved: every second sheet, and pairs of which both videos exist.
_SAVED = "v as (select distinct sequence_id, 1 as chosen_contact_saved, (length(sequence_id) % 2)::int as topview_contact_saved, (length(sequence_id) % 3 = 0)::int as pair_mid_saved from sequence_sample where sequence_id is not null)"


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("sequence_id")
    flags = {"chosen_contact_saved": F.lit(1), "topview_contact_saved": n % 2, "pair_mid_saved": (n % 3 == 0).cast("int")}
    return table(spark, sf_dir, "sequence_sample").filter("sequence_id is not null").select("sequence_id").distinct().withColumns(flags)


@query(
    f"with {_PLAN}, {_SAVED} select sequence_id, preferred_camera_rule, driving_direction, approach, primary_label_object, weather_tags, chosen_video_exists, topview_video_exists, "
    "coalesce(chosen_contact_saved, 0) as chosen_contact_saved, coalesce(topview_contact_saved, 0) as topview_contact_saved, coalesce(pair_mid_saved, 0) as pair_mid_saved, "
    "case when pair_mid_saved = 1 then concat_ws('/', 'out', sequence_id, 'pair_' || preferred_camera_rule || '_mid.jpg') else '' end as pair_mid_path from plan left join v using (sequence_id)"
)
def contact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.contact_summary(review.artifact_paths(_contact_plan(spark, sf_dir), "out"), _saved(spark, sf_dir))


_SHEET_OWN = "preferred_camera_rule preferred_camera_rule_reason driving_direction approach weather_tags primary_label_object scene_tags metadata_json label_objects_json target_object".split()
_SHEET = (
    f"sheet as (select coalesce(s.sequence_id, '') as sequence_id, {', '.join(f'coalesce({c}, {chr(39) * 2}) as {c}' for c in _SHEET_OWN)}, "
    + ", ".join(f"coalesce({c}::varchar, '') as {c}" for c in ("chosen_contact_saved", "topview_contact_saved", "pair_mid_saved"))
    + f", concat_ws('/', 'out', s.sequence_id, {_CHOSEN} || '_contact.jpg') as chosen_contact_path, concat_ws('/', 'out', s.sequence_id, 'topview_contact.jpg') as topview_contact_path, "
    f"concat_ws('/', 'out', s.sequence_id, 'pair_' || {_CHOSEN} || '_mid.jpg') as pair_mid_path, {', '.join(f'{chr(39) * 2} as {c}' for c in review.HUMAN_COLUMNS)} "
    "from sequence_sample s left join v on v.sequence_id = s.sequence_id)"
)


def _review_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_sheet(table(spark, sf_dir, "sequence_sample"), _saved(spark, sf_dir), "out")


@query(f"with {_SAVED}, {_SHEET} select * from sheet")
def review_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _review_sheet(spark, sf_dir)


@query(
    f"with {_SAVED}, {_SHEET} select s.*, coalesce('b/' || v.sequence_id, '') as review_board_path, coalesce(v.pair_mid_saved::varchar, '') as review_board_saved "
    "from sheet s left join v on v.sequence_id = s.sequence_id"
)
def review_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = _saved(spark, sf_dir).select("sequence_id", F.concat(F.lit("b/"), "sequence_id").alias("review_board_path"), F.col("pair_mid_saved").alias("review_board_saved"))
    return review.review_input(_review_sheet(spark, sf_dir), boards)


def _byte(k: str) -> str:
    return f"('0x' || substr(h, 2 * ({k}) + 1, 2))::int"


#: The stand-in reviewer: scores are bytes of a hash of the board's path.
_ANSWERS = (
    "b as (select *, sha256(concat_ws('/', 'out', sequence_id, 'ratio_review_board.jpg')) as h from sequence_sample), "
    f"i as (select b.*, list_transform(range(0, 5), lambda i: {{'r': ['0.15', '0.30', '0.45', '0.60', '0.75'][i + 1], 'o': {_byte('3 * i')} % 4, 's': {_byte('3 * i + 1')} % 4, 't': {_byte('3 * i + 2')} % 4, 'q': {_byte('i')} % 4}}) as items from b), "
    "t as (select *, list_transform(items, lambda x: 4 * x.o + 2 * x.t + x.s + 3 - x.q) as totals from i), "
    "w as (select *, items[list_position(totals, list_max(totals))] as x, '[' || array_to_string(list_transform(items, lambda x: '{\"ratio\": \"' || x.r || '\", \"object_visible_score_0_3\": ' || x.o || ', \"scene_clarity_score_0_3\": ' || x.s || "
    "', \"topview_useful_score_0_3\": ' || x.t || ', \"candidate_quality\": \"' || ['good', 'good_enough', 'borderline', 'bad'][x.q + 1] || '\", \"reason\": \"\"}'), ', ') || ']' as js from t)"
)


@query(
    f"with {_ANSWERS} select sequence_id, x.r as ai_best_ratio, '0.60' as ai_model_best_ratio_raw, x.o::varchar as ai_object_visible_score_0_3, x.s::varchar as ai_scene_clarity_score_0_3, x.t::varchar as ai_topview_useful_score_0_3, "
    "case when x.q < 2 then '1' else '0' end as ai_keep_for_next_stage, ['good', 'good_enough', 'borderline', 'bad'][x.q + 1] as ai_candidate_quality, 'low' as ai_confidence, js as ai_ratio_scores_json, 'rule' as ai_reason, "
    "'{\"ratio_scores\": ' || js || ', \"model_best_ratio\": \"0.60\", \"confidence\": \"low\", \"overall_reason\": \"rule\"}' as ai_raw_text, 'ok' as ai_status from w"
)
def auto_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.artifact_paths(table(spark, sf_dir, "sequence_sample"), "out").withColumn("review_board_saved", F.lit("1"))
    return review.review(rows).select("sequence_id", *review.AI_COLUMNS)


_ITEM = (
    "select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) as pos, "
    "case l_linenumber when 1 then '0.15' when 2 then '0.30' when 3 then '0.45' when 4 then '0.60' when 5 then '0.75' when 6 then '0.90' end as ratio, "
    "least(3, (l_quantity::bigint % 5))::int as obj, (l_partkey % 4)::int as top, (l_suppkey % 4)::int as scene, "
    "case l_returnflag when 'A' then 'good' when 'N' then 'good_enough' else 'borderline' end as quality from lineitem"
)


@query(
    f"with i as ({_ITEM}), t as (select *, 4 * obj + 2 * top + scene + case quality when 'good' then 3 when 'good_enough' then 2 else 1 end as total from i where ratio is not null), "
    "w as (select l_orderkey, first(ratio order by total desc, pos) as ratio, first(total order by total desc, pos)::int as total from t group by 1) "
    "select w.l_orderkey, w.ratio as best_ratio, first(t.quality order by t.pos) as quality from w join t using (l_orderkey, ratio) group by 1, 2"
)
def best_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    ratio = F.element_at(F.array(*[F.lit(str(r)) for r in R.RATIOS], F.lit("")), F.least("l_linenumber", F.lit(7)))
    quality = F.when(F.col("l_returnflag") == "A", "good").when(F.col("l_returnflag") == "N", "good_enough").otherwise("borderline")
    text = lambda c: c.cast("string")
    item = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax",
        F.struct(
            ratio.alias("ratio"), text(F.col("l_quantity").cast("bigint") % 5).alias("object_visible"), text(F.col("l_partkey") % 4).alias("topview"),
            text(F.col("l_suppkey") % 4).alias("scene"), quality.alias("quality"),
        ).alias("x"),
    )
    per_order = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(item)), lambda z: z["x"]).alias("items"))
    # exploding drops orders without a valid item; a filter would be pushed down and choose twice
    best = per_order.select("l_orderkey", F.explode(F.array_compact(F.array(R.best_item(F.col("items"))))).alias("b"))
    return best.select("l_orderkey", F.col("b.r").alias("best_ratio"), F.col("b.x.quality").alias("quality"))


@query(
    "with q as (select o_orderkey, case o_orderpriority when '1-URGENT' then ' Good' when '2-HIGH' then 'good_enough' when '3-MEDIUM' then 'borderline' else o_orderpriority end as raw from orders) "
    "select o_orderkey, case when lower(trim(raw)) in ('good', 'good_enough', 'borderline', 'bad') then lower(trim(raw)) else 'bad' end as quality, "
    "case when lower(trim(raw)) in ('good', 'good_enough') then '1' else '0' end as keep from q"
)
def quality_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    raw = F.when(p == "1-URGENT", " Good").when(p == "2-HIGH", "good_enough").when(p == "3-MEDIUM", "borderline").otherwise(p)
    return table(spark, sf_dir, "orders").select("o_orderkey", R.quality(raw).alias("quality"), R.keeps(raw).alias("keep"))


@query("select event_id, case when event_id % 4 = 3 then null else props end as block from events")
def answer_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    D.allow_repeated_keys(spark)
    p, k = F.col("props"), F.col("event_id") % 4
    text = F.when(k == 0, p).when(k == 1, F.concat(F.lit("Sure!\n```json\n"), p, F.lit("\n```\nDone"))).when(k == 2, F.concat(F.lit("The answer is "), p, F.lit(" as asked."))).otherwise(F.concat(F.lit("["), p))
    return table(spark, sf_dir, "events").select("event_id", F.when(k == 3, R.json_block(F.regexp_replace(text, r"[{}]", ""))).otherwise(R.json_block(text)).alias("block"))


@query(
    "select l_orderkey, l_linenumber, l_partkey, l_discount, case when l_discount * 10 between 0.14500000000000002 and 0.155 then '0.15' when l_discount * 10 between 0.29500000000000004 and 0.305 then '0.30' "
    "when l_discount * 10 between 0.445 and 0.45499999999999996 then '0.45' when l_discount * 10 between 0.5950000000000001 and 0.605 then '0.60' when l_discount * 10 between 0.7450000000000001 and 0.7549999999999999 then '0.75' "
    "when l_discount * 10 between 0.895 and 0.9049999999999999 then '0.90' end as ratio, least(3, l_linenumber)::int as score from lineitem"
)
def ratio_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", R.ratio_key(F.col("l_discount") * 10).alias("ratio"), R.score(F.col("l_linenumber").cast("string")).alias("score"))


@query(
    "select sequence_id, 'You judge candidate frames of a parking sequence. The board shows six rows, one per position in the video' || chr(10) || '(0.15, 0.30, 0.45, 0.60, 0.75, 0.90); left is the ' "
    "|| coalesce(nullif(preferred_camera_rule, ''), 'front') || ' camera, right the view from above.' || chr(10) || 'Sequence: ' || coalesce(sequence_id, '') || '. Direction: ' || coalesce(driving_direction, '') || '. Approach: ' || coalesce(approach, '') "
    "|| '. Weather: ' || coalesce(weather_tags, '') || '. Scene: ' || coalesce(scene_tags, '') || '.' || chr(10) || 'Object to find: ' || coalesce(target_object, '') || '. Objects in the metadata: ' || coalesce(label_objects_json, '') || '.' || chr(10) "
    "|| 'For every position give whole scores from 0 to 3 for object_visible_score_0_3, scene_clarity_score_0_3 and' || chr(10) || 'topview_useful_score_0_3, and a candidate_quality out of good, good_enough, borderline and bad. Answer with one JSON' || chr(10) "
    "|| 'object: {\"ratio_scores\": [{\"ratio\": \"0.15\", ...}, ...], \"model_best_ratio\": \"...\", \"confidence\": \"...\", \"overall_reason\": \"...\"}.' as prompt from sequence_sample"
)
def review_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sequence_sample")
    return rows.select("sequence_id", R.prompt(rows.columns).alias("prompt"))


@query(
    "with t as (select 'q' || user_id::varchar as sequence_id, case event_id % 2 when 0 then 'front' else 'topview' end as camera, round((event_id % 6)::double * 0.15::double + 0.15::double, 2) as ratio, event_id::int as frame, value as t from events) "
    "select c.sequence_id, c.ratio, c.frame as chosen_frame, c.t as chosen_time, p.frame as topview_frame, p.t as topview_time from t c join t p on c.sequence_id = p.sequence_id and c.ratio = p.ratio where c.camera <> 'topview' and p.camera = 'topview'"
)
def tile_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    tiles = table(spark, sf_dir, "events").select(
        F.concat(F.lit("q"), "user_id").alias("sequence_id"), F.when(e % 2 == 0, "front").otherwise("topview").alias("camera_name"), F.round(e % 6 * 0.15 + 0.15, 2).alias("ratio"),
        e.cast("int").alias("frame_idx"), F.col("value").alias("time_sec"), F.lit(1).alias("success"),
    )
    pairs = media.tile_pairs(tiles)
    return pairs.select("sequence_id", "ratio", *[F.col(f"{side}.{c}").alias(f"{side}_{n}") for side in ("chosen", "topview") for c, n in (("frame_idx", "frame"), ("time_sec", "time"))])


# --- files --------------------------------------------------------------------------------------------------------

_TABLES = (
    "customer documents embeddings eval_items events label_column_profile label_sequence_profile label_v2_csv lineitem metadata_json nation orders part region rig_speed_units sample_targets "
    "sequence_manifest_enriched sequence_sample supplier"
).split()


@query(f"select unnest([{', '.join(f'{chr(39)}{t}.parquet{chr(39)}' for t in _TABLES)}]) as path")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the tables' folder."""
    return list_files(spark, sf_dir).select("path")


@query(f"select {', '.join(f'coalesce({c}::varchar, {chr(39) * 2}) as {c}' for c in ('sequence_id', 'sequence_dir', 'weather_tags', 'scene_tags', 'label_objects_json', 'json_loaded'))}, case when is_poc_ready then 'True' when not is_poc_ready then 'False' else '' end as is_poc_ready from sequence_sample")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as one CSV file, in the shared folder if the session names one, and read again."""
    columns = ["sequence_id", "sequence_dir", "weather_tags", "scene_tags", "label_objects_json", "json_loaded", "is_poc_ready"]
    at = f"{shared_folder(spark)}/kerbline-{uuid.uuid4().hex}.csv"
    sinks.write_csv(table(spark, sf_dir, "sequence_sample").select(*columns), at)
    return tables.read_csv(spark, at, columns)


@query(
    "select o_orderkey::varchar as o_orderkey, o_orderstatus, '' as c_custkey, '' as c_name, o_custkey::varchar as o_custkey from orders "
    "union all select '', '', c_custkey::varchar, c_name, '' from customer"
)
def union_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    return sinks.union_fields([orders, table(spark, sf_dir, "customer").select("c_name", "c_custkey")], ["o_orderkey", "none", "c_custkey"])


# --- geometry -----------------------------------------------------------------------------------------------------


@query("select event_id, case when value > 0 then round_even((floor(value * 100) - 1) * 0.15, 0)::bigint else -1 end as frame_idx, case when floor(value * 100) > 0 then floor(value * 100) / 25.0 else 0.0 end::double as seconds from events where floor(value * 100) > 0")
def frame_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = F.floor(F.col("value") * 100)
    return table(spark, sf_dir, "events").filter(frames > 0).select("event_id", G.frame_index(frames, 0.15).alias("frame_idx"), G.duration(frames, F.lit(25.0)).alias("seconds"))


@query(
    "with p as (select p_partkey, (p_partkey % 6) as i, (p_size * 40) as w, (p_size * 23 + 7) as h from part), s as (select *, least(320.0::double / w, 214.0::double / h) as k from p), "
    "n as (select *, greatest(1, round_even(w * k, 0))::bigint as new_width, greatest(1, round_even(h * k, 0))::bigint as new_height from s) "
    "select p_partkey, ((i % 3) * 320)::bigint as x0, (56 + (i // 3) * 214)::bigint as y0, new_width, new_height, floor((320 - new_width) / 2)::bigint as x_offset, floor((214 - new_height) / 2)::bigint as y_offset from n"
)
def tile_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 6).alias("i"), (F.col("p_size") * 40).alias("w"), (F.col("p_size") * 23 + 7).alias("h"))
    places = {k: c.cast("bigint").alias(k) for k, c in G.tile_rectangle("i").items()}
    sizes = {k: c.cast("bigint").alias(k) for k, c in G.fitted_size("w", "h", G.TILE_WIDTH, G.TILE_HEIGHT).items()}
    return parts.select("p_partkey", *places.values(), *sizes.values())


@query("with o as (select count(*) as orders, count(*) filter (o_orderstatus = 'F') as filled, count(distinct o_custkey) as customers from orders) unpivot o on orders, filled, customers into name metric value value")
def run_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview(table(spark, sf_dir, "orders"), {"orders": F.count(F.lit(1)), "filled": F.count_if(F.col("o_orderstatus") == "F"), "customers": F.countDistinct("o_custkey")})


@query("select 'status' as \"group\", o_orderstatus as value, count(*) as \"count\" from orders group by 2 union all select 'priority', o_orderpriority, count(*) from orders group by 2")
def profile_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counter_profile(table(spark, sf_dir, "orders"), [Group("status", "o_orderstatus"), Group("priority", "o_orderpriority")])


@query(f"select sequence_id, array_to_string(list_distinct_ordered, '|') as objects from (select sequence_id, list_filter(l, lambda x, i: list_position(l, x) = i) as list_distinct_ordered from (select sequence_id, list_filter(list_transform(string_split(coalesce(label_objects_json, ''), '|'), lambda x: {_strip('x')}), lambda x: x <> '') as l from {MANIFEST}))")
def pipe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, MANIFEST).select("sequence_id", D.join_distinct(F.split(F.coalesce("label_objects_json", F.lit("")), r"\|")).alias("objects"))


__all__ = ["oracle_sql", "queries", "query", "strip", "table"]
