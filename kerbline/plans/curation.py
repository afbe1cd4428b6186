"""Queries of the general training-data problems (p1 to p3 and p5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.operators import drift, inlining, labels, rejects, units


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rejects.rejected_lines(table(spark, sf_dir, "label_v2_csv"))
    return found.filter(F.col("reason") != "missing_header").select(F.col("id").alias("record_id"), "reason")


def p1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All loadable lines as typed label rows; polygons as numbers and sums of their values, other fields as sorted text."""
    typed, _ = rejects.split_lines(table(spark, sf_dir, "label_v2_csv"))
    others = F.array_join(F.array_sort(F.transform(F.map_entries("other_fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    polygons = [c for axis in "xy" for c in (
        F.coalesce(F.size(f"polygon_{axis}"), F.lit(0)).cast("bigint").alias(f"polygon_{axis}_points"),
        F.round(F.aggregate(f"polygon_{axis}", F.lit(0.0), lambda a, x: a + x), 2).alias(f"polygon_{axis}_sum"),
    )]
    return typed.select(
        F.col("id").alias("record_id"), "line_no", F.col("frame_idx").cast("string"), "class_value", "object_value", "distance_mm", "xmin", "ymin", "xmax", "ymax", *polygons, others.alias("other_fields")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inlining.object_nodes(table(spark, sf_dir, "metadata_json"))


def p2_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the flat tables with their attributes as JSON text."""
    rows = inlining.shred(table(spark, sf_dir, "metadata_json"))
    entries = F.array_sort(F.map_entries("attributes"))
    return rows.select("record_id", "element", "parent_path", "node_path", F.to_json(F.map_from_entries(entries)).alias("attributes"))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the related tables: its table, its key and the key of its parent row."""
    rows = inlining.shred(table(spark, sf_dir, "metadata_json"))
    return rows.select("record_id", "element", "kind", "parent_path", "node_path")


def p2_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of each of the related tables, inlined ones included, with the rows that have them."""
    return inlining.element_columns(inlining.shred(table(spark, sf_dir, "metadata_json")))


def p2_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of tags: its keys, its own columns and those of the objects inlined into it."""
    rows = inlining.element_table(inlining.shred(table(spark, sf_dir, "metadata_json")), "tags", TAG_COLUMNS)
    named = {c: c.replace(".", "_").replace("tagCategory", "category").replace("tagSubCategory", "subcategory") for c in TAG_COLUMNS}
    return rows.select("record_id", "parent_path", "node_path", *[F.col(f"`{c}`").alias(n) for c, n in named.items()])


TAG_COLUMNS = ("id", "name", "tagCategory.id", "tagCategory.name", "tagSubCategory.id", "tagSubCategory.name")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_changes(table(spark, sf_dir, "label_sequence_profile"), table(spark, sf_dir, "label_column_profile"), told_only=True)


def p3_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's columns under the name with which the field began in its campaign."""
    return drift.unified_fields(table(spark, sf_dir, "label_sequence_profile"), table(spark, sf_dir, "label_column_profile"), told_only=True)


def p3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All loadable label rows as one table, values under unified names (JSON text)."""
    rows = drift.unified_rows(labels.loaded_lines(table(spark, sf_dir, "label_v2_csv")), p3_fields(spark, sf_dir))
    return rows.select(F.col("id").alias("record_id"), "line_no", F.to_json("values").alias("label_values"))


def p5_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every speed in km/h, with the unit it came in and where that unit was stated."""
    rows = units.convert_speeds(table(spark, sf_dir, "sequence_manifest_enriched"), table(spark, sf_dir, "rig_speed_units"))
    return rows.select("sequence_id", "field_name", "value", "unit", "unit_from", F.round(F.col("converted") * 100).cast("bigint").alias("kph_x100"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units.convert_speeds(table(spark, sf_dir, "sequence_manifest_enriched"), table(spark, sf_dir, "rig_speed_units"))
    kph = F.round(F.col("converted") * 100).cast("bigint")
    return rows.filter((F.col("unit") != units.TARGET) & F.col("converted").isNotNull()).select("sequence_id", "field_name", kph.alias("kph_x100")).distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_rows, p2_found, p2_rows, p2_links, p2_columns, p2_tags, p3_found, p3_fields, p3_rows, p5_converted, p5_found)}


_TEXT = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

def _fields_sql(sep: str) -> tuple[str, str]:
    """(pattern of a well quoted record, expression of its field texts) for one separator."""
    field = f'(?:"(?:[^"]|"")*"|[^"{sep}]*)'
    whole = f"regexp_full_match(text, '{field}(?:{sep}{field})*', 's')"
    raw = f"regexp_extract_all('{sep}' || text, '{sep}({field})', 1, 's')"
    return whole, f"list_transform({raw}, lambda x: case when x like '\"%' then replace(x[2:-2], '\"\"', '\"') else x end)"


# fixed values, written out here for themselves: names of the distance, the class and the object
_DISTANCES = "'distance_mm', 'distance', 'important distance', 'important distance [mm]', 'gap [mm]', 'clearance'"
_CLASSES, _OBJECTS = "'class', 'label class', 'class_id', 'category code', 'kind'", "'which object', 'label_object', 'object'"


def _lines_sql() -> str:
    """CTE f: (record_id, line_no, sep, names, ok, fields) of every data line; b: record_id of those with a bad value."""
    by = {s: _fields_sql(s) for s in (",", ";", "\t")}
    each = lambda k: " ".join(f"when '{s}' then {by[s][k]}" for s in by)
    bare = "regexp_replace(t, '\"[^\"]*\"', '', 'g')"
    n = {s: f"(length({bare}) - length(replace({bare}, '{s}', '')))" for s in by}
    names = "list_transform(string_split(replace(t, '\"', ''), sep), lambda x: lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g')))"
    missing = "v in ('', 'NA', 'None')"

    def good(number: str) -> str:
        whole = lambda form: f"regexp_full_match(v, '{form.format(n=number)}')"
        return (
            f"case when n = 'frame_idx' then regexp_full_match(v, '[0-9]+') when regexp_full_match(n, '(bbox_)?[xy]_?(min|max)') then {missing} or {whole('{n}')} "
            f"when regexp_full_match(n, 'poly(gon)?_?[xy]') then {missing} or {whole('{n}(?: {n})*')} when n in ({_DISTANCES}) then {missing} or {whole('{n} *(?:mm|cm|m)?')} else true end"
        )

    return (
        "with raw as (select record_id, file_path, line_no, coalesce(label_v2_csv, '') as text from label_v2_csv), "
        "h as (select file_path, regexp_replace(arg_min(text, record_id), '^' || chr(65279), '') as t from raw where line_no = 0 group by 1), "
        f"s as (select file_path, t, case when {n[',']} >= {n[';']} and {n[',']} >= {n[chr(9)]} then ',' when {n[';']} >= {n[chr(9)]} then ';' else chr(9) end as sep from h), "
        f"hs as (select file_path, sep, {names} as names from s), "
        f"q as (select record_id, file_path, line_no, sep, names, text, case sep {each(0)} end as ok from raw join hs using (file_path) where line_no is distinct from 0), "
        f"f as (select record_id, file_path, line_no, sep, names, ok, case when ok then case sep {each(1)} end end as fields from q), "
        "v as (select record_id, sep, unnest(names) as n, unnest(fields) as v from f where ok and len(fields) = len(names)), "
        f"b as (select distinct record_id from v where not case when sep = ';' then {good('[0-9]+(?:,[0-9]+)?')} else {good('[0-9]+(?:[.][0-9]+)?')} end) "
    )


def loaded_sql() -> str:
    """CTE d: (file_path, line_no, names, fields) of the loadable lines, a redelivered one once."""
    return _lines_sql() + (
        ", d as (select * from (select *, row_number() over (partition by file_path, line_no order by record_id) as r from f "
        "where ok and len(fields) = len(names) and record_id not in (select record_id from b)) where r = 1 or line_no is null) "
    )


def _rejects_sql() -> str:
    return (
        _lines_sql() + "select record_id, case when not ok then 'broken_quoting' when len(fields) <> len(names) then 'column_count' else 'invalid_value' end as reason "
        "from f where not ok or len(fields) <> len(names) or record_id in (select record_id from b)"
    )


def _typed_sql() -> str:
    def field(test: str) -> str:
        at = f"fields[list_position(list_transform(names, lambda n: {test}), true)]"
        return f"case when {at} not in ('', 'NA', 'None') then {at} end"

    point = lambda x: f"case when sep = ';' then replace({x}, ',', '.') else {x} end"
    corner = lambda c: f"try_cast({point(field(f'regexp_full_match(n, {chr(39)}(bbox_)?{c[0]}_?{c[1:]}{chr(39)})'))} as double) as {c}"
    polygon = lambda a: point(field(f"regexp_full_match(n, 'poly(gon)?_?{a}')"))
    numbers = lambda a: f"list_transform(string_split({a}_text, ' '), lambda x: try_cast(x as double))"
    known = f"n in ('frame_idx', {_CLASSES}, {_OBJECTS}, {_DISTANCES}) or regexp_full_match(n, '(bbox_)?[xy]_?(min|max)') or regexp_full_match(n, 'poly(gon)?_?[xy]')"
    others = f"list_filter(list_transform(range(1, len(names) + 1), lambda i: case when not ({known.replace('n in', 'names[i] in').replace('(n,', '(names[i],')}) and fields[i] not in ('', 'NA', 'None') then names[i] || '=' || fields[i] end), lambda x: x is not null)"
    return (
        _lines_sql() + f", k as (select record_id, line_no, {field(chr(110) + ' = ' + chr(39) + 'frame_idx' + chr(39))} as frame_idx, {field(f'n in ({_CLASSES})')} as class_value, {field(f'n in ({_OBJECTS})')} as object_value, "
        f"{point(field(f'n in ({_DISTANCES})'))} as d, {', '.join(map(corner, ('xmin', 'ymin', 'xmax', 'ymax')))}, {polygon('x')} as x_text, {polygon('y')} as y_text, array_to_string(list_sort({others}), '|') as other_fields "
        "from f where ok and len(fields) = len(names) and record_id not in (select record_id from b)) "
        "select record_id, line_no, (frame_idx::hugeint)::varchar as frame_idx, class_value, object_value, try_cast(regexp_extract(d, '^[0-9.]+') as double) * "
        "case when d like '%cm' then 10.0 when d like '%mm' then 1.0 when d like '%m' then 1000.0 else 1.0 end::double as distance_mm, xmin, ymin, xmax, ymax, "
        + ", ".join(f"coalesce(len({numbers(a)}), 0)::bigint as polygon_{a}_points, round(list_sum({numbers(a)}), 2) as polygon_{a}_sum" for a in "xy")
        + ", other_fields from k"
    )


_NODES = (
    "with p as (select record_id, t, json_valid(t) and json_type(case when json_valid(t) then t end) = 'OBJECT' as ok from (select record_id, "
    f"{_TEXT.format(x='regexp_replace(' + _TEXT.format(x='payload') + ', chr(65279), chr(32))')} as t from metadata_json) where t is not null), "
    "d as (select record_id, t from p where ok), "
    "r as (select record_id, k, json_extract(t, '$.' || k) as v from d, (select unnest(['tags', 'customFieldValues']) as k)), "
    "w as (select record_id, k, case json_type(v) when 'OBJECT' then json_array(v) when 'ARRAY' then v end as v from r where json_type(v) in ('OBJECT', 'ARRAY')), "
    "n as (select record_id, k || substr(j.fullkey, 2) as node_path from w, json_tree(w.v) j where j.type = 'OBJECT' and j.fullkey like '%]') "
    "select n.record_id, coalesce((select arg_max(m.node_path, length(m.node_path)) from n m where m.record_id = n.record_id and "
    "(starts_with(n.node_path, m.node_path || '.') or starts_with(n.node_path, m.node_path || '['))), '') as parent_path, n.node_path from n"
)


_ROOTS = _NODES[: _NODES.index("n as (select record_id")]
#: The graph of elements and the tables it asks for. No element of the test tables lies on a cycle that its parents do not tell.
_TABLES = (
    _ROOTS + "a as (select record_id, k, j.fullkey as f, j.type as t, j.fullkey like '%]' as rep, nullif(regexp_extract(regexp_replace(j.fullkey, '(\\[[0-9]+\\])+$', ''), '[^.]*$'), '$') as own, "
    "regexp_replace(j.fullkey, '(\\.[^.\\[\\]]+)?(\\[[0-9]+\\])*$', '') as up from w, json_tree(w.v) j where j.fullkey <> '$'), "
    "b as (select record_id, k, f, t, rep, up, coalesce(own, k) as name from a), o as (select * from b where t = 'OBJECT'), "
    "e as (select distinct o.name, case when o.up = '$' then '' else p.name end as parent, o.rep from o left join o p on p.record_id = o.record_id and p.k = o.k and p.f = o.up), "
    "own as (select name from e group by name having bool_or(rep) or count(distinct parent) > 1), "
    "m as (select * from o where rep or name in (select name from own)), "
    "x as (select record_id, k, f, name, case when t = 'OBJECT' then 'object' else 'value' end as kind from b where t <> 'ARRAY' and (rep or (t = 'OBJECT' and name in (select name from own)))), "
    "l as (select x.record_id, x.k, x.f, x.name, x.kind, arg_max(m.f, length(m.f)) as pf from x left join m on m.record_id = x.record_id and m.k = x.k "
    "and (starts_with(x.f, m.f || '.') or starts_with(x.f, m.f || '[')) group by all) "
)
_LINKS = _TABLES + "select record_id, name as element, kind, coalesce(k || substr(pf, 2), '') as parent_path, k || substr(f, 2) as node_path from l"
_COLUMNS = (
    _TABLES + ", s as (select record_id, k, f from b where t not in ('OBJECT', 'ARRAY') and not rep), "
    "h as (select s.record_id, s.k, s.f, arg_max(struct_pack(f := m.f, name := m.name), length(m.f)) as m from s join m on m.record_id = s.record_id and m.k = s.k and starts_with(s.f, m.f || '.') group by all), "
    "c as (select m.name as element, substr(f, length(m.f) + 2) as \"column\" from h union all select name, '' from l where kind = 'value') select element, \"column\", count(*) as n from c group by all"
)
#: Texts of scalars as they are written, but for a number's form (``1e3``), which the test tables do not vary.
_RECORD_ROWS = (
    _TABLES.replace("j.type as t,", "j.type as t, j.atom as x,").replace("b as (select record_id, k, f, t,", "b as (select record_id, k, f, t, x,")
    + ", s as (select record_id, k, f, case when t = 'NULL' then null else x->>'$' end as v, rep from b where t not in ('OBJECT', 'ARRAY')), "
    "h as (select s.record_id, s.k, s.f, s.v, arg_max(m.f, length(m.f)) as mf from s join m on not s.rep and m.record_id = s.record_id and m.k = s.k and starts_with(s.f, m.f || '.') group by all), "
    "c as (select record_id, k, mf as f, substr(f, length(mf) + 2) as name, v from h union all select record_id, k, f, '', v from s where rep), "
    "g as (select record_id, k, f, '{' || string_agg(to_json(name)::varchar || ':' || coalesce(to_json(v)::varchar, 'null'), ',' order by name) || '}' as attributes from c group by all) "
    "select l.record_id, l.name as element, coalesce(l.k || substr(l.pf, 2), '') as parent_path, l.k || substr(l.f, 2) as node_path, coalesce(g.attributes, '{}') as attributes from l left join g using (record_id, k, f)"
)
_TAGS = (
    _ROOTS + "g as (select record_id, j.fullkey as f, j.value as v from w, json_tree(w.v) j where k = 'tags' and j.type <> 'ARRAY' and regexp_full_match(j.fullkey, '\\$(\\[[0-9]+\\])+')) "
    "select record_id, '' as parent_path, 'tags' || substr(f, 2) as node_path, v->>'$.id' as id, v->>'$.name' as name, v->>'$.tagCategory.id' as category_id, v->>'$.tagCategory.name' as category_name, "
    "v->>'$.tagSubCategory.id' as subcategory_id, v->>'$.tagSubCategory.name' as subcategory_name from g"
)


_ROLE_COLUMNS = "class_col object_col distance_col xmin_col ymin_col xmax_col ymax_col polygon_x_col polygon_y_col".split()


def _drift_sql() -> str:
    """CTE r: renames (c, k, a, b); state: of each column of each file the type of its last values, the name it then had and its first
    name; f: files, numbered in each campaign; gone and new: names that vanished and appeared."""
    low = lambda x: f"lower({_TEXT.format(x=x)})"
    return (
        f"with recursive p as (select campaign_id as c, sequence_id as s, label_v2_csv as l, arg_max(struct_pack(at := recorded_at, columns := coalesce(columns, ''), {', '.join(f'{r} := {r}' for r in _ROLE_COLUMNS)}), profiled_at) as x "
        "from label_sequence_profile where campaign_id is not null group by all), "
        "f as (select c, s, l, x, row_number() over (partition by c order by x.at nulls first, s, l) as k from p), "
        f"n0 as (select c, k, s, l, {low('unnest(string_split(x.columns, chr(124)))')} as name, generate_subscripts(string_split(x.columns, chr(124)), 1) as place from f where x.columns <> ''), "
        "n1 as (select c, k, s, l, name, min(place) as place from n0 group by all), "
        f"t as (select sequence_id as s, label_v2_csv as l, {low('column_name')} as name, any_value(case when regexp_full_match(sample_values, '[0-9]+(\\|[0-9]+)*') then 'integer' "
        "when regexp_full_match(sample_values, '[0-9]+([.,][0-9]+)?(\\|[0-9]+([.,][0-9]+)?)*') then 'decimal' else 'text' end) as kind "
        f"from label_column_profile where {_TEXT.format(x='sample_values')} <> '' group by all), "
        "gone as (select a.c, a.k + 1 as k, a.name, a.place from n1 a join f on f.c = a.c and f.k = a.k + 1 where not exists (select 1 from n1 b where b.c = a.c and b.k = a.k + 1 and b.name = a.name)), "
        "new as (select b.c, b.k, b.name, b.place from n1 b where b.k > 1 and not exists (select 1 from n1 a where a.c = b.c and a.k = b.k - 1 and a.name = b.name)), "
        f"ro as ({' union all '.join(f'select c, k, {chr(39)}{r}{chr(39)} as role, {low(f'coalesce(x.{r}, {chr(39) * 2})')} as name from f' for r in _ROLE_COLUMNS)}), "
        "pr as (select b.c, b.k, a.name as x, b.name as y from ro a join ro b on a.c = b.c and a.k + 1 = b.k and a.role = b.role), "
        "by_role as (select distinct g.c, g.k, g.name as a, n.name as b from gone g join new n on n.c = g.c and n.k = g.k join pr on pr.c = g.c and pr.k = g.k and pr.x = g.name and pr.y = n.name), "
        "by_place as (select distinct g.c, g.k, g.name as a, n.name as b from gone g join new n on n.c = g.c and n.k = g.k and n.place = g.place join pr on pr.c = g.c and pr.k = g.k "
        "where (pr.x = '' or pr.y = '') and pr.x in ('', g.name) and pr.y in ('', n.name) "
        "and not (pr.x <> g.name and g.name in (select o.x from pr o where o.c = g.c and o.k = g.k)) and not (pr.y <> n.name and n.name in (select o.y from pr o where o.c = g.c and o.k = g.k))), "
        "r as (select * from by_role union all select * from by_place q where not exists (select 1 from by_role e where e.c = q.c and e.k = q.k and (e.a = q.a or e.b = q.b))), "
        "node as (select n1.*, t.kind, coalesce(r.a, case when exists (select 1 from n1 o where o.c = n1.c and o.k = n1.k - 1 and o.name = n1.name) then n1.name end) as before "
        "from n1 left join r on r.c = n1.c and r.k = n1.k and r.b = n1.name left join t on t.s = n1.s and t.l = n1.l and t.name = n1.name), "
        "state as (select c, k, s, l, name, kind, case when kind is not null then name end as named, name as first, null::varchar as was, null::varchar as old from node where before is null "
        "union all select n.c, n.k, n.s, n.l, n.name, coalesce(n.kind, o.kind), case when n.kind is not null then n.name else o.named end, o.first, case when n.kind <> o.kind then o.kind end, o.named "
        "from state o join node n on n.c = o.c and n.k = o.k + 1 and n.before = o.name) "
    )


def _changes_sql() -> str:
    return _drift_sql() + (
        "select distinct f.s as sequence_id, change_kind, old_name, new_name from (select c, k, 'renamed' as change_kind, a as old_name, b as new_name from r "
        "union all select c, k, 'removed', name, '' from gone g where not exists (select 1 from r where r.c = g.c and r.k = g.k and r.a = g.name) "
        "union all select c, k, 'added', '', name from new g where not exists (select 1 from r where r.c = g.c and r.k = g.k and r.b = g.name) "
        "union all select c, k, 'type_changed', old, name from state where was is not null) join f using (c, k)"
    )


def _fields_of_files_sql() -> str:
    return _drift_sql() + "select c as campaign_id, s as sequence_id, l as label_v2_csv, name as column_name, first as field_name from state"


def _unified_rows_sql() -> str:
    return (
        f"with u as (select label_v2_csv as file, column_name as n, min(field_name) as u from ({_fields_of_files_sql()}) group by 1, 2), "
        "m as (select file, map(list(n), list(u)) as m from u group by 1), "
        f"d as ({loaded_sql()} select record_id, file_path as file, line_no, names, fields from d), "
        "k as (select record_id, line_no, fields, list_transform(names, lambda n: coalesce(map_extract(m, n)[1], n)) as keys from d left join m using (file)) "
        "select record_id, line_no, '{' || array_to_string(list_transform(list_filter(range(1, len(keys) + 1), lambda i: list_position(keys, keys[i]) = i), lambda i: to_json(keys[i])::varchar || ':' || to_json(fields[i])::varchar), ',') || '}' as label_values from k"
    )


# fixed values, written out here for themselves: spellings of units and what one of each is in km/h
_UNITS = {
    "km/h": (r"km\s?/\s?h|kmh|kph|km/hr|kilomet(?:re|er)s? (?:per|an) hour|kilomet(?:re|er)s?/h|kilometern? (?:pro|je) stunde|stundenkilometern?", "1"),
    "mi/h": (r"mph|mi\s?/\s?h|mi/hr|miles? (?:per|an) hour|miles/h|meilen? (?:pro|je) stunde|meilen/h", "1.609344"),
    "cm/s": (r"cm\s?/\s?s|cm/sec|centimet(?:re|er)s? per second|centimet(?:re|er)s?/s|zentimetern? (?:pro|je) sekunde", "0.036"),
    "mm/s": (r"mm\s?/\s?s|mm/sec|millimet(?:re|er)s? per second|millimet(?:re|er)s?/s|millimetern? (?:pro|je) sekunde", "0.0036"),
    "ft/s": (r"ft\s?/\s?s|ft/sec|fps|feet per second|foot per second|feet/s|fuß (?:pro|je) sekunde", "1.09728"),
    "m/s": (r"m\s?/\s?s|m/sec|mps|met(?:re|er)s? per second|met(?:re|er)s?/s|metern? (?:pro|je) sekunde", "3.6"),
    "kn": (r"knots?|kn|kts?|knoten", "1.852"),
}
_LOGGED = "speeds?|tempo|geschwindigkeit[a-z]*|logger|logged|channel|kanal|encoder|recorder|receiver|empfänger|gnss|gps|dash|export[a-z]*|aufzeichnung"


def _speeds_sql(every: bool = False) -> str:
    """Readings in another unit than km/h, or ``every`` reading with its unit and where that was stated."""
    any_unit = "|".join(f"(?:{p})" for p, _ in _UNITS.values())
    edge = lambda p: rf"(?:^|[^\p{{L}}/])(?:{p})(?:$|[^\p{{L}}/])"
    pad = lambda x: f"regexp_replace({x}, '([0-9])([a-z])', '\\1 \\2', 'g')"
    first = lambda x: (
        "(select arg_min(u, place) from (values "
        + ", ".join(f"('{u}', strpos(' ' || {x}, nullif(regexp_extract(' ' || {x}, '{edge(p)}'), '')))" for u, (p, _) in _UNITS.items())
        + ") c(u, place) where place > 0)"
    )
    tenth = r"0[.,]1\s?(?:km\s?/\s?h|kmh|kph)"
    own = f"case when regexp_matches(lower(value), '[0-9]\\s*(?:x|\\(|\\sx)\\s*\\(?\\s*{tenth}') then '0.1 km/h' else {first(pad('lower(value)'))} end"
    setting = lambda c: f"case when regexp_full_match(lower(trim({c})), '{tenth}') then '0.1 km/h' else {first(f'lower(trim({c}))')} end"
    kept = (
        f"regexp_replace(regexp_replace(lower(logger_note), '[0-9]+(?:[.,][0-9]+)?\\s*(?:{any_unit})', ' ', 'g'), "
        f"'(?:statt|anstatt|instead of|rather than|not|nicht)\\s+(?:in\\s+|auf\\s+)?(?:{any_unit})', ' ', 'g')"
    )
    note = f"case when regexp_matches(lower(logger_note), '{edge(_LOGGED)}') then {first(kept)} end"
    scale = " ".join(f"when '{u}' then {x}" for u, (_, x) in _UNITS.items()) + " when '0.1 km/h' then 0.1"
    return (
        f"with g as (select rig_id, valid_from, valid_to, {setting('limit_speed_unit')} as lu, {setting('avg_speed_unit')} as au from rig_speed_units), "
        f"m as (select distinct sequence_id, rig_id, recorded_at, logger_note, max_speed_kph, min_speed_kph, avg_speed from sequence_manifest_enriched), "
        f"n as (select logger_note, {note} as note_unit from (select distinct logger_note from m where logger_note is not null)), "
        "e as (select sequence_id, rig_id, recorded_at, logger_note, unnest(['max_speed_kph', 'min_speed_kph', 'avg_speed']) as field_name, unnest([max_speed_kph, min_speed_kph, avg_speed]) as value from m), "
        "x as (select e.*, n.note_unit, case when field_name = 'avg_speed' then g.au else g.lu end as set_unit from e left join n using (logger_note) "
        "left join g on g.rig_id = e.rig_id and g.valid_from <= e.recorded_at and (g.valid_to is null or e.recorded_at < g.valid_to)), "
        f"o as (select *, {own} as own_unit, replace(regexp_extract(value, '-?[0-9]+(?:[.,][0-9]+)?'), ',', '.') as number from x where regexp_matches(coalesce(value, ''), '[0-9]')), "
        "y as (select *, coalesce(own_unit, note_unit, set_unit, 'km/h') as unit, case when own_unit is not null then 'value' when note_unit is not null then 'note' when set_unit is not null then 'setting' else 'default' end as unit_from from o) "
        f"select distinct sequence_id, field_name, {'value, unit, unit_from, ' if every else ''}round(number::decimal(18, 6) * (case unit {scale} end)::decimal(14, 8) * 100)::bigint as kph_x100 from y"
        + ("" if every else " where unit <> 'km/h'")
    )


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _rejects_sql(), "p1_rows": _typed_sql(), "p2_found": _NODES, "p2_rows": _RECORD_ROWS, "p2_links": _LINKS, "p2_columns": _COLUMNS, "p2_tags": _TAGS, "p3_found": _changes_sql(), "p3_fields": _fields_of_files_sql(), "p3_rows": _unified_rows_sql(), "p5_found": _speeds_sql(), "p5_converted": _speeds_sql(every=True)}
