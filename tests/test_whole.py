"""Queries over label lines and documents compared with brute force on small tables of awkward cases."""

import json
from collections import Counter

import pytest

import __spark_entry__ as entry
from kerbline.operators import labels, metadata

HEADER = "frame_idx,Class,Which object"
LINES = [("f", 0, HEADER), ("f", 1, "1,a,Pole"), ("f", 2, "2,NA,"), ("f", 2, "2,NA,"), ("f", 3, "x,b,Wall"), ("g", 0, HEADER), ("g", 1, "1,a,Wall"), ("g", 2, "2,b,Pole")]
#: The long run: many lines over several blocks, in no stored profile.
LINES += [("long", 0, HEADER)] + [("long", i, f"{i},{'abc'[i % 3]},{'' if i % 7 else 'Pole'}") for i in range(1, 9001)]


@pytest.fixture(scope="module")
def label_tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("labels"))
    rows = [(i, *x) for i, x in enumerate(LINES)]
    spark.createDataFrame(rows, "record_id long, file_path string, line_no int, label_v2_csv string").write.parquet(f"{at}/label_v2_csv.parquet")
    stored = [(f, c, 1, "1") for f in "fg" for c in ("frame_idx", "class", "which object")]
    spark.createDataFrame(stored, "label_v2_csv string, column_name string, nonempty_count long, sample_values string").write.parquet(f"{at}/label_column_profile.parquet")
    spark.createDataFrame([("f", 2), ("g", 2)], "label_v2_csv string, num_label_rows long").write.parquet(f"{at}/label_sequence_profile.parquet")
    return at


def loadable():
    """Fields of the loadable rows by file and line number."""
    files = {}
    for file, line_no, text in LINES:
        fields = text.split(",")
        if line_no and fields[0].isdigit():
            files.setdefault(file, {})[line_no] = fields
    return files


def test_columns_of_all_files(spark, label_tables):
    want = set()
    for file, rows in loadable().items():
        for i, name in enumerate(HEADER.lower().split(",")):
            values = [r[i] for _, r in sorted(rows.items()) if r[i] not in ("", "NA", "None")]
            want.add((file, name, len(values), "|".join(values[:5])))
    got = [tuple(r) for r in entry.queries()["label_columns"](spark, label_tables).collect()]
    assert len(got) == len(want) == 9 and set(got) == want


def test_rows_of_all_files(spark, label_tables):
    want = Counter(len(rows) for rows in loadable().values())
    assert {r.num_label_rows: r.files for r in entry.queries()["rows_per_file"](spark, label_tables).collect()} == want == {2: 2, 9000: 1}


VALUES = ["1", 2.5, True, None, "", "plain [text]", "{odd", "[1,2]", False, [1, "a, b: \"c\"", {"d":2}], [1, {"b": "x"}], {"c": [None]}, "1", [1, {"b": "x"}]]
DOCUMENTS = [
    '{"name": "a", "status": "open", "maxSpeedInKph": 7, "customFieldValues": ' + json.dumps([{"field": {"id": 1, "name": "n", "type": "t"}, "value": v} for v in VALUES]) + "}",
    '{"name": "b", "status": "", "status": "done", "minSpeedInKph": "3", "customFieldValues": [{"field": {"name": "Avg speed"}, "value": 5.5}, {"field": {"name": "n"}, "value": [ 1, {"b":"x"} ]}]}',
    '{"name": "c", "status": "open", "status": ""}',
    "no json",
    None,
]


@pytest.fixture(scope="module")
def json_tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("json"))
    rows = [(i, f"s{i}", "p", d) for i, d in enumerate(DOCUMENTS)]
    spark.createDataFrame(rows, "record_id long, sequence_id string, metadata_json string, payload string").write.parquet(f"{at}/metadata_json.parquet")
    return at


def text(v):
    return "" if v is None else v if isinstance(v, str) else str(v) if isinstance(v, bool) else json.dumps(v)


def test_documents_with_all_values_and_columns(spark, json_tables):
    docs = {i: json.loads(d) for i, d in enumerate(DOCUMENTS) if d and d.startswith("{")}
    run = lambda name: entry.queries()[name](spark, json_tables).collect()
    fields = [(i, c["field"]["name"], text(c["value"])) for i, d in docs.items() for c in d.get("customFieldValues", [])]
    assert sorted((r.record_id, r.field_name, r.value) for r in run("json_fields_long")) == sorted(fields)
    assert {(r.field_name, r.value): r["count"] for r in run("json_field_values")} == Counter((n, v) for _, n, v in fields if v != "")
    keys = Counter(k for d in docs.values() for k in d)
    filled = Counter(k for d in docs.values() for k, v in d.items() if v not in (None, "", [], {}))
    assert {r.key: (r.present_count, r.nonempty_count) for r in run("json_key_counts")} == {k: (n, filled[k]) for k, n in keys.items()}
    assert {(r.value, r["count"]) for r in run("json_profile") if r.group == "status"} == {("open", 1), ("done", 1), ("MISSING", 1)}
    flat = {r.record_id: (r.json_status, r.max_speed_kph, r.min_speed_kph, r.avg_speed) for r in run("json_flat")}
    assert flat == {0: ("open", "7", "", ""), 1: ("done", "", "3", "5.5"), 2: ("", "", "", "")}


def test_names_of_nothing_are_blank(spark):
    tags = [{"id": 0, "name": False}, {"id": "0", "name": True, "tagCategory": {"id": 0.0, "name": []}}, {"id": None, "name": {}, "tagSubCategory": {"id": 7, "name": " x "}}]
    df = metadata.parse(spark.createDataFrame([(1, "s", json.dumps({"tags": tags}))], "record_id long, sequence_id string, payload string"))
    got = [tuple(r)[2:] for r in metadata.tags_long(df).collect()]
    assert got == [("", "", "", "", "", ""), ("0", "True", "", "", "", ""), ("", "", "", "", "7", "x")]


def test_first_values_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(labels, "BLOCKS_AT_ONCE", 2)
    lines = [(0, "f", 0, "frame_idx,Class")] + [(i, "f", i, f"{i},{'' if i < 20_000 else 'v' + str(i)}") for i in range(1, 60_000, 7)] + [(70_000, "f", None, "1,zz")]
    df = spark.createDataFrame(lines, "record_id long, file_path string, line_no int, label_v2_csv string")
    got = {r.column_name: (r.nonempty_count, r.sample_values) for r in labels.profile_lines(df).collect()}
    numbers = [i for i in range(1, 60_000, 7)]
    late = [f"v{i}" for i in numbers if i >= 20_000]
    assert got == {"frame_idx": (len(numbers) + 1, "|".join(map(str, numbers[:5]))), "class": (len(late) + 1, "|".join(late[:5]))}


def test_lines_without_a_number_are_all_kept(spark):
    lines = [(1, "f", 0, "frame_idx,Class"), (2, "f", 1, "1,a"), (3, "f", 1, "1,a"), (4, "f", None, "7,c"), (5, "f", None, "8,b"), (6, "f", None, "9,b")]
    df = spark.createDataFrame(lines, "record_id long, file_path string, line_no int, label_v2_csv string")
    assert {tuple(r) for r in labels.profile_lines(df).collect()} == {("f", "frame_idx", 4, "1|7|8|9"), ("f", "class", 4, "a|b|b|c")}
    assert {tuple(r) for r in labels.rows_per_file(df).collect()} == {(4, 1)}
    assert [r.class_value for r in labels.preview_lines(df).orderBy("label_row_idx").collect()] == ["a", "c", "b", "b"]
