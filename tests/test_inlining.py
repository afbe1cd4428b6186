import json

from kerbline.operators import inlining
from kerbline.operators.inlining import _parse_deep, element_columns, element_table, object_nodes, parse_object, shred, tables_of

SCHEMA = "record_id long, payload string"


def nodes(spark, payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), SCHEMA)
    return {tuple(r) for r in object_nodes(df).collect()}


def test_paths_and_parents(spark):
    doc = {"tags": [{"a": [{"b": {"c": [{}]}}]}, None, 5, [{"x": 1}, [{}]]], "customFieldValues": {"value": {"list": [{"p": 1}]}}, "other": [{}]}
    assert nodes(spark, [json.dumps(doc)]) == {
        (0, "", "tags[0]"), (0, "tags[0]", "tags[0].a[0]"), (0, "tags[0].a[0]", "tags[0].a[0].b.c[0]"), (0, "", "tags[3][0]"), (0, "", "tags[3][1][0]"),
        (0, "", "customFieldValues[0]"), (0, "customFieldValues[0]", "customFieldValues[0].value.list[0]"),
    }


def test_invalid_payloads_give_nothing(spark):
    bad = [None, "", "[]", '[{"tags":[{}]}]', '{"tags":[{}]} ok', '{"tags":[{}]}{}', "{'tags':[{}]}", '{"tags":[{}', '{"tags":[{"a":NaN}]}', '"{}"', '{"tags":[{}],}', "{\"tags\":[{\"a\":\"\n\"}]}"]
    assert nodes(spark, bad) == set()
    odd = '{"tags":[{"\\ud800":[{}],"b\\uDC00":{"c":[{}]}}]}'  # keys that are no text
    assert nodes(spark, [odd]) == {(0, "", "tags[0]"), (0, "tags[0]", "tags[0].\ufffd[0]"), (0, "tags[0]", "tags[0].b\ufffd.c[0]")}
    good = ['\ufeff {"tags":[{}]}\n', ' \ufeff{"tags":{}}', '{"tags":[],"tags":[{}]}', '{"tags":null,"customFieldValues":[{"a":"\\ud800"}]}']
    assert {n for n, _, _ in nodes(spark, good)} == {0, 1, 2, 3}


def test_deep_documents_equal_the_plain_parser(spark):
    deep = '{"tags":' + "[" * 20_000 + "{}" + "]" * 20_000 + "}"
    assert parse_object(deep) is not None
    assert nodes(spark, [deep]) == {(0, "", "tags" + "[0]" * 20_000)}
    for text in ('{"a":[1,{"b":null},"x\\u00e9"],"c":{}}', "{}", '{"a":1,}', '{"a" 1}', '{"a":01}', "[1]", '{"a":[}', '{"a":1}}', '{"a":"\\x"}', '{"a":[1 2]}', '{,}', '{"a":-1.5e3}'):
        try:
            want = json.loads(text, parse_int=str, parse_float=str)
        except ValueError:
            want = None
        assert _parse_deep(text) == (want if isinstance(want, dict) else None), text


def test_tables(spark):
    doc = {"tags": [{"id": 1, "cat": {"id": 2, "name": "n"}, "names": ["x", "y"]}], "customFieldValues": [{"cat": {"id": 3}, "flag": True}]}
    rows = shred(spark.createDataFrame([(7, json.dumps(doc)), (7, json.dumps(doc))], SCHEMA + "")).cache()
    assert rows.count() == 2 * 6  # repeated input rows repeat; the shared element cat has a table of its own
    tags = element_table(rows, "tags", ["id"]).first()
    assert (tags.id, tags.parent_path, tags.node_path) == ("1", "", "tags[0]")
    cats = {(r.parent_path, r.node_path, r.id) for r in element_table(rows, "cat", ["id"]).collect()}
    assert cats == {("tags[0]", "tags[0].cat", "2"), ("customFieldValues[0]", "customFieldValues[0].cat", "3")}
    names = {(r.node_path, r.value) for r in element_table(rows, "names", [""]).collect()}
    assert names == {("tags[0].names[0]", "x"), ("tags[0].names[1]", "y")}
    assert {(r.element, r.column): r.n for r in element_columns(rows).collect()}[("tags", "id")] == 2


def test_singletons_are_inlined_and_cycles_are_not(spark):
    assert tables_of([("", "t", True), ("t", "a", False), ("a", "b", False)]) == {"t"}
    assert tables_of([("", "t", True), ("t", "a", False), ("a", "b", False), ("b", "a", False)]) >= {"t", "a", "b"}
    row = shred(spark.createDataFrame([(1, '{"tags":[{"a":{"b":{"c":1}}}]}')], SCHEMA)).collect()
    assert [r.attributes for r in row] == [{"a.b.c": "1"}]


def test_a_graph_of_any_size_gives_the_same_tables(spark, monkeypatch):
    shapes = [{"a": {"b": {"c": 1}}}, {"b": {"a": 2}, "z": {"y": {"x": 1}}}, {"x": [{"q": 1}, 3], "only": {"single": {"s": [1, 2]}}}, {"loop": {"mid": {"loop": {"v": 1}}}}, {"self": {"self": {}}, "m": [1, 2]}]
    payloads = [json.dumps({"tags": [d], "customFieldValues": [{"k": d}]}) for d in shapes] + [json.dumps({"tags": shapes})]
    df = spark.createDataFrame(list(enumerate(payloads)), SCHEMA)
    local, cluster = (sorted(map(repr, shred(df, local_edges=n).collect())) for n in (1000, 2))
    assert local == cluster and len(local) > 30
    monkeypatch.setattr(inlining, "MAX_BROADCAST_NAMES", 0)
    assert local == sorted(map(repr, shred(df.repartition(3), local_edges=0).collect()))
    assert sorted(map(repr, object_nodes(df).collect())) == sorted(map(repr, object_nodes(df, local_edges=0).collect()))


def test_empty_and_extra_columns(spark):
    assert object_nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, '{"tags":[{}]}', "clash")], SCHEMA + ", node_path string")
    assert [tuple(r) for r in object_nodes(df).collect()] == [(None, "", "tags[0]")]
