import pytest
from pyspark.sql import functions as F

from kerbline.functions import documents as D
from kerbline.functions import geometry as G
from kerbline.functions import review as R
from kerbline.functions import text as X
from kerbline.operators.labels import find_column


def of(spark, make, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_text(spark):
    blank = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
    assert of(spark, X.strip, [f"{blank}a b{blank}", None, blank]) == ["a b", None, ""]
    assert of(spark, X.truthy, ["1", " True ", "yes", "no", "", None]) == [True, True, True, False, False, False]
    assert of(spark, X.split_pipe, ["a| b||c ", "", None, "|"]) == [["a", "b", "c"], [], [], []]
    assert of(spark, X.last_segment, ["v2.Environment. Scene ", "Scene", None, "a."]) == ["Scene", "Scene", "", ""]
    assert of(spark, X.join_distinct, [["b", " a", "b", None, ""], [], None], "array<string>") == ["b|a", "", ""]


def test_rules(spark):
    assert of(spark, D.primary_object, ["", "empty", "empty|Pole:2", ":x|Wall", " Pole : 1 ", None]) == ["unknown", "empty_control", "Pole", "Wall", "Pole", "unknown"]
    assert of(spark, D.preferred_camera, ["Forward", " forwards", "Reverse", "rearward", "Backward", "", None, "sideways"]) == ["front", "front", "rear", "rear", "rear"] + ["unknown"] * 3
    assert of(spark, D.stratum, [None, "", " ", " a "]) == ["MISSING", "MISSING", "", "a"]
    assert of(spark, D.resolved_camera, ["REAR ", "unknown", None]) == ["rear", "front", "front"]


def test_strict_json(spark):
    good = ['{"a":1}', '{"a":1,"a":2}', "{}"]
    bad = ['{"a":1} sure!', "{'a':1}", "[1]", "1", "", None, '{"a":1}{}', '{"a"']
    D.allow_repeated_keys(spark)
    assert of(spark, D.is_object, good + bad) == [True] * 3 + [False] * 8


def test_review_scalars(spark):
    assert of(spark, R.ratio_key, ["0.3", "0.30", "0.145", "0.1450001", "0.2", "x", None, "0.6"]) == ["0.30", "0.30", None, "0.15", None, None, None, "0.60"]
    assert of(spark, R.score, ["3", "2.0", "-1", "9", None, "x", " 2 ", "99999999999999999999999999"]) == [3, 0, 0, 3, 0, 0, 2, 3]
    assert of(spark, R.quality, ["GOOD ", "fine", None]) == ["good", "bad", "bad"]
    assert of(spark, R.keeps, ["good", "good_enough", "borderline", None]) == ["1", "1", "0", "0"]
    D.allow_repeated_keys(spark)
    assert of(spark, R.json_block, ['{"a":1}', 'x ```json\n{"a":2}\n``` y', 'so {"a":3} it is', '{"a":1} {"b":2}', "none"]) == ['{"a":1}', '{"a":2}', '{"a":3}', None, None]


def test_find_column(spark):
    f = lambda names: (lambda c: find_column(c, names))
    names = [["xmin", "XMIN "], ["my class id"], ["class_id", "Class"], [], None]
    assert of(spark, f(("class", "class_id")), names, "array<string>") == ["", "my class id", "Class", "", ""]
    assert of(spark, f(("xmin",)), names[:1], "array<string>") == ["XMIN "]


@pytest.mark.parametrize(("n", "r", "want"), [(0, 0.5, -1), (1, 0.9, 0), (100, 0.15, 15), (101, 0.45, 45), (11, 2.0, 10), (11, -1.0, 0), (6, 0.5, 2), (4, 0.5, 2)])
def test_frame_index(spark, n, r, want):
    assert of(spark, lambda c: G.frame_index(c, r), [n], "int") == [want]


def test_board():
    assert G.board_size() == (792, 1517)
