from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kerbline.operators.rejects import judge_lines, rejected_lines, split_lines

SCHEMA = "record_id long, file_path string, line_no long, label_v2_csv string"


def found(spark, rows, schema=SCHEMA):
    return {(r.id, r.reason) for r in rejected_lines(spark.createDataFrame(rows, schema)).collect()}


def test_reasons_in_order(spark):
    h = "\ufeffframe_idx;Class;xmin;PolygonX;Distance"
    rows = [
        (1, "f", 0, h),
        (2, "f", 1, '1;"a;b";1,5;1 2 3;4,7 m'),  # fine
        (3, "f", 2, '1;"a;1,5;1 2;3'),  # never closed
        (4, "f", 3, '1;Pole 12" tall;1;1;1'),
        (5, "f", 4, '1;"a""b";1;1;1'),  # doubled, fine
        (6, "f", 5, "1;a;1;1"),
        (7, "f", 6, "1;a;1.5;1;1"),  # a point is no decimal mark here
        (8, "f", 7, "NA;a;1;1;1"),
        (9, "f", 8, "1;a;NA;None;"),  # missing values, fine
        (10, "f", 9, "1;a;1;1  2;1"),
        (11, "f", 10, "1;a;1;1 2;-5"),
        (12, "f", 11, "1;a;1e3;1 2;5 kg"),
        (13, "f", 12, '"7";a;1;1 2,5;5mm'),  # fine
        (14, "f", 13, None),  # an empty record
    ]
    assert found(spark, rows) == {
        (3, "broken_quoting"), (4, "broken_quoting"), (6, "column_count"), (7, "invalid_value"), (8, "invalid_value"),
        (10, "invalid_value"), (11, "invalid_value"), (12, "invalid_value"), (14, "column_count"),
    }


def test_typed_rows(spark):
    rows = [(1, "f", 0, "frame_idx,Class,object,Distance,xmin,poly_x,note,note"), (2, "f", 1, '3,5,Pole,1.5 m,2,"1 2",a,b'), (3, "f", 2, "4,NA,,7 cm,None,,,")]
    typed, rejected = split_lines(spark.createDataFrame(rows, SCHEMA))
    got = {r.id: r for r in typed.collect()}
    assert rejected.count() == 0
    assert (got[2].frame_idx, got[2].class_value, got[2].distance_mm, got[2].xmin, got[2].polygon_x) == (3, "5", 1500.0, 2.0, [1.0, 2.0])
    assert got[2].other_fields == {"note": "a"}
    assert (got[3].class_value, got[3].object_value, got[3].distance_mm, got[3].xmin, got[3].polygon_x) == (None, None, 70.0, None, None)


def test_values_that_pass_are_loaded_and_values_that_no_type_holds_do_not_pass(spark):
    rows = [(1, "f", 0, "frame_idx,xmin,poly_x,Distance"), (2, "f", 1, f"{'9' * 23},{'8' * 290},1 2,3 cm"), (3, "f", 2, f"{'9' * 39},1,1,1"), (4, "f", 3, f"1,{'9' * 400},1,1"), (5, "f", 4, f"1,1,1 {'9' * 400},1"), (6, "f", 5, f"1,1,1,{'9' * 400} mm"), (7, "f", 6, f"1,{'0' * 400}1.5,1,1")]
    typed, rejected = split_lines(spark.createDataFrame(rows, SCHEMA))
    got = {r.id: r for r in typed.collect()}
    assert sorted(got) == [2, 7] and int(got[2].frame_idx) == int("9" * 23) and got[2].xmin == float("8" * 290) and got[7].xmin == 1.5
    assert {(r.id, *r.errors) for r in rejected.collect()} == {(i, "invalid_value") for i in (3, 4, 5, 6)}


def test_nulls_repeats_missing_headers_and_clashing_columns(spark):
    rows = [
        (1, "a", 0, "frame_idx,x"), (2, "a", 0, "other,y,z"), (3, "a", 1, "1,2"), (3, "a", 1, "1,2"), (4, "a", None, "1,2,3"), (5, None, 1, "1,2"), (6, "b", 1, "1"), (None, "a", 2, "x,1"),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA + ", sep string, errors string")
    got = sorted(((r.id, r.reason) for r in rejected_lines(df).collect()), key=str)
    assert got == sorted([(4, "column_count"), (5, "missing_header"), (6, "missing_header"), (None, "invalid_value")], key=str)


def test_empty_table_and_long_record(spark):
    assert found(spark, []) == set()
    long = '"' + "a" * 300_000 + '""' * 3000 + '"'
    rows = [(1, "f", 0, "frame_idx,x"), (2, "f", 1, "1," + long), (3, "f", 2, "1," + long + '"'), (4, "f", 3, "1" + ",2" * 50_000)]
    assert found(spark, rows) == {(3, "broken_quoting"), (4, "column_count")}


def brute(text, sep):
    """Fields of a record by a hand-written reader, or None if its quoting is broken."""
    out, i = [], 0
    while True:
        if i < len(text) and text[i] == '"':
            j, field = i + 1, ""
            while True:
                k = text.find('"', j)
                if k < 0:
                    return None
                field += text[j:k]
                if text[k + 1 : k + 2] == '"':
                    field, j = field + '"', k + 2
                    continue
                break
            out.append(field)
            if k + 1 == len(text):
                return out
            if text[k + 1] != sep:
                return None
            i = k + 2
        else:
            k = text.find(sep, i)
            field = text[i:] if k < 0 else text[i:k]
            if '"' in field:
                return None
            out.append(field)
            if k < 0:
                return out
            i = k + 1


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet='",;\ta1\n', max_size=12), min_size=40, max_size=60), st.sampled_from([",", ";", "\t"]))
def test_fields_equal_brute_force(spark, texts, sep):
    rows = [(0, "f", 0, f"frame_idx{sep}b")] + [(i + 1, "f", i + 1, t) for i, t in enumerate(texts)]
    got = {r.id: r.fields for r in judge_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i + 1: brute(t, sep) for i, t in enumerate(texts)}


def test_lines_of_every_block_meet_their_header(spark):
    rows = [(0, "f", 0, "frame_idx,x")] + [(k, "f", n, f"{k},1" if k % 2 else "x,1") for k, n in enumerate((1, 4095, 4096, 5000, 5000, 10**15, -3, 123_456_789), 1)]
    assert found(spark, rows) == {(k, "invalid_value") for k in (2, 4, 6, 8)}
