import random
from datetime import datetime, timedelta
from itertools import permutations

from kerbline.operators.drift import ROLES, assign, match, schema_changes, unified_fields, unified_rows

PROFILE = "campaign_id string, recorded_at timestamp, profiled_at timestamp, sequence_id string, label_v2_csv string, columns string, " + ", ".join(f"{r} string" for r in ROLES)
COLUMN = "sequence_id string, label_v2_csv string, column_name string, nonempty_count long, sample_values string"
START = datetime(2024, 1, 1)


def profile(seq, t, columns, campaign="c", **roles):
    at = None if t is None else START + timedelta(hours=t)
    return (campaign, at, at, seq, seq, columns, *[roles.get(r) for r in ROLES])


def changes(spark, profiles, columns=()):
    out = schema_changes(spark.createDataFrame(profiles, PROFILE), spark.createDataFrame([(s, s, c, 1, v) for s, c, v in columns], COLUMN))
    return {tuple(r) for r in out.collect()}


def test_kinds_of_changes(spark):
    ps = [
        profile("1", 0, "f|Class|x|d", class_col="Class", distance_col="d"),
        profile("2", 1, " F |CLASS|x|d", class_col="class", distance_col="d"),  # spelling only
        profile("3", 2, "f|label class|x|d", class_col="label class", distance_col="d"),  # by role
        profile("4", 3, "f|kind|x|d|new", class_col=None, distance_col="d"),  # by place
        profile("5", 4, "x|f|kind|d|new", class_col=None, distance_col="d"),  # order only
        profile("6", 5, "x|f|kind|new", class_col=None),
    ]
    cs = [("1", "d", "1|2"), ("1", "Class", "4|5"), ("2", "d", "1,5|2"), ("3", "d", ""), ("4", "kind", "a|b"), ("5", "d", "7")]
    assert changes(spark, ps, cs) == {
        ("2", "type_changed", "d", "d"), ("3", "renamed", "class", "label class"), ("4", "renamed", "label class", "kind"), ("4", "added", "", "new"),
        ("4", "type_changed", "class", "kind"), ("5", "type_changed", "d", "d"), ("6", "removed", "d", ""),
    }


def test_nulls_repeats_ties_and_empty(spark):
    p = profile("1", 0, "a|b")
    assert changes(spark, [p, p, profile("2", 0, "a|c"), profile("3", None, None), profile("9", 1, "z", campaign=None)]) == {
        ("1", "added", "", "a"), ("1", "added", "", "b"), ("2", "renamed", "b", "c"),
    }
    assert changes(spark, []) == set()


def test_one_large_campaign_in_many_partitions_equals_one_task(spark):
    r = random.Random(3)
    names, ps, cs = ["f", "Class", "d", "x"], [], []
    for t in range(300):
        step = r.random()
        if step < 0.1:
            names = [*names, f"n{t}"]
        elif step < 0.2 and len(names) > 3:
            names = [n for n in names if n != r.choice(names[1:])]
        elif step < 0.3:
            names = [f"k{t}" if n == names[1] else n for n in names]
        elif step < 0.4:
            names = r.sample(names, len(names))
        seq = f"{t:04d}"
        known = names[1] if len(names) > 1 and not names[1].startswith("k") else None
        ps.append(profile(seq, t, "|".join(names), campaign="big" if t > 20 else "a", class_col=known))
        cs += [(seq, n, r.choice(["1|2", "1.5", "x", "", "7"])) for n in names if r.random() < 0.4]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = changes(spark, ps, cs)
        fields_one = unified(spark, ps, cs)
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        many = changes(spark, ps, cs)
        fields_many = unified(spark, ps, cs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(one) > 100 and one == many
    assert fields_one == fields_many


def unified(spark, ps, cs):
    out = unified_fields(spark.createDataFrame(ps, PROFILE), spark.createDataFrame([(s, s, c, 1, v) for s, c, v in cs], COLUMN))
    return {(r.sequence_id, r.column_name): r.field_name for r in out.collect()}


def test_unified_names_follow_renames(spark):
    ps = [profile("1", 0, "f|Class", class_col="Class"), profile("2", 1, "f|label class", class_col="label class"), profile("3", 2, "f|kind")]
    assert unified(spark, ps, [])[("3", "kind")] == "class"


def test_matching_is_optimal():
    r = random.Random(1)
    for _ in range(60):
        n, m = r.randint(1, 4), r.randint(1, 4)
        w = [[r.choice([0, 0, r.random() * 9]) for _ in range(m)] for _ in range(n)]
        got = sum(w[i][j] for i, j in assign(w))
        size = max(n, m)
        full = [[w[i][j] if i < n and j < m else 0 for j in range(size)] for i in range(size)]
        assert abs(got - max(sum(full[i][p[i]] for i in range(size)) for p in permutations(range(size)))) < 1e-9


def test_sparse_matching_equals_dense():
    r = random.Random(2)
    for _ in range(80):
        n, m = r.randint(1, 5), r.randint(1, 5)
        edges = {f"a{i}": {f"b{j}": r.random() * 9 + 0.01 for j in range(m) if r.random() < 0.4} for i in range(n)}
        edges = {a: own for a, own in edges.items() if own}
        dense = [[own.get(f"b{j}", 0.0) for j in range(m)] for own in edges.values()]
        got = match(edges)
        assert len(set(got.values())) == len(got)
        assert abs(sum(edges[a][b] for a, b in got.items()) - sum(dense[i][j] for i, j in assign(dense))) < 1e-9


def test_sketches_types_and_names_decide_where_roles_and_places_are_silent(spark):
    ps = [profile("1", 0, "f|g|h|k|weather|remark|speed"), profile("2", 1, "speed_kmh|x1|weather_tag|y2|f|g|h|k")]
    cs = [
        ("1", "weather", "dry|rain|fog"), ("1", "remark", "left side seen late|ok"), ("1", "speed", "12.5|14.0|9.5"), ("2", "weather_tag", "rain|fog|dry"),
        ("2", "speed_kmh", "11.5|14.0|8.5"), ("2", "x1", "7|8"), ("2", "y2", "ok|left side seen late"),
    ]
    out = schema_changes(spark.createDataFrame(ps, PROFILE), spark.createDataFrame([(s, s, c, 1, v) for s, c, v in cs], COLUMN))
    assert {tuple(r)[1:] for r in out.collect()} == {("renamed", "weather", "weather_tag"), ("renamed", "speed", "speed_kmh"), ("renamed", "remark", "y2"), ("added", "", "x1")}
    without = schema_changes(spark.createDataFrame(ps, PROFILE), spark.createDataFrame([], COLUMN))
    assert not {r.change_kind for r in without.collect()} & {"renamed"}  # the names alone do not tell
    told = schema_changes(spark.createDataFrame(ps, PROFILE), spark.createDataFrame([(s, s, c, 1, v) for s, c, v in cs], COLUMN), told_only=True)
    assert {r.change_kind for r in told.collect()} == {"added", "removed"}


def test_rows_under_unified_names(spark):
    ps = [profile("1", 0, "f|Class", class_col="Class"), profile("2", 1, "f|label class", class_col="label class")]
    fields = unified_fields(spark.createDataFrame(ps, PROFILE), spark.createDataFrame([], COLUMN))
    loaded = spark.createDataFrame(
        [(1, "1", 1, ["f", "class"], ["1", "a"]), (2, "2", 9000, ["f", "label class"], ["2", "b"]), (3, "x", 1, ["f", "f"], ["3", "4"]), (4, None, None, ["z"], ["9"])],
        "id long, file string, line_no long, names array<string>, fields array<string>",
    )
    got = {r.id: r["values"] for r in unified_rows(loaded, fields).collect()}
    assert got == {1: {"f": "1", "class": "a"}, 2: {"f": "2", "class": "b"}, 3: {"f": "3"}, 4: {"z": "9"}}
