import random

import numpy as np

from kerbline.llm import quota
from kerbline.llm.quota import FIELDS, divisor_seats, draw_sample, shortfalls, unmet_targets

POOL = "sequence_id string, " + ", ".join(f"{f} string" for f in FIELDS)
TARGET = "field_name string, category string, target_permille int, min_rows int"


def make(spark, n, seed=1):
    r = random.Random(seed)
    rows = [(f"s{i}", r.choice(["front", "front", "Rear ", None]), r.choice(["|Dry|Fog", " rain", "Snow", ""]), r.choice(["a", "b"]), r.choice(["x", "y", "y", "y"])) for i in range(n)]
    return spark.createDataFrame(rows, POOL)


TARGETS = [("preferred_camera_rule", "front", 500, 1), ("preferred_camera_rule", "rear", 500, 1), ("weather_tags", "Dry", 400, 2), ("weather_tags", "Rain", 300, 2), ("weather_tags", "Snow", 290, 2),
           ("weather_tags", "Hail", 10, 3), ("approach", "A", 700, 1), ("approach", "B", 300, 1), ("target_object", "X", 600, 1), ("target_object", "y", 400, 1)]


def test_sample_meets_shares_and_reports(spark):
    df, targets = make(spark, 2000), spark.createDataFrame(TARGETS, TARGET)
    sample, report = draw_sample(df, targets)
    rows = sample.collect()
    assert len(rows) == 200 and len({r.sequence_id for r in rows}) == 200
    for r in report.collect():
        assert r.unmet == (r.category == "Hail") and (r.reason == "exhausted") == r.unmet
        assert abs(r.sampled - r.seats) <= 1 and r.sampled == sum(quota_key(x, r.field_name) == r.category.lower() for x in rows)
        assert r.unmet or r.reason is not None or abs(r.sampled - r.target_permille * 0.2) < 1
        assert r.unmet or abs(r.sampled - r.target_permille * 0.2) <= 2
    assert {r.sequence_id for r in draw_sample(df.repartition(7), targets)[0].collect()} == {r.sequence_id for r in rows}  # whatever the order
    assert all(r.priority > 0 for r in rows)


def quota_key(row, field):
    return row[field]


def test_one_field_is_the_plain_divisor_method(spark):
    """Brute force: number the records of each category in hash order, sort all by (no floor, priority), keep n."""
    r = random.Random(5)
    rows = [(f"s{i}", r.choice("aaaaaabbbc"), "", None, None) for i in range(700)]
    df = spark.createDataFrame(rows, POOL)
    targets = [("preferred_camera_rule", "a", 300, 2), ("preferred_camera_rule", "b", 500, 2), ("preferred_camera_rule", "c", 200, 9)]
    ranked = quota.priorities(df, spark.createDataFrame(targets, TARGET)).filter("field_name <> ''").collect()
    order = {x.sequence_id: x.o for x in df.select("sequence_id", quota._order(42).alias("o")).collect()}
    for key in "abc":
        own = sorted((x for x in ranked if x.key == key), key=lambda x: x["rank"])
        assert [x["rank"] for x in own] == list(range(1, len(own) + 1))
        assert [x.sequence_id for x in own] == sorted((x.sequence_id for x in own), key=lambda i: (order[i] >> 40) % 2**24 % quota.RANGES * 2**64 + order[i])
    want = sorted(ranked, key=lambda x: (not x.is_floor, x.priority))[:70]
    got = draw_sample(df, spark.createDataFrame(targets, TARGET))[0].collect()
    assert {x.sequence_id for x in got} == {x.sequence_id for x in want}


def test_smallest_equals_sorting(spark, monkeypatch):
    monkeypatch.setattr(quota, "BOUNDARY", 3)
    r = random.Random(1)
    rows = [(f"s{i:03}", r.choice([1e-30, 0.5, 0.5, r.random(), 10.0 ** r.randint(-20, 40)])) for i in range(400)]
    df = spark.createDataFrame(rows, "sequence_id string, priority double")
    for n in (0, 1, 7, 150, 399, 400, 900):
        assert sorted(tuple(x) for x in quota._smallest(df, n).collect()) == sorted(sorted(rows, key=lambda x: (x[1], x[0]))[:n])


def test_unmet_brute_force(spark):
    rows = [("1", "Front", "a", "p", "x"), ("1", " front", "a", "p", "x"), ("2", "rear", None, "p", "x"), (None, "rear", "a", "p", "x")] + [(f"k{i}", "front", "|", "q", "y") for i in range(18)]
    df = spark.createDataFrame(rows, POOL)  # 20 sequences, n = 2
    ts = [("preferred_camera_rule", "REAR", 500, 1), ("preferred_camera_rule", "rear", 500, 2), ("weather_tags", "A", 500, 1), ("weather_tags", "b", 1, 0), ("approach", "p", 1000, 1), ("approach", "p", 1001, 1)]
    got = {tuple(r) for r in unmet_targets(df, spark.createDataFrame(ts, TARGET)).collect()}
    assert got == {("preferred_camera_rule", "rear"), ("weather_tags", "b"), ("approach", "p")}


def test_empty_pool_nulls_and_clashing_columns(spark):
    targets = spark.createDataFrame([("approach", "a", 1000, 1), ("approach", "b", 0, 0), (None, None, None, None)], TARGET)
    sample, report = draw_sample(spark.createDataFrame([], POOL), targets)
    assert sample.count() == 0
    assert {r.category: r.unmet for r in shortfalls(spark.createDataFrame([], POOL), targets).collect()} == {"a": True, "b": False}
    assert {r.category: r.reason for r in report.collect()} == {"a": "below_minimum", "b": None}
    df = spark.createDataFrame([(f"s{i}", None, None, "A", None, 1, 2) for i in range(30)], POOL + ", cell int, seats int")
    sample, _ = draw_sample(df, targets)
    assert sample.count() == 3
    assert draw_sample(df, targets.limit(0))[0].count() == 0  # no targets, no pool to speak of


def test_divisor_seats_equal_sorting_all_priorities():
    r = np.random.default_rng(0)
    for _ in range(200):
        k = r.integers(1, 6)
        counts, shares = r.integers(0, 30, k), np.round(r.random(k) * 10, 3) + 0.001
        floors = np.minimum(r.integers(0, 3, k), counts)
        size = int(r.integers(0, counts.sum() + 3))
        every = sorted((0 if j < floors[c] else 1, (j + 0.5) / shares[c], c) for c in range(k) for j in range(counts[c]))
        want = np.bincount([c for _, _, c in every[: max(size, floors.sum())]], minlength=k)
        assert (divisor_seats(counts, shares, floors, size) == want).all()
