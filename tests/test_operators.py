import json
import random

import numpy as np
from pyspark.sql import functions as F

from kerbline.operators import inventory, labels, media, metadata, review, sampling
from kerbline.operators.profile import Group, counter_profile, piped
from kerbline.streaming.resume import review_stream


def test_leaves_equal_a_nested_loop(spark):
    r = random.Random(5)
    for _ in range(4):
        dirs = {"/".join(r.choices("abc-_", k=r.randint(1, 5))) for _ in range(60)}
        got = {x.dir for x in inventory.leaf_directories(spark.createDataFrame([(d,) for d in dirs] * 2, "dir string")).collect()}
        assert got == {d for d in dirs if not any(e.startswith(d + "/") for e in dirs)}


def test_roles_and_manifest(spark):
    files = [
        "a/b/x_front.AVI", "a/b/x_front.mp4", "a/b/front_uss.webm", "a/b/label_v2.csv", "a/b/z.json", "a/b/m.json", "a/b/.pure.bz2", "a/b/pfdf4.json", "a/b/.front.mp4",
        "a/two_front.mp4", "a/uss.jpg", "a/label_v1.xlsx", "a-b/front.mp4", "a-b/c.json", "a-b/d.mf4", "root_front.mp4", "root.json", "root.mf4", "c/front.mp4", "c/x.json",
    ]
    rows = {r.sequence_id: r for r in inventory.build_manifest(spark.createDataFrame([(f,) for f in files], "path string")).collect()}
    assert list(rows) == ["a__b", "a-b"]  # ordered by parts; the parent of a sequence, the root and two roles are none
    ab = rows["a__b"]
    assert (ab.front_video, ab.topview_video, ab.metadata_json, ab.pfdf4_pure_bz2, ab.is_poc_ready) == ("a/b/.front.mp4", "a/b/front_uss.webm", "a/b/m.json", "a/b/.pure.bz2", True)


def test_profile_ties_and_limits(spark):
    df = spark.createDataFrame([(1, "b", "x|y"), (2, "a", "x"), (3, None, None), (4, "b", ""), (5, "a", " y ")], "i int, g string, p string")
    rows = {tuple(r) for r in counter_profile(df, [Group("g", "g", missing="MISSING", top=1), piped("p", "p")], first_seen="i").collect()}
    assert rows == {("g", "b", 2), ("p", "x", 2), ("p", "y", 2)}
    assert counter_profile(df.limit(0), [Group("g", "g")]).count() == 0


def test_enrich(spark):
    good = {"name": " n ", "tags": [{"name": "Forward", "tagSubCategory": {"name": "x.Driving Direction"}}, {"name": "Rain", "tagSubCategory": {"name": "Weather Conditions"}}, None], "customFieldValues": [{"field": {"name": "Avg speed"}, "value": 5.0}]}
    docs = [("p1", json.dumps(good), 1), ("p1", "old", 0), ("p2", '{"tags": null}', 1), ("p3", "no json", 1), ("p4", "{}", 1)]
    manifest = spark.createDataFrame([(f"s{i}", f"p{i}") for i in range(1, 6)] + [("s6", None)], "sequence_id string, metadata_json string")
    rows = {r.sequence_id: r for r in metadata.enrich(manifest, spark.createDataFrame(docs, "metadata_json string, payload string, received_at int")).collect()}
    assert (rows["s1"].json_loaded, rows["s1"].preferred_camera_rule, rows["s1"].weather_tags, rows["s1"].avg_speed, rows["s1"].sequence_name_json) == (1, "front", "Rain", "5.0", "n")
    why = {k: r.preferred_camera_rule_reason for k, r in rows.items()}
    assert why == {"s1": "json_driving_direction", "s2": "json_parse_error", "s3": "json_parse_error", "s4": "no_direction_rule", "s5": "no_metadata", "s6": "no_metadata"}


def test_round_robin_equals_dealing(spark):
    r = random.Random(2)
    rows = [(f"i{k}", r.choice("aaaaaaaabcdefg"), r.choice(["x", "x", None, "", " y"])) for k in range(5000)]
    df = spark.createDataFrame(rows, "sequence_id string, s string, t string")
    import hashlib

    md5 = lambda *p: hashlib.md5("\x1f".join(p).encode()).hexdigest()
    for n in (0, 1, 37, 500, 4200, 9000):
        groups = {}
        for i, s, t in rows:
            groups.setdefault(f"{s}\x1f{(t or 'MISSING').strip()}", []).append(i)
        queues = [sorted(v, key=lambda i: (md5("9", i), i)) for k, v in sorted(groups.items(), key=lambda kv: (md5("9", kv[0]), kv[0]))]
        want = []
        while len(want) < n and any(queues):
            want += [q.pop(0) for q in queues if q]
        assert {x.sequence_id for x in sampling.round_robin(df, ["s", "t"], n, seed=9).collect()} == set(want[:n])


def test_label_files(spark):
    files = [("a.csv", b"Class;xmin\n1;2\n;3\n"), ("b.csv", b"one\n1\n"), ("c.csv", None), ("d.csv", "Which object,PolygonX\nW\xe4nd,1 2\nNA, \n".encode("latin1"))]
    profiled = labels.profile_files(spark.createDataFrame(files, "path string, content binary")).cache()
    sample = spark.createDataFrame([("s1", "a.csv", "Pole:1"), ("s2", "b.csv", ""), ("s3", "c.csv", ""), ("s4", "d.csv", ""), ("s5", "", ""), ("s6", "z.csv", "")], "sequence_id string, label_v2_csv string, label_objects_json string")
    sample = sample.withColumns({"preferred_camera_rule": F.lit("front"), "driving_direction": F.lit("")})
    rows = {r.sequence_id: r for r in labels.sequence_profile(sample, profiled).collect()}
    assert set(rows) == {"s1", "s4"} and (rows["s1"].class_col, rows["s1"].class_nonempty_rows, rows["s1"].target_object) == ("Class", 1, "Pole")
    assert rows["s4"].object_nonempty_rows == 1
    errors = {r.sequence_id: r.error for r in labels.label_errors(sample, profiled).collect()}
    assert errors["s5"] == "missing_label_v2_csv_path" and errors["s6"] == errors["s3"] == "label_v2_csv_not_found" and errors["s2"].startswith("RuntimeError")
    columns = {(r.sequence_id, r.column): r.sample_values for r in labels.column_profile(sample, profiled).collect()}
    assert columns[("s1", "xmin")] == "2|3"


ANSWER = {"ratio_scores": [{"ratio": 0.3, "object_visible_score_0_3": 3, "candidate_quality": "good"}, {"ratio": "0.60", "object_visible_score_0_3": "3", "candidate_quality": "GOOD"}, {"ratio": 0.2}, 5]}


def answers(spark, texts):
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "i int, answer string, problem string")
    return [r.asDict() for r in review.scored(df).orderBy("i").collect()]


def test_answers(spark):
    twice = {"ratio_scores": [{"ratio": "0.15", "candidate_quality": "bad"}, {"ratio": "0.15", "object_visible_score_0_3": 3, "candidate_quality": "good"}]}
    wild = ["2.0", 2.7, True, -1, 9, None, "3", " 2 ", [1], "x", False, -2.5]
    many = {"ratio_scores": [{"ratio": 0.6, "object_visible_score_0_3": x, "reason": " r "} for x in wild], "model_best_ratio": 0.2, "confidence": None, "overall_reason": " why "}
    got = answers(spark, [
        "sure ```json\n" + json.dumps(ANSWER) + "\n``` bye", '{"ratio_scores": 3}', json.dumps(twice), json.dumps(many), "[1]", "no object", '{"a": 1} {"b": 2}', 'see {x}: ```{"model_best_ratio": "0.3"}```', None,
    ])
    assert (got[0]["ai_best_ratio"], got[0]["ai_keep_for_next_stage"], got[0]["ai_status"]) == ("0.30", "1", "ok")  # the first of equals
    assert (got[1]["ai_candidate_quality"], got[1]["ai_best_ratio"], got[1]["ai_object_visible_score_0_3"], got[1]["ai_ratio_scores_json"], got[1]["ai_status"]) == ("bad", "", "", "[]", "ok")
    assert got[2]["ai_candidate_quality"] == "bad"  # fields of the first entry of the winner
    assert [x["object_visible_score_0_3"] for x in json.loads(got[3]["ai_ratio_scores_json"])] == [0, 2, 1, 0, 3, 0, 3, 2, 0, 0, 0, 0]
    clean = [{"ratio": "0.60", "object_visible_score_0_3": n, "scene_clarity_score_0_3": 0, "topview_useful_score_0_3": 0, "candidate_quality": "bad", "reason": "r"} for n in [0, 2, 1, 0, 3, 0, 3, 2, 0, 0, 0, 0]]
    assert got[3]["ai_ratio_scores_json"] == json.dumps(clean)
    assert (got[3]["ai_model_best_ratio_raw"], got[3]["ai_confidence"], got[3]["ai_reason"]) == ("0.20", "", "why")
    assert [x["ai_status"][:17] for x in got[4:7]] == ["error: ValueError"] * 3 and got[4]["ai_raw_text"] == ""
    assert (got[7]["ai_model_best_ratio_raw"], got[7]["ai_status"], got[8]["ai_status"][:5]) == ("0.30", "ok", "error")


def test_review_and_resume(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i}", f"b{i}" if i else "", "1" if i != 2 else "0") for i in range(5)], "sequence_id string, review_board_path string, review_board_saved string")
    out = {r.sequence_id: r.ai_status for r in review.review(rows).collect()}
    assert out["s1"] == "ok" and out["s0"].startswith("error: FileNotFoundError") and out["s2"].startswith("error: RuntimeError")
    done = spark.createDataFrame([(" s1 ", "ok"), ("s2", "error: x"), ("s3", " "), ("", "ok")], "sequence_id string, ai_status string")
    left = lambda **k: {r.sequence_id for r in review.unreviewed(rows, done, **k).collect()}
    assert left() == {"s0", "s3", "s4"} and left(retry_errors=True) == {"s0", "s2", "s3", "s4"} and left(start=1, limit=3) == {"s3"}
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows.write.parquet(source)
    for _ in range(2):
        review_stream(spark, source, target, check).awaitTermination(120)
    rows.withColumn("sequence_id", F.concat("sequence_id", F.lit("n"))).unionByName(rows).write.mode("append").parquet(source)
    review_stream(spark, source, target, check).awaitTermination(120)
    assert spark.read.parquet(target).count() == 10


def test_lookup_last_wins(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "sequence_id string")
    right = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), (None, "z", 3)], "sequence_id string, v string, t int")
    assert {r.sequence_id: r.v for r in review.lookup(left, right, "sequence_id", ["v"], "t").collect()} == {"a": "y", "b": "", None: ""}


def test_images():
    im = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)
    assert (media.resize(im, 6, 4) == im).all()
    assert abs(float(media.resize(im, 3, 2).mean()) - float(im.mean())) < 0.6
    padded = media.resize_with_padding(im, 20, 20)
    assert padded.shape == (20, 20, 3) and (padded[0] == 255).all() and (padded[10, 10] != 255).any()
    sheet = media.contact_grid([im, None, im])
    assert sheet.shape == (270, 960, 3) and media.contact_grid([im] * 6).shape == (484, 960, 3)
    assert (media.crop_tile(sheet, 5) == 245).all() and (media.crop_tile(sheet, 1) == 245).all()
    assert media.review_board(sheet, sheet).shape == (1517, 792, 3)
    assert media.side_by_side(im, im).shape == (4, 32, 3)
    assert media.text_block(im.copy(), ["x"], 0, 0).shape == im.shape


def test_png_files(tmp_path):
    import struct
    import zlib

    r = np.random.default_rng(1)
    im, codec, path = r.integers(0, 256, (7, 5, 3), dtype=np.uint8), media.PngCodec(), str(tmp_path / "a" / "x.png")
    assert codec.write(path, im) and (codec.read(path) == im).all()
    assert codec.read(str(tmp_path / "none.png")) is None and codec.read(__file__) is None
    # the same image with every row filter, made by the definition of the format
    before, lines = np.zeros((5, 3), int), b""
    for y, row in enumerate(im.astype(int)):
        left = np.vstack([np.zeros((1, 3), int), row[:-1]])
        corner = np.vstack([np.zeros((1, 3), int), before[:-1]])
        p = left + before - corner
        paeth = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        guess = [0 * row, left, before, (left + before) // 2, paeth][y % 5]
        lines += bytes([y % 5]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        before = row
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    (tmp_path / "f.png").write_bytes(codec.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", 5, 7, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b""))
    assert (codec.read(str(tmp_path / "f.png")) == im).all()


def test_tiles(spark):
    class FakeDecoder:
        def probe(self, path):
            return None if "bad" in path else (101, 25.0, 4, 4)

        def frames(self, path, indices):
            return [np.zeros((4, 4, 3), np.uint8) if i < 90 else None for i in indices]

    videos = spark.createDataFrame([("s", "front", "f"), ("s", "topview", "t"), ("z", "front", "bad")], "sequence_id string, camera_name string, path string")
    tiles = media.contact_tiles(videos, FakeDecoder).cache()
    got = {(r.sequence_id, r.camera_name, r.ratio): (r.frame_idx, r.time_sec, r.success) for r in tiles.collect()}
    assert got[("s", "front", 0.15)] == (15, 0.606, 1) and got[("s", "front", 0.9)] == (90, 3.636, 0) and got[("z", "front", 0.3)] == (-1, None, 0)
    assert media.tile_pairs(tiles).count() == 6
    info = {r.path: tuple(r)[1:] for r in media.video_info(videos, FakeDecoder).collect()}
    assert info["f"] == (True, 101, 25.0, 4, 4, 4.04) and info["bad"] == (False, 0, 0.0, 0, 0, 0.0)
    drawn = []
    media.review_board(np.zeros((484, 960, 3), np.uint8), np.zeros((484, 960, 3), np.uint8), ["s"], lambda im, text, x, y: drawn.append(text))
    assert drawn == ["0.15", "0.30", "0.45", "0.60", "0.75", "0.90", "s"]


def test_sheets_and_boards(spark, tmp_path):
    class Still:
        def probe(self, path):
            return None if "bad" in path else (50, 25.0, 4, 4)

        def frames(self, path, indices):
            return [np.full((8, 12, 3), 9, np.uint8) for _ in indices]

    sample = spark.createDataFrame(
        [("s1", "rear", "f1", "r1", "t1"), ("s2", "front", "bad", "", "t2"), ("s3", "x", "gone", "", "")], "sequence_id string, preferred_camera_rule string, front_video string, rear_video string, topview_video string"
    ).withColumns({c: F.lit("") for c in ("driving_direction", "approach", "primary_label_object", "weather_tags")})
    inventory_rows = spark.createDataFrame([(p,) for p in ("f1", "r1", "t1", "bad", "t2")], "path string")
    plan = review.artifact_paths(review.contact_plan(sample, inventory_rows), str(tmp_path)).cache()
    saved = media.contact_sheets(plan, "raw", Still).cache()
    assert {tuple(r) for r in saved.collect()} == {("s1", 1, 1, 1), ("s2", 1, 1, 0), ("s3", 0, 0, 0)}
    summary = {r.sequence_id: r for r in review.contact_summary(plan, saved).collect()}
    assert summary["s1"].pair_mid_path.endswith("s1/pair_rear_mid.jpg") and summary["s2"].pair_mid_path == "" and len(summary["s1"]) == 12
    boards = {r.sequence_id: r.review_board_saved for r in media.review_boards(plan).collect()}
    assert boards == {"s1": 1, "s2": 1, "s3": 0}
    assert media.NumpyCodec().read(str(tmp_path / "s1" / "ratio_review_board.jpg")).shape == (1517, 792, 3)


def test_label_values(spark):
    lines = [(1, "f", 0, "frame_idx,Class,Which object"), (2, "f", 1, "1,a,Pole"), (3, "f", 2, "2,a,"), (4, "f", 2, "2,a,"), (5, "f", 3, "x,b,Pole"), (6, "f", 4, "3,NA,Pole")]
    df = spark.createDataFrame(lines, "record_id long, file_path string, line_no long, label_v2_csv string")
    assert {tuple(r) for r in labels.value_counts(df).collect()} == {("label_object_values", "Pole", 2), ("class_values", "a", 2)}
    assert {(r.label_row_idx, r.class_value, r.object_value) for r in labels.preview_lines(df).collect()} == {(0, "a", "Pole"), (1, "a", ""), (2, "NA", "Pole")}
