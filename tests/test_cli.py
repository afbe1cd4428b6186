import csv
import json
import os

import numpy as np
import pytest
import yaml

from kerbline.cli import main
from kerbline.sources import sinks, tables
from kerbline.sources.config import load_paths
from kerbline.sources.inventory import list_files


@pytest.fixture
def project(tmp_path):
    configs = tmp_path / "configs" / "paths"
    configs.mkdir(parents=True)
    config = {"profile_name": "t", "paths": {k: k for k in ("raw_data_root", "manifests_dir", "processed_dir", "samples_dir", "outputs_dir")} | {"project_root": "."}}
    (configs / "t.yaml").write_text(yaml.safe_dump(config))
    for i in range(6):
        d = tmp_path / "raw_data_root" / "lot" / f"run {i}"
        d.mkdir(parents=True)
        for name in ("front.mp4", "rear.avi", "uss.mp4", "_hidden_topview.jpg"):
            (d / name).write_bytes(b"")
        (d / "label_v2.csv").write_text("Class,Which object,xmin\n1,Pole,2\n2,,3\n")
        tags = [{"name": ["Forward", "Reverse", "?"][i % 3], "tagSubCategory": {"name": "Driving Direction"}}, {"name": "Pole:1", "tagSubCategory": {"name": "Label Objects"}}]
        (d / "meta.json").write_text(json.dumps({"name": f"n{i}", "tags": tags, "customFieldValues": []}) if i != 5 else "broken")
    return tmp_path


class GreyDecoder:
    def probe(self, path):
        return (100, 25.0, 8, 6)

    def frames(self, path, indices):
        return [np.full((6, 8, 3), i, np.uint8) for i in indices]


class BrokenReviewer:
    def __init__(self, model_id, max_new_tokens):
        assert (model_id, max_new_tokens) == ("m", 700)

    def review(self, prompt, board_path):
        raise RuntimeError("down")


def read(path):
    with open(path, newline="", encoding="utf-8") as f:
        return list(csv.DictReader(f))


def test_pipeline(spark, project):
    run = lambda *a: main(["--configs", str(project / "configs" / "paths"), *a, "--profile", "t"], spark)
    assert run("build-manifest")["sequences"] == 6
    assert run("enrich-manifest")["json_loaded"] == 5
    assert run("profile-json") | {"out": ""} == {"out": "", "documents": 6, "loaded": 5}
    assert run("sample-subset", "--n-front", "1") | {"out": ""} == {"out": "", "rule_ready": 3, "unknown": 1}
    assert run("profile-labels")["labels_loaded"] == 3
    profile = project / "outputs_dir" / "label_profile"
    assert len(read(profile / "label_v2_long_preview.csv")) == 6 and {r["class_value"] for r in read(profile / "label_v2_long_preview.csv")} == {"1", "2"}
    assert {(r["group"], r["value"], r["count"]) for r in read(profile / "label_v2_summary.csv")} >= {
        ("overview", "labels_loaded", "3"), ("overview", "sample_rows", "3"), ("overview", "label_errors", "0"), ("label_object_values", "Pole", "3"), ("class_values", "2", "3"), ("rows_per_label_file", "2", "3"),
    }
    groups = [r["group"] for r in read(profile / "label_v2_summary.csv")]
    assert list(dict.fromkeys(groups)) == ["overview", "columns", "label_object_values", "class_values", "target_object_from_json", "rows_per_label_file"]
    directions = [r for r in read(project / "manifests_dir" / "enriched_manifest_profile.csv") if r["group"] == "driving_direction"]
    assert [(r["value"], r["count"]) for r in directions] == [("Forward", "2"), ("Reverse", "2"), ("?", "1"), ("MISSING", "1")]
    assert run("contact-plan")["sequences"] == 3
    reviews = project / "outputs_dir" / "reviews" / "rule_ready_sample"
    assert run("contact-sheets", "--decoder", "tests.test_cli:GreyDecoder") | {"out": ""} == {"out": "", "sequences": 3, "pairs_saved": 3}
    assert run("review-sheet")["rows"] == 3
    assert run("review-boards") | {"out": ""} == {"out": "", "rows": 3, "boards_saved": 3}
    assert run("review-input")["rows"] == 3
    assert all(os.path.exists(r["review_board_path"]) and r["review_board_saved"] == "1" for r in read(reviews / "review_input.csv"))
    assert run("auto-review", "--limit", "2")["reviewed"] == 2
    journal = reviews / "auto_review.csv.journal"  # left by a run that was broken off
    journal.mkdir()
    last = read(reviews / "review_input.csv")[2]["sequence_id"]
    (journal / "x.jsonl").write_text(json.dumps({"sequence_id": last, "answer": '{"ratio_scores": [], "overall_reason": "kept"}'}) + '\n{"sequence_id": "cut o')
    assert run("auto-review", "--limit", "0", "--reviewer", "tests.test_cli:BrokenReviewer", "--model-id", "m")["reviewed"] == 1
    assert [r["ai_reason"] for r in read(reviews / "auto_review.csv") if r["sequence_id"] == last] == ["kept"] and not journal.exists()
    assert {r["ai_status"] for r in read(reviews / "auto_review.csv")} == {"ok"} and len(read(reviews / "auto_review.csv")) == 3
    assert run("auto-review", "--limit", "0")["reviewed"] == 0
    assert (project / "outputs_dir" / "json_profile" / "report.md").read_text().startswith("# JSON metadata")
    assert run("print-paths")["profile_name"] == "t"
    with pytest.raises(FileNotFoundError):
        run("enrich-manifest", "--manifest", str(project / "none.csv"))
    with pytest.raises(FileNotFoundError):
        load_paths("none", project / "configs" / "paths")


def test_inventory_lists_every_file(spark, project):
    rows = list_files(spark, str(project / "raw_data_root"))
    assert rows.count() == 36 and rows.filter("path like '%_hidden%'").count() == 6


def test_csv_edges(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffid,t\r\n1,\"a \"\"b\"\"\nc\"\r\n2,\r\n".encode())
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "a.csv"), ["t", "id", "new"]).collect()] == [('a "b"\nc', "1", ""), ("", "2", "")]
    (tmp_path / "e.csv").write_bytes(b"")
    assert tables.read_csv(spark, str(tmp_path / "e.csv"), ["x"]).count() == 0
    sinks.write_csv(spark.createDataFrame([], "a int"), str(tmp_path / "sub" / "o.csv"))
    assert (tmp_path / "sub" / "o.csv").read_bytes() == b""
    sinks.write_csv(spark.createDataFrame([], "a int, b string"), str(tmp_path / "sub" / "o.csv"), header_always=True)
    assert (tmp_path / "sub" / "o.csv").read_bytes() == b"a,b\n"
    rows = [(i, f' x{i}, "q"\nnext ', None, i % 2 == 0) for i in range(50)]
    sinks.write_csv(spark.createDataFrame(rows, "i int, t string, n string, f boolean").repartition(5).orderBy("i"), str(tmp_path / "o.csv"))
    assert [(r["i"], r["t"], r["n"], r["f"]) for r in read(tmp_path / "o.csv")] == [(str(i), t, "", str(f)) for i, t, _, f in rows]
    a, b = spark.createDataFrame([(1, "x")], "i int, q string"), spark.createDataFrame([("y", 2.0)], "p string, r double")
    out = sinks.union_fields([a, b], ["p", "i"])
    assert out.columns == ["p", "i", "q", "r"] and {tuple(r) for r in out.collect()} == {("", "1", "x", ""), ("y", "", "", "2.0")}
