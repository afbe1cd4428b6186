"""Command line: one command per stage. ``python -m kerbline.cli COMMAND --help`` lists its options."""

from __future__ import annotations

import argparse
import importlib
import shutil
import sys
from collections.abc import Callable, Sequence
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions.text import is_blank, strip
from kerbline.operators import inventory, labels, media, metadata, review, sampling
from kerbline.session import local_session
from kerbline.sources import sinks, tables
from kerbline.sources.config import Profile, load_paths
from kerbline.sources.inventory import list_files

SAMPLES = ("rule_ready_sample", "unknown_camera_review_sample")


def _need(path: Path) -> str:
    if not path.exists():
        raise FileNotFoundError(f"missing input: {path}")
    return str(path)


def _made(name: str, **options) -> Callable:
    """What ``module:name`` names, called with options on the executors: a reviewer, a decoder, a codec."""
    module, _, attribute = name.partition(":")
    return partial(getattr(importlib.import_module(module), attribute), **options)


def _first(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in the order of their file (0: all)."""
    if not n:
        return rows
    return rows.withColumn("_row", F.monotonically_increasing_id()).orderBy("_row").limit(n).drop("_row")


def _write(df: DataFrame, path: str, groups: Sequence[str] = ()) -> None:
    """A CSV of counts, the most frequent first (within groups, which come in the given order), or of anything else as it is."""
    if "count" in df.columns:
        place = F.array_position(F.lit(list(groups)), F.col("group")) if groups else None
        values = [c for c in df.columns if c not in ("group", "count")]
        df = df.orderBy(*([place] if place is not None else []), F.desc("count"), *values)
    sinks.write_csv(df, path)


def _documents(spark: SparkSession, paths: Profile, manifest: DataFrame) -> DataFrame:
    named = manifest.select(strip("metadata_json").alias("path")).filter("path <> ''").distinct()
    return tables.read_documents(spark, str(paths.raw_data_root), named).withColumnRenamed("path", "metadata_json")


def build_manifest(spark: SparkSession, a: argparse.Namespace, paths: Profile) -> dict:
    out = a.out or str(paths.manifests_dir / "sequence_manifest.csv")
    rows = inventory.build_manifest(list_files(spark, _need(Path(a.raw_dir or paths.raw_data_root))))
    sinks.write_csv(rows, out, header_always=True)
    return {"out": out, **sinks.run_summary(rows, {"sequences": F.count("*"), "ready": F.count_if("is_poc_ready")})}


def enrich_manifest(spark: SparkSession, a: argparse.Namespace, paths: Profile) -> dict:
    rows = tables.read_csv(spark, _need(Path(a.manifest or paths.manifests_dir / "sequence_manifest.csv")))
    rich = metadata.enrich(rows, _documents(spark, paths, rows)).cache()
    out, summary = a.out or str(paths.manifests_dir / "sequence_manifest_enriched.csv"), a.summary_out or str(paths.manifests_dir / "enriched_manifest_profile.csv")
    sinks.write_csv(rich, out)
    _write(metadata.manifest_profile(rich), summary, metadata.MANIFEST_GROUPS)
    return {"out": out, **sinks.run_summary(rich, {"sequences": F.count("*"), "json_loaded": F.sum("json_loaded")})}


def profile_json(spark: SparkSession, a: argparse.Namespace, paths: Profile) -> dict:
    rows = tables.read_csv(spark, _need(Path(a.manifest or paths.manifests_dir / "sequence_manifest.csv")))
    rows = _first(rows, a.limit)
    docs = rows.select("sequence_id", "metadata_json").join(_documents(spark, paths, rows), "metadata_json", "left").withColumn("record_id", F.monotonically_increasing_id())
    parsed = metadata.parse(docs).cache()
    tags, custom, flat = metadata.tags_long(parsed), metadata.fields_long(parsed), metadata.flat(parsed)
    made = {
        "overview": metadata.document_overview(parsed), "top_level_keys": metadata.key_counts(parsed), "tag_names": metadata.count_by(tags, "tag_name"),
        "tag_subcategories": metadata.count_by(tags, "subcategory_name"), "tag_categories": metadata.count_by(tags, "category_name", "subcategory_name"),
        "custom_field_names": metadata.count_by(custom, "field_name"), "custom_field_values": metadata.count_by(custom.filter("value <> ''"), "field_name", "value", top=500),
        "profile": metadata.document_profile(flat), "flat": flat, "tags_long": tags, "custom_fields_long": custom, "errors": metadata.errors(parsed),
    }
    root = paths.outputs_dir / "json_profile"
    for name, df in made.items():
        _write(df, str(root / f"json_{name}.csv"), metadata.DOCUMENT_GROUPS if name == "profile" else ())
    shown = {k: made[k] for k in ("overview", "top_level_keys", "tag_subcategories", "custom_field_names", "profile")}
    (root / "report.md").write_text(sinks.markdown_report("JSON metadata", shown), encoding="utf-8")
    return {"out": str(root), **sinks.run_summary(parsed, {"documents": F.count("*"), "loaded": F.count_if("ok")})}


def sample_subset(spark: SparkSession, a: argparse.Namespace, paths: Profile) -> dict:
    rows = tables.read_csv(spark, _need(Path(a.manifest or paths.manifests_dir / "sequence_manifest_enriched.csv")))
    ready, unknown = sampling.build_samples(rows, a.n_front, a.n_rear, a.n_unknown, a.seed)
    for name, df in zip(SAMPLES, (ready, unknown)):
        sinks.write_csv(df, str(paths.samples_dir / f"{name}.csv"))
    return {"out": str(paths.samples_dir), "rule_ready": ready.count(), "unknown": unknown.count()}


def profile_labels(spark: SparkSession, a: argparse.Namespace, paths: Profile) -> dict:
    rows = tables.read_csv(spark, _need(Path(a.sample_csv or paths.samples_dir / f"{SAMPLES[0]}.csv")))
    rows = _first(rows, a.limit)
    named = rows.filter(~is_blank("label_v2_csv")).select(strip("label_v2_csv").alias("path")).distinct()
    profiled = labels.profile_files(tables.read_bytes(spark, str(paths.raw_data_root), named)).cache()
    sequences, errors = labels.sequence_profile(rows, profiled), labels.label_errors(rows, profiled)
    n = rows.count()
    summary = labels.label_overview(n, sequences, errors).unionByName(labels.label_summary(sequences)).unionByName(labels.file_value_counts(rows, profiled))
    made = {"summary": summary, "sequence_profile": sequences, "column_profile": labels.column_profile(rows, profiled), "long_preview": labels.long_preview(rows, profiled), "errors": errors}
    root = paths.outputs_dir / "label_profile"
    for name, df in made.items():
        _write(df, str(root / f"label_v2_{name}.csv"), labels.SUMMARY_GROUPS if name == "summary" else ())
    return {"out": str(root), "sample_rows": n, "labels_loaded": sequences.count()}


def _sample(spark: SparkSession, a: argparse.Namespace, paths: Profile) -> DataFrame:
    given = getattr(a, "sample_csv", None)
    return tables.read_csv(spark, _need(Path(given or paths.samples_dir / f"{a.sample_name}.csv")))


def contact_plan(spark: SparkSession, a: argparse.Namespace, paths: Profile) -> dict:
    """What a contact-sheet run would make; images need a decoder (see ``operators.media``)."""
    rows = _sample(spark, a, paths)
    rows = _first(rows, a.limit)
    plan = review.contact_plan(rows, list_files(spark, str(paths.raw_data_root)))
    out = paths.outputs_dir / "reviews" / a.sample_name / "contact_plan.csv"
    sinks.write_csv(plan, str(out))
    return {"out": str(out), "sequences": plan.count()}


def contact_sheets(spark: SparkSession, a: argparse.Namespace, paths: Profile) -> dict:
    """Contact sheets and middle pairs of a sample, and the summary that the review sheet reads."""
    root = paths.outputs_dir / "reviews" / a.sample_name
    plan = review.contact_plan(_first(_sample(spark, a, paths), a.limit), list_files(spark, str(paths.raw_data_root)))
    plan = review.artifact_paths(plan, str(root), a.suffix).drop("review_board_path")
    saved = media.contact_sheets(plan, str(paths.raw_data_root), _made(a.decoder), _made(a.codec)).persist()
    out = root / "contact_sheet_summary.csv"
    sinks.write_csv(review.contact_summary(plan, saved), str(out))
    return {"out": str(out), **sinks.run_summary(saved, {"sequences": F.count("*"), "pairs_saved": F.coalesce(F.sum("pair_mid_saved"), F.lit(0))})}


def review_boards(spark: SparkSession, a: argparse.Namespace, paths: Profile) -> dict:
    """Review boards of the sequences of a review sheet, and the summary that the review input reads."""
    root = paths.outputs_dir / "reviews" / a.sample_name
    rows = _first(tables.read_csv(spark, _need(root / "contact_review_sheet.csv")), a.limit)
    rows = review.artifact_paths(rows.drop("chosen_contact_path", "topview_contact_path", "pair_mid_path"), str(root), a.suffix)
    boards = media.review_boards(rows, _made(a.codec)).persist()
    out = root / "review_board_summary.csv"
    sinks.write_csv(boards, str(out))
    return {"out": str(out), **sinks.run_summary(boards, {"rows": F.count("*"), "boards_saved": F.coalesce(F.sum("review_board_saved"), F.lit(0))})}


def review_sheet(spark: SparkSession, a: argparse.Namespace, paths: Profile) -> dict:
    root = paths.outputs_dir / "reviews" / a.sample_name
    contacts = tables.read_csv(spark, _need(root / "contact_sheet_summary.csv"))
    sheet = review.review_sheet(_sample(spark, a, paths), contacts, str(root), suffix=a.suffix)
    sinks.write_csv(sheet, str(root / "contact_review_sheet.csv"))
    return {"out": str(root), "rows": sheet.count()}


def review_input(spark: SparkSession, a: argparse.Namespace, paths: Profile) -> dict:
    root = paths.outputs_dir / "reviews" / a.sample_name
    rows = review.review_input(tables.read_csv(spark, _need(root / "contact_review_sheet.csv")), tables.read_csv(spark, _need(root / "review_board_summary.csv")))
    sinks.write_csv(rows, str(root / "review_input.csv"))
    return {"out": str(root), "rows": rows.count()}


def auto_review(spark: SparkSession, a: argparse.Namespace, paths: Profile) -> dict:
    root = paths.outputs_dir / "reviews" / a.sample_name
    rows = tables.read_csv(spark, _need(Path(a.review_sheet or root / "review_input.csv")))
    out = Path(a.out or root / "auto_review.csv")
    old = tables.read_csv(spark, str(out)) if out.exists() and not a.overwrite else None
    if old is not None and "ai_status" not in old.columns:
        old = old.withColumn("ai_status", F.lit(""))
    todo = review.unreviewed(rows, old if old is not None and "sequence_id" in old.columns else rows.limit(0).withColumn("ai_status", F.lit("")), start=a.start_idx, limit=a.limit)
    journal = out.with_name(out.name + ".journal")  # holds every answer of a run that was broken off
    make = _made(a.reviewer, **({"model_id": a.model_id} if a.model_id else {}), **({"max_new_tokens": a.max_new_tokens} if a.max_new_tokens else {}))
    new = review.review(todo, make, journal=str(journal)).persist()
    n = new.count()
    if n:
        sinks.write_csv(sinks.union_fields([new] if old is None else [old, new], rows.columns), str(out))
    new.unpersist()
    shutil.rmtree(journal, ignore_errors=True)
    return {"out": str(out), "reviewed": n}


def print_paths(_: SparkSession, a: argparse.Namespace, paths: Profile) -> dict:
    return paths.described()


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="kerbline")
    parser.add_argument("--configs", default="configs/paths", help="folder of path profiles")
    commands = parser.add_subparsers(dest="command", required=True)

    def add(run, *options: tuple) -> None:
        p = commands.add_parser(run.__name__.replace("_", "-"), help=(run.__doc__ or "").splitlines()[0] if run.__doc__ else None)
        p.add_argument("--profile")
        for names, kwargs in options:
            p.add_argument(names, **kwargs)
        p.set_defaults(run=run)

    text, number = lambda n: (n, {}), lambda n, d: (n, {"type": int, "default": d})
    name = ("--sample-name", {"choices": SAMPLES, "default": SAMPLES[0]})
    add(build_manifest, text("--raw-dir"), text("--out"))
    add(enrich_manifest, text("--manifest"), text("--out"), text("--summary-out"))
    add(profile_json, text("--manifest"), number("--limit", 0))
    add(sample_subset, text("--manifest"), number("--n-front", 100), number("--n-rear", 100), number("--n-unknown", 100), number("--seed", 42))
    add(profile_labels, text("--sample-csv"), number("--limit", 0))
    add(contact_plan, text("--sample-csv"), name, number("--limit", 20))
    codec = ("--codec", {"default": "kerbline.operators.media:PngCodec", "help": "module:name of a codec"})
    suffix = ("--suffix", {"default": "png", "help": "of the image files, as the codec makes them"})
    add(contact_sheets, text("--sample-csv"), name, number("--limit", 20), ("--decoder", {"required": True, "help": "module:name of a decoder"}), codec, suffix)
    add(review_sheet, name, suffix)
    add(review_boards, name, number("--limit", 0), codec, suffix)
    add(review_input, name)
    add(auto_review, text("--review-sheet"), text("--out"), name, number("--limit", 20), number("--start-idx", 0), ("--overwrite", {"action": "store_true"}),
        ("--reviewer", {"default": "kerbline.operators.review:RuleReviewer", "help": "module:name of a reviewer, made with model_id and max_new_tokens"}), text("--model-id"), number("--max-new-tokens", 700))
    add(print_paths)
    a = parser.parse_args(argv)
    paths = load_paths(a.profile, a.configs)
    needs_spark = a.run is not print_paths
    result = a.run(spark or (local_session() if needs_spark else None), a, paths)
    for key, value in result.items():
        print(f"{key:<20}: {value}")
    return result


if __name__ == "__main__":
    main(sys.argv[1:])
