"""From samples to reviewed candidates: review sheets, resumable review, scoring.

A reviewer is anything with ``review(prompt, board_path) -> str``; one is made per task by a factory, so a model client is
opened where it runs. The deterministic ``RuleReviewer`` stands in where no model is at hand.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions.documents import allow_repeated_keys, resolved_camera
from kerbline.functions.review import QUALITIES, RATIO_BOUNDS, SCORES, answer_steps, prompt
from kerbline.functions.text import or_blank, strip
from kerbline.session import ship_package

HUMAN_COLUMNS = ("best_ratio", "object_visible_score_0_3", "scene_clarity_score_0_3", "topview_useful_score_0_3", "keep_for_next_stage", "candidate_quality", "notes")
AI_COLUMNS = (
    "ai_best_ratio ai_model_best_ratio_raw ai_object_visible_score_0_3 ai_scene_clarity_score_0_3 ai_topview_useful_score_0_3 ai_keep_for_next_stage "
    "ai_candidate_quality ai_confidence ai_ratio_scores_json ai_reason ai_raw_text ai_status"
).split()


def lookup(left: DataFrame, right: DataFrame, on: str, columns: Sequence[str], order: str) -> DataFrame:
    """``left`` with columns of the last right row (by ``order``) of its key; blank where there is none.

    The right side is reduced to one row per key by an aggregation, which combines map-side; adaptive execution
    chooses the join.
    """
    picked = F.max_by(F.struct(*columns), order).alias("r")
    last = right.filter(F.col(on).isNotNull()).groupBy(on).agg(picked).select(on, *[F.col(f"r.{c}").alias(c) for c in columns])
    rows = left.drop(*[c for c in columns if c in left.columns]).join(last, on, "left")
    return rows.withColumns({c: or_blank(F.col(c).cast("string")) for c in columns})


def unreviewed(rows: DataFrame, done: DataFrame, *, start: int = 0, limit: int = 0, order: str = "sequence_id", retry_errors: bool = False) -> DataFrame:
    """The slice ``start``, ``limit`` (0: all) of ``rows``, without those that have a review already.

    A review with any status counts, also an error unless ``retry_errors``; blank ids are never skipped. The slice
    is taken before the skipping, so a restarted chunk stays the same chunk.
    """
    if start or limit:
        rows = rows.orderBy(order)
        rows = rows.offset(start) if start else rows
        rows = rows.limit(limit) if limit else rows
    status = strip(or_blank("ai_status"))
    finished = done.filter((strip(or_blank("sequence_id")) != "") & (status == "ok" if retry_errors else status != ""))
    ids = finished.select(strip("sequence_id").alias("_id")).distinct()
    return rows.join(ids, strip(or_blank(rows["sequence_id"])) == ids["_id"], "left_anti")


def artifact_paths(rows: DataFrame, root: str, suffix: str = "jpg") -> DataFrame:
    """``rows`` with the paths of each sequence's contact sheets, middle pair and review board."""
    camera = resolved_camera("preferred_camera_rule")
    at = lambda *parts: F.concat_ws("/", F.lit(root), F.col("sequence_id"), F.concat(*parts))
    return rows.withColumns(
        {
            "chosen_contact_path": at(camera, F.lit(f"_contact.{suffix}")),
            "topview_contact_path": at(F.lit(f"topview_contact.{suffix}")),
            "pair_mid_path": at(F.lit("pair_"), camera, F.lit(f"_mid.{suffix}")),
            "review_board_path": at(F.lit(f"ratio_review_board.{suffix}")),
        }
    )


def contact_plan(sample: DataFrame, inventory: DataFrame) -> DataFrame:
    """Which videos a contact sheet uses and whether they exist; ``inventory`` has one row per existing ``path``."""
    camera = resolved_camera("preferred_camera_rule")
    chosen = strip(or_blank(F.when(camera == "rear", F.col("rear_video")).otherwise(F.col("front_video"))))
    rows = sample.select("sequence_id", camera.alias("preferred_camera_rule"), *[or_blank(c).alias(c) for c in ("driving_direction", "approach", "primary_label_object", "weather_tags")], chosen.alias("chosen_video"), strip(or_blank("topview_video")).alias("topview_video"))
    there = inventory.select("path").distinct()
    for video in ("chosen_video", "topview_video"):
        found = there.withColumnRenamed("path", video).withColumn(f"{video}_exists", F.lit(1))
        rows = rows.join(found, video, "left").withColumn(f"{video}_exists", F.coalesce(f"{video}_exists", F.lit(0)))
    label = F.format_string("%s | cam=%s | dir=%s | approach=%s | obj=%s", "sequence_id", "preferred_camera_rule", "driving_direction", "approach", "primary_label_object")
    return rows.withColumns({"pair_possible": F.col("chosen_video_exists") * F.col("topview_video_exists"), "label_text": label})


def contact_summary(plan: DataFrame, saved: DataFrame) -> DataFrame:
    """The 12 columns of a contact-sheet summary: the plan with what was saved; the camera is the resolved one."""
    flags = ["chosen_contact_saved", "topview_contact_saved", "pair_mid_saved"]
    rows = plan.drop(*flags).join(saved.select("sequence_id", *flags), "sequence_id", "left").fillna(0, flags)
    own = "sequence_id preferred_camera_rule driving_direction approach primary_label_object weather_tags chosen_video_exists topview_video_exists".split()
    return rows.select(*own, *flags, F.when(F.col("pair_mid_saved") == 1, F.col("pair_mid_path")).otherwise("").alias("pair_mid_path"))


def review_sheet(sample: DataFrame, contacts: DataFrame, root: str, order: str = "sequence_id", suffix: str = "jpg") -> DataFrame:
    """The 24 columns of a review sheet: sample, saved flags of its contact sheets, paths, blanks to fill in."""
    rows = lookup(sample, contacts, "sequence_id", ["chosen_contact_saved", "topview_contact_saved", "pair_mid_saved"], order)
    rows = artifact_paths(rows, root, suffix)
    own = "sequence_id preferred_camera_rule preferred_camera_rule_reason driving_direction approach weather_tags primary_label_object scene_tags metadata_json label_objects_json target_object".split()
    made = "chosen_contact_saved topview_contact_saved pair_mid_saved chosen_contact_path topview_contact_path pair_mid_path".split()
    return rows.select(*[or_blank(F.col(c).cast("string")).alias(c) for c in own], *made, *[F.lit("").alias(c) for c in HUMAN_COLUMNS])


def review_input(sheet: DataFrame, boards: DataFrame, order: str = "sequence_id") -> DataFrame:
    """The review sheet with the path and saved flag of each sequence's board."""
    return lookup(sheet, boards, "sequence_id", ["review_board_path", "review_board_saved"], order)


class Reviewer(Protocol):
    def review(self, prompt: str, board_path: str) -> str: ...


class RuleReviewer:
    """Answers from a hash of the board's path: always the same, for tests and dry runs."""

    def __init__(self, model_id: str = "rule", max_new_tokens: int = 0) -> None:
        self.model_id, self.max_new_tokens = model_id, max_new_tokens

    def review(self, prompt: str, board_path: str) -> str:
        import hashlib

        seed = hashlib.sha256(board_path.encode()).digest()
        names = list(QUALITIES)
        scores = [{"ratio": r, **{s: seed[3 * i + j] % 4 for j, s in enumerate(SCORES)}, "candidate_quality": names[seed[i] % 4], "reason": ""} for i, r in enumerate(RATIO_BOUNDS)][:5]
        return json.dumps({"ratio_scores": scores, "model_best_ratio": "0.60", "confidence": "low", "overall_reason": "rule"})


def board_problem(row: dict, board_exists: Callable[[str], bool] | None) -> str | None:
    """Why a row cannot be reviewed, or None."""
    board = str(row.get("review_board_path") or "").strip()
    if not board:
        return "FileNotFoundError: no review board path"
    if board_exists is not None and not board_exists(board):
        return f"FileNotFoundError: missing review board: {board}"
    saved = row.get("review_board_saved")
    if not pd.isna(saved) and str(saved).strip() not in ("", "1", "1.0", "True", "true"):
        return f"RuntimeError: review board is not saved for sequence {row.get('sequence_id') or ''}"
    return None


def ask(
    rows: DataFrame, make_reviewer: Callable[[], Reviewer] = RuleReviewer, board_exists: Callable[[str], bool] | None = None, journal: str | None = None
) -> DataFrame:
    """``rows`` with ``answer`` and ``problem`` (null if there is none). A row that fails does not stop the others.

    ``journal``: a folder that all machines share. Every answer is appended there as soon as it is there, so that a run
    that is broken off loses at most the row in work (see ``read_journal``).
    """
    ship_package(rows.sparkSession)
    kept = [c for c in rows.columns if c not in (*AI_COLUMNS, "answer", "problem", "prompt")]
    asked = rows.select(*kept).withColumn("prompt", prompt(kept))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reviewer = make_reviewer()
        with contextlib.ExitStack() as stack:
            log = None
            if journal is not None:
                os.makedirs(journal, exist_ok=True)
                log = stack.enter_context(open(os.path.join(journal, f"{uuid.uuid4().hex}.jsonl"), "w", encoding="utf-8"))
            for batch in batches:
                answers, problems = [], []
                for row in batch.to_dict("records"):
                    answer, problem = None, board_problem(row, board_exists)
                    if problem is None:
                        try:
                            answer = reviewer.review(row["prompt"], str(row["review_board_path"]).strip())
                        except Exception as e:  # noqa: BLE001
                            problem = f"{type(e).__name__}: {e}"
                    if log and answer is not None:
                        log.write(json.dumps({"sequence_id": row.get("sequence_id"), "answer": answer}) + "\n")
                        log.flush()
                        os.fsync(log.fileno())
                    answers.append(answer)
                    problems.append(problem)
                yield batch[kept].assign(answer=pd.Series(answers, dtype=object, index=batch.index), problem=pd.Series(problems, dtype=object, index=batch.index))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema) + ", answer string, problem string"
    return asked.mapInPandas(run, schema)


def read_journal(spark: SparkSession, journal: str) -> DataFrame:
    """(sequence_id, answer) of the answers that earlier runs left in a journal, one row per sequence."""
    lines = spark.read.schema("sequence_id string, answer string").json(journal)
    return lines.filter("answer is not null").groupBy("sequence_id").agg(F.min("answer").alias("answer"))


def scored(answered: DataFrame) -> DataFrame:
    """Rows with ``answer`` and ``problem`` to the ``ai_`` columns."""
    allow_repeated_keys(answered.sparkSession)
    rows = answered
    for step in answer_steps("answer"):
        rows = rows.withColumns(step)
    failed = F.col("problem").isNotNull()
    out = {c: F.when(~failed, F.col(c)).otherwise(F.concat(F.lit("error: "), "problem") if c == "ai_status" else "") for c in AI_COLUMNS}
    return rows.select(*[c for c in answered.columns if c not in ("answer", "problem", *AI_COLUMNS)], *[out[c].alias(c) for c in AI_COLUMNS])


def review(rows: DataFrame, make_reviewer: Callable[[], Reviewer] = RuleReviewer, board_exists: Callable[[str], bool] | None = None, journal: str | None = None) -> DataFrame:
    """``rows`` with the ``ai_`` columns. A row that fails gets blanks and a status that names the error; others go on.

    ``board_exists`` checks a board's path on the executor (default: any path that is not blank). Answers are read and scored by
    built-in expressions; only the reviewer itself runs in Python. Answers of an earlier run's ``journal`` are not asked for again.
    """
    if journal is None or not os.path.isdir(journal):
        return scored(ask(rows, make_reviewer, board_exists, journal))
    known = read_journal(rows.sparkSession, journal)
    old = rows.join(known, "sequence_id").withColumn("problem", F.lit(None).cast("string"))
    new = ask(rows.join(known.select("sequence_id"), "sequence_id", "left_anti"), make_reviewer, board_exists, journal)
    return scored(old.select(*new.columns).unionByName(new))
