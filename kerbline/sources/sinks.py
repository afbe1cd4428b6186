"""Writers: delimited files, reports, run summaries."""

from __future__ import annotations

import csv
import io
import shutil
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, header_always: bool = False) -> None:
    """One CSV file with header, rows in the order of ``df``. An empty table gives an empty file, or its header alone.

    Spark writes the parts next to the target; only their bytes are joined here, and the file appears when it is complete.
    """
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    parts = target.with_name(f".{target.name}.parts-{uuid.uuid4().hex}")
    flags = {n for n, t in df.dtypes if t == "boolean"}
    text = [F.coalesce(F.initcap(F.col(f"`{c}`").cast("string")) if c in flags else F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]
    options = {"emptyValue": "", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    try:
        df.select(*text).write.options(**options).csv(str(parts))
        files = [f for f in sorted(parts.glob("part-*.csv")) if f.stat().st_size]
        draft = parts / "whole"
        with draft.open("wb") as out:
            if files or header_always:
                names = io.StringIO()
                csv.writer(names, lineterminator="\n").writerow(df.columns)
                out.write(names.getvalue().encode())
            for f in files:
                with f.open("rb") as part:
                    shutil.copyfileobj(part, out)
        draft.replace(target)
    finally:
        shutil.rmtree(parts, ignore_errors=True)


def union_fields(frames: Sequence[DataFrame], preferred: Sequence[str]) -> DataFrame:
    """All rows of ``frames`` under the union of their columns: preferred ones first, then as first seen; gaps are blank."""
    seen: dict[str, None] = {}
    for df in frames:
        seen |= dict.fromkeys(df.columns)
    columns = [c for c in preferred if c in seen] + [c for c in seen if c not in preferred]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def markdown_report(title: str, sections: dict[str, DataFrame], rows: int = 50) -> str:
    """A report of the first ``rows`` rows of small tables."""
    out = [f"# {title}", ""]
    for name, df in sections.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        for row in df.limit(rows).collect():
            out.append("| " + " | ".join(str("" if v is None else v).replace("|", "\\|").replace("\n", " ") for v in row) + " |")
        out.append("")
    return "\n".join(out)


def run_summary(df: DataFrame, metrics: dict[str, Column]) -> dict[str, int]:
    """Counters of a stage, by one aggregation."""
    row = df.agg(*[m.alias(name) for name, m in metrics.items()]).first()
    return {name: row[name] for name in metrics}
