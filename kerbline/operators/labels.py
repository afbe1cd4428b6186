"""Profiles of label files.

Two entrances: ``profile_lines`` works on a table of raw lines and stays inside the JVM, whatever a file's size;
``profile_files`` works on whole files (path and bytes) in Arrow batches and keeps the inference of a data frame reader.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbline.functions.documents import primary_object
from kerbline.functions.text import is_blank, strip
from kerbline.operators.profile import Group, counter_profile
from kerbline.operators.rejects import judge_lines
from kerbline.session import ship_package

# fixed values: the names under which each role is looked for, best first
CANDIDATES: dict[str, tuple[str, ...]] = {
    "class_col": ("class", "class_id"),
    "object_col": ("which object", "object", "label_object"),
    "distance_col": ("important distance [mm]", "important distance", "distance"),
    "xmin_col": ("xmin", "x_min", "bbox_xmin"),
    "ymin_col": ("ymin", "y_min", "bbox_ymin"),
    "xmax_col": ("xmax", "x_max", "bbox_xmax"),
    "ymax_col": ("ymax", "y_max", "bbox_ymax"),
    "polygon_x_col": ("polygonx", "polygon_x", "poly_x"),
    "polygon_y_col": ("polygony", "polygon_y", "poly_y"),
}
PREVIEW_ROWS, SAMPLE_VALUES = 20, 5
BLOCKS_AT_ONCE = 4096


def _equals(key: str):
    return lambda x: x["low"] == key


def find_column(columns: Column | str, candidates: Sequence[str]) -> Column:
    """The column that plays a role, out of an array of names: the first candidate that equals a name (blanks and case
    aside; of equal names the last), else the first name that contains a candidate, else the empty string."""
    columns = F.col(columns) if isinstance(columns, str) else columns
    named = F.transform(columns, lambda c: F.struct(F.lower(strip(c)).alias("low"), c.alias("name")))
    exact = [F.try_element_at(F.filter(named, _equals(k)), F.lit(-1))["name"] for k in map(str.lower, candidates)]
    inside = F.get(F.filter(named, lambda x: F.array_max(F.array(*[F.contains(x["low"], F.lit(k.lower())) for k in candidates]))), F.lit(0))["name"]
    return F.coalesce(*exact, inside, F.lit(""))


def role_columns(columns: Column | str) -> dict[str, Column]:
    return {role: find_column(columns, names) for role, names in CANDIDATES.items()}


def nonempty_count(column: Column | str) -> Column:
    """Aggregate: values that are neither null nor blank."""
    return F.count_if(~is_blank(column))


def loaded_lines(lines: DataFrame, **columns: str) -> DataFrame:
    """Loadable lines, a redelivered line (same file and line number) once, with names, fields and block.

    Lines without a line number are all kept; nothing tells a redelivered one of them."""
    judged = judge_lines(lines, **columns)
    ok = judged.select("id", "file", "block", "line_no", "names", "fields", F.explode(F.when(F.size("errors") == 0, F.array(F.lit(1)))).alias("_")).drop("_")
    first = Window.partitionBy("file", "block", "line_no", F.when(F.col("line_no").isNull(), F.col("id"))).orderBy("id")
    return ok.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def profile_lines(lines: DataFrame, **columns: str) -> DataFrame:
    """(file, column_name, nonempty_count, sample_values) per column: the first five values in line order,
    those of lines without a number last and by value.

    Missing marks (empty, NA, None) are no values. Lines are aggregated by (file, block), as they are partitioned already, then
    ``BLOCKS_AT_ONCE`` blocks at a time, then by file: every state is bounded and only one row a block is moved.
    """
    ok = loaded_lines(lines, **columns)
    each = ok.select("file", "block", "line_no", F.explode(F.arrays_zip(F.col("names").alias("n"), F.col("fields").alias("v"))).alias("z"))
    value = F.when(~F.col("z.v").isin("NA", "None"), strip("z.v"))
    rows = each.select("file", "block", F.col("z.n").alias("column_name"), "line_no", F.when(value != "", value).alias("v"))
    entry = F.when(F.col("v").isNotNull(), F.struct(F.col("line_no").isNull().alias("unnumbered"), "line_no", "v"))
    first = lambda values: F.slice(F.array_sort(values), 1, SAMPLE_VALUES)
    pack = F.collect_list(F.struct("column_name", "n", "s")).alias("c")
    blocks = rows.groupBy("file", "block", "column_name").agg(F.count("v").alias("n"), first(F.collect_list(entry)).alias("s"))
    packed = blocks.groupBy("file", "block").agg(pack).withColumn("block", F.floor(F.col("block") / BLOCKS_AT_ONCE))

    def merged(df: DataFrame, *keys: str) -> DataFrame:
        """Packed rows of equal keys as one row a column; one shuffle."""
        each = df.repartition(*[F.col(k) for k in keys]).select(*keys, F.explode("c").alias("c")).select(*keys, "c.*")
        return each.groupBy(*keys, "column_name").agg(F.sum("n").alias("n"), first(F.flatten(F.collect_list("s"))).alias("s"))

    packed = merged(packed, "file", "block").groupBy("file", "block").agg(pack)
    return merged(packed, "file").select("file", "column_name", F.col("n").alias("nonempty_count"), F.array_join(F.col("s.v"), "|").alias("sample_values"))


def rows_per_file(lines: DataFrame, **columns: str) -> DataFrame:
    """(num_label_rows, files): how many files have how many loadable rows."""
    sizes = loaded_lines(lines, **columns).groupBy("file").agg(F.count("*").alias("num_label_rows"))
    return sizes.groupBy("num_label_rows").agg(F.count("*").alias("files"))


def preview_lines(lines: DataFrame, k: int = PREVIEW_ROWS, **columns: str) -> DataFrame:
    """The first ``k`` loadable rows of each file with the values of their roles; lines without a number come last, by id."""
    order = Window.partitionBy("file").orderBy(F.asc_nulls_last("line_no"), "id")
    # ranked and cut before the shuffle, so a file that holds most rows does not reach one task
    rows = loaded_lines(lines, **columns).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).withColumn("label_row_idx", F.col("_rank") - 1)
    at = lambda role: F.coalesce(F.try_element_at(F.map_from_arrays(F.array_distinct("names"), F.slice("fields", 1, F.size(F.array_distinct("names")))), find_column("names", CANDIDATES[role])), F.lit(""))
    picks = {"class_value": "class_col", "object_value": "object_col", "distance_value": "distance_col"} | {r[:-4]: r for r in list(CANDIDATES)[3:]}
    unique = F.size(F.array_distinct("names")) == F.size("names")
    return rows.select("file", "label_row_idx", *[F.when(unique, strip(at(role))).otherwise("").alias(name) for name, role in picks.items()])


def value_counts(lines: DataFrame, top_objects: int = 100, top_classes: int = 50, **columns: str) -> DataFrame:
    """(group, value, count): the most frequent object and class values of all loadable rows."""
    rows = loaded_lines(lines, **columns).withColumns({"o": find_column("names", CANDIDATES["object_col"]), "c": find_column("names", CANDIDATES["class_col"])})

    def value(name: str) -> Column:
        at = F.array_position("names", F.col(name)).cast("int")
        v = strip(F.try_element_at(F.col("fields"), F.when(at > 0, at)))
        return F.when((v == "") | v.isin("NA", "None"), None).otherwise(v)

    held = rows.select(value("o").alias("o"), value("c").alias("c"))
    kept = lambda c: F.array_compact(F.array(c))
    return counter_profile(held, [Group("label_object_values", kept("o"), many=True, top=top_objects), Group("class_values", kept("c"), many=True, top=top_classes)])


#: Ways to read a label file, tried in order; the first that gives more than one column counts.
ATTEMPTS = (("utf-8-sig", ","), ("utf-8", ","), ("utf-8-sig", ";"), ("utf-8", ";"), ("latin1", ","), ("latin1", ";"))

FILE_SCHEMA = (
    "path string, error string, num_label_rows long, columns array<string>, nonempty array<long>, samples array<string>, "
    "preview array<map<string,string>>, counts array<struct<column:string,value:string,n:long>>"
)
#: Groups of a label summary, in the order of its report.
SUMMARY_GROUPS = ("overview", "columns", "label_object_values", "class_values", "target_object_from_json", "rows_per_label_file")
#: Roles whose values are counted.
COUNTED = ("object_col", "class_col")


def read_label_bytes(content: bytes) -> pd.DataFrame:
    """A label file as a data frame with inferred types; raises if no attempt gives several columns."""
    last: Exception | None = None
    for encoding, separator in ATTEMPTS:
        try:
            found = pd.read_csv(io.BytesIO(content), encoding=encoding, sep=separator)
        except Exception as e:  # noqa: BLE001
            last = e
            continue
        if found.shape[1] > 1:
            return found
    raise RuntimeError(f"no attempt gave more than one column; last error: {last}")


def profile_files(files: DataFrame) -> DataFrame:
    """Profile of each file of (path, content): its columns, counts, sample values, first rows and the values of columns that
    may play a counted role, or its error."""
    ship_package(files.sparkSession)
    counted = [name for role in COUNTED for name in CANDIDATES[role]]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    if content is None:
                        raise FileNotFoundError("label_v2_csv_not_found")
                    df = read_label_bytes(bytes(content))
                except Exception as e:  # noqa: BLE001
                    out.append((path, str(e) if isinstance(e, FileNotFoundError) else f"{type(e).__name__}: {e}", 0, [], [], [], [], []))
                    continue
                texts = {c: df[c].dropna().astype(str).str.strip() for c in df.columns}
                values = {c: t[t != ""] for c, t in texts.items()}
                preview = [{str(c): str(v).strip() for c, v in row.items()} for _, row in df.head(PREVIEW_ROWS).iterrows()]
                counts = [{"column": str(c), "value": v, "n": int(n)} for c in df.columns if any(k in str(c).lower() for k in counted) for v, n in values[c].value_counts().items()]
                out.append((path, None, len(df), list(map(str, df.columns)), [len(v) for v in values.values()], ["|".join(v.head(SAMPLE_VALUES)) for v in values.values()], preview, counts))
            yield pd.DataFrame(out, columns=["path", "error", "num_label_rows", "columns", "nonempty", "samples", "preview", "counts"])

    return files.select("path", "content").mapInPandas(scan, FILE_SCHEMA)


def sequence_profile(sample: DataFrame, profiled: DataFrame) -> DataFrame:
    """The 23 columns of a sequence profile, of a sample joined with its profiled files."""
    p = profiled.filter(F.col("error").isNull()).withColumnRenamed("path", "label_v2_csv")
    rows = sample.select("sequence_id", "preferred_camera_rule", "driving_direction", primary_object("label_objects_json").alias("target_object"), "label_objects_json", "label_v2_csv").join(p, "label_v2_csv")
    roles = role_columns("columns")
    rows = rows.withColumns(roles)
    count = lambda role: F.coalesce(F.try_element_at(F.map_from_arrays("columns", "nonempty"), F.col(role)), F.lit(0))
    has = lambda *names: sum(((F.col(n) != "").cast("int") for n in names), F.lit(0)) == len(names)
    return rows.select(
        "sequence_id", "preferred_camera_rule", "driving_direction", "target_object", "label_objects_json", "label_v2_csv", "num_label_rows",
        F.size("columns").alias("num_columns"), *roles,
        has("xmin_col", "ymin_col", "xmax_col", "ymax_col").cast("int").alias("bbox_available"),
        has("polygon_x_col", "polygon_y_col").cast("int").alias("polygon_available"),
        count("object_col").alias("object_nonempty_rows"), count("class_col").alias("class_nonempty_rows"), count("distance_col").alias("distance_nonempty_rows"),
        F.array_join("columns", "|").alias("columns"),
    )


def column_profile(sample: DataFrame, profiled: DataFrame) -> DataFrame:
    """(sequence_id, label_v2_csv, column, nonempty_count, sample_values)."""
    p = profiled.filter(F.col("error").isNull()).select(F.col("path").alias("label_v2_csv"), F.explode(F.arrays_zip("columns", "nonempty", "samples")).alias("z"))
    return sample.select("sequence_id", "label_v2_csv").join(p, "label_v2_csv").select("sequence_id", "label_v2_csv", F.col("z.columns").alias("column"), F.col("z.nonempty").alias("nonempty_count"), F.col("z.samples").alias("sample_values"))


def label_errors(sample: DataFrame, profiled: DataFrame) -> DataFrame:
    """(sequence_id, label_v2_csv, error) of sample rows without path, without file, or with an unreadable file."""
    p = profiled.select(F.col("path").alias("label_v2_csv"), "error", F.lit(True).alias("there"))
    why = F.when(is_blank("label_v2_csv"), "missing_label_v2_csv_path").when(F.col("there").isNull(), "label_v2_csv_not_found").otherwise(F.col("error"))
    return sample.select("sequence_id", "label_v2_csv").join(p, "label_v2_csv", "left").select("sequence_id", "label_v2_csv", why.alias("error")).filter(F.col("error").isNotNull())


def long_preview(sample: DataFrame, profiled: DataFrame) -> DataFrame:
    """The first rows of each sample row's file: sequence_id, label_row_idx, target_object and the value of each role, blank
    where no column plays it (a missing value reads ``nan``)."""
    p = profiled.filter(F.col("error").isNull()).select(F.col("path").alias("label_v2_csv"), "columns", F.posexplode("preview").alias("label_row_idx", "row"))
    rows = sample.select("sequence_id", "label_v2_csv", primary_object("label_objects_json").alias("target_object")).join(p, "label_v2_csv").withColumns(role_columns("columns"))
    value = lambda role: F.coalesce(F.try_element_at("row", F.col(role)), F.lit(""))
    named = {"class_value": "class_col", "object_value": "object_col", "distance_value": "distance_col"} | {r[:-4]: r for r in list(CANDIDATES)[3:]}
    return rows.select("sequence_id", "label_row_idx", "target_object", *[value(role).alias(name) for name, role in named.items()])


def file_value_counts(sample: DataFrame, profiled: DataFrame, top_objects: int = 100, top_classes: int = 50) -> DataFrame:
    """(group, value, count): the most frequent object and class values over the files of all sample rows."""
    p = profiled.filter(F.col("error").isNull()).select(F.col("path").alias("label_v2_csv"), "columns", "counts")
    rows = sample.select("label_v2_csv").join(p, "label_v2_csv").withColumns({r: find_column("columns", CANDIDATES[r]) for r in COUNTED})
    out = None
    for group, role, top in (("label_object_values", "object_col", top_objects), ("class_values", "class_col", top_classes)):
        own = rows.select(role, F.explode("counts").alias("c")).filter(F.col("c.column") == F.col(role)).groupBy(F.col("c.value").alias("value")).agg(F.sum("c.n").alias("count"))
        own = own.orderBy(F.desc("count"), "value").limit(top).select(F.lit(group).alias("group"), "value", "count")
        out = own if out is None else out.unionByName(own)
    return out


def label_overview(sample_rows: int, sequences: DataFrame, errors: DataFrame) -> DataFrame:
    """(group, value, count): sample rows, loaded label files and errors."""
    counts = {"sample_rows": sample_rows, "labels_loaded": sequences.count(), "label_errors": errors.count()}
    return sequences.sparkSession.createDataFrame([("overview", k, n) for k, n in counts.items()], "group string, value string, count long")


def label_summary(profiles: DataFrame) -> DataFrame:
    """(group, value, count) over sequence profiles: columns, target objects and rows per file."""
    groups = [
        Group("columns", F.split("columns", r"\|"), many=True),
        Group("target_object_from_json", "target_object", top=100),
        Group("rows_per_label_file", F.col("num_label_rows").cast("string"), top=50),
    ]
    return counter_profile(profiles, groups)
