"""Problem 1: rows that fail to parse, separated with a reason while the valid ones are loaded.

Every record is read as nullable text, split by the separator of its file's header, and judged by constraint rules (the
form of a value) and casts (the very ones that load it) that are evaluated column-wise into one error array per
row. Rows whose array is empty are loaded with types; the others keep their text and get the array, so no value is lost.

Scale: a file's header has to meet each of its lines. One file may hold a third of all rows, so lines are
joined on (file, block of line numbers), not on the file alone; the header side is repeated once per block that
occurs. Nothing is broadcast or collected, and everything runs inside the JVM.

Defined results: a line without a header line in its file gets ``missing_header``; a null text is an empty
record; a number that its type cannot hold (a whole one of more than 38 digits, one beyond the doubles) is an invalid value;
a null or repeated line number is allowed; of several header lines of one file the one with the smallest
id counts; an empty input gives empty outputs; other input columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.text import strip

LINES_PER_BLOCK = 4096
UNNUMBERED_BLOCKS = 1024
MISSING = ("", "NA", "None")
SEPARATORS = (",", ";", "\t")

BOX_NAME = r"^(?:bbox_)?[xy]_?(?:min|max)$"
POLYGON_NAME = r"^poly(?:gon)?_?[xy]$"
# fixed values: names under which label files carry the distance, the class and the object
DISTANCE_NAMES = ("distance_mm", "distance", "important distance", "important distance [mm]", "gap [mm]", "clearance")
CLASS_NAMES = ("class", "label class", "class_id", "category code", "kind")
OBJECT_NAMES = ("which object", "label_object", "object")
FRAME_NAME = "frame_idx"
#: Texts up to this length are within the range of doubles.
SAFE_LENGTH = 300


def _field(sep: str) -> str:
    # possessive quantifiers: matched in a loop, so long records need no deep stack
    return rf'(?:"[^"]*+(?:""[^"]*+)*+"|[^"{sep}]*+)'


def _well_quoted(text: Column, sep: str) -> Column:
    f = _field(sep)
    return text.rlike(rf"\A{f}(?:{sep}{f})*+\z")


def _by_sep(sep: Column, of) -> Column:
    """``of(separator)`` for each separator, as one CASE: each branch keeps its own compiled pattern."""
    out = F
    for s in SEPARATORS:
        out = out.when(sep == s, of(s))
    return out


def _quoted_fields(text: Column, sep: str) -> Column:
    # a leading separator makes every match non-empty, so that no empty field is skipped
    raw = F.regexp_extract_all(F.concat(F.lit(sep), text), F.lit(rf"{sep}({_field(sep)})"), F.lit(1))
    return F.transform(
        raw, lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    )


def _fields(text: Column, sep: Column) -> Column:
    """Field texts of a record, or null where its quoting is broken."""
    plain = F.split(text, sep, -1)
    return F.when(~F.contains(text, F.lit('"')), plain).otherwise(
        _by_sep(sep, lambda s: F.when(_well_quoted(text, s), _quoted_fields(text, s)))
    )


def as_point(text: Column, sep: Column) -> Column:
    """A number's text with a point as decimal mark; files parted by semicolons have a comma."""
    return F.when(sep == ";", F.replace(text, F.lit(","), F.lit("."))).otherwise(text)


def as_frame(text: Column) -> Column:
    return text.try_cast("decimal(38,0)")


def _positions(names: Column, test) -> Column:
    """1-based positions of the names for which ``test`` holds."""
    hits = F.transform(names, lambda x, i: F.when(test(x), i + 1))
    return F.filter(hits, lambda x: x.isNotNull())


def read_headers(headers: DataFrame) -> DataFrame:
    """(file, text) of header lines to the separator, the normalised field names and the positions of roles."""
    text = F.regexp_replace("text", "\\A\ufeff", "")
    bare = F.regexp_replace(text, '"[^"]*"', "")
    n = {s: F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit(""))) for s in SEPARATORS}
    top = F.greatest(*n.values())
    sep = F.when(n[","] == top, ",").when(n[";"] == top, ";").otherwise("\t")
    out = headers.select("file", text.alias("text")).select("file", "text", sep.alias("sep"))
    names = F.transform(F.coalesce(_fields(F.col("text"), F.col("sep")), F.split("text", F.col("sep"), -1)), lambda x: F.lower(strip(x)))
    out = out.select("file", "sep", names.alias("names"))
    return out.select(
        "file",
        "sep",
        "names",
        F.size("names").alias("width"),
        _positions(F.col("names"), lambda x: x == FRAME_NAME).alias("frame_at"),
        _positions(F.col("names"), lambda x: x.rlike(BOX_NAME)).alias("box_at"),
        _positions(F.col("names"), lambda x: x.rlike(POLYGON_NAME)).alias("polygon_at"),
        _positions(F.col("names"), lambda x: x.isin(*DISTANCE_NAMES)).alias("distance_at"),
    )


def judge_lines(
    lines: DataFrame, *, id_col: str = "record_id", file_col: str = "file_path", line_col: str = "line_no", text_col: str = "label_v2_csv"
) -> DataFrame:
    """Each data line with its header, its fields, its error array and the names of its bad fields.

    Columns: id, file, line_no, text, sep, names, fields, errors (array of reasons in order of precedence, empty
    for a loadable line), bad_fields, block.
    """
    rows = lines.select(
        F.col(id_col).alias("id"), F.col(file_col).alias("file"), F.col(line_col).alias("line_no"), F.col(text_col).alias("text")
    )
    is_header = F.col("line_no").eqNullSafe(0)
    # lines without a number are spread over blocks of their own
    unnumbered = -1 - F.pmod(F.xxhash64("id", "text"), F.lit(UNNUMBERED_BLOCKS))
    block = F.coalesce(F.floor(F.greatest(F.col("line_no"), F.lit(0)) / LINES_PER_BLOCK), unnumbered)
    data = rows.filter(~is_header).select("id", "file", "line_no", F.coalesce("text", F.lit("")).alias("text"), block.alias("block"))
    headers = read_headers(rows.filter(is_header & F.col("text").isNotNull() & F.col("file").isNotNull()).groupBy("file").agg(F.min_by("text", "id").alias("text")))
    blocks = data.filter(F.col("file").isNotNull()).select("file", "block").distinct()
    dim = blocks.join(headers, "file")
    joined = data.join(dim.hint("shuffle_hash"), ["file", "block"], "left")

    judged = joined.withColumn("fields", _fields(F.col("text"), F.col("sep")))
    comma = F.col("sep") == ";"

    def bad(positions: str, point: str, decimal_comma: str) -> Column:
        def wrong(i: Column) -> Column:
            v = F.try_element_at(F.col("fields"), i)
            numbers = F.split(F.regexp_replace(as_point(v, F.col("sep")), " *(mm|cm|m)$", ""), " ")
            too_large = (F.length(v) > SAFE_LENGTH) & F.exists(numbers, lambda x: F.coalesce(x.try_cast("double") == float("inf"), F.lit(True)))
            return ~F.when(comma, v.rlike(decimal_comma)).otherwise(v.rlike(point)) | too_large

        return F.filter(positions, wrong)

    def pattern(mark: str, form: str) -> str:
        number = rf"\d+(?:{mark}\d+)?"
        return rf"\A(?:{'|'.join(MISSING)}|{form.format(n=number)})\z"

    def both(form: str) -> tuple[str, str]:
        return pattern(r"\.", form), pattern(",", form)

    bad_at = F.concat(
        F.filter("frame_at", lambda i: ~F.try_element_at(F.col("fields"), i).rlike(r"\A\d+\z") | as_frame(F.try_element_at(F.col("fields"), i)).isNull()),
        bad("box_at", *both("{n}")),
        bad("polygon_at", *both("{n}(?: {n})*+")),
        bad("distance_at", *both("{n} *(?:mm|cm|m)?")),
    )
    judged = judged.withColumn("bad_at", F.when(F.size("fields") == F.col("width"), bad_at))
    errors = F.array_compact(
        F.array(
            F.when(F.col("sep").isNull(), "missing_header"),
            F.when(F.col("sep").isNotNull() & F.col("fields").isNull(), "broken_quoting"),
            F.when(F.size("fields") != F.col("width"), "column_count"),
            F.when(F.size("bad_at") > 0, "invalid_value"),
        )
    )
    return judged.select(
        "id",
        "file",
        "line_no",
        "text",
        "sep",
        "names",
        "fields",
        errors.alias("errors"),
        F.transform("bad_at", lambda i: F.try_element_at(F.col("names"), i)).alias("bad_fields"),
        "block",  # rows are partitioned by (file, block): later steps that include both need no new shuffle
    )


def _where(df: DataFrame, condition: Column) -> DataFrame:
    """A filter that the optimizer does not push down: pushed, it would repeat the whole parse in its condition."""
    return df.select("*", F.explode(F.when(condition, F.array(F.lit(True)))).alias("_kept")).drop("_kept")


def split_lines(lines: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(typed label rows, rejected rows) of a table of raw label lines; see ``judge_lines`` for the columns.

    Typed rows: id, file, line_no, frame_idx, class_value, object_value, distance_mm, xmin, ymin, xmax, ymax,
    polygon_x, polygon_y, other_fields (map of the remaining named fields). A missing value is null; frame_idx is decimal(38,0).
    Rejected rows: id, file, line_no, text, errors, bad_fields.
    """
    judged = judge_lines(lines, **columns)
    rejected = _where(judged, F.size("errors") > 0).select("id", "file", "line_no", "text", "errors", "bad_fields")
    ok = _where(judged, F.size("errors") == 0)

    def field(test) -> Column:
        at = F.get(_positions(F.col("names"), test), F.lit(0))
        v = F.try_element_at(F.col("fields"), at)
        return F.when(v.isin(*MISSING), None).otherwise(v)

    point = lambda c: as_point(c, F.col("sep"))
    number = lambda c: point(c).try_cast("double")
    corner = lambda axis, end: number(field(lambda x: x.rlike(rf"^(?:bbox_)?{axis}_?{end}$")))
    outline = lambda axis: F.transform(F.split(point(field(lambda x: x.rlike(rf"^poly(?:gon)?_?{axis}$"))), " "), lambda x: x.try_cast("double"))
    distance = field(lambda x: x.isin(*DISTANCE_NAMES))
    unit = F.regexp_extract(distance, "(mm|cm|m)?$", 1)
    factor = F.when(unit == "cm", 10.0).when(unit == "m", 1000.0).otherwise(1.0)
    known = lambda x: x.isin(FRAME_NAME, *CLASS_NAMES, *OBJECT_NAMES, *DISTANCE_NAMES) | x.rlike(BOX_NAME) | x.rlike(POLYGON_NAME)
    others = F.filter(F.arrays_zip(F.col("names").alias("n"), F.col("fields").alias("v")), lambda z: ~known(z["n"]) & ~z["v"].isin(*MISSING))
    typed = ok.select(
        "id",
        "file",
        "line_no",
        as_frame(field(lambda x: x == FRAME_NAME)).alias("frame_idx"),
        field(lambda x: x.isin(*CLASS_NAMES)).alias("class_value"),
        field(lambda x: x.isin(*OBJECT_NAMES)).alias("object_value"),
        (number(F.regexp_replace(distance, " *(mm|cm|m)$", "")) * factor).alias("distance_mm"),
        corner("x", "min").alias("xmin"),
        corner("y", "min").alias("ymin"),
        corner("x", "max").alias("xmax"),
        corner("y", "max").alias("ymax"),
        outline("x").alias("polygon_x"),
        outline("y").alias("polygon_y"),
        # repeated names: the first one is kept
        F.aggregate(
            others,
            F.create_map().cast("map<string,string>"),
            lambda m, z: F.when(F.map_contains_key(m, z["n"]), m).otherwise(F.map_concat(m, F.create_map(z["n"], z["v"]))),
        ).alias("other_fields"),
    )
    return typed, rejected


def rejected_lines(lines: DataFrame, **columns: str) -> DataFrame:
    """(id, reason): the first reason of every line that cannot be loaded as a record of its file."""
    return judge_lines(lines, **columns).select("id", F.explode(F.slice("errors", 1, 1)).alias("reason"))
