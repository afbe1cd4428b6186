"""Problem 3: schemas that drift between files, reported change by change and unified.

The files of a campaign are put in order of recording. Each is compared with the one before it: the names that
vanished and the names that appeared form a bipartite graph whose edges are scored by role, place, likeness of
value sketches (type, range, values, length, characters) and name similarity; a maximum-weight matching gives the renames, the
rest is removed or added. Role and place tell a rename by themselves and outweigh everything else; where they tell nothing,
columns whose sketches and names are alike are renames too, unless ``told_only`` asks for role or place (an exact check
behind the matching). Each field carries the type of its last values, which its sketch gives, and its first name through
renames, which gives type changes and one consistent name per field.

Scale: following fields is sequential inside a campaign, yet a campaign may hold a third of all files. Files are
therefore range-partitioned by (campaign, time), so that a large campaign spans many tasks. A first pass describes
each partition's effect on the state that enters it, symbolically; these effects (one row per partition, of
the width of a header) are composed in order, and a second pass runs every partition with its true entry state.

Defined results: rows without a campaign are in no campaign and give nothing; several profiles of one file count
once, the latest wins; ties in time are put in order of sequence_id; null or empty ``columns`` is a file without
fields; a repeated name in one header counts once; empty inputs give an empty result; other input
columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache, partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.text import is_blank, strip
from kerbline.session import checkpoint_ready, ship_package

ROLES = ("class_col", "object_col", "distance_col", "xmin_col", "ymin_col", "xmax_col", "ymax_col", "polygon_x_col", "polygon_y_col")
#: Weights of a rename's evidence. A role outweighs two places, a place two pairs that are alike in all content.
BY_ROLE, BY_PLACE, BY_SKETCH, BY_NAME = 100.0, 20.0, 4.0, 2.0
#: Content alone makes a rename from this weight on.
ALIKE = 3.2
#: Marks state that a partition inherits from the one before it.
INHERITED = "\x00"

FILES = ["campaign_id", "recorded_at", "sequence_id", "label_v2_csv", "columns", "roles", "sketches"]
CHANGE_SCHEMA = "sequence_id string, change_kind string, old_name string, new_name string"
FIELD_SCHEMA = "campaign_id string, sequence_id string, label_v2_csv string, column_name string, field_name string"


def _name(col: Column | str) -> Column:
    return F.lower(strip(col))


def typed_values(samples: Column | str) -> Column:
    """``type:`` and the ``|``-joined sample values (up to five); null without values."""
    samples = F.col(samples) if isinstance(samples, str) else samples
    number = r"\d+(?:[.,]\d+)?"
    kind = F.when(samples.rlike(r"\A\d+(?:\|\d+)*+\z"), "integer:").when(samples.rlike(rf"\A{number}(?:\|{number})*+\z"), "decimal:").otherwise("text:")
    return F.when(~is_blank(samples), F.concat(kind, F.translate(samples, "\x1e\x1f", "  ")))


def campaign_files(profiles: DataFrame, column_profiles: DataFrame) -> DataFrame:
    """One row per distinct file: its campaign, time, header, roles and the sketches of its columns."""
    roles = F.concat_ws("\x1f", *[F.coalesce(_name(c), F.lit("")) for c in ROLES])
    facts = F.struct("recorded_at", F.coalesce("columns", F.lit("")).alias("columns"), roles.alias("roles"))
    files = (
        profiles.filter(F.col("campaign_id").isNotNull())
        .groupBy("campaign_id", "sequence_id", "label_v2_csv")
        .agg(F.max_by(facts, F.struct("profiled_at", facts)).alias("f"))
        .select("campaign_id", "sequence_id", "label_v2_csv", "f.*")
    )
    sketch = F.concat_ws("\x1f", _name("column_name"), typed_values("sample_values"))
    sketches = (
        column_profiles.select("sequence_id", "label_v2_csv", F.when(~is_blank("sample_values"), sketch).alias("sketch"))
        .groupBy("sequence_id", "label_v2_csv")
        .agg(F.array_join(F.array_sort(F.collect_set("sketch")), "\x1e").alias("sketches"))
    )
    return files.join(sketches, ["sequence_id", "label_v2_csv"], "left").select(*FILES)


def assign(weights: list[list[float]]) -> list[tuple[int, int]]:
    """Maximum-weight matching of rows to columns by shortest augmenting paths; pairs of positive weight."""
    rows, cols = len(weights), len(weights[0]) if weights else 0
    size = max(rows, cols)
    cost = [[-weights[i][j] if i < rows and j < cols else 0.0 for j in range(size)] for i in range(size)]
    u, v, owner = [0.0] * (size + 1), [0.0] * (size + 1), [0] * (size + 1)
    for i in range(1, size + 1):
        owner[0], at = i, 0
        best, back, done = [float("inf")] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        while owner[at]:
            done[at] = True
            row, step, nxt = owner[at], float("inf"), 0
            for j in range(1, size + 1):
                if not done[j]:
                    reduced = cost[row - 1][j - 1] - u[row] - v[j]
                    if reduced < best[j]:
                        best[j], back[j] = reduced, at
                    if best[j] < step:
                        step, nxt = best[j], j
            for j in range(size + 1):
                if done[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    best[j] -= step
            at = nxt
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    return [(owner[j] - 1, j - 1) for j in range(1, size + 1) if owner[j] - 1 < rows and j - 1 < cols and weights[owner[j] - 1][j - 1] > 0]


@lru_cache(maxsize=1 << 14)
def value_sketch(kind: str, samples: str) -> tuple[str, float, float, float, float, frozenset[str]]:
    """(type, lowest and highest number, mean length, share of digits, distinct values) of a column's sample values."""
    values = [v.strip().lower() for v in samples.split("|")]
    numbers = [] if kind == "text" else [float(v.replace(",", ".")) for v in values]
    characters = sum(map(len, values))
    digits = sum(c.isdigit() for v in values for c in v) / max(1, characters)
    return kind, min(numbers, default=0.0), max(numbers, default=0.0), characters / len(values), digits, frozenset(values)


def likeness(a: tuple[str, str], b: tuple[str, str]) -> float:
    """0 to 1: how alike the values of two columns, each (type, samples), are by their sketches."""
    (kind_a, low_a, high_a, length_a, digits_a, values_a), (kind_b, low_b, high_b, length_b, digits_b, values_b) = value_sketch(*a), value_sketch(*b)
    kinds = 1.0 if kind_a == kind_b else 0.5 if "text" not in (kind_a, kind_b) else 0.0
    same = spread = len(values_a & values_b) / len(values_a | values_b)
    if "text" not in (kind_a, kind_b):  # share of the joint range that both cover
        spread = (max(0.0, min(high_a, high_b) - max(low_a, low_b)) + 1) / (max(high_a, high_b) - min(low_a, low_b) + 1)
    lengths = (min(length_a, length_b) + 1) / (max(length_a, length_b) + 1)
    return 0.35 * kinds + 0.2 * same + 0.2 * spread + 0.15 * lengths + 0.1 * (1 - abs(digits_a - digits_b))


class File:
    """A file's header as the comparison needs it."""

    __slots__ = ("columns", "place", "roles", "sketch")

    def __init__(self, columns: str, roles: str, sketches: str | None) -> None:
        names = [c.strip().lower() for c in columns.split("|")] if columns else []
        self.place: dict[str, int] = {}
        for i, c in enumerate(names):
            self.place.setdefault(c, i)
        self.columns = list(self.place)
        self.roles = roles.split("\x1f")
        pairs = [s.split("\x1f") for s in sketches.split("\x1e")] if sketches else []
        self.sketch: dict[str, tuple[str, str]] = {p[0]: p[1].partition(":")[::2] for p in pairs if len(p) == 2}

    def pack(self) -> list:
        return [list(self.place.items()), self.roles, {k: list(v) for k, v in self.sketch.items()}]

    @classmethod
    def unpack(cls, x: list) -> File:
        self = cls("", "", None)
        self.place = dict(map(tuple, x[0]))
        self.columns, self.roles, self.sketch = list(self.place), x[1], {k: tuple(v) for k, v in x[2].items()}
        return self


def told(before: File, now: File, a: str, b: str) -> float:
    """What roles and places say for ``a`` going on as ``b``: the weight of the best evidence, 0 without any."""
    score = 0.0
    for x, y in zip(before.roles, now.roles):
        if x and y:
            score = max(score, BY_ROLE if (x, y) == (a, b) else 0.0)
        elif before.place[a] == now.place[b] and x in ("", a) and y in ("", b):  # the role is unknown in one of the files
            known_elsewhere = (a in before.roles and x != a) or (b in now.roles and y != b)
            score = max(score, 0.0 if known_elsewhere else BY_PLACE)
    return score


def content(before: File, now: File, a: str, b: str) -> float:
    """What sketches and names say for ``a`` going on as ``b``."""
    s, t = before.sketch.get(a), now.sketch.get(b)
    return BY_SKETCH * (likeness(s, t) if s and t else 0.0) + BY_NAME * SequenceMatcher(None, a, b, autojunk=False).ratio()


def renames(before: File, now: File, told_only: bool = False) -> dict[str, str]:
    """Names of ``before`` to their new names in ``now``."""
    gone = [c for c in before.columns if c not in now.place]
    new = [c for c in now.columns if c not in before.place]
    edges: dict[str, dict[str, float]] = {}
    for a in gone:
        for b in new:
            sure, alike = told(before, now, a, b), content(before, now, a, b)
            if sure or alike >= ALIKE:
                edges.setdefault(a, {})[b] = sure + alike
    matched = match(edges)
    return {a: b for a, b in matched.items() if told(before, now, a, b)} if told_only else matched


def match(edges: dict[str, dict[str, float]]) -> dict[str, str]:
    """Maximum-weight matching of a sparse bipartite graph, solved for each connected part by itself."""
    out: dict[str, str] = {}
    by_new: dict[str, list[str]] = {}
    for a, own in edges.items():
        for b in own:
            by_new.setdefault(b, []).append(a)
    left = dict.fromkeys(edges)
    while left:
        todo, olds, news = [next(iter(left))], {}, {}
        while todo:
            a = todo.pop()
            if a in left:
                del left[a]
                olds[a] = None
                for b in edges[a]:
                    news[b] = None
                    todo += by_new[b]
        olds, news = list(olds), list(news)
        if len(olds) == len(news) == 1:
            out[olds[0]] = news[0]
        else:
            out |= {olds[i]: news[j] for i, j in assign([[edges[a].get(b, 0.0) for b in news] for a in olds])}
    return out


#: State of a campaign: its last file, and of each of that file's columns the type of its last values, the name
#: it then had, and its canonical name.
State = tuple[File, dict[str, tuple[str, str, str]]]


def step(state: State | None, now: File, changes: list | None = None, told_only: bool = False) -> State:
    """The state after ``now``; what changed is appended to ``changes``."""
    inherited: dict[str, tuple[str, str, str]] = {}
    if state is not None:
        before, known = state
        if before.columns == now.columns:
            inherited = known
        else:
            moved = renames(before, now, told_only)
            for c in before.columns:
                name = moved.get(c, c if c in now.place else None)
                if name is not None:
                    inherited[name] = known[c]
            if changes is not None:
                changes += [("renamed", a, b) for a, b in moved.items()]
                changes += [("removed", c, "") for c in before.columns if c not in now.place and c not in moved]
                changes += [("added", "", c) for c in now.columns if c not in inherited]
    info = {}
    for c in now.columns:
        kind, then, canon = inherited.get(c, ("", "", c))
        sketch = now.sketch.get(c)
        if sketch is not None:
            if changes is not None and kind and kind != sketch[0]:
                changes.append(("type_changed", then, c))
            kind, then = sketch[0], c
        info[c] = (kind, then, canon)
    return now, info


def _unknown_start(now: File) -> State:
    """State after a file whose predecessor is in another partition."""
    info = {}
    for c in now.columns:
        sketch = now.sketch.get(c)
        info[c] = (sketch[0], c, INHERITED + c) if sketch else (INHERITED + c, "", INHERITED + c)
    return now, info


def _settle(state: State, start: State | None, first: File, told_only: bool) -> State:
    """Replace what ``state`` inherited from before ``first`` by what ``start`` says."""
    _, known = step(start, first, None, told_only)

    def of(x: tuple[str, str, str]) -> tuple[str, str, str]:
        kind, then, canon = x
        if kind.startswith(INHERITED):
            kind, then = known[kind[1:]][:2]
        return kind, then, known[canon[1:]][2] if canon.startswith(INHERITED) else canon

    return state[0], {c: of(x) for c, x in state[1].items()}


def _files(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for pdf in batches:
        for pid, campaign, sequence, label, columns, roles, sketches in pdf.itertuples(index=False):
            yield int(pid), campaign, sequence, label, File(columns, roles, sketches if isinstance(sketches, str) else None)


def _effects(told_only: bool, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per partition: its first campaign and file, its last campaign and the state it ends with."""
    first, state, campaign, pid = None, None, None, -1
    for pid, now_in, _, _, f in _files(batches):
        if first is None:
            first, state = (now_in, f), _unknown_start(f)
        else:
            state = step(state if now_in == campaign else None, f, None, told_only)
        campaign = now_in
    if first is not None:
        text = json.dumps([first[0], first[1].pack(), campaign, state[0].pack(), state[1]])
        yield pd.DataFrame({"pid": [pid], "effect": [text]})


def _entry_states(effects: list[tuple[int, str]], told_only: bool) -> dict[int, tuple[str, list, dict]]:
    """The state that enters each partition whose first campaign began in an earlier one."""
    entries, campaign, state = {}, None, None
    for pid, text in sorted(effects):
        first_in, first, last_in, last, info = json.loads(text)
        end: State = (File.unpack(last), {c: tuple(x) for c, x in info.items()})
        start = state if first_in == campaign else None
        if start is not None:
            entries[pid] = (campaign, start[0].pack(), start[1])
        # a state of a campaign that began in this partition inherits nothing
        state = _settle(end, start, File.unpack(first), told_only) if first_in == last_in else end
        campaign = last_in
    return entries


def _staged(profiles: DataFrame, column_profiles: DataFrame, told_only: bool) -> tuple[DataFrame, dict]:
    spark = profiles.sparkSession
    ship_package(spark)
    checkpoint_ready(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["campaign_id", "recorded_at", "sequence_id", "label_v2_csv"]
    ordered = campaign_files(profiles, column_profiles).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # both passes must see the same partitions, also after the loss of an executor
    staged = ordered.withColumn("pid", F.spark_partition_id()).select("pid", "campaign_id", "sequence_id", "label_v2_csv", "columns", "roles", "sketches").checkpoint()
    effects = staged.mapInPandas(partial(_effects, told_only), "pid int, effect string").collect()  # one row per partition
    return staged, _entry_states([(r.pid, r.effect) for r in effects], told_only)


def _walk(entries: dict, told_only: bool, batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(campaign, sequence, label, changes, state after the file) of every file, in order."""
    campaign, state = None, None
    for k, (pid, now_in, sequence, label, f) in enumerate(_files(batches)):
        if k == 0 and pid in entries and entries[pid][0] == now_in:
            state = (File.unpack(entries[pid][1]), {c: tuple(x) for c, x in entries[pid][2].items()})
        elif now_in != campaign:
            state = None
        campaign, changes = now_in, []
        state = step(state, f, changes, told_only)
        yield now_in, sequence, label, changes, state


def schema_changes(profiles: DataFrame, column_profiles: DataFrame, told_only: bool = False) -> DataFrame:
    """(sequence_id, change_kind, old_name, new_name), distinct. ``told_only``: only renames that role or place tell. Runs one job when called (see the module)."""
    staged, entries = _staged(profiles, column_profiles, told_only)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple] = []
        for _, sequence, _, changes, _ in _walk(entries, told_only, batches):
            found += dict.fromkeys((sequence, *c) for c in changes)
            if len(found) > 5000:
                yield pd.DataFrame(found, columns=["sequence_id", "change_kind", "old_name", "new_name"])
                found = []
        yield pd.DataFrame(found, columns=["sequence_id", "change_kind", "old_name", "new_name"])

    return staged.mapInPandas(run, CHANGE_SCHEMA).distinct()


def unified_fields(profiles: DataFrame, column_profiles: DataFrame, told_only: bool = False) -> DataFrame:
    """(campaign_id, sequence_id, label_v2_csv, column_name, field_name): each file's columns under the name with
    which the field began in its campaign. Joined with loaded label rows it gives one consistent table."""
    staged, entries = _staged(profiles, column_profiles, told_only)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["campaign_id", "sequence_id", "label_v2_csv", "column_name", "field_name"]
        found: list[tuple] = []
        for campaign, sequence, label, _, (_, info) in _walk(entries, told_only, batches):
            found += [(campaign, sequence, label, c, canon) for c, (_, _, canon) in info.items()]
            if len(found) > 5000:
                yield pd.DataFrame(found, columns=names)
                found = []
        yield pd.DataFrame(found, columns=names)

    return staged.mapInPandas(run, FIELD_SCHEMA)


def unified_rows(loaded: DataFrame, fields: DataFrame, lines_per_block: int = 4096) -> DataFrame:
    """(id, file, line_no, values): loaded label rows with their values under the unified field names of their file.

    ``loaded``: id, file, line_no, names, fields (arrays); ``fields``: the result of ``unified_fields``. A file without
    profile keeps its own names; of repeated names the first counts. The names of a file meet its lines block by
    block, so that one file with most of the rows is spread over many tasks.
    """
    block = F.floor(F.greatest(F.coalesce("line_no", F.lit(0)), F.lit(0)) / lines_per_block)
    rows = loaded.select("id", "file", "line_no", "names", "fields", F.col("block") if "block" in loaded.columns else block.alias("block"))
    pairs = fields.groupBy(F.col("label_v2_csv").alias("file"), "column_name").agg(F.min("field_name").alias("field_name"))
    maps = pairs.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("column_name", "field_name"))).alias("unified"))
    # headers are renamed once per file and block, not once per line
    headers = rows.filter(F.col("file").isNotNull()).select("file", "block", "names").distinct().join(maps, "file", "left")
    keys = F.transform("names", lambda n: F.coalesce(F.try_element_at(F.col("unified"), n), n))
    headers = headers.select("file", "block", "names", keys.alias("keys"))
    joined = rows.join(headers.hint("shuffle_hash"), ["file", "block", "names"], "left").withColumn("keys", F.coalesce("keys", "names"))
    entries = F.arrays_zip(F.col("keys").alias("k"), F.col("fields").alias("v"))
    first = F.filter(entries, lambda z, i: F.array_position(F.col("keys"), z["k"]) == i + 1)
    repeated = F.map_from_entries(F.transform(first, lambda z: F.struct(z["k"], z["v"])))
    unique = F.size(F.array_distinct("keys")) == F.size("keys")
    values = F.when(unique & (F.size("keys") == F.size("fields")), F.map_from_arrays("keys", "fields")).otherwise(repeated)
    return joined.select("id", "file", "line_no", values.alias("values"))
