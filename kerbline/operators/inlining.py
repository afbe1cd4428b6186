"""Problem 2: deeply nested records turned into related flat tables.

The method is shared inlining over the graph of elements that occur in the documents: an edge leads from an element
to a child key and says whether the child is repeated (an array member) there. An element gets a table of its own if
it is repeated, has several parents (shared) or lies on a cycle (recursive); every other object is inlined into
the row of its nearest ancestor with a table, as columns ``key.key``. Rows carry the path of their own node and
of their parent row as keys.

Two passes of a vectorised Python parser run over the payloads, since no built-in expression walks a document of
unknown depth: the first returns distinct edges per batch, which are reduced by a grouping; the second
writes the rows, and looks for them only where the graph has any. The graph has the size of the schema, not of the data. Up
to ``LOCAL_EDGES`` edges it is analysed on the driver and broadcast; the second pass then has no shuffle, so a hot record id
or group cannot matter. A larger one (keys that are data) is analysed on the cluster with the same result, and each
document meets those of its own names that ask for tables in a join, so no set of names outgrows a task.

Defined results: a null payload, a payload that is not exactly one JSON object (blanks around it and a leading byte
order mark aside) and absent, null or scalar root keys give no rows; of repeated keys the last counts; NaN and
Infinity are no JSON; empty objects are rows; any depth is followed (no recursion); a repeated input row repeats
its output rows; other input columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from kerbline.session import broadcast_if_small, checkpoint_ready, ship_package, spread

ROOTS = ("tags", "customFieldValues")
#: Names up to this number are broadcast; more meet the documents in a shuffle.
MAX_BROADCAST_NAMES = 100_000
#: Edges that the driver analyses itself, and that a task remembers having sent.
LOCAL_EDGES = 20_000
ROW_SCHEMA = (
    "record_id bigint, element string, kind string, repeated boolean, parent_path string, enclosing_path string, node_path string, attributes map<string,string>"
)
EDGE_SCHEMA = "parent string, child string, repeated boolean"

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?|true|false|null))')


#: A spelled surrogate without the other half of its pair.
_LONE = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F]")


def _reject(text: str) -> None:
    raise ValueError(text)


#: Numbers keep their spelling, which also spares a limit on the digits of integers.
_DECODER = json.JSONDecoder(parse_constant=_reject, parse_int=str, parse_float=str)


def parse_object(payload: str | None) -> dict | None:
    """The payload's JSON object, or None if the payload is not exactly one."""
    if payload is None:
        return None
    text = payload.strip()
    if text.startswith("\ufeff"):
        text = text[1:].strip()
    if not text.startswith("{"):
        return None
    try:
        document = _DECODER.decode(text)
    except RecursionError:
        document = _parse_deep(text)
    except ValueError:
        return None
    if document and ("\\ud" in text or "\\uD" in text) and _LONE.search(text):
        _clean_all(document)
    return document


def _parse_deep(text: str) -> dict | None:
    """As ``json.loads``, without recursion, for documents nested deeper than the interpreter's stack."""
    stack: list = []  # open containers
    keys: list = []  # pending key of each open container
    root, at, need = None, 0, "value"
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            return root if need == "end" and not text[at:].strip(" \t\n\r") and isinstance(root, dict) else None
        at, mark = m.end(), m[1]
        if mark in ("}", "]"):
            if not stack or isinstance(stack[-1], dict) != (mark == "}") or need not in ("next", "first key" if mark == "}" else "first"):
                return None
            stack.pop(), keys.pop()
            need = "next" if stack else "end"
        elif mark == ",":
            if need != "next":
                return None
            need = "key" if isinstance(stack[-1], dict) else "value"
        elif mark == ":":
            if need != "colon":
                return None
            need = "value"
        elif need in ("key", "first key"):
            if m[2] is None:
                return None
            keys[-1], need = json.loads(m[2]), "colon"
        elif need in ("value", "first"):
            value = {} if mark == "{" else [] if mark == "[" else _DECODER.decode(m[2] or m[3])
            if stack:
                if isinstance(stack[-1], dict):
                    stack[-1][keys[-1]] = value
                else:
                    stack[-1].append(value)
            else:
                root = value
            if mark:
                stack.append(value), keys.append(None)
                need = "first key" if mark == "{" else "first"
            else:
                need = "next" if stack else "end"
        else:
            return None


def _clean(text: str) -> str:
    """Lone surrogates, which JSON can spell but UTF-8 cannot, become replacement characters."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _clean_all(document: dict) -> None:
    todo: list = [document]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            items = [(_clean(k), _clean(v) if isinstance(v, str) else v) for k, v in node.items()]
            node.clear()
            node.update(items)
        else:
            node[:] = [_clean(v) if isinstance(v, str) else v for v in node]
        todo += [v for v in (node.values() if isinstance(node, dict) else node) if isinstance(v, (dict, list))]


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def _starts(document: dict, roots: Sequence[str]) -> Iterator[tuple[str, list]]:
    for key in roots:
        value = document.get(key)
        if isinstance(value, dict):
            yield key, [value]
        elif isinstance(value, list):
            yield key, value


def edges_of(document: dict, roots: Sequence[str]) -> set[tuple[str, str, bool]]:
    """(parent element, child element, repeated) of a document; elements are named by their key."""
    found: set[tuple[str, str, bool]] = set()
    todo: list[tuple[str, str, object, bool]] = [("", key, x, True) for key, xs in _starts(document, roots) for x in xs]
    while todo:
        parent, name, value, repeated = todo.pop()
        if isinstance(value, list):
            todo += [(parent, name, x, True) for x in value]
        elif isinstance(value, dict):
            found.add((parent, name, repeated))
            for k, x in value.items():
                if isinstance(x, dict):
                    todo.append((name, k, x, False))
                elif isinstance(x, list):
                    todo += [(name, k, y, True) for y in x]
    return found


def rows_of(document: dict, roots: Sequence[str], own_table: frozenset[str], attributes: bool = True, objects: frozenset[str] | None = None) -> Iterator[tuple]:
    """(element, kind, repeated, parent_path, enclosing_path, node_path, attributes) of every row that a document gives.

    ``objects``: the elements of the graph; arrays of other elements, which hold no objects, are left out (None: none are).
    """
    # element, value, path, path of the parent row, path of the nearest array member around it, repeated
    todo: list[tuple] = [(key, x, f"{key}[{i}]", "", "", True) for key, xs in _starts(document, roots) if objects is None or key in objects for i, x in enumerate(xs)]
    while todo:
        name, value, path, parent, member, repeated = todo.pop()
        if isinstance(value, list):  # an array in an array
            todo += [(name, x, f"{path}[{i}]", parent, member, True) for i, x in enumerate(value)]
            continue
        if not isinstance(value, dict):  # a scalar member: a row of its element with one attribute
            yield name, "value", repeated, parent, member, path, {"": _text(value)} if attributes else None
            continue
        around = path if repeated else member
        inlined: dict[str, str | None] = {}
        fields = [("", path, value)]
        while fields:
            prefix, at, obj = fields.pop()
            for k, x in obj.items():
                here = f"{at}.{k}"
                if isinstance(x, list):
                    if objects is None or k in objects:
                        todo += [(k, y, f"{here}[{i}]", path, around, True) for i, y in enumerate(x)]
                elif isinstance(x, dict) and k in own_table:
                    todo.append((k, x, here, path, around, False))
                elif isinstance(x, dict):
                    fields.append((f"{prefix}{k}.", here, x))
                elif attributes:
                    inlined[prefix + k] = _text(x)
        yield name, "object", repeated, parent, member, path, inlined if attributes else None


def schema_graph(records: DataFrame, payload: str = "payload", roots: Sequence[str] = ROOTS) -> DataFrame:
    """(parent, child, repeated): the distinct edges of the element graph over all payloads."""
    ship_package(records.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[str, str, bool]] = set()  # edges this task has already sent
        for batch in batches:
            new: set[tuple[str, str, bool]] = set()
            for text in batch.column(0).to_pylist():
                document = parse_object(text)
                if document:
                    new |= edges_of(document, roots) - known
            if len(known) < LOCAL_EDGES:
                known |= new
            rows = list(new)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.bool_())],
                names=["parent", "child", "repeated"],
            )

    return spread(records.select(F.col(payload).alias("p"))).mapInArrow(scan, EDGE_SCHEMA).distinct()


def tables_of(edges: Sequence[tuple[str, str, bool]]) -> frozenset[str]:
    """Elements with a table of their own: repeated, shared by several parents, or on a cycle."""
    parents: dict[str, set[str]] = {}
    children: dict[str, set[str]] = {}
    own = set()
    for parent, child, repeated in edges:
        parents.setdefault(child, set()).add(parent)
        children.setdefault(parent, set()).add(child)
        if repeated:
            own.add(child)
    own |= {c for c, ps in parents.items() if len(ps) > 1}
    # an element is recursive if it can be reached from itself; leaves are peeled off until only cycles remain
    left = {e: set(c) for e, c in children.items()}
    while True:
        leaves = {e for e, c in left.items() if not (c & left.keys())}
        if not leaves:
            break
        left = {e: c for e, c in left.items() if e not in leaves}
    return frozenset(own | (left.keys() & parents.keys()))


def single_tables(graph: DataFrame) -> DataFrame:
    """(element): ``tables_of`` of a graph of any size, of elements that are single objects somewhere, found on the cluster."""
    checkpoint_ready(graph.sparkSession)
    edges = graph.select("parent", "child").distinct()
    shared = edges.groupBy(F.col("child").alias("element")).agg(F.count("*").alias("n")).filter("n > 1").select("element")
    left, n = edges.filter("parent <> ''").checkpoint(), -1
    while n != (n := left.count()):  # edges to elements without children are peeled off until only cycles and what leads to them remain
        left = left.join(left.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").checkpoint()
    cyclic = left.select(F.col("parent").alias("element")).distinct().join(edges.select(F.col("child").alias("element")).distinct(), "element", "left_semi")
    own = graph.filter("repeated").select(F.col("child").alias("element")).unionByName(shared).unionByName(cyclic).distinct()
    return own.join(graph.filter("not repeated").select(F.col("child").alias("element")).distinct(), "element", "left_semi")


def shred(
    records: DataFrame, *, id_col: str = "record_id", payload: str = "payload", roots: Sequence[str] = ROOTS, attributes: bool = True, local_edges: int = LOCAL_EDGES
) -> DataFrame:
    """All rows of all tables: record_id, element (the table), kind (object or value), repeated, parent_path,
    enclosing_path, node_path, attributes.

    (record_id, node_path) is the key of a row, (record_id, parent_path) refers to its parent row; an empty
    parent_path refers to the record. ``enclosing_path`` is the nearest array member around the row. ``attributes``
    holds the scalar and inlined fields; ``attributes=False`` leaves it null and leaves out arrays without objects, when only
    the keys of objects are needed. Runs one job over the payloads when called (the schema graph).
    """
    graph = schema_graph(records, payload, roots)
    edges = [tuple(e) for e in graph.limit(local_edges + 1).collect()]
    rows = records.select(F.col(id_col).cast("bigint").alias("i"), F.col(payload).alias("p"))
    if len(edges) <= local_edges:
        known = records.sparkSession.sparkContext.broadcast((tables_of(edges), None if attributes else frozenset(child for _, child, _ in edges)))
        rows = spread(rows).withColumn("own", F.lit(None).cast("array<string>"))
    else:
        known = records.sparkSession.sparkContext.broadcast((frozenset(), None))
        rows = _with_own_tables(rows, single_tables(graph.persist(StorageLevel.MEMORY_AND_DISK)), roots)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, with_objects = known.value
        for batch in batches:
            out: list[tuple] = []
            for record, text, own in zip(*(batch.column(k).to_pylist() for k in range(3))):
                document = parse_object(text)
                if document:
                    out += [(record, *r) for r in rows_of(document, roots, tables if own is None else frozenset(own), attributes, with_objects)]
                if len(out) > 20_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return rows.select("i", "p", "own").mapInArrow(scan, ROW_SCHEMA)


def _with_own_tables(rows: DataFrame, tables: DataFrame, roots: Sequence[str]) -> DataFrame:
    """``rows`` (p: payload) with ``own``: those of ``tables`` (element) that the payload has as single objects.

    Equal payloads share the answer, by their hash; nothing has the size of the graph but the join that finds it.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, names = [], []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                document = parse_object(text)
                found = {child for _, child, repeated in edges_of(document, roots) if not repeated} if document else ()
                hashes += [h] * len(found)
                names += found
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.string()), pa.array(names, pa.string())], names=["h", "element"])

    keyed = spread(rows).withColumn("h", F.sha2("p", 256))
    pairs = keyed.select("h", "p").filter("p is not null").mapInArrow(scan, "h string, element string")
    own = pairs.join(broadcast_if_small(tables, MAX_BROADCAST_NAMES), "element").groupBy("h").agg(F.collect_set("element").alias("own"))
    return keyed.join(own, "h", "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))


_ROW_TYPES = (
    ("record_id", pa.int64()),
    ("element", pa.string()),
    ("kind", pa.string()),
    ("repeated", pa.bool_()),
    ("parent_path", pa.string()),
    ("enclosing_path", pa.string()),
    ("node_path", pa.string()),
    ("attributes", pa.map_(pa.string(), pa.string())),
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in _ROW_TYPES]
    columns[-1] = [None if m is None else list(m.items()) for m in columns[-1]]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _ROW_TYPES)], names=[name for name, _ in _ROW_TYPES])


def element_table(shredded: DataFrame, element: str, columns: Sequence[str]) -> DataFrame:
    """The flat table of one element: its keys and the named attributes as columns; other attributes stay in a map."""
    rows = shredded.filter(F.col("element") == element)
    named = [F.col("attributes").getItem(c).alias(c or "value") for c in columns]
    rest = F.map_filter("attributes", lambda k, _: ~k.isin(*columns)) if columns else F.col("attributes")
    return rows.select("record_id", "parent_path", "node_path", *named, rest.alias("other_attributes"))


def element_columns(shredded: DataFrame) -> DataFrame:
    """(element, column, n): the attributes that occur in each table."""
    return shredded.select("element", F.explode(F.map_keys("attributes")).alias("column")).groupBy("element", "column").agg(F.count("*").alias("n"))


def object_nodes(records: DataFrame, **options) -> DataFrame:
    """(record_id, parent_path, node_path) of every object that is a member of an array under the roots; the parent
    is the nearest such object around it."""
    rows = shred(records, attributes=False, **options)
    members = rows.filter(F.col("repeated") & (F.col("kind") == "object"))
    return members.select("record_id", F.col("enclosing_path").alias("parent_path"), "node_path")
