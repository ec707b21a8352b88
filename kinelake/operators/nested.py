"""Deeply nested scene records as related flat tables, by structural variant.

The shape of a JSON value is classified bottom-up by a tree automaton, once a
node and only where something follows from it: every leaf has a state by its type and form, every array a state by the
states of its elements, every object one by its field names and the states of
its fields. A string that holds a list or a map, as JSON (in any number of
layers) or as a Python literal, is a leaf with a child and takes the child's
state.

What a node stands for is decided by its state alone, in the role that its
parent's field gives it: tables name, for each role, the states that it takes
and what is made of them. So differently shaped records take the same path, and
a state that a role doesn't take is skipped while the rest of the record is kept.

Rows are routed by state and written once, to one folder a table: a subtype
table for each variant of an object's position, and tags, links, nodes, unnamed
and unparsed. The supertype table ``objects`` unites the common columns of the
subtypes; ``scene_links`` reads the links from these tables. Child rows carry
(scene_uid, parent_id), so they join back.

One pass without a shuffle; only ``scene_links`` shuffles, to drop repeated links.

Defined cases: a null, empty, blank or cut-off text, one nested too deeply for
the parser, and one without a scene give a row of ``unparsed`` with the reason;
null, empty and blank tags give no rows; objects without an id, and all below
them, are rows of ``unnamed`` with a positional id ('#2' for the third) and give
no links; ids repeated within a record give a row each.
"""

from __future__ import annotations

import ast
import json
import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.session import scratch_path

#: Variants of an object's position by its state, each with its own subtype table; those of four numbers have a w besides.
XYZ_VARIANTS = ("vector_array_3", "vector_object_3", "vector_text_3", "literal", "none")
SUBTYPES = (*XYZ_VARIANTS, "vector_array_4", "vector_object_4", "vector_text_4")

# Field names with one meaning.
ID_NAMES = ("object_id", "id", "name", "uid")
THING_FIELDS = {"description", "keywords", "tags", "xyz", "xyzw", "usd", "parts"}
LINK_ENDS = (("source", "target"), ("from", "to"), ("src", "dst"))
LINK_NAMES = ("links", "edges")
LINK_HEADS = {a for a, _ in LINK_ENDS}


class Node:
    """A value with its state. ``raw`` is a leaf's value (of a written list or map its text); ``kids`` a list or a map of nodes."""

    __slots__ = ("state", "raw", "kids", "id")

    def __init__(self, state: str, raw=None, kids=(), own_id: str | None = None) -> None:
        self.state, self.raw, self.kids, self.id = state, raw, kids, own_id

    @property
    def written(self) -> bool:
        return self.raw is not None and bool(self.kids)


NOTHING = Node("null")
NAMED, THINGS = {"thing_id", "named"}, {"thing_id", "thing", "named", "object", "thing_map", "empty_object"}
TEXTS = {"text", "vector_text_3", "vector_text_4"}
VECTORS = {f"vector_{form}_{n}" for form in ("array", "object", "text") for n in (3, 4)}
ARRAYS = {"empty_array", "vector_array_3", "vector_array_4", "number_array", "pair", "text_array", "link_array", "thing_array", "mixed_array"}


class _Numbers:
    """The nodes of a list of numbers, made when they are asked for."""

    __slots__ = ("values",)

    def __init__(self, values: list) -> None:
        self.values = values

    def __len__(self) -> int:
        return len(self.values)

    def __iter__(self) -> Iterator[Node]:
        return (Node("number", v) for v in self.values)

    def __getitem__(self, at: slice) -> list[Node]:
        return [Node("number", v) for v in self.values[at]]


class _Fields:
    """The nodes of an object's fields; each is classified when it is first asked for, and then kept."""

    __slots__ = ("values_", "nodes")

    def __init__(self, values: dict) -> None:
        self.values_, self.nodes = values, {}

    def keys(self):
        return self.values_.keys()

    def __len__(self) -> int:
        return len(self.values_)

    def __iter__(self) -> Iterator[str]:
        return iter(self.values_)

    def __contains__(self, name: str) -> bool:
        return name in self.values_

    def __getitem__(self, name: str) -> Node:
        node = self.nodes.get(name)
        if node is None:
            node = self.nodes[name] = classify(self.values_[name])
        return node

    def get(self, name: str, other: Node) -> Node:
        return self[name] if name in self.values_ else other

    def values(self) -> Iterator[Node]:
        return (self[k] for k in self.values_)

    def items(self) -> Iterator[tuple[str, Node]]:
        return ((k, self[k]) for k in self.values_)


def classify(value) -> Node:
    """The node of a JSON value. A state follows from the states below it; each is worked out once, and only if something follows from it."""
    return CLASSIFY[type(value)](value)


def state_of(value) -> str:
    """The automaton's state of a JSON value."""
    return classify(value).state


def _text(text: str) -> Node:
    t = text.strip()
    if not t:
        return Node("blank", text)
    if t[0] in '[{("':
        inner = _written(t)
        if inner is not None:
            node = classify(inner)
            return Node(node.state, text, node.kids or [NOTHING], node.id)
    if t[0] in "0123456789+-.":
        parts = t.replace(",", " ").split()
        if len(parts) in (3, 4) and all(_real(p) is not None for p in parts):
            return Node(f"vector_text_{len(parts)}", text)
    return Node("text", text)


def _list(values: list) -> Node:
    if values and {type(v) for v in values} <= {int, float}:
        return Node(f"vector_array_{len(values)}" if len(values) in (3, 4) else "number_array", None, _Numbers(values))
    kids = [classify(v) for v in values]
    states = {"text" if k.written and k.state not in THINGS else k.state for k in kids}
    if not states:
        state = "empty_array"
    elif len(kids) == 1 and states <= {"scene", "wrapper"}:
        state = "wrapper"
    elif states <= {*TEXTS, "blank", "null"}:
        state = "pair" if len(kids) == 2 and states <= TEXTS else "text_array"
    elif states <= {"pair", "link"}:
        state = "link_array"
    elif states <= THINGS:
        state = "thing_array"
    else:
        state = "mixed_array"
    return Node(state, None, kids)


def _object(values: dict) -> Node:
    kids = _Fields(values)
    names = values.keys()
    own = None if names.isdisjoint(ID_NAMES) else next((i for i in (_as_id(kids[n]) for n in ID_NAMES if n in kids) if i), None)
    if not names:
        state = "empty_object"
    elif {"x", "y", "z"} <= names:
        state = "vector_object_4" if "w" in names else "vector_object_3"
    elif not names.isdisjoint(LINK_HEADS) and any(a in names and b in names for a, b in LINK_ENDS):
        state = "link"
    elif names & {"layout", "relations"}:
        state = "scene"
    elif "scene_info" in names and kids["scene_info"].state in ("scene", "wrapper"):
        state = "wrapper"
    elif names & {"nodes", *LINK_NAMES}:
        state = "graph"
    elif names & THING_FIELDS:
        state = "thing_id" if own else "thing"
    elif names & set(ID_NAMES[:2]):
        state = "named" if own else "object"
    elif "graph" in names and kids["graph"].state == "graph":
        state = "scene"
    elif len(names) == 1 and next(iter(kids.values())).state in ("scene", "wrapper"):
        state = "wrapper"
    elif all(k.state in THINGS for k in kids.values()):
        state = "thing_map"
    else:
        state = "object"
    return Node(state, None, kids, own)


CLASSIFY: dict[type, Callable[[object], Node]] = {
    dict: _object,
    list: _list,
    str: _text,
    int: lambda v: Node("number", v),
    float: lambda v: Node("number", v),
    bool: lambda v: Node("bool", v),
    type(None): lambda v: NOTHING,
}


def _written(text: str):
    """The list or map written into a text, as JSON in any number of layers or as a Python literal; None if it holds none."""
    out = text
    while isinstance(out, str):  # every layer is shorter than the one around it
        try:
            out = json.loads(out)
        except (ValueError, RecursionError):
            break
    if isinstance(out, (list, dict)):
        return out
    if text[0] == '"':
        return None
    try:
        out = ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return None
    return _plain(out) if isinstance(out, (list, dict, tuple)) else None


def _plain(value):
    """A Python literal as a JSON value."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_plain(v) for v in value]
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def _real(text) -> float | None:
    try:
        x = float(text)
    except (TypeError, ValueError, OverflowError):
        return None
    return x if math.isfinite(x) else None


# What is made of a node in a role, by its state.

Rule = Callable[[Node], object]


def _as_id(node: Node) -> str | None:
    """Role id: a text that isn't blank, or a whole number."""
    if node.state in TEXTS:
        return node.raw
    return str(node.raw) if node.state == "number" and isinstance(node.raw, int) else None


NUMBERS: dict[str, Rule] = {
    **{f"vector_array_{n}": lambda v: [_real(k.raw) for k in v.kids] for n in (3, 4)},
    **{f"vector_object_{n}": lambda v, n=n: [_real(v.kids[c].raw) if v.kids[c].state != "bool" else None for c in "xyzw"[:n]] for n in (3, 4)},
    **{f"vector_text_{n}": lambda v: [float(p) for p in v.raw.replace(",", " ").split()] for n in (3, 4)},
}


def vector(node: Node) -> list[float] | None:
    """Role vector: three or four numbers."""
    rule = NUMBERS.get(node.state)
    out = rule(node) if rule else None
    return out if out and all(x is not None for x in out) else None


def _leaf_text(node: Node) -> str | None:
    if node.written or node.state in TEXTS:
        return node.raw
    return str(node.raw) if node.state == "number" else None


def _texts_of(kids: Iterator[Node]) -> list[str]:
    return [t for t in ((_leaf_text(k) or "").strip() for k in kids) if t]


STRINGS: dict[str, Rule] = {
    **{s: lambda v: [v.raw.strip()] for s in TEXTS},
    **{s: lambda v: _texts_of(v.kids) for s in ARRAYS},
    **{s: lambda v: [k for k in v.kids if k.strip()] for s in (*THINGS, "link", "graph", "scene", "wrapper", "vector_object_3", "vector_object_4")},
}


def strings(node: Node) -> list[str]:
    """Role strings: the non-blank texts of a list, of one text, or of a map's keys; numbers become text."""
    rule = STRINGS.get(node.state)
    return rule(node) if rule else []


def _entries(node: Node) -> Iterator[tuple[str | None, Node]]:
    return ((k, body) for k, body in node.kids.items() if k.strip())


def _elements(node: Node) -> Iterator[tuple[str | None, Node]]:
    for kid in node.kids:
        rule = ELEMENT.get(kid.state)
        if rule is not None:
            yield rule(kid)


def _sole(node: Node) -> tuple[str | None, Node]:
    """An element {id: thing}; any other object has no id."""
    if len(node.kids) == 1 and not node.id:
        key, body = next(iter(node.kids.items()))
        if body.state in THINGS and key.strip():
            return key, body
    return node.id, node


ELEMENT: dict[str, Rule] = {
    **{s: lambda v: (v.id, v) for s in NAMED},
    **{s: _sole for s in ("thing", "object", "thing_map", "empty_object")},
    **{s: lambda v: (v.raw, NOTHING) for s in TEXTS},
}
CHILDREN: dict[str, Rule] = {
    **{s: lambda v: iter([(v.id, v)]) for s in NAMED},
    **{s: _entries for s in ("thing", "object", "thing_map", "empty_object", "graph", "link", "scene", "wrapper")},
    **{s: _elements for s in ARRAYS},
}


def things(node: Node) -> Iterator[tuple[str | None, Node]]:
    """Role things: (id, body) of a map, a list or a single one; the id is None where a thing has none."""
    rule = CHILDREN.get(node.state)
    return rule(node) if rule else iter(())


def truth(node: Node) -> bool | None:
    """Role truth: true or false in any form; None if the value says neither."""
    if node.state == "text":
        word = node.raw.strip().lower()
        return True if word in ("true", "yes", "1", "t", "y", "on") else False if word in ("false", "no", "0", "f", "n", "off") else None
    if node.state in ("bool", "number"):
        return True if node.raw == 1 else False if node.raw == 0 else None
    return None


END: dict[str, Rule] = {**{s: _as_id for s in (*TEXTS, "number")}, **{s: lambda v: v.id for s in (*NAMED, "thing", "object")}}
ENDS: dict[str, Rule] = {
    "link": lambda v: next((v.kids[a], v.kids[b]) for a, b in LINK_ENDS if a in v.kids and b in v.kids),
    **{s: lambda v: tuple(v.kids[:2]) for s in ARRAYS},
}


def link_ends(node: Node) -> tuple[str, str] | None:
    """Role link: (source, target)."""
    rule = ENDS.get(node.state)
    ends = [END[e.state](e) for e in (rule(node) if rule else ()) if e.state in END]
    return (ends[0], ends[1]) if len(ends) == 2 and all(e and e.strip() for e in ends) else None


INWARD: dict[str, Rule] = {
    "wrapper": lambda v: v.kids[0] if not isinstance(v.kids, _Fields) else v.kids["scene_info"] if "scene_info" in v.kids else next(iter(v.kids.values())),
}


def scene_of(node: Node) -> Node | None:
    """Role root: the scene within its wrappers; None if there is none."""
    while node.state in INWARD:
        node = INWARD[node.state](node)
    return node if node.state == "scene" else None


def _field(node: Node, name: str) -> Node:
    return node.kids.get(name, NOTHING) if isinstance(node.kids, _Fields) else NOTHING


# Rows: (scene_uid, scene_id, kind, parent_id, node_id, depth, ordinal, variant, x, y, z, w, orientation, usd, semantic_name, full_description, keywords, directed, reason)
NODE_ROW = (
    "scene_uid long, scene_id string, kind string, parent_id string, node_id string, depth int, ordinal int, variant string, "
    "x double, y double, z double, w double, orientation array<double>, usd string, semantic_name string, full_description string, keywords array<string>, directed boolean, reason string"
)
COLUMNS = [c.strip().split(" ")[0] for c in NODE_ROW.split(", ")]
NARROW = ("scene_uid", "kind", "parent_id", "node_id", "variant")


def record_rows(uid: int, scene_id: str | None, text: str | None, wide: bool = True) -> Iterator[dict]:
    """The typed rows of one record; narrow ones hold ids and variants only."""
    base = {"scene_uid": uid, "scene_id": scene_id}
    if text is None or not text.strip():
        yield base | {"kind": "unparsed", "variant": "none", "reason": "null" if text is None else "blank"}
        return
    try:
        yield from list(_scene_rows(base, json.loads(text), wide))
    except (ValueError, RecursionError) as e:  # the whole record, however far it was read
        yield base | {"kind": "unparsed", "variant": "none", "reason": "cut off or no JSON" if isinstance(e, ValueError) else "nested too deeply"}


def _scene_rows(base: dict, value, wide: bool) -> Iterator[dict]:
    scene = scene_of(classify(value))
    if scene is None:
        yield base | {"kind": "unparsed", "variant": "none", "reason": "no scene"}
        return
    root = base["scene_id"] if base["scene_id"] is not None else _leaf_text(_field(scene, "scene_id"))
    yield from _thing_rows(base, _field(scene, "layout"), root, wide)
    relations = _field(scene, "relations")
    graph = _field(relations, "graph")
    yield from _graph_rows(base, graph if graph.state != "null" else relations if relations.state == "graph" else _field(scene, "graph"))


def _thing_rows(base: dict, found: Node, root: str | None, wide: bool) -> Iterator[dict]:
    stack = [(root, 1, i, key, body, "object") for i, (key, body) in enumerate(things(found))]
    while stack:
        parent, depth, i, key, body, kind = stack.pop()
        if key is None:
            key, kind = f"#{i}", "unnamed"
        position = _field(body, "xyz")
        xyz = vector(position)
        variant = "none" if xyz is None else "literal" if position.written else position.state
        row = base | {"kind": kind, "parent_id": parent, "node_id": key, "variant": variant}
        if wide:
            about = _field(body, "description")
            said = lambda name: next(iter(strings(_field(about, name))), None)  # noqa: B023, E731
            row |= dict(zip("xyzw", xyz or ())) | {
                "depth": depth, "ordinal": i, "orientation": vector(_field(body, "xyzw")), "usd": _field(body, "usd").raw if _field(body, "usd").state == "text" else None,
                "semantic_name": said("semantic_name"), "full_description": said("full_description") if isinstance(about.kids, _Fields) else next(iter(strings(about)), None),
                "keywords": strings(_field(body, "keywords")),
            }
        yield row
        tags = _field(body, "tags")
        for j, tag in enumerate(strings(tags)):
            yield base | {"kind": "tag" if kind == "object" else kind, "parent_id": key, "node_id": tag, "depth": depth, "ordinal": j, "variant": tags.state}
        stack.extend((key, depth + 1, j, k, b, kind) for j, (k, b) in enumerate(things(_field(body, "parts"))))


def _graph_rows(base: dict, graph: Node) -> Iterator[dict]:
    directed = truth(_field(graph, "directed"))
    for name in LINK_NAMES:
        links = _field(graph, name)
        for i, link in enumerate(links.kids if links.state in ARRAYS else ()):
            ends = link_ends(link)
            if ends:
                a, b = sorted(ends) if directed is False else ends
                yield base | {"kind": "link", "parent_id": a, "node_id": b, "ordinal": i, "variant": link.state, "directed": directed}
    nodes = _field(graph, "nodes")
    for i, node in enumerate(nodes.kids if nodes.state in ARRAYS else ()):
        key = END[node.state](node) if node.state in END else None
        if key:
            yield base | {"kind": "node", "node_id": key, "ordinal": i, "variant": node.state}


def _parse(batches: Iterator[pa.RecordBatch], columns: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    wide = len(columns) > len(NARROW)

    def emit(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        rows: list[dict] = []
        for uid, scene_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            rows.extend(record_rows(uid, scene_id, text, wide))
            if len(rows) > 20_000:
                yield emit(rows)
                rows = []
        if rows:
            yield emit(rows)


def scene_nodes(records: DataFrame, wide: bool = True) -> DataFrame:
    """The typed rows of all records; narrow ones hold ids and variants only."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    want = COLUMNS if wide else list(NARROW)
    kinds = {c.strip().split(" ")[0]: c.strip() for c in NODE_ROW.split(", ")}
    ddl = ", ".join(kinds[c] for c in want)
    schema = to_arrow_schema(_parse_datatype_string(ddl))
    return records.select("scene_uid", "scene_id", "scene_info").mapInArrow(lambda it: _parse(it, want, schema), ddl)


def scene_tables(records: DataFrame, wide: bool = True) -> dict[str, DataFrame]:
    """The related tables: objects (supertype), objects_<variant> (subtypes), tags, links, nodes, unnamed, unparsed.

    Every record is parsed once; the rows are written to the shared folder, each
    to its table's own part, and the tables read only that.
    """
    spark = records.sparkSession
    rows = scene_nodes(records, wide)
    route = F.when(F.col("kind") == "object", F.concat(F.lit("objects_"), "variant")).otherwise(F.concat("kind", F.lit("s")))
    path = scratch_path(spark, "scenes")
    rows.withColumn("route", route).write.partitionBy("route").parquet(path)
    written = spark.read.schema(rows.withColumn("route", route).schema).option("basePath", path).parquet(path)
    part = lambda name: written.where(F.col("route") == name)
    key = ["scene_uid", "parent_id", "node_id"]
    common = [c for c in ("scene_id", "depth", "ordinal", "variant", "usd", "semantic_name", "full_description", "keywords", "orientation") if c in rows.columns]
    objects = written.where(F.col("route").isin(*[f"objects_{v}" for v in SUBTYPES]))
    out = {
        "objects": objects.select(*key, *common).withColumn("variant", F.concat(F.lit("xyz_"), "variant")),
        "tags": part("tags").select("scene_uid", F.col("parent_id").alias("object_id"), F.col("node_id").alias("tag"), *[c for c in ("ordinal", "variant") if c in rows.columns]),
        "links": part("links").select("scene_uid", F.col("parent_id").alias("source"), F.col("node_id").alias("target"), *[c for c in ("directed", "variant") if c in rows.columns]),
        "nodes": part("nodes").select("scene_uid", "node_id"),
        "unnamed": part("unnameds").select(*key, "variant"),
        "unparsed": part("unparseds").select("scene_uid", *[c for c in ("scene_id", "reason") if c in rows.columns]),
    }
    for v in SUBTYPES:
        numbers = [] if v == "none" or not wide else list("xyzw") if v.endswith("4") else list("xyz")
        out[f"objects_{v}"] = part(f"objects_{v}").select(*key, *numbers)
    return out


def scene_links(records: DataFrame) -> DataFrame:
    """(scene_uid, link_kind, parent_id, child_id): the distinct parent links of the related tables; link_kind is layout, tag or graph."""
    t = scene_tables(records, wide=False)
    as_link = lambda df, kind, a, b: df.select("scene_uid", F.lit(kind).alias("link_kind"), F.col(a).alias("parent_id"), F.col(b).alias("child_id"))
    parts = (as_link(t["objects"], "layout", "parent_id", "node_id"), as_link(t["tags"], "tag", "object_id", "tag"), as_link(t["links"], "graph", "source", "target"))
    return reduce(DataFrame.unionByName, parts).distinct()
