"""Declarative rules as column expressions: ordered filter chains and the task-success rule trees.

A filter chain is a list of (name, params, result code); the first failing rule
decides. A rule tree is JSON with one key a node: leaves with arguments
separated by ``|``, combinators ActionList (in order), ActionSetWaitAny (or),
ActionSetWaitAll (and) and ActionSetWaitSome_k (k of n). Leaves become boolean
columns over an episode's frames; a tree becomes the tick at which it is
satisfied, with distinct ticks counted once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Leaf = Callable[[Sequence[str]], Column]
#: Filter rules by name, and builders of tree leaves (arguments -> leaf) by operator.
REGISTRY: dict[str, Callable[..., Column]] = {}
LEAVES: dict[str, Callable[..., object]] = {}


def rule(name: str) -> Callable:
    """Registers a column builder (params) -> Column under a rule's name; ``episode_rules`` and ``tree_leaves`` fill the registries."""

    def put(f: Callable[..., Column]) -> Callable[..., Column]:
        REGISTRY[name] = f
        return f

    return put


def filter_chain(rules: Sequence[Mapping], registry: Mapping[str, Callable[..., Column]] | None = None) -> Column:
    """Struct (valid, result_code, status) of the first failing rule; code 0 where all hold. Null counts as failing.

    ``rules`` are the entries of a filter file's filter_rules. Raises KeyError for an unknown rule.
    """
    known = REGISTRY if registry is None else registry
    out = None
    for r in reversed(list(rules)):
        ok = F.coalesce(known[r["rule_name"]](**r.get("params", {})), F.lit(False))
        bad = F.struct(F.lit(False).alias("valid"), F.lit(int(r.get("result_code", 1))).alias("result_code"), F.lit(r["rule_name"]).alias("status"))
        rest = out if out is not None else F.struct(F.lit(True).alias("valid"), F.lit(0).alias("result_code"), F.lit("ok").alias("status"))
        out = F.when(~ok, bad).otherwise(rest)
    return out if out is not None else F.struct(F.lit(True).alias("valid"), F.lit(0).alias("result_code"), F.lit("ok").alias("status"))


@dataclass
class Node:
    """A node of a rule tree: its operator, arguments and children, and its place in the tree."""

    op: str
    args: list[str] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)
    path: str = "0"


COMBINATORS = ("ActionList", "ActionSetWaitAny", "ActionSetWaitAll", "ActionSetWaitSome")


def parse_tree(source: str | Mapping, path: str = "0") -> Node:
    """The tree of a JSON rule. Raises ValueError for a node that isn't one operator."""
    value = json.loads(source) if isinstance(source, str) else source
    if not isinstance(value, Mapping) or len(value) != 1:
        raise ValueError(f"a rule node has one key: {value!r}")
    op, body = next(iter(value.items()))
    if op.startswith(COMBINATORS):
        if not isinstance(body, list):
            raise ValueError(f"{op} needs a list")
        return Node(op, [], [parse_tree(b, f"{path}.{i}") for i, b in enumerate(body)], path)
    return Node(op, split_args(str(body)), [], path)


def parse_task(source: str | Mapping) -> Node:
    """The tree of a task file: its problem's acts, one after another. Raises ValueError where there is no problem with acts."""
    value = json.loads(source) if isinstance(source, str) else source
    problem = next((v for v in value.values() if isinstance(v, Mapping) and "Acts" in v), None)
    if problem is None:
        raise ValueError("a task file has a problem with Acts")
    return parse_tree({"ActionList": problem["Acts"]})


def named_leaf(node: Node) -> object:
    """The registered leaf of a node. Raises ValueError for an unknown operator."""
    if node.op not in LEAVES:
        raise ValueError(f"unknown rule {node.op!r}")
    return LEAVES[node.op](*node.args)


def split_args(text: str) -> list[str]:
    """'a|b|[1,2,3]' as its parts."""
    return [p.strip() for p in text.split("|")]


def some_count(op: str) -> int:
    """k of ActionSetWaitSome_k; 1 where it says none."""
    tail = op.rpartition("_")[2]
    return int(tail) if tail.isdigit() else 1


def flatten(node: Node) -> list[tuple[str, str | None, str, str]]:
    """(node id, parent id, operator, arguments) of a tree, ids by position."""
    out = [(node.path, node.path.rpartition(".")[0] or None, node.op, "|".join(node.args))]
    for c in node.children:
        out += flatten(c)
    return out


def reached(node: Node, ticks: Column, leaf: Callable[[Node], object], state: Column) -> Column:
    """Struct (at, cancel, bound) of a tree that starts at ``state.at``.

    at is the first tick at which the tree is satisfied, cancel the one at which
    a terminal leaf (a fall, a timeout, too many steps) ended it before that;
    both are null if neither happens. bound is the name of the object that the
    last matching leaf found, for the placeholders of later leaves.

    ``ticks`` is an episode's array of frames in order, each with a field
    ``tick``. ``leaf(node)`` gives a condition on one frame, or an object with
    ``first(frames from the start on, bound) -> struct (at, bound)`` and
    ``terminal``. A sequence's child starts where the one before it ended, so
    everything happens within one array expression; no join per step is needed.
    """
    none, no_name = F.get(F.slice(ticks, 1, 0), F.lit(0))["tick"], F.lit(None).cast("string")
    make = lambda at, cancel, bound: F.struct(at.alias("at"), cancel.alias("cancel"), bound.alias("bound"))
    if not node.op.startswith(COMBINATORS):
        test = leaf(node)
        rest = F.filter(ticks, lambda f: f["tick"] >= state["at"])
        if not hasattr(test, "first"):
            at = F.try_element_at(F.filter(rest, lambda f: F.coalesce(test(f), F.lit(False))), F.lit(1))["tick"]
            return make(at, none, state["bound"])
        hit = lambda h: make(none, h["at"], state["bound"]) if test.terminal else make(h["at"], none, F.coalesce(h["bound"], state["bound"]))
        return once(once(rest, lambda w: test.first(w, state["bound"])), hit)
    if node.op == "ActionList":
        for c in node.children:
            state = once(state, _next(c, ticks, leaf, make, none, no_name))
        return state
    k = 1 if node.op == "ActionSetWaitAny" else len(node.children) if node.op == "ActionSetWaitAll" else some_count(node.op)
    kids = F.array(*[reached(c, ticks, leaf, state) for c in node.children])

    def decide(all_: Column) -> Column:
        ends = F.array_sort(F.transform(F.filter(all_, lambda x: x["at"].isNotNull()), lambda x: F.struct(x["at"].alias("at"), x["bound"].alias("bound"))))
        at, bound = F.try_element_at(ends, F.lit(k))["at"], F.try_element_at(ends, F.lit(1))["bound"]
        cancel = F.array_min(F.transform(all_, lambda x: x["cancel"]))
        ended = cancel.isNotNull() & (at.isNull() | (cancel < at))
        return make(F.when(~ended, at), F.when(ended, cancel), F.when(~ended, bound))

    return once(kids, decide)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _next(node: Node, ticks: Column, leaf: Callable[[Node], object], make, none: Column, no_name: Column) -> Callable[[Column], Column]:
    """A sequence's step: nothing follows what was never satisfied or was cancelled."""
    return lambda s: F.when(s["at"].isNotNull(), reached(node, ticks, leaf, s)).otherwise(make(none, s["cancel"], no_name))


def start_state(ticks: Column, start: Column) -> Column:
    return F.struct(start.alias("at"), F.get(F.slice(ticks, 1, 0), F.lit(0))["tick"].alias("cancel"), F.lit(None).cast("string").alias("bound"))


def satisfied_tick(node: Node, ticks: Column, leaf: Callable[[Node], object], start: Column) -> Column:
    """The first tick at or after ``start`` at which the tree is satisfied, null if never."""
    return reached(node, ticks, leaf, start_state(ticks, start))["at"]


def evaluate_tree(frames: DataFrame, tree: Node, leaf: Callable[[Node], object], episode: str, tick: str, columns: Sequence[str], timeout: int | None = None) -> DataFrame:
    """(episode, satisfied_at, outcome): outcome is done, cancelled, timeout or open.

    An episode's frames are one bounded array (one evaluation run). A timeout
    is a terminal tick: what would be satisfied after it isn't.
    """
    packed = frames.groupBy(episode).agg(F.sort_array(F.collect_list(F.struct(F.col(tick).alias("tick"), *columns))).alias("frames"))
    return tree_outcomes(packed, tree, leaf, [episode], timeout)


def tree_outcomes(episodes: DataFrame, tree: Node, leaf: Callable[[Node], object], keep: Sequence[str], timeout: int | None = None) -> DataFrame:
    """The same for episodes whose ordered frames are an array column ``frames``."""
    first = F.element_at("frames", 1)["tick"]
    # a generator keeps the projection below from working the tree out once for every use of its result
    packed = episodes.select(*keep, "frames", F.explode(F.array(reached(tree, F.col("frames"), leaf, start_state(F.col("frames"), first)))).alias("__r"))
    at = F.col("__r.at")
    late = (at > first + timeout) if timeout is not None else F.lit(False)
    ended = F.element_at("frames", -1)["tick"] > first + timeout if timeout is not None else F.lit(False)
    return packed.select(
        *keep,
        F.when(at.isNotNull() & ~late, at).alias("satisfied_at"),
        F.when(at.isNotNull() & ~late, "done").when(F.col("__r.cancel").isNotNull(), "cancelled").when(late | ended, "timeout").otherwise("open").alias("outcome"),
    )
