"""Leaves of the task-success rule trees, registered by operator for ``rules.named_leaf``.

Arguments come as texts in the order in which a task file separates them by
``|``. A frame is a struct with ``tick``, ``elapsed`` (seconds) and what its
leaves need: maps ``objects`` (name to xyz, q as w x y z, and the box low, high),
``grippers`` (xyz), ``joints`` (name to an array of positions), ``particles``,
``stains``, ``triggers`` and ``scores``, and ``base`` (x, y, yaw in degrees).

A leaf sees the frames from its start on. ``{@...}`` in place of a name stands
for the object that an earlier leaf matched; of several names separated by commas
the first match counts. What is missing from a frame doesn't hold in it.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinelake.functions import geom as g
from kinelake.operators.rules import LEAVES, once

Test = Callable[[Column, Column], Column]  # (frame, object's name) -> does it hold


@dataclass
class Leaf:
    """``tick(frames, name)`` is the first tick at which the leaf is done with one object; ``names`` are the objects it may match."""

    tick: Callable[[Column, Column], Column]
    names: Sequence[str] = ("",)
    terminal: bool = False

    def first(self, frames: Column, bound: Column) -> Column:
        name = lambda n: bound if n.startswith("{@") else F.lit(n)
        found = lambda n, place: lambda t: F.struct(t.alias("at"), F.lit(place).alias("place"), name(n).alias("bound"))
        each = [once(self.tick(frames, name(n)), found(n, i)) for i, n in enumerate(self.names)]
        # of equal ticks the name that stands first
        best = F.array_min(F.filter(F.array(*each), lambda x: x["at"].isNotNull()))
        return once(best, lambda b: F.struct(b["at"].alias("at"), F.nullif(b["bound"], F.lit("")).alias("bound")))


def leaf(op: str) -> Callable:
    def put(build: Callable[..., Leaf]) -> Callable[..., Leaf]:
        LEAVES[op] = build
        return build

    return put


def names_of(text: str) -> list[str]:
    return [n.strip() for n in text.split(",") if n.strip()]


def numbers(text: str) -> list[float]:
    """'[1,2]' or '1,2'."""
    return [float(x) for x in text.strip().strip("[]()").split(",")]


def hit(test: Test, times: int = 1) -> Callable[[Column, Column], Column]:
    """The tick of the ``times``-th frame for which the test holds; the count never resets."""
    return lambda frames, name: F.try_element_at(F.filter(frames, lambda f: F.coalesce(test(f, name), F.lit(False))), F.lit(times))["tick"]


def held(test: Test, frames_in_a_row: int) -> Callable[[Column, Column], Column]:
    """The tick at which the test has held for so many frames in a row."""

    def tick(frames: Column, name: Column) -> Column:
        def step(acc: Column, f: Column) -> Column:
            run = F.when(F.coalesce(test(f, name), F.lit(False)), acc["run"] + 1).otherwise(0)
            return once(run, lambda r: F.struct(r.alias("run"), F.coalesce(acc["at"], F.when(r >= frames_in_a_row, f["tick"])).alias("at")))

        none = F.get(F.slice(frames, 1, 0), F.lit(0))["tick"]
        return F.aggregate(frames, F.struct(F.lit(0).alias("run"), none.alias("at")), step)["at"]

    return tick


def since_start(test: Callable[[Column, Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """As ``hit``, with the first frame as a third argument."""
    return lambda frames, name: once(F.try_element_at(frames, F.lit(1)), lambda first: F.try_element_at(F.filter(frames, lambda f: F.coalesce(test(f, name, first), F.lit(False))), F.lit(1))["tick"])


def thing(frame: Column, name: Column | str) -> Column:
    return F.try_element_at(frame["objects"], F.lit(name) if isinstance(name, str) else name)


def vec(a: Column, n: int = 3) -> g.Vec:
    return tuple(a[i] for i in range(n))


def spot(frame: Column, name: Column | str) -> g.Vec:
    return vec(thing(frame, name)["xyz"])


def hand(frame: Column, gripper: str) -> g.Vec:
    return vec(F.try_element_at(frame["grippers"], F.lit(gripper))["xyz"])


def area(low: Column, high: Column) -> Column:
    return (high[0] - low[0]) * (high[1] - low[1])


def shared(a: Column, b: Column) -> Column:
    """Area that two boxes share, seen from above."""
    return g.overlap_1d(a["low"][0], a["high"][0], b["low"][0], b["high"][0]) * g.overlap_1d(a["low"][1], a["high"][1], b["low"][1], b["high"][1])


@leaf("Inside")
def inside(obj: str, box: str, factor: str) -> Leaf:
    def test(f: Column, name: Column) -> Column:
        b = thing(f, box)
        return g.in_box(spot(f, name), *g.scaled_box(vec(b["low"]), vec(b["high"]), float(factor)))

    return Leaf(held(test, 2), names_of(obj))


@leaf("InBBox")
def in_bbox(obj: str, centre: str, size: str) -> Leaf:
    c, n = numbers(centre), numbers(size)
    low, high = [x - s / 2 for x, s in zip(c, n)], [x + s / 2 for x, s in zip(c, n)]
    return Leaf(held(lambda f, name: g.in_box(spot(f, name), low, high), 2), names_of(obj))


@leaf("Ontop")
def ontop(obj: str, base: str) -> Leaf:
    """Standing on the base's top, with half of the larger face shared."""

    def test(f: Column, name: Column) -> Column:
        a, b = thing(f, name), thing(f, base)
        return (F.abs(a["low"][2] - b["high"][2]) <= 0.02) & (F.try_divide(shared(a, b), F.greatest(area(a["low"], a["high"]), area(b["low"], b["high"]))) >= 0.5)

    return Leaf(hit(test), names_of(obj))


@leaf("Cover")
def cover(obj: str, base: str) -> Leaf:
    """The centre no higher than the base's top, with half of the smaller face shared."""

    def test(f: Column, name: Column) -> Column:
        a, b = thing(f, name), thing(f, base)
        return (a["xyz"][2] - b["high"][2] <= 0.002) & (F.try_divide(shared(a, b), F.least(area(a["low"], a["high"]), area(b["low"], b["high"]))) >= 0.5)

    return Leaf(hit(test), names_of(obj))


@leaf("Onfloor")
def onfloor(obj: str, height: str) -> Leaf:
    """Fallen to the floor: ends the evaluation."""
    return Leaf(hit(lambda f, name: F.abs(thing(f, name)["xyz"][2] - float(height)) < 0.3), names_of(obj), terminal=True)


@leaf("Follow")
def follow(objs: str, size: str, gripper: str) -> Leaf:
    """The gripper is in the axis-parallel box around an object's turned box; the object is bound."""

    def test(f: Column, name: Column) -> Column:
        o = thing(f, name)
        return g.in_box(hand(f, gripper), *g.box_of_rotated(vec(o["xyz"]), numbers(size), g.q_matrix(vec(o["q"], 4))))

    return Leaf(hit(test), names_of(objs))


@leaf("PickUpOnGripper")
def pick_up(obj: str, gripper: str) -> Leaf:
    return Leaf(since_start(lambda f, name, first: (spot(f, name)[2] - spot(first, name)[2] > 0.02) & (g.distance(spot(f, name), hand(f, gripper)) < 0.1)), names_of(obj))


@leaf("LiftUp")
def lift_up(obj: str, rise: str) -> Leaf:
    return Leaf(since_start(lambda f, name, first: spot(f, name)[2] - spot(first, name)[2] >= float(rise)), names_of(obj))


@leaf("Upright")
def upright(obj: str, degrees: str) -> Leaf:
    """The turned y axis within so many degrees of the vertical."""
    up = lambda f, name: g.m_apply(g.q_matrix(vec(thing(f, name)["q"], 4)), g.axis_vector("y"))[2]
    return Leaf(hit(lambda f, name: up(f, name) >= F.cos(F.radians(F.lit(float(degrees))))), names_of(obj))


@leaf("StableGrasp")
def stable_grasp(obj: str, gripper: str) -> Leaf:
    return Leaf(held(lambda f, name: g.distance(spot(f, name), hand(f, gripper)) < 0.1, 2), names_of(obj))


@leaf("PushPull")
def push_pull(obj: str, low: str, high: str, joint: str = "0") -> Leaf:
    return Leaf(hit(lambda f, name: F.try_element_at(F.try_element_at(f["joints"], name), F.lit(int(joint) + 1)).between(float(low), float(high)), 2), names_of(obj))


@leaf("OnShelf")
def on_shelf(obj: str, target: str, bbox: str, height: str) -> Leaf:
    """Strictly within a box about the target, its height above ``height``, on more than five frames."""
    x0, x1, y0, y1, z0, z1 = (float(v) for v in ast.literal_eval(bbox))

    def test(f: Column, name: Column) -> Column:
        (x, y, z), (tx, ty, _) = spot(f, name), spot(f, target)
        strictly = lambda v, a, b: (v > a) & (v < b)
        return strictly(x - tx, x0, x1) & strictly(y - ty, y0, y1) & strictly(z - float(height), z0, z1)

    return Leaf(hit(test, 6), names_of(obj))


@leaf("ChassisAtTarget")
def chassis_at_target(target: str, threshold: str) -> Leaf:
    (x, y, yaw), (dx, dy, turn) = numbers(target), numbers(threshold)
    near = lambda f, _: (F.abs(f["base"]["x"] - x) <= dx) & (F.abs(f["base"]["y"] - y) <= dy) & (F.abs(g.wrap_degrees(f["base"]["yaw"] - yaw)) <= turn)
    return Leaf(hit(near))


@leaf("Approach")
def approach(x: str, y: str, z: str) -> Leaf:
    """The gripper named right within 0.01 of a point, by axis."""
    aim = (float(x), float(y), float(z))
    return Leaf(hit(lambda f, _: F.greatest(*[F.abs(c - a) for c, a in zip(hand(f, "right"), aim)]) < 0.01))


@leaf("GripperPassing")
def gripper_passing(obj: str, reverse: str = "false") -> Leaf:
    """The object goes from the left gripper to the right one (the other way if reversed). Closed grippers hold it if the line between the two crosses its box."""
    order = ("right", "left") if reverse.strip().lower() == "true" else ("left", "right")

    def tick(frames: Column, name: Column) -> Column:
        def step(acc: Column, f: Column) -> Column:
            o = thing(f, name)
            across = g.segment_hits_box(hand(f, "left"), hand(f, "right"), vec(o["low"]), vec(o["high"]))
            first, second = (F.coalesce(across & (F.try_element_at(f["joints"], F.lit(w))[0] < 0.3), F.lit(False)) for w in order)
            given = (acc["state"].isin(1, 2)) & ~first & second
            state = F.when(given, 3).when(first & second, 2).when(first, 1).when(second & (acc["state"] == 2), 2).otherwise(0)
            return F.struct(state.alias("state"), F.coalesce(acc["at"], F.when(given, f["tick"])).alias("at"))

        none = F.get(F.slice(frames, 1, 0), F.lit(0))["tick"]
        return F.aggregate(frames, F.struct(F.lit(0).alias("state"), none.alias("at")), step)["at"]

    return Leaf(tick, names_of(obj))


def within_count(points: Column, low: g.Vec, high: g.Vec) -> Column:
    return F.size(F.filter(points, lambda p: g.in_box(vec(p), low, high)))


@leaf("CheckParticleInBBox")
def few_particles(count: str, box: str) -> Leaf:
    """Fewer than so many particles within a box (three lower, three upper bounds)."""
    b = numbers(box)
    return Leaf(hit(lambda f, _: within_count(f["particles"], b[:3], b[3:]) < int(count)))


@leaf("FluidInside")
def fluid_inside(folder: str, obj: str) -> Leaf:
    """More than fifty particles within an object's box."""
    return Leaf(hit(lambda f, name: within_count(f["particles"], vec(thing(f, name)["low"]), vec(thing(f, name)["high"])) > 50), names_of(obj))


@leaf("CheckStainClean")
def stain_clean(prim: str, count: str) -> Leaf:
    return Leaf(hit(lambda f, _: F.try_element_at(f["stains"], F.lit(prim)) < int(count)))


@leaf("TriggerAction")
def trigger(prim: str, response: str) -> Leaf:
    return Leaf(hit(lambda f, _: F.try_element_at(f["triggers"], F.lit(prim)) == response))


@leaf("Pass2People")
def pass_to_people(obj: str, y: str) -> Leaf:
    return Leaf(hit(lambda f, name: F.abs(spot(f, name)[1] - spot(f, "people")[1]) < float(y)), names_of(obj))


@leaf("VLM")
def outside_score(task: str, interval: str) -> Leaf:
    """A score that an outside model gave, read every so many frames: done at 1."""

    def tick(frames: Column, _: Column) -> Column:
        read = F.filter(frames, lambda f, i: ((i + 1) % int(interval) == 0) & (F.coalesce(F.try_element_at(f["scores"], F.lit(task)), F.lit(0.0)) >= 1))
        return F.try_element_at(read, F.lit(1))["tick"]

    return Leaf(tick)


@leaf("Timeout")
def timeout(seconds: str) -> Leaf:
    return Leaf(since_start(lambda f, _, first: f["elapsed"] - first["elapsed"] >= float(seconds)), terminal=True)


@leaf("StepOut")
def step_out(steps: str) -> Leaf:
    """More than so many frames: ends the evaluation."""
    return Leaf(lambda frames, _: F.try_element_at(frames, F.lit(int(steps) + 1))["tick"], terminal=True)


@leaf("ActionWaitForTime")
def wait(seconds: str) -> Leaf:
    return Leaf(since_start(lambda f, _, first: f["elapsed"] - first["elapsed"] >= float(seconds)))
