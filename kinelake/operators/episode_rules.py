"""Filter rules over recorded episodes, registered by name for ``rules.filter_chain``.

An episode is a row with an array column ``frames`` in time order and a map
column ``cameras``. A frame has maps ``objects``, ``cameras``, ``ee`` and
``ee_center`` from a name to a struct with a 4 x 4 ``pose`` (rows), and
``robot.joints`` with ``joint_name`` and ``joint_position``. A rule only reads
the fields that it needs. Each is one JVM expression over the episode's array.

All frames are used, in order: rates of downsampling are taken as 1. Where an
object, camera or gripper that a rule needs is missing the rule is null, which
the chain counts as failing, unless the rule says otherwise. An episode without
frames fails.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinelake.functions import geom as g
from kinelake.operators.rules import once, rule

FRAMES, CAMERAS = "frames", "cameras"
KINDS = {"object": "objects", "camera": "cameras", "gripper": "ee"}


def all_of(tests: Sequence[Column]) -> Column:
    return reduce(and_, tests, F.lit(True))


def _pose(frame: Column, kind: str, name: str) -> Column:
    return F.try_element_at(frame[kind], F.lit(name))["pose"]


def _at(pose: Column) -> g.Vec:
    return tuple(pose[i][3] for i in range(3))


def _turn(pose: Column) -> g.Rot:
    return tuple(tuple(pose[i][j] for j in range(3)) for i in range(3))


def _rigid(pose: Column) -> g.Pose:
    return _turn(pose), _at(pose)


def _first() -> Column:
    return F.try_element_at(F.col(FRAMES), F.lit(1))


def _last() -> Column:
    return F.try_element_at(F.col(FRAMES), F.lit(-1))


def _within(p: g.Vec, low: Sequence[float], high: Sequence[float]) -> Column:
    return g.in_box(p, low, high)


@rule("is_object_reach_target")
def reach_target(objects: Sequence[str], target: str | Sequence[float], target_scope: Sequence[Sequence[float]]) -> Column:
    """In the last frame each object's offset from the target (an object's name or a point) lies within the scope of each axis."""
    if len(target_scope) != 3 or any(len(s) != 2 for s in target_scope):
        raise ValueError("target_scope is three pairs")
    if not isinstance(target, str) and len(target) != 3:
        raise ValueError("a target point has three coordinates")
    low, high = zip(*target_scope)

    def test(f: Column) -> Column:
        aim = _at(_pose(f, "objects", target)) if isinstance(target, str) else target
        return all_of([_within(g.sub(_at(_pose(f, "objects", o)), aim), low, high) for o in objects])

    return once(_last(), test)


@rule("is_object_pose_similar2start")
def similar_to_start(objects: Sequence[Sequence[str]], pos_threshold: Sequence[float] = (0.1, 0.1, 0.1), euler_threshold: Sequence[float] = (5, 5, 5), check_exist: bool = True) -> Column:
    """No object, camera or gripper ever leaves its first pose by more than the thresholds of position and of y-z-x angles.

    One that is missing from the first frame, or lies farther than 500 off, fails if ``check_exist``, else passes.
    """

    def one(kind: str, name: str) -> Column:
        def against(start: Column) -> Column:
            p0 = _at(start)
            e0 = g.euler_yzx(_turn(start))

            def near(f: Column) -> Column:
                pose = _pose(f, KINDS[kind], name)
                still = all_of([F.abs(a - b) <= t for a, b, t in zip(p0, _at(pose), pos_threshold)])
                return still & all_of([F.abs(a - b) <= t for a, b, t in zip(e0, g.euler_yzx(_turn(pose)), euler_threshold)])

            gone = start.isNull() | reduce(or_, [F.abs(c) > 500 for c in p0])
            return F.when(gone, F.lit(not check_exist)).otherwise(F.forall(F.slice(FRAMES, 2, F.greatest(F.size(FRAMES), F.lit(1))), near))

        return once(_pose(_first(), KINDS[kind], name), against)

    for kind, _ in objects:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
    return (F.size(FRAMES) > 0) & all_of([one(kind, name) for kind, name in objects])


def longest_run(frames: Column, flag) -> Column:
    """The longest run of frames for which the flag holds."""
    step = lambda a, f: once(F.when(flag(f), a["run"] + 1).otherwise(0), lambda r: F.struct(r.alias("run"), F.greatest(r, a["most"]).alias("most")))
    return F.aggregate(frames, F.struct(F.lit(0).alias("run"), F.lit(0).alias("most")), step)["most"]


def _seen(camera: str, at, limit: int, reverse: bool, zoom: float, size: tuple[Column, Column], centre: tuple[Column, Column]) -> Column:
    lens = F.try_element_at(F.col(CAMERAS), F.lit(camera))["intrinsic"]

    def seen(f: Column) -> g.Vec:
        return g.transform_point(g.pose_inverse(_rigid(_pose(f, "cameras", camera))), at(f))

    def out(f: Column) -> Column:
        x, y, z = seen(f)
        u, v = lens["fx"] * x / z / zoom + centre[0], lens["fy"] * y / z / zoom + centre[1]
        return ~((u >= 0) & (u < size[0]) & (v >= 0) & (v < size[1]))

    front = F.forall(FRAMES, lambda f: seen(f)[2] < 0 if reverse else seen(f)[2] > 0)
    return (F.size(FRAMES) > 0) & front & (longest_run(F.col(FRAMES), out) < limit)


def _limit(seconds: float, rate: int) -> int:
    return max(1, int(seconds * rate))


@rule("is_object_in_view")
def object_in_view(objects: Sequence[str], camera: str = "head", downsample_ratio: float = 1.0, refresh_rate: int = 30, out_view_allow_time: float = 0.5, camear_z_reverse: bool = True) -> Column:
    """Always before the camera, and never out of its image for longer than the time allowed; ``downsample_ratio`` is taken as 1."""
    lens = F.try_element_at(F.col(CAMERAS), F.lit(camera))["intrinsic"]
    size, centre = (lens["width"], lens["height"]), (lens["ppx"], lens["ppy"])
    see = lambda o: _seen(camera, lambda f: _at(_pose(f, "objects", o)), _limit(out_view_allow_time, refresh_rate), camear_z_reverse, 1.0, size, centre)
    return all_of([see(o) for o in objects])


@rule("is_gripper_in_view")
def gripper_in_view(gripper: str = "right", camera: str = "head", downsample_ratio: float = 1.0, refresh_rate: int = 30, out_view_allow_time: float = 0.5, camear_z_reverse: bool = True, zoom_factor: float = 1.05) -> Column:
    """The same for a gripper's centre, where a frame has one, else its end; the image is zoomed out."""
    lens = F.try_element_at(F.col(CAMERAS), F.lit(camera))["intrinsic"]
    at = lambda f: _at(F.coalesce(_pose(f, "ee_center", gripper), _pose(f, "ee", gripper)))
    return _seen(camera, at, _limit(out_view_allow_time, refresh_rate), camear_z_reverse, zoom_factor, (lens["width"], lens["height"]), (lens["ppx"], lens["ppy"]))


@rule("is_object_end_pose_up")
def end_pose_up(objects: Sequence[str], objects_up_axis: Sequence[str | Sequence[float]], thresholds: Sequence[float]) -> Column:
    """In the last frame each object's own up axis is within its threshold (radians) of the world's z axis."""

    def test(f: Column) -> Column:
        out = []
        for name, axis, most in zip(objects, objects_up_axis, thresholds):
            up = g.axis_vector(axis) if isinstance(axis, str) else axis
            turned = g.m_apply(_turn(_pose(f, "objects", name)), up)
            out.append(F.acos(g.clip(F.try_divide(turned[2], g.norm(turned)), -1, 1)) <= most)
        return all_of(out)

    return once(_last(), test)


@rule("is_object_end_higher_than_start")
def end_higher(objects: Sequence[str], delta_z: float = 0.08, tolerance: float = 0.03) -> Column:
    """Each object ends at least ``delta_z`` minus the tolerance above its start; one that isn't in the first frame passes."""

    def one(name: str) -> Column:
        start, end = _pose(_first(), "objects", name), _pose(_last(), "objects", name)
        return start.isNull() | (end[2][3] - start[2][3] >= delta_z - tolerance)

    return (F.size(FRAMES) > 0) & all_of([one(o) for o in objects])


@rule("is_objects_distance_greater_than")
def apart(objects: Sequence[str], min_distance: float = 0.3, check_frame: str = "last") -> Column:
    """No two of the objects are nearer than ``min_distance`` in the first, the last or all frames. The objects are those that the rule names, a few."""
    if len(objects) < 2:
        return F.lit(True)

    def test(f: Column) -> Column:
        at = [_at(_pose(f, "objects", o)) for o in objects]
        return all_of([g.distance(a, b) >= min_distance for i, a in enumerate(at) for b in at[i + 1 :]])

    if check_frame not in ("first", "last", "all"):
        raise ValueError("check_frame is first, last or all")
    return F.forall(FRAMES, test) & (F.size(FRAMES) > 0) if check_frame == "all" else once(_first() if check_frame == "first" else _last(), test)


@rule("is_object_end_in_region")
def end_in_region(objects: Sequence[str], region_center: Sequence[float], region_size: Sequence[float]) -> Column:
    low = [c - s / 2 for c, s in zip(region_center, region_size)]
    high = [c + s / 2 for c, s in zip(region_center, region_size)]
    return once(_last(), lambda f: all_of([_within(_at(_pose(f, "objects", o)), low, high) for o in objects]))


@rule("is_object_relative_position_in_target")
def relative_in_target(objects: Sequence[str], target: str, relative_position_range: Sequence[Sequence[float]]) -> Column:
    """In the last frame each object's position, seen from the target's frame, lies within the range of each axis."""
    low, high = zip(*relative_position_range)

    def test(f: Column) -> Column:
        back = g.pose_inverse(_rigid(_pose(f, "objects", target)))
        return all_of([_within(g.transform_point(back, _at(_pose(f, "objects", o))), low, high) for o in objects])

    return once(_last(), test)


#: Fixed values of the grasp test: frames a second, least travel of a moving gripper, frames after which one stands still, least opening of a frame.
RATE, TRAVEL, STILL, OPENING = 30, 0.002, 15, 0.02


@rule("is_object_grasped_by_gripper")
def grasped(objs: Sequence[str], gripper: str = "right", active_gripper_joint: str = "idx81_gripper_r_outer_joint1", grasp_time_threshold: float = 1.0, check_unexpected_drop: bool = False, object_gripper_move_threshold: float = 0.002) -> Column:
    """The first of the objects that the episode has moves along with the gripper for long enough; with ``check_unexpected_drop``, until the gripper opens.

    A fold over the frames but the last: frames in which the object keeps its
    place in the moving gripper's frame count, any other sets the count back to 0;
    a frame in which the fingers move leaves it.
    """
    frames = F.col(FRAMES)
    name = F.coalesce(*[F.when(_pose(_first(), "objects", o).isNotNull(), F.lit(o)) for o in objs])
    joint = F.array_position(_first()["robot"]["joints"]["joint_name"], active_gripper_joint).cast("int")
    need = grasp_time_threshold * RATE

    def view(f: Column) -> Column:
        hand, thing = F.try_element_at(f["ee"], F.lit(gripper))["pose"], F.try_element_at(f["objects"], name)["pose"]
        return F.struct(hand.alias("hand"), thing.alias("thing"), F.try_element_at(f["robot"]["joints"]["joint_position"], joint).alias("finger"))

    def step(acc: Column, v: Column) -> Column:
        last = acc["last"]
        moved = g.distance(_at(v["hand"]), _at(last["hand"]))
        relative = lambda x: g.pose_relative(_rigid(x["hand"]), _rigid(x["thing"]))
        slipped = g.distance(relative(v)[1], relative(last)[1])
        turn = v["finger"] - last["finger"]
        held = acc["count"] >= need
        done = acc["done"] | (held & (turn > OPENING) if check_unexpected_drop else held)
        still = F.when(moved > TRAVEL, 0).otherwise(acc["still"] + 1)
        along = (still < STILL) & (slipped < object_gripper_move_threshold)
        count = F.when(along, acc["count"] + F.when(F.abs(turn) < OPENING, 1).otherwise(0)).otherwise(0)
        return F.struct(done.alias("done"), still.alias("still"), count.alias("count"), v.alias("last"))

    views = F.transform(F.slice(frames, 1, F.greatest(F.size(frames) - 1, F.lit(0))), view)
    start = once(view(_first()), lambda v: F.struct(F.lit(False).alias("done"), F.lit(0).alias("still"), F.lit(0).alias("count"), v.alias("last")))
    return F.when(name.isNotNull() & joint.isNotNull(), F.aggregate(views, start, step)["done"])
