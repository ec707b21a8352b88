"""Filter files and task files run by the named rules: PF04-PF15, PF22, AD01-AD26, on episodes made of a user's events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions import geom as g
from kinelake.operators import episode_rules, rules, tree_leaves  # noqa: F401  the last and the first fill the registries
from kinelake.plans.q_geometry import BASE, base, point, quat
from kinelake.plans.registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _matrix(turn: g.Rot, at: g.Vec) -> Column:
    rows = [F.array(*[g.col(turn[i][j]).cast("double") for j in range(3)], g.col(at[i]).cast("double")) for i in range(3)]
    return F.array(*rows, F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]))


def _named(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def episodes(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as an episode: objects a and c, a head camera ten units above, a gripper near object a."""
    pose = lambda turn, at: F.struct(_matrix(turn, at).alias("pose"))
    level = tuple(tuple(1.0 if i == j else 0.0 for j in range(3)) for i in range(3))
    off = F.col("event_id") % 3 * 0.001
    frame = F.struct(
        "event_id",
        _named(a=pose(g.q_matrix(quat("q")), point("a")), c=pose(g.q_matrix(quat("p")), point("c"))).alias("objects"),
        _named(head=pose(level, (0.0, 0.0, 10.0))).alias("cameras"),
        _named(right=pose(level, (F.col("ax") + off, F.col("ay"), F.col("az")))).alias("ee"),
        F.lit(None).cast("map<string,struct<pose:array<array<double>>>>").alias("ee_center"),
        F.struct(F.struct(F.array(F.lit("idx81_gripper_r_outer_joint1")).alias("joint_name"), F.array(F.col("k") / 100).alias("joint_position")).alias("joints")).alias("robot"),
    )
    by_id = lambda x, y: F.when(x["event_id"] < y["event_id"], -1).when(x["event_id"] > y["event_id"], 1).otherwise(0)  # noqa: E731  maps can't be compared
    e = base(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(frame), by_id).alias("frames"))
    lens = F.struct(*[F.lit(float(v)).alias(n) for n, v in (("fx", 600), ("fy", 600), ("ppx", 1200), ("ppy", 900), ("width", 1280), ("height", 960))])
    return e.withColumn("cameras", _named(head=F.struct(lens.alias("intrinsic"))))


FILTER_FILE = {
    "filter_rules": [
        {"rule_name": "is_object_end_higher_than_start", "params": {"objects": ["a", "absent"], "delta_z": -1.5, "tolerance": 0.03}, "result_code": 2},
        {"rule_name": "is_object_end_in_region", "params": {"objects": ["a"], "region_center": [3.0, 5.0, 2.3], "region_size": [6.0, 9.0, 3.0]}, "result_code": 3},
        {"rule_name": "is_objects_distance_greater_than", "params": {"objects": ["a", "c"], "min_distance": 2.5}, "result_code": 4},
        {"rule_name": "is_object_end_pose_up", "params": {"objects": ["a"], "objects_up_axis": ["z"], "thresholds": [1.1]}, "result_code": 5},
        {"rule_name": "is_object_reach_target", "params": {"objects": ["a"], "target": "c", "target_scope": [[-20, 9], [-20, 20], [-9, 9]]}},
    ]
}


@R.query(
    BASE
    + """, l AS (SELECT user_id, arg_max({'x': ax, 'y': ay, 'z': az, 'cx': cx, 'cy': cy, 'cz': cz, 'up': 1 - 2 * (qx * qx + qy * qy), 'u0': 2 * (qx * qz + qw * qy), 'u1': 2 * (qy * qz - qw * qx)}, event_id) AS e, arg_min(az, event_id) AS z0 FROM q GROUP BY 1),
    c AS (SELECT user_id, e.z - z0 >= -1.5 - 0.03 AS r2, e.x BETWEEN 0 AND 6 AND e.y BETWEEN 0.5 AND 9.5 AND e.z BETWEEN 0.8 AND 3.8 AS r3,
      sqrt(pow(e.x - e.cx, 2) + pow(e.y - e.cy, 2) + pow(e.z - e.cz, 2)) >= 2.5 AS r4, acos(greatest(least(e.up / sqrt(e.up * e.up + e.u0 * e.u0 + e.u1 * e.u1), 1), -1)) <= 1.1 AS r5,
      e.x - e.cx BETWEEN -20 AND 9 AND e.y - e.cy BETWEEN -20 AND 20 AND e.z - e.cz BETWEEN -9 AND 9 AS r1 FROM l)
    SELECT user_id, r1 AND r2 AND r3 AND r4 AND r5 AS valid, CASE WHEN NOT r2 THEN 2 WHEN NOT r3 THEN 3 WHEN NOT r4 THEN 4 WHEN NOT r5 THEN 5 WHEN NOT r1 THEN 1 ELSE 0 END AS result_code,
    CASE WHEN NOT r2 THEN 'is_object_end_higher_than_start' WHEN NOT r3 THEN 'is_object_end_in_region' WHEN NOT r4 THEN 'is_objects_distance_greater_than' WHEN NOT r5 THEN 'is_object_end_pose_up' WHEN NOT r1 THEN 'is_object_reach_target' ELSE 'ok' END AS status FROM c"""
)
def pf04_filter_file(spark: SparkSession, d: str) -> DataFrame:
    """A filter file's rules by name; the first that fails decides."""
    return episodes(spark, d).withColumn("r", rules.filter_chain(FILTER_FILE["filter_rules"])).select("user_id", "r.valid", "r.result_code", "r.status")


def _rule(name: str, **params) -> Column:
    return F.coalesce(rules.REGISTRY[name](**params), F.lit(False))


@R.query(
    BASE
    + """, w AS (SELECT *, first_value({'x': ax, 'y': ay, 'z': az}) OVER (PARTITION BY user_id ORDER BY event_id) AS s, 600 * ax / (az - 10) + 1200 AS u, 600 * ay / (az - 10) + 900 AS v2, 600 * (ax + event_id % 3 * 0.001) / (az - 10) / 1.05 + 1200 AS gu, 600 * ay / (az - 10) / 1.05 + 900 AS gv FROM q),
    f AS (SELECT *, (u >= 0 AND u < 1280 AND v2 >= 0 AND v2 < 960)::INT AS seen, (gu >= 0 AND gu < 1280 AND gv >= 0 AND gv < 960)::INT AS gseen FROM w),
    r AS (SELECT *, sum(seen) OVER (PARTITION BY user_id ORDER BY event_id) AS g1, sum(gseen) OVER (PARTITION BY user_id ORDER BY event_id) AS g2 FROM f),
    o AS (SELECT user_id, max(n) AS most FROM (SELECT user_id, g1, sum(1 - seen) AS n FROM r GROUP BY 1, 2) GROUP BY 1), og AS (SELECT user_id, max(n) AS most FROM (SELECT user_id, g2, sum(1 - gseen) AS n FROM r GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT user_id, bool_and(abs(ax - s.x) <= 7 AND abs(ay - s.y) <= 9.5 AND abs(az - s.z) <= 2.5) AS alike, bool_and(sqrt(pow(ax - cx, 2) + pow(ay - cy, 2) + pow(az - cz, 2)) >= 0.4) AS far FROM f GROUP BY 1)
    SELECT user_id, o.most < 3 AS in_view, og.most < 2 AS gripper_in_view, alike, far FROM o JOIN og USING (user_id) JOIN s USING (user_id)"""
)
def pf07_pf08_pf09_pf12_all_frames(spark: SparkSession, d: str) -> DataFrame:
    """The rules that look at every frame, by name."""
    return episodes(spark, d).select(
        "user_id",
        _rule("is_object_in_view", objects=["a"], out_view_allow_time=0.1).alias("in_view"),
        _rule("is_gripper_in_view", out_view_allow_time=0.07).alias("gripper_in_view"),
        _rule("is_object_pose_similar2start", objects=[["object", "a"]], pos_threshold=[7, 9.5, 2.5], euler_threshold=[400, 400, 400]).alias("alike"),
        _rule("is_objects_distance_greater_than", objects=["a", "c"], min_distance=0.4, check_frame="all").alias("far"),
    )


@R.query()
def pf14_pf15_grasp_relative(spark: SparkSession, d: str) -> DataFrame:
    """The grasp fold and the relative position, by name (the fold has no SQL twin)."""
    return episodes(spark, d).select(
        "user_id",
        _rule("is_object_grasped_by_gripper", objs=["absent", "a"], grasp_time_threshold=0.1, object_gripper_move_threshold=0.5).alias("grasped"),
        _rule("is_object_relative_position_in_target", objects=["a"], target="c", relative_position_range=[[-5, 5], [-2, 6], [0, 9]]).alias("relative"),
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as the frames of an evaluation run."""
    b = base(spark, d)
    x, y, z = point("a")
    cx, cy, cz = point("c")
    arr = lambda *v: F.array(*[g.col(c).cast("double") for c in v])
    thing = lambda at, q, half: F.struct(arr(*at).alias("xyz"), arr(*q).alias("q"), arr(*[c - h for c, h in zip(at, half)]).alias("low"), arr(*[c + h for c, h in zip(at, half)]).alias("high"))
    frame = F.struct(
        F.col("event_id").alias("tick"),
        (F.unix_micros("ts").cast("double") / 1e6).alias("elapsed"),
        _named(a=thing((x, y, z), quat("q"), (2.2, 2.2, 0.5)), c=thing((cx, cy, cz), quat("p"), (2.0, 2.0, 2.0))).alias("objects"),
        _named(left=F.struct(arr(cx, cy, cz).alias("xyz")), right=F.struct(arr(x + F.col("event_id") % 3 * 0.06, y, z).alias("xyz"))).alias("grippers"),
        _named(a=arr(F.col("v")), left=arr(F.col("k") / 100), right=arr(F.col("v") / 100)).alias("joints"),
        F.struct(x.alias("x"), y.alias("y"), g.q_yaw(quat("q")).alias("yaw")).alias("base"),
        F.array(arr(x, y, z), arr(cx, cy, cz)).alias("particles"),
        _named(s=F.col("k").cast("int")).alias("stains"),
        _named(t=F.col("event_type")).alias("triggers"),
        _named(vlm=F.col("v") / 80).alias("scores"),
    )
    by_tick = lambda p, q: F.when(p["tick"] < q["tick"], -1).when(p["tick"] > q["tick"], 1).otherwise(0)
    b = b.withColumn("ts", F.col("ts").cast("timestamp"))
    return b.groupBy("user_id").agg(F.array_sort(F.collect_list(frame), by_tick).alias("frames"))


#: Leaves as a task file spells them, and the SQL of the first tick of each on (q, n: number of the frame within the run).
LEAVES = {
    "inside": ({"Inside": "a|c|0.8"}, "min(event_id) FILTER (i AND i1)"),
    "in_bbox": ({"InBBox": "a|2,4,2|3,6,2"}, "min(event_id) FILTER (b AND b1)"),
    "ontop": ({"Ontop": "a|c"}, "min(event_id) FILTER (abs(az - 0.5 - (cz + 2)) <= 0.02 AND shared / 19.36 >= 0.5)"),
    "cover": ({"Cover": "a|c"}, "min(event_id) FILTER (az - (cz + 2) <= 0.002 AND shared / 16 >= 0.5)"),
    "onfloor": ({"Onfloor": "a|1.2"}, "min(event_id) FILTER (abs(az - 1.2) < 0.3)"),
    "follow": ({"Follow": "absent,a|[6,6,6]|left"}, "min(event_id) FILTER (abs(ax - cx) <= 3 * e0 AND abs(ay - cy) <= 3 * e1 AND abs(az - cz) <= 3 * e2)"),
    "picked": ({"PickUpOnGripper": "a|right"}, "min(event_id) FILTER (az - z0 > 0.02 AND event_id % 3 < 2)"),
    "lifted": ({"LiftUp": "a|0.5"}, "min(event_id) FILTER (az - z0 >= 0.5)"),
    "upright": ({"Upright": "a|80"}, "min(event_id) FILTER (2 * (qy * qz + qw * qx) >= cos(radians(80.0)))"),
    "stable": ({"StableGrasp": "a|right"}, "min(event_id) FILTER (event_id % 3 < 2 AND e1b % 3 < 2)"),
    "pushed": ({"PushPull": "a|10|30|0"}, "list_sort(list(event_id) FILTER (v BETWEEN 10 AND 30))[2]"),
    "shelved": ({"OnShelf": "a|c|[-5,5,-5,5,0,3]|0.5"}, "list_sort(list(event_id) FILTER (abs(ax - cx) < 5 AND abs(ay - cy) < 5 AND az - 0.5 > 0 AND az - 0.5 < 3))[6]"),
    "parked": ({"ChassisAtTarget": "[3,5,30]|[2,4,45]"}, "min(event_id) FILTER (abs(ax - 3) <= 2 AND abs(ay - 5) <= 4 AND abs(yaw - 360 * floor(yaw / 360) - 180) <= 45)"),
    "few": ({"CheckParticleInBBox": "2|0,0,0,3,9,9"}, "min(event_id) FILTER ((ax BETWEEN 0 AND 3 AND ay BETWEEN 0 AND 9 AND az BETWEEN 0 AND 9)::INT + (cx BETWEEN 0 AND 3 AND cy BETWEEN 0 AND 9 AND cz BETWEEN 0 AND 9)::INT < 2)"),
    "clean": ({"CheckStainClean": "s|5"}, "min(event_id) FILTER (k < 5)"),
    "triggered": ({"TriggerAction": "t|signup"}, "min(event_id) FILTER (event_type = 'signup')"),
    "scored": ({"VLM": "vlm|5"}, "min(event_id) FILTER (n % 5 = 0 AND v / 80 >= 1)"),
    "timed_out": ({"Timeout": "432000"}, "min(event_id) FILTER (el - el0 >= 432000)"),
    "stepped_out": ({"StepOut": "30"}, "min(event_id) FILTER (n = 31)"),
    "waited": ({"ActionWaitForTime": "86400"}, "min(event_id) FILTER (el - el0 >= 86400)"),
}
RUN_SQL = (
    BASE
    + """, w AS (SELECT *, row_number() OVER o AS n, epoch_us(ts) / 1000000.0 AS el, abs(ax - cx) <= 1.6 AND abs(ay - cy) <= 1.6 AND abs(az - cz) <= 1.6 AS i, abs(ax - 2) <= 1.5 AND abs(ay - 4) <= 3 AND abs(az - 2) <= 1 AS b,
      greatest(least(ax + 2.2, cx + 2) - greatest(ax - 2.2, cx - 2), 0) * greatest(least(ay + 2.2, cy + 2) - greatest(ay - 2.2, cy - 2), 0) AS shared,
      abs(1 - 2 * (qy * qy + qz * qz)) + abs(2 * (qx * qy - qw * qz)) + abs(2 * (qx * qz + qw * qy)) AS e0, abs(2 * (qx * qy + qw * qz)) + abs(1 - 2 * (qx * qx + qz * qz)) + abs(2 * (qy * qz - qw * qx)) AS e1, abs(2 * (qx * qz - qw * qy)) + abs(2 * (qy * qz + qw * qx)) + abs(1 - 2 * (qx * qx + qy * qy)) AS e2,
      degrees(atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz))) - 30 + 180 AS yaw, first_value(az) OVER o AS z0, coalesce(lag(event_id) OVER o, 2) AS e1b FROM q WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
    x AS (SELECT *, coalesce(lag(i) OVER o, false) AS i1, coalesce(lag(b) OVER o, false) AS b1, first_value(el) OVER o AS el0 FROM w WINDOW o AS (PARTITION BY user_id ORDER BY event_id)) """
)


@R.query(RUN_SQL + "SELECT user_id, " + ", ".join(f"{sql} AS {name}_at" for name, (_, sql) in LEAVES.items()) + " FROM x GROUP BY 1")
def ad01_ad23_named_leaves(spark: SparkSession, d: str) -> DataFrame:
    """The tick at which each leaf of a task file is first done, or ends the evaluation."""
    r = runs(spark, d)
    frames = F.col("frames")
    start = rules.start_state(frames, F.element_at("frames", 1)["tick"])

    def tick(spelled: dict) -> Column:
        return rules.once(rules.reached(rules.parse_tree(spelled), frames, rules.named_leaf, start), lambda s: F.coalesce(s["at"], s["cancel"]))

    return r.select("user_id", *[tick(spelled).alias(f"{name}_at") for name, (spelled, _) in LEAVES.items()])


TASK_FILE = {
    "problem1": {
        "Acts": [
            {
                "ActionList": [
                    {"ActionSetWaitAny": [{"Follow": "absent,a|[6,6,6]|left"}, {"StepOut": 20}]},
                    {"ActionSetWaitAny": [{"LiftUp": "{@placeholder_str1}|0.5"}, {"StepOut": 4}]},
                ]
            }
        ],
        "Init": [],
        "Objects": [],
        "Problem": "lift_what_is_followed",
    }
}


@R.query(
    RUN_SQL
    + """, f AS (SELECT user_id, min(n) AS fn FROM x WHERE abs(ax - cx) <= 3 * e0 AND abs(ay - cy) <= 3 * e1 AND abs(az - cz) <= 3 * e2 AND n <= 21 GROUP BY 1),
    s AS (SELECT x.user_id, n, event_id, az - first_value(az) OVER (PARTITION BY x.user_id ORDER BY n) AS rise, fn FROM x JOIN f USING (user_id) WHERE n >= fn),
    l AS (SELECT user_id, min(event_id) AS at FROM s WHERE rise >= 0.5 AND n <= fn + 4 GROUP BY 1), t AS (SELECT user_id, max(n) AS last FROM x GROUP BY 1)
    SELECT t.user_id, l.at AS satisfied_at, CASE WHEN l.at IS NOT NULL THEN 'done' WHEN coalesce(fn + 4, 21) <= last THEN 'cancelled' ELSE 'open' END AS outcome FROM t LEFT JOIN f USING (user_id) LEFT JOIN l USING (user_id)"""
)
def ad_task_file(spark: SparkSession, d: str) -> DataFrame:
    """A task file run by the named leaves: follow, then lift what was followed, each within a number of steps."""
    return rules.tree_outcomes(runs(spark, d), rules.parse_task(TASK_FILE), rules.named_leaf, ["user_id"])


@R.query()
def ad15_named_passing(spark: SparkSession, d: str) -> DataFrame:
    """The hand-over machine by name, both ways (a fold, without a SQL twin)."""
    frames = F.col("frames")
    start = rules.start_state(frames, F.element_at("frames", 1)["tick"])
    done = lambda arg: rules.reached(rules.parse_tree({"GripperPassing": f"a|{arg}"}), frames, rules.named_leaf, start)["at"]
    return runs(spark, d).select("user_id", done("false").alias("left_to_right"), done("true").alias("right_to_left"))
