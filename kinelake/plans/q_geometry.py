"""Geometry on poses made of the events' columns: MA, and the pose rules PF06-PF21."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.functions import geom as g
from kinelake.operators import timeseries as ts
from kinelake.plans.registry import Registry, r6, r9
from kinelake.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

#: Two unit quaternions (q, p) and two points (a, c) of each event.
BASE = """WITH b AS (SELECT event_id, user_id, ts, value AS v, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, event_type FROM events),
    n AS (SELECT *, sqrt(pow(1 + v / 100, 2) + pow(k / 100, 2) + pow(event_id % 7 / 10.0, 2) + pow(user_id / 100.0, 2)) AS nq, sqrt(1 + pow(event_id % 5 / 10.0, 2) + pow(k / 50, 2)) AS np FROM b),
    q AS (SELECT *, (1 + v / 100) / nq AS qw, k / 100 / nq AS qx, event_id % 7 / 10.0 / nq AS qy, user_id / 100.0 / nq AS qz, 1 / np AS pw, event_id % 5 / 10.0 / np AS px, 0.0 AS py, k / 50 / np AS pz,
      v / 10 AS ax, k / 10 AS ay, 1 + event_id % 9 / 3.0 AS az, user_id / 10.0 AS cx, v / 20 AS cy, event_id % 4 / 2.0 AS cz FROM n)
    """


def base(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    v, k = F.col("v"), F.col("k")
    b = e.select("event_id", "user_id", "ts", "event_type", F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    i7, i5 = F.col("event_id") % 7 / 10.0, F.col("event_id") % 5 / 10.0
    q = g.q_normalize((1 + v / 100, k / 100, i7, F.col("user_id") / 100.0))
    p = g.q_normalize((F.lit(1.0), i5, F.lit(0.0), k / 50))
    b = b.withColumns({f"q{c}": x for c, x in zip("wxyz", q)} | {f"p{c}": x for c, x in zip("wxyz", p)})
    return b.withColumns({"ax": v / 10, "ay": k / 10, "az": 1 + F.col("event_id") % 9 / 3.0, "cx": F.col("user_id") / 10.0, "cy": v / 20, "cz": F.col("event_id") % 4 / 2.0})



def quat(prefix: str):
    return tuple(F.col(prefix + c) for c in "wxyz")


def point(prefix: str):
    return tuple(F.col(prefix + c) for c in "xyz")


@R.query(
    BASE
    + """SELECT event_id, round(1 - 2 * (qy * qy + qz * qz), 6) + 0.0 AS m00, round(2 * (qx * qy - qw * qz), 6) + 0.0 AS m01, round(2 * (qx * qz + qw * qy), 6) + 0.0 AS m02,
    round(2 * (qy * qz + qw * qx), 6) + 0.0 AS m21, round(1 - 2 * (qx * qx + qy * qy), 6) + 0.0 AS m22 FROM q"""
)
def ma01_rotation(spark: SparkSession, d: str) -> DataFrame:
    m = g.q_matrix(quat("q"))
    return base(spark, d).select("event_id", *[r6(m[i][j]).alias(f"m{i}{j}") for i, j in ((0, 0), (0, 1), (0, 2), (2, 1), (2, 2))])


@R.query(
    BASE
    + """SELECT event_id, round(qw * pw - qx * px - qy * py - qz * pz, 6) + 0.0 AS w, round(qw * px + qx * pw + qy * pz - qz * py, 6) + 0.0 AS x,
    round(qw * py - qx * pz + qy * pw + qz * px, 6) + 0.0 AS y, round(qw * pz + qx * py - qy * px + qz * pw, 6) + 0.0 AS z,
    round(degrees(2 * acos(least(abs(qw * pw + qx * px + qy * py + qz * pz), 1))), 4) AS angle FROM q"""
)
def ma02_ma07_quaternions(spark: SparkSession, d: str) -> DataFrame:
    m = g.q_multiply(quat("q"), quat("p"))
    return base(spark, d).select("event_id", *[r6(x).alias(c) for c, x in zip("wxyz", m)], F.round(g.q_angle(quat("q"), quat("p")), 4).alias("angle"))


@R.query(
    BASE
    + """, s AS (SELECT event_id, qw, qx, qy, qz, pw, px, py, pz, abs(qw * pw + qx * px + qy * py + qz * pz) AS c, CASE WHEN qw * pw + qx * px + qy * py + qz * pz < 0 THEN -1 ELSE 1 END AS sg FROM q),
    t AS (SELECT *, CASE WHEN c > 0.9995 THEN 0.7 ELSE sin(0.7 * acos(least(c, 1))) / sin(acos(least(c, 1))) END AS wa, CASE WHEN c > 0.9995 THEN 0.3 ELSE sin(0.3 * acos(least(c, 1))) / sin(acos(least(c, 1))) END * sg AS wb FROM s),
    u AS (SELECT event_id, wa * qw + wb * pw AS w, wa * qx + wb * px AS x, wa * qy + wb * py AS y, wa * qz + wb * pz AS z FROM t)
    SELECT event_id, round(w / sqrt(w * w + x * x + y * y + z * z), 6) + 0.0 AS w, round(x / sqrt(w * w + x * x + y * y + z * z), 6) + 0.0 AS x, round(y / sqrt(w * w + x * x + y * y + z * z), 6) + 0.0 AS y, round(z / sqrt(w * w + x * x + y * y + z * z), 6) + 0.0 AS z FROM u"""
)
def ma03_slerp(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).select("event_id", *[r6(x).alias(c) for c, x in zip("wxyz", g.q_slerp(quat("q"), quat("p"), 0.3))])


@R.query(
    BASE
    + """SELECT event_id, round(degrees(atan2(2 * (qy * qz + qw * qx), 1 - 2 * (qx * qx + qy * qy))), 4) + 0.0 AS ex, round(degrees(asin(greatest(least(-2 * (qx * qz - qw * qy), 1), -1))), 4) + 0.0 AS ey,
    round(degrees(atan2(2 * (qx * qy + qw * qz), 1 - 2 * (qy * qy + qz * qz))), 4) + 0.0 AS ez,
    round(degrees(atan2(2 * (qx * qz + qw * qy), 1 - 2 * (qy * qy + qz * qz))), 4) + 0.0 AS a_y, round(degrees(asin(greatest(least(-2 * (qx * qy - qw * qz), 1), -1))), 4) + 0.0 AS a_z,
    round(degrees(atan2(2 * (qy * qz + qw * qx), 1 - 2 * (qx * qx + qz * qz))), 4) + 0.0 AS a_x FROM q"""
)
def ma04_euler(spark: SparkSession, d: str) -> DataFrame:
    m = g.q_matrix(quat("q"))
    xyz, yzx = g.euler_xyz(m), g.euler_yzx(m)
    f = lambda c: F.round(c, 4) + F.lit(0.0)
    return base(spark, d).select("event_id", *[f(x).alias(n) for n, x in zip(("ex", "ey", "ez", "a_y", "a_z", "a_x"), (*xyz, *yzx))])


#: a - c turned into the frame of q: the transposed rotation applied to the difference.
REL = """, r AS (SELECT *, ax - cx AS dx, ay - cy AS dy, az - cz AS dz FROM q), f AS (SELECT *,
    (1 - 2 * (qy * qy + qz * qz)) * dx + 2 * (qx * qy + qw * qz) * dy + 2 * (qx * qz - qw * qy) * dz AS rx,
    2 * (qx * qy - qw * qz) * dx + (1 - 2 * (qx * qx + qz * qz)) * dy + 2 * (qy * qz + qw * qx) * dz AS ry,
    2 * (qx * qz + qw * qy) * dx + 2 * (qy * qz - qw * qx) * dy + (1 - 2 * (qx * qx + qy * qy)) * dz AS rz FROM r)
    """


@R.query(BASE + REL + "SELECT event_id, round(rx, 5) + 0.0 AS rx, round(ry, 5) + 0.0 AS ry, round(rz, 5) + 0.0 AS rz FROM f")
def ma05_ma12_relative(spark: SparkSession, d: str) -> DataFrame:
    """Position of a in the frame (q, c): inverse pose composed with a pose."""
    rel = g.pose_relative((g.q_matrix(quat("q")), point("c")), (g.q_matrix(quat("p")), point("a")))
    return base(spark, d).select("event_id", *[(F.round(x, 5) + F.lit(0.0)).alias("r" + c) for c, x in zip("xyz", rel[1])])


@R.query(
    BASE
    + """SELECT event_id, round(sqrt(pow(ax - cx, 2) + pow(ay - cy, 2) + pow(az - cz, 2)), 6) AS metres,
    round(degrees(acos(greatest(least((ax * cx + ay * cy + az * cz) / (sqrt(ax * ax + ay * ay + az * az) * sqrt(cx * cx + cy * cy + cz * cz)), 1), -1))), 4) AS degrees FROM q WHERE cx * cx + cy * cy + cz * cz > 0"""
)
def ma06_difference(spark: SparkSession, d: str) -> DataFrame:
    a, c = point("a"), point("c")
    return base(spark, d).where(g.dot(c, c) > 0).select("event_id", r6(g.distance(a, c)).alias("metres"), F.round(g.angle_between(a, c), 4).alias("degrees"))


@R.query(
    BASE
    + """, y AS (SELECT event_id, degrees(atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz))) - 150 + 180 AS s FROM q)
    SELECT event_id, round(s - 360 * floor(s / 360) - 180, 4) + 0.0 AS turn FROM y"""
)
def ma08_yaw(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).select("event_id", (F.round(g.wrap_degrees(g.q_yaw(quat("q")) - 150), 4) + F.lit(0.0)).alias("turn"))


@R.query(BASE + "SELECT event_id, round(degrees(atan2(ay, ax)), 4) AS azimuth, round(degrees(asin(az / sqrt(ax * ax + ay * ay + az * az))), 4) AS elevation FROM q")
def ma09_azimuth(spark: SparkSession, d: str) -> DataFrame:
    az, el = g.azimuth_elevation(point("a"))
    return base(spark, d).select("event_id", F.round(az, 4).alias("azimuth"), F.round(el, 4).alias("elevation"))


@R.query(BASE + "SELECT event_id, round(600 * ax / az + 320, 4) AS u, round(610 * ay / az + 240, 4) AS w, round(((600 * ax / az + 320) - 320) * az / 600, 6) AS bx FROM q")
def ma10_project(spark: SparkSession, d: str) -> DataFrame:
    u, w = g.project(point("a"), 600, 610, 320, 240)
    back = g.back_project(u, w, F.col("az"), 600, 610, 320, 240)
    return base(spark, d).select("event_id", F.round(u, 4).alias("u"), F.round(w, 4).alias("w"), r6(back[0]).alias("bx"))


@R.query("SELECT vec_id, i - 1 AS col_no, round(((i - 1) - 3.5) * abs(e) / 50, 6) + 0.0 AS x, round(abs(e), 6) AS depth FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS e FROM embeddings) WHERE abs(e) > 0.05")
def ma11_depth_cloud(spark: SparkSession, d: str) -> DataFrame:
    """A depth row unfolded into points of the camera's frame; shallow depths are dropped."""
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "e"))
    depth = F.abs(F.col("e").cast("double"))
    return x.where(depth > 0.05).select("vec_id", F.col("p").cast("long").alias("col_no"), r6((F.col("p") - 3.5) * depth / 50).alias("x"), r6(depth).alias("depth"))


@R.query(BASE + "SELECT event_id, CAST(trunc((ax - 0.5) / 0.25) AS INT) AS gx, CAST(trunc((40 - ay) / 0.25) AS INT) AS gy FROM q")
def ma13_grid(spark: SparkSession, d: str) -> DataFrame:
    gx, gy = g.grid_cell(F.col("ax"), F.col("ay"), 0.5, 40, 0.25)
    return base(spark, d).select("event_id", gx.alias("gx"), gy.alias("gy"))


@R.query(
    BASE
    + """, t AS (SELECT *, greatest(least(CASE WHEN cx * cx + cy * cy + cz * cz = 0 THEN 0 ELSE (ax * cx + ay * cy + az * cz) / (cx * cx + cy * cy + cz * cz) END, 1), 0) AS t FROM q)
    SELECT event_id, round(sqrt(pow(ax - t * cx, 2) + pow(ay - t * cy, 2) + pow(az - t * cz, 2)), 6) AS distance FROM t"""
)
def ma14_segment(spark: SparkSession, d: str) -> DataFrame:
    zero = (F.lit(0.0),) * 3
    return base(spark, d).select("event_id", r6(g.segment_distance(point("a"), zero, point("c"))).alias("distance"))


@R.query(
    BASE
    + """, r AS (SELECT *, 4.0 AS w, 2.0 AS h FROM q)
    SELECT event_id, round(-w / 2 * cos(radians(v)) + h / 2 * sin(radians(v)) + ax, 6) + 0.0 AS x0, round(-w / 2 * sin(radians(v)) - h / 2 * cos(radians(v)) + ay, 6) + 0.0 AS y0,
    round(greatest(least(ax + 4, cx + 3) - greatest(ax, cx), 0) * greatest(least(ay + 2, cy + 5) - greatest(ay, cy), 0), 9) AS common FROM r"""
)
def ma15_ma16_rectangles(spark: SparkSession, d: str) -> DataFrame:
    (x0, y0) = g.rectangle_corners(F.col("ax"), F.col("ay"), 4, 2, F.col("v"))[0]
    common = g.overlap_1d(F.col("ax"), F.col("ax") + 4, F.col("cx"), F.col("cx") + 3) * g.overlap_1d(F.col("ay"), F.col("ay") + 2, F.col("cy"), F.col("cy") + 5)
    return base(spark, d).select("event_id", r6(x0).alias("x0"), r6(y0).alias("y0"), F.round(common, 9).alias("common"))


@R.query(
    BASE
    + """, o AS (SELECT event_id, greatest(least(ax + 4, cx + 3) - greatest(ax, cx), 0) * greatest(least(ay + 2, cy + 5) - greatest(ay, cy), 0) AS i FROM q)
    SELECT event_id, round(i / (8 + 15 - i), 6) AS iou FROM o"""
)
def ma17_iou(spark: SparkSession, d: str) -> DataFrame:
    iou = g.rect_iou((F.col("ax"), F.col("ay"), F.col("ax") + 4, F.col("ay") + 2), (F.col("cx"), F.col("cy"), F.col("cx") + 3, F.col("cy") + 5))
    return base(spark, d).select("event_id", r6(iou).alias("iou"))


@R.query(BASE + "SELECT event_id, ax + 4 < cx OR cx + 3 < ax OR ay + 2 < cy OR cy + 5 < ay AS separate FROM q")
def ma18_separating_axis(spark: SparkSession, d: str) -> DataFrame:
    """The general test on rectangles that happen to be axis-parallel, where SQL can say it."""
    a = [(F.col("ax"), F.col("ay")), (F.col("ax") + 4, F.col("ay")), (F.col("ax") + 4, F.col("ay") + 2), (F.col("ax"), F.col("ay") + 2)]
    c = [(F.col("cx"), F.col("cy")), (F.col("cx") + 3, F.col("cy")), (F.col("cx") + 3, F.col("cy") + 5), (F.col("cx"), F.col("cy") + 5)]
    return base(spark, d).select("event_id", g.rectangles_separate(a, c).alias("separate"))


@R.query(
    BASE
    + """, s AS (SELECT event_id, greatest(0, (1 - ax) / dx, (1 - ay) / dy) AS t0, least(1, (3 - ax) / dx, (4 - ay) / dy) AS t1 FROM (SELECT event_id, ax, ay, 6 - ax AS dx, 11 - ay AS dy FROM q) WHERE dx > 0 AND dy > 0)
    SELECT event_id, t0 <= t1 AS hits FROM s"""
)
def ma19_slab(spark: SparkSession, d: str) -> DataFrame:
    """Segments to a far corner against a box, in the plane."""
    hit = g.segment_hits_box((F.col("ax"), F.col("ay")), (F.lit(6.0), F.lit(11.0)), (1.0, 1.0), (3.0, 4.0))
    return base(spark, d).where("ax < 6 and ay < 11").select("event_id", hit.alias("hits"))


@R.query("SELECT event_id, round(CASE WHEN value BETWEEN 0 AND 20 THEN value * 2 WHEN value BETWEEN 20 AND 50 THEN (value - 20) * 0.5 + 40 WHEN value BETWEEN 50 AND 100 THEN (value - 50) * -1 + 55 END, 6) + 0.0 AS score FROM events")
def ma20_piecewise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", r6(g.piecewise(F.col("value"), [0, 20, 50, 100], [2, 0.5, -1])).alias("score"))


@R.query("SELECT event_id, round(greatest(least(1.28 * 120 * (0.78 - value / 100), 120), 0), 6) AS a, round(greatest(least(1.2 * 120 * (0.75 - value / 100), 120), 0), 6) AS b, round(pow(least(value / 100, 1), 2) * 0.8, 6) AS c FROM events")
def ma21_gripper_remap(spark: SparkSession, d: str) -> DataFrame:
    """Three remaps; gain, span and offset are parameters."""
    remap = lambda gain, span, off: g.clip(gain * span * (F.lit(off) - F.col("value") / 100), 0, span)
    return table(spark, d, "events").select("event_id", r6(remap(1.28, 120, 0.78)).alias("a"), r6(remap(1.2, 120, 0.75)).alias("b"), r6(F.pow(F.least(F.col("value") / 100, F.lit(1.0)), 2) * 0.8).alias("c"))


@R.query("SELECT p_partkey, round(0.01 + (0.1 - 0.01) * p_size / 50.0, 6) AS lin, round(exp(ln(0.01) + (ln(0.1) - ln(0.01)) * p_size / 50.0), 6) AS log FROM part")
def ma22_schedule(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("p_size") / 50.0
    return table(spark, d, "part").select("p_partkey", r6(g.lerp(0.01, 0.1, t)).alias("lin"), r6(g.log_lerp(0.01, 0.1, t)).alias("log"))


@R.query("SELECT p_partkey, round(2 * (p_size - 1) / 49.0 - 1, 6) + 0.0 AS unit, round(((2 * (p_size - 1) / 49.0 - 1) + 1) / 2 * 49 + 1, 6) AS back FROM part")
def ma23_bounds(spark: SparkSession, d: str) -> DataFrame:
    unit = 2 * (F.col("p_size") - 1) / 49.0 - 1
    return table(spark, d, "part").select("p_partkey", r6(unit).alias("unit"), r6((unit + 1) / 2 * 49 + 1).alias("back"))


@R.query(
    """WITH t AS (SELECT user_id, event_type, sum(value) / 500 AS x FROM events GROUP BY 1, 2), s AS (SELECT *, x - ln(sum(exp(x)) OVER (PARTITION BY user_id)) AS lp FROM t)
    SELECT user_id, round(-sum(exp(lp) * lp), 6) AS entropy, round(max(CASE WHEN event_type = 'click' THEN lp END), 6) AS picked FROM s GROUP BY 1"""
)
def ma24_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Log-softmax, its entropy, and the gathered entry."""
    t = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.sum("value") / 500).alias("x"))
    s = t.withColumn("lp", F.col("x") - F.log(F.sum(F.exp("x")).over(Window.partitionBy("user_id"))))
    return s.groupBy("user_id").agg(r6(-F.sum(F.exp("lp") * F.col("lp"))).alias("entropy"), r6(F.max(F.when(F.col("event_type") == "click", F.col("lp")))).alias("picked"))


@R.query("SELECT event_id, round(value - 20, 6) + 0.0 AS kl, round(abs(value - 20), 6) AS abs_kl, round(0.5 * (value - 20) * (value - 20), 7) AS mse FROM events")
def ma25_kl_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("value") - 20
    return table(spark, d, "events").select("event_id", r6(k).alias("kl"), r6(F.abs(k)).alias("abs_kl"), F.round(0.5 * k * k, 7).alias("mse"))


@R.query("SELECT user_id, CAST(ts AS DATE) AS day, round(0.2 * product(1 + greatest(least(value / 30 - 1, 0.2), -0.2) * 0.1), 6) + 0.0 AS coefficient FROM events GROUP BY 1, 2")
def ma26_adaptive_kl(spark: SparkSession, d: str) -> DataFrame:
    """A coefficient that is multiplied step by step, over each user-day."""
    x = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    out = F.aggregate("e", F.lit(0.2), lambda acc, v: acc * (1 + g.clip(v["value"] / 30 - 1, -0.2, 0.2) * 0.1))
    return x.select("user_id", "day", r6(out).alias("coefficient"))


@R.query(
    BASE
    + """, s AS (SELECT event_id, ax, ay, az, cx, cy, cz, CAST(greatest(ceil(sqrt(pow(ax - cx, 2) + pow(ay - cy, 2) + pow(az - cz, 2)) / 2.0), ceil(v / 10), 2) AS INT) AS n FROM q)
    SELECT event_id, n AS n_steps, i AS step_no, round(cx + (ax - cx) * i / (n - 1.0), 9) + 0.0 AS x, round(cz + (az - cz) * i / (n - 1.0), 9) + 0.0 AS z FROM (SELECT *, unnest(range(0, n)) AS i FROM s)"""
)
def ma30_ma32_interpolation(spark: SparkSession, d: str) -> DataFrame:
    """Poses between c and a, as many as the distance and the turn ask for.

    Events of as many steps between the same heights come side by side, since
    their z repeat: the result, many times its input, is smaller on disk.
    """
    n = g.interpolation_steps(g.distance(point("a"), point("c")), F.col("v"), 2.0, 10.0)
    order = ["n_steps", "az", "cz", "cx", "ax", "event_id"]
    s = base(spark, d).withColumn("n_steps", n).select(*order)
    s = s.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)  # a fixed number: few bytes here become many rows
    x = s.select("*", F.explode(F.sequence(F.lit(0), F.col("n_steps") - 1)).alias("i"))
    at = lambda a, b: r9(F.col(a) + (F.col(b) - F.col(a)) * F.col("i") / (F.col("n_steps") - 1.0))
    return x.select("event_id", "n_steps", F.col("i").cast("long").alias("step_no"), at("cx", "ax").alias("x"), at("cz", "az").alias("z"))


@R.query("SELECT p_partkey, round((p_size / 50.0 - 0.5) / 0.28209479177387814, 6) + 0.0 AS sh, round((p_size / 50.0 - 0.5) / 0.28209479177387814 * 0.28209479177387814 + 0.5, 6) AS rgb FROM part")
def ma33_harmonics(spark: SparkSession, d: str) -> DataFrame:
    sh = g.rgb_to_sh(F.col("p_size") / 50.0)
    return table(spark, d, "part").select("p_partkey", r6(sh).alias("sh"), r6(g.sh_to_rgb(sh)).alias("rgb"))


@R.query(BASE + "SELECT user_id, arg_max(ax, event_id) BETWEEN 0 AND 3 AND arg_max(ay, event_id) BETWEEN 2 AND 9 AND arg_max(az, event_id) BETWEEN 1 AND 3 AS reached FROM q GROUP BY 1")
def pf06_reach_target(spark: SparkSession, d: str) -> DataFrame:
    """The last frame's position within a box: also PF13's end in region."""
    last = base(spark, d).groupBy("user_id").agg(F.max_by(F.struct("ax", "ay", "az"), "event_id").alias("p"))
    return last.select("user_id", g.in_box([F.col("p")[c] for c in ("ax", "ay", "az")], (0, 2, 1), (3, 9, 3)).alias("reached"))


@R.query(
    BASE
    + """, s AS (SELECT user_id, arg_min(ax, event_id) AS x0, arg_min(ay, event_id) AS y0 FROM q GROUP BY 1)
    SELECT user_id, bool_and(sqrt(pow(ax - x0, 2) + pow(ay - y0, 2)) <= 9) AS similar FROM q JOIN s USING (user_id) GROUP BY 1"""
)
def pf07_similar_to_start(spark: SparkSession, d: str) -> DataFrame:
    b = base(spark, d)
    s = b.groupBy("user_id").agg(F.min_by("ax", "event_id").alias("x0"), F.min_by("ay", "event_id").alias("y0"))
    near = g.distance((F.col("ax"), F.col("ay")), (F.col("x0"), F.col("y0"))) <= 9
    return b.join(s, "user_id").groupBy("user_id").agg(F.bool_and(near).alias("similar"))


@R.query(
    BASE
    + """, f AS (SELECT user_id, ts, event_id, (600 * ax / az + 320 < 0 OR 600 * ax / az + 320 > 1280 OR 600 * ay / az + 240 > 2000)::INT AS out FROM q),
    r AS (SELECT *, sum(1 - out) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM f), runs AS (SELECT user_id, grp, sum(out) AS run FROM r GROUP BY 1, 2)
    SELECT user_id, max(run) < 4 AS in_view FROM runs GROUP BY 1"""
)
def pf08_pf09_in_view(spark: SparkSession, d: str) -> DataFrame:
    """Fails where the projection leaves the image for four frames in a row; all frames are used, in order."""
    u, w = g.project(point("a"), 600, 600, 320, 240)
    out = (u < 0) | (u > 1280) | (w > 2000)
    x = ts.run_length(base(spark, d), out, ["user_id"], ["ts", "event_id"])
    return x.groupBy("user_id").agg((F.max("run") < 4).alias("in_view"))


@R.query(BASE + "SELECT user_id, degrees(acos(greatest(least(arg_max(1 - 2 * (qx * qx + qy * qy), event_id), 1), -1))) <= 60 AS upright FROM q GROUP BY 1")
def pf10_pose_up(spark: SparkSession, d: str) -> DataFrame:
    """Angle of the turned z axis to +z in the last frame, cosine clipped."""
    up = F.max_by(g.q_matrix(quat("q"))[2][2], "event_id")
    return base(spark, d).groupBy("user_id").agg(up.alias("c")).select("user_id", (F.degrees(F.acos(g.clip(F.col("c"), -1, 1))) <= 60).alias("upright"))


@R.query(BASE + "SELECT user_id, arg_max(az, event_id) - arg_min(az, event_id) >= 0.5 - 0.01 AS higher FROM q GROUP BY 1")
def pf11_end_higher(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).groupBy("user_id").agg((F.max_by("az", "event_id") - F.min_by("az", "event_id") >= 0.5 - 0.01).alias("higher"))


@R.query(
    BASE
    + """, l AS (SELECT user_id, arg_max(ax, event_id) AS x, arg_max(ay, event_id) AS y FROM q GROUP BY 1)
    SELECT a.user_id % 10 AS grp, bool_and(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) > 0.05) AS apart FROM l a JOIN l b ON a.user_id % 10 = b.user_id % 10 AND a.user_id < b.user_id GROUP BY 1"""
)
def pf12_distances(spark: SparkSession, d: str) -> DataFrame:
    """No two objects of a group nearer than 0.05 in the last frame: only objects in the same or neighbouring cells of that size meet."""
    l = base(spark, d).groupBy("user_id").agg(F.max_by("ax", "event_id").alias("x"), F.max_by("ay", "event_id").alias("y")).withColumn("grp", F.col("user_id") % 10)
    cell = lambda c: F.floor(F.col(c) / 0.05)
    a = l.select("*", cell("x").alias("gx"), cell("y").alias("gy"))
    around = F.array(*[F.lit(o) for o in (-1, 0, 1)])
    b = a.select("grp", *[F.col(c).alias("b_" + c) for c in ("user_id", "x", "y")], F.explode(F.transform(around, lambda o: F.col("gx") + o)).alias("gx"), "gy")
    b = b.select("grp", "b_user_id", "b_x", "b_y", "gx", F.explode(F.transform(around, lambda o: F.col("gy") + o)).alias("gy"))
    near = a.join(b, ["grp", "gx", "gy"]).where("user_id < b_user_id").where(g.distance((F.col("x"), F.col("y")), (F.col("b_x"), F.col("b_y"))) <= 0.05).select("grp").distinct()
    several = l.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp")
    return several.join(near.withColumn("apart", F.lit(False)), "grp", "left").select("grp", F.coalesce("apart", F.lit(True)).alias("apart"))


@R.query(BASE + REL + "SELECT event_id, rx BETWEEN -5 AND 5 AND ry BETWEEN -2 AND 6 AND rz BETWEEN 0 AND 9 AS inside FROM f")
def pf15_relative_target(spark: SparkSession, d: str) -> DataFrame:
    rel = g.pose_relative((g.q_matrix(quat("q")), point("c")), (g.q_matrix(quat("p")), point("a")))
    return base(spark, d).select("event_id", g.in_box(rel[1], (-5, -2, 0), (5, 6, 9)).alias("inside"))


@R.query(
    BASE
    + """SELECT event_id, coalesce(abs(ax - lag(ax, 5) OVER w) < 1 AND abs(ay - lag(ay, 5) OVER w) > 2, false) AS grasps, round(sqrt(pow(ax - cx, 2) + pow(ay - cy, 2) + pow(az - cz, 2)), 6) AS gap, k < 10 AS closed FROM q WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def pf16_pf17_grasp(spark: SparkSession, d: str) -> DataFrame:
    """Five-frame lag comparison, distance to the object, closed fingers."""
    w = ts.order(["user_id"], ["ts", "event_id"])
    move = lambda c: F.abs(F.col(c) - F.lag(c, 5).over(w))
    return base(spark, d).select("event_id", F.coalesce((move("ax") < 1) & (move("ay") > 2), F.lit(False)).alias("grasps"), r6(g.distance(point("a"), point("c"))).alias("gap"), (F.col("k") < 10).alias("closed"))


@R.query(BASE + "SELECT event_id, round(-(1 * (1 - 2 * (qx * qx + qz * qz))), 6) + 0.0 AS along FROM q")
def pf18_pf21_axis_angle(spark: SparkSession, d: str) -> DataFrame:
    """The turned axis '-y' along +y."""
    v = g.m_apply(g.q_matrix(quat("q")), g.axis_vector("-y"))
    return base(spark, d).select("event_id", r6(v[1]).alias("along"))


@R.query(BASE + REL + "SELECT event_id, round(sqrt(rx * rx + ry * ry), 5) AS planar FROM f")
def pf20_distance_to_target(spark: SparkSession, d: str) -> DataFrame:
    """Distance in the target's own frame, the z axis ignored."""
    rel = g.pose_relative((g.q_matrix(quat("q")), point("c")), (g.q_matrix(quat("p")), point("a")))
    return base(spark, d).select("event_id", F.round(g.norm(rel[1][:2]), 5).alias("planar"))


@R.query(BASE + "SELECT event_id FROM q WHERE 1 - 2 * (qy * qy + qz * qz) > 0 AND 2 * (qx * qy + qw * qz) > 0 AND 1 - 2 * (qx * qx + qy * qy) > 0")
def pf31_pf32_grasp_posture(spark: SparkSession, d: str) -> DataFrame:
    """Sign tests on cells of the grasp's rotation."""
    m = g.q_matrix(quat("q"))
    return base(spark, d).where((m[0][0] > 0) & (m[1][0] > 0) & (m[2][2] > 0)).select("event_id")


@R.query(BASE + "SELECT user_id, count(*) FILTER (az BETWEEN 1.2 AND 3.5 AND az / sqrt(ax * ax + ay * ay + az * az) >= cos(radians(60))) AS seen FROM q GROUP BY 1")
def pf38_frustum(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("az") / g.norm(point("a"))
    return base(spark, d).groupBy("user_id").agg(F.count_if(F.col("az").between(1.2, 3.5) & (c >= F.cos(F.radians(F.lit(60.0))))).alias("seen"))


@R.query(BASE + "SELECT user_id, round(sum(dt), 4) AS metres FROM (SELECT user_id, sqrt(pow(ax - lag(ax) OVER w, 2) + pow(ay - lag(ay) OVER w, 2) + pow(az - lag(az) OVER w, 2)) AS dt FROM q WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1")
def ag49_pose_path(spark: SparkSession, d: str) -> DataFrame:
    return ts.path_length(base(spark, d), ["ax", "ay", "az"], ["user_id"], ["ts", "event_id"], "metres").withColumn("metres", F.round("metres", 4))
