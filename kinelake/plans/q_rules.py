"""Filter chains and rule-tree leaves on the events' poses: PF04, PF22, AD."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.functions import geom as g
from kinelake.operators import rules
from kinelake.operators import timeseries as ts
from kinelake.plans.q_geometry import BASE, base, point, quat
from kinelake.plans.registry import Registry, r6
from kinelake.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql
ORDER = (["user_id"], ["ts", "event_id"])
W = "(PARTITION BY user_id ORDER BY ts, event_id)"


def consecutive(df: DataFrame, flag, n: int) -> DataFrame:
    """(event_id, fired): the flag has held on the last n frames."""
    return ts.run_length(df, flag, *ORDER).select("event_id", (F.col("run") >= n).alias("fired"))


def consecutive_sql(condition: str, n: int) -> str:
    lags = " AND ".join(f"coalesce(lag(f, {i}) OVER {W}, false)" for i in range(1, n))
    return BASE + f", c AS (SELECT *, coalesce({condition}, false) AS f FROM q) SELECT event_id, f{' AND ' + lags if lags else ''} AS fired FROM c"


CHAIN = [
    {"rule_name": "min_frames", "params": {"n": 40}, "result_code": 4},
    {"rule_name": "low_average", "params": {"limit": 30.5}, "result_code": 7},
    {"rule_name": "enough_clicks", "params": {"n": 12}},
]


@R.query(
    """SELECT user_id, n >= 40 AND a <= 30.5 AND c >= 12 AS valid, CASE WHEN n < 40 THEN 4 WHEN a > 30.5 THEN 7 WHEN c < 12 THEN 1 ELSE 0 END AS result_code,
    CASE WHEN n < 40 THEN 'min_frames' WHEN a > 30.5 THEN 'low_average' WHEN c < 12 THEN 'enough_clicks' ELSE 'ok' END AS status
    FROM (SELECT user_id, count(*) AS n, avg(value) AS a, count(*) FILTER (event_type = 'click') AS c FROM events GROUP BY 1)"""
)
def pf04_pf22_chain(spark: SparkSession, d: str) -> DataFrame:
    """The first failing rule decides; rules come from a registry by name."""
    registry = {"min_frames": lambda n: F.col("n") >= n, "low_average": lambda limit: F.col("a") <= limit, "enough_clicks": lambda n: F.col("c") >= n}
    x = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("a"), F.count_if(F.col("event_type") == "click").alias("c"))
    return x.withColumn("r", rules.filter_chain(CHAIN, registry)).select("user_id", "r.valid", "r.result_code", "r.status")


@R.query(consecutive_sql("ax BETWEEN 0.7774 AND 3.2226 AND ay BETWEEN 0.1096 AND 9.8904", 2))
def ad01_inside(spark: SparkSession, d: str) -> DataFrame:
    """Point in a scaled box on two consecutive frames."""
    low, high = g.scaled_box((0.0, -3.0), (4.0, 13.0), 0.6113)
    return consecutive(base(spark, d), g.in_box((F.col("ax"), F.col("ay")), low, high), 2)


@R.query(consecutive_sql("abs(ax - 2) <= 1.5 AND abs(ay - 4) <= 3 AND abs(az - 2) <= 1", 2))
def ad02_in_bbox(spark: SparkSession, d: str) -> DataFrame:
    """Point in a box given by centre and lengths."""
    c, n = (2.0, 4.0, 2.0), (3.0, 6.0, 2.0)
    return consecutive(base(spark, d), g.in_box(point("a"), [x - s / 2 for x, s in zip(c, n)], [x + s / 2 for x, s in zip(c, n)]), 2)


@R.query(
    BASE
    + """SELECT event_id, abs(az - (cz + 1)) <= 0.4 AND greatest(least(ax + 4, cx + 3) - greatest(ax, cx), 0) * greatest(least(ay + 2, cy + 5) - greatest(ay, cy), 0) / 15 >= 0.1 AS ontop,
    az - (cz + 1) <= 0.002 AND greatest(least(ax + 4, cx + 3) - greatest(ax, cx), 0) * greatest(least(ay + 2, cy + 5) - greatest(ay, cy), 0) / 8 >= 0.1 AS covers FROM q"""
)
def ad03_ad04_ontop_cover(spark: SparkSession, d: str) -> DataFrame:
    """Gap between bottom and top, and overlap relative to the larger (on top) or the smaller face (cover)."""
    overlap = g.overlap_1d(F.col("ax"), F.col("ax") + 4, F.col("cx"), F.col("cx") + 3) * g.overlap_1d(F.col("ay"), F.col("ay") + 2, F.col("cy"), F.col("cy") + 5)
    gap = F.col("az") - (F.col("cz") + 1)
    return base(spark, d).select("event_id", ((F.abs(gap) <= 0.4) & (overlap / 15 >= 0.1)).alias("ontop"), ((gap <= 0.002) & (overlap / 8 >= 0.1)).alias("covers"))


@R.query(BASE + "SELECT user_id, min(event_id) AS dropped_at FROM q WHERE abs(az - 1.2) < 0.3 GROUP BY 1")
def ad05_onfloor(spark: SparkSession, d: str) -> DataFrame:
    """The terminal tick: the first frame near the floor's height."""
    return ts.first_tick(base(spark, d), F.abs(F.col("az") - 1.2) < 0.3, ["user_id"], "event_id").withColumnRenamed("first_tick", "dropped_at")


@R.query(BASE + "SELECT user_id, event_type AS followed, min(event_id) AS at_tick FROM q WHERE ax BETWEEN 1 AND 3 AND ay BETWEEN 2 AND 6 AND event_type IN ('click', 'view') GROUP BY 1, 2")
def ad06_ad25_ad26_follow(spark: SparkSession, d: str) -> DataFrame:
    """AD06, AD25, AD26: of a list of objects each is followed at its first match; the match is bound for later leaves."""
    wanted = F.split(F.lit("click,view"), ",")
    inside = g.in_box((F.col("ax"), F.col("ay")), (1, 2), (3, 6))
    x = base(spark, d).where(F.array_contains(wanted, F.col("event_type")) & inside)
    return x.groupBy("user_id", F.col("event_type").alias("followed")).agg(F.min("event_id").alias("at_tick"))


@R.query(BASE + f"SELECT event_id, az - first_value(az) OVER {W} > 0.02 AND sqrt(pow(ax - cx, 2) + pow(ay - cy, 2) + pow(az - cz, 2)) < 4 AS picked, az - first_value(az) OVER {W} >= 0.5 AS lifted FROM q")
def ad07_ad08_pickup_lift(spark: SparkSession, d: str) -> DataFrame:
    rise = F.col("az") - F.first("az").over(ts.order(*ORDER))
    return base(spark, d).select("event_id", ((rise > 0.02) & (g.distance(point("a"), point("c")) < 4)).alias("picked"), (rise >= 0.5).alias("lifted"))


@R.query(BASE + "SELECT event_id, 2 * (qy * qz + qw * qx) >= cos(radians(80)) AS upright FROM q")
def ad09_upright(spark: SparkSession, d: str) -> DataFrame:
    """z component of the turned y axis."""
    return base(spark, d).select("event_id", (g.m_apply(g.q_matrix(quat("q")), g.axis_vector("y"))[2] >= F.cos(F.radians(F.lit(80.0)))).alias("upright"))


@R.query(consecutive_sql("sqrt(pow(ax - cx, 2) + pow(ay - cy, 2) + pow(az - cz, 2)) < 6", 2))
def ad10_stable_grasp(spark: SparkSession, d: str) -> DataFrame:
    return consecutive(base(spark, d), g.distance(point("a"), point("c")) < 6, 2)


@R.query(BASE + f"SELECT event_id, sum((v BETWEEN 10 AND 30)::INT) OVER {W} >= 2 AS pushed, sum((ax > 0.5 AND ax < 3)::INT) OVER {W} > 5 AS shelved FROM q")
def ad11_ad12_cumulative(spark: SparkSession, d: str) -> DataFrame:
    """Counters that never reset."""
    count = lambda c: ts.cumulative_true(c, *ORDER)
    return base(spark, d).select("event_id", (count(F.col("v").between(10, 30)) >= 2).alias("pushed"), (count((F.col("ax") > 0.5) & (F.col("ax") < 3)) > 5).alias("shelved"))


@R.query(
    BASE
    + """, y AS (SELECT *, degrees(atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz))) - 30 + 180 AS s FROM q)
    SELECT event_id, abs(ax - 3) <= 2 AND abs(ay - 5) <= 4 AND abs(s - 360 * floor(s / 360) - 180) <= 45 AS at_target, abs(ax - cx) < 1 AND abs(ay - cy) < 2 AND abs(az - cz) < 1 AS approached FROM y"""
)
def ad13_ad14_target(spark: SparkSession, d: str) -> DataFrame:
    yaw = F.abs(g.wrap_degrees(g.q_yaw(quat("q")) - 30))
    near = (F.abs(F.col("ax") - 3) <= 2) & (F.abs(F.col("ay") - 5) <= 4) & (yaw <= 45)
    close = (F.abs(F.col("ax") - F.col("cx")) < 1) & (F.abs(F.col("ay") - F.col("cy")) < 2) & (F.abs(F.col("az") - F.col("cz")) < 1)
    return base(spark, d).select("event_id", near.alias("at_target"), close.alias("approached"))


@R.query(
    """WITH RECURSIVE e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type AS t, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events),
    r(user_id, day, n, state, passed) AS (SELECT DISTINCT user_id, day, 0::BIGINT, 0, 0 FROM e UNION ALL
      SELECT user_id, day, n, s, passed + (s = 3)::INT FROM (SELECT r.user_id, r.day, e.n, r.passed, CASE WHEN state = 0 AND t = 'click' THEN 1 WHEN state = 1 AND t = 'view' THEN 2 WHEN state = 2 AND t = 'purchase' THEN 3 WHEN t = 'error' THEN 0 WHEN state = 3 THEN 0 ELSE state END AS s
        FROM r JOIN e ON r.user_id = e.user_id AND r.day = e.day AND e.n = r.n + 1))
    SELECT user_id, day, arg_max(state, n) AS state, max(passed) AS passed FROM r GROUP BY 1, 2"""
)
def ad15_sm06_passing(spark: SparkSession, d: str) -> DataFrame:
    """A four-state machine over each user-day: idle, held left, both, handed over; counts the hand-overs."""
    x = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    left, both, right = F.lit("click"), F.lit("view"), F.lit("purchase")

    def step(acc, ev):
        s, t = acc["state"], ev["event_type"]
        nxt = F.when((s == 0) & (t == left), 1).when((s == 1) & (t == both), 2).when((s == 2) & (t == right), 3).when(t == "error", 0).otherwise(F.when(s == 3, 0).otherwise(s))
        return F.struct(nxt.alias("state"), (acc["passed"] + F.when(nxt == 3, 1).otherwise(0)).alias("passed"))

    out = F.aggregate("e", F.struct(F.lit(0).alias("state"), F.lit(0).alias("passed")), step)
    return x.select("user_id", "day", out["state"].alias("state"), out["passed"].alias("passed"))


@R.query(BASE + "SELECT user_id, count(*) FILTER (ax BETWEEN 0 AND 1 AND ay BETWEEN 0 AND 5) < 12 AS few_inside, count(*) FILTER (ax BETWEEN 0 AND 3 AND az BETWEEN 1 AND 2) > 10 AS fluid_inside, count(*) FILTER (v > 60) < 8 AS clean FROM q GROUP BY 1")
def ad16_17_18_counts(spark: SparkSession, d: str) -> DataFrame:
    """Conditional counts: particles in a box, fluid inside, visible stains."""
    x, y, z = point("a")
    return base(spark, d).groupBy("user_id").agg(
        (F.count_if(x.between(0, 1) & y.between(0, 5)) < 12).alias("few_inside"), (F.count_if(x.between(0, 3) & z.between(1, 2)) > 10).alias("fluid_inside"), (F.count_if(F.col("v") > 60) < 8).alias("clean")
    )


@R.query(BASE + "SELECT event_id, event_type = 'signup' AS triggered, abs(ay - cy) < 1.5 AS passed FROM q")
def ad19_ad20_equal_near(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).select("event_id", (F.col("event_type") == "signup").alias("triggered"), (F.abs(F.col("ay") - F.col("cy")) < 1.5).alias("passed"))


@R.query(
    f"""WITH r AS (SELECT *, row_number() OVER {W} AS tick FROM events), m AS (SELECT *, max(CASE WHEN tick % 5 = 0 THEN least(value / 100, 1) END) OVER {W} AS best FROM r)
    SELECT event_id, round(coalesce(best, 0), 6) AS best, coalesce(best >= 1, false) AS done FROM m"""
)
def ad21_running_max(spark: SparkSession, d: str) -> DataFrame:
    """A score taken every fifth tick, its running maximum, done at 1."""
    w = ts.order(*ORDER)
    x = table(spark, d, "events").withColumn("tick", F.row_number().over(w))
    best = F.max(F.when(F.col("tick") % 5 == 0, F.least(F.col("value") / 100, F.lit(1.0)))).over(w.rowsBetween(*ts.ALL_BEFORE))
    return x.withColumn("b", best).select("event_id", r6(F.coalesce("b", F.lit(0.0))).alias("best"), F.coalesce(F.col("b") >= 1, F.lit(False)).alias("done"))


@R.query(f"SELECT user_id, min(event_id) FILTER (elapsed >= 1000) AS timeout_at, min(event_id) FILTER (step_no > 30) AS step_out_at FROM (SELECT user_id, event_id, sum(value) OVER {W} AS elapsed, row_number() OVER {W} AS step_no FROM events) GROUP BY 1")
def ad22_ad23_timeouts(spark: SparkSession, d: str) -> DataFrame:
    w = ts.order(*ORDER)
    x = table(spark, d, "events").select("user_id", "event_id", F.sum("value").over(w.rowsBetween(*ts.ALL_BEFORE)).alias("elapsed"), F.row_number().over(w).alias("step_no"))
    return x.groupBy("user_id").agg(F.min(F.when(F.col("elapsed") >= 1000, F.col("event_id"))).alias("timeout_at"), F.min(F.when(F.col("step_no") > 30, F.col("event_id"))).alias("step_out_at"))


@R.query(
    BASE
    + """SELECT event_id, round(ax - (abs(1 - 2 * (qy * qy + qz * qz)) * 2 + abs(2 * (qx * qy - qw * qz)) * 1 + abs(2 * (qx * qz + qw * qy)) * 0.5), 6) + 0.0 AS low_x,
    round(az + (abs(2 * (qx * qz - qw * qy)) * 2 + abs(2 * (qy * qz + qw * qx)) * 1 + abs(1 - 2 * (qx * qx + qy * qy)) * 0.5), 6) + 0.0 AS high_z FROM q"""
)
def ad24_rotated_box(spark: SparkSession, d: str) -> DataFrame:
    low, high = g.box_of_rotated(point("a"), (4.0, 2.0, 1.0), g.q_matrix(quat("q")))
    return base(spark, d).select("event_id", r6(low[0]).alias("low_x"), r6(high[2]).alias("high_z"))


TREE = {"ActionList": [{"ActionSetWaitAny": [{"Is": "click"}, {"Above": "60"}]}, {"ActionSetWaitAll": [{"Is": "view"}, {"Is": "purchase"}]}, {"ActionSetWaitSome_2": [{"Is": "signup"}, {"Is": "error"}, {"Above": "80"}]}]}


@R.query(
    """WITH e AS (SELECT user_id, event_id, event_type AS t, value AS v FROM events), s AS (SELECT user_id, min(event_id) AS a FROM e GROUP BY 1),
    one AS (SELECT s.user_id, min(event_id) AS b FROM s JOIN e ON e.user_id = s.user_id AND event_id >= a AND (t = 'click' OR v > 60) GROUP BY 1),
    two AS (SELECT one.user_id, greatest(min(event_id) FILTER (t = 'view'), min(event_id) FILTER (t = 'purchase')) AS c, count(DISTINCT t) FILTER (t IN ('view', 'purchase')) AS k FROM one JOIN e ON e.user_id = one.user_id AND event_id >= b GROUP BY 1),
    three AS (SELECT two.user_id, list_sort(list_filter([min(event_id) FILTER (t = 'signup'), min(event_id) FILTER (t = 'error'), min(event_id) FILTER (v > 80)], lambda x: x IS NOT NULL))[2] AS d FROM two JOIN e ON e.user_id = two.user_id AND event_id >= c WHERE k = 2 GROUP BY 1)
    SELECT s.user_id, d AS satisfied_at, CASE WHEN d IS NOT NULL THEN 'done' ELSE 'open' END AS outcome FROM s LEFT JOIN three USING (user_id)"""
)
def ader_tree(spark: SparkSession, d: str) -> DataFrame:
    """Sequence of any, all, and two of three; the tick at which each user's events satisfy it."""

    def leaf(node: rules.Node):
        return (lambda f: f["event_type"] == node.args[0]) if node.op == "Is" else (lambda f: f["value"] > float(node.args[0]))

    return rules.evaluate_tree(table(spark, d, "events"), rules.parse_tree(TREE), leaf, "user_id", "event_id", ["event_type", "value"])
