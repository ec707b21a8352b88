"""Folds, grids and graphs: WN08, WN26, SR06, SR10-12, SR24-25, AG52-54, GR03-18, and streams SM02-SM16 run to their end."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions import geom as g
from kinelake.operators import folds, grids
from kinelake.operators import timeseries as ts
from kinelake.plans.q_geometry import BASE, base
from kinelake.plans.registry import Registry, r6
from kinelake.session import scratch_path, table
from kinelake.streaming import live

R = Registry()
QUERIES, SQL = R.queries, R.sql


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Poses by user: a run is one user's events."""
    return base(spark, d)


@R.query(BASE + "SELECT user_id, min(event_id) FILTER (ax / 40 < 0.1 AND az - z1 > 0.001) AS grasped_at FROM (SELECT *, lag(az) OVER (PARTITION BY user_id ORDER BY event_id) AS z1 FROM q) GROUP BY 1")
def wn08_pf14_grasp(spark: SparkSession, d: str) -> DataFrame:
    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("event_id")
        i = folds.grasp_ticks(p["az"].to_numpy(), (p["ax"] / 40).to_numpy(), need=1)
        return pd.DataFrame({"grasped_at": pd.array([None if i is None else int(p["event_id"].iloc[i])], dtype="Int64")})

    return folds.per_group(runs(spark, d).select("user_id", "event_id", "az", "ax"), ["user_id"], fold, "user_id long, grasped_at long")


@R.query()
def wn26_simplify(spark: SparkSession, d: str) -> DataFrame:
    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("event_id")
        keep = folds.simplify_path(p[["ax", "ay"]].to_numpy(), 1.0, 20.0)
        return pd.DataFrame({"event_id": p["event_id"].to_numpy()[keep]})

    return folds.per_group(runs(spark, d).select("user_id", "event_id", "ax", "ay"), ["user_id"], fold, "user_id long, event_id long")


@R.query()
def sr10_sr11_sr12_samples(spark: SparkSession, d: str) -> DataFrame:
    """Of each run: spaced sample, three farthest points, place in the greedy tour."""

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("event_id").reset_index(drop=True)
        x = p[["ax", "ay"]].to_numpy()
        near, far, tour = set(folds.spaced_sample(x, 2.0)), set(folds.farthest_points(x, 3)), folds.nearest_order(x)
        place = np.empty(len(p), int)
        place[tour] = np.arange(len(p))
        return pd.DataFrame({"event_id": p["event_id"], "spaced": [i in near for i in p.index], "farthest": [i in far for i in p.index], "tour_no": place})

    return folds.per_group(runs(spark, d).select("user_id", "event_id", "ax", "ay"), ["user_id"], fold, "user_id long, event_id long, spaced boolean, farthest boolean, tour_no int")


@R.query()
def ag53_ndtw(spark: SparkSession, d: str) -> DataFrame:
    """Path fidelity of each run against the straight line through its ends."""

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        x = p.sort_values("event_id")[["ax", "ay"]].to_numpy()
        truth = np.linspace(x[0], x[-1], len(x))
        return pd.DataFrame({"ndtw": [round(folds.ndtw(x, truth, 3.0), 6)]})

    return folds.per_group(runs(spark, d).select("user_id", "event_id", "ax", "ay"), ["user_id"], fold, "user_id long, ndtw double")


RESOLUTION = 24


def occupied(p: pd.DataFrame) -> np.ndarray:
    """A robot's map: cells in which it has stood are walls, on a grid over the range of the map's own points."""
    free = np.ones((RESOLUTION, RESOLUTION), bool)
    x, y = p["ax"].to_numpy(float), p["ay"].to_numpy(float)
    cell = lambda v: np.clip(((v - v.min()) / max(v.max() - v.min(), 1e-9) * (RESOLUTION - 1)).astype(int), 0, RESOLUTION - 1)
    free[cell(y), cell(x)] = False
    return free


@R.query()
def gr04_gr07_gr12_gr13_plans(spark: SparkSession, d: str) -> DataFrame:
    """On each user's map, whose walls are the cells of the user's points: path over safety cost, pulled tight without cutting corners or costs, as actions; start and goal are moved to the nearest free cell."""

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        free = occupied(p.sort_values("event_id"))
        cost = folds.safety_cost(free, 3)
        start, goal = folds.nearest_free(free, (0, 0)), folds.nearest_free(free, (RESOLUTION - 1, RESOLUTION - 1))
        path = folds.shortest_path(free, start, goal, cost) if start and goal else []
        tight = folds.pull_string(free, path, cost, 1.0)
        acts = folds.follow_actions(np.array(tight, float) * 0.25) if tight else []
        return pd.DataFrame({"n_free": [int(free.sum())], "n_cells": [len(path)], "n_nodes": [len(tight)], "n_actions": [len(acts)]})

    return folds.per_group(runs(spark, d).select("user_id", "event_id", "ax", "ay"), ["user_id"], fold, "user_id long, n_free int, n_cells int, n_nodes int, n_actions int")


@R.query()
def gr05_gr06_sight(spark: SparkSession, d: str) -> DataFrame:
    """Line of sight between the corners of each user's map, plain, with blocked corners, and with a limit of cost."""

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        free = occupied(p)
        cost, a, b = folds.safety_cost(free, 3), (0, RESOLUTION // 2), (RESOLUTION - 1, RESOLUTION // 2 + 5)
        return pd.DataFrame({"clear": [all(free[y, x] for x, y in folds.line_cells(a, b))], "in_sight": [folds.in_sight(free, a, b)], "cheap": [folds.in_sight(free, a, b, cost, 0.5)]})

    return folds.per_group(runs(spark, d).select("user_id", "ax", "ay"), ["user_id"], fold, "user_id long, clear boolean, in_sight boolean, cheap boolean")


@R.query()
def gr03_chains(spark: SparkSession, d: str) -> DataFrame:
    """The graph of each scene record with its chains compressed (a record's graph is small)."""
    from kinelake.operators import nested

    links = nested.scene_tables(table(spark, d, "scene_records"), wide=False)["links"].select("scene_uid", "source", "target")

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(folds.compress_chains(list(zip(p["source"], p["target"]))), columns=["source", "target", "steps"])

    return folds.per_group(links, ["scene_uid"], fold, "scene_uid long, source string, target string, steps int")


@R.query()
def gr15_layouts(spark: SparkSession, d: str) -> DataFrame:
    """A seeded layout of each nation's suppliers as rectangles in a room (a scene's few objects)."""

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("s_suppkey")
        spots = folds.place_rectangles([(0.5 + k % 3 / 4, 0.4 + k % 5 / 5) for k in p["s_suppkey"]], (6.0, 6.0), 0.05, int(p["s_suppkey"].iloc[0]))
        return pd.DataFrame({"s_suppkey": p["s_suppkey"].to_numpy(), "x": [None if s is None else round(s[0], 6) for s in spots], "y": [None if s is None else round(s[1], 6) for s in spots]})

    return folds.per_group(table(spark, d, "supplier").select("s_nationkey", "s_suppkey"), ["s_nationkey"], fold, "s_nationkey int, s_suppkey long, x double, y double")


@R.query()
def gr16_assignments(spark: SparkSession, d: str) -> DataFrame:
    """Four shapes of each region, each accepting the nations of one remainder, get instances of their own."""

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        have = sorted(p["n_nationkey"])
        got = folds.assign_shapes([{k for k in have if k % 3 != i % 3} for i in range(4)], have)
        return pd.DataFrame({"shape_no": range(4), "n_nationkey": got if got else [None] * 4})

    return folds.per_group(table(spark, d, "nation").select("n_regionkey", "n_nationkey"), ["n_regionkey"], fold, "n_regionkey int, shape_no int, n_nationkey int")


@R.query()
def gr10_ground_planes(spark: SparkSession, d: str) -> DataFrame:
    def fold(p: pd.DataFrame) -> pd.DataFrame:
        plane, n = folds.ground_plane(p.sort_values("event_id")[["ax", "ay", "az"]].to_numpy(), 0.2)
        return pd.DataFrame({"nz": [round(float(plane[2]), 6)], "n_inliers": [n]})

    return folds.per_group(runs(spark, d).select("user_id", "event_id", "ax", "ay", "az"), ["user_id"], fold, "user_id long, nz double, n_inliers int")


CELLS = "SELECT DISTINCT CAST(l_quantity AS INT) AS gx, CAST(round(l_discount * 100) AS INT) AS gy FROM lineitem"


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Occupied cells of the whole table."""
    return table(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("gx"), F.round(F.col("l_discount") * 100).cast("int").alias("gy")).distinct()


@R.query(f"WITH c AS ({CELLS}), o AS (SELECT * FROM (VALUES (-1), (0), (1)) AS t(o)) SELECT DISTINCT gx + a.o AS gx, gy + b.o AS gy FROM c, o a, o b")
def gr08_dilate(spark: SparkSession, d: str) -> DataFrame:
    return grids.dilate(cells(spark, d))


@R.query(f"WITH c AS ({CELLS}), o AS (SELECT * FROM (VALUES (-1), (0), (1)) AS t(o)) SELECT gx, gy FROM (SELECT gx + a.o AS gx, gy + b.o AS gy FROM c, o a, o b) GROUP BY 1, 2 HAVING count(*) = 9")
def gr08_erode(spark: SparkSession, d: str) -> DataFrame:
    return grids.erode(cells(spark, d))


@R.query(
    """WITH RECURSIVE e AS (SELECT a.s_suppkey AS src, b.s_suppkey AS dst FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) <= 60),
    r(node, seen) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT r.node, e.dst FROM r JOIN e ON r.seen = e.src)
    SELECT node, min(seen) AS component FROM r GROUP BY 1"""
)
def gr08_components(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return grids.density_clusters(s.select("s_suppkey", "s_acctbal"), "s_suppkey", ["s_acctbal"], 60.0, 1).select(F.col("s_suppkey").alias("node"), F.coalesce("cluster", "s_suppkey").alias("component"))


@R.query(
    """WITH RECURSIVE p AS (SELECT a.s_suppkey AS k, b.s_suppkey AS o FROM supplier a JOIN supplier b ON sqrt(pow((a.s_acctbal - b.s_acctbal) / 100, 2) + pow(a.s_nationkey - b.s_nationkey, 2)) <= 6),
    c AS (SELECT k FROM p GROUP BY 1 HAVING count(*) >= 4), l AS (SELECT p.k, p.o FROM p JOIN c ON c.k = p.k JOIN c d ON d.k = p.o),
    r(k, seen) AS (SELECT k, k FROM c UNION SELECT r.k, l.o FROM r JOIN l ON r.seen = l.k), m AS (SELECT k, min(seen) AS component FROM r GROUP BY 1)
    SELECT s_suppkey, coalesce(any_value(own.component), min(near.component)) AS cluster FROM supplier LEFT JOIN m own ON own.k = s_suppkey LEFT JOIN p ON p.k = s_suppkey LEFT JOIN m near ON near.k = p.o GROUP BY 1"""
)
def gr09_density_clusters(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return grids.density_clusters(s, "s_suppkey", ["x", "y"], 6.0, 4)


@R.query("SELECT a.s_suppkey FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey AND sqrt(pow((a.s_acctbal - b.s_acctbal) / 100, 2) + pow(a.s_nationkey - b.s_nationkey, 2)) <= 6 GROUP BY 1 HAVING count(*) >= 3")
def gr11_outliers(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return grids.without_lonely(s, "s_suppkey", ["x", "y"], 6.0, 3).select("s_suppkey")


@R.query()
def gr17_representatives(spark: SparkSession, d: str) -> DataFrame:
    """Centres of ten clusters of the parts (size, price), seeded."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=["p_size", "p_retailprice"], outputCol="features").transform(table(spark, d, "part").select("p_size", "p_retailprice"))
    model = KMeans(k=10, seed=3, maxIter=10).fit(x)
    return spark.createDataFrame([(i, float(round(c[0], 4)), float(round(c[1], 4))) for i, c in enumerate(model.clusterCenters())], "cluster int, p_size double, p_retailprice double")


@R.query("SELECT s_nationkey, min(s_acctbal * 0.6 + s_suppkey * 0.8) >= -1000 AS bound, max(s_acctbal * 0.6 + s_suppkey * 0.8) - min(s_acctbal * 0.6 + s_suppkey * 0.8) <= 4000 AS aligned FROM supplier GROUP BY 1")
def gr18_assertions(spark: SparkSession, d: str) -> DataFrame:
    """Extent along an axis: bound and alignment assertions."""
    along = g.dot((F.col("s_acctbal"), F.col("s_suppkey")), (0.6, 0.8))
    return table(spark, d, "supplier").groupBy("s_nationkey").agg((F.min(along) >= -1000).alias("bound"), (F.max(along) - F.min(along) <= 4000).alias("aligned"))


@R.query("SELECT a.s_nationkey, round(avg(m), 6) AS cost FROM (SELECT a.s_nationkey, a.s_suppkey, min(abs(a.s_acctbal - b.s_acctbal) + 0.5 * abs(a.s_suppkey - b.s_suppkey)) AS m FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey % 2 = 0 AND b.s_suppkey % 2 = 1 GROUP BY 1, 2) a GROUP BY 1")
def ag52_pose_sets(spark: SparkSession, d: str) -> DataFrame:
    """Mean over A of the least distance to B, within a nation's few suppliers."""
    s = table(spark, d, "supplier")
    a = s.where("s_suppkey % 2 = 0").select("s_nationkey", F.col("s_suppkey").alias("ka"), F.col("s_acctbal").alias("xa"))
    b = s.where("s_suppkey % 2 = 1").select("s_nationkey", F.col("s_suppkey").alias("kb"), F.col("s_acctbal").alias("xb"))
    m = a.join(b, "s_nationkey").groupBy("s_nationkey", "ka").agg(F.min(F.abs(F.col("xa") - F.col("xb")) + 0.5 * F.abs(F.col("ka") - F.col("kb"))).alias("m"))
    return m.groupBy("s_nationkey").agg(r6(F.avg("m")).alias("cost"))


@R.query("SELECT event_id, round(-0.01 + coalesce(lag(value) OVER w - value, 0) + CASE WHEN value < 3 THEN 10 ELSE 0 END, 6) + 0.0 AS reward FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def ag54_waypoint_reward(spark: SparkSession, d: str) -> DataFrame:
    """Slack, progress and success."""
    w = ts.order(["user_id"], ["ts", "event_id"])
    v = F.col("value")
    return table(spark, d, "events").select("event_id", r6(-0.01 + F.coalesce(F.lag("value").over(w) - v, F.lit(0.0)) + F.when(v < 3, 10).otherwise(0)).alias("reward"))


def _stream(spark: SparkSession, d: str, files: int = 1, cuts: int = 4) -> DataFrame:
    """The events as a stream of files that arrive one after another, in order of time, ``files`` a trigger."""
    e, path = table(spark, d, "events"), scratch_path(spark, "arrivals")
    span = e.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("a"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("b")).first()
    part = F.least(F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(span["a"])) * cuts / F.lit(max(1, (span["b"] or 0) - (span["a"] or 0)))), F.lit(cuts - 1))
    for i in range(cuts):
        e.where(part == i).coalesce(1).write.mode("append").parquet(path)
    return live.file_stream(spark, path, e.schema, files)


def _run(stream: DataFrame, mode: str) -> DataFrame:
    spark = stream.sparkSession
    return live.run_once(stream, mode, scratch_path(spark, "stream"), scratch_path(spark, "result"))


@R.query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance FROM events GROUP BY 1")
def sm04_sm15_live_stats(spark: SparkSession, d: str) -> DataFrame:
    s = _run(live.live_stats(_stream(spark, d), "event_type", "value"), "complete")
    return s.select("event_type", "n", r6("mean").alias("mean"), F.round("variance", 4).alias("variance"))


@R.query("SELECT count(*) AS n, sum(event_id)::BIGINT AS ids FROM events")
def sm03_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Deduplicated by id within the watermark: ids are unique here, so all stay."""
    return _run(live.first_wins(_stream(spark, d), ["event_id"]), "append").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@R.query(
    """WITH r AS (SELECT user_id, event_id, event_type, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gate FROM events)
    SELECT user_id, event_id FROM r WHERE event_type NOT IN ('signup', 'purchase') AND gate = 'signup'"""
)
def sm02_sm05_gate(spark: SparkSession, d: str) -> DataFrame:
    """Rows pass from a user's signup to the next purchase: state per key."""
    return _run(live.gated(_stream(spark, d), "signup", "purchase"), "append")


@R.query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def sm08_sm11_keep_last(spark: SparkSession, d: str) -> DataFrame:
    """The directory poller with a sink that keeps each user's last row over all batches."""
    out, mark = scratch_path(spark, "last"), scratch_path(spark, "stream")
    live.keep_last_sink(_stream(spark, d), out, ["user_id"], ["ts", "event_id"], mark).awaitTermination()
    return live.read_kept(spark, out).select("user_id", "event_id", "event_type")


@R.query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r(user_id, n, t, event_id) AS (SELECT user_id, n, t, event_id FROM e WHERE n = 1 UNION ALL
      SELECT user_id, n, t, event_id FROM (SELECT e.*, row_number() OVER (PARTITION BY e.user_id ORDER BY e.n) AS k FROM r JOIN e ON e.user_id = r.user_id AND e.n > r.n AND e.t - r.t >= 86400) WHERE k = 1)
    SELECT user_id, event_id FROM r"""
)
def sm12_paced(spark: SparkSession, d: str) -> DataFrame:
    """A rate limiter: at most one row a day and user, counted from the last one that passed."""
    return _run(live.paced(_stream(spark, d), 1 / 86400), "append")


@R.query("SELECT event_id, user_id, event_type FROM events")
def sm16_state_log(spark: SparkSession, d: str) -> DataFrame:
    """The append-only log of frame states: every row once, whatever batch it came in."""
    out, mark = scratch_path(spark, "log"), scratch_path(spark, "stream")
    live.state_log(_stream(spark, d), out, mark).awaitTermination()
    return spark.read.option("recursiveFileLookup", True).parquet(out).select("event_id", "user_id", "event_type")


@R.query(
    """SELECT user_id, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, count(*) AS n FROM events
    WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2"""
)
def sm13_windows(spark: SparkSession, d: str) -> DataFrame:
    """Chunked windows of a stream: those that the watermark has closed."""
    w = _run(live.windows(_stream(spark, d), "user_id", "1 day"), "append")
    return w.select("user_id", F.unix_micros("start_at").alias("start_us"), "n")
