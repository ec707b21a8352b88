"""The rest of the joins, samples, noise and frame arithmetic: JN14-22, JN26, PF03, SR06, SR14, SR24-25, MA28-29, SRC20, SRC25, SNK06-13."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.functions import geom as g
from kinelake.operators import folds
from kinelake.plans.q_geometry import BASE, base
from kinelake.plans.registry import Registry, r6
from kinelake.session import table
from kinelake.sources import sinks

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.query(
    """SELECT a.s_suppkey AS a_key, b.s_suppkey AS b_key FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey
    WHERE abs(a.s_acctbal - b.s_acctbal) <= 2000 AND abs(a.s_suppkey - b.s_suppkey) <= 40"""
)
def jn14_polygons_touch(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles of one map that aren't separated by an axis: corner (balance, key), 2000 by 40. Only those in the same or neighbouring cells of that size meet."""
    s = table(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("x"), F.col("s_suppkey").cast("double").alias("y"))
    s = s.withColumns({"gx": F.floor(F.col("x") / 2000), "gy": F.floor(F.col("y") / 40)})
    around = F.array(*[F.lit(o) for o in (-1, 0, 1)])
    a = s.select("s_nationkey", *[F.col(c).alias("a_" + c) for c in "kxy"], "gx", "gy")
    b = s.select("s_nationkey", *[F.col(c).alias("b_" + c) for c in "kxy"], F.explode(F.transform(around, lambda o: F.col("gx") + o)).alias("gx"), "gy")
    b = b.select("s_nationkey", "b_k", "b_x", "b_y", "gx", F.explode(F.transform(around, lambda o: F.col("gy") + o)).alias("gy"))
    box = lambda p: [(F.col(p + "x") + dx, F.col(p + "y") + dy) for dx, dy in ((0, 0), (2000, 0), (2000, 40), (0, 40))]
    near = a.join(b, ["s_nationkey", "gx", "gy"]).where(F.col("a_k") < F.col("b_k"))
    return near.where(~g.rectangles_separate(box("a_"), box("b_"))).select(F.col("a_k").alias("a_key"), F.col("b_k").alias("b_key"))


@R.query("SELECT p_partkey FROM part WHERE NOT (p_size >= 10 AND p_size < 30 AND p_retailprice < 1000 + (p_size - 10) * 20 AND p_retailprice >= 950)")
def jn15_outside_polygon(spark: SparkSession, d: str) -> DataFrame:
    """Points outside a placed polygon, by ray casting."""
    poly = [(950.0, 10.0), (1000.0, 10.0), (1400.0, 30.0), (950.0, 30.0)]
    return table(spark, d, "part").where(~g.in_polygon(F.col("p_retailprice"), F.col("p_size"), poly)).select("p_partkey")


@R.query(
    """WITH b AS (SELECT p_partkey AS k, p_type AS t, p_size * 10.0 AS x, p_partkey % 13 * 10.0 AS y FROM part),
    p AS (SELECT a.k AS new_key, b.k AS old_key, greatest(20 - abs(a.x - b.x), 0) * greatest(30 - abs(a.y - b.y), 0) AS i FROM b a JOIN b b ON a.t = b.t AND a.k % 5 = 0 AND b.k % 5 <> 0)
    SELECT new_key, min(old_key) AS matched FROM p WHERE i / (1200 - i) >= 0.3 GROUP BY 1"""
)
def jn17_detections(spark: SparkSession, d: str) -> DataFrame:
    """New boxes matched to the first known box of their category by overlap. Boxes at one place are one row, the known ones with their first key; cells as large as a box bound the pairs of places."""
    x = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("t"), (F.col("p_size") * 10.0).alias("x"), (F.col("p_partkey") % 13 * 10.0).alias("y"))
    cx, cy = F.floor(F.col("x") / 20), F.floor(F.col("y") / 30)
    around = lambda c: F.explode(F.array(c - 1, c, c + 1))
    new = x.where("k % 5 = 0")
    places = new.select("t", F.col("x").alias("nx"), F.col("y").alias("ny"), cx.alias("cx"), cy.alias("cy")).distinct()
    places = places.select("t", "nx", "ny", around(F.col("cx")).alias("cx"), "cy").select("t", "nx", "ny", "cx", around(F.col("cy")).alias("cy"))
    old = x.where("k % 5 <> 0").groupBy("t", F.col("x").alias("ox"), F.col("y").alias("oy"), cx.alias("cx"), cy.alias("cy")).agg(F.min("k").alias("old_key"))
    iou = g.rect_iou((F.col("nx"), F.col("ny"), F.col("nx") + 20, F.col("ny") + 30), (F.col("ox"), F.col("oy"), F.col("ox") + 20, F.col("oy") + 30))
    first = places.join(old, ["t", "cx", "cy"]).where(iou >= 0.3).groupBy("t", F.col("nx").alias("x"), F.col("ny").alias("y")).agg(F.min("old_key").alias("matched"))
    return new.join(first, ["t", "x", "y"]).groupBy(F.col("k").alias("new_key")).agg(F.min("matched").alias("matched"))


@R.query("SELECT file_id, CASE WHEN contains(lower(file_path), 'depth') THEN 2 ELSE 1 END AS global_id FROM camera_files")
def jn18_global_labels(spark: SparkSession, d: str) -> DataFrame:
    """Camera labels to global ones, joined on the class word."""
    x = table(spark, d, "camera_files").select("file_id", F.when(F.contains(F.lower("file_path"), F.lit("depth")), "depth").otherwise("color").alias("word"))
    dim = spark.createDataFrame([("color", 1), ("depth", 2)], "word string, global_id int")
    return x.join(dim, "word").select("file_id", "global_id")


@R.query(
    """WITH e AS (SELECT episode_id, ts_seconds, joint_name, arg_min_null(joint_position, reading_id) AS p FROM joint_readings
      WHERE joint_name IN ('grip_l_joint', 'grip_r_joint', 'waist_lift_joint') AND ts_seconds IS NOT NULL AND episode_id IS NOT NULL GROUP BY 1, 2, 3)
    SELECT episode_id, ts_seconds, [max(p) FILTER (joint_name = 'grip_l_joint'), max(p) FILTER (joint_name = 'grip_r_joint'), max(p) FILTER (joint_name = 'waist_lift_joint')] AS ordered FROM e GROUP BY 1, 2"""
)
def jn19_reorder(spark: SparkSession, d: str) -> DataFrame:
    """Joint positions of each message second in a fixed order of names; absent ones are null and keep their place."""
    order = ["grip_l_joint", "grip_r_joint", "waist_lift_joint"]
    x = table(spark, d, "joint_readings").where(F.col("joint_name").isin(*order) & F.col("ts_seconds").isNotNull() & F.col("episode_id").isNotNull())
    each = x.groupBy("episode_id", "ts_seconds", "joint_name").agg(F.min_by("joint_position", "reading_id").alias("p"))
    m = each.groupBy("episode_id", "ts_seconds").agg(F.map_from_entries(F.collect_list(F.struct("joint_name", "p"))).alias("m"))
    return m.select("episode_id", "ts_seconds", F.array(*[F.try_element_at("m", F.lit(n)) for n in order]).alias("ordered"))


@R.query("WITH s AS (SELECT s_nationkey AS n, s_suppkey AS k, s_acctbal AS x FROM supplier) SELECT a.n AS s_nationkey, round(sum(a.x * b.x), 2) AS pair_sum FROM s a JOIN s b ON a.n = b.n GROUP BY 1")
def jn22_all_pairs_sum(spark: SparkSession, d: str) -> DataFrame:
    """A weighted sum over all ordered pairs of a group, without making the pairs: the square of the sum."""
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.round(F.pow(F.sum("s_acctbal"), 2), 2).alias("pair_sum"))


@R.query(
    """WITH r AS (SELECT n_nationkey, s_suppkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY md5(s_suppkey::VARCHAR || '-' || n_nationkey::VARCHAR), s_suppkey) AS k FROM nation JOIN supplier ON s_nationkey = n_nationkey)
    SELECT n_nationkey, s_suppkey FROM r WHERE k <= 1 + n_nationkey % 3"""
)
def jn26_group_assets(spark: SparkSession, d: str) -> DataFrame:
    """Each group draws its own number of objects without replacement."""
    x = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    h = F.md5(F.concat_ws("-", F.col("s_suppkey").cast("string"), F.col("n_nationkey").cast("string")).cast("binary"))
    k = F.row_number().over(Window.partitionBy("n_nationkey").orderBy(h, "s_suppkey"))
    return x.withColumn("k", k).where(F.col("k") <= 1 + F.col("n_nationkey") % 3).select("n_nationkey", "s_suppkey")


@R.query("SELECT event_id, event_type AS status, value AS score FROM events")
def pf03_whitelist(spark: SparkSession, d: str) -> DataFrame:
    """Only the fields of a whitelist leave a progress row."""
    keep = {"event_id": "event_id", "event_type": "status", "value": "score"}
    return table(spark, d, "events").select(*[F.col(a).alias(b) for a, b in keep.items()])


@R.query("SELECT p_partkey, round(CASE WHEN p_size <= 20 THEN p_size * 2 ELSE 40 + (p_size - 20) * -0.5 END + abs(p_retailprice - 1000) / 50, 6) AS score FROM part ORDER BY CASE WHEN p_size <= 20 THEN p_size * 2 ELSE 40 + (p_size - 20) * -0.5 END + abs(p_retailprice - 1000) / 50 DESC, p_partkey LIMIT 15")
def sr06_human_like(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen best by an elbow score in pieces and a hand score."""
    elbow = g.piecewise(F.col("p_size").cast("double"), [0, 20, 60], [2, -0.5])
    x = table(spark, d, "part").select("p_partkey", (elbow + F.abs(F.col("p_retailprice") - 1000) / 50).alias("s"))
    return x.orderBy(F.desc("s"), "p_partkey").limit(15).select("p_partkey", r6("s").alias("score"))


@R.query(
    BASE
    + """, c AS (SELECT event_id, cos(radians(v)) AS c, sin(radians(v)) AS s, ax, ay FROM q),
    l AS (SELECT event_id, list_sort(list_transform([[-0.5, -0.5], [0.5, -0.5], [0.5, 0.5], [-0.5, 0.5]], lambda o: {'y': round(4 * o[1] * s + 2 * o[2] * c + ay, 6) + 0.0, 'x': round(4 * o[1] * c - 2 * o[2] * s + ax, 6) + 0.0})) AS s FROM c)
    SELECT event_id, list_sort([[s[1].x, s[1].y], [s[2].x, s[2].y]]) || list_sort([[s[3].x, s[3].y], [s[4].x, s[4].y]]) AS corners FROM l"""
)
def sr14_corner_order(spark: SparkSession, d: str) -> DataFrame:
    """Corners of each event's rectangle: the two lower ones by x, then the two upper ones by x."""
    corners = F.array(*[F.struct(r6(y).alias("y"), r6(x).alias("x")) for x, y in g.rectangle_corners(F.col("ax"), F.col("ay"), 4, 2, F.col("v"))])
    s = F.array_sort(corners)
    by_x = lambda part: F.array_sort(F.transform(part, lambda c: F.array(c["x"], c["y"])))
    return base(spark, d).select("event_id", F.concat(by_x(F.slice(s, 1, 2)), by_x(F.slice(s, 3, 2))).alias("corners"))


@R.query()
def sr24_sr25_variants(spark: SparkSession, d: str) -> DataFrame:
    """Seeded variants of each user's path: ends and anchors perturbed and clamped, near-copies dropped, at most 8 n attempts for n of them."""

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        kept = path_variants(p.sort_values("event_id")[["ax", "ay"]].to_numpy(), int(p["event_id"].min()), 3)
        return pd.DataFrame({"variant": range(len(kept)), "length": [round(float(path_length(y)), 6) for y in kept]})

    return folds.per_group(base(spark, d).select("user_id", "event_id", "ax", "ay"), ["user_id"], fold, "user_id long, variant int, length double")


def path_length(x: np.ndarray) -> float:
    return np.linalg.norm(np.diff(x, axis=0), axis=1).sum()


def path_variants(x: np.ndarray, seed: int, n: int) -> list[np.ndarray]:
    """Up to n variants of the whole path x, every point of it perturbed."""
    rng, kept = np.random.default_rng(seed), []
    for _ in range(8 * n):
        y = np.clip(x + rng.normal(0, 0.5, x.shape), 0, 50)
        size = path_length(y)
        if all(abs(size - s) >= 0.05 * s or np.linalg.norm(y[len(y) // 2] - m) >= 0.5 for s, m in ((path_length(k), k[len(k) // 2]) for k in kept)):
            kept.append(y)
        if len(kept) == n:
            break
    return kept


@R.query()
def ma28_noise(spark: SparkSession, d: str) -> DataFrame:
    """Gaussian, uniform, exponential and salt-and-pepper noise, from a hash of the row, so that every run gives the same; the first matching pattern decides."""
    u = lambda s: (F.pmod(F.xxhash64("event_id", F.lit(s)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    gauss = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * np.pi * u(2))
    noise = F.when(F.col("event_type").rlike("^c"), gauss * 0.1).when(F.col("event_type").rlike("^(v|e)"), u(3) - 0.5).when(F.col("event_type").rlike("^p"), -F.log(u(4)) * 0.2)
    return table(spark, d, "events").select("event_id", r6(F.col("value") + F.coalesce(noise, F.when(u(5) < 0.05, 100.0).otherwise(0.0))).alias("noisy"))


@R.query(
    """WITH x AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS e FROM embeddings),
    m AS (SELECT a.vec_id, avg(a.e) AS ma, avg(b.e) AS mb, var_pop(a.e) AS va, var_pop(b.e) AS vb, covar_pop(a.e, b.e) AS cov FROM x a JOIN x b ON a.vec_id = b.vec_id + 1 AND a.i = b.i GROUP BY 1)
    SELECT vec_id, round((2 * ma * mb + 0.0001) * (2 * cov + 0.0009) / ((ma * ma + mb * mb + 0.0001) * (va + vb + 0.0009)), 6) + 0.0 AS ssim FROM m"""
)
def ma29_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Structural similarity of neighbouring embeddings, seen as small signals."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    pair = e.join(e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    n = F.size("embedding")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    one = lambda c: F.transform(c, lambda v: v.cast("double"))
    pair = pair.select("vec_id", one("embedding").alias("a"), one("other").alias("b"), n.alias("n"))
    pair = pair.select("*", (total(F.col("a")) / F.col("n")).alias("ma"), (total(F.col("b")) / F.col("n")).alias("mb"))
    dev = lambda x, mx, y, my: total(F.zip_with(x, y, lambda p, q: (p - mx) * (q - my))) / F.col("n")
    va, vb, cov = dev(F.col("a"), F.col("ma"), F.col("a"), F.col("ma")), dev(F.col("b"), F.col("mb"), F.col("b"), F.col("mb")), dev(F.col("a"), F.col("ma"), F.col("b"), F.col("mb"))
    c1, c2 = 0.01**2, 0.03**2
    s = (2 * F.col("ma") * F.col("mb") + c1) * (2 * cov + c2) / ((F.col("ma") ** 2 + F.col("mb") ** 2 + c1) * (va + vb + c2))
    return pair.select("vec_id", r6(s).alias("ssim"))


@R.query("SELECT episode_id, list_distinct(list_transform(range(0, least(8, n)), lambda i: i * greatest(n - 1, 0) // greatest(least(8, n) - 1, 1))).list_sort() AS frames FROM (SELECT DISTINCT episode_id, n_frames AS n FROM episodes WHERE n_frames > 0)")
def src20_frame_indexes(spark: SparkSession, d: str) -> DataFrame:
    """Evenly spread frame numbers, eight at most; decoding isn't done here."""
    n = F.col("n_frames").cast("long")
    k = F.least(F.lit(8).cast("long"), n)
    idx = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.floor(i * (n - 1) / F.greatest(k - 1, F.lit(1))))
    return table(spark, d, "episodes").where("n_frames > 0").select("episode_id", "n_frames").distinct().select("episode_id", F.array_sort(F.array_distinct(idx)).alias("frames"))


@R.query("SELECT vec_id, label FROM embeddings WHERE label = 3")
def src25_store_filter(spark: SparkSession, d: str) -> DataFrame:
    """A store read by a condition, pushed down to the scan."""
    return table(spark, d, "embeddings").where("label = 3").select("vec_id", "label")


@R.query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def snk04_keep_last(spark: SparkSession, d: str) -> DataFrame:
    return sinks.keep_last(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@R.query("SELECT 0 AS shard_no, s_nationkey, count(*) AS n FROM supplier GROUP BY ALL UNION ALL SELECT 1, c_nationkey, count(*) FROM customer GROUP BY ALL")
def snk06_07_merge_shards(spark: SparkSession, d: str) -> DataFrame:
    """SNK06, SNK07."""
    a = table(spark, d, "supplier").select("s_nationkey")
    b = table(spark, d, "customer").select(F.col("c_nationkey").alias("s_nationkey"))
    return sinks.merge_shards([a, b]).groupBy("shard_no", "s_nationkey").agg(F.count("*").alias("n"))


@R.query("SELECT episode_id, round((epoch_us(max(written_at)) - epoch_us(min(written_at))) / 1000000.0, 6) AS duration_s, sum(n_bytes)::BIGINT AS n_bytes, strftime(min(written_at) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS started FROM camera_files GROUP BY 1")
def snk09_meta_info(spark: SparkSession, d: str) -> DataFrame:
    return sinks.meta_info(table(spark, d, "camera_files"), "episode_id", "written_at", "n_bytes").withColumn("duration_s", F.round("duration_s", 6))


@R.query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'new' END AS c_name FROM customer WHERE c_custkey % 5 <> 0")
def snk13_sync_store(spark: SparkSession, d: str) -> DataFrame:
    """A store after its sync: changed names replaced, missing keys gone."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    new = c.where("c_custkey % 5 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("new"))
    return sinks.sync_store(c.where("c_custkey % 3 <> 0"), new, "c_custkey", "c_name")
