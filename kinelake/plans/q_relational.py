"""Joins, set operations, sorts, limits and samples: JN, SO, SR, PF19-40."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.operators.order_stats import first_rows
from kinelake.plans.registry import Registry, r6
from kinelake.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.query(
    """WITH o AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, c_nationkey + (c_custkey % 7 = 0)::INT AS v FROM customer WHERE c_custkey % 5 <> 0)
    SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NULL THEN 'delete' WHEN o.k IS NULL THEN 'add' WHEN o.v <> n.v THEN 'change' END AS action
    FROM o FULL JOIN n ON o.k = n.k WHERE n.k IS NULL OR o.k IS NULL OR o.v <> n.v"""
)
def jn07_store_diff(spark: SparkSession, d: str) -> DataFrame:
    """Delete missing, change differing, add new: one full outer join."""
    c = table(spark, d, "customer")
    o = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("ok"), F.col("c_nationkey").alias("ov"))
    n = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("nk"), (F.col("c_nationkey") + (F.col("c_custkey") % 7 == 0).cast("int")).alias("nv"))
    action = F.when(F.col("nk").isNull(), "delete").when(F.col("ok").isNull(), "add").when(F.col("ov") != F.col("nv"), "change")
    return o.join(n, F.col("ok") == F.col("nk"), "full_outer").select(F.coalesce("ok", "nk").alias("k"), action.alias("action")).where("action is not null")


@R.query("SELECT v.event_id, d.grp FROM events v JOIN (VALUES ('click', 'a'), ('view', 'b')) AS d(event_type, grp) USING (event_type) WHERE grp <> ''")
def jn08_hydrate(spark: SparkSession, d: str) -> DataFrame:
    dim = spark.createDataFrame([("click", "a"), ("view", "b"), ("error", None)], "event_type string, grp string").where("grp is not null")
    return table(spark, d, "events").join(dim, "event_type").select("event_id", "grp")


@R.query("SELECT count(*) AS n, sum(c_custkey)::BIGINT AS key_sum FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'F')")
def jn10_resume(spark: SparkSession, d: str) -> DataFrame:
    """What is left to do: anti join against the finished."""
    done = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return table(spark, d, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("key_sum"))


@R.query("SELECT c_custkey, n_name, round(c_acctbal + n_regionkey, 6) AS shifted FROM customer JOIN nation ON c_nationkey = n_nationkey")
def jn11_attach(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", r6(F.col("c_acctbal") + F.col("n_regionkey")).alias("shifted"))


@R.query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')")
def jn12_missing_objects(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    return table(spark, d, "lineitem").join(known, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("l_orderkey", "l_linenumber")


@R.query("SELECT a.s_suppkey, a.s_nationkey, count(b.s_suppkey) AS n_links FROM supplier a LEFT JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY 1, 2")
def jn13_links(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of one nation as one row an object: its group and how many others it is paired with. The pairs themselves aren't written out; pairs under a condition are formed by cells (jn14, jn25)."""
    s = table(spark, d, "supplier")
    n = s.groupBy("s_nationkey").agg((F.count("*") - 1).alias("n_links"))
    return s.join(n, "s_nationkey").select("s_suppkey", "s_nationkey", "n_links")


@R.query("SELECT a.s_suppkey AS a_key, b.s_suppkey AS b_key, round(abs(a.s_acctbal - b.s_acctbal), 6) AS distance FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) <= 50")
def jn25_radius(spark: SparkSession, d: str) -> DataFrame:
    """All pairs within a radius, by buckets as wide as the radius instead of a nested loop."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.floor(F.col("s_acctbal") / 50).alias("bucket"))
    a = s.select(F.col("s_suppkey").alias("a_key"), F.col("s_acctbal").alias("a_bal"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    b = s.select(F.col("s_suppkey").alias("b_key"), F.col("s_acctbal").alias("b_bal"), "bucket")
    gap = F.abs(F.col("a_bal") - F.col("b_bal"))
    return a.join(b, "bucket").where((F.col("a_key") < F.col("b_key")) & (gap <= 50)).select("a_key", "b_key", r6(gap).alias("distance"))


@R.query("SELECT a.p_partkey AS p_partkey, min(abs(a.p_retailprice - b.s_acctbal)) < 1.0 AS near FROM part a JOIN supplier b ON abs(a.p_retailprice - b.s_acctbal) < 1.0 GROUP BY 1")
def jn16_nearest_under(spark: SparkSession, d: str) -> DataFrame:
    """Points of A whose nearest point of B is closer than a threshold, by grid buckets."""
    a = table(spark, d, "part").select("p_partkey", "p_retailprice", F.floor("p_retailprice").alias("c"))
    a = a.select("p_partkey", "p_retailprice", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("cell"))
    b = table(spark, d, "supplier").select("s_acctbal", F.floor("s_acctbal").alias("cell"))
    gap = F.abs(F.col("p_retailprice") - F.col("s_acctbal"))
    return a.join(b, "cell").where(gap < 1.0).groupBy("p_partkey").agg((F.min(gap) < 1.0).alias("near"))


@R.query("SELECT event_id, coalesce(name, 'class_' || user_id) AS label FROM events LEFT JOIN (VALUES (1, 'chair'), (2, 'table')) AS d(user_id, name) USING (user_id)")
def jn21_default_label(spark: SparkSession, d: str) -> DataFrame:
    dim = spark.createDataFrame([(1, "chair"), (2, "table")], "user_id long, name string")
    return table(spark, d, "events").join(dim, "user_id", "left").select("event_id", F.coalesce("name", F.concat(F.lit("class_"), F.col("user_id").cast("string"))).alias("label"))


@R.query("SELECT n_regionkey, round(sum(c_acctbal), 4) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def jn23_images_cameras(spark: SparkSession, d: str) -> DataFrame:
    """Fact joined to two dimensions by id."""
    n, g = table(spark, d, "nation"), table(spark, d, "region")
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(g, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_regionkey").agg(F.round(F.sum("c_acctbal"), 4).alias("total"))


@R.query("SELECT p_type, arg_min(p_partkey, abs(p_retailprice - 950) * 1000000 + p_partkey) AS nearest_part FROM part GROUP BY 1")
def jn24_nearest_of_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_type").agg(F.min_by("p_partkey", F.abs(F.col("p_retailprice") - 950) * 1000000 + F.col("p_partkey")).alias("nearest_part"))


@R.query("SELECT 'orders' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def so01_concat(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select(F.lit("orders").alias("kind"), "o_orderkey")
    b = table(spark, d, "events").select(F.lit("events").alias("kind"), "event_id")
    return a.unionByName(b, allowMissingColumns=True).groupBy("kind").agg(F.count("*").alias("n"))


@R.query("SELECT DISTINCT p_brand, p_type FROM part")
def so02_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


@R.query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def so03_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").select("o_custkey"))


@R.query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events u WHERE u.event_type = 'click' AND u.user_id = e.user_id AND u.ts < e.ts)")
def so04_unused(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user up to the first click: anti join against the users' first use."""
    e = table(spark, d, "events")
    used = e.where("event_type = 'click'").groupBy(F.col("user_id").alias("u")).agg(F.min("ts").alias("first_use"))
    return e.join(used, (F.col("user_id") == F.col("u")) & (F.col("ts") > F.col("first_use")), "left_anti").select("event_id")


@R.query("SELECT (SELECT count(*) FROM (SELECT l_returnflag FROM lineitem EXCEPT ALL SELECT l_returnflag FROM lineitem)) = 0 AS equal_bags, (SELECT count(*) FROM (SELECT l_returnflag FROM lineitem EXCEPT ALL SELECT o_orderstatus FROM orders)) AS surplus")
def so05_ag40_bag_equality(spark: SparkSession, d: str) -> DataFrame:
    """SO05, AG40: whether lineitem's flags are the bag that its SQL holds them against, and how many more of them there are than order states."""
    flags, states = table(spark, d, "lineitem").select("l_returnflag"), table(spark, d, "orders").select("o_orderstatus")
    return compare_bags(flags, flags).select("equal_bags").crossJoin(compare_bags(flags, states).select("surplus"))


@R.query(
    """WITH x AS (SELECT l_returnflag FROM lineitem), y AS (SELECT o_orderstatus FROM orders)
    SELECT NOT EXISTS (SELECT * FROM x EXCEPT ALL SELECT * FROM y) AND NOT EXISTS (SELECT * FROM y EXCEPT ALL SELECT * FROM x) AS equal_bags, (SELECT count(*) FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y)) AS surplus"""
)
def so05_ag40_two_bags(spark: SparkSession, d: str) -> DataFrame:
    """SO05, AG40: whether the flags of lineitem and the states of orders are equal bags, and the flags' surplus."""
    return compare_bags(table(spark, d, "lineitem").select("l_returnflag"), table(spark, d, "orders").select("o_orderstatus"))


def compare_bags(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row for two columns: equal_bags, no value's counts differ, and surplus, the rows of the left bag that the right one lacks; nulls are a value."""
    x = left.toDF("v").groupBy("v").agg(F.count("*").alias("n"))
    y = right.toDF("w").groupBy("w").agg(F.count("*").alias("m"))
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    both = x.join(y, F.col("v").eqNullSafe(F.col("w")), "full")
    return both.agg(F.coalesce(F.bool_and(n == m), F.lit(True)).alias("equal_bags"), F.coalesce(F.sum(F.greatest(n - m, F.lit(0))), F.lit(0)).alias("surplus"))


@R.query("SELECT event_id, CASE WHEN event_type = 'click' THEN 9 WHEN event_type = 'view' THEN 2 ELSE 1 END AS merged FROM events")
def so06_map_merge(spark: SparkSession, d: str) -> DataFrame:
    """Later map wins: overrides are looked up first."""
    over = F.create_map(F.lit("click"), F.lit(9))
    base = F.create_map(F.lit("click"), F.lit(1), F.lit("view"), F.lit(2))
    merged = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, "click") | (k != "click")), over)
    return table(spark, d, "events").select("event_id", F.coalesce(F.element_at(merged, F.col("event_type")), F.lit(1)).alias("merged"))


@R.query("SELECT DISTINCT l_quantity AS gx, l_discount AS gy FROM lineitem WHERE l_returnflag = 'A' AND (l_quantity, l_discount) NOT IN (SELECT (l_quantity, l_discount) FROM lineitem WHERE l_returnflag = 'R' AND l_tax > 0.05)")
def so07_mask_and_not(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    cell = [F.col("l_quantity").alias("gx"), F.col("l_discount").alias("gy")]
    return x.where("l_returnflag = 'A'").select(*cell).distinct().join(x.where("l_returnflag = 'R' and l_tax > 0.05").select(*cell).distinct(), ["gx", "gy"], "left_anti")


@R.query("SELECT n_name, row_number() OVER (ORDER BY TRY_CAST(split_part(n_name, '_', 2) AS INT) NULLS LAST, n_name) AS rank_no FROM nation")
def sr01_numeric_sort(spark: SparkSession, d: str) -> DataFrame:
    """Rank by the number in the name; the dimension has a fixed 25 rows."""
    key = F.split("n_name", "_")[1].try_cast("int").asc_nulls_last()
    return table(spark, d, "nation").select("n_name", F.row_number().over(Window.orderBy(key, "n_name")).alias("rank_no"))


@R.query("SELECT event_type, count(*) AS n, list_position(['view', 'click', 'error'], event_type)::INT AS pos FROM events GROUP BY 1 HAVING pos IS NOT NULL")
def sr02_category_order(spark: SparkSession, d: str) -> DataFrame:
    order = F.array(*[F.lit(x) for x in ("view", "click", "error")])
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("pos", F.array_position(order, F.col("event_type")).cast("int")).where("pos > 0").orderBy("pos")


@R.query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, min(p_partkey) LIMIT 3")
def sr04_top3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("pos")).orderBy(F.desc("n"), "pos").limit(3).select("p_type", "n")


@R.query("SELECT p_partkey, round(2 * abs(p_size - 25) + abs(p_retailprice - 1000) / 100, 6) AS cost FROM part ORDER BY 2 * abs(p_size - 25) + abs(p_retailprice - 1000) / 100, p_partkey LIMIT 20")
def sr05_weighted_rank(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best by weighted joint distance."""
    cost = 2 * F.abs(F.col("p_size") - 25) + F.abs(F.col("p_retailprice") - 1000) / 100
    return table(spark, d, "part").select("p_partkey", cost.alias("c")).orderBy("c", "p_partkey").limit(20).select("p_partkey", r6("c").alias("cost"))


@R.query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT (SELECT CAST(ceil(count(*) * 0.1) AS BIGINT) FROM orders)")
def sr07_first_percent(spark: SparkSession, d: str) -> DataFrame:
    """first:10 %, rounded up; a sampling operator."""
    o = table(spark, d, "orders").select("o_orderkey")
    return first_rows(o, "o_orderkey", -(-o.count() * 10 // 100))


@R.query("SELECT s_nationkey, s_suppkey FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY md5(s_suppkey::VARCHAR || ':7'), s_suppkey) AS k FROM supplier) WHERE k <= 2")
def sr08_group_sample(spark: SparkSession, d: str) -> DataFrame:
    """Two of each group without replacement, by a seeded hash order."""
    w = Window.partitionBy("s_nationkey").orderBy(F.md5(F.concat(F.col("s_suppkey").cast("string"), F.lit(":7")).cast("binary")), "s_suppkey")
    return table(spark, d, "supplier").withColumn("k", F.row_number().over(w)).where("k <= 2").select("s_nationkey", "s_suppkey")


@R.query(
    """WITH r AS (SELECT p_partkey, p_size <= 25 AS seen, row_number() OVER (PARTITION BY p_size <= 25 ORDER BY md5(p_partkey::VARCHAR), p_partkey) AS k FROM part)
    SELECT p_partkey, seen FROM r WHERE k <= CASE WHEN seen THEN round(100 * 0.7) ELSE 100 - round(100 * 0.7) END"""
)
def sr09_ratio_sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred parts, seventy percent of them from the seen ones: two top-k, no global window."""
    x = table(spark, d, "part").select("p_partkey", (F.col("p_size") <= 25).alias("seen"), F.md5(F.col("p_partkey").cast("string").cast("binary")).alias("h"))
    take = lambda side, n: x.where(F.col("seen") == side).orderBy("h", "p_partkey").limit(n)
    return take(True, 70).unionByName(take(False, 30)).select("p_partkey", "seen")


@R.query("SELECT p_partkey FROM part ORDER BY md5(p_partkey::VARCHAR || '#'), p_partkey LIMIT 50")
def sr13_downsample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").orderBy(F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit("#")).cast("binary")), "p_partkey").limit(50).select("p_partkey")


@R.query("SELECT o_orderkey FROM orders WHERE o_orderkey % 8 = 3")
def sr16_worker_split(spark: SparkSession, d: str) -> DataFrame:
    """Every eighth row from the third on, for dense keys."""
    return table(spark, d, "orders").where("o_orderkey % 8 = 3").select("o_orderkey")


@R.query("SELECT chunk, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM (SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / (SELECT ceil(count(*) / 7) FROM orders)) AS INT) AS chunk FROM orders) GROUP BY 1")
def sr17_even_chunks(spark: SparkSession, d: str) -> DataFrame:
    """ceil(n/k)-sized chunks in key order. Row numbers come from range partitions and their sizes, not from one task."""
    o = table(spark, d, "orders").select("o_orderkey")
    ranked = row_numbers(o, "o_orderkey")
    size = -(-o.count() // 7)
    return ranked.groupBy(F.floor((F.col("rn") - 1) / size).cast("int").alias("chunk")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


def row_numbers(df: DataFrame, key: str, buckets: int = 1024) -> DataFrame:
    """Adds rn = 1..n in the order of a unique integer key, by equal-width key buckets and their running totals."""
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    if lo is None:
        return df.withColumn("rn", F.lit(None).cast("long"))
    width = max(1, -(-(hi - lo + 1) // buckets))
    df = df.withColumn("__b", F.floor((F.col(key) - lo) / width))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` rows
    offsets = df.groupBy("__b").agg(F.count("*").alias("__n")).select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inner = F.row_number().over(Window.partitionBy("__b").orderBy(key))
    return df.withColumn("__k", inner).join(offsets, "__b").withColumn("rn", F.col("__k") + F.col("__off")).drop("__b", "__k", "__off")


@R.query("SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN 'val' ELSE 'train' END AS split FROM orders")
def sr18_sr19_holdout(spark: SparkSession, d: str) -> DataFrame:
    """SR18, SR19: every eighth is held out."""
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 8 == 0, "val").otherwise("train").alias("split"))


@R.query(
    """WITH g AS (SELECT p_partkey, w, h, least(p_size * 10 * least(w / (p_size * 10), h / (p_size * 7)) * (p_size * 7 * least(w / (p_size * 10), h / (p_size * 7))), p_size * 70.0 * p_size) AS eff
      FROM part, (VALUES (224.0, 224.0), (336.0, 224.0), (448.0, 448.0)) AS r(w, h)),
    k AS (SELECT p_partkey, w, h, row_number() OVER (PARTITION BY p_partkey ORDER BY round(eff, 6) DESC, w * h - round(eff, 6), w, h) AS n FROM g)
    SELECT p_partkey, w AS best_w, h AS best_h FROM k WHERE n = 1"""
)
def sr20_best_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The candidate with the most effective and then the least wasted pixels."""
    w0, h0 = F.col("p_size") * 10.0, F.col("p_size") * 7.0
    cands = []
    for w, h in ((224.0, 224.0), (336.0, 224.0), (448.0, 448.0)):
        s = F.least(F.lit(w) / w0, F.lit(h) / h0)
        eff = F.round(F.least(w0 * s * (h0 * s), w0 * h0), 6)
        cands.append(F.struct((-eff).alias("e"), (F.lit(w * h) - eff).alias("waste"), F.lit(w).alias("w"), F.lit(h).alias("h")))
    best = F.least(*cands)
    return table(spark, d, "part").select("p_partkey", best["w"].alias("best_w"), best["h"].alias("best_h"))


@R.query("SELECT s_nationkey, arg_min(s_suppkey, s_acctbal * 1000 + s_suppkey) AS worker FROM supplier GROUP BY 1")
def sr21_least_loaded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.min_by("s_suppkey", F.col("s_acctbal") * 1000 + F.col("s_suppkey")).alias("worker"))


@R.query(
    """WITH t AS (SELECT user_id, event_type, sum(value) AS logit FROM events GROUP BY 1, 2),
    p AS (SELECT user_id, event_type, exp(logit / 500) / sum(exp(logit / 500)) OVER (PARTITION BY user_id) AS p FROM t),
    c AS (SELECT *, sum(p) OVER (PARTITION BY user_id ORDER BY p DESC, event_type ROWS UNBOUNDED PRECEDING) - p AS before, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, event_type) AS k FROM p)
    SELECT user_id, event_type, round(p, 6) AS p FROM c WHERE k <= 4 AND before < 0.8"""
)
def sr22_nucleus(spark: SparkSession, d: str) -> DataFrame:
    """Top-k and nucleus filter per distribution."""
    t = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("logit"))
    e = F.exp(F.col("logit") / 500)
    w = Window.partitionBy("user_id").orderBy(F.desc("p"), "event_type")
    p = t.withColumn("p", e / F.sum(e).over(Window.partitionBy("user_id")))
    c = p.withColumn("before", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("p")).withColumn("k", F.row_number().over(w))
    return c.where("k <= 4 and before < 0.8").select("user_id", "event_type", r6("p").alias("p"))


@R.query("SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 3")
def sr23_best_of_n(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").withColumn("k", F.row_number().over(w)).where("k <= 3").select("user_id", "event_id", "value")


@R.query("SELECT event_id FROM events WHERE value > 12.5 AND event_type = 'view'")
def pf19_value_checker(spark: SparkSession, d: str) -> DataFrame:
    rules = {"equalTo": lambda c, v: c == v, "greaterThan": lambda c, v: c > v, "lessThan": lambda c, v: c < v}
    return table(spark, d, "events").where(rules["greaterThan"](F.col("value"), 12.5) & rules["equalTo"](F.col("event_type"), "view")).select("event_id")


@R.query(
    """SELECT doc_id, unnest(list_filter([CASE WHEN text IS NULL THEN 'no text' END, CASE WHEN lang IS NULL THEN 'no language' END, CASE WHEN n_chars < 20 THEN 'too short' END, CASE WHEN episode_id IS NULL THEN 'no episode' END], lambda x: x IS NOT NULL)) AS message FROM documents"""
)
def pf23_validator(spark: SparkSession, d: str) -> DataFrame:
    checks = [(F.col("text").isNull(), "no text"), (F.col("lang").isNull(), "no language"), (F.col("n_chars") < 20, "too short"), (F.col("episode_id").isNull(), "no episode")]
    found = F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in checks]))
    return table(spark, d, "documents").select("doc_id", F.explode(found).alias("message"))


@R.query("SELECT doc_id FROM documents WHERE contains(lower(text), 'kitchen') OR contains(lower(text), 'lobby')")
def pf24_keywords(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower("text")
    return table(spark, d, "documents").where(F.contains(t, F.lit("kitchen")) | F.contains(t, F.lit("lobby"))).select("doc_id")


@R.query("SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(*) BETWEEN 4 AND 6")
def pf25_26_action_count(spark: SparkSession, d: str) -> DataFrame:
    """PF25, PF26."""
    x = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.groupBy("o_orderkey").agg(F.count("*").alias("n")).where(F.col("n").between(4, 6))


@R.query("SELECT event_id FROM events WHERE value < 60 AND ((event_type = 'error' AND value < 30) OR value < 5)")
def pf27_save_predicate(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").where((v < 60) & (((F.col("event_type") == "error") & (v < 30)) | (v < 5))).select("event_id")


@R.query(
    """WITH e AS (SELECT event_id, sum((event_type = 'error')::INT) OVER w AS n_err, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id FROM e WHERE n_err > 12 OR n_err / n > 0.8"""
)
def pf28_error_tolerance(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    x = table(spark, d, "events").select("event_id", F.sum((F.col("event_type") == "error").cast("int")).over(w).alias("n_err"), F.count("*").over(w).alias("n"))
    return x.where("n_err > 12 or n_err / n > 0.8").select("event_id")


@R.query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 - 0.1 * 20 AND 30 + 0.1 * 20")
def pf29_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bounds widened by ten percent of their span."""
    lo, hi = 10.0, 30.0
    return table(spark, d, "lineitem").where(F.col("l_quantity").between(lo - 0.1 * (hi - lo), hi + 0.1 * (hi - lo))).select("l_orderkey", "l_linenumber")


@R.query("WITH b AS (SELECT min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem WHERE l_returnflag = 'N') SELECT count(*) AS n FROM lineitem, b WHERE l_tax > lo AND l_tax < hi")
def pf30_workspace(spark: SparkSession, d: str) -> DataFrame:
    """Strictly within the foreground's bounds; the bounds are one row."""
    x = table(spark, d, "lineitem")
    lo, hi = x.where("l_returnflag = 'N'").agg(F.min("l_tax"), F.max("l_tax")).first()
    return x.where((F.col("l_tax") > F.lit(lo)) & (F.col("l_tax") < F.lit(hi))).agg(F.count("*").alias("n"))


@R.query("SELECT event_type, count(*) AS n FROM events e JOIN (SELECT event_type, avg(value) AS m FROM events GROUP BY 1) USING (event_type) WHERE value <= m GROUP BY 1")
def pf33_below_mean(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events")
    m = x.groupBy("event_type").agg(F.avg("value").alias("m"))
    return x.join(m, "event_type").where("value <= m").groupBy("event_type").agg(F.count("*").alias("n"))


@R.query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.02 AND l_discount < 0.09 AND l_tax > 0 AND l_tax < 0.08")
def pf34_depth_mask(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_discount > 0.02 and l_discount < 0.09 and l_tax > 0 and l_tax < 0.08").select("l_orderkey", "l_linenumber")


@R.query("SELECT p_partkey, CASE WHEN p_name LIKE 'red%' THEN 1 WHEN p_name LIKE 'small%' THEN 2 ELSE p_size END AS size FROM part WHERE p_name NOT LIKE '%widget%'")
def pf35_36_delete_update(spark: SparkSession, d: str) -> DataFrame:
    """PF35, PF36: DELETE and UPDATE as filter and projection."""
    n = F.col("p_name")
    return table(spark, d, "part").where(~n.like("%widget%")).select("p_partkey", F.when(n.like("red%"), 1).when(n.like("small%"), 2).otherwise(F.col("p_size")).alias("size"))


@R.query("SELECT event_id FROM (SELECT event_id, event_type = 'error' AS hit, coalesce(lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS carried FROM events) WHERE NOT hit AND NOT carried")
def pf37_carry_filter(spark: SparkSession, d: str) -> DataFrame:
    """Drops matching rows and the row behind each."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hit = F.col("event_type") == "error"
    return table(spark, d, "events").select("event_id", hit.alias("hit"), F.coalesce(F.lag(hit).over(w), F.lit(False)).alias("carried")).where("not hit and not carried").select("event_id")


@R.query(
    """SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM (VALUES (TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-05'), (TIMESTAMP '2024-01-10 12:00:00', TIMESTAMP '2024-01-11')) AS r(a, b) WHERE e.ts BETWEEN a AND b)"""
)
def pf39_playback(spark: SparkSession, d: str) -> DataFrame:
    """Instants inside any playback range are dropped; the few ranges are part of the expression."""
    ranges = [("2024-01-03 00:00:00", "2024-01-05 00:00:00"), ("2024-01-10 12:00:00", "2024-01-11 00:00:00")]
    inside = F.lit(False)
    for a, b in ranges:
        inside = inside | F.col("ts").between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"))
    return table(spark, d, "events").where(~inside).select("event_id")


@R.query("SELECT l_orderkey, count(*) FILTER (o_orderkey IS NULL) AS n_missing FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW') ON l_orderkey = o_orderkey GROUP BY 1 HAVING n_missing > 0")
def pf40_pf05_integrity(spark: SparkSession, d: str) -> DataFrame:
    """PF40, PF05: what refers to something that isn't there."""
    known = table(spark, d, "orders").where("o_orderpriority <> '5-LOW'")
    return table(spark, d, "lineitem").join(known, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n_missing"))
