"""Scores and aggregates: AG, PF01-03, JN01-02, SRC03, ST03, ST05."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.operators import scoring, timeseries
from kinelake.operators.order_stats import percentiles
from kinelake.plans.registry import Registry, micros, r6
from kinelake.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

LABELS = [("click", "manip", "spatial"), ("error", "manip", "memory"), ("view", "move", "spatial"), ("purchase", "move", ""), ("pour", "pour", "memory")]
LABEL_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in LABELS) + ") AS dim(event_type, manip, cognition)"


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELS, "event_type string, manip string, cognition string")


@R.query("SELECT round(avg(value), 6) AS e2e_avg, count(value) AS e2e_count, round(coalesce(sum(value), 0), 6) AS e2e_total FROM events WHERE event_type = 'purchase'")
def ag01_e2e(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").where("event_type = 'purchase'")
    return x.agg(r6(F.avg("value")).alias("e2e_avg"), F.count("value").alias("e2e_count"), r6(F.coalesce(F.sum("value"), F.lit(0.0))).alias("e2e_total"))


@R.query("SELECT event_type AS step, round(avg(value), 6) AS step_avg, count(value) AS step_count, round(sum(value), 4) AS step_total FROM events GROUP BY 1")
def ag02_steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("step")).agg(r6(F.avg("value")).alias("step_avg"), F.count("value").alias("step_count"), F.round(F.sum("value"), 4).alias("step_total"))


@R.query("SELECT event_type AS step, round(avg(value), 6) AS step_avg, count(value) AS step_count FROM events GROUP BY GROUPING SETS ((event_type), ())")
def ag02_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events")
    return x.groupingSets([["event_type"], []], "event_type").agg(r6(F.avg("value")).alias("step_avg"), F.count("value").alias("step_count")).withColumnRenamed("event_type", "step")


@R.query("SELECT round(avg(m), 6) AS mean_of_means, round(min(m), 6) AS least, round(max(m), 6) AS most FROM (SELECT avg(value) AS m FROM events GROUP BY user_id)")
def ag03_mean_of_means(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("m"))
    return m.agg(r6(F.avg("m")).alias("mean_of_means"), r6(F.min("m")).alias("least"), r6(F.max("m")).alias("most"))


@R.query(f"SELECT manip AS label, round(avg(value), 6) AS score FROM events JOIN {LABEL_SQL} USING (event_type) GROUP BY 1")
def ag04_label_avg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").join(labels(spark), "event_type").groupBy(F.col("manip").alias("label")).agg(r6(F.avg("value")).alias("score"))


@R.query(
    """WITH n AS (SELECT user_id, count(DISTINCT date_trunc('day', ts)) AS n FROM events GROUP BY 1)
    SELECT e.user_id, event_type, round(sum(value) / any_value(n), 6) AS mean_score FROM events e JOIN n USING (user_id) GROUP BY e.user_id, event_type"""
)
def ag05_dense_steps(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").withColumn("run", F.date_trunc("day", "ts"))
    return scoring.dense_step_means(x, "user_id", "run", "event_type", "value").withColumn("mean_score", r6("mean_score"))


@R.query(
    """WITH n AS (SELECT user_id, count(DISTINCT date_trunc('day', ts)) AS n FROM events GROUP BY 1),
    c AS (SELECT sum(value) / any_value(n) AS m FROM events e JOIN n USING (user_id) GROUP BY e.user_id, event_type)
    SELECT round(coalesce(avg(m), 0), 6) AS overall FROM c"""
)
def ag06_overall(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").withColumn("run", F.date_trunc("day", "ts"))
    return scoring.dense_step_means(x, "user_id", "run", "event_type", "value").agg(r6(F.coalesce(F.avg("mean_score"), F.lit(0.0))).alias("overall"))


WANTED = ["click", "view", "purchase"]


@R.query(
    """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type AS t, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events),
    a AS (SELECT *, min(n) FILTER (t = 'click') OVER w AS p FROM e WINDOW w AS (PARTITION BY user_id, day)), b AS (SELECT *, min(n) FILTER (t = 'view' AND n > p) OVER w AS p2 FROM a WINDOW w AS (PARTITION BY user_id, day))
    SELECT user_id, day, any_value(p) IS NOT NULL AS found_click, any_value(p2) IS NOT NULL AS found_view, coalesce(bool_or(t = 'purchase' AND n > p2), false) AS found_purchase FROM b GROUP BY 1, 2"""
)
def ag07_greedy_match(spark: SparkSession, d: str) -> DataFrame:
    """Which of the wanted steps each user's events hold in order (one array a user-day, so arrays stay small)."""
    x = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    found = scoring.greedy_match(F.array(*[F.lit(w) for w in WANTED]), F.transform("e", lambda s: s["event_type"]))
    return x.select("user_id", "day", *[F.element_at(found, i + 1).alias(f"found_{w}") for i, w in enumerate(WANTED)])


@R.query(
    """SELECT user_id, CAST(ts AS DATE) AS day, (arg_max(value, (ts, event_id)) > 20)::INT AS e2e, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS mean_score FROM events GROUP BY 1, 2"""
)
def ag08_summary(spark: SparkSession, d: str) -> DataFrame:
    """End-to-end and mean score of each user-day."""
    x = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    s = scoring.summary(F.transform("e", lambda v: F.when(v["value"] > 20, 1.0).otherwise(0.0)))
    return x.select("user_id", "day", s["e2e"].alias("e2e"), r6(s["mean"]).alias("mean_score"))


@R.query("SELECT user_id, round(sum(value), 4) AS total_cost, count(*) AS n FROM events GROUP BY 1")
def ag09_costs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total_cost"), F.count("*").alias("n"))


@R.query("SELECT round(avg((value > 30)::INT), 6) AS sr, round(avg(least(value / 100, 1)), 6) AS spl, count(*) AS n FROM events")
def ag10_nav_means(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events")
    return x.agg(r6(F.avg((F.col("value") > 30).cast("int"))).alias("sr"), r6(F.avg(F.least(F.col("value") / 100, F.lit(1.0)))).alias("spl"), F.count("*").alias("n"))


@R.query("SELECT user_id, round(coalesce(sum(abs(v)), 0), 4) AS path_length FROM (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events) GROUP BY 1")
def ag11_path_length(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.path_length(table(spark, d, "events"), ["value"], ["user_id"], ["ts", "event_id"]).withColumn("path_length", F.round("path_length", 4))


@R.query("SELECT user_id, min(value) AS oracle_error, max((value < 3.0)::INT) AS oracle_success, round(max(1 / (1 + value)), 6) AS oracle_spl, count(*) AS steps FROM events GROUP BY 1")
def ag12_16_oracles(spark: SparkSession, d: str) -> DataFrame:
    """AG12, AG13, AG14, AG16."""
    return table(spark, d, "events").groupBy("user_id").agg(F.min("value").alias("oracle_error"), F.max((F.col("value") < 3.0).cast("int")).alias("oracle_success"), r6(F.max(1 / (1 + F.col("value")))).alias("oracle_spl"), F.count("*").alias("steps"))


@R.query(
    """WITH p AS (SELECT user_id, ts, event_id, value, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS s FROM events)
    SELECT user_id, round(arg_min(value, event_id) / greatest(arg_min(value, event_id), coalesce(sum(s), 0)), 6) AS pl FROM p GROUP BY 1"""
)
def ag15_pl(spark: SparkSession, d: str) -> DataFrame:
    w = timeseries.order(["user_id"], ["ts", "event_id"])
    x = table(spark, d, "events").withColumn("s", F.abs(F.col("value") - F.lag("value").over(w)))
    start = F.min_by("value", "event_id")
    return x.groupBy("user_id").agg(r6(F.try_divide(start, F.greatest(start, F.coalesce(F.sum("s"), F.lit(0.0))))).alias("pl"))


@R.query(
    """SELECT user_id, arg_max(value, event_id) AS final_distance, min(value) AS min_distance, count(*) AS n_steps,
    (arg_max(event_type, event_id) = 'purchase' AND arg_max(value, event_id) <= 40)::INT AS success, (min(value) <= 40)::INT AS oracle_success FROM events GROUP BY 1"""
)
def ag17_episode_eval(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").withColumn("action", F.when(F.col("event_type") == "purchase", "stop").otherwise(F.col("event_type")))
    return scoring.navigation_eval(x, "user_id", "event_id", 40.0, "value", "action")


@R.query("SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean, count(DISTINCT l_suppkey) AS n_unique FROM lineitem")
def ag18_profile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), r6(F.avg("l_quantity")).alias("mean"), F.countDistinct("l_suppkey").alias("n_unique"))


@R.query("SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'error') AS n_error FROM events GROUP BY 1")
def ag19_action_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == a).alias(f"n_{a}") for a in ("click", "view", "error")])


@R.query("SELECT lang, round(avg((n_chars > 300)::INT), 6) AS accuracy, count(*) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY 1")
def ag20_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("n_chars is not null").groupBy("lang").agg(r6(F.avg((F.col("n_chars") > 300).cast("int"))).alias("accuracy"), F.count("*").alias("n"))


@R.query(
    """WITH per AS (SELECT source, avg((n_chars > 300)::INT) AS a FROM documents WHERE n_chars IS NOT NULL GROUP BY 1),
    cat AS (SELECT * FROM (VALUES ('nav_instruction', 'instruction'), ('task_instruction', 'instruction'), ('eval_report', 'report'), ('rule_trace', 'report'), ('absent', 'report')) AS c(source, category))
    SELECT category, round(avg(a), 6) AS macro_accuracy FROM per JOIN cat USING (source) GROUP BY 1"""
)
def ag22_macro_average(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "documents").where("n_chars is not null").groupBy("source").agg(F.avg((F.col("n_chars") > 300).cast("int")).alias("a"))
    cat = spark.createDataFrame([("nav_instruction", "instruction"), ("task_instruction", "instruction"), ("eval_report", "report"), ("rule_trace", "report"), ("absent", "report")], "source string, category string")
    return per.join(cat, "source").groupBy("category").agg(r6(F.avg("a")).alias("macro_accuracy"))


@R.query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted_mean FROM lineitem GROUP BY 1")
def ag23_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity"), 4).alias("weighted_mean"))


@R.query(
    """WITH x AS (SELECT l_linenumber % 4 AS pred, CAST(l_quantity AS INT) % 4 AS truth FROM lineitem WHERE l_linenumber <> 7)
    SELECT c AS class_id, count(*) FILTER (pred = c AND truth = c) AS n_both, count(*) FILTER (pred = c OR truth = c) AS n_either,
    round(count(*) FILTER (pred = c AND truth = c) / count(*) FILTER (pred = c OR truth = c), 6) AS iou FROM x, (VALUES (0), (1), (2), (3)) AS k(c) WHERE pred = c OR truth = c GROUP BY 1"""
)
def ag24_class_iou(spark: SparkSession, d: str) -> DataFrame:
    """Intersection over union per class; line 7 is the ignored label. Each row counts for its one or two classes."""
    x = table(spark, d, "lineitem").where("l_linenumber <> 7").select((F.col("l_linenumber") % 4).alias("pred"), (F.col("l_quantity").cast("int") % 4).alias("truth"))
    x = x.select("pred", "truth", F.explode(F.array_distinct(F.array("pred", "truth"))).alias("class_id"))
    both = F.count_if((F.col("pred") == F.col("class_id")) & (F.col("truth") == F.col("class_id")))
    return x.groupBy("class_id").agg(both.alias("n_both"), F.count("*").alias("n_either"), r6(both / F.count("*")).alias("iou"))


@R.query("SELECT l_returnflag, round(20 * log10(1 / sqrt(avg(l_discount * l_discount))), 6) AS psnr, round(avg(abs(l_discount)), 6) AS l1 FROM lineitem GROUP BY 1")
def ag25_image_metrics(spark: SparkSession, d: str) -> DataFrame:
    """PSNR and L1 of residuals."""
    e = F.col("l_discount")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(20 * F.log10(1 / F.sqrt(F.avg(e * e)))).alias("psnr"), r6(F.avg(F.abs(e))).alias("l1"))


@R.query(
    """WITH x AS (SELECT l_returnflag AS g, l_tax AS v, (l_linenumber < 4)::INT AS m FROM lineitem),
    a AS (SELECT g, sum(v * m) / sum(m) AS mean FROM x GROUP BY 1)
    SELECT g AS l_returnflag, round(any_value(mean), 6) AS masked_mean, round(sum((v - mean) * (v - mean) * m) / sum(m) * sum(m) / (sum(m) - 1), 6) AS masked_var FROM x JOIN a USING (g) GROUP BY 1"""
)
def ag26_masked_moments(spark: SparkSession, d: str) -> DataFrame:
    """Mean and Bessel-corrected variance of the masked values, in one pass."""
    v = F.when(F.col("l_linenumber") < 4, F.col("l_tax"))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(F.avg(v)).alias("masked_mean"), r6(F.var_samp(v)).alias("masked_var"))


@R.query("SELECT round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance, count(*) AS n FROM events")
def ag27_29_moments(spark: SparkSession, d: str) -> DataFrame:
    """AG27, AG29: partial and final moments."""
    return table(spark, d, "events").agg(r6(F.avg("value")).alias("mean"), F.round(F.var_pop("value"), 4).alias("variance"), F.count("*").alias("n"))


@R.query(
    """SELECT event_id, round(avg(value) OVER w, 6) AS recent_mean, count(*) OVER w AS recent_n FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""
)
def ag28_recent_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of each key's last ten values."""
    w = timeseries.order(["user_id"], ["ts", "event_id"]).rowsBetween(-9, 0)
    return table(spark, d, "events").select("event_id", r6(F.avg("value").over(w)).alias("recent_mean"), F.count("*").over(w).alias("recent_n"))


@R.query("SELECT l_returnflag, round((quantile_cont(l_extendedprice, 0.98) + quantile_cont(l_extendedprice, 0.02)) / 2, 4) AS centre FROM lineitem GROUP BY 1")
def ag30_trimmed_centre(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.02, 0.98]).select("l_returnflag", F.round((F.col("p")[0] + F.col("p")[1]) / 2, 4).alias("centre"))


@R.query(
    """WITH r AS (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
    SELECT l_returnflag, l_extendedprice AS ground_level FROM r WHERE k = CAST(floor(0.10 * n) AS BIGINT) + 1"""
)
def ag31_ground_level(spark: SparkSession, d: str) -> DataFrame:
    """The sorted value at index int(0.10 n): from counts of distinct values, so no task sorts a whole group."""
    x = table(spark, d, "lineitem").groupBy("l_returnflag", "l_extendedprice").agg(F.count("*").alias("c"))
    w = Window.partitionBy("l_returnflag").orderBy("l_extendedprice")
    upto = F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("c").over(Window.partitionBy("l_returnflag"))
    y = x.select("l_returnflag", "l_extendedprice", "c", upto.alias("upto"), (F.floor(n * 0.10) + 1).alias("k"))
    return y.where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("c") < F.col("k"))).select("l_returnflag", F.col("l_extendedprice").alias("ground_level"))


@R.query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.10) + 0.05 * (max(l_extendedprice) - min(l_extendedprice)), 4) AS ground FROM lineitem GROUP BY 1")
def ag32_ground_percentile(spark: SparkSession, d: str) -> DataFrame:
    x = percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.10, 0.0, 1.0])
    return x.select("l_returnflag", F.round(F.col("p")[0] + 0.05 * (F.col("p")[2] - F.col("p")[1]), 4).alias("ground"))


@R.query("SELECT l_linestatus, round(median(l_extendedprice), 4) AS median_ground, round(quantile_cont(l_extendedprice, 0.10), 4) AS fallback FROM lineitem GROUP BY 1")
def ag33_median_ground(spark: SparkSession, d: str) -> DataFrame:
    x = percentiles(table(spark, d, "lineitem"), ["l_linestatus"], "l_extendedprice", [0.5, 0.10])
    return x.select("l_linestatus", F.round(F.col("p")[0], 4).alias("median_ground"), F.round(F.col("p")[1], 4).alias("fallback"))


@R.query(
    """WITH m AS (SELECT l_returnflag, median(l_extendedprice) AS med, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 10)
    SELECT l_returnflag, round(any_value(med), 4) AS middle, round(avg(abs(l_extendedprice - med)), 4) AS spread FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1"""
)
def ag34_robust_scale(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    many = x.groupBy("l_returnflag").agg(F.count("*").alias("n")).where("n > 10").drop("n")
    m = percentiles(x, ["l_returnflag"], "l_extendedprice", [0.5]).join(many, "l_returnflag").select("l_returnflag", F.col("p")[0].alias("med"))
    return x.join(m, "l_returnflag").groupBy("l_returnflag").agg(F.round(F.first("med"), 4).alias("middle"), F.round(F.avg(F.abs(F.col("l_extendedprice") - F.col("med"))), 4).alias("spread"))


@R.query("SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS vx, CAST(floor(l_discount / 0.02) AS BIGINT) AS vy, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 5")
def ag35_voxels(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    return x.groupBy(F.floor(F.col("l_quantity") / 5).alias("vx"), F.floor(F.col("l_discount") / 0.02).alias("vy")).agg(F.count("*").alias("n")).where("n >= 5")


@R.query("SELECT CAST(trunc(l_quantity / 10) AS INT) AS gx, CAST(trunc(l_extendedprice / 10000) AS INT) AS gy, arg_max(l_returnflag, l_orderkey * 100 + l_linenumber) AS colour, max(l_tax) AS top FROM lineitem GROUP BY 1, 2")
def ag36_grid_projection(spark: SparkSession, d: str) -> DataFrame:
    """A cell is occupied by any point; its colour is that of the last point in (order, line) order."""
    x = table(spark, d, "lineitem")
    key = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    return x.groupBy((F.col("l_quantity") / 10).cast("int").alias("gx"), (F.col("l_extendedprice") / 10000).cast("int").alias("gy")).agg(F.max_by("l_returnflag", key).alias("colour"), F.max("l_tax").alias("top"))


@R.query("SELECT l_suppkey, min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_tax) AS y0, max(l_tax) AS y1, round(avg(l_quantity), 6) AS cx, round(avg(l_tax), 6) AS cy FROM lineitem GROUP BY 1")
def ag37_38_bounds(spark: SparkSession, d: str) -> DataFrame:
    """AG37, AG38: bounding box and centroid."""
    q, t = "l_quantity", "l_tax"
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min(q).alias("x0"), F.max(q).alias("x1"), F.min(t).alias("y0"), F.max(t).alias("y1"), r6(F.avg(q)).alias("cx"), r6(F.avg(t)).alias("cy"))


@R.query(
    """WITH c AS (SELECT avg(l_quantity) AS cx, avg(l_tax) AS cy FROM lineitem)
    SELECT round(avg(sqrt(l_quantity * l_quantity + l_tax * l_tax)), 6) AS frame_scale, round(1.1 * max(sqrt(pow(l_quantity - cx, 2) + pow(l_tax - cy, 2))), 6) AS radius FROM lineitem, c"""
)
def ag39_51_extent(spark: SparkSession, d: str) -> DataFrame:
    """AG39, AG51: mean distance to the origin; 1.1 times the largest distance from the centre (the centre is one row)."""
    x = table(spark, d, "lineitem").select("l_quantity", "l_tax")
    c = x.agg(F.avg("l_quantity").alias("cx"), F.avg("l_tax").alias("cy")).first()
    cx, cy = F.lit(c["cx"]), F.lit(c["cy"])
    return x.agg(r6(F.avg(F.sqrt(F.col("l_quantity") ** 2 + F.col("l_tax") ** 2))).alias("frame_scale"), r6(1.1 * F.max(F.sqrt((F.col("l_quantity") - cx) ** 2 + (F.col("l_tax") - cy) ** 2))).alias("radius"))


@R.query("SELECT source, sum(CAST(ceil(n_chars / 4) AS BIGINT)) AS token_estimate FROM documents WHERE n_chars IS NOT NULL GROUP BY 1")
def ag41_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("n_chars is not null").groupBy("source").agg(F.sum(F.ceil(F.col("n_chars") / 4)).alias("token_estimate"))


@R.query("SELECT episode_id, sum(n_bytes)::BIGINT AS folder_bytes, count(*) AS n_files FROM camera_files GROUP BY 1")
def ag42_folder_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "camera_files").groupBy("episode_id").agg(F.sum("n_bytes").alias("folder_bytes"), F.count("*").alias("n_files"))


@R.query("SELECT CASE WHEN payload IS NULL THEN 'missing' WHEN octet_length(payload) < n_bytes THEN 'cut' ELSE 'ok' END AS outcome, count(*) AS n FROM camera_files GROUP BY 1")
def ag43_outcomes(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("payload")
    return table(spark, d, "camera_files").groupBy(F.when(p.isNull(), "missing").when(F.octet_length(p) < F.col("n_bytes"), "cut").otherwise("ok").alias("outcome")).agg(F.count("*").alias("n"))


@R.query("SELECT event_type, date_trunc('minute', ts) AS minute, arg_min(event_id, event_id) AS first_id, arg_min(value, event_id) AS first_value FROM events GROUP BY 1, 2")
def ag44_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.date_trunc("minute", "ts").alias("minute")).agg(F.min("event_id").alias("first_id"), F.min_by("value", "event_id").alias("first_value"))


@R.query("SELECT DISTINCT printf('%d.%04d', (epoch_us(ts) + 50) // 100 // 10000, (epoch_us(ts) + 50) // 100 % 10000) AS stamp FROM events")
def ag45_dt01_distinct_stamps(spark: SparkSession, d: str) -> DataFrame:
    """AG45, DT01: distinct instants in seconds with four decimals."""
    return table(spark, d, "events").select((micros("ts").cast("decimal(22,0)") / 1000000).cast("decimal(18,4)").cast("string").alias("stamp")).distinct()


@R.query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT min(n) AS least, CAST(round(max(n) / greatest(min(n), 1)) * 3 AS BIGINT) AS replay_factor FROM c")
def ag46_min_count(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return c.agg(F.min("n").alias("least"), (F.round(F.max("n") / F.greatest(F.min("n"), F.lit(1))) * 3).cast("long").alias("replay_factor"))


@R.query("SELECT scene_id, count(DISTINCT episode_id) AS n_episodes, min(episode_id) AS first_episode FROM episodes GROUP BY 1")
def ag47_scene_groups(spark: SparkSession, d: str) -> DataFrame:
    """Episodes by scene, as a set per scene of which size and first element are shown."""
    g = table(spark, d, "episodes").groupBy("scene_id").agg(F.array_sort(F.collect_set("episode_id")).alias("e"))
    return g.select("scene_id", F.size("e").cast("long").alias("n_episodes"), F.try_element_at("e", F.lit(1)).alias("first_episode"))


@R.query("SELECT p_brand, min(p_partkey) AS first_part FROM part GROUP BY 1")
def ag48_unique_colour(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("first_part"))


@R.query(
    """WITH x AS (SELECT o_orderkey, array_agg(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey) AS a FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT round(avg((list_position(a, list_max(a)) = 1)::INT), 6) AS accuracy, count(*) AS n FROM x"""
)
def ag50_argmax_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Share of orders whose first line is the largest; an order's lines are few."""
    x = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey")
    a = x.agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))), lambda s: s["l_quantity"]).alias("a"))
    return a.agg(r6(F.avg((F.array_position("a", F.array_max("a")) == 1).cast("int"))).alias("accuracy"), F.count("*").alias("n"))


@R.query("SELECT l_returnflag, round(sum(CASE WHEN 0.05 - l_discount > 0 THEN 0.05 - l_discount ELSE 0 END), 6) AS cost FROM lineitem GROUP BY 1")
def ag55_collision_cost(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(F.sum(F.greatest(F.lit(0.05) - F.col("l_discount"), F.lit(0.0)))).alias("cost"))


@R.query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS confident FROM events WHERE contains(lower(event_type), 'e') GROUP BY 1")
def ag57_category_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.contains(F.lower("event_type"), F.lit("e"))).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("confident"))


@R.query(
    """WITH x AS (SELECT event_id, event_type AS class_name, CASE WHEN json_extract(props, '$.k') IS NOT NULL THEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) ELSE value END AS score FROM events)
    SELECT class_name, round(avg(score), 6) AS mean_score, count(*) AS n FROM x WHERE class_name NOT IN ('ActionList', 'ActionSetWaitAny', 'StepOut', 'error') AND score IS NOT NULL GROUP BY 1"""
)
def pf01_pf02_scores(spark: SparkSession, d: str) -> DataFrame:
    """PF01, PF02: a score field if there is one, else the progress; combinator classes left out."""
    k = F.get_json_object("props", "$.k")
    x = table(spark, d, "events").select(F.col("event_type").alias("class_name"), F.when(k.isNotNull(), k.try_cast("double")).otherwise(F.col("value")).alias("score"))
    return scoring.scored_progress(x).where("class_name <> 'error' and score is not null").groupBy("class_name").agg(r6(F.avg("score")).alias("mean_score"), F.count("*").alias("n"))


@R.query(f"SELECT manip, cognition, round(avg(value), 6) AS score FROM events JOIN {LABEL_SQL} USING (event_type) WHERE manip <> '' OR cognition <> '' GROUP BY 1, 2")
def jn01_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    dim = labels(spark).where("manip <> '' or cognition <> ''")
    return table(spark, d, "events").join(dim, "event_type").groupBy("manip", "cognition").agg(r6(F.avg("value")).alias("score"))


@R.query(f"SELECT dim.event_type AS label, round(coalesce(s, 0.0), 6) AS score FROM {LABEL_SQL} LEFT JOIN (SELECT event_type, avg(value) AS s FROM events GROUP BY 1) USING (event_type)")
def jn02_all_labels(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("s"))
    return labels(spark).join(s, "event_type", "left").select(F.col("event_type").alias("label"), r6(F.coalesce("s", F.lit(0.0))).alias("score"))


@R.query("SELECT CASE event_type WHEN 'click' THEN 'pick' WHEN 'view' THEN 'look' ELSE event_type END AS label, count(*) AS n FROM events GROUP BY 1")
def st03_case_map(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    return table(spark, d, "events").groupBy(F.when(e == "click", "pick").when(e == "view", "look").otherwise(e).alias("label")).agg(F.count("*").alias("n"))


@R.query("SELECT regexp_replace(n_name, '_\\d+$', '') AS base, count(*) AS n FROM nation GROUP BY 1")
def st05_strip_suffix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").groupBy(scoring.step_name(F.col("n_name")).alias("base")).agg(F.count("*").alias("n"))
