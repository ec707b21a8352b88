"""Time series: JN03-06, JN20, WN, DT, SM01 in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.operators import timeseries as ts
from kinelake.plans.registry import Registry, micros, r6
from kinelake.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql
W = "(PARTITION BY user_id ORDER BY ts, event_id)"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Errors as probes, purchases as status rows; instants in microseconds."""
    e = events(spark, d).withColumn("at", micros("ts"))
    return e.where("event_type = 'error'").select("user_id", "at", "event_id"), e.where("event_type = 'purchase'").select("user_id", "at", F.col("event_id").alias("purchase_id"), "value")


@R.query(
    """SELECT e.event_id, p.event_id AS purchase_id, p.value FROM (SELECT * FROM events WHERE event_type = 'error') e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts <= p.ts"""
)
def jn03_as_of_forward(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return ts.as_of(a, b, ["user_id"], "at", ["purchase_id", "value"], "forward").select("event_id", "purchase_id", "value")


@R.query(
    """SELECT e.event_id, p.event_id AS purchase_id, p.value FROM (SELECT * FROM events WHERE event_type = 'error') e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts"""
)
def jn05_as_of_backward(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return ts.as_of(a, b, ["user_id"], "at", ["purchase_id", "value"], "backward").select("event_id", "purchase_id", "value")


@R.query(
    """SELECT event_id, purchase_id FROM (
        SELECT e.event_id, p.event_id AS purchase_id, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(epoch_us(e.ts) - epoch_us(p.ts)), p.ts) AS k
        FROM events e JOIN events p ON e.user_id = p.user_id AND p.event_type = 'purchase' WHERE e.event_type = 'error') WHERE k = 1"""
)
def jn06_as_of_nearest(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return ts.as_of(a, b, ["user_id"], "at", ["purchase_id"], "nearest").where("purchase_id is not null").select("event_id", "purchase_id")


GRID_SQL = """WITH span AS (SELECT date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS b FROM events),
    grid AS (SELECT event_type, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour FROM span, (SELECT DISTINCT event_type FROM events)),
    v AS (SELECT event_type, date_trunc('hour', ts) AS hour, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2),
    g AS (SELECT event_type, hour, value FROM grid LEFT JOIN v USING (event_type, hour))"""


def hourly_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every topic at every hour of the common span; the first value of the hour, or null."""
    e = events(spark, d)
    v = e.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.min_by("value", "event_id").alias("value"))
    a, b = e.agg(F.date_trunc("hour", F.min("ts")), F.date_trunc("hour", F.max("ts"))).first()
    topics = v.select("event_type").distinct()
    hours = F.sequence(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"), F.expr("interval 1 hour"))
    return topics.select("event_type", F.explode(hours).alias("hour")).join(v, ["event_type", "hour"], "left")


@R.query(GRID_SQL + " SELECT event_type, hour, value FROM g")
def jn04_topic_grid(spark: SparkSession, d: str) -> DataFrame:
    return hourly_grid(spark, d)


@R.query(
    GRID_SQL
    + """ SELECT event_type, hour, coalesce(first_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS value FROM g"""
)
def wn01_fill(spark: SparkSession, d: str) -> DataFrame:
    return hourly_grid(spark, d).select("event_type", "hour", ts.fill_next_then_last("value", ["event_type"], ["hour"]).alias("value"))


@R.query(GRID_SQL + " SELECT event_type, hour, first_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM g")
def wn02_reverse_fill(spark: SparkSession, d: str) -> DataFrame:
    return hourly_grid(spark, d).select("event_type", "hour", ts.backfill("value", ["event_type"], ["hour"]).alias("value"))


@R.query(
    """WITH t AS (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1), r AS (SELECT max(lo) AS a, min(hi) AS b FROM t)
    SELECT event_type, count(*) AS n FROM events, r WHERE ts BETWEEN a AND b GROUP BY 1"""
)
def wn03_common_range(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    a, b = ts.common_range(e, "event_type", "ts").first()
    return e.where(F.col("ts").between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"))).groupBy("event_type").agg(F.count("*").alias("n"))


@R.query(f"SELECT event_id FROM (SELECT event_id, row_number() OVER {W} AS k FROM events) WHERE k % 10 = 1")
def wn04_every_tenth(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", F.row_number().over(ts.order(["user_id"], ["ts", "event_id"])).alias("k")).where("k % 10 = 1").select("event_id")


@R.query(f"SELECT user_id, CAST((k - 1) // 25 AS INT) AS chunk, count(*) AS n, min(event_id) AS first_id FROM (SELECT user_id, event_id, row_number() OVER {W} AS k FROM events) GROUP BY 1, 2")
def wn05_chunks(spark: SparkSession, d: str) -> DataFrame:
    x = events(spark, d).select("user_id", "event_id", F.row_number().over(ts.order(["user_id"], ["ts", "event_id"])).alias("k"))
    return x.groupBy("user_id", F.floor((F.col("k") - 1) / 25).cast("int").alias("chunk")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@R.query(
    f"""WITH f AS (SELECT user_id, ts, event_id, (value > 20)::INT AS f FROM events), g AS (SELECT *, sum(1 - f) OVER {W} AS grp FROM f)
    SELECT event_id, sum(f) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM g"""
)
def wn06_run_length(spark: SparkSession, d: str) -> DataFrame:
    return ts.run_length(events(spark, d), F.col("value") > 20, ["user_id"], ["ts", "event_id"]).select("event_id", "run")


@R.query(f"SELECT event_id, sum((value > 20)::INT) OVER {W}::BIGINT AS so_far FROM events")
def wn07_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", ts.cumulative_true(F.col("value") > 20, ["user_id"], ["ts", "event_id"]).alias("so_far"))


@R.query(f"SELECT event_id, round(value - lag(value, 5) OVER {W}, 6) + 0.0 AS change5 FROM events")
def wn09_lag5(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", r6(F.col("value") - F.lag("value", 5).over(ts.order(["user_id"], ["ts", "event_id"]))).alias("change5"))


@R.query(f"SELECT event_id, round(value - first_value(value) OVER {W}, 6) + 0.0 AS rise FROM events")
def wn10_baseline(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", r6(F.col("value") - F.first("value").over(ts.order(["user_id"], ["ts", "event_id"]))).alias("rise"))


SEGMENT_SQL = f"""WITH c AS (SELECT *, CASE WHEN row_number() OVER {W} = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER {W} THEN 1 ELSE 0 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER {W} AS segment FROM c)"""


@R.query(SEGMENT_SQL + " SELECT user_id, segment::BIGINT AS segment, any_value(event_type) AS event_type, min(ts) AS start_at, max(ts) AS end_at, count(*) AS n FROM s GROUP BY 1, 2")
def wn11_segments(spark: SparkSession, d: str) -> DataFrame:
    s = ts.segments(events(spark, d), ["event_type"], ["user_id"], ["ts", "event_id"])
    return s.groupBy("user_id", "segment").agg(F.first("event_type").alias("event_type"), F.min("ts").alias("start_at"), F.max("ts").alias("end_at"), F.count("*").alias("n"))


@R.query(
    SEGMENT_SQL
    + """, g AS (SELECT user_id, segment, CASE WHEN any_value(event_type) IN ('click', 'view') THEN 'look' ELSE any_value(event_type) END AS text, min(ts) AS a, max(ts) AS b FROM s GROUP BY 1, 2),
    h AS (SELECT *, CASE WHEN text IS DISTINCT FROM lag(text) OVER (PARTITION BY user_id ORDER BY segment) THEN 1 ELSE 0 END AS new FROM g),
    m AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY segment) AS part FROM h)
    SELECT user_id, part::BIGINT AS part, any_value(text) AS text, min(a) AS start_at, max(b) AS end_at FROM m GROUP BY 1, 2"""
)
def wn12_merge_adjacent(spark: SparkSession, d: str) -> DataFrame:
    s = ts.segments(events(spark, d), ["event_type"], ["user_id"], ["ts", "event_id"])
    text = F.when(F.col("event_type").isin("click", "view"), "look").otherwise(F.col("event_type"))
    g = s.withColumn("text", text).groupBy("user_id", "segment").agg(F.first("text").alias("text"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    m = ts.segments(g, ["text"], ["user_id"], ["segment"], "part")
    return m.groupBy("user_id", "part").agg(F.first("text").alias("text"), F.min("a").alias("start_at"), F.max("b").alias("end_at"))


@R.query(
    SEGMENT_SQL
    + """, g AS (SELECT user_id, segment, any_value(event_type) AS kind, min(ts) AS a, max(ts) AS b FROM s GROUP BY 1, 2)
    SELECT user_id, segment::BIGINT AS segment, kind, CASE kind WHEN 'error' THEN greatest(a - INTERVAL 60 SECOND, coalesce(lag(b) OVER (PARTITION BY user_id ORDER BY segment), a - INTERVAL 60 SECOND)) WHEN 'click' THEN b ELSE a END AS start_at FROM g"""
)
def wn13_interval_shaping(spark: SparkSession, d: str) -> DataFrame:
    """Per kind: errors reach back a minute but not into the previous segment, clicks start at their end."""
    s = ts.segments(events(spark, d), ["event_type"], ["user_id"], ["ts", "event_id"])
    g = s.groupBy("user_id", "segment").agg(F.first("event_type").alias("kind"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    early = F.col("a") - F.expr("interval 60 seconds")
    before = F.lag("b").over(Window.partitionBy("user_id").orderBy("segment"))
    start = F.when(F.col("kind") == "error", F.greatest(early, F.coalesce(before, early))).when(F.col("kind") == "click", F.col("b")).otherwise(F.col("a"))
    return g.select("user_id", "segment", "kind", start.alias("start_at"))


@R.query("SELECT o_orderkey, unnest(range(0, n, 3)) AS start_no FROM (SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)")
def wn14_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Windows of three over each sequence; none begins exactly at its end."""
    n = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("n"))
    return n.select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(3).cast("long"))).alias("start_no"))


@R.query("SELECT p_partkey, unnest(range(0, p_size, greatest(p_size // 8, 1))) AS frame FROM part")
def wn15_history_stride(spark: SparkSession, d: str) -> DataFrame:
    stride = F.greatest(F.floor(F.col("p_size") / 8), F.lit(1)).cast("int")
    return table(spark, d, "part").where("p_size > 0").select("p_partkey", F.explode(F.sequence(F.lit(0), F.col("p_size") - 1, stride).cast("array<bigint>")).alias("frame"))


@R.query("SELECT p_partkey, list_slice(range(0, p_size), 3, 6) AS future FROM part")
def wn16_index_slice(spark: SparkSession, d: str) -> DataFrame:
    """Four future steps from index 2 on."""
    seq = F.when(F.col("p_size") > 0, F.sequence(F.lit(0), F.col("p_size") - 1)).otherwise(F.array().cast("array<int>"))
    return table(spark, d, "part").select("p_partkey", F.slice(seq, 3, 4).cast("array<bigint>").alias("future"))


@R.query(f"SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER {W} AS p FROM events) WHERE event_type IS DISTINCT FROM p")
def wn17_adjacent_dedupe(spark: SparkSession, d: str) -> DataFrame:
    p = F.lag("event_type").over(ts.order(["user_id"], ["ts", "event_id"]))
    return events(spark, d).select("event_id", "event_type", p.alias("p")).where(~F.col("event_type").eqNullSafe(F.col("p"))).select("event_id")


@R.query(f"SELECT event_id, round(coalesce(sum(step) OVER {W}, 0), 4) AS arc FROM (SELECT *, abs(value - lag(value) OVER {W}) AS step FROM events)")
def wn18_arc_length(spark: SparkSession, d: str) -> DataFrame:
    w = ts.order(["user_id"], ["ts", "event_id"])
    x = events(spark, d).withColumn("step", F.abs(F.col("value") - F.lag("value").over(w)))
    return x.select("event_id", F.round(F.coalesce(F.sum("step").over(w.rowsBetween(*ts.ALL_BEFORE)), F.lit(0.0)), 4).alias("arc"))


@R.query(f"SELECT user_id, round(2.0 * sum(abs(dv)) + 0.5 * sum(abs(dk)), 4) AS cost FROM (SELECT user_id, value - lag(value) OVER {W} AS dv, event_id - lag(event_id) OVER {W} AS dk FROM events) GROUP BY 1")
def wn19_joint_cost(spark: SparkSession, d: str) -> DataFrame:
    w = ts.order(["user_id"], ["ts", "event_id"])
    x = events(spark, d).select("user_id", (F.col("value") - F.lag("value").over(w)).alias("dv"), (F.col("event_id") - F.lag("event_id").over(w)).alias("dk"))
    return x.groupBy("user_id").agg(F.round(2.0 * F.sum(F.abs("dv")) + 0.5 * F.sum(F.abs("dk")), 4).alias("cost"))


@R.query(
    """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, value AS x, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS n FROM events)
    SELECT a.user_id, a.day, a.n::INT AS step_no, round(sum(CASE WHEN b.n = 0 THEN pow(0.7, a.n) ELSE 0.3 * pow(0.7, a.n - b.n) END * b.x), 6) + 0.0 AS smoothed FROM e a JOIN e b ON a.user_id = b.user_id AND a.day = b.day AND b.n <= a.n GROUP BY ALL"""
)
def wn20_21_smoothing(spark: SparkSession, d: str) -> DataFrame:
    """WN20, WN21: (1 - a) s + a x over each user-day, started by its first value."""
    x = events(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    s = ts.ema(F.transform("e", lambda v: v["value"]), 0.3)
    return x.select("user_id", "day", F.posexplode(s).alias("step_no", "smoothed")).withColumn("smoothed", r6("smoothed"))


@R.query(
    """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, value - 30 AS d, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS n FROM events)
    SELECT a.user_id, a.day, a.n::INT AS step_no, round(sum(b.d * pow(0.9, b.n - a.n)), 6) + 0.0 AS advantage FROM e a JOIN e b ON a.user_id = b.user_id AND a.day = b.day AND b.n >= a.n GROUP BY ALL"""
)
def wn22_advantages(spark: SparkSession, d: str) -> DataFrame:
    """Reverse scan: A_t = delta_t + 0.9 A_{t+1}, with delta the value less 30, over each user-day."""
    x = events(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value")), asc=False).alias("e"))
    back = ts.recurrence(F.transform("e", lambda v: v["value"] - 30), 0.9, 1.0, 1.0)
    return x.select("user_id", "day", F.posexplode(F.reverse(back)).alias("step_no", "advantage")).withColumn("advantage", r6("advantage"))


@R.query(
    """SELECT event_id, round(-0.1 * value + CASE WHEN event_id = last_ok THEN 1 ELSE 0 END, 6) + 0.0 AS reward
    FROM (SELECT *, max(CASE WHEN event_type <> 'error' THEN event_id END) OVER (PARTITION BY user_id) AS last_ok FROM events)"""
)
def wn23_token_rewards(spark: SparkSession, d: str) -> DataFrame:
    """A penalty each token, the score on the last unmasked one."""
    last = F.max(F.when(F.col("event_type") != "error", F.col("event_id"))).over(Window.partitionBy("user_id"))
    x = events(spark, d).withColumn("last_ok", last)
    return x.select("event_id", r6(-0.1 * F.col("value") + F.when(F.col("event_id") == F.col("last_ok"), 1).otherwise(0)).alias("reward"))


@R.query("SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - m) / sqrt(v + 1e-8), 6) + 0.0 AS white FROM lineitem, (SELECT avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem)")
def wn24_whiten(spark: SparkSession, d: str) -> DataFrame:
    """Global moments as one row, instead of a window over everything."""
    x = table(spark, d, "lineitem")
    m, v = x.agg(F.avg("l_quantity"), F.var_samp("l_quantity")).first()
    return x.select("l_orderkey", "l_linenumber", "l_partkey", r6((F.col("l_quantity") - F.lit(m)) / F.sqrt(F.lit(v) + 1e-8)).alias("white"))


@R.query(
    """WITH g AS (SELECT avg(value) AS gm, stddev_pop(value) AS gs FROM events), k AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM events GROUP BY 1)
    SELECT event_id, round(CASE WHEN n < 60 THEN (value - gm) / (gs + 1e-8) ELSE (value - m) / (s + 1e-8) END, 6) + 0.0 AS z FROM events JOIN k USING (user_id), g"""
)
def wn25_key_zscore(spark: SparkSession, d: str) -> DataFrame:
    """z-score by key, by global statistics where a key has fewer than sixty values."""
    e = events(spark, d)
    gm, gs = e.agg(F.avg("value"), F.stddev_pop("value")).first()
    k = e.groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count("*").alias("n"))
    z = F.when(F.col("n") < 60, (F.col("value") - F.lit(gm)) / (F.lit(gs) + 1e-8)).otherwise((F.col("value") - F.col("m")) / (F.col("s") + 1e-8))
    return e.join(k, "user_id").select("event_id", r6(z).alias("z"))


@R.query(f"SELECT event_id, first_value(CASE WHEN event_type <> 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS source_id FROM events")
def wn27_backfill_image(spark: SparkSession, d: str) -> DataFrame:
    """From where a missing image is copied: the next row that has one."""
    w = ts.order(["user_id"], ["ts", "event_id"]).rowsBetween(1, Window.unboundedFollowing)
    return events(spark, d).select("event_id", F.first(F.when(F.col("event_type") != "error", F.col("event_id")), ignorenulls=True).over(w).alias("source_id"))


@R.query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, round((l_quantity - avg(l_quantity) OVER w) / (stddev_pop(l_quantity) OVER w + 1e-8), 6) + 0.0 AS z, round((l_quantity - min(l_quantity) OVER w) / (max(l_quantity) OVER w - min(l_quantity) OVER w + 1e-8), 6) AS scaled FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)")
def wn28_29_normalise(spark: SparkSession, d: str) -> DataFrame:
    """WN28, WN29: group statistics joined back, so a hot group isn't sorted in one task."""
    x = table(spark, d, "lineitem")
    q = "l_quantity"
    g = x.groupBy("l_suppkey").agg(F.avg(q).alias("m"), F.stddev_pop(q).alias("s"), F.min(q).alias("lo"), F.max(q).alias("hi"))
    return x.join(g, "l_suppkey").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", r6((F.col(q) - F.col("m")) / (F.col("s") + 1e-8)).alias("z"), r6((F.col(q) - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-8)).alias("scaled"))


@R.query("SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey, s_suppkey) - 1 AS global_no FROM supplier")
def wn30_global_index(spark: SparkSession, d: str) -> DataFrame:
    """0..N over (shard, index): row numbers within shards plus the shards' running totals."""
    s = table(spark, d, "supplier")
    sizes = s.groupBy("s_nationkey").agg(F.count("*").alias("n"))  # a row a shard
    before = sizes.select("s_nationkey", F.coalesce(F.sum("n").over(Window.orderBy("s_nationkey").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    inner = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    return s.withColumn("k", inner).join(before, "s_nationkey").select("s_suppkey", (F.col("k") + F.col("off")).alias("global_no"))


@R.query("SELECT p_partkey, CASE WHEN k = 1 THEN p_name ELSE p_name || '_' || (k - 1) END AS unique_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def wn31_suffix_duplicates(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    return table(spark, d, "part").withColumn("k", k).select("p_partkey", F.when(F.col("k") == 1, F.col("p_name")).otherwise(F.concat_ws("_", "p_name", (F.col("k") - 1).cast("string"))).alias("unique_name"))


@R.query(
    """WITH s AS (SELECT user_id, ts, event_id AS instruction FROM events WHERE event_type = 'signup')
    SELECT e.event_id, s.instruction FROM events e ASOF JOIN s ON e.user_id = s.user_id AND e.ts >= s.ts"""
)
def wn32_instruction_switch(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("at", micros("ts"))
    s = e.where("event_type = 'signup'").select("user_id", "at", F.col("event_id").alias("instruction"))
    return ts.as_of(e.select("user_id", "at", "event_id"), s, ["user_id"], "at", ["instruction"]).where("instruction is not null").select("event_id", "instruction")


@R.query(f"SELECT event_id, epoch_us(ts) * 1000 AS ns, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time, strftime(ts, '%Y%m%d_%H%M%S') AS suffix, round((epoch_us(ts) - epoch_us(lag(ts) OVER {W})) / 1000000.0, 6) AS duration FROM events")
def dt02_05_times(spark: SparkSession, d: str) -> DataFrame:
    """DT02-DT05: nanoseconds, zoned text, name suffix, duration."""
    w = ts.order(["user_id"], ["ts", "event_id"])
    at = F.col("ts").cast("timestamp")
    return events(spark, d).select(
        "event_id",
        (micros("ts") * 1000).alias("ns"),
        F.date_format(F.from_utc_timestamp(at, "Asia/Shanghai"), "yyyy-MM-dd HH:mm:ss").alias("local_time"),
        F.date_format(at, "yyyyMMdd_HHmmss").alias("suffix"),
        F.round((micros("ts") - micros(F.lag("ts").over(w))) / 1000000.0, 6).alias("duration"),
    )


@R.query(
    f"""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER {W}) > 1800000000 THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER {W} AS session FROM g)
    SELECT user_id, session::BIGINT AS session, min(ts) AS start_at, max(ts) AS end_at, count(*) AS n FROM s GROUP BY 1, 2"""
)
def sm01_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = ts.sessions(events(spark, d), "ts", 1800, ["user_id"], "event_id")
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("start_at"), F.max("ts").alias("end_at"), F.count("*").alias("n"))


@R.query(
    f"""WITH f AS (SELECT user_id, ts, event_id, (value > 20)::INT AS f FROM events), g AS (SELECT *, sum(1 - f) OVER {W} AS grp FROM f)
    SELECT user_id, min(ts) AS held_from FROM g WHERE f = 1 GROUP BY user_id, grp HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= 3600000000"""
)
def sm07_condition_held(spark: SparkSession, d: str) -> DataFrame:
    """Where a condition has held for an hour at least."""
    w = ts.order(["user_id"], ["ts", "event_id"]).rowsBetween(*ts.ALL_BEFORE)
    x = events(spark, d).withColumn("f", (F.col("value") > 20).cast("int")).withColumn("grp", F.sum(1 - F.col("f")).over(w)).where("f = 1")
    g = x.groupBy("user_id", "grp").agg(F.min("ts").alias("held_from"), F.max("ts").alias("held_to"))
    return g.where(micros("held_to") - micros("held_from") >= 3_600_000_000).select("user_id", "held_from")


@R.query("SELECT user_id, max(ts) AS last_heard FROM events GROUP BY 1 HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 12 HOUR")
def sm09_expired(spark: SparkSession, d: str) -> DataFrame:
    """Who hasn't been heard of for twelve hours."""
    e = events(spark, d)
    last = e.groupBy("user_id").agg(F.max("ts").alias("last_heard"))
    end = e.agg(F.max("ts")).first()[0]
    return last.where(F.col("last_heard") < F.lit(end).cast("timestamp_ntz") - F.expr("interval 12 hours"))


@R.query(
    """WITH s AS (SELECT user_id, ts, event_id, event_type || value::VARCHAR AS st FROM events WHERE event_type = 'signup')
    SELECT e.event_id, s.event_id AS first_after FROM (SELECT * FROM events WHERE event_type = 'view') e ASOF JOIN s ON e.user_id = s.user_id AND e.ts <= s.ts"""
)
def jn20_segment_frames(spark: SparkSession, d: str) -> DataFrame:
    """The first frame at or after each state change."""
    e = events(spark, d).withColumn("at", micros("ts"))
    s = e.where("event_type = 'signup'").select("user_id", "at", F.col("event_id").alias("first_after"))
    v = e.where("event_type = 'view'").select("user_id", "at", "event_id")
    return ts.as_of(v, s, ["user_id"], "at", ["first_after"], "forward").where("first_after is not null").select("event_id", "first_after")
