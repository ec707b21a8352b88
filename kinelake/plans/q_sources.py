"""Sources and sinks by round trip: tables written in a format to the shared folder and read back. SRC01-SRC23, SNK01-SNK14."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions import geom as g
from kinelake.plans.q_geometry import BASE, base, point, quat
from kinelake.plans.registry import Registry, r6
from kinelake.session import scratch_path, table
from kinelake.sources import bags, readers, sinks
from kinelake.streaming import live

R = Registry()
QUERIES, SQL = R.queries, R.sql


def text_file(spark: SparkSession, folder: str, name: str, content: str | bytes) -> str:
    """A small file in the shared folder."""
    sinks.write_files(spark.createDataFrame([(name, content if isinstance(content, bytes) else content.encode())], "name string, data binary"), folder, "name", "data")
    return f"{folder}/{name}"


@R.query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src01_snk01_json_files(spark: SparkSession, d: str) -> DataFrame:
    """One pretty JSON file a row, read by a glob."""
    out = scratch_path(spark, "json")
    n = table(spark, d, "nation").select(F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("file"), "n_nationkey", "n_name", "n_regionkey")
    sinks.write_documents(n, out, "file")
    return readers.read_json_documents(spark, out, "n_nationkey int, n_name string, n_regionkey int", "nation_*.json").select("n_nationkey", "n_name", "n_regionkey")


@R.query("SELECT s_nationkey AS folder_no, count(*) AS n, sum(s_suppkey)::BIGINT AS keys FROM supplier GROUP BY 1")
def src02_src19_folders(spark: SparkSession, d: str) -> DataFrame:
    """Files in numbered folders, walked recursively; the folder's number is a column."""
    out = scratch_path(spark, "folders")
    s = table(spark, d, "supplier").select(F.concat_ws("/", F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")).alias("file"), "s_suppkey")
    sinks.write_documents(s, out, "file", pretty=False)
    walked = readers.read_json_documents(spark, out, "s_suppkey long").select("s_suppkey", "path")
    listed = readers.read_numbered_folders(spark, out).select("folder_no", "path")
    name = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    both = walked.select("s_suppkey", name.alias("name")).join(listed.select("folder_no", name.alias("name")), "name")
    return both.groupBy("folder_no").agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("keys"))


@R.query("SELECT p_type AS label, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1")
def src03_src04_dirty_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores among noise lines: the number stands anywhere before its label."""
    out = scratch_path(spark, "csv")
    k = F.col("p_partkey")
    line = F.concat(F.when(k % 3 == 0, "task,").when(k % 3 == 1, "").otherwise("a,b,"), F.col("p_retailprice").cast("string"), F.lit(", "), F.col("p_type"))
    noise = F.when(k % 2 == 0, "== finished ==").otherwise("INFO,started,now")
    table(spark, d, "part").select(F.explode(F.array(line, noise)).alias("value")).write.text(out)
    return readers.read_dirty_scores(spark, out).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("total"))


@R.query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view')")
def src05_src07_snk03_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSONL appended twice to each type's folder, read by a path with braces."""
    out, e = scratch_path(spark, "jsonl"), table(spark, d, "events").select("event_id", "event_type", "value")
    for kind in ("click", "view", "error"):
        for half in (0, 1):
            sinks.append_json_lines(e.where((F.col("event_type") == kind) & (F.col("event_id") % 2 == half)), f"{out}/{kind}")
    return readers.read_json_lines(spark, [f"{out}/{{click,view}}"], "event_id long, event_type string, value double")


@R.query(
    """(SELECT 'first' AS dataset, o_orderkey FROM orders ORDER BY o_orderkey LIMIT (SELECT CAST(ceil(count(*) * 0.1) AS BIGINT) FROM orders))
    UNION ALL (SELECT 'end', o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 25) UNION ALL SELECT 'all', o_orderkey FROM orders"""
)
def src06_dataset_list(spark: SparkSession, d: str) -> DataFrame:
    """A dataset list file: each entry with its own sampling strategy, united."""
    out = scratch_path(spark, "sets")
    for name in ("first", "end", "all"):
        table(spark, d, "orders").select("o_orderkey").write.json(f"{out}/{name}")
    listed = text_file(spark, f"{out}-list", "sets.json", json.dumps({"datasets": [{"json_path": f"{out}/{n}", "sampling_strategy": s} for n, s in (("first", "first:10%"), ("end", "end:25"), ("all", "all"))]}))
    entries = readers.dataset_entries(spark.read.text(listed, wholetext=True).first()[0])
    return readers.read_datasets(spark, entries, "o_orderkey long", "o_orderkey").select(F.element_at(F.split("dataset", "/"), -1).alias("dataset"), "o_orderkey")


@R.query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT s_suppkey FROM supplier ORDER BY printf('%09d', s_suppkey) LIMIT 7)")
def src08_file_samples(spark: SparkSession, d: str) -> DataFrame:
    """The first seven files of a folder of JSONL files, whole."""
    out = scratch_path(spark, "mmc4")
    line = F.to_json(F.struct("s_suppkey", "s_name"))
    s = table(spark, d, "supplier").select(F.concat(F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit(".jsonl")).alias("name"), line.alias("line"))
    sinks.write_files(s, out, "name", "line")
    return readers.read_json_lines(spark, readers.sample_files(spark, out, "first:7"), "s_suppkey long, s_name string")


def event_bags(spark: SparkSession, d: str) -> str:
    """The events as bags, a file for each kind of the user's number, a topic for each type."""
    out = scratch_path(spark, "bags")

    def pack(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("event_id")
        rows = [(f"/record/{t}", "std_msgs/msg/Int64", int(ns), struct.pack("<q", i)) for t, ns, i in zip(p["event_type"], p["ns"], p["event_id"])]
        return pd.DataFrame([(f"{key[0]}/run.mcap", bags.bag_bytes(rows, 200, "zstd" if key[0] % 2 else ""))], columns=["name", "data"])

    e = table(spark, d, "events").select((F.col("user_id") % 4).alias("grp"), "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ns"))
    sinks.write_files(e.groupBy("grp").applyInPandas(pack, "name string, data binary"), out, "name", "data")
    return out


@R.query("SELECT '/record/' || event_type AS topic, event_id, epoch_us(ts) * 1000 AS log_ns FROM events WHERE event_type IN ('click', 'error')")
def src09_bags(spark: SparkSession, d: str) -> DataFrame:
    """Messages of two topics out of bags, plain and compressed chunks."""
    m = bags.read_bags(spark, event_bags(spark, d), ["/record/click", "/record/error"])
    number = F.conv(F.hex(F.concat(*[F.substring("data", i, 1) for i in range(8, 0, -1)])), 16, 10)  # eight bytes, lowest first
    return m.select("topic", number.cast("long").alias("event_id"), "log_ns")


@R.query("SELECT file_id, '/record/camera' AS topic, 'jpeg' AS format, octet_length(payload) AS n_bytes FROM camera_files WHERE payload IS NOT NULL AND file_path LIKE '%head_color%' AND octet_length(payload) > 0")
def src10_bag_images(spark: SparkSession, d: str) -> DataFrame:
    """Compressed images out of a bag; messages of another type in it give no rows."""
    out = scratch_path(spark, "bags")

    def pack(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for i, data in zip(p["file_id"], p["payload"]):
            frame = str(i).encode() + b"\0"
            head = struct.pack("<4siII", b"\0\1\0\0", 0, 0, len(frame)) + frame
            head += b"\0" * (-(len(head) - 4) % 4) + struct.pack("<I", 5) + b"jpeg\0"
            head += b"\0" * (-(len(head) - 4) % 4) + struct.pack("<I", len(data))
            rows += [("/record/camera", "sensor_msgs/msg/CompressedImage", int(i), head + data), ("/record/noise", "std_msgs/msg/Int64", int(i), b"\0" * 8)]
        return pd.DataFrame([(f"{key[0]}.mcap", bags.bag_bytes(rows))], columns=["name", "data"])

    f = table(spark, d, "camera_files").where("payload is not null and file_path like '%head_color%' and octet_length(payload) > 0").select((F.col("file_id") % 8).alias("grp"), "file_id", "payload")
    sinks.write_files(f.groupBy("grp").applyInPandas(pack, "name string, data binary"), out, "name", "data")
    i = bags.read_bag_images(spark, out)
    return i.select(F.col("frame_id").cast("long").alias("file_id"), "topic", "format", F.octet_length("image").cast("long").alias("n_bytes"))


@R.query("SELECT DISTINCT episode_id, fps, c.key AS camera, c.value.intrinsic.fx AS fx FROM (SELECT episode_id, fps, unnest(map_entries(cameras)) AS c FROM episodes)")
def src12_state_files(spark: SparkSession, d: str) -> DataFrame:
    """Episode states with nested cameras, one file an episode, read with their schema."""
    out = scratch_path(spark, "state")
    e = table(spark, d, "episodes").select("episode_id", "fps", "cameras").withColumn("file", F.concat_ws("/", "episode_id", F.sha2(F.to_json(F.struct("fps", "cameras")), 256), F.lit("state")))
    sinks.write_documents(e.dropDuplicates(["file"]), out, "file")
    schema = "episode_id string, fps int, cameras map<string,struct<intrinsic:struct<fx:double,fy:double,ppx:double,ppy:double,width:double,height:double>>>"
    s = readers.read_json_documents(spark, out, schema, "state.json")
    return s.select("episode_id", "fps", F.explode("cameras").alias("camera", "v")).select("episode_id", "fps", "camera", F.col("v.intrinsic.fx").alias("fx")).distinct()


@R.query("SELECT p_brand, p_size::FLOAT::DOUBLE AS x, p_retailprice::FLOAT::DOUBLE AS y, p_partkey::FLOAT::DOUBLE AS z, (p_partkey % 256)::INT AS r FROM part")
def src13_snk11_clouds(spark: SparkSession, d: str) -> DataFrame:
    """Coloured clouds as PLY files, one a brand, read back."""
    out = scratch_path(spark, "ply")
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_brand", F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"), k.alias("z"), (k % 256).alias("red"), F.lit(0).alias("green"), F.lit(9).alias("blue"))
    sinks.write_ply_files(p, out, "p_brand")
    c = readers.read_ply(spark, out)
    return c.select(F.regexp_replace(F.url_decode(F.element_at(F.split("path", "/"), -1)), r"\.ply$", "").alias("p_brand"), "x", "y", "z", F.col("r").cast("int").alias("r"))


COLMAP = "SELECT s_suppkey::INT AS image_id, s_acctbal AS tx, (s_nationkey + 1)::INT AS camera_id, s_name || '.png' AS name FROM supplier"


@R.query(COLMAP)
def src14_colmap_text(spark: SparkSession, d: str) -> DataFrame:
    """images.txt: pose lines among comments and lines of points."""
    out = scratch_path(spark, "colmap")
    pose = F.concat_ws(" ", F.col("s_suppkey").cast("string"), F.lit("1 0 0 0"), F.col("s_acctbal").cast("string"), F.lit("0 0"), (F.col("s_nationkey") + 1).cast("string"), F.concat("s_name", F.lit(".png")))
    lines = F.array(F.lit("# IMAGE_ID, QW, QX"), pose, F.lit("1.5 2.5 -1 3.5 4.5 17"))
    table(spark, d, "supplier").select(F.explode(lines).alias("value")).write.text(out)
    return readers.read_colmap_images_text(spark, out).select("image_id", "tx", "camera_id", "name")


@R.query("SELECT s_suppkey::INT AS image_id, s_acctbal AS tx, s_name || '.png' AS name, CASE WHEN s_suppkey % 3 = 0 THEN []::BIGINT[] ELSE [s_suppkey, s_suppkey + 1] END AS point_ids FROM supplier")
def src14_colmap_binary(spark: SparkSession, d: str) -> DataFrame:
    """images.bin with the points that each image sees."""
    out = scratch_path(spark, "colmap")

    def pack(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        data = struct.pack("<Q", len(p))
        for k, bal, name in zip(p["s_suppkey"], p["s_acctbal"], p["s_name"]):
            seen = [] if k % 3 == 0 else [k, k + 1]
            data += struct.pack("<i7di", k, 1, 0, 0, 0, bal, 0, 0, 1) + name.encode() + b".png\0" + struct.pack("<Q", len(seen)) + b"".join(struct.pack("<ddq", 0.5, 1.5, int(i)) for i in seen)
        return pd.DataFrame([(f"{key[0]}/images.bin", data)], columns=["name", "data"])

    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal", "s_name")
    sinks.write_files(s.groupBy("s_nationkey").applyInPandas(pack, "name string, data binary"), out, "name", "data")
    return readers.read_colmap_images_binary(spark, f"{out}/*/images.bin").select("image_id", "tx", "name", "point_ids")


@R.query("SELECT s_suppkey AS point_id, s_acctbal AS x, (s_suppkey % 256)::INT AS r, [s_nationkey, s_nationkey + 1] AS image_ids FROM supplier")
def src14_colmap_points(spark: SparkSession, d: str) -> DataFrame:
    """points3D.bin with the tracks."""
    out = scratch_path(spark, "colmap")

    def pack(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        data = struct.pack("<Q", len(p)) + b"".join(struct.pack("<QdddBBBdQ4i", k, bal, 0, 0, k % 256, 2, 3, 0.1, 2, n, 0, n + 1, 1) for k, bal, n in zip(p["s_suppkey"], p["s_acctbal"], p["s_nationkey"]))
        return pd.DataFrame([(f"{key[0]}/points3D.bin", data)], columns=["name", "data"])

    s = table(spark, d, "supplier").select((F.col("s_suppkey") % 5).alias("grp"), "s_suppkey", "s_acctbal", "s_nationkey")
    sinks.write_files(s.groupBy("grp").applyInPandas(pack, "name string, data binary"), out, "name", "data")
    return readers.read_colmap_points_binary(spark, f"{out}/*/points3D.bin").select("point_id", "x", F.col("r").cast("int").alias("r"), "image_ids")


@R.query("SELECT s_name AS file_path, s_acctbal::DOUBLE AS m00, -(s_suppkey::DOUBLE) AS m01, -(s_nationkey::DOUBLE) AS m02, 4.0 AS m03 FROM supplier")
def src15_transforms(spark: SparkSession, d: str) -> DataFrame:
    """transforms.json, a file a nation; the y and z axes are flipped."""
    out = scratch_path(spark, "nerf")
    row = F.array(F.col("s_acctbal"), F.col("s_suppkey").cast("double"), F.col("s_nationkey").cast("double"), F.lit(4.0))
    frame = F.struct(F.col("s_name").alias("file_path"), F.array(row).alias("transform_matrix"))
    t = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.lit(0.7).alias("camera_angle_x"), F.collect_list(frame).alias("frames"))
    sinks.write_documents(t.withColumn("file", F.concat_ws("/", F.col("s_nationkey").cast("string"), F.lit("transforms"))).drop("s_nationkey"), out, "file")
    m = readers.read_transforms(spark, f"{out}/*/transforms.json")
    return m.select("file_path", *[F.col("matrix")[0][i].alias(f"m0{i}") for i in range(4)])


@R.query("SELECT n_nationkey AS image_id, n_name AS name, n_regionkey AS camera_id FROM nation WHERE n_name NOT LIKE '%A'")
def src16_sqlite(spark: SparkSession, d: str) -> DataFrame:
    """A table of SQLite files, one a region."""
    out = scratch_path(spark, "sqlite")

    def pack(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        import sqlite3

        base_ = sqlite3.connect(":memory:")
        base_.execute("CREATE TABLE images (name TEXT, image_id INTEGER PRIMARY KEY, camera_id INTEGER)")
        base_.executemany("INSERT INTO images VALUES (?, ?, ?)", [(n, int(k), int(r)) for n, k, r in zip(p["n_name"], p["n_nationkey"], p["n_regionkey"])])
        base_.commit()
        return pd.DataFrame([(f"{key[0]}.db", base_.serialize())], columns=["name", "data"])

    n = table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name").withColumn("grp", F.col("n_regionkey"))
    sinks.write_files(n.groupBy("grp").applyInPandas(pack, "name string, data binary"), out, "name", "data")
    return readers.read_sqlite(spark, out, "images", "image_id int, name string, camera_id int").where(~F.col("name").like("%A"))


@R.query("SELECT s_suppkey AS point_key, s_acctbal AS x, CASE WHEN s_suppkey % 2 = 0 THEN [0, 1] ELSE [1] END AS cameras FROM supplier")
def src17_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Points of a Bundler file with their view lists; a view of a camera that the file lacks is left out."""
    out = scratch_path(spark, "bundle")

    def pack(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        lines = ["# Bundle file v0.3", f"2 {len(p)}"] + ["500 0 0", "1 0 0", "0 1 0", "0 0 1", "1 2 3"] * 2
        for k, bal in zip(p["s_suppkey"], p["s_acctbal"]):
            views = [(0, 4), (1, 5)] if k % 2 == 0 else [(1, 5), (9, 6)]
            lines += [f"{bal!r} {k} 0", "1 2 3", f"{len(views)} " + " ".join(f"{c} {n} 0.5 0.25" for c, n in views)]
        return pd.DataFrame([(f"{key[0]}/bundle.out", "\n".join(lines).encode())], columns=["name", "data"])

    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    sinks.write_files(s.groupBy("s_nationkey").applyInPandas(pack, "name string, data binary"), out, "name", "data")
    v = readers.read_bundle_views(spark, f"{out}/*/bundle.out")
    return v.select(F.col("y").cast("long").alias("point_key"), "x", "cameras")


@R.query()
def src21_image_headers(spark: SparkSession, d: str) -> DataFrame:
    """Type and size of every stored image, from its header (no SQL twin: it reads bytes of several formats)."""
    f = readers.with_image_header(table(spark, d, "camera_files").select("file_id", "payload"), "payload")
    return f.select("file_id", "header.type", "header.width", "header.height")


@R.query("SELECT event_id, user_id FROM events")
def src23_landing(spark: SparkSession, d: str) -> DataFrame:
    """Topics landing as files, read as a stream until nothing is left."""
    out = scratch_path(spark, "landing")
    e = table(spark, d, "events")
    e.repartition(3).write.parquet(out)
    return live.run_once(live.file_stream(spark, out, e.schema, 1).select("event_id", "user_id"), "append", scratch_path(spark, "stream"), scratch_path(spark, "result"))


@R.query("SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1")
def src24_latest_command(spark: SparkSession, d: str) -> DataFrame:
    """A command stream of which only the latest pending one of each client counts."""
    out, mark, e = scratch_path(spark, "commands"), scratch_path(spark, "stream"), table(spark, d, "events")
    landing = scratch_path(spark, "landing")
    e.where("event_type = 'click'").repartition(3).write.parquet(landing)
    live.keep_last_sink(live.file_stream(spark, landing, e.schema, 1).select("user_id", "event_id"), out, ["user_id"], ["event_id"], mark).awaitTermination()
    return live.read_kept(spark, out)


@R.query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def snk01_summary(spark: SparkSession, d: str) -> DataFrame:
    out = scratch_path(spark, "summary")
    sinks.write_summary(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean")), out)
    return spark.read.schema("event_type string, n long, mean double").json(out)


@R.query("SELECT p_partkey, p_name, p_retailprice FROM part")
def snk02_csv_append(spark: SparkSession, d: str) -> DataFrame:
    """CSV appended in two goes, read back with its header."""
    out, p = scratch_path(spark, "csv"), table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    for half in (0, 1):
        sinks.append_csv(p.where(F.col("p_partkey") % 2 == half), out)
    return spark.read.schema("p_partkey long, p_name string, p_retailprice double").option("header", True).csv(out)


@R.query("SELECT 'state/joint/position' AS leaf, count(joint_position) AS n, 'double' AS kind FROM joint_readings UNION ALL SELECT 'state/joint/effort', count(joint_effort), 'double' FROM joint_readings UNION ALL SELECT 'index/sequence', count(seq_no), 'bigint' FROM joint_readings")
def snk05_typed_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Typed leaf tables, each with its own type and attributes."""
    out, r = scratch_path(spark, "leaves"), table(spark, d, "joint_readings")
    leaves = {"state/joint/position": "joint_position", "state/joint/effort": "joint_effort", "index/sequence": "seq_no"}
    sinks.write_leaves(r, out, ["episode_id", "joint_name"], leaves, {"state/joint/effort": {"unit": "N*m"}})
    parts = []
    for leaf in leaves:
        t = spark.read.parquet(f"{out}/{leaf}")
        parts.append(t.agg(F.lit(leaf).alias("leaf"), F.count("value").alias("n"), F.lit(dict(t.dtypes)["value"]).alias("kind")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.query(
    """WITH o AS (SELECT episode_id, ts_seconds, joint_name, min(joint_position) AS p, min(joint_velocity) AS v FROM joint_readings WHERE ts_seconds IS NOT NULL AND episode_id IS NOT NULL GROUP BY 1, 2, 3)
    SELECT episode_id, ts_seconds, [max(p) FILTER (joint_name = 'grip_l_joint'), max(p) FILTER (joint_name = 'grip_r_joint')] AS grip, max(v) FILTER (joint_name = 'waist_lift_joint') AS waist_velocity FROM o GROUP BY 1, 2"""
)
def snk08_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of joint groups in a fixed order of names, each with position and velocity; null where a joint is absent."""
    r = table(spark, d, "joint_readings").where("ts_seconds is not null and episode_id is not null")
    f = sinks.frame_documents(r, "episode_id", ["ts_seconds"], "joint_name", {"effector": ["grip_l_joint", "grip_r_joint"], "waist": ["waist_lift_joint"]}, ["joint_position", "joint_velocity"])
    return f.select("episode_id", "ts_seconds", F.col("effector.joint_position").alias("grip"), F.col("waist.joint_velocity")[0].alias("waist_velocity"))


@R.query(
    BASE
    + """SELECT user_id, count(*) AS n_frames, round(sum((1 - 2 * (py * py + pz * pz)) * (ax - cx) + 2 * (px * py + pw * pz) * (ay - cy) + 2 * (px * pz - pw * py) * (az - cz)), 4) AS sum_x FROM q GROUP BY 1"""
)
def snk10_extrinsics(spark: SparkSession, d: str) -> DataFrame:
    """The camera's pose in the robot's frame for every frame, as one document an episode; here its frames and the sum of x."""
    e = sinks.extrinsics(base(spark, d), "user_id", "event_id", (g.q_matrix(quat("q")), point("a")), (g.q_matrix(quat("p")), point("c")))
    x = F.aggregate("extrinsics", F.lit(0.0), lambda s, v: s + v["extrinsic"]["translation_vector"][0])
    return e.select("user_id", F.size("extrinsics").cast("long").alias("n_frames"), F.round(x, 4).alias("sum_x"))


@R.query("SELECT coalesce(max(n) + 1, 0)::INT AS next_no FROM (SELECT TRY_CAST(regexp_extract('run_' || printf('%02d', s_nationkey), '^run_(\\d+)', 1) AS INT) AS n FROM supplier)")
def snk12_next_name(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "supplier").select(F.concat(F.lit("run_"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")).alias("name"))
    return spark.createDataFrame([(sinks.next_free_number(names, "name", "run"),)], "next_no int")


@R.query("SELECT user_id AS episode_id, count(*) AS n_frames, avg(value) > 30.5 AS task_status, CASE WHEN avg(value) > 30.5 THEN 0 ELSE 7 END AS return_code, CASE WHEN avg(value) > 30.5 THEN 'success' ELSE 'low_average' END AS metric_status FROM events GROUP BY 1")
def snk14_task_results(spark: SparkSession, d: str) -> DataFrame:
    """A result document for each episode, written and read back."""
    out = scratch_path(spark, "results")
    e = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), (F.avg("value") > 30.5).alias("ok"))
    r = sinks.task_results(e.withColumns({"code": F.when(F.col("ok"), 0).otherwise(7), "why": F.lit("low_average")}), "ok", "code", "why", {"episode_id": "user_id", "n_frames": "n"})
    sinks.write_documents(r.withColumn("file", F.concat(F.lit("task_result_"), F.col("episode_id").cast("string"))), out, "file")
    return readers.read_json_documents(spark, out, "episode_id long, n_frames long, task_status boolean, return_code int, metric_status string", "task_result_*.json").drop("path", "_corrupt_record")
