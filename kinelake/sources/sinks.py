"""Writers: summaries, appended rows, keep-last documents, merged shards, synchronised stores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_summary(df: DataFrame, path: str) -> None:
    """A small result as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """Rows appended as JSONL, one object a line."""
    df.write.mode("append").json(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_files(df: DataFrame, folder: str, name: str, content: str) -> None:
    """One file a row: the bytes or text of ``content`` under the path ``name`` below the folder. Files appear by rename, so a task that runs again replaces equal ones."""

    def put(rows) -> None:
        import uuid

        from kinelake.operators.compact import _open

        fs, root = None, None
        for r in rows:
            if fs is None:
                fs, root = _open(folder)
            path = f"{root}/{r[0]}"
            parent = path.rpartition("/")[0]
            fs.create_dir(parent, recursive=True)
            data = r[1].encode() if isinstance(r[1], str) else bytes(r[1])
            hidden = f"{parent}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(hidden) as out:
                out.write(data)
            fs.move(hidden, path)

    df.select(name, content).where(df[name].isNotNull() & df[content].isNotNull()).foreachPartition(put)


def write_documents(df: DataFrame, folder: str, name: str, pretty: bool = True) -> None:
    """One JSON file a row, named by a column, which isn't part of it."""
    rest = [c for c in df.columns if c != name]
    doc = F.to_json(F.struct(*rest), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"})
    write_files(df.select(F.concat(F.col(name).cast("string"), F.lit(".json")).alias("__name"), doc.alias("__doc")), folder, "__name", "__doc")


def write_ply_files(points: DataFrame, folder: str, name: str) -> None:
    """One binary PLY file for each value of ``name``, of the columns x, y, z and, if there, red, green, blue. A cloud is one group, as one file is written by one task."""
    import pandas as pd

    from kinelake.sources.readers import write_ply

    columns = [c for c in ("x", "y", "z", "red", "green", "blue") if c in points.columns]

    def pack(key: tuple, cloud: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(f"{key[0]}.ply", write_ply(cloud[columns]))], columns=["__name", "__data"])

    files = points.select(name, *columns).groupBy(name).applyInPandas(pack, "__name string, __data binary")
    write_files(files, folder, "__name", "__data")


def write_leaves(df: DataFrame, folder: str, keys: Sequence[str], leaves: dict[str, str], attributes: dict[str, dict] | None = None) -> None:
    """Typed leaf tables: for each leaf (a path such as state/joint/position) a folder of Parquet with the keys and ``value``, the leaf's attributes in the column's metadata."""
    for leaf, column in leaves.items():
        value = F.col(column).alias("value", metadata=(attributes or {}).get(leaf, {}))
        df.select(*keys, value).where(F.col(column).isNotNull()).write.mode("overwrite").parquet(f"{folder}/{leaf}")


def frame_documents(readings: DataFrame, episode: str, at: Sequence[str], name: str, groups: dict[str, Sequence[str]], values: Sequence[str]) -> DataFrame:
    """Per-frame conversion: (episode, at, a struct for each group of joint names with an array for each value, in the order of the names; absent joints are null)."""
    one = readings.groupBy(episode, *at, name).agg(*[F.min(v).alias(v) for v in values])
    each = one.groupBy(episode, *at).agg(F.map_from_entries(F.collect_list(F.struct(name, F.struct(*values)))).alias("__m"))
    of = lambda names, v: F.array(*[F.try_element_at("__m", F.lit(n))[v] for n in names]).alias(v)
    return each.select(episode, *at, *[F.struct(*[of(names, v) for v in values]).alias(g) for g, names in groups.items()])


def extrinsics(frames: DataFrame, episode: str, order: str, camera_pose, robot_pose) -> DataFrame:
    """(episode, extrinsics): the camera's rotation and translation in the robot's frame, one entry a frame, in order. Poses are (rotation, translation) of columns."""
    from kinelake.functions import geom as g

    turn, at = g.pose_relative(robot_pose, camera_pose)
    entry = F.struct(F.array(*[F.array(*row) for row in turn]).alias("rotation_matrix"), F.array(*at).alias("translation_vector"))
    packed = frames.groupBy(episode).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("__o"), entry.alias("extrinsic")))).alias("e"))
    return packed.select(episode, F.transform("e", lambda x: F.struct(x["extrinsic"].alias("extrinsic"))).alias("extrinsics"))


def task_results(episodes: DataFrame, valid: str, code: str, status: str, fields: dict[str, str]) -> DataFrame:
    """The result document of each episode: the fields taken over under their new names, task_status, return_code, metric_status."""
    kept = [F.col(c).alias(n) for n, c in fields.items()]
    return episodes.select(*kept, F.col(valid).alias("task_status"), F.col(code).alias("return_code"), F.when(F.col(valid), "success").otherwise(F.col(status)).alias("metric_status"))


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of the rows with one key the last in order: an aggregation with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")
    return df.groupBy(*keys).agg(newest).select(*keys, "__last.*").select(*df.columns)


def merge_shards(shards: Sequence[DataFrame], shard: str = "shard_no") -> DataFrame:
    """Shards in numeric order with a shard column; empty ones vanish, missing columns are null."""
    out = None
    for i, df in enumerate(shards):
        part = df.withColumn(shard, F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no shards")
    return out


def sync_store(store: DataFrame, assets: DataFrame, key: str, digest: str) -> DataFrame:
    """The store after a sync: missing assets deleted, changed ones replaced, new ones added; equal ones are kept as they are."""
    s = store.select(F.col(key).alias("__k"), F.col(digest).alias("__d"), F.struct(*store.columns).alias("__s"))
    a = assets.select(F.col(key).alias("__ak"), F.col(digest).alias("__ad"), F.struct(*[assets[c] for c in store.columns]).alias("__a"))
    both = a.join(s, F.col("__ak") == F.col("__k"), "left")
    same = F.col("__ad").eqNullSafe(F.col("__d"))
    return both.select(F.when(same & F.col("__k").isNotNull(), F.col("__s")).otherwise(F.col("__a")).alias("r")).select("r.*")


def next_free_number(existing: DataFrame, name: str, prefix: str) -> int:
    """The number behind the largest of prefix_NN; 0 where there is none."""
    n = existing.select(F.regexp_extract(name, rf"^{prefix}_(\d+)", 1).try_cast("int").alias("n")).agg(F.max("n")).first()[0]
    return 0 if n is None else n + 1


def meta_info(files: DataFrame, episode: str, at: str, size: str, zone: str = "Asia/Shanghai") -> DataFrame:
    """(episode, duration seconds, bytes, zoned start) of each episode's files."""
    g = files.groupBy(episode).agg(F.min(at).alias("a"), F.max(at).alias("b"), F.sum(size).alias("n_bytes"))
    start = F.date_format(F.from_utc_timestamp(F.col("a").cast("timestamp"), zone), "yyyy-MM-dd HH:mm:ss")
    micro = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return g.select(episode, ((micro("b") - micro("a")) / 1_000_000).alias("duration_s"), "n_bytes", start.alias("started"))


def newest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last n rows of each key (a bounded buffer)."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")
