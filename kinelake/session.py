"""Session helpers: table loading and durable cuts of the lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a local master (everything runs on one
    machine) gets a local folder; on a cluster that raises RuntimeError, since
    executors don't share local folders.
    """
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir")
    if conf:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(conf)
        return conf
    have = sc._jsc.sc().getCheckpointDir()
    if not have.isEmpty():
        return have.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = "file://" + os.path.join(tempfile.gettempdir(), "kinelake-shared")
    sc.setCheckpointDir(local)
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and continue from a table in the shared folder.

    The files lie in the shared folder, so a lost executor costs a task's
    re-read, not a recomputation; they go when the session's Python ends.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the session's Python ends."""
    import atexit

    path = f"{shared_dir(spark).rstrip('/')}/kinelake/{name}-{uuid.uuid4().hex}"
    sc = spark.sparkContext

    def drop() -> None:
        try:
            hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the gateway may be gone already
            pass

    atexit.register(drop)
    return path
