"""Streaming forms: first value wins, live statistics, inactivity sessions, gates, expiry, keep-last sinks.

Late rows are dropped ten minutes behind the newest event time. State is kept
per key only and leaves with the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

LATE = "10 minutes"


def file_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1, at: str = "ts") -> DataFrame:
    """New files of a folder, some a trigger, with event time as an instant."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return s.withColumn(at, F.col(at).cast("timestamp"))


def first_wins(stream: DataFrame, keys: list[str], at: str = "ts") -> DataFrame:
    """Duplicates of a key within the watermark are ignored."""
    return stream.withWatermark(at, LATE).dropDuplicatesWithinWatermark(keys)


def live_stats(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Running count, mean and variance of each key, for update or complete mode."""
    return stream.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))


def recordings(stream: DataFrame, key: str, gap: str, at: str = "ts") -> DataFrame:
    """A recording closes after a silence of ``gap``: session windows."""
    s = stream.withWatermark(at, LATE).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "n")


def windows(stream: DataFrame, key: str, width: str, at: str = "ts") -> DataFrame:
    """Counts of tumbling windows."""
    s = stream.withWatermark(at, LATE).groupBy(key, F.window(at, width).alias("w")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("start_at"), "n")


class Gate(StatefulProcessor):
    """Per key: rows before the control message are dropped, those behind it pass, until a stop.

    All rows of a micro-batch are put in event order together, however they are
    cut into chunks; batches count in the order in which they arrive.
    """

    def __init__(self, control: str, stop: str) -> None:
        self.control, self.stop = control, stop

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "is_open boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        is_open = bool(self.open.get()[0]) if self.open.exists() else False
        passed = []
        batch = pd.concat(list(rows), ignore_index=True)  # one key's rows of one batch, bounded by the files a trigger
        for r in batch.sort_values(["ts", "event_id"]).itertuples(index=False):
            if r.event_type == self.control:
                is_open = True
            elif r.event_type == self.stop:
                is_open = False
            elif is_open:
                passed.append((key[0], r.event_id))
        self.open.update((is_open,))
        yield pd.DataFrame(passed, columns=["user_id", "event_id"])

    def close(self) -> None:
        pass


def gated(stream: DataFrame, control: str, stop: str) -> DataFrame:
    """(user_id, event_id) of what passes the gate of its user."""
    return stream.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Gate(control, stop), outputStructType="user_id long, event_id long", outputMode="append", timeMode="none")


def run_once(stream: DataFrame, mode: str, checkpoint: str, out: str) -> DataFrame:
    """Runs a stream over everything that is there, into Parquet at ``out``, and reads that.

    In complete and update mode the last batch's table replaces the one before.
    Both folders must be shared by all executors; nothing passes the driver.
    """
    spark, provider = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # custom state needs it
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    try:
        if mode == "append":
            w.format("parquet").start(out).awaitTermination()
        else:
            w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    return spark.read.schema(stream.schema).parquet(out)


def _versions(spark: SparkSession, path: str) -> dict[int, str]:
    """The written versions of a kept table by number."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
    whole = [f for f in found if f.getName().startswith("v") and fs.exists(f.suffix("/_SUCCESS"))]
    return {int(f.getName()[1:]): f.toString() for f in whole}


def keep_last_sink(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str):
    """A table with the last row of each key over all batches so far.

    Each batch is merged with the version before it into a new version; a
    version counts once it is complete, so a batch that runs again after a
    failure replaces its own. Only the two newest versions are kept.
    """
    from kinelake.sources.sinks import keep_last

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = _versions(spark, path)
        older = [n for n in done if n < number]
        both = batch.unionByName(spark.read.schema(batch.schema).parquet(done[max(older)])) if older else batch
        keep_last(both, keys, order).write.mode("overwrite").parquet(f"{path}/v{number}")
        for n in sorted(older)[:-1]:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(done[n])
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_kept(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table that ``keep_last_sink`` writes. Raises ValueError if there is none."""
    done = _versions(spark, path)
    if not done:
        raise ValueError(f"nothing is kept at {path}")
    return spark.read.parquet(done[max(done)])


class Pace(StatefulProcessor):
    """Per key: a row passes if at least ``period`` seconds have gone by since the last one that passed."""

    def __init__(self, period: float) -> None:
        self.period = period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else float("-inf")
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"])
        passed = []
        for at, event_id in zip(batch["ts"], batch["event_id"]):
            t = at.timestamp()
            if t - last >= self.period:
                passed.append((key[0], event_id))
                last = t
        self.last.update((last,))
        yield pd.DataFrame(passed, columns=["user_id", "event_id"])

    def close(self) -> None:
        pass


def paced(stream: DataFrame, hz: float) -> DataFrame:
    """(user_id, event_id) of the rows that a rate limiter of ``hz`` rows a second and user lets through."""
    return stream.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Pace(1.0 / hz), outputStructType="user_id long, event_id long", outputMode="append", timeMode="none")


def state_log(stream: DataFrame, path: str, checkpoint: str):
    """Appends every frame's state as a row with the number of its batch; a batch that runs again replaces its own rows."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
