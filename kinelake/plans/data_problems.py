"""Registered queries of the data problems P1 to P5 (the general ones)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.operators import compact, nested, regular, spikes, units
from kinelake.session import scratch_path, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that store a record again, found in the compacted files."""
    _, records = compact.compacted_files(spark, f"{d}/camera_files.parquet")
    return compact.repeated_records(records)


def p1_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The outputs of the compaction, without their paths."""
    manifest, _ = compact.compacted_files(spark, f"{d}/camera_files.parquet")
    return manifest.select("n_files", "n_blocks", "n_rows", "n_bytes", "kept")


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """Every record of the compacted files once; incomplete rows stay."""
    _, records = compact.compacted_files(spark, f"{d}/camera_files.parquet")
    return compact.distinct_records(records).select("file_id", "episode_id", "n_bytes")


def p1_many_files(spark: SparkSession, d: str) -> DataFrame:
    """The table cut into 400 small files, compacted again: totals of what the compacted files hold."""
    small, out = scratch_path(spark, "small"), scratch_path(spark, "compact")
    table(spark, d, "camera_files").repartition(400, "file_id").write.parquet(small)
    manifest = compact.compact_parquet(spark, small, out)
    rows = compact.read_compacted(spark, small, out, manifest)
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct("file_id").alias("n_ids"), F.sum("file_id").alias("ids"), F.sum(F.octet_length("payload")).alias("n_bytes"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Openings in whole millimetres of states recorded in another unit."""
    g = units.gripper_openings(table(spark, d, "hand_states"), table(spark, d, "grippers"))
    return g.where("opening_mm is not null and not in_millimetres").select("hand_id", "opening_mm")


def p2_openings(spark: SparkSession, d: str) -> DataFrame:
    """Every state with its unit's source and its opening."""
    g = units.gripper_openings(table(spark, d, "hand_states"), table(spark, d, "grippers"))
    return g.select("hand_id", "unit_from", F.round("opening", 6).alias("opening"), "opening_mm", "in_millimetres")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Empty cells of the regular series."""
    return regular.regular_series(table(spark, d, "joint_readings")).where("filled").select("episode_id", "joint_name", "cell_ms")


def p3_series(spark: SparkSession, d: str) -> DataFrame:
    """All cells, filled and marked."""
    return regular.regular_series(table(spark, d, "joint_readings"))


def p3_holdout(spark: SparkSession, d: str) -> DataFrame:
    """Errors of imputed positions at cells held back, beside those of linear interpolation."""
    return regular.holdout_errors(table(spark, d, "joint_readings"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Distinct parent links of the scene records."""
    return nested.scene_links(table(spark, d, "scene_records"))


def p4_objects(spark: SparkSession, d: str) -> DataFrame:
    """The supertype table of objects."""
    return nested.scene_tables(table(spark, d, "scene_records"))["objects"]


def p4_positions(spark: SparkSession, d: str) -> DataFrame:
    """The subtype tables of positions, united."""
    t = nested.scene_tables(table(spark, d, "scene_records"))
    out = None
    for v in (v for v in nested.SUBTYPES if v != "none"):
        part = t[f"objects_{v}"].select("scene_uid", "parent_id", "node_id", "x", "y", "z").withColumn("variant", F.lit(v))
        out = part if out is None else out.unionByName(part)
    return out


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Implausible values by field."""
    return spikes.implausible_readings(table(spark, d, "joint_readings"), table(spark, d, "joint_params")).select("reading_id", "field_name").distinct()


def p5_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Implausible values with their kind."""
    return spikes.implausible_readings(table(spark, d, "joint_readings"), table(spark, d, "joint_params"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_manifest, p1_records, p1_many_files, p2_found, p2_openings, p3_found, p3_series, p3_holdout, p4_found, p4_objects, p4_positions, p5_found, p5_kinds)
}

#: P1, P2 and P4 need path, unit and JSON grammars, P5 the tests of its model; those are held against brute force in tests.
SQL: dict[str, str] = {
    "p1_many_files": "SELECT count(*) AS n_rows, count(DISTINCT file_id) AS n_ids, sum(file_id)::BIGINT AS ids, sum(octet_length(payload))::BIGINT AS n_bytes FROM camera_files",
    "p3_found": """
        WITH c AS (
            SELECT DISTINCT episode_id, joint_name, (ts_seconds * 1000000000 + ts_nanos) // 100000000 AS cell
            FROM joint_readings
            WHERE ts_seconds IS NOT NULL AND ts_nanos IS NOT NULL AND joint_position IS NOT NULL AND NOT isnan(joint_position)
        ), s AS (SELECT episode_id, joint_name, cell, lead(cell) OVER (PARTITION BY episode_id, joint_name ORDER BY cell) AS nxt FROM c)
        SELECT episode_id, joint_name, e * 100 AS cell_ms FROM (SELECT episode_id, joint_name, unnest(range(cell + 1, nxt)) AS e FROM s WHERE nxt > cell + 1)
    """,
}
