"""Matching records by nearest time.

Both sides get time buckets as wide as the tolerance; a record's partner can
only lie in its own or an adjacent bucket, so an equi-join on (entity, bucket)
sees every candidate. Candidates are filtered by difference and the minimum of
(difference, id) is kept, which makes ties deterministic.

Before the join each side is reduced to its distinct instants: a reading
delivered a million times is one candidate with its smallest id, and copies of
a probe ask once. What is joined per bucket is thus bounded by the instants
that fit into one tolerance, whatever one entity's share of the table is; the
result goes back to all probes by a join on the instant.

Defined cases: records without an entity key or an instant take no part; the
tolerance is inclusive on both sides; among equally near records the smallest
id wins; probes without a partner give no row; empty tables give no rows;
further columns, of whatever names, are not touched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.operators.blocks import instant_ns


def nearest_within(probes: DataFrame, records: DataFrame, entity: Sequence[str], probe_id: str, record_id: str, at: str, tolerance: int) -> DataFrame:
    """(probe_id, record_id) of the nearest record for each probe that has one within ``tolerance``.

    ``at`` is a long column of both sides, ``entity`` their common key columns.
    """
    keys = list(entity)
    known = F.col(at).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    bucket = F.expr(f"({at} - pmod({at}, {tolerance}L)) div {tolerance}L")
    right = records.where(known & F.col(record_id).isNotNull()).groupBy(*keys, at).agg(F.min(record_id).alias("r_id"))
    right = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col(at).alias("r_at"), "r_id", bucket.alias("r_bucket"))
    left = probes.where(known).select(*keys, at).distinct()
    left = left.withColumn("p_bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    on = F.col("p_bucket") == F.col("r_bucket")
    for k in keys:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    gap = F.abs(F.col(at) - F.col("r_at"))
    best = left.join(right, on).where(gap <= tolerance).groupBy(*keys, at).agg(F.min(F.struct(gap.alias("gap"), "r_id")).alias("best"))
    best = best.select(*keys, at, F.col("best.r_id").alias(record_id))
    return probes.where(known).select(probe_id, *keys, at).join(best, [*keys, at]).select(probe_id, record_id)


def nearest_readings(states: DataFrame, readings: DataFrame, tolerance_ns: int = 40_000_000) -> DataFrame:
    """(hand_id, reading_id): the nearest usable reading of the same robot and joint for each gripper state.

    A reading is usable if it has an instant and its position is neither null nor NaN.
    """
    key = ["robot_id", "joint_name"]
    usable = readings.where(F.col("joint_position").isNotNull() & ~F.isnan("joint_position")).select(*key, instant_ns().alias("at"), "reading_id")
    return nearest_within(states.select(*key, instant_ns().alias("at"), "hand_id"), usable, key, "hand_id", "reading_id", "at", tolerance_ns)
