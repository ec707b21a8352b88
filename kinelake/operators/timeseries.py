"""As-of joins, fills, runs, segments and sessions over ordered rows.

``as_of``, ``run_length``, ``segments`` and ``sessions`` cut a key's rows into
buckets and carry over what they need (see ``prefix``), so a key that holds a
large share of all rows is spread. The functions that give a Column are window
expressions partitioned by the key, for keys of bounded length. The order always
ends in a unique column, so results don't depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kinelake.operators import prefix

ALL_BEFORE = (Window.unboundedPreceding, Window.currentRow)
ALL_AFTER = (Window.currentRow, Window.unboundedFollowing)


def order(keys: Sequence[str], by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*by)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], direction: str = "backward") -> DataFrame:
    """left with the right side's ``values`` at the nearest instant not after (backward), not before (forward), or nearest.

    ``at`` is an orderable column of both sides. Equal instants match. In the
    nearest form ties go to the earlier instant, and ``at`` must be subtractable.
    The output adds the values and ``matched_at``.
    """
    picked = F.struct(F.col(at).alias("at"), *[F.col(v).alias(v) for v in values])
    kind = right.select(picked.alias("p")).schema["p"].dataType
    a = left.withColumn("__side", F.lit(1)).withColumn("__right", F.lit(None).cast(kind)).withColumn("__left", F.lit(True))
    b = right.select(*keys, at, picked.alias("__right")).withColumn("__left", F.lit(False))
    both = a.drop("__side").unionByName(b, allowMissingColumns=True)
    both = prefix.nearest_sides(both, "__right", "__left", keys, at)
    lo, hi = F.col("__lo"), F.col("__hi")
    if direction == "backward":
        hit = lo
    elif direction == "forward":
        hit = hi
    else:
        gap_lo, gap_hi = F.col(at) - F.col("__lo.at"), F.col("__hi.at") - F.col(at)
        hit = F.when(hi.isNull() | (gap_lo <= gap_hi), lo).otherwise(hi)
    out = both.where("__left").withColumn("__hit", hit)
    return out.select(*left.columns, *[F.col(f"__hit.{v}").alias(v) for v in values], F.col("__hit.at").alias("matched_at"))


def fill_next_then_last(value: str, keys: Sequence[str], by: Sequence[str]) -> Column:
    """A null takes the next value; trailing nulls take the last one."""
    w = order(keys, by)
    return F.coalesce(F.first(value, ignorenulls=True).over(w.rowsBetween(*ALL_AFTER)), F.last(value, ignorenulls=True).over(w.rowsBetween(*ALL_BEFORE)))


def backfill(value: str, keys: Sequence[str], by: Sequence[str]) -> Column:
    return F.first(value, ignorenulls=True).over(order(keys, by).rowsBetween(*ALL_AFTER))


def run_length(df: DataFrame, flag: Column, keys: Sequence[str], by: Sequence[str], name: str = "run") -> DataFrame:
    """Adds the number of consecutive true flags up to each row; 0 where the flag is false or null."""
    return prefix.run_lengths(df, flag, keys, by, name)


def cumulative_true(flag: Column, keys: Sequence[str], by: Sequence[str]) -> Column:
    """How often the flag has been true so far; never resets."""
    return F.sum(F.when(flag, 1).otherwise(0)).over(order(keys, by).rowsBetween(*ALL_BEFORE))


def segments(df: DataFrame, state: Sequence[str], keys: Sequence[str], by: Sequence[str], name: str = "segment") -> DataFrame:
    """Adds a segment number that grows where any of the state columns changes (nulls compare as equal)."""
    return prefix.numbered(df, state, lambda p, c: ~p.eqNullSafe(c), 1, keys, by, name)


def sessions(df: DataFrame, at: str, gap_seconds: float, keys: Sequence[str], tie: str, name: str = "session") -> DataFrame:
    """Adds a session number: a silence longer than the gap opens the next one."""
    micros = lambda c: F.unix_micros(c[at].cast("timestamp"))
    return prefix.numbered(df, [at], lambda p, c: micros(c) - micros(p) > int(gap_seconds * 1_000_000), 0, keys, [at, tie], name)


def common_range(df: DataFrame, topic: str, at: str) -> DataFrame:
    """One row: the span that all topics cover (latest first, earliest last)."""
    each = df.groupBy(topic).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    return each.agg(F.max("lo").alias("start_at"), F.min("hi").alias("end_at"))


def first_tick(df: DataFrame, satisfied: Column, keys: Sequence[str], tick: str) -> DataFrame:
    """(keys, first tick at which the condition holds); keys that never satisfy it are absent."""
    return df.where(satisfied).groupBy(*keys).agg(F.min(tick).alias("first_tick"))


def path_length(df: DataFrame, coordinates: Sequence[str], keys: Sequence[str], by: Sequence[str], name: str = "path_length") -> DataFrame:
    """(keys, sum of the distances between consecutive points)."""
    w = order(keys, by)
    step = None
    for c in coordinates:
        d = F.pow(F.col(c) - F.lag(c).over(w), 2)
        step = d if step is None else step + d
    return df.withColumn("__step", F.sqrt(step)).groupBy(*keys).agg(F.coalesce(F.sum("__step"), F.lit(0.0)).alias(name))


def ema(values: Column, alpha: float) -> Column:
    """Exponential smoothing of an array, started by its first value; returns the array of smoothed values."""
    return recurrence(values, 1 - alpha, alpha, 1.0)


def recurrence(values: Column, keep: float, take: float, first: float) -> Column:
    """s_1 = first * x_1, then s_i = keep * s_(i-1) + take * x_i, for each array; a null value gives nulls from there on. Linear in the array's length."""

    @F.pandas_udf("array<double>")
    def run(arrays: pd.Series) -> pd.Series:
        out = []
        for a in arrays:
            x = None if a is None else np.asarray(a, dtype=float)
            if x is not None and len(x):
                s, res = first * x[0], [first * x[0]]
                for v in x[1:].tolist():
                    s = keep * s + take * v
                    res.append(s)
                x = np.array(res)
            out.append(x)
        return pd.Series(out)

    return run(values)
