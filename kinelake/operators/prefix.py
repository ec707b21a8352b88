"""Running values of ordered rows without a task that sorts a whole key.

A key's rows are cut into buckets of the first order column (an hour of time, or
a share of an octave of a number). The window over all rows is partitioned by
key and bucket. What a bucket passes on to the next, its carry, is worked out on
a narrow table with one row a bucket, and joined back; the key is one struct
column, so that null keys are equal and that join needs no second shuffle of the
rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.operators.order_stats import order_bucket

SPAN_US = 3_600_000_000
KEY, BUCKET = "__k", "__b"
PARTS = [KEY, BUCKET]


def spread(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Adds the key struct and the bucket of the first order column: one bucket for columns that are neither times nor numbers, and one for nulls, in front."""
    kind = dict(df.dtypes)[at]
    if kind.startswith("timestamp") or kind == "date":
        b = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / SPAN_US)
    elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        b = order_bucket(F.col(at))
    else:
        b = F.lit(0)
    return df.withColumns({KEY: F.struct(*keys) if keys else F.struct(F.lit(0)), BUCKET: F.coalesce(b.cast("long"), F.lit(-(1 << 62)))})


def within(by: Sequence[str]):
    return Window.partitionBy(*PARTS).orderBy(*by)


def upto(by: Sequence[str]):
    return within(by).rowsBetween(Window.unboundedPreceding, 0)


def series():
    """Over the table of buckets: the buckets of a key in order."""
    return Window.partitionBy(KEY).orderBy(BUCKET)


def before():
    return series().rowsBetween(Window.unboundedPreceding, -1)


def behind():
    return series().rowsBetween(1, Window.unboundedFollowing)


def running_sum(df: DataFrame, value: Column, keys: Sequence[str], by: Sequence[str], name: str) -> DataFrame:
    """Adds the sum of the values up to each row, nulls as 0."""
    x = spread(df.withColumn("__v", F.coalesce(value, F.lit(0))), keys, by[0]).withColumn("__s", F.sum("__v").over(upto(by)))
    carry = x.groupBy(*PARTS).agg(F.sum("__v").alias("__t")).select(*PARTS, F.coalesce(F.sum("__t").over(before()), F.lit(0)).alias("__t"))
    return x.join(carry, PARTS).withColumn(name, F.col("__t") + F.col("__s")).select(*df.columns, name)


def run_lengths(df: DataFrame, flag: Column, keys: Sequence[str], by: Sequence[str], name: str) -> DataFrame:
    """Adds the number of consecutive true flags up to each row; 0 where the flag is false or null."""
    x = spread(df.withColumn("__flag", F.coalesce(flag, F.lit(False))), keys, by[0]).withColumn("__rn", F.row_number().over(within(by)))
    x = x.withColumn("__stop", F.max(F.when(~F.col("__flag"), F.col("__rn"))).over(upto(by)))
    x = x.withColumn("__in", F.col("__rn") - F.coalesce("__stop", F.lit(0)))
    ends = x.groupBy(*PARTS).agg(F.max_by("__in", "__rn").alias("tail"), F.max((~F.col("__flag")).cast("int")).alias("stops"))
    ends = ends.withColumn("grp", F.sum("stops").over(series()))
    ends = ends.withColumn("so_far", F.sum("tail").over(Window.partitionBy(KEY, "grp").orderBy(BUCKET)))
    carry = ends.select(*PARTS, F.coalesce(F.lag("so_far").over(series()), F.lit(0)).alias("__carry"))
    run = F.when(F.col("__stop").isNull(), F.col("__carry") + F.col("__rn")).otherwise(F.col("__in"))
    return x.join(carry, PARTS).withColumn(name, run.cast("long")).select(*df.columns, name)


def numbered(df: DataFrame, columns: Sequence[str], changed: Callable[[Column, Column], Column], first: int, keys: Sequence[str], by: Sequence[str], name: str) -> DataFrame:
    """Adds a number that grows by one where ``changed(previous, current)`` holds for the columns as structs; it starts at ``first``."""
    now = F.struct(*columns)
    x = spread(df, keys, by[0]).withColumns({"__rn": F.row_number().over(within(by)), "__last": F.lag(now).over(within(by))})
    step = lambda p, c: F.coalesce(changed(p, c), F.lit(False)).cast("int")
    x = x.withColumn("__new", F.when(F.col("__rn") > 1, step(F.col("__last"), now)).otherwise(0)).withColumn("__sum", F.sum("__new").over(upto(by)))
    ends = x.groupBy(*PARTS).agg(F.min_by(now, "__rn").alias("head"), F.max_by(now, "__rn").alias("tail"), F.sum("__new").alias("n"))
    ends = ends.withColumn("prev", F.lag("tail").over(series()))
    ends = ends.withColumn("start", F.when(F.col("prev").isNull(), F.lit(first)).otherwise(step(F.col("prev"), F.col("head"))))
    carry = ends.select(*PARTS, (F.coalesce(F.sum(F.col("n") + F.col("start")).over(before()), F.lit(0)) + F.col("start")).alias("__carry"))
    return x.join(carry, PARTS).withColumn(name, F.col("__carry") + F.col("__sum")).select(*df.columns, name)


def nearest_sides(both: DataFrame, value: str, is_left: str, keys: Sequence[str], at: str) -> DataFrame:
    """Adds ``__lo`` and ``__hi``: the ``value`` of the last row of the right side not after each row, and of the first not before it. ``value`` is null on the left side."""
    x = spread(both, keys, at)
    right_at = F.when(~F.col(is_left), F.col(at))  # min_by and max_by pass over nulls
    ends = x.groupBy(*PARTS).agg(F.min_by(value, right_at).alias("head"), F.max_by(value, right_at).alias("tail"))
    carry = ends.select(*PARTS, F.last("tail", ignorenulls=True).over(before()).alias("__before"), F.first("head", ignorenulls=True).over(behind()).alias("__behind"))
    # the right side comes first among equal instants when looking back, last when looking ahead
    back = Window.partitionBy(*PARTS).orderBy(F.col(at), F.col(is_left).cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*PARTS).orderBy(F.col(at), F.col(is_left).cast("int").desc()).rowsBetween(0, Window.unboundedFollowing)
    x = x.withColumns({"__lo": F.last(value, ignorenulls=True).over(back), "__hi": F.first(value, ignorenulls=True).over(ahead)}).join(carry, PARTS)
    return x.withColumns({"__lo": F.coalesce("__lo", "__before"), "__hi": F.coalesce("__hi", "__behind")}).select(*both.columns, "__lo", "__hi")
