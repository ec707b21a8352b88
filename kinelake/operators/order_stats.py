"""Exact percentiles and first rows of large groups, without a task that sorts a group.

Values are cut into buckets that keep their order, an octave in ``STEPS`` parts.
Counts by bucket tell in which bucket a rank lies, and only that bucket's
distinct values, or rows, are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 1024


def order_bucket(value: Column) -> Column:
    """A whole number that never falls as the value grows; NaN comes last."""
    size = F.floor((F.log2(F.abs(value.cast("double"))) + 1100) * STEPS)
    return F.when(F.isnan(value.cast("double")), F.lit(1 << 40)).when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("long")


def percentiles(df: DataFrame, group: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(group..., p): for each group the values at the shares of its order, interpolated between neighbours; nulls don't count, groups may be null."""
    x = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("c")).withColumn("bucket", order_bucket(F.col(value)))
    order = Window.partitionBy(*group).orderBy("bucket")
    per = x.groupBy(*group, "bucket").agg(F.sum("c").alias("c"))
    per = per.select(*group, "bucket", "c", (F.sum("c").over(order) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy(*group)).alias("n"))
    at = [(F.col("n") - 1) * float(s) for s in shares]
    ranks = F.array(*[F.struct(F.lit(i).alias("no"), side(h).cast("long").alias("rank"), (h - F.floor(h)).alias("part")) for i, h in enumerate(at) for side in (F.floor, F.ceil)])
    want = per.select(*group, "bucket", "before", "c", F.explode(ranks).alias("r")).where((F.col("r.rank") >= F.col("before")) & (F.col("r.rank") < F.col("before") + F.col("c")))
    want = want.groupBy(*group, "bucket").agg(F.collect_set(F.struct("r.no", (F.col("r.rank") - F.col("before")).alias("place"), "r.rank", "r.part")).alias("wanted"))  # two a share at most
    on = F.lit(True)
    for k in [*group, "bucket"]:
        on = on & F.col(f"x.{k}").eqNullSafe(F.col(f"w.{k}"))
    inner = Window.partitionBy(*group, "bucket").orderBy(value)
    hit = x.alias("x").join(want.alias("w"), on).select(*[F.col(f"x.{k}").alias(k) for k in [*group, "bucket", value, "c"]], "wanted")
    hit = hit.withColumn("upto", F.sum("c").over(inner)).select(*group, value, "c", "upto", F.explode("wanted").alias("w"))
    hit = hit.where((F.col("w.place") < F.col("upto")) & (F.col("w.place") >= F.col("upto") - F.col("c")))
    each = hit.groupBy(*group, F.col("w.no").alias("no")).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.max("w.part").alias("part"))
    p = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")
    return each.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("no", p.alias("p")))), lambda s: s["p"]).alias("p"))


def first_rows(df: DataFrame, key: str | Column, n: int, tie: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows with the smallest key (a number; ties by the ``tie`` columns), where n may grow with the table. Null keys come last."""
    k = F.col(key) if isinstance(key, str) else key
    x = df.withColumn("__bucket", F.coalesce(order_bucket(k), F.lit(1 << 41))).withColumn("__key", k)
    per = x.groupBy("__bucket").agg(F.count("*").alias("c"))
    upto = per.select("__bucket", "c", F.sum("c").over(Window.partitionBy(F.lit(1)).orderBy("__bucket")).alias("upto"))  # a row a bucket
    cut = upto.where((F.col("upto") >= n) & (F.col("upto") - F.col("c") < n)).first()
    if n <= 0:
        return df.limit(0)
    if cut is None:
        return df
    below = x.where(F.col("__bucket") < cut["__bucket"])
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(F.col("__key").asc_nulls_last(), *tie))
    last = x.where(F.col("__bucket") == cut["__bucket"]).withColumn("__place", place).where(F.col("__place") <= n - (cut["upto"] - cut["c"]))
    return below.unionByName(last.drop("__place")).select(*df.columns)
