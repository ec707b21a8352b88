"""Packing of texts or token lists into blocks of a fixed length, without a global sort of a group.

Records of a group follow each other in the order of a unique integer id. The
running sum is taken in two steps: totals of id ranges are summed up over a
small table, then each range sums its own records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pieces(records: DataFrame, group: str, order: str, size: str, block: int, ids: int = 4096) -> DataFrame:
    """A row for each piece of a record in a block: the records' columns and block_no, block_offset, record_from, n_taken and full.

    ``size`` holds each record's length with its separator, at least 1; groups
    aren't null. full: the block is filled to its end, which only a group's
    last block may not be. ``ids`` is the width of the id ranges.
    """
    x = records.withColumn("__range", F.floor(F.col(order) / ids))
    totals = x.groupBy(group, "__range").agg(F.sum(size).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(group).orderBy("__range"))
    totals = totals.select(group, "__range", (upto - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(group)).alias("__total"))
    own = F.sum(size).over(Window.partitionBy(group, "__range").orderBy(order)) - F.col(size)
    x = x.join(totals, [group, "__range"]).withColumn("__at", F.col("__before") + own)
    at, end = F.col("__at"), F.col("__at") + F.col(size)
    x = x.withColumn("block_no", F.explode(F.sequence(F.floor(at / block), F.floor((end - 1) / block))))
    lo, hi = F.greatest(at, F.col("block_no") * block), F.least(end, (F.col("block_no") + 1) * block)
    return x.select(*records.columns, "block_no", (lo - F.col("block_no") * block).alias("block_offset"), (lo - at).alias("record_from"), (hi - lo).alias("n_taken"), ((F.col("block_no") + 1) * block <= F.col("__total")).alias("full"))
