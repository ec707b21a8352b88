"""Time series cut into bounded blocks with a halo of neighbouring readings.

A key (one joint of one episode, say) may hold a third of all rows, so no
operator groups by the key alone. Readings are packed by (key, time block);
the packing aggregates on the map side, where repeated deliveries of one
message collapse. What a block must know of its neighbours, the last readings
before it and the first ones after it, is sent to it by their block numbers;
who is whose neighbour is worked out on block numbers alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NANOS = 1_000_000_000
SPAN = 4096


def instant_ns(seconds: str = "ts_seconds", nanos: str = "ts_nanos"):
    """Seconds and nanoseconds as one instant in nanoseconds; null if either is null."""
    return F.col(seconds).cast("long") * F.lit(NANOS) + F.col(nanos).cast("long")


SERIES = "__series"
PLACE = [SERIES, "block"]


def _numbered(df: DataFrame, keys: Sequence[str], at: str, width: int) -> DataFrame:
    """The rows with an instant, with their series as one struct (so that null keys are equal, and joins on it need no second shuffle) and their block."""
    placed = df.where(F.col(at).isNotNull()).withColumns({SERIES: F.struct(*keys), "block": F.expr(f"({at} - pmod({at}, {width}L)) div {width}L")})
    # inner joins infer this filter; said here, every branch has it and all read one exchange
    return placed.where(F.col("block").isNotNull())


def pack_blocks(df: DataFrame, keys: Sequence[str], at: str, fields: Sequence[str], width: int) -> DataFrame:
    """(__series, block, items): the distinct (at, fields...) of each block in order; ``__series`` is a struct of the keys.

    ``at`` is a long; block = floor(at / width). Rows with a null ``at`` are
    left out. Exact repeats become one item, already on the map side.
    """
    return _numbered(df, keys, at, width).groupBy(*PLACE).agg(F.sort_array(F.collect_set(F.struct(at, *fields))).alias("items"))


def block_numbers(df: DataFrame, keys: Sequence[str], at: str, width: int) -> DataFrame:
    """(__series, block) of the blocks that ``pack_blocks`` makes, from the keys and instants alone."""
    return _numbered(df, keys, at, width).select(*PLACE).distinct()


def neighbours(numbers: DataFrame) -> DataFrame:
    """(__series, block, prev, next): the nearest blocks that hold anything, null at a series' ends.

    Two levels of narrow windows: one over the blocks of a span of ``SPAN``
    block widths, one over the spans. No window sees a row for each block of a
    hot key; the outer one sees a row for each span of its time.
    """
    n = numbers.withColumn("span", F.expr(f"(block - pmod(block, {SPAN}L)) div {SPAN}L")).where(F.col("span").isNotNull())  # as above, for reuse
    inner, outer = Window.partitionBy(SERIES, "span").orderBy("block"), Window.partitionBy(SERIES).orderBy("span")
    within = n.withColumns({"prev": F.lag("block").over(inner), "next": F.lead("block").over(inner)})
    ends = within.groupBy(SERIES, "span").agg(F.min("block").alias("first"), F.max("block").alias("final"))
    ends = ends.select(SERIES, "span", F.lag("final").over(outer).alias("before"), F.lead("first").over(outer).alias("behind"))
    return within.join(ends, [SERIES, "span"]).select(*PLACE, F.coalesce("prev", "before").alias("prev"), F.coalesce("next", "behind").alias("next"))


def with_halo(blocks: DataFrame, keys: Sequence[str], halo: int, fields: Sequence[str], numbers: DataFrame | None = None) -> DataFrame:
    """(keys, block, items, before, after): the neighbouring blocks' items beside each block's own, of each field the nearest ``halo`` that have it.

    Neighbours are the nearest blocks that hold anything; the arrays are empty
    at the ends of a series. Each block sends its last items on and its first
    ones back, addressed by block number, so a hot key is spread like its blocks.
    ``numbers`` are the ``block_numbers``, where they come cheaper than from the blocks.
    """
    ask = lambda f: lambda x: x[f].isNotNull()
    first = lambda a: F.slice(a, 1, halo)
    last = lambda a: F.slice(a, F.greatest(F.size(a) - F.lit(halo - 1), F.lit(1)), F.lit(halo))

    def near(end):
        """The items at an end if each has all fields, else those of each field; sorted, repeats still in."""
        whole = F.forall(end(F.col("items")), lambda x: reduce(and_, [x[f].isNotNull() for f in fields]))
        return F.when(whole, end(F.col("items"))).otherwise(F.sort_array(F.concat(*[end(F.filter("items", ask(f))) for f in fields])))

    once = lambda c: F.filter(c, lambda x, i: (i == 0) | (x != F.get(c, i - 1))).alias(c)
    ends = blocks.select(*PLACE, near(first).alias("head"), near(last).alias("tail")).select(*PLACE, once("head"), once("tail"))
    ends = ends.join(neighbours(blocks.select(*PLACE) if numbers is None else numbers), PLACE)
    empty = F.slice("tail", 1, 0)
    letter = lambda to, before, after: F.struct(F.col(to).alias("block"), before.alias("before"), after.alias("after"))
    post = ends.select(SERIES, F.explode(F.array(letter("next", F.col("tail"), empty), letter("prev", empty, F.col("head")))).alias("p")).where("p.block is not null")
    got = post.select(SERIES, "p.*").groupBy(*PLACE).agg(F.flatten(F.collect_list("before")).alias("before"), F.flatten(F.collect_list("after")).alias("after"))
    none = F.slice("items", 1, 0)
    joined = blocks.join(got, PLACE, "left")
    return joined.select(*[F.col(SERIES)[k].alias(k) for k in keys], "block", "items", F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"))
