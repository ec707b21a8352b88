"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the documents stand in
key order, and a distributed prefix sum of their token counts says where the
source's budget ends: the key space is cut into ranges, the ranges' totals give
each range its offset, and the running sum within a range does the rest. Budgets
above a source's size repeat it: whole epochs, then the prefix that the rest
of the budget reaches. No task holds a source, a hot one least of all.

The size of the mix is the largest at which every source can supply its share
with each document used at most ``max_repeats`` times, unless ``total`` names a
smaller one. A source's last document is the one in whose middle the budget
ends at the latest, so a share is off by at most half a document.

Defined cases: documents of unlisted or null sources and those without tokens
(null and empty texts) are not used; a listed source without tokens gets none,
and the shares of the others are taken relative to each other; a target row
with a null or non-positive share or repeat count has no share; a source listed
more than once counts once, with its largest share and count; rows that repeat
a document count as documents of their own; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm.tokens import count_tokens
from kinelake.session import materialize

ROWS_PER_RANGE = 20_000


def _targets(targets: DataFrame) -> DataFrame:
    good = targets.where((F.col("target_share") > 0) & ~F.isnan("target_share") & (F.col("max_repeats") > 0) & F.col("source").isNotNull())
    return good.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def budgets(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, tuple[int, float]]:
    """(whole epochs, tokens beyond them) of each source with tokens."""
    live = {s: t for s, t in targets.items() if sizes.get(s)}
    weight = sum(share for share, _ in live.values())
    if not live:
        return {}
    most = min(repeats * sizes[s] * weight / share for s, (share, repeats) in live.items())
    size = most if total is None else min(most, float(total))
    out = {}
    for s, (share, repeats) in live.items():
        want = min(size * share / weight, float(repeats * sizes[s]))
        epochs = int(min(repeats, (want + 1e-6 * sizes[s]) // sizes[s]))
        out[s] = (epochs, max(0.0, want - epochs * sizes[s]))
    return out


def mix_documents(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix, shares).

    mix: doc_id, source, n_tokens, n_uses (at least 1). shares: source,
    target_share, max_repeats, n_documents, tokens_available, tokens_used, actual_share.
    """
    spark = documents.sparkSession
    goals = materialize(_targets(targets))
    listed = documents.select("doc_id", "source", "text").join(goals.select("source"), "source", "left_semi")
    counted = count_tokens(listed, ["doc_id", "source"], path=path).where("n_tokens > 0")
    # rows that repeat a document are one row with their number, so that no key is hot
    copies = counted.groupBy("doc_id", "source", "n_tokens").agg(F.count("*").alias("n_copies"))
    rows = materialize(copies.withColumn("mix_key", F.xxhash64("doc_id", F.lit(seed))))

    per_source = {r["source"]: r for r in rows.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("t"), F.count("*").alias("n")).collect()}  # a row a listed source
    goal_rows = goals.collect()
    plan = budgets({s: r["t"] for s, r in per_source.items()}, {r["source"]: (r["target_share"], r["max_repeats"]) for r in goal_rows}, total)

    biggest = max((r["n"] for r in per_source.values()), default=1)
    bits = min(30, max(1, (biggest // ROWS_PER_RANGE).bit_length() + 1))
    place = F.shiftrightunsigned(F.col("mix_key").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits).alias("range_no")
    ranged = rows.select("*", place, (F.col("n_tokens") * F.col("n_copies")).alias("all_tokens"))
    offset = Window.partitionBy("source").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("source", "range_no").agg(F.sum("all_tokens").alias("range_tokens")).select("source", "range_no", F.coalesce(F.sum("range_tokens").over(offset), F.lit(0)).alias("before_range"))
    within = Window.partitionBy("source", "range_no").orderBy("mix_key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = spark.createDataFrame([(s, e, r) for s, (e, r) in plan.items()], "source string, epochs int, beyond double")
    placed = ranged.withColumn("in_range", F.sum("all_tokens").over(within)).join(ranges, ["source", "range_no"]).join(budget, "source")
    # a copy is used once more if its middle lies within what the budget reaches of the last epoch
    reach = (F.col("beyond") - (F.col("before_range") + F.col("in_range") - F.col("all_tokens"))) / F.col("n_tokens")
    more = F.when(F.col("beyond") > 0, F.least(F.greatest(F.floor(reach + 0.5), F.lit(0)), F.col("n_copies"))).otherwise(F.lit(0))
    parts = F.array(F.struct((F.col("epochs") + 1).alias("n_uses"), more.alias("n")), F.struct(F.col("epochs").alias("n_uses"), (F.col("n_copies") - more).alias("n")))
    part = placed.select("doc_id", "source", "n_tokens", F.explode(parts).alias("p")).where("p.n > 0 and p.n_uses > 0")
    mix = part.select("doc_id", "source", "n_tokens", F.col("p.n_uses").cast("int").alias("n_uses"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("p.n"))).alias("copy")).drop("copy")

    used = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("tokens_used"))
    have = rows.groupBy("source").agg(F.sum("n_copies").alias("n_documents"), F.sum(F.col("n_tokens") * F.col("n_copies")).alias("tokens_available"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    shares = goals.join(have, "source", "left").join(used, "source", "left").select("source", "target_share", "max_repeats", zero("n_documents"), zero("tokens_available"), zero("tokens_used"))
    all_used = F.sum("tokens_used").over(Window.partitionBy(F.lit(1)))  # one row a listed source
    return mix, shares.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens_used").cast("double"), all_used), F.lit(0.0)))
