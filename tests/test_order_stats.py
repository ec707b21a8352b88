import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.operators import order_stats, timeseries, vectors
from kinelake.sources.readers import sample_rows


def test_percentiles_against_numpy(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([rng.uniform(-5, 5), float(rng.randrange(-3, 3)), rng.lognormvariate(0, 4)])) for g in ("a", "b", None) for _ in range(rng.choice([1, 40, 301]))]
    rows += [("hot", 2.5)] * 500 + [("hot", None)] * 20 + [("none", None)]
    shares = [0.0, 0.02, 0.5, 0.9, 1.0]
    got = {r["g"]: r["p"] for r in order_stats.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares).collect()}
    assert set(got) == {"a", "b", None, "hot"}
    for g, p in got.items():
        assert p == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], shares).tolist())
    assert order_stats.percentiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", [0.5]).count() == 0


def test_first_rows_against_a_sort(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, float("nan"), -1.5, 0.0, 3.25, rng.gauss(0, 100)])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(5)
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] is not None and r[1] != r[1], r[1] if r[1] is not None and r[1] == r[1] else 0, r[0]))
    for n in (0, 1, 57, 250, 399, 400, 900):
        assert {r["id"] for r in order_stats.first_rows(df, "v", n, ["id"]).collect()} == {r[0] for r in order[:n]}
    assert order_stats.first_rows(df.limit(0), "v", 3).count() == 0


@pytest.mark.parametrize("strategy, want", [("all", 50), ("first:7", 7), ("end:3", 3), ("random:10%", 5), ("first:1%", 1)])
def test_samples(spark, strategy, want):
    df = spark.range(50)
    got = sorted(r["id"] for r in sample_rows(df, strategy, "id").collect())
    assert len(got) == want
    if strategy.startswith("first"):
        assert got == list(range(want))
    if strategy.startswith("end"):
        assert got == list(range(50 - want, 50))


def test_both_ways_of_vector_search_agree(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 4)] if i % 17 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, e array<float>").repartition(3)
    here = {tuple(r) for r in vectors.top_k(df.where("id % 9 = 0"), df, "id", "e", 4).collect()}
    there = {tuple(r) for r in vectors.top_k(df.where("id % 9 = 0"), df, "id", "e", 4, broadcast_bytes=0).collect()}
    assert {(a, b, round(c, 9), d) for a, b, c, d in here} == {(a, b, round(c, 9), d) for a, b, c, d in there} and len(here) == 4 * len([i for i in range(0, 400, 9) if i % 17])


def test_recurrences_are_those_of_a_loop(spark):
    df = spark.createDataFrame([([1.0, 2.0, None, 4.0],), ([],), (None,), ([5.0] * 2000,)], "v array<double>")
    a, b, c, d = (r["s"] for r in df.select(timeseries.ema(F.col("v"), 0.25).alias("s")).collect())
    assert a[:2] == [1.0, 1.25] and np.isnan(np.array(a[2:], float)).all() and b == [] and c is None and d == [5.0] * 2000
