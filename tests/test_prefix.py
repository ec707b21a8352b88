import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kinelake.operators import prefix, timeseries

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out, i = [], 0
    for key in ("hot", "few", None, "one"):
        t = T0
        for _ in range({"hot": 300, "few": 12, None: 60, "one": 1}[key]):
            t += dt.timedelta(seconds=rng.choice([0, 1, 600, 3000, 9000, 90_000]))
            out.append((i, key, t, rng.choice([True, True, True, False, None]), rng.choice(["a", "a", "b", None])))
            i += 1
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, t timestamp, f boolean, s string").repartition(7)


def ordered(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        groups.setdefault(r[1], []).append(r)
    return groups


def test_run_lengths(df, rows):
    want = {}
    for g in ordered(rows).values():
        run = 0
        for r in g:
            run = run + 1 if r[3] else 0
            want[r[0]] = run
    assert {r["id"]: r["run"] for r in timeseries.run_length(df, F.col("f"), ["k"], ["t", "id"]).collect()} == want


def test_segments_and_sessions(df, rows):
    seg, ses = {}, {}
    for g in ordered(rows).values():
        a, b, last = 0, 0, None
        for r in g:
            a += last is None or r[4] != last[4]
            b += last is not None and (r[2] - last[2]).total_seconds() > 1800
            seg[r[0]], ses[r[0]], last = a, b, r
    got = timeseries.segments(timeseries.sessions(df, "t", 1800, ["k"], "id"), ["s"], ["k"], ["t", "id"]).collect()
    assert {r["id"]: r["segment"] for r in got} == seg and {r["id"]: r["session"] for r in got} == ses


def test_running_sums(df, rows):
    want = {}
    for g in ordered(rows).values():
        n = 0
        for r in g:
            n += r[0] if r[3] else 0
            want[r[0]] = n
    assert {r["id"]: r["n"] for r in prefix.running_sum(df, F.when(F.col("f"), F.col("id")), ["k"], ["t", "id"], "n").collect()} == want


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_as_of(spark, df, rows, direction):
    rng = random.Random(9)
    right = [(k, t + dt.timedelta(seconds=rng.choice([0, 5, 40_000])), i) for i, (_, k, t, _, _) in enumerate(rng.sample(rows, 40))]
    by_time = {}
    for k, t, i in right:
        by_time[k, t] = i
    right = [(k, t, i) for (k, t), i in by_time.items()]
    seconds = lambda d: d.withColumn("at", F.unix_micros("t"))
    got = timeseries.as_of(seconds(df), seconds(spark.createDataFrame(right, "k string, t timestamp, v long")), ["k"], "at", ["v"], direction).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [(t, v) for k, t, v in right if k == r["k"] and t <= r["t"]]
        behind = [(t, v) for k, t, v in right if k == r["k"] and t >= r["t"]]
        lo, hi = max(before, default=None), min(behind, default=None)
        if direction == "nearest":
            pick = lo if hi is None or (lo is not None and r["t"] - lo[0] <= hi[0] - r["t"]) else hi
        else:
            pick = lo if direction == "backward" else hi
        assert r["v"] == (pick[1] if pick else None)


def test_empty_tables(df):
    none = df.limit(0)
    assert timeseries.run_length(none, F.col("f"), ["k"], ["t", "id"]).count() == timeseries.segments(none, ["s"], ["k"], ["t", "id"]).count() == timeseries.sessions(none, "t", 5, ["k"], "id").count() == 0
