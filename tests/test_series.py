import math
import random

import numpy as np
import pytest

from kinelake.operators import regular, spikes

R = "reading_id long, robot_id string, episode_id string, topic string, joint_name string, seq_no long, ts_seconds long, ts_nanos int, joint_position double, joint_velocity double, joint_effort double, block string, at string"
P = "joint_name string, joint_kind string, position_lower_limit double, position_upper_limit double, velocity_limit double, effort_limit double"


def reading(i, ns, pos, vel=0.0, eff=None, ep="e", joint="j", robot="r", seq=None):
    s, n = (None, None) if ns is None else divmod(ns, 10**9)
    return (i, robot, ep, "t", joint, i if seq is None else seq, s, n, pos, vel, eff, "clash", "clash")


def cells_by_hand(rows):
    seen = {}
    for r in rows:
        if r[6] is not None and r[8] is not None and not math.isnan(r[8]):
            seen.setdefault((r[2], r[4]), set()).add((r[6] * 10**9 + r[7]) // 10**8)
    return {(*k, c * 100) for k, v in seen.items() for c in range(min(v), max(v) + 1) if c not in v}


def test_empty_cells_against_brute_force(spark):
    rng = random.Random(3)
    rows, i = [], 0
    for ep in ("e1", "e2", None):
        for joint in ("a", "b"):
            t = 1_700_000_000 * 10**9 + rng.randrange(10**9) - (95 * 10**9 if ep == "e1" else 0)
            for _ in range(120):
                t += rng.choice([20, 60, 150, 400, 20_000 if ep == "e1" else 90]) * 10**6 + rng.randrange(1000)
                i += 1
                rows.append(reading(i, t, rng.choice([math.sin(i / 9)] * 8 + [None, float("nan"), float("inf")]), rng.choice([1.0, None, float("nan")]), ep=ep, joint=joint))
                if rng.random() < 0.1:
                    i += 1
                    rows.append((i, *rows[-1][1:]))
    rows.append(reading(i + 1, None, 1.0))
    rows.append(reading(i + 2, 10**18, 1.0, ep="alone"))
    rng.shuffle(rows)
    out = regular.regular_series(spark.createDataFrame(rows, R)).toPandas()
    got = {(None if isinstance(r.episode_id, float) else r.episode_id, r.joint_name, r.cell_ms) for r in out[out.filled].itertuples()}
    assert got == cells_by_hand(rows)
    assert not out.duplicated(["episode_id", "joint_name", "cell_ms"]).any()
    assert set(out.method) == {"observed", "ssa", "marked"} and out[out.method == "marked"].joint_position.isna().all()
    assert out[out.method == "observed"].filled.sum() == 0
    assert out[out.method == "ssa"].joint_position.notna().all()
    assert regular.regular_series(spark.createDataFrame([], R)).count() == 0


def test_ssa_recovers_a_wave():
    t = np.arange(120)
    x = np.stack([np.sin(t / 5 + p) for p in range(4)])
    missing = np.zeros_like(x, bool)
    for k in range(4):
        missing[k, [20 + k, 21 + k, 50, 51, 52, 80]] = True
    guess = np.stack([regular.first_guess(np.where(m, np.nan, r), np.zeros(120, int)) for r, m in zip(x, missing)])
    fixed = regular.ssa_impute(guess, missing, rounds=60, tolerance=1e-6)
    assert np.abs(fixed - x)[missing].max() < 0.25 * np.abs(guess - x)[missing].max() and (fixed[~missing] == pytest.approx(x[~missing]))


def test_long_silence_at_a_block_border(spark):
    base = 1_700_000_000 * 10**9
    rows = [reading(i, base + ns, 0.5) for i, ns in enumerate([0, 10**8, 95 * 10**9, 100 * 10**9 + 3 * 10**8, 450 * 10**9])]
    out = regular.regular_series(spark.createDataFrame(rows, R))
    assert {r["cell_ms"] for r in out.where("filled").collect()} == {c * 100 for c in range(base // 10**8, base // 10**8 + 4501)} - {(r[6] * 10**9 + r[7]) // 10**8 * 100 for r in rows}


LIMITS = [("j", "revolute", -5.0, 5.0, 3.0, 10.0), ("free", "revolute", None, None, None, None)]


def found(spark, rows, limits=LIMITS):
    df = spikes.implausible_readings(spark.createDataFrame(rows, R), spark.createDataFrame(limits, P))
    return {(r["reading_id"], r["field_name"].split("_")[1], r["kind"]) for r in df.collect()}


def course(n, ep="e", start=0, noise=0.002, seed=1, joint="j"):
    rng = random.Random(seed)
    t0 = 1_700_000_000 * 10**9
    return [reading(start + i, t0 + i * 10**8 + rng.randrange(10**7), math.sin(i / 15) + rng.gauss(0, noise), math.cos(i / 15) + rng.gauss(0, noise), ep=ep, joint=joint) for i in range(n)]


def put(rows, i, pos):
    rows[i] = (*rows[i][:8], pos, *rows[i][9:])


def test_spikes_shifts_and_limits(spark):
    rows = course(300)
    put(rows, 50, rows[50][8] + 3)
    for k in (100, 101, 102):
        put(rows, k, rows[k][8] - 2)
    for k in range(150, 300):
        put(rows, k, rows[k][8] + 1.5)  # a new level that stays
    for k in (200, 201, 202, 203, 204):
        put(rows, k, rows[k][8] + 1.4)  # five readings are no spike
    put(rows, 250, float("nan"))
    put(rows, 251, 99.0)
    put(rows, 252, None)
    rows.append((900, *rows[50][1:]))  # second delivery of a case
    rows.append(reading(901, None, float("inf")))
    assert found(spark, rows) == {(50, "position", "spike"), (900, "position", "spike"), *((k, "position", "spike") for k in (100, 101, 102)), (250, "position", "limit"), (251, "position", "limit"), (901, "position", "limit")}


def test_two_spikes_with_one_good_reading_between(spark):
    rows = course(200)
    put(rows, 80, rows[80][8] + 3)
    put(rows, 82, rows[82][8] + 3)
    assert found(spark, rows) == {(80, "position", "spike"), (82, "position", "spike")}


def test_stuck_stretches(spark):
    rows = course(200)
    for k in range(60, 76):
        put(rows, k, 0.25)
    for k in range(120, 135):
        put(rows, k, 0.125)  # fifteen are too few
    put(rows, 65, None)  # nulls don't end a stretch, but don't count either
    rows.insert(0, (999, *rows[70][1:]))
    got = {x for x in found(spark, rows) if x[2] == "stuck"}
    assert got == set()
    put(rows, 77, 0.25)  # index shifted by one: reading 76
    got = {x[0] for x in found(spark, rows) if x[2] == "stuck"}
    assert got == {*range(60, 64), *range(65, 77), 999} - {64} or got == {k for k in range(60, 77) if rows[k + 1][8] is not None} | {999}


def test_a_stretch_across_a_block_border_and_a_frozen_source(spark):
    edge = 1_700_000_000 // 600 * 600 * 10**9
    rows = [reading(i, edge + (i - 40) * 10**8, math.sin(i / 9)) for i in range(80)]
    for k in range(32, 48):
        put(rows, k, 0.5)
    rows += [reading(1000 + i, edge + i * 10**8, 0.1, ep="f", joint="free", robot="q") for i in range(100)]
    rows[80 + 50] = reading(1050, edge + 50 * 10**8, 0.4, ep="f", joint="free", robot="q")
    got = found(spark, rows)
    assert {x[0] for x in got if x[2] == "stuck" and x[1] == "position"} == set(range(32, 48))
    assert (1050, "position", "spike") in got and not any(x[0] >= 1000 and x[0] != 1050 for x in got)


def test_empty_and_null_keys(spark):
    assert found(spark, course(0)) == set()
    rows = course(200)
    put(rows, 90, rows[90][8] + 3)
    rows = [(r[0], None, None, *r[3:]) for r in rows]
    assert found(spark, rows) == {(90, "position", "spike")}


def test_the_model_of_a_source_does_not_depend_on_batches(spark):
    rows = course(600) + course(600, ep="f", start=1000, seed=2) + course(400, ep="g", start=2000, seed=3, joint="k")
    put(rows, 300, rows[300][8] + 5)
    blocks = spikes.source_blocks(spark.createDataFrame(rows, R), spark.createDataFrame([], P)).repartition(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    models = []
    try:
        for n in (1, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            models.append(sorted(map(str, spikes.source_models(blocks)[0].collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert models[0] == models[1] and len(models[0]) == 2


def test_readings_between_two_gaps_are_no_spikes():
    t = np.cumsum(np.r_[np.ones(20), 15, 1, 18, np.ones(20)]) * 1e8
    v = np.r_[np.zeros(20), 0.13, 0.13, np.zeros(21)] + np.tile([0.0, 0.01], 22)[:43]
    one = np.ones(len(v))
    assert not spikes.find_spikes(v, t.astype(np.int64), one, 0.01 * one, 0 * one, pace=1e8 * one).any()
    assert spikes.find_spikes(v, np.arange(43) * 10**8, one, 0.01 * one, 0 * one, pace=1e8 * one).sum() == 2


def test_halo_reaches_the_nearest_blocks_by_field(spark):
    from kinelake.operators import blocks

    at = [0, 1, 2, 11, 12 * 4096 * 10 + 5, 12 * 4096 * 10 + 6, 12 * 4096 * 10 + 15]
    rows = [(key, a, float(a), 1.0 if a % 2 else None) for key in ("k", None) for a in at]
    df = spark.createDataFrame(rows, "key string, at long, a double, b double")
    got = blocks.with_halo(blocks.pack_blocks(df, ["key"], "at", ["a", "b"], 10), ["key"], 1, ["a", "b"]).collect()
    assert len(got) == 8
    for r in got:
        items = [x["at"] for x in r["items"]]
        below, above = [a for a in at if a < min(items)], [a for a in at if a > max(items)]
        prev = [a for a in below if a // 10 == max(below) // 10] if below else []
        nxt = [a for a in above if a // 10 == min(above) // 10] if above else []
        want = lambda side, pick: sorted({pick(s) for s in (side, [a for a in side if a % 2]) if s})
        assert [x["at"] for x in r["before"]] == want(prev, max)
        assert [x["at"] for x in r["after"]] == want(nxt, min)


def test_imputed_cells_are_near_those_held_back(spark):
    rows = course(900, noise=0.01) + course(900, ep="f", start=1000, seed=5, noise=0.01, joint="k")
    put(rows, 400, 50.0)  # a spike near which nothing is learnt
    e = {r["joint_name"]: r for r in regular.holdout_errors(spark.createDataFrame(rows, R)).collect()}
    assert set(e) == {"j", "k"} and all(50 < r["n_cells"] < 150 and r["ssa_p50"] < 0.02 and r["ssa_p90"] < 1.3 * r["linear_p90"] for r in e.values())


def test_a_stray_cell_keeps_its_value():
    x = np.sin(np.arange(200) / 9)
    x[60], x[63] = 40, np.nan
    out, unsettled = regular._impute(x, np.zeros(200, int))
    assert out[60] == 40 and abs(out[63] - np.sin(63 / 9)) < 0.05 and not unsettled.any()
