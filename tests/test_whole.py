"""Queries that read all of their tables: against SQL without filters and against brute force."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def rows_of_sql(sql):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return sorted(con.execute(sql).fetchall())


@needs_data
def test_dilation_and_erosion_of_the_whole_table(spark):
    cells = set(rows_of_sql("SELECT DISTINCT CAST(l_quantity AS INT), CAST(round(l_discount * 100) AS INT) FROM lineitem"))
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    spread = {(x + a, y + b) for x, y in cells for a, b in around}
    assert rows_of(entry.queries()["gr08_dilate"](spark, DATA)) == sorted(spread)
    assert rows_of(entry.queries()["gr08_erode"](spark, DATA)) == sorted(c for c in spread if all((c[0] + a, c[1] + b) in cells for a, b in around))


def test_bags_are_compared_both_ways(spark):
    from kinelake.plans.q_relational import compare_bags

    bag = lambda *v: spark.createDataFrame([(x,) for x in v], "v string")
    cases = [(("a", "a", None), ("a", None, "a"), True, 0), (("a", "a", None), ("a", None, None), False, 1), (("a",), ("a", "b"), False, 0), (("a",), ("a", None), False, 0), ((), (), True, 0), ((), ("a",), False, 0), (("a",), (), False, 1)]
    for x, y, equal, surplus in cases:
        assert compare_bags(bag(*x), bag(*y)).collect() == [(equal, surplus)]


@needs_data
def test_unequal_bags_of_two_tables(spark):
    got = rows_of(entry.queries()["so05_ag40_two_bags"](spark, DATA))
    assert got == rows_of_sql(entry.oracle_sql()["so05_ag40_two_bags"]) and not got[0][0]
    assert rows_of(entry.queries()["so05_ag40_bag_equality"](spark, DATA)) == rows_of_sql(entry.oracle_sql()["so05_ag40_bag_equality"])


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_words_against_the_table():
    import random

    from kinelake.plans.q_text import common_words

    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(90))] for _ in range(2))
        assert common_words(a, b) == table_lcs(a, b)


@needs_data
def test_rouge_of_whole_truths(spark):
    import re

    of = {}
    for source, text in rows_of_sql("SELECT coalesce(source, ''), text FROM documents WHERE text IS NOT NULL"):
        truth, said = text.lower().split(), re.sub(r"\b(the|and|of) ", "", text, flags=re.A).strip()[:512].lower().split()
        if truth:
            n = table_lcs(truth, said)
            of.setdefault(source, []).append(2 * n / (len(truth) + len(said)))
    got = {r.source or "": r.rouge_l for r in entry.queries()["ag21_rouge_l"](spark, DATA).collect()}
    assert got == pytest.approx({k: sum(v) / len(v) for k, v in of.items()}, abs=1e-6)


@needs_data
def test_prompts_hold_whole_instructions(spark):
    want = rows_of_sql("SELECT doc_id, 'Do ' || text || ' Answer.' || CASE WHEN n_chars > 300 THEN ' These are your historical observations <memory>.' ELSE '' END FROM documents WHERE text IS NOT NULL")
    assert rows_of(entry.queries()["st14_prompt"](spark, DATA)) == want


def one_more_round(x, missing):
    """A centred series after one more round, by its singular vectors."""
    import numpy as np

    n = len(x)
    length = min(10, n // 2)
    h = np.array([x[i : i + n - length + 1] for i in range(length)])
    u = np.linalg.svd(h, full_matrices=False)[0][:, :3]
    low, total, count = u @ u.T @ h, np.zeros(n), np.zeros(n)
    for i in range(length):
        total[i : i + n - length + 1] += low[i]
        count[i : i + n - length + 1] += 1
    return np.where(missing, total / count, x)


def test_imputation_settles_with_the_production_parameters():
    import numpy as np

    from kinelake.operators import regular

    rng, slow = np.random.default_rng(2), 0
    for n in (40, 75, 120):
        values = np.cumsum(rng.normal(size=(30, n)), axis=1)
        missing = rng.random((30, n)) < 0.4
        missing[:, [0, -1]] = False
        guess = np.stack([regular.first_guess(np.where(m, np.nan, v), np.zeros(n, int)) for v, m in zip(values, missing)])
        x, settled = regular.ssa_settle(guess, missing)
        assert settled.all() and (x == regular.ssa_impute(guess, missing)).all()
        for row, m, g in zip(x, missing, guess):
            centred = row - g.mean()
            assert np.abs(one_more_round(centred, m) - centred).max() <= 1.5e-3 * g.std()
        short, few = regular.ssa_settle(guess, missing, rounds=12)
        slow += (~few).sum()
    assert slow > 10


def test_unsettled_rows_are_marked(spark, monkeypatch):
    import numpy as np

    from kinelake.operators import regular

    rng = np.random.default_rng(4)
    values, run = np.cumsum(rng.normal(size=200)), np.repeat([1, 2], 100)
    values[rng.random(200) < 0.4] = np.nan
    values[[0, 100]] = 0.0
    assert not regular._impute(values, run)[1].any()
    settle = regular.ssa_settle
    monkeypatch.setattr(regular, "ssa_settle", lambda x, m: settle(x, m, rounds=1))
    assert (regular._impute(values, run)[1] == np.isnan(values)).all()
    if os.path.isdir(DATA):
        out = entry.queries()["p3_series"](spark, DATA).toPandas()
        assert out.unsettled.dtype == bool and not out.unsettled.any() and (out.method == "ssa").any()


def test_variants_run_the_whole_path():
    import numpy as np

    from kinelake.plans.q_more import path_variants

    x = np.stack([np.linspace(5, 45, 60), np.linspace(45, 5, 60)], axis=1)
    kept = path_variants(x, 7, 3)
    assert len(kept) == 3
    for y in kept:
        assert y.shape == x.shape and 0 < np.abs(y - x).max() < 4 and (y != x).any(axis=1).all()


@needs_data
def test_variant_lengths_are_those_of_whole_paths(spark):
    from collections import defaultdict

    import numpy as np

    from kinelake.plans.q_more import base

    paths, got = defaultdict(list), defaultdict(list)
    for r in base(spark, DATA).select("user_id", "event_id", "ax", "ay").orderBy("event_id").collect():
        paths[r.user_id].append((r.ax, r.ay))
    for r in entry.queries()["sr24_sr25_variants"](spark, DATA).collect():
        got[r.user_id].append(r.length)
    assert set(got) == set(paths)
    for user, sizes in got.items():
        x = np.array(paths[user])
        assert np.abs(np.array(sizes) - np.linalg.norm(np.diff(x, axis=0), axis=1).sum()).max() <= 2 * 0.5 * 4 * len(x)


@needs_data
def test_conversations_hold_the_texts(spark):
    want = rows_of_sql("SELECT scene_id, string_agg('### ' || source || ': ' || coalesce(text, '') || chr(10), '' ORDER BY doc_id) FROM documents WHERE source IS NOT NULL GROUP BY 1")
    assert rows_of(entry.queries()["st16_speakers"](spark, DATA)) == want


@pytest.mark.parametrize("ids", [1, 7, 4096])
def test_packing_by_hand(spark, ids):
    import random

    from kinelake.operators.packing import pieces

    rng = random.Random(6)
    rows = [(rng.choice("ab"), i, rng.choice([1, 2, 9, 10, 11, 35])) for i in rng.sample(range(200), 60)] + [("short", 500, 9), ("even", 600, 20)]
    want, end = set(), {}
    for g, i, n in sorted(rows, key=lambda r: r[1]):
        for k in range(n):
            at = end[g] = end.get(g, -1) + 1
            want.add((g, at // 10, at % 10, i, k))
    want = {(*w, (w[1] + 1) * 10 <= end[w[0]] + 1) for w in want}
    got = pieces(spark.createDataFrame(rows, "g string, i long, n long"), "g", "i", "n", 10, ids).collect()
    spread = [(r.g, r.block_no, r.block_offset + k, r.i, r.record_from + k, r.full) for r in got for k in range(r.n_taken)]
    assert len(spread) == len(want) and set(spread) == want


@needs_data
@pytest.mark.parametrize("name", ["ar05_pack", "ar05_places", "ar05_blocks"])
def test_packing_against_sql(spark, name):
    assert rows_of(entry.queries()[name](spark, DATA)) == rows_of_sql(entry.oracle_sql()[name])


def test_texts_with_tabs_and_vertical_tabs_stay(spark, tmp_path):
    texts = ["a\tb c\n", "  a\x0bb\r\n", "\x0b", "plain ", "", None, "x\n\ny\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    q = entry.queries()
    assert rows_of(q["st04_trim"](spark, str(tmp_path))) == [(0, "a\tb c"), (1, "a\x0bb"), (2, "\x0b"), (3, "plain"), (4, ""), (6, "x\n\ny")]
    assert rows_of(q["st21_estimates"](spark, str(tmp_path))) == [(i, len(t.split()) + 128, -(-len(t) // 4)) for i, t in enumerate(texts) if t is not None]


def test_heaps_of_boxes_at_one_place(spark, tmp_path):
    import threading

    n = 400_000  # 25 billion pairs of one category and cell
    spark.range(n).selectExpr("id as p_partkey", "'A' as p_type", "5 as p_size").write.parquet(str(tmp_path / "part.parquet"))
    late = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = rows_of(entry.queries()["jn17_detections"](spark, str(tmp_path)))
    finally:
        late.cancel()
    first = {p: min(k for k in range(100) if k % 5 and abs(k % 13 - p) <= 1) for p in range(13)}
    assert got == [(k, first[k % 13]) for k in range(0, n, 5)]


@needs_data
def test_detections_against_sql(spark):
    assert rows_of(entry.queries()["jn17_detections"](spark, DATA)) == rows_of_sql(entry.oracle_sql()["jn17_detections"])


def test_interpolation_far_away_to_the_last_decimal(spark, tmp_path):
    """Users with high ids give long ways, where another order of the same steps rounds otherwise; unknown values leave two poses."""
    import duckdb

    con = duckdb.connect()
    con.execute("""CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' AS ts, 90000 - 1009 * i AS user_id, 'view' AS event_type,
        CASE WHEN i <> 9 THEN round(i * 37.77 % 200, 2) END AS value, '{"k": ' || i * 13 % 100 || '}' AS props FROM range(20) t(i)""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df = entry.queries()["ma30_ma32_interpolation"](spark, str(tmp_path))
    got, want = df.collect(), con.execute(entry.oracle_sql()["ma30_ma32_interpolation"]).fetchall()
    key = lambda r: (r[0], r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert len(got) > 40_000 and [r.step_no for r in got if r.event_id == 9] == [0, 1]


def test_interpolation_lays_equal_ways_side_by_side(spark, tmp_path):
    """Else the result, many times its input, repeats z without being packed; no event is lost by the order."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' AS ts, i % 5 * 100 AS user_id, 'view' AS event_type, i % 3 * 20.0 AS value, '{\"k\": 0}' AS props FROM range(720) t(i)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = entry.queries()["ma30_ma32_interpolation"](spark, str(tmp_path)).collect()
    ways = [(r.n_steps, r.event_id % 9, r.event_id % 4) for r in got if r.step_no == 0]
    assert len(ways) == 720 and 1 + sum(a != b for a, b in zip(ways, ways[1:])) == len(set(ways)) < 720
    assert all((b.event_id, b.step_no) == (a.event_id, a.step_no + 1) for a, b in zip(got, got[1:]) if b.step_no)


def test_nine_decimals_round_halves_away_from_zero(spark):
    from pyspark.sql import functions as F

    from kinelake.plans.registry import r9

    cases = [(0.5e-9, 1e-9), (-0.5e-9, -1e-9), (2.5e-9, 3e-9), (1.5e-9, 2e-9), (1.25, 1.25), (0.49999999999999994e-9, 0.0), (0.0, 0.0), (-1e-12, 0.0), (1e12 + 0.5, 1e12 + 0.5), (None, None), (float("inf"), float("inf"))]
    got = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x double").select("i", r9(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == [y for _, y in cases] and all(str(r.y) != "-0.0" for r in got)
