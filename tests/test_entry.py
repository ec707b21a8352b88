"""The registered queries on the smallest tables: they run, agree in columns with their SQL, and don't need the optional subpackage."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
SOME = ["p3_found", "ag05_dense_steps", "wn12_merge_adjacent", "jn06_as_of_nearest", "ma03_slerp", "ader_tree", "sm02_sm05_gate", "gr08_components", "sr03_jn09_ma27_top_k"]


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*cols).collect())


@pytest.mark.parametrize("name", SOME)
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cols, got = rows_of(entry.queries()[name](spark, DATA))
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted(repr([round(r[names.index(c)], 9) if isinstance(r[names.index(c)], float) else r[names.index(c)] for c in cols]) for r in cur.fetchall())
    assert got == want


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns == ["episode_id", "joint_name", "cell_ms"]
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and {f"p{n}_found" for n in range(1, 6)} <= set(q)
