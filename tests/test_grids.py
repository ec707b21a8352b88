import random

import pytest

from kinelake.operators import grids


def near(a, b, r):
    return sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5 <= r


def clusters_by_hand(pts, r, least):
    count = {k: sum(near(p, q, r) for q in pts.values()) for k, p in pts.items()}
    core = [k for k in pts if count[k] >= least]
    label = {k: k for k in core}
    changed = True
    while changed:
        changed = False
        for a in core:
            for b in core:
                if label[b] < label[a] and near(pts[a], pts[b], r):
                    label[a] = label[b]
                    changed = True
    return {k: label[k] if k in label else min((label[c] for c in core if near(pts[c], p, r)), default=None) for k, p in pts.items()}


@pytest.mark.parametrize("axes, r, least, seed", [(1, 0.7, 1, 1), (1, 0.5, 4, 2), (2, 0.6, 3, 3), (2, 1.1, 1, 4), (2, 0.8, 6, 5), (3, 0.9, 3, 6)])
def test_clusters_against_brute_force(spark, axes, r, least, seed):
    rng = random.Random(seed)
    pts = {i: tuple(rng.choice([rng.uniform(-4, 4), rng.gauss(1, 0.2), 2.0]) for _ in range(axes)) for i in range(150)}
    names = ["x", "y", "z"][:axes]
    rows = [(k, *p) for k, p in pts.items()] + [(900, *[None] * axes), (901, *[float("nan")] * axes)]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{n} double" for n in names))
    got = {x["k"]: x["cluster"] for x in grids.density_clusters(df, "k", names, r, least).collect()}
    assert got == clusters_by_hand(pts, r, least) | {900: None, 901: None}
    kept = {x["k"] for x in grids.without_lonely(df, "k", names, r, least).collect()}
    assert kept == {k for k, p in pts.items() if sum(near(p, q, r) for q in pts.values()) - 1 >= least}


def test_a_dense_heap_is_one_cluster(spark):
    df = spark.range(20_000).selectExpr("id as k", "cast(id % 3 as double) / 100 as x", "0.0 as y")
    assert grids.density_clusters(df, "k", ["x", "y"], 1.0, 5).groupBy("cluster").count().collect()[0][:] == (0, 20_000)
    assert grids.density_clusters(df.limit(0), "k", ["x", "y"], 1.0, 5).count() == 0


def test_chains_of_any_length_settle(spark):
    order = list(range(1, 1000)) + [0]
    random.Random(1).shuffle(order)
    pairs = list(zip(order, order[1:])) + [(2000, 2001)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    out = grids.components(edges, spark.createDataFrame([(k,) for k in [*order, 2000, 2001, 3000]], "node long"))
    assert sorted(map(tuple, out.select("node", "component").collect())) == [(k, 0) for k in range(1000)] + [(2000, 2000), (2001, 2000), (3000, 3000)]


def test_suppliers_without_gaps_are_one_component(spark, tmp_path):
    import __spark_entry__ as entry

    balances = [50.0 * k for k in range(400)]
    random.Random(2).shuffle(balances)
    rows = list(enumerate(balances)) + [(400, -500.0), (401, None), (402, None)]
    spark.createDataFrame(rows, "s_suppkey long, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    got = entry.queries()["gr08_components"](spark, str(tmp_path)).select("node", "component").collect()
    assert sorted(map(tuple, got)) == [(k, 0) for k in range(400)] + [(k, k) for k in (400, 401, 402)]
