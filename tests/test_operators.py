import json
import math
import random
import struct

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinelake.functions import geom as g
from kinelake.functions import text as tx
from kinelake.operators import folds, grids, nested, rules, scoring, timeseries, vectors
from kinelake.sources import readers, sinks

# nested records

SCENE = {
    "layout": {"a": {"xyz": [1, 2, 3], "tags": ["t1", "t2", "t1"], "parts": [{"id": "b", "xyz": "1 2 3", "tags": "['t3', 't4']", "parts": {"c": {"xyz": {"x": 1, "y": 2, "z": 3}, "tags": "t5"}}}]}, "d": {"tags": None}},
    "relations": {"graph": {"directed": "False", "links": [{"source": "z", "target": "a"}, ["a", "z"]], "nodes": [{"id": "a"}]}},
    "scene_id": "s",
}
LINKS = {("layout", "s", "a"), ("layout", "a", "b"), ("layout", "b", "c"), ("layout", "s", "d"), ("tag", "a", "t1"), ("tag", "a", "t2"), ("tag", "b", "t3"), ("tag", "b", "t4"), ("tag", "c", "t5"), ("graph", "a", "z")}


def links(text, scene_id="s"):
    kinds = {"object": "layout", "tag": "tag", "link": "graph"}
    return {(kinds[r["kind"]], r["parent_id"], r["node_id"]) for r in nested.record_rows(1, scene_id, text) if r["kind"] in kinds}


def test_variants_of_one_scene():
    text = json.dumps(SCENE)
    for t in (text, json.dumps(text), json.dumps({"scene_info": SCENE}), json.dumps({"scene_info": text}), json.dumps([SCENE])):
        assert links(t) == LINKS
    other = json.loads(text)
    other["layout"] = [{"object_id": k, **v} for k, v in other["layout"].items()]
    other["relations"]["graph"]["edges"] = other["relations"]["graph"].pop("links")
    other["relations"]["graph"]["directed"] = 0
    assert links(json.dumps(other)) == LINKS


@pytest.mark.parametrize("directed, want", [(True, ("z", "a")), (None, ("z", "a")), ("true", ("z", "a")), (1, ("z", "a")), (False, ("a", "z")), ("false", ("a", "z")), (0, ("a", "z"))])
def test_direction(directed, want):
    assert links(json.dumps({"relations": {"graph": {"directed": directed, "links": [["z", "a"]]}}})) == {("graph", *want)}


@pytest.mark.parametrize("text", [None, "", "  ", '{"layout": {"a": {"xyz"', "12", "null", "[]", '"x"', "[" * 100_000])
def test_text_without_a_scene(text):
    assert links(text) == set() and [r["kind"] for r in nested.record_rows(1, "s", text)] == ["unparsed"]


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.floats() | st.text(max_size=5), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["layout", "parts", "tags", "xyz", "id", "relations", "graph", "links", "nodes", "a"]), c, max_size=4), max_leaves=12))
def test_any_json_is_survived(value):
    list(nested.record_rows(1, None, json.dumps(value)))
    nested.state_of(value)


def test_scene_tables(spark):
    df = spark.createDataFrame([(1, "s", json.dumps(SCENE), "clash"), (2, None, None, "clash")], "scene_uid long, scene_id string, scene_info string, kind string")
    t = nested.scene_tables(df)
    assert {(r["link_kind"], r["parent_id"], r["child_id"]) for r in nested.scene_links(df).collect()} == LINKS
    assert t["objects"].count() == 4 and t["unparsed"].count() == 1
    assert [t[f"objects_{v}"].count() for v in nested.XYZ_VARIANTS] == [1, 1, 1, 0, 1]
    assert {tuple(r) for r in t["objects_vector_text_3"].select("x", "y", "z").collect()} == {(1.0, 2.0, 3.0)}
    assert nested.scene_links(df.limit(0)).count() == 0


# geometry: properties over random poses


def test_geometry_properties(spark):
    rng = np.random.default_rng(4)
    rows = [tuple(float(x) for x in rng.normal(size=14)) for _ in range(60)]
    names = ["aw", "ax", "ay", "az", "bw", "bx", "by", "bz", "px", "py", "pz", "vx", "vy", "vz"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    c = F.col
    a, b = (g.q_normalize([c(p + k) for k in "wxyz"]) for p in "ab")
    p, v = [c("p" + k) for k in "xyz"], [c("v" + k) for k in "xyz"]
    pose = (g.q_matrix(a), p)
    same = g.pose_compose(pose, g.pose_inverse(pose))
    back = g.matrix_q(g.q_matrix(a))
    checks = {
        "unit": g.dot(a, a) - 1,
        "slerp_unit": g.dot(g.q_slerp(a, b, 0.37), g.q_slerp(a, b, 0.37)) - 1,
        "slerp_start": g.q_angle(g.q_slerp(a, b, 0.0), a),
        "slerp_end": g.q_angle(g.q_slerp(a, b, 1.0), b),
        "inverse": g.norm(same[1]) + g.m_angle(same[0], g.q_matrix((F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)))) / 1e6,
        "rotate": g.distance(g.q_rotate(a, v), g.m_apply(g.q_matrix(a), v)),
        "matrix": g.q_angle(back, a) / 1e3,
        "length": g.norm(g.q_rotate(a, v)) - g.norm(v),
        "product": g.distance(g.m_apply(g.q_matrix(g.q_multiply(a, b)), v), g.m_apply(g.m_multiply(g.q_matrix(a), g.q_matrix(b)), v)),
    }
    out = df.select(*[F.max(F.abs(x)).alias(n) for n, x in checks.items()]).first().asDict()
    assert {n: v for n, v in out.items() if v > 1e-5} == {}


def test_shapes(spark):
    one = spark.range(1)
    get = lambda x: one.select(x.alias("x")).first()[0]
    box = ((0.0, 0.0, 0.0), (1.0, 1.0, 1.0))
    pt = lambda *v: [F.lit(float(x)) for x in v]
    assert get(g.segment_hits_box(pt(-1, 0.5, 0.5), pt(2, 0.5, 0.5), *box)) and not get(g.segment_hits_box(pt(-1, 2, 0.5), pt(2, 2, 0.5), *box))
    assert get(g.rectangles_separate(g.rectangle_corners(0, 0, 2, 2, 45), g.rectangle_corners(3, 0, 2, 2, 0))) and not get(g.rectangles_separate(g.rectangle_corners(0, 0, 2, 2, 45), g.rectangle_corners(1.5, 0, 2, 2, 0)))
    assert get(g.in_polygon(0.5, 0.5, [(0, 0), (2, 0), (0, 2)])) and not get(g.in_polygon(1.5, 1.5, [(0, 0), (2, 0), (0, 2)]))
    assert get(g.piecewise(F.lit(3.0), [0, 2, 4], [1.0, 2.0])) == 4.0
    with pytest.raises(ValueError):
        g.axis_vector("w")


# series


def test_as_of_against_brute_force(spark):
    rng = random.Random(6)
    left = [(k, rng.randrange(60), i) for i, k in enumerate("ab" * 40)]
    right = [(k, t, t * 10) for k in "ab" for t in rng.sample(range(60), 12)]
    a, b = spark.createDataFrame(left, "k string, at long, id long"), spark.createDataFrame(right, "k string, at long, v long")
    for way in ("backward", "forward", "nearest"):
        got = {r["id"]: r["v"] for r in timeseries.as_of(a, b, ["k"], "at", ["v"], way).collect()}
        for k, t, i in left:
            c = [(abs(t - t2), t2, v) for k2, t2, v in right if k2 == k and (way == "nearest" or (t2 <= t if way == "backward" else t2 >= t))]
            assert got[i] == (min(c)[2] if c else None)


def test_fill_runs_segments(spark):
    df = spark.createDataFrame([(1, i, v, s) for i, (v, s) in enumerate([(None, "a"), (1.0, "a"), (None, None), (None, None), (3.0, "b"), (None, "a")])], "k int, i int, v double, s string")
    assert [r[0] for r in df.select(timeseries.fill_next_then_last("v", ["k"], ["i"]), "i").orderBy("i").collect()] == [1.0, 1.0, 3.0, 3.0, 3.0, 3.0]
    assert [r["run"] for r in timeseries.run_length(df, F.col("v").isNull(), ["k"], ["i"]).orderBy("i").collect()] == [1, 0, 1, 2, 0, 1]
    assert [r["segment"] for r in timeseries.segments(df, ["s"], ["k"], ["i"]).orderBy("i").collect()] == [1, 1, 2, 2, 3, 4]


# scores and rules


def test_greedy_match_drains(spark):
    df = spark.createDataFrame([(["a", "b"], ["x", "a", "b"]), (["b", "a"], ["a", "b"]), (["q", "a"], ["a"]), ([], ["a"]), (["a"], [])], "s array<string>, p array<string>")
    assert [list(r[0]) for r in df.select(scoring.greedy_match(F.col("s"), F.col("p"))).collect()] == [[True, True], [True, False], [False, False], [], [False]]


def test_rule_trees(spark):
    def leaf(node):
        return lambda f: f["x"] == node.args[0]

    frames = spark.createDataFrame([(1, i, x) for i, x in enumerate("abcab")] + [(2, 0, "b"), (2, 1, "a")], "e int, tick int, x string")

    def ends(tree, **kw):
        return {r["e"]: (r["satisfied_at"], r["outcome"]) for r in rules.evaluate_tree(frames, rules.parse_tree(tree), leaf, "e", "tick", ["x"], **kw).collect()}

    assert ends({"ActionList": [{"Is": "b"}, {"Is": "a"}]}) == {1: (3, "done"), 2: (1, "done")}
    assert ends({"ActionList": [{"Is": "b"}, {"Is": "a"}]}, timeout=2) == {1: (None, "timeout"), 2: (1, "done")}
    assert ends({"ActionSetWaitAny": [{"Is": "c"}, {"Is": "b"}]}) == {1: (1, "done"), 2: (0, "done")}
    assert ends({"ActionSetWaitAll": [{"Is": "c"}, {"Is": "b"}]}) == {1: (2, "done"), 2: (None, "open")}
    assert ends({"ActionSetWaitSome_2": [{"Is": "c"}, {"Is": "b"}, {"Is": "a"}]}) == {1: (1, "done"), 2: (1, "done")}
    tree = rules.parse_tree({"ActionList": [{"A": "x|[1,2]"}, {"ActionSetWaitAny": [{"B": ""}]}]})
    assert [n[0] for n in rules.flatten(tree)] == ["0", "0.0", "0.1", "0.1.0"] and rules.some_count("ActionSetWaitSome_x") == 1
    with pytest.raises(ValueError):
        rules.parse_tree({"a": 1, "b": 2})


def test_filter_chain(spark):
    known = {"above": lambda n: F.col("x") > n}
    chain = [{"rule_name": "above", "params": {"n": 1}, "result_code": 5}, {"rule_name": "above", "params": {"n": 3}}]
    df = spark.createDataFrame([(0,), (2,), (4,), (None,)], "x int")
    assert [r["r"]["result_code"] for r in df.select(rules.filter_chain(chain, known).alias("r")).collect()] == [5, 1, 0, 5]
    with pytest.raises(KeyError):
        rules.filter_chain([{"rule_name": "unknown"}], known)


# text


def test_text_functions(spark):
    df = spark.createDataFrame([("A: b",), ("it is (c) : D",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.choice_letter(F.col("t"))).collect()] == ["b", "d", None, None]
    one = spark.createDataFrame([('x {"a": 1} y', "Is 3.5 it?\n(Yes.)", [1, 2, 9, 3, 9, 4], "a <image> b")], "j string, n string, k array<int>, i string")
    r = one.select(tx.first_json(F.col("j")), tx.normalize_answer(F.col("n")), tx.mask_before(F.col("k"), [9]), tx.parse_actions(tx.action_text(F.array(*map(F.lit, [1, 2, 0])))), tx.move_tag_first(F.col("i"))).first()
    assert r[0] == '{"a": 1}' and "3.5" in r[1] and list(r[2]) == [-100] * 5 + [4] and list(r[3]) == [1, 2, 0] and r[4].startswith("<image>\n")


# folds and grids


def test_paths():
    free = np.ones((6, 6), bool)
    free[2, :5] = False
    path = folds.shortest_path(free, (0, 0), (0, 5))
    assert path[0] == (0, 0) and path[-1] == (0, 5) and (5, 2) in path and folds.shortest_path(~free, (0, 0), (1, 1)) == []
    tight = folds.pull_string(free, path)
    assert len(tight) < len(path) and all(folds.in_sight(free, a, b) for a, b in zip(tight, tight[1:]))
    assert folds.nearest_free(free, (0, 2)) in {(0, 1), (0, 3)} and folds.wall_distance(free)[0, 0] == 1
    assert folds.follow_actions(np.array([[0, 0], [1, 0]]), 0.25) == [1, 1, 1, 1, 0]
    assert folds.simplify_path(np.array([[0, 0], [1, 0], [2, 0], [2, 2]]), 0.5, 10) == [0, 2, 3]
    assert folds.warp_distance(np.array([[0.0, 0], [1, 0], [1, 0]]), np.array([[0.0, 0], [1, 0]])) == 0
    assert folds.grasp_ticks(np.array([0, 0, 1, 2, 3.0]), np.full(5, 0.05)) == 4


@given(st.lists(st.tuples(st.floats(-9, 9), st.floats(-9, 9)), max_size=25))
def test_samples(points):
    x = np.array(points).reshape(-1, 2)
    kept = folds.spaced_sample(x, 2.0)
    assert all(np.linalg.norm(x[i] - x[j]) >= 2 for i in kept for j in kept if i < j)
    assert all(any(np.linalg.norm(x[i] - x[j]) < 2 for j in kept if j <= i) for i in range(len(x)) if i not in kept)
    assert sorted(folds.nearest_order(x)) == list(range(len(x))) and len(set(folds.farthest_points(x, 4))) <= 4


def test_components_of_a_chain(spark):
    edges = spark.range(99).selectExpr("id as src", "id + 1 as dst")
    out = grids.components(edges, spark.range(102).selectExpr("id as node"))
    assert {r["component"]: r["n"] for r in out.groupBy("component").agg(F.count("*").alias("n")).collect()} == {0: 100, 100: 1, 101: 1}


def test_density_clusters(spark):
    pts = [(i, i * 0.1, 0.0) for i in range(10)] + [(20 + i, 9 + i * 0.1, 5.0) for i in range(10)] + [(99, 50.0, 50.0)]
    out = {r["k"]: r["cluster"] for r in grids.density_clusters(spark.createDataFrame(pts, "k long, x double, y double"), "k", ["x", "y"], 0.5, 3).collect()}
    assert {out[i] for i in range(10)} == {0} and {out[20 + i] for i in range(10)} == {20} and out[99] is None


def test_vector_search(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 6)).astype("float32")
    x[7] = 0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(80, None)], "id long, e array<float>")
    got = vectors.top_k(df.where("id < 5"), df, "id", "e", 3).collect()
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    for q in range(5):
        want = sorted(range(80), key=lambda i: (-round(float(u[q].astype(float) @ u[i].astype(float)), 6), i))[:3]
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank_no"]) if r["query_id"] == q] == want
    hits = vectors.search_assets(df.withColumnRenamed("id", "asset_id").withColumnRenamed("e", "embedding"), "80", x[3].tolist(), 2).collect()
    assert [r["asset_id"] for r in hits] == [80, 3]


# sources and sinks


def test_readers(spark, tmp_path):
    (tmp_path / "s.csv").write_text("noise\nname,score,label\npick,0.5,grasp,x\nbad line\npour, 1.0 ,pour\n0.25,grasp\nnan,zz\n")
    assert sorted((r["score"], r["label"]) for r in readers.read_dirty_scores(spark, str(tmp_path / "s.csv")).collect()) == [(0.25, "grasp"), (0.5, "grasp"), (1.0, "pour")]
    pts = pd.DataFrame({"x": [1.0, 2], "y": [3.0, 4], "z": [5.0, 6], "red": [1, 2], "green": [3, 4], "blue": [5, 6]})
    (tmp_path / "a.ply").write_bytes(readers.write_ply(pts))
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n7 8 9\n")
    (tmp_path / "c.ply").write_text("not one")
    assert sorted(tuple(r)[1:5] for r in readers.read_ply(spark, str(tmp_path / "*.ply")).collect()) == [(1.0, 3.0, 5.0, 1), (2.0, 4.0, 6.0, 2), (7.0, 8.0, 9.0, None)]
    (tmp_path / "cameras.txt").write_text("# c\n1 PINHOLE 640 480 500 501 320 240\n")
    (tmp_path / "cameras.bin").write_bytes(struct.pack("<QiiQQ4d", 2, 1, 1, 640, 480, 500, 501, 320, 240))
    text, binary = readers.read_colmap_cameras_text(spark, str(tmp_path / "cameras.txt")).first(), readers.read_colmap_cameras_binary(spark, str(tmp_path / "cameras.bin")).collect()
    assert len(binary) == 1 and tuple(text) == tuple(binary[0])
    (tmp_path / "images.txt").write_text("# c\n1 1 0 0 0 1 2 3 1 a.jpg\n10 20 -1 30 40 5\n")
    assert readers.read_colmap_images_text(spark, str(tmp_path / "images.txt")).select("image_id", "tz", "name").collect()[0][:] == (1, 3.0, "a.jpg")
    (tmp_path / "points3D.txt").write_text("# c\n9 1 2 3 10 20 30 0.5 1 2\n")
    assert readers.read_colmap_points_text(spark, str(tmp_path / "points3D.txt")).first()[:] == (1.0, 2.0, 3.0, 10, 20, 30, 0.5)
    (tmp_path / "t.json").write_text(json.dumps({"camera_angle_x": 0.6, "frames": [{"file_path": "f", "transform_matrix": [[1, 2, 3, 4]] * 4}]}))
    assert list(readers.read_transforms(spark, str(tmp_path / "t.json")).first()["matrix"][0]) == [1.0, -2.0, -3.0, 4.0]
    (tmp_path / "b.out").write_text("# Bundle\n1 1\n" + "0 0 0\n" * 5 + "1 2 3\n9 8 7\n2 0 1 2 3\n")
    assert readers.read_bundle(spark, str(tmp_path / "b.out")).first()[:] == (0, 1.0, 2.0, 3.0, 9, 8, 7, 2) and readers.read_bundle(spark, str(tmp_path / "b.out"), 0).count() == 0


def test_json_and_folders(spark, tmp_path):
    (tmp_path / "1").mkdir()
    (tmp_path / "x").mkdir()
    (tmp_path / "1" / "evaluate_ret_1.json").write_text('{\n"a": 1}')
    (tmp_path / "x" / "evaluate_ret_2.json").write_text('{"a": ')
    docs = readers.read_json_documents(spark, str(tmp_path), "a int", "evaluate_ret_*.json").collect()
    assert {r["a"] for r in docs} == {1, None} and sum(r["_corrupt_record"] is not None for r in docs) == 1
    assert [r["folder_no"] for r in readers.read_numbered_folders(spark, str(tmp_path)).collect()] == [1]
    rows = spark.range(10).withColumnRenamed("id", "k")
    assert [readers.sample_rows(rows, s, "k").count() for s in ("all", "first:3", "end:25%", "random:4")] == [10, 3, 3, 4]
    with pytest.raises(ValueError):
        readers.sample_rows(rows, "some:1", "k")


def test_image_headers(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480)
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 480, 640) + b"\x03"
    assert readers.image_header(png) == ("png", 640, 480) and readers.image_header(jpg) == ("jpeg", 640, 480)
    assert readers.image_header(b"") is None and readers.image_header(b"\xff\xd8\xff") is None
    df = readers.with_image_header(spark.createDataFrame([(png,), (None,)], "b binary"), "b")
    assert [r["header"]["width"] for r in df.collect()] == [640, None]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, n int, v string")
    assert sorted(map(tuple, sinks.keep_last(df, ["k"], ["n"]).collect())) == [("a", 2, "y"), ("b", 1, "z")]
    new = spark.createDataFrame([("a", 9, "q"), ("c", 1, "n"), ("b", 1, "other")], "k string, n int, v string")
    assert sorted(map(tuple, sinks.sync_store(df.where("n = 1"), new, "k", "n").collect())) == [("a", 9, "q"), ("b", 1, "z"), ("c", 1, "n")]
    sinks.append_json_lines(df, str(tmp_path / "j"))
    sinks.append_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 6
    assert sinks.merge_shards([df, df.drop("v")]).where("v is null").count() == 3
    assert sinks.next_free_number(spark.createDataFrame([("r_07.json",), ("q",)], "f string"), "f", "r") == 8
    assert math.isclose(sinks.newest_rows(df, ["k"], ["n"], 1).count(), 2)


def test_sight_keeps_corners_and_costs():
    free = np.ones((5, 5), bool)
    free[1, 2] = free[2, 1] = False
    assert not folds.in_sight(free, (1, 1), (2, 2))  # between two blocked corners
    free[2, 1] = True
    assert not folds.in_sight(free, (1, 1), (2, 2)) and folds.in_sight(free, (0, 3), (4, 3)) and not folds.in_sight(free, (0, 0), (9, 0))
    cost = np.zeros((5, 5))
    cost[3, 2] = 0.8
    assert folds.in_sight(free, (0, 3), (4, 3), cost, 0.9) and not folds.in_sight(free, (0, 3), (4, 3), cost, 0.5)


def test_chains_layouts_assignments():
    assert folds.compress_chains([("a", "b"), ("b", "c"), ("c", "d"), ("c", "e"), ("b", "a")]) == [("a", "c", 2), ("c", "d", 1), ("c", "e", 1)]
    assert folds.compress_chains([("x", "y"), ("y", "z"), ("z", "x")]) == [("x", "x", 3)] and folds.compress_chains([]) == []
    assert folds.compress_chains([("h", "a"), ("a", "b"), ("b", "h"), ("h", "q")]) == [("h", "h", 3), ("h", "q", 1)]
    spots = folds.place_rectangles([(1, 1), (2, 1), (9, 9)], (4, 4), 0.1, 3)
    assert spots[2] is None and spots == folds.place_rectangles([(1, 1), (2, 1), (9, 9)], (4, 4), 0.1, 3)
    (x, y), (u, v) = spots[:2]
    assert x >= u + 2.1 or u >= x + 1.1 or y >= v + 1.1 or v >= y + 1.1
    assert folds.assign_shapes([{1, 2}, {1}], [1, 2]) == [2, 1] and folds.assign_shapes([{1}, {1}], [1, 2]) is None and folds.assign_shapes([], []) == []


def test_deep_fields_are_survived():
    for deep in ("[" * 900 + "]" * 900, '{"a":' * 900 + "1" + "}" * 900):
        rows = list(nested.record_rows(1, "s", '{"layout": {"a": {"tags": ["t"], "xyz": %s}}}' % deep))
        assert {r["kind"] for r in rows} in ({"object", "tag"}, {"unparsed"})


def test_things_without_an_id_are_kept_apart():
    rows = list(nested.record_rows(1, "s", json.dumps({"layout": [{"xyz": [1, 2, 3, 4], "tags": ["t"], "parts": [{"id": "p"}]}, {"id": "q", "xyz": [1, 2, 3, 4]}]})))
    assert {(r["kind"], r["parent_id"], r["node_id"], r["variant"]) for r in rows} == {("unnamed", "s", "#0", "vector_array_4"), ("unnamed", "#0", "t", "text_array"), ("unnamed", "#0", "p", "none"), ("object", "s", "q", "vector_array_4")}


def test_objects_are_the_union_of_their_subtypes(spark):
    from kinelake.session import table

    t = nested.scene_tables(table(spark, "/root/testdata/sf0.001", "scene_records"))
    key = ["scene_uid", "parent_id", "node_id"]
    parts = [r[:] for v in nested.SUBTYPES for r in t[f"objects_{v}"].select(*key).collect()]
    assert sorted(parts) == sorted(r[:] for r in t["objects"].select(*key).collect()) and parts
