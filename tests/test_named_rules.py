import numpy as np
import pytest

from kinelake.operators import episode_rules, rules, tree_leaves  # noqa: F401
from kinelake.plans import q_named_rules as q

DATA = "/root/testdata/sf0.001"


def grasped_by_hand(frames, obj, need, most_slip):
    rigid = lambda m: np.array(m)
    last_hand, last_rel = None, None
    count = still = 0
    last_finger = None
    for f in frames[:-1]:
        hand, thing, finger = rigid(f["ee"]["right"]["pose"]), rigid(f["objects"][obj]["pose"]), f["robot"]["joints"]["joint_position"][0]
        if last_hand is None:
            last_hand, last_rel, last_finger = hand, np.linalg.inv(hand) @ thing, finger
        if count >= need:
            return True
        moved = np.linalg.norm((np.linalg.inv(last_hand) @ hand)[:3, 3])
        still = 0 if moved > 0.002 else still + 1
        rel = np.linalg.inv(hand) @ thing
        slip = np.linalg.norm((np.linalg.inv(last_rel) @ rel)[:3, 3])
        if still < 15 and slip < most_slip:
            count += abs(finger - last_finger) < 0.02
        else:
            count = 0
        last_hand, last_rel, last_finger = hand, rel, finger
    return False


def test_grasps_against_a_loop(spark):
    rows = q.episodes(spark, DATA).collect()
    for need, slip in ((0.04, 0.5), (0.1, 0.0015), (0.0, 0.1)):
        got = {r["user_id"]: r["g"] for r in q.episodes(spark, DATA).select("user_id", rules.REGISTRY["is_object_grasped_by_gripper"](objs=["absent", "a"], grasp_time_threshold=need, object_gripper_move_threshold=slip).alias("g")).collect()}
        assert got == {r["user_id"]: grasped_by_hand(r["frames"], "a", need * 30, slip) for r in rows}


def passing_by_hand(frames, order):
    state, at = 0, None
    for f in frames:
        o, p, r = f["objects"]["a"], np.array(f["grippers"]["left"]["xyz"]), np.array(f["grippers"]["right"]["xyz"])
        steps = p + np.linspace(0, 1, 4001)[:, None] * (r - p)
        across = ((steps >= np.array(o["low"]) - 1e-9) & (steps <= np.array(o["high"]) + 1e-9)).all(axis=1).any()
        first, second = (bool(across and f["joints"][w][0] < 0.3) for w in order)
        if state in (1, 2) and second and not first:
            state = 3
            at = f["tick"] if at is None else at
        else:
            state = 2 if first and second else 1 if first else 2 if second and state == 2 else 0
    return at


def test_handing_over_against_a_loop(spark):
    rows = q.runs(spark, DATA).collect()
    got = {r["user_id"]: (r["left_to_right"], r["right_to_left"]) for r in q.ad15_named_passing(spark, DATA).collect()}
    want = {r["user_id"]: tuple(passing_by_hand(r["frames"], o) for o in (("left", "right"), ("right", "left"))) for r in rows}
    assert got == want and any(v[0] is not None for v in want.values())


def test_unknown_names_raise():
    with pytest.raises(KeyError):
        rules.filter_chain([{"rule_name": "is_blue"}])
    with pytest.raises(ValueError):
        rules.named_leaf(rules.parse_tree({"IsBlue": "a"}))
    with pytest.raises(ValueError):
        rules.parse_task({"problem1": {}})


def test_missing_things_and_empty_episodes_fail(spark):
    some = q.episodes(spark, DATA)
    from pyspark.sql import functions as F

    empty = some.withColumn("frames", F.slice("frames", 1, 0))
    chain = [{"rule_name": "is_object_end_in_region", "params": {"objects": ["absent"], "region_center": [0, 0, 0], "region_size": [99, 99, 99]}, "result_code": 7}]
    assert {(r["valid"], r["result_code"]) for r in some.select(rules.filter_chain(chain).alias("r")).select("r.*").collect()} == {(False, 7)}
    higher = [{"rule_name": "is_object_end_higher_than_start", "params": {"objects": ["a"]}}]
    assert {tuple(r) for r in empty.select(rules.filter_chain(higher).alias("r")).select("r.valid", "r.result_code").collect()} == {(False, 1)}


def test_terminal_leaves_cancel(spark):
    frames = spark.createDataFrame([(1, [(i, float(i)) for i in range(1, 11)])], "user_id long, frames array<struct<tick: long, elapsed: double>>")
    run = lambda tree: tuple(rules.tree_outcomes(frames, rules.parse_tree(tree), rules.named_leaf, ["user_id"]).first()[1:])
    assert run({"ActionSetWaitAny": [{"ActionWaitForTime": "3"}, {"StepOut": "5"}]}) == (4, "done")
    assert run({"ActionSetWaitAny": [{"ActionWaitForTime": "6"}, {"StepOut": "5"}]}) == (None, "cancelled")
    assert run({"ActionList": [{"ActionWaitForTime": "2"}, {"ActionWaitForTime": "3"}]}) == (6, "done")
    assert run({"ActionList": [{"ActionWaitForTime": "2"}, {"ActionSetWaitAny": [{"ActionWaitForTime": "99"}, {"Timeout": "3"}]}]}) == (None, "cancelled")
    assert run({"ActionSetWaitSome_2": [{"ActionWaitForTime": "2"}, {"ActionWaitForTime": "4"}, {"ActionWaitForTime": "99"}]}) == (5, "done")
    assert run({"ActionSetWaitAll": [{"ActionWaitForTime": "2"}, {"ActionWaitForTime": "99"}]}) == (None, "open")
