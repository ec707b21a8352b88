import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinelake.llm import bpe, lookalike, mixing, nearest, tokens


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(bpe.vocabulary_file())


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_file())
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_every_token_encodes_to_itself(enc):
    assert enc.v.sound.all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_ids_of_any_text(enc, reference, texts):
    assert [list(x) for x in enc.encode(texts)] == reference(texts)


def test_ids_of_hard_words(enc, reference):
    rng = random.Random(5)
    vocabulary = sorted(enc.v.ids)
    texts = ["a" * 3000, " " * 999, "ab" * 1500, "<|endoftext|>", "​﻿\xa0 x", "\x1c\x1d\x85", "", "é" * 50]
    for _ in range(3000):
        try:
            texts.append(b"".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 6))).decode())
        except UnicodeDecodeError:
            pass
    assert [list(x) for x in enc.encode(texts)] == reference(texts)
    assert enc.exact_words > 0


def test_compatible_pairs_are_those_that_stay(enc):
    import numpy as np

    rng = random.Random(1)
    ids = [rng.randrange(50_256) for _ in range(4000)]
    a, b = np.array(ids[:2000]), np.array(ids[2000:])
    spelled = {i: t for t, i in enc.v.ids.items()}
    want = [enc.exact(spelled[x] + spelled[y]) != [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert enc.v.crossing(a, b).tolist() == want


def test_corpus(spark, enc):
    rows = [(1, "Pick up the cup.", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (4, "  ", "x"), (5, "word " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sorted(((r["doc_id"], list(r["ids"])) for r in tokens.encode_corpus(df).collect()))
    assert out == sorted((i, list(enc.encode([t])[0])) for i, t, _ in rows)
    assert dict(out)[2] == [] and dict(out)[3] == [] and dict(out)[4] != []
    assert tokens.encode_corpus(df.limit(0)).count() == 0


# nearest

H = "hand_id long, robot_id string, joint_name string, ts_seconds long, ts_nanos int, at string"
R = "reading_id long, robot_id string, joint_name string, ts_seconds long, ts_nanos int, joint_position double, r_at string"


def split(ns):
    return (None, None) if ns is None else divmod(ns, 10**9)


def brute(hands, readings, tol=40_000_000):
    out = set()
    for i, r, j, s, n, _ in hands:
        best = None
        for k, r2, j2, s2, n2, p, _ in readings:
            if None in (s, n, s2, n2, p, r, j) or p != p or (r, j) != (r2, j2):
                continue
            gap = abs(s * 10**9 + n - s2 * 10**9 - n2)
            if gap <= tol and (best is None or (gap, k) < best):
                best = (gap, k)
        if best:
            out.add((i, best[1]))
    return out


def test_nearest_against_brute_force(spark):
    rng = random.Random(2)
    base = 1_700_000_000 * 10**9
    hands = [(i, rng.choice(["a", "b", None]), rng.choice(["g", "h"]), *split(rng.choice([None] + [base + rng.randrange(3 * 10**9)] * 9)), "clash") for i in range(150)]
    hands += [(200, "a", "g", *split(base), "c"), (201, "a", "g", *split(base + 500_000_000), "c"), (201, "a", "g", *split(base + 500_000_000), "c")]
    readings = [(i, rng.choice(["a", "b", None]), rng.choice(["g", "h"]), *split(rng.choice([None] + [base + rng.randrange(3 * 10**9)] * 9)), rng.choice([1.0, 1.0, None, float("nan")]), "clash") for i in range(300)]
    readings += [(400, "a", "g", *split(base - 40_000_000), 1.0, "c"), (401, "a", "g", *split(base + 540_000_001), 1.0, "c"), (403, "a", "g", *split(base + 499_999_990), 1.0, "c"), (402, "a", "g", *split(base + 500_000_010), 1.0, "c"), (404, "a", "g", *split(base + 499_999_990), 1.0, "c")]
    h, r = spark.createDataFrame(hands, H), spark.createDataFrame(readings, R)
    got = [tuple(x) for x in nearest.nearest_readings(h, r).collect()]
    assert set(got) == brute(hands, readings) and (201, 402) in got
    assert nearest.nearest_readings(h.limit(0), r).count() == 0 and nearest.nearest_readings(h, r.limit(0)).count() == 0


def test_a_message_delivered_often_is_one_candidate(spark):
    h = spark.range(2000).selectExpr("id as hand_id", "'a' as robot_id", "'g' as joint_name", "1L as ts_seconds", "5 as ts_nanos")
    r = spark.range(2000).selectExpr("id + 7 as reading_id", "'a' as robot_id", "'g' as joint_name", "1L as ts_seconds", "9 as ts_nanos", "1D as joint_position")
    out = nearest.nearest_readings(h, r)
    assert out.count() == 2000 and out.select("reading_id").distinct().collect()[0][0] == 7


# mixing


def test_budgets():
    plan = mixing.budgets({"a": 1000, "b": 100, "c": 0}, {"a": (0.5, 1), "b": (0.25, 4), "c": (0.25, 2)})
    assert plan == {"a": (0, pytest.approx(800)), "b": (4, 0.0)}
    assert mixing.budgets({}, {"a": (1.0, 1)}) == {} and mixing.budgets({"a": 5}, {"a": (1.0, 2)}, total=3)["a"] == (0, 3.0)


def test_mix_shares(spark):
    rng = random.Random(3)
    rows = [(i, "word " * rng.randint(5, 40), "hot" if i % 3 else "b") for i in range(3000)] + [(10_000 + i, "tiny text", "small") for i in range(60)]
    rows += [(20_000, None, "hot"), (20_001, "", "b"), (20_002, "unlisted", "z"), (20_003, "none", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("nothing", "n_tokens")
    goals = spark.createDataFrame([("hot", 0.6, 1), ("b", 0.39, 2), ("small", 0.01, 3), ("absent", 0.2, 1), ("null", None, 1), ("b", 0.1, 1)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mix_documents(docs, goals)
    m = mix.toPandas()
    limit = {"hot": 1, "b": 2, "small": 3}
    assert m.doc_id.is_unique and all(r.n_uses <= limit[r.source] for r in m.itertuples()) and not set(m.doc_id) & {20_000, 20_001, 20_002, 20_003}
    s = {r["source"]: r for r in shares.collect()}
    assert set(s) == {"hot", "b", "small", "absent"} and s["absent"]["actual_share"] == 0
    total = sum(r["tokens_used"] for r in s.values())
    for name, share in (("hot", 0.6), ("b", 0.39), ("small", 0.01)):
        assert abs(s[name]["tokens_used"] - share * total) <= 60
    assert s["small"]["tokens_used"] == 3 * s["small"]["tokens_available"]
    again = mixing.mix_documents(docs.repartition(7), goals)[0].toPandas()
    assert sorted(map(tuple, again.values.tolist())) == sorted(map(tuple, m.values.tolist()))
    assert mixing.mix_documents(docs.limit(0), goals)[0].count() == 0


# look-alikes

SAME = [
    ("Pick up", "Рick uр"), ("café", "café"), ("８．５ mm", "8.5 mm"), ("a b", "a b"), ("a b", "a　b"), ("a b", "a b"), ("word", "wo​rd"), ("word", "wo­⁠rd﻿"), ("ёж", "ёж"), ("x\r\ny", "x\ny"), ("x y", "x\ny"), ("Ｈｉ", "Hi"), ("a  ", "a"), ("Zoo", "Ζοο"),
]
OTHER = [("Pick", "pick"), ("café", "cafe"), ("12", "13"), ("a b", "ab"), ("O", "0"), ("l", "1"), ("x²", "x2"), ("й", "и"), ("a.b", "a,b"), ("I", "l"), ("one two", "one")]


@pytest.mark.parametrize("a, b", SAME)
def test_same_look(a, b):
    assert lookalike.skeleton(a) == lookalike.skeleton(b)


@pytest.mark.parametrize("a, b", OTHER)
def test_other_look(a, b):
    assert lookalike.skeleton(a) != lookalike.skeleton(b)


@given(st.text(max_size=50))
def test_skeletons_are_stable(text):
    s = lookalike.skeleton(text)
    assert lookalike.skeleton(s) == s and lookalike.skeleton(lookalike.consistent_form(text)) == s


def test_pairs_against_brute_force(spark):
    texts = [t for p in SAME + OTHER for t in p] + [None, "", "  ", "\u200b", "Pick up", "Pick up"]
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, look int")
    got = [tuple(r) for r in lookalike.same_look_pairs(df).collect()]
    want = {(a, b) for (a, s, _), (b, t, _) in itertools.combinations(rows, 2) if s and t and s != t and lookalike.skeleton(s) and lookalike.skeleton(s) == lookalike.skeleton(t)}
    assert set(got) == want and len(got) == len(want)
    assert lookalike.same_look_pairs(df.limit(0)).count() == 0
    forms = {r["doc_id"]: r["form"] for r in lookalike.consistent_texts(df).collect()}
    assert forms[0] == forms[1] == "Pick up" and forms[len(SAME + OTHER) * 2] is None


def test_many_copies_of_one_text(spark):
    df = spark.range(1500).selectExpr("id as doc_id", "if(id = 0, 'Рick', 'Pick') as text")
    assert lookalike.same_look_pairs(df).count() == 1499


@pytest.mark.parametrize("a, b", [("Ⅳ", "IV"), ("ﬁne", "fine"), ("wait…", "wait..."), ("1⁄2", "1/2"), ("a∶b", "a:b"), ("υp", "up"), ("oո", "on"), ("ɡo", "go"), ("ꓐⲞ", "BO"), ("⼀", "一"), ("µm", "μm"), ("ǆ", "dž")])
def test_same_look_of_other_kinds(a, b):
    assert lookalike.skeleton(a) == lookalike.skeleton(b)


@pytest.mark.parametrize("a, b", [("ı", "i"), ("α", "a"), ("к", "k"), ("т", "t"), ("м", "m"), ("ѡ", "w"), ("η", "n"), ("ι", "i"), ("ſ", "s"), ("x₂", "x2"), ("①", "1"), ("½", "1/2"), ("–", "-"), ("“a”", '"a"'), ("ᴀ", "A"), ("µ", "u")])
def test_other_look_of_other_kinds(a, b):
    assert lookalike.skeleton(a) != lookalike.skeleton(b)


def test_classes_of_texts_that_look_the_same(spark):
    rows = [(5, "Pick"), (3, "Рick"), (9, "Pick"), (4, "pick"), (7, None), (8, " ")]
    got = {tuple(r) for r in lookalike.same_look_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 3, 2), (3, 3, 2), (9, 3, 2), (4, 4, 1)}


def test_a_document_delivered_often_is_mixed_like_its_copies(spark):
    docs = spark.createDataFrame([(1, "a", "one two three")] * 500 + [(2, "b", "one two three")] * 100, "doc_id long, source string, text string")
    goals = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mix_documents(docs, goals)
    m = mix.groupBy("source", "n_uses").count().collect()
    assert {tuple(r) for r in m} == {("a", 1, 200), ("b", 2, 100)}
    assert {r["source"]: (r["n_documents"], r["actual_share"]) for r in shares.collect()} == {"a": (500, 0.5), "b": (100, 0.5)}
