"""The features on literal dialogues, and intervals against loops."""

import random

import pytest
from pyspark.sql import functions as F

from parley.operators import intervals as iv
from parley.operators.features import CONTRACT, assert_contract, extract_features

# Literal cases: caller turns, agent turns, duration, the 23 values.
CASES = {
    "dialogue_1": ([(2.5, 4), (6.3, 7), (9.4, 11)], [(0, 2), (4, 6), (7, 9)], 11.0, "0.4 0.4 0.08164965809 0.2041241452 1 0.3 0 0 0 0 0 0 0 1.266666667 0.4027681991 0.317974894 0.3333333333 0 0.3454545455 0.6333333333 0 0 3"),
    "dialogue_2": ([(2.0, 2.3), (5.2, 5.4), (10.6, 12.0), (12.3, 13.0)], [(0, 5), (8.5, 10)], 13.0, "0.4 0.4 0.2 0.5 0 0.2 1 4.615384615 0.3 1 2.9 0 1 0.65 0.4716990566 0.7256908563 0.75 4.615384615 0.2 0.4 5.2 0 4"),
    "dialogue_3": ([(0.2, 3.0)], [(0, 1)], 3.3, "0 0 0 0 0 0 1 18.18181818 0.8 1 0 0 0 2.8 0 0 0 0 0.8484848485 2.8 0 0 1"),
    "fragment": ([(126.32, 129.14), (129.46, 131.26)], [], 140.0, "0 0 0 0 0 0 0 0 0 0 0 0 0 2.31 0.51 0.2207792208 0 0.4285714286 0.033 0 126.32 0 2"),
    "no_caller": ([], [(0, 5), (6, 9)], 10.0, " ".join("0" * 23)),
    "one_each": ([(3, 5)], [(0, 2)], 6.0, "1 1 0 0 1 1 0 0 0 0 0 0 0 2 0 0 0 0 0.3333333333 1 0 0 1"),
    "full_overlap": ([(0, 10)], [(0, 10)], 10.0, "0 0 0 0 0 0 1 6 10 0 0 0 0 10 0 0 0 0 1 1 0 0 1"),
    "empty": ([], [], 10.0, " ".join("0" * 23)),
    "zero_duration": ([(0, 0.5)], [(0.5, 1)], 0.0, "0 0 0 0 0 0 0 0 0 0 0 0 0 0.5 0 0 1 0 0 1 0 0 1"),
}


def test_literal_vectors(spark):
    turns, calls = [], []
    for name, (caller, agent, dur, _) in CASES.items():
        rows = sorted([(float(s), float(e), 0) for s, e in caller] + [(float(s), float(e), 1) for s, e in agent])
        turns += [(name, i, c, s, e) for i, (s, e, c) in enumerate(rows)]
        calls.append((name, dur))
    out = extract_features(spark.createDataFrame(turns, "call_id string, turn_id int, channel int, s double, e double"), spark.createDataFrame(calls, "call_id string, dur double"))
    assert_contract(out)
    got = {r["call_id"]: [r[c] for c in CONTRACT] for r in out.collect()}
    for name, case in CASES.items():
        assert got[name] == pytest.approx([float(x) for x in case[3].split()], abs=1e-8), name


def test_intervals_against_loops(spark):
    rng = random.Random(3)
    rows = [(c, i, rng.randrange(2), s, s + rng.randrange(1, 9)) for c in range(30) for i, s in enumerate(sorted(float(rng.randrange(60)) for _ in range(12)))]
    t = spark.createDataFrame(rows, "call_id int, turn_id int, channel int, s double, e double")
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] == 1 and b[2] == 0 and a[3] < b[4] and b[3] < a[4])
    for bins in (None, 4.0):
        assert sorted(map(tuple, iv.overlap_join(t, bins).select("call_id", "ai", "ci").collect())) == want
    points = t.filter("channel = 1").select("call_id", F.col("e").alias("t"), "turn_id")
    for inclusive in (True, False):
        want = sorted((a[0], a[1], min(x)) for a in rows if a[2] == 1 if (x := [b[3] for b in rows if b[0] == a[0] and b[2] == 0 and (b[3] >= a[4] if inclusive else b[3] > a[4])]))
        assert sorted(map(tuple, iv.next_start_asof(points, t.filter("channel = 0"), inclusive).select("call_id", "turn_id", "nt").collect())) == want


def test_orders_of_scores(spark):
    """All scores distinct, all equal, and scores beyond 0..1: as by brute force."""
    import random

    from parley.operators.calibrate import stratified_folds
    from parley.operators.evaluate import auc_rank, roc_curve

    rng = random.Random(1)
    for score in (rng.random, lambda: 0.5, lambda: rng.choice([-3.25, 0.0, 0.1, 7.0]), lambda: round(rng.random(), 2)):
        rows = [(k, rng.randrange(2), float(score())) for k in range(300)]
        df = spark.createDataFrame(rows, "call_id long, y int, score double").repartition(3)
        pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
        want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
        assert abs(auc_rank(df).first()["auc"] - want) < 1e-9
        curve = sorted((r["fpr"], r["tpr"]) for r in roc_curve(df).collect())
        assert curve[0] == (0.0, 0.0) and curve[-1] == (1.0, 1.0)
        assert abs(sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:])) - want) < 1e-9
        folds = stratified_folds(df.withColumn("label", df["y"].cast("string")), 5).collect()
        for label in "01":
            n = [sum(r["label"] == label and r["fold"] == f for r in folds) for f in range(5)]
            assert max(n) - min(n) <= 1 and sum(n) == sum(y == int(label) for _, y, _ in rows)
