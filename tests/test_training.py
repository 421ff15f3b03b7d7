"""Compiled trees, staged evaluation and early stopping, cross-validation, A/B, and global orders of crowded values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from parley.operators import calibrate, evaluate, events, features, gates, ml, timeline, trees


@pytest.fixture(scope="module")
def rows(spark):
    """y follows f but for every sixth row; g says nothing."""
    rng = random.Random(1)
    made = [(i, int((i % 10 > 4) != (i % 6 == 0)), float(i % 10) + rng.random() / 2, rng.random(), "val" if i % 7 == 0 else "train") for i in range(240)]
    return spark.createDataFrame(made, "call_id long, y int, f double, g double, split string").repartition(2).persist()


def brute_auc(pairs):
    pos, neg = [s for y, s in pairs if y == 1], [s for y, s in pairs if y != 1]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else 0.5


def brute_best(aucs, patience):
    """(best round, its value, round at which training stops)."""
    best = 0
    for r, a in enumerate(aucs):
        if a > aucs[best]:
            best = r
        if r - best >= patience:
            return best + 1, aucs[best], r + 1
    return best + 1, aucs[best], None


def test_compiled_trees_score_as_the_model(rows):
    model = ml.train_gbt(rows, ["f", "g"], rounds=6)
    own = trees.compiled(model)
    assert len(own.trees) == 6 and own.trees[0][0] == 1.0
    out = trees.score_model(model.transform(rows), own)
    got = out.select("raw", "p", "is_synthetic", "confidence", "probability").collect()
    for r in got:
        assert r["p"] == pytest.approx(float(r["probability"][1]), abs=1e-12) and r["is_synthetic"] == (r["p"] >= 0.5) and r["confidence"] == max(r["p"], 1 - r["p"])
    plan = trees.score_model(rows, own)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "UDF" not in plan and out.filter("(p >= 0.5) = (y = 1)").count() > 180
    # Prefixes of the staged steps are shorter ensembles; a longer fit begins with the same trees.
    steps = rows.select(own.staged().alias("s"), own.first(4).raw().alias("r")).collect()
    assert all(sum(x["s"][:4]) == pytest.approx(x["r"], abs=1e-12) for x in steps)
    assert trees.compiled(ml.train_gbt(rows, ["f", "g"], rounds=4)).trees == own.trees[:4]
    assert rows.select(trees.Ensemble(()).raw().alias("r")).filter("r = 0").count() == 240


def test_nested_trees_and_numbers(spark):
    nested = trees.Ensemble(((1.0, ("f", 0.5, ("g", -1e-9, 1e-7, 2.0), -3.25)), (0.5, 4.0)), scale=1.0)
    df = spark.createDataFrame([(0.5, -1.0), (0.5, 0.0), (0.6, 0.0), (None, 0.0)], "f double, g double")
    assert [r["raw"] for r in df.select(nested.raw().alias("raw")).collect()] == pytest.approx([2 + 1e-7, 4.0, -1.25, -1.25])
    assert dict(df.select(nested.raw().alias("raw")).dtypes)["raw"] == "double"


def test_staged_auc(spark):
    rng = random.Random(3)
    made = [(k % 3, int(rng.random() < 0.4), [rng.choice([-30.0, -1.0, 0.0, 0.5, 40.0]) for _ in range(12)]) for k in range(150)]
    made += [(9, 1, [1.0, 2.0])]
    got = {(r["k"], r["round"]): r["auc"] for r in ml.staged_auc(spark.createDataFrame(made, "k long, y int, steps array<double>"), ("k",)).collect()}
    want = {(k, n): brute_auc([(y, sum(s[:n])) for j, y, s in made if j == k]) for k in range(3) for n in range(1, 13)} | {(9, 1): 0.5, (9, 2): 0.5}
    assert got == pytest.approx(want)


def test_best_round(spark):
    rng = random.Random(4)
    curves = {k: [round(rng.random(), 1) for _ in range(rng.randrange(1, 30))] for k in range(60)} | {100: [0.1 * k for k in range(10)], 101: [1.0] + [0.5] * 20}
    df = spark.createDataFrame([(k, r + 1, a) for k, c in curves.items() for r, a in enumerate(c)], "k long, round int, auc double")
    for patience in (1, 5, 50):
        got = {r["k"]: (r["best_round"], r["best_auc"], r["stopped"]) for r in ml.best_round(df, ("k",), patience).collect()}
        assert got == {k: brute_best(c, patience) for k, c in curves.items()}


def test_early_stopping(rows):
    """A set that the first round separates stops a patience later; fits of doubled length end where one long fit ends."""
    clear = rows.withColumn("y", (F.col("f") > 5).cast("int"))
    fit = ml.fit_early(clear.filter("split = 'train'"), clear.filter("split = 'val'"), ["f", "g"], rounds=40, patience=3)
    assert (fit.best, fit.auc) == (1, 1.0) and len(fit.trees.trees) == 6
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    fit = ml.fit_early(train, val, ["g"], rounds=16, patience=4)
    whole = trees.compiled(ml.train_gbt(train, ["g"], rounds=16))
    aucs = [brute_auc([(r["y"], sum(r["s"][:n])) for r in val.select("y", whole.staged().alias("s")).collect()]) for n in range(1, 17)]
    assert (fit.best, pytest.approx(fit.auc)) == brute_best(aucs, 4)[:2]


def test_protocol(spark, rows):
    train, small = rows.filter("split = 'train'"), dict(k=3, seeds=(1, 2), rounds=6, patience=3)
    fits = ml.fold_fits(train, ["f", "g"], **small)
    assert set(fits) == {(s, f) for s in (1, 2) for f in range(3)}
    oof = ml.oof_scores(train, fits).collect()
    assert len(oof) == 2 * train.count() and {r["fold"] for r in oof} == {0, 1, 2}
    for (seed, fold), fit in fits.items():
        own = [(r["y"], r["score"]) for r in oof if (r["seed"], r["fold"]) == (seed, fold)]
        assert 1 <= fit.best <= 6 and brute_auc(own) == pytest.approx(fit.auc)  # no row is scored by trees that have seen it, and the best rounds score it
    cv = ml.cross_validate(ml.fold_table(spark, fits)).first()
    assert cv["mean_auc"] == pytest.approx(sum(x.auc for x in fits.values()) / 6) and cv["best_rounds"] == max(1, round(sum(x.best for x in fits.values()) / 6))
    assert cv["std_auc"] == pytest.approx(math.sqrt(sum((x.auc - cv["mean_auc"]) ** 2 for x in fits.values()) / 6))


def test_ab(rows):
    out = {r["variant"]: r for r in ml.ab_compare(rows, ["g"], ["f"], k=2, seeds=(1,), rounds=4, patience=2).collect()}
    base, more = out["base"], out["extended"]
    assert base["delta_auc_val"] == base["delta_ba_val"] == 0
    assert more["delta_auc_val"] == pytest.approx(more["auc_val"] - base["auc_val"]) and more["delta_auc_val"] > 0.2 and more["delta_ba_val"] > 0.1
    assert all(0 < r["threshold"] < 1 and 0 <= r["brier_val"] <= 1 and r["rounds"] >= 1 for r in (base, more))


def test_registered_ab_runs_the_whole_protocol(spark, sf_dir, monkeypatch):
    """Both sets of features: 5 folds by 3 seeds, up to 500 rounds, a patience of 50, and every train row in each fit."""
    from parley.plans import q_training

    calls, model = [], trees.Ensemble(((1.0, ("speech_balance", 0.5, -0.1, 0.1)),))

    def noted(train, valid, names, params, rounds, patience, seed):
        calls.append((len(names), seed, rounds, patience, train.count() + valid.count(), valid.count()))
        return ml.Fit(model, 1, 0.5)

    monkeypatch.setattr(ml, "fit_early", noted)
    assert q_training.ab_compare(spark, sf_dir).count() == 2
    n = q_training.training(spark, sf_dir).filter("split = 'train'").count()
    assert sorted(c[:5] for c in calls) == sorted((f, s, 500, 50, n) for f in (22, 23) for s in ml.SEEDS for _ in range(5)) and len(ml.SEEDS) == 3
    assert sum(c[5] for c in calls) == 2 * 3 * n


def test_fits_follow_their_rows_not_their_partitions(spark, rows):
    """The same rows in 2 or 30 partitions give the same trees, and passes over 30 partitions don't grow with the rounds."""
    for frame in (rows, rows.drop("call_id")):
        assert trees.compiled(ml.train_gbt(frame.repartition(2), ["f", "g"], rounds=3)) == trees.compiled(ml.train_gbt(frame.repartition(30), ["f", "g"], rounds=3))
    assert [calibrate.packed(spark.range(n).repartition(30)).rdd.getNumPartitions() for n in (0, 1, calibrate.PACK, 2 * calibrate.PACK + 1)] == [1, 1, 1, 3]

    def wide(name, run):
        spark.sparkContext.setJobGroup(name, name)
        run()
        spark.sparkContext.setJobGroup("rest", "rest")
        told = spark.sparkContext.statusTracker()
        stages = {s for j in told.getJobIdsForGroup(name) for s in told.getJobInfo(j).stageIds}
        return sum(1 for s in stages if told.getStageInfo(s) and told.getStageInfo(s).numCompletedTasks >= 30)

    many = rows.repartition(30).persist()
    assert many.count() == 240
    short, long = (wide(f"rounds {n}", lambda n=n: ml.train_gbt(many, ["f", "g"], rounds=n)) for n in (1, 4))
    assert short == long
    assert wide("platt", lambda: calibrate.platt_fit(many.select("y", F.col("f").alias("score")))) <= 6


def test_kept_folds(rows):
    """Given folds serve as those the fits deal themselves, and hold each row once a seed."""
    train, small = rows.filter("split = 'train'"), dict(k=2, seeds=(1, 2), rounds=2, patience=2)
    folds = ml.kept_folds(train, 2, (1, 2))
    fits = ml.fold_fits(train, ["f"], folds=folds, **small)
    assert fits == ml.fold_fits(train.repartition(7), ["f"], **small) and folds.count() == 2 * train.count()
    by = lambda df: sorted(tuple(r) for r in df.collect())
    assert by(ml.oof_scores(train, fits, folds)) == by(ml.oof_scores(train, fits))


def test_oof_scores_keep_fits_apart(rows):
    """Each row has the score of the fit it took no part in; no plan holds the trees of two fits."""
    train = rows.filter("split = 'train'")
    folds = ml.kept_folds(train, 2, (1, 2))
    fits = {(s, f): ml.Fit(trees.Ensemble(((1.0, ("f", 4.0 + s, 0.1 * s, 0.3 + f)), (0.5, ("g", 0.5, -1.0, 9.0)))), 1 + f, 0.5) for s in (1, 2) for f in range(2)}
    out = ml.oof_scores(train, fits, folds)
    assert "CASE" not in out._jdf.queryExecution().analyzed().toString()
    got = {(r["call_id"], r["seed"]): r["raw"] for r in out.collect()}
    step = lambda r, s, k: 2 * ((0.1 * s if r["f"] <= 4.0 + s else 0.3 + k) + (k and 0.5 * (-1.0 if r["g"] <= 0.5 else 9.0)))
    assert got == pytest.approx({(r["call_id"], r["seed"]): step(r, r["seed"], r["fold"]) for r in folds.collect()}) and len(got) == 2 * train.count()


def test_validation_audit(spark):
    val, duration = spark.createDataFrame([(0.97,)], "auc double"), spark.createDataFrame([(0.5, 0.1)], "auc double, r double")
    agreement = spark.createDataFrame([("human", 0.9), ("synthetic", 0.8)], "label string, f1_caller double")
    importances = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0)], "feature string, importance double")
    assert tuple(ml.validation_audit(val, duration, agreement, importances, top=2).first()) == (0.97, True, 0.5, 0.1, 0.9, 0.8, "b,c")
    assert tuple(ml.validation_audit(val.selectExpr("auc - 1e-9 AS auc"), duration, agreement, importances).first())[1:] == (False, None, None, None, None, None)
    assert ml.validation_audit(val, duration, agreement.limit(0), importances.limit(0)).first()["top_features"] == ""


@pytest.mark.parametrize("shift", [0.0, 0.123, -7e5])
def test_crowded_scores_fill_ranges_evenly(spark, shift):
    """A million distinct scores within 1e-4: no range holds over twice the median."""
    scores = spark.range(1_000_000).select((F.col("id") * 1e-10 + shift).alias("score"))
    n = sorted(r["count"] for r in evaluate.ranged(scores.distinct(), "score").groupBy("part").count().collect())
    assert n[-1] <= 2 * n[len(n) // 2] and len(n) > 900


def test_orders_of_awkward_scores(spark):
    """Infinite and NaN scores, ties over ranges, few values, none."""
    nan, inf = float("nan"), float("inf")
    made = [(k % 2, s) for k, s in enumerate([inf, -inf, nan, 0.0, -0.0, 1e300, -1e300, 5e-324, 0.5, 0.5, 0.5, 2.0, nan, -3.0])]
    df = spark.createDataFrame(made, "y int, score double")
    place = lambda s: 1e308 * 10 if s == inf else s
    order = lambda s: (s != s, 0 if s != s else place(s))
    pos, neg = [order(s) for y, s in made if y], [order(s) for y, s in made if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert evaluate.auc_rank(df).first()["auc"] == pytest.approx(want)
    parts = evaluate.ranged(df, "score", parts=4).collect()
    assert all(a["part"] <= b["part"] for a in parts for b in parts if order(a["score"]) < order(b["score"]))
    ranks = {r["score"]: r["rank"] for r in gates.average_rank(df.filter("NOT isnan(score)"), "score").collect()}
    values = sorted(s for _, s in made if s == s)
    assert ranks == {s: (2 * values.index(s) + values.count(s) + 1) / 2 for s in values}
    assert evaluate.roc_curve(df.limit(0)).count() == 1 and evaluate.auc_rank(df.limit(0)).first()["auc"] == 0.5


def test_timeline_is_the_features_of_each_truncated_call(spark, sf_dir):
    """17 by 23 values, each call cut by itself and extracted alone; the served confidence is the last point."""
    from parley.plans.q_training import MODEL
    from parley.plans.views import view

    turns, calls = view(spark, sf_dir, "turns").persist(), view(spark, sf_dir, "calls").persist()
    got = {(r["call_id"], r["i"]): r for r in timeline.features_at(turns, events.timeline_cuts(calls)).collect()}
    assert len(got) == 17 * calls.count()
    for i in (1, 8, 17):
        at = calls.select("call_id", (F.col("dur") if i == 17 else F.col("dur") * i / 17).alias("t"))
        part = turns.join(at, "call_id").filter("s < t").withColumn("e", F.least("e", "t")).drop("t")
        for r in features.extract_features(part, at.withColumnRenamed("t", "dur")).collect():
            assert [got[r["call_id"], i][n] for n in features.CONTRACT] == pytest.approx([r[n] for n in features.CONTRACT])
    served = calls.filter("call_id % 2 = 0").select("call_id", F.lit(0.75).alias("confidence"))
    rows = timeline.confidence_timeline(turns, calls, MODEL, points=4, served=served).collect()
    assert sorted({r["i"] for r in rows}) == [1, 2, 3, 4, 5] and len(rows) == 5 * calls.count()
    assert all((r["confidence"] == 0.75) for r in rows if r["i"] == 5 and r["call_id"] % 2 == 0) and all(0.5 <= r["confidence"] <= 1 for r in rows)
