"""Training on Spark ML: boosted trees with early stopping, cross-validation, out-of-fold scores, A/B, audits."""

from __future__ import annotations

import tempfile
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators.calibrate import class_weight, packed, platt_apply, platt_fit, stratified_folds
from parley.operators.evaluate import auc_rank, brier, confusion, select_threshold
from parley.operators.trees import Ensemble, compiled

# Fixed settings of the two protocols.
BEHAVIOURAL = {"maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 15}
ACOUSTIC = BEHAVIOURAL | {"maxDepth": 3, "minInstancesPerNode": 10}
SEED = 20260912
FOLDS, SEEDS, ROUNDS, PATIENCE = 5, (SEED, SEED + 1, SEED + 2), 500, 50
SUSPICIOUS = 0.97


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut by a checkpoint: a plan over persisted rows would carry all that made them."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def train_gbt(rows: DataFrame, features: list[str], params: dict | None = None, rounds: int = ROUNDS, seed: int = SEED) -> PipelineModel:
    """Boosted trees of ``rounds`` rounds on {y, features..}; positives weigh as all negatives do.

    A fit makes several passes a round, so rows are packed first: its tasks follow the rows, not
    the partitions they come in. What a round draws follows the packed order: by call_id where
    there is one, else by the features.
    """
    weight = class_weight(rows).first()["weight"]
    order = [*(["call_id"] if "call_id" in rows.columns else []), "y", *features]
    data = packed(rows.select(*order), order[:1] if order[0] == "call_id" else order).sortWithinPartitions(*order)
    data = data.withColumns({"label": F.col("y").cast("double"), "weight": F.when(F.col("y") == 1, F.lit(float(weight))).otherwise(1.0)})
    gbt = GBTClassifier(labelCol="label", weightCol="weight", featuresCol="features", maxIter=rounds, seed=seed, **(params or BEHAVIOURAL))
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    return PipelineModel([assembler, gbt.fit(assembler.transform(data))])


def train_acoustic(rows: DataFrame, features: list[str], rounds: int = ROUNDS, seed: int = SEED) -> PipelineModel:
    return train_gbt(rows, features, ACOUSTIC, rounds, seed)


def staged_auc(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """{round, auc} for each key: of {y, steps}, where steps holds what each round adds to a row's score; all rounds in one pass.

    Each row becomes its prefix sums, one row a round, and the rounds are ranked side by side.
    """
    sums = F.aggregate("steps", F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("a")), lambda t, x: F.struct((t["s"] + x).alias("s"), F.array_append(t["a"], t["s"] + x).alias("a")))
    rounds = rows.select(*by, "y", F.posexplode(sums["a"]).alias("round", "score"))
    return auc_rank(rounds.withColumn("round", F.col("round") + 1), (*by, "round"))


def best_round(curve: DataFrame, by: tuple[str, ...] = (), patience: int = PATIENCE) -> DataFrame:
    """{best_round, best_auc, stopped} for each key of {round, auc}: training stops at the first round that is ``patience`` rounds after the best so far.

    Of equal values the first round is best. ``stopped`` is the round it stops at, or null if the rounds end before.
    """
    upto = W.partitionBy(*by).orderBy("round").rowsBetween(W.unboundedPreceding, W.currentRow)
    best = F.max(F.struct("auc", (-F.col("round")).alias("r"))).over(upto)
    told = curve.withColumn("best", best).withColumn("out", F.when(F.col("round") + F.col("best.r") >= patience, F.col("round")))
    told = told.withColumn("stop", F.min("out").over(W.partitionBy(*by)))
    kept = told.filter(F.col("stop").isNull() | (F.col("round") <= F.col("stop")))
    return kept.groupBy(*by).agg(F.max("best").alias("best"), F.max("stop").alias("stopped")).select(*by, (-F.col("best.r")).alias("best_round"), F.col("best.auc").alias("best_auc"), "stopped")


class Fit(NamedTuple):
    """Trees fitted until the patience ends, how many of them are best, and their AUC on the rows they were not fitted on."""

    trees: Ensemble
    best: int
    auc: float


def fit_early(train: DataFrame, valid: DataFrame, features: list[str], params: dict | None = None, rounds: int = ROUNDS, patience: int = PATIENCE, seed: int = SEED) -> Fit:
    """Boosted trees that stop early by AUC on ``valid``.

    Spark's trees can't be continued, but a longer fit with the same seed begins with the same
    trees; so fits of doubled length are made until one holds the round where patience ends.
    """
    n = min(2 * patience, rounds)
    while True:
        trees = compiled(train_gbt(train, features, params, n, seed))
        found = best_round(staged_auc(settled(valid.select("y", trees.staged().alias("steps")))), patience=patience).first()
        if found is None:  # nothing to validate on
            return Fit(trees, n, 0.5)
        if found["stopped"] is not None or n >= rounds:
            return Fit(trees, found["best_round"], found["best_auc"])
        n = min(2 * n, rounds)


def fold_fits(rows: DataFrame, features: list[str], k: int = FOLDS, seeds: tuple[int, ...] = SEEDS, params: dict | None = None, rounds: int = ROUNDS, patience: int = PATIENCE, parallel: int = 4, folds: DataFrame | None = None) -> dict[tuple[int, int], Fit]:
    """(seed, fold) -> the early-stopped fit on the other folds, ``parallel`` at a time; folds are those of ``dealt_folds``, given or made and kept here."""
    folds = kept_folds(rows, k, seeds) if folds is None else folds

    def one(at: tuple[int, int]) -> Fit:
        own = folds.filter(F.col("seed") == at[0])
        return fit_early(own.filter(F.col("fold") != at[1]), own.filter(F.col("fold") == at[1]), features, params, rounds, patience, at[0])

    jobs = [(s, f) for s in seeds for f in range(k)]
    with ThreadPool(parallel) as pool:
        return dict(zip(jobs, pool.map(inheritable_thread_target(rows.sparkSession)(one), jobs, chunksize=1), strict=True))


def dealt_folds(rows: DataFrame, k: int = FOLDS, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """``rows`` once for each seed, with seed and fold, each class dealt evenly in an order of its own."""
    out = None
    for seed in seeds:
        part = stratified_folds(rows.withColumn("label", F.col("y")), k, F.xxhash64(F.lit(seed), "call_id")).drop("label").withColumn("seed", F.lit(seed))
        out = part if out is None else out.unionByName(part)
    return out


def kept_folds(rows: DataFrame, k: int = FOLDS, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """``dealt_folds``, packed and computed once, so that fits side by side don't deal them again; ``rows`` are read twice."""
    return settled(packed(dealt_folds(rows, k, seeds), ["call_id"], rows.count() * len(seeds)))


def summed(trees: Ensemble) -> Column:
    """The log-odds from an array of what each tree adds: one sum of 500 trees takes over 2 GB of the driver to plan."""
    return F.aggregate(trees.staged(), F.lit(0.0), lambda total, step: total + step)


def oof_scores(rows: DataFrame, fits: dict[tuple[int, int], Fit], folds: DataFrame | None = None, parallel: int = 4) -> DataFrame:
    """{call_id, seed, fold, y, raw, score}: each row scored by the best rounds of the fit it took no part in, once per seed; ``folds`` as for the fits.

    Each fit scores its rows in a plan of its own, computed here: the trees of all fits in one plan outgrow the driver.
    """
    if folds is None:
        folds = kept_folds(rows, len({f for _, f in fits}), tuple(dict.fromkeys(s for s, _ in fits)))

    def one(at: tuple[int, int]) -> DataFrame:
        own = packed(folds.filter((F.col("seed") == at[0]) & (F.col("fold") == at[1])), ["call_id"])
        return settled(own.select("call_id", "seed", "fold", "y", summed(fits[at].trees.first(fits[at].best)).alias("raw")))

    with ThreadPool(parallel) as pool:
        parts = pool.map(inheritable_thread_target(folds.sparkSession)(one), list(fits), chunksize=1)
    return reduce(DataFrame.union, parts).withColumn("score", 1 / (1 + F.exp(-F.col("raw"))))


def fold_table(spark, fits: dict[tuple[int, int], Fit]) -> DataFrame:
    """{seed, fold, auc, best_round, rounds} of each fit."""
    rows = [(s, f, x.auc, x.best, len(x.trees.trees)) for (s, f), x in fits.items()]
    return spark.createDataFrame(rows, "seed long, fold int, auc double, best_round int, rounds int")


def cross_validate(folds: DataFrame) -> DataFrame:
    """{mean_auc, std_auc, best_rounds} over {auc, best_round} of the folds; best_rounds is the mean, rounded half to even, at least 1."""
    return folds.agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"), F.greatest(F.bround(F.avg("best_round"), 0).cast("int"), F.lit(1)).alias("best_rounds"))


def ab_variant(rows: DataFrame, features: list[str], folds: DataFrame | None = None, **protocol) -> DataFrame:
    """{cv_auc_mean, cv_auc_std, rounds, auc_val, ba_val, brier_val, threshold} of one set of features, calibrated on its own terms.

    Cross-validation on split train gives the rounds and out-of-fold scores; the final trees are
    fitted on all of it, Platt's curve on val, and the threshold chosen on the out-of-fold chances.
    ``folds`` are those of split train where they are made already.
    """
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    fits = fold_fits(train, features, folds=folds, **protocol)
    cv = cross_validate(fold_table(rows.sparkSession, fits)).first()
    trees = compiled(train_gbt(train, features, protocol.get("params"), cv["best_rounds"]))
    scored = settled(val.select("y", summed(trees).alias("score")))
    a, b = platt_fit(scored)
    oof = oof_scores(train, fits, folds).groupBy("call_id").agg(F.first("y").alias("y"), F.avg("raw").alias("raw")).select("y", platt_apply(F.col("raw"), a, b).alias("score"))
    threshold = select_threshold(settled(oof)).first()["threshold"]
    final = scored.select("y", platt_apply(F.col("score"), a, b).alias("score"))
    parts = auc_rank(final).select(F.col("auc").alias("auc_val")).crossJoin(confusion(final, threshold).select(F.col("balanced_accuracy").alias("ba_val"))).crossJoin(brier(final).select(F.col("brier").alias("brier_val"))).first()  # one row each
    told = {"cv_auc_mean": cv["mean_auc"], "cv_auc_std": cv["std_auc"], "rounds": cv["best_rounds"], **parts.asDict(), "threshold": threshold}
    return rows.sparkSession.range(1).select(*(F.lit(v).alias(n) for n, v in told.items()))


def ab_compare(rows: DataFrame, base: list[str], extra: list[str], **protocol) -> DataFrame:
    """``ab_variant`` of the base and of the extended features {variant, ..}, with the extended one's gains {delta_auc_val, delta_ba_val}, 0 for the base; both on the same folds."""
    rows = settled(packed(rows, ["call_id"]))
    folds = kept_folds(rows.filter("split = 'train'"), **{n: protocol[n] for n in ("k", "seeds") if n in protocol})

    def one(at: tuple[str, list[str]]) -> DataFrame:
        return ab_variant(rows, at[1], folds, **protocol).select(F.lit(at[0]).alias("variant"), "*")

    with ThreadPool(2) as pool:
        both = pool.map(inheritable_thread_target(rows.sparkSession)(one), [("base", base), ("extended", base + extra)], chunksize=1)
    return with_deltas(both[0].union(both[1]))


def with_deltas(variants: DataFrame) -> DataFrame:
    """{variant, auc_val, ba_val, ..} with what each variant gains over the one named base."""
    base = F.broadcast(variants.filter("variant = 'base'").select(F.col("auc_val").alias("_auc"), F.col("ba_val").alias("_ba")).limit(1))
    gain = variants.crossJoin(base)
    return gain.withColumns({"delta_auc_val": F.col("auc_val") - F.col("_auc"), "delta_ba_val": F.col("ba_val") - F.col("_ba")}).drop("_auc", "_ba")


def _leading(importances: DataFrame, top: int) -> DataFrame:
    """{top_features}: the names of the most important features {feature, importance}, joined by commas; '' if there are none."""
    first = importances.orderBy(F.desc("importance"), "feature").limit(top).agg(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("i"), "feature"))).alias("x"))
    return first.select(F.array_join(F.transform("x", lambda x: x["feature"]), ",").alias("top_features"))


def audit_gate(cv: DataFrame, importances: DataFrame, limit: float = SUSPICIOUS, acknowledged: bool = False, top: int = 5) -> DataFrame:
    """{mean_auc, suspicious, top_features, refused}: an accuracy too good to be true names the leading features and refuses the model until acknowledged.

    ``importances`` {feature, importance} has a row per feature; without suspicion top_features is ''.
    """
    suspicious = F.col("mean_auc") > limit
    named = F.when(suspicious, F.col("top_features")).otherwise("")
    return cv.crossJoin(_leading(importances, top)).select("mean_auc", suspicious.alias("suspicious"), named.alias("top_features"), (suspicious & F.lit(not acknowledged)).alias("refused"))


def validation_audit(val: DataFrame, duration: DataFrame, agreement: DataFrame, importances: DataFrame, limit: float = SUSPICIOUS, top: int = 5) -> DataFrame:
    """{auc, triggered, duration_auc, duration_r, f1_human, f1_synthetic, top_features}: evidence beside a validation AUC at or above ``limit``, null below.

    ``val`` {auc} and ``duration`` {auc, r} have one row; ``agreement`` {label, f1_caller} has one for each label.
    """
    told = agreement.agg(*(F.max(F.when(F.col("label") == x, F.col("f1_caller"))).alias(f"f1_{x}") for x in ("human", "synthetic")))
    rows = val.select("auc").crossJoin(duration.select(F.col("auc").alias("duration_auc"), F.col("r").alias("duration_r"))).crossJoin(told).crossJoin(_leading(importances, top))  # one row each
    triggered = F.col("auc") >= limit
    return rows.select("auc", triggered.alias("triggered"), *(F.when(triggered, F.col(c)).alias(c) for c in ("duration_auc", "duration_r", "f1_human", "f1_synthetic", "top_features")))


def cv_val_gap(cv: DataFrame, val: DataFrame, oof: DataFrame, held: DataFrame) -> DataFrame:
    """{gap, ba_gap}: cross-validated minus validation AUC ({auc}), and out-of-fold minus validation balanced accuracy ({balanced_accuracy} each)."""
    both = oof.select(F.col("balanced_accuracy").alias("a")).crossJoin(held.select(F.col("balanced_accuracy").alias("b")))
    return cv.crossJoin(val.select("auc")).crossJoin(both).select((F.col("mean_auc") - F.col("auc")).alias("gap"), (F.col("a") - F.col("b")).alias("ba_gap"))
