"""Data-quality gates, drift between two sources, agreement and parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators.evaluate import auc_rank, ranged
from parley.operators.features import features_long
from parley.operators.intervals import overlap_join
from parley.operators.vad import shared_cells


def gate_class_balance(calls: DataFrame) -> DataFrame:
    """{split, human, synthetic, majority_share, unbalanced, reweight}."""
    c = calls.groupBy("split").agg(F.count_if(F.col("label") == "human").alias("human"), F.count_if(F.col("label") == "synthetic").alias("synthetic"))
    share = F.greatest("human", "synthetic") / (F.col("human") + F.col("synthetic"))
    return c.select("*", share.alias("majority_share"), (share > 0.60).alias("unbalanced"), ((F.col("split") == "train") & (share >= 0.55)).alias("reweight"))


def gate_overlap_density(turns: DataFrame, calls: DataFrame) -> DataFrame:
    """{label, n, share, median_events, sparse}: calls with an overlap, over all (null label) and per label."""
    counted = overlap_join(turns).groupBy("call_id").agg(F.count(F.lit(1)).alias("events"))
    rows = calls.select("call_id", "label").join(counted, "call_id", "left").select("label", F.coalesce("events", F.lit(0)).alias("events"))
    out = rows.rollup("label").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("events") > 0).cast("double")).alias("share"), F.median("events").alias("median_events"))
    return out.withColumn("sparse", F.col("share") < 0.40)


def gate_duration_leak(calls: DataFrame) -> DataFrame:
    """{mean_human, mean_synthetic, r, auc, best_auc, banned}: does the duration alone tell the label?"""
    y = (F.col("label") == "synthetic").cast("int")
    rows = calls.select(y.alias("y"), F.col("duration_s").alias("score"))
    means = rows.agg(F.avg(F.when(F.col("y") == 0, F.col("score"))).alias("mean_human"), F.avg(F.when(F.col("y") == 1, F.col("score"))).alias("mean_synthetic"), F.corr("y", "score").alias("r"))
    best = F.greatest(F.col("auc"), 1 - F.col("auc"))
    return means.crossJoin(auc_rank(rows)).withColumns({"best_auc": best, "banned": best >= 0.60})


def duration_histogram(calls: DataFrame, bins: int = 20) -> DataFrame:
    """{label, bin, n} over equal bins between the least and the greatest duration."""
    ends = calls.agg(F.min("duration_s").alias("lo"), F.max("duration_s").alias("hi"))
    place = F.least(F.floor((F.col("duration_s") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return calls.crossJoin(F.broadcast(ends)).groupBy("label", F.coalesce(place, F.lit(0)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def average_rank(rows: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """{by.., column, rank}: the averaged rank of each distinct value; ties meet before the window.

    Values are numbered range by range, so no task orders all values of a group. Nulls have no rank.
    """
    c = ranged(rows.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n")), column, "_part")
    before = lambda n, *keys: F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy(n).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = c.groupBy(*by, "_part").agg(F.sum("_n").alias("_n")).select(*by, "_part", before("_part", *by).alias("_base"))
    c = c.withColumn("_before", before(column, *by, "_part")).join(parts, [*by, "_part"])
    return c.select(*by, column, (F.col("_base") + F.col("_before") + (F.col("_n") + 1) / 2).alias("rank"))


def spearman(rows: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """{by.., rho}: rank correlation, NaN or null where one side is constant."""
    a, b = (average_rank(rows, c, by).withColumnRenamed("rank", f"_r{c}") for c in (x, y))
    return rows.join(a, [*by, x]).join(b, [*by, y]).groupBy(*by).agg(F.corr(f"_r{x}", f"_r{y}").alias("rho"))


def direction_signs(features: DataFrame, labels: DataFrame) -> DataFrame:
    """{feature, rho, sign}: +1 where a feature rises with y or stays constant, else -1."""
    rows = features_long(features).join(labels.select("call_id", F.col("y").cast("double").alias("y")), "call_id")
    spread = rows.groupBy("feature").agg((F.max("value") == F.min("value")).alias("constant"))
    out = spearman(rows, "value", "y", ("feature",)).join(spread, "feature", "right")
    rho = F.when(F.isnan("rho"), None).otherwise(F.col("rho"))
    return out.select("feature", rho.alias("rho"), F.when(F.col("constant") | (rho >= 0), 1).otherwise(-1).alias("sign"))


def feature_stats(features: DataFrame) -> DataFrame:
    """{feature, mean, std}."""
    return features_long(features).groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def skew_report(a: DataFrame, b: DataFrame, floor: float = 0.7) -> DataFrame:
    """{feature, mean_abs_diff, rho, flagged}: two feature tables of the same calls; flagged below ``floor`` or undefined."""
    rows = features_long(a).withColumnRenamed("value", "x").join(features_long(b).select("call_id", "feature", F.col("value").alias("y")), ["call_id", "feature"])
    diff = rows.groupBy("feature").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_abs_diff"))
    rho = F.when(F.isnan("rho"), None).otherwise(F.col("rho"))
    return diff.join(spearman(rows, "x", "y", ("feature",)), "feature", "left").select("feature", "mean_abs_diff", rho.alias("rho"), (rho.isNull() | (rho < floor)).alias("flagged"))


def frame_agreement(pred: DataFrame, gold: DataFrame, calls: DataFrame, frame_ms: int = 10) -> DataFrame:
    """{call_id, channel, precision, recall, f1} of 10 ms frames that the turns of either side cover."""

    length = calls.select("call_id", F.bround(F.col("dur") * 1000 / frame_ms).cast("long").alias("n"))

    def cells(turns: DataFrame) -> DataFrame:
        at = lambda x: F.floor(F.col(x) * 1000 / frame_ms)
        return turns.join(length, "call_id").select("call_id", "channel", at("s").alias("a"), F.least(at("e"), F.col("n")).alias("z")).filter("a < z")

    c = shared_cells(cells(pred), cells(gold), ("call_id", "channel"))
    ratio = lambda n: F.coalesce(F.try_divide(F.col("n_both"), F.col(n)), F.lit(0.0))
    return c.select("call_id", "channel", ratio("n_pred").alias("precision"), ratio("n_gold").alias("recall"), F.coalesce(F.try_divide(2 * F.col("n_both"), F.col("n_pred") + F.col("n_gold")), F.lit(0.0)).alias("f1"))


def _turn_ratio(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """{call_id, ratio}: turns found for each true turn."""
    n = gold.groupBy("call_id").agg(F.count(F.lit(1)).alias("g")).join(pred.groupBy("call_id").agg(F.count(F.lit(1)).alias("p")), "call_id", "left")
    return n.select("call_id", (F.coalesce("p", F.lit(0)) / F.greatest(F.lit(1), F.col("g"))).alias("ratio"))


def _medians() -> list[Column]:
    return [F.median(F.when(F.col("channel") == c, F.col("f1"))).alias(name) for c, name in ((0, "f1_caller"), (1, "f1_agent"))]


def agreement_summary(agreement: DataFrame, pred: DataFrame, gold: DataFrame) -> DataFrame:
    """{f1_caller, f1_agent, turn_ratio, passed}: medians over calls."""
    both = agreement.agg(*_medians()).crossJoin(_turn_ratio(pred, gold).agg(F.median("ratio").alias("turn_ratio")))
    return both.withColumn("passed", (F.col("f1_caller") >= 0.85) & (F.col("f1_agent") >= 0.85) & F.col("turn_ratio").between(0.8, 1.2))


def agreement_by_label(agreement: DataFrame, pred: DataFrame, gold: DataFrame, labels: DataFrame) -> DataFrame:
    """{label, f1_caller, f1_agent, turn_ratio}: the same medians for each label of {call_id, label}."""
    ratio = _turn_ratio(pred, gold).join(labels, "call_id").groupBy("label").agg(F.median("ratio").alias("turn_ratio"))
    return agreement.join(labels, "call_id").groupBy("label").agg(*_medians()).join(ratio, "label")


def parity_report(a: DataFrame, golden: DataFrame, tol: float = 1e-6) -> DataFrame:
    """{feature, max_abs_error, passed}."""
    rows = features_long(a).join(features_long(golden).select("call_id", "feature", F.col("value").alias("want")), ["call_id", "feature"])
    return rows.groupBy("feature").agg(F.max(F.abs(F.col("value") - F.col("want"))).alias("max_abs_error")).withColumn("passed", F.col("max_abs_error") <= tol)
