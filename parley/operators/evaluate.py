"""Classifier evaluation over {y, score}, y 0 or 1.

Everything that needs a global order first sums the rows to distinct scores, then deals these to
PARTS ranges of about equal counts: the one window without a key sees a row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges that distinct values are dealt to, a power of two.
PARTS = 1024


def score_counts(rows: DataFrame, digits: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """{score, pos, neg}: rows per distinct score, optionally on a grid of ``digits`` decimals."""
    score = F.col("score") if digits is None else F.round("score", digits)
    return rows.groupBy(*by, score.alias("score")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))


def confusion(rows: DataFrame, threshold: float) -> DataFrame:
    """One row: tp, fp, tn, fn, tpr, tnr, accuracy, balanced_accuracy, cost (3 per false alarm, 1 per miss); rates of an empty class are 0."""
    yes, pos = F.col("score") >= threshold, F.col("y") == 1
    c = rows.agg(F.count_if(yes & pos).alias("tp"), F.count_if(yes & ~pos).alias("fp"), F.count_if(~yes & ~pos).alias("tn"), F.count_if(~yes & pos).alias("fn"))
    return with_rates(c)


def with_rates(c: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    c = c.withColumns({"tpr": ratio("tp", "fn"), "tnr": ratio("tn", "fp"), "accuracy": F.coalesce(F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), F.lit(0.0))})
    return c.withColumns({"balanced_accuracy": (F.col("tpr") + F.col("tnr")) / 2, "cost": 3 * F.col("fp") + F.col("fn")})


def sensitivity(rows: DataFrame, threshold: float, delta: float = 0.05) -> DataFrame:
    """Balanced accuracy at the threshold and ``delta`` to either side, one pass over the rows."""
    cuts = F.array(*[F.lit(threshold + d) for d in (-delta, 0.0, delta)])
    each = rows.select("y", "score", F.explode(cuts).alias("threshold"))
    yes, pos = F.col("score") >= F.col("threshold"), F.col("y") == 1
    c = each.groupBy("threshold").agg(F.count_if(yes & pos).alias("tp"), F.count_if(yes & ~pos).alias("fp"), F.count_if(~yes & ~pos).alias("tn"), F.count_if(~yes & pos).alias("fn"))
    return with_rates(c).select("threshold", "balanced_accuracy")


def ranged(values: DataFrame, column: str, part: str = "part", parts: int = PARTS) -> DataFrame:
    """Adds ``part``, a whole number that never falls as the column rises, by cut points from approximate quantiles of its values.

    So ranges hold about equally many rows however the values crowd, and windows see one range at
    a time. The cut points are one row of ``parts`` - 1 numbers; each value finds its range by
    halving. NaN is above every number; infinite values are values.
    """
    cuts = values.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 16 * parts).alias("_cuts"))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(parts.bit_length() - 1))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.col("_cuts")[at + step - 1] <= F.col(column), at + step).otherwise(at))
    return values.crossJoin(F.broadcast(cuts)).withColumn(part, found).drop("_cuts")


def swept(rows: DataFrame) -> DataFrame:
    """{score, tp, fp, pos, neg, all_pos, all_neg, next_pos, next_neg, top}: counts at or above each distinct score, and those of the next lower score.

    Scores are summed by range, the few ranges get their prefix sums, and each range is
    ordered by itself; ``top`` marks the highest score. The next score of a range's last one is
    the highest of the next range.
    """
    c = ranged(score_counts(rows), "score")
    parts = c.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.max(F.struct("score", "pos", "neg")).alias("first"))
    down = W.orderBy(F.desc("part"))
    above, every = down.rowsBetween(W.unboundedPreceding, -1), down.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    parts = parts.select(
        "part", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"), F.sum("p").over(every).alias("all_pos"),
        F.sum("n").over(every).alias("all_neg"), F.lead("first").over(down).alias("then"), F.lag("part").over(down).isNull().alias("highest"),
    )
    order = W.partitionBy("part").orderBy(F.desc("score"))
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    c = c.select("*", F.sum("pos").over(upto).alias("p"), F.sum("neg").over(upto).alias("n"), F.lead(F.struct("score", "pos", "neg")).over(order).alias("next"), F.lag("score").over(order).isNull().alias("begins"))
    then = F.coalesce("next", "then")
    return c.join(parts, "part").select(
        "score", (F.col("p0") + F.col("p")).alias("tp"), (F.col("n0") + F.col("n")).alias("fp"), "pos", "neg", "all_pos", "all_neg",
        then["pos"].alias("next_pos"), then["neg"].alias("next_neg"), (F.col("begins") & F.col("highest")).alias("top"),
    )


def roc_curve(rows: DataFrame) -> DataFrame:
    """{fpr, tpr, threshold}: the curve's corners, from (0, 0) at a null threshold."""
    corner = F.col("top") | F.col("next_pos").isNull() | (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
    rate = lambda a, n: F.coalesce(F.try_divide(F.col(a), F.col(n)), F.lit(0.0))
    corners = swept(rows).filter(corner).select(rate("fp", "all_neg").alias("fpr"), rate("tp", "all_pos").alias("tpr"), F.col("score").alias("threshold"))
    origin = rows.sparkSession.range(1).select(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold"))
    return origin.union(corners)


def eer(rows: DataFrame) -> DataFrame:
    """{eer}: where misses and false alarms are nearest, the mean of the two."""
    gap = F.abs(1 - F.col("tpr") - F.col("fpr"))
    return roc_curve(rows).orderBy(gap, "fpr", "tpr").limit(1).select(((F.col("fpr") + 1 - F.col("tpr")) / 2).alias("eer"))


def auc_rank(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """{auc}: Mann-Whitney with ties counted half; 0.5 where a class is missing. Scores are ordered range by range, as in ``swept``."""
    c = ranged(score_counts(rows, by=by), "score")
    before = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    parts = c.groupBy(*by, "part").agg(F.sum("neg").alias("n")).withColumn("n0", F.coalesce(F.sum("n").over(before(*by).orderBy("part")), F.lit(0))).drop("n")
    c = c.withColumn("under", F.coalesce(F.sum("neg").over(before(*by, "part").orderBy("score")), F.lit(0))).join(parts, [*by, "part"])
    wins = F.sum(F.col("pos") * (F.col("n0") + F.col("under") + F.col("neg") / 2))
    return c.groupBy(*by).agg(F.coalesce(F.try_divide(wins, (F.sum("pos") * F.sum("neg")).cast("double")), F.lit(0.5)).alias("auc"))


def brier(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg(F.pow(F.col("score") - F.col("y"), 2)).alias("brier"))


def reliability_table(rows: DataFrame, n: int = 10) -> DataFrame:
    """{bin, n, mean_score, share}: n equal bins, the last one closed; empty bins show as 0."""
    binned = rows.groupBy(F.least(F.floor(F.col("score") * n), F.lit(n - 1)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg("y").alias("share"))
    return rows.sparkSession.range(n).withColumnRenamed("id", "bin").join(F.broadcast(binned), "bin", "left").fillna(0)


def ece(rows: DataFrame, n: int = 10) -> DataFrame:
    t = reliability_table(rows, n)
    return t.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("share"))) / F.sum("n"), F.lit(0.0)).alias("ece"))


def error_by_band(rows: DataFrame, threshold: float, bands: list[tuple[float, float]]) -> DataFrame:
    """{lo, hi, n, error}: share of wrong verdicts per duration band [lo, hi); empty bands show as 0."""
    table = rows.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for a, b in bands])))
    wrong = (F.col("score") >= threshold) != (F.col("y") == 1)
    own = F.lit(None).cast("double")
    for a, b in bands:
        own = F.when((F.col("duration_s") >= a) & (F.col("duration_s") < b), F.lit(float(a))).otherwise(own)
    counted = rows.select(own.alias("lo"), wrong.alias("wrong")).groupBy("lo").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("wrong").cast("double")).alias("error"))
    return table.join(F.broadcast(counted), "lo", "left").select("lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("error", F.lit(0.0)).alias("error"))


def select_threshold(rows: DataFrame, cost_fp: int = 3, cost_fn: int = 1) -> DataFrame:
    """{threshold, balanced_accuracy, cost}: best balanced accuracy, then least cost, then lowest threshold.

    Candidates are the distinct scores and a value just above the largest. Accuracies compare
    as exact fractions: tp * all_neg + tn * all_pos.
    """
    s = swept(rows)
    tn = F.col("all_neg") - F.col("fp")
    cand = s.select("score", "tp", "fp", "all_pos", "all_neg").union(s.groupBy("all_pos", "all_neg").agg((F.max("score") + 1e-9).alias("score")).select("score", F.lit(0).cast("long"), F.lit(0).cast("long"), "all_pos", "all_neg"))
    p, q = F.greatest("all_pos", F.lit(1)), F.greatest("all_neg", F.lit(1))
    cand = cand.withColumns({"exact": F.col("tp") * q + tn * p, "balanced_accuracy": (F.col("tp") / p + tn / q) / 2, "cost": cost_fp * F.col("fp") + cost_fn * (F.col("all_pos") - F.col("tp"))})
    best = cand.orderBy(F.desc("exact"), "cost", "score").limit(1)
    return best.select(F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("score"))).alias("threshold"), "balanced_accuracy", "cost")


def cross_check(a: DataFrame, b: DataFrame, tol: float = 0.01) -> DataFrame:
    """Two one-row frames {balanced_accuracy}: do they agree?"""
    d = F.abs(F.col("x") - F.col("y"))
    return a.select(F.col("balanced_accuracy").alias("x")).crossJoin(b.select(F.col("balanced_accuracy").alias("y"))).select("x", "y", d.alias("difference"), (d <= tol).alias("agrees"))


def top_importances(meta: DataFrame, k: int = 5) -> DataFrame:
    """The k most important features {feature, importance, sign} with the class they point to."""
    return meta.orderBy(F.desc("importance"), "feature").limit(k).select("feature", "importance", F.when(F.col("sign") > 0, "synthetic").otherwise("human").alias("points_to"))


def redteam_eval(rows: DataFrame) -> DataFrame:
    """{engine, n, hits, hit_rate} of {engine, expected, verdict}."""
    return rows.groupBy("engine").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("expected") == F.col("verdict")).alias("hits")).withColumn("hit_rate", F.col("hits") / F.col("n"))
