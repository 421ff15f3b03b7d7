"""Calibration, fusion and folds."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators.evaluate import auc_rank

EDGE = 1e-6
#: Rows of a partition of what a fit passes over many times.
PACK = 1 << 14


def packed(rows: DataFrame, by: list[str] | None = None, n: int | None = None) -> DataFrame:
    """``rows`` in partitions of about PACK rows, dealt by the columns ``by`` or evenly; ``n`` is their number where it is known, else they are counted.

    An iterative fit starts its tasks anew in every pass, so many small partitions cost more than what is in them.
    """
    parts = max(1, -(-(rows.count() if n is None else n) // PACK))
    return rows.repartition(parts, *(by or []))


def platt_fit(rows: DataFrame) -> tuple[float, float]:
    """(a, b) of P = 1 / (1 + exp(a * score + b)) for {y, score}, with targets short of 0 and 1.

    Each row enters twice, as label 1 with its target's weight and as label 0 with the rest.
    """
    n = rows.agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") != 1).alias("n")).first()
    t = F.when(F.col("y") == 1, (n["p"] + 1) / (n["p"] + 2)).otherwise(1 / (n["n"] + 2))
    both = rows.select("score", F.inline(F.array(F.struct(F.lit(1.0).alias("label"), t.alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - t).alias("weight")))))
    both = packed(both, n=2 * (n["p"] + n["n"]))
    model = LogisticRegression(weightCol="weight", regParam=0.0, standardization=False, tol=1e-12, maxIter=200).fit(VectorAssembler(inputCols=["score"], outputCol="features").transform(both))
    return -float(model.coefficients[0]), -float(model.intercept)


def platt_apply(score: Column, a: float | Column, b: float | Column) -> Column:
    return 1 / (1 + F.exp(a * score + b))


def isotonic_fit(rows: DataFrame):
    """A monotone calibration of {y, score}, for comparison."""
    return IsotonicRegression(labelCol="label", featuresCol="score").fit(rows.select(F.col("y").cast("double").alias("label"), "score"))


def class_weight(rows: DataFrame) -> DataFrame:
    """{weight}: negatives per positive of the training rows {y}, 1 without positives."""
    return rows.agg(F.coalesce(F.try_divide(F.count_if(F.col("y") != 1), F.count_if(F.col("y") == 1)), F.lit(1.0)).alias("weight"))


def stratified_folds(rows: DataFrame, k: int = 5, order: Column | None = None) -> DataFrame:
    """Adds fold 0..k-1, each class dealt out evenly in the order of ``order`` (a whole number; a hash of call_id by default). Rows without a label go."""
    rows = rows.withColumn("_order", F.xxhash64("call_id") if order is None else order.cast("long"))
    # No task sees a whole class: rows are counted in stretches of the order, then numbered within each.
    rows = rows.withColumn("_part", F.when(F.abs("_order") < 1 << 20, F.shiftright("_order", 8)).otherwise(F.shiftright("_order", 50) + F.signum("_order").cast("long") * (1 << 20)))
    upto = W.partitionBy("label").orderBy("_low").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("label", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_order").alias("_low")).withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    number = F.col("_before") + F.row_number().over(W.partitionBy("label", "_part").orderBy("_order", "call_id")) - 1
    return rows.join(parts.select("label", "_part", "_before"), ["label", "_part"]).withColumn("fold", number % k).select(*[c for c in rows.columns if c[0] != "_"], "fold")


def oof_average(predictions: DataFrame) -> DataFrame:
    """{call_id, score}: mean of the held-out predictions over the seeds."""
    return predictions.groupBy("call_id").agg(F.avg("score").alias("score"))


def fuse_probability(p: Column, evidence: Column, w: Column | float, max_delta: float = 1.0) -> Column:
    """p moved on the logit scale by w * (evidence - 0.5), at most ``max_delta`` and within 0..1."""
    c = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p))
    fused = 1 / (1 + F.exp(-(F.ln(c / (1 - c)) + w * (evidence - 0.5))))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(p - max_delta, F.least(p + max_delta, fused))))


def _at(rows: DataFrame, p: Column, threshold: float, *by: str) -> DataFrame:
    yes, pos = p >= threshold, F.col("y") == 1
    total = lambda c: F.count_if(c)
    c = rows.groupBy(*by).agg(total(yes & pos).alias("tp"), total(~yes & ~pos).alias("tn"), total(pos).alias("n_pos"), total(~pos).alias("n_neg"))
    a, b = F.greatest("n_pos", F.lit(1)), F.greatest("n_neg", F.lit(1))
    return c.select(*by, (F.col("tp") * b + F.col("tn") * a).alias("exact"), ((F.col("tp") / a + F.col("tn") / b) / 2).alias("balanced_accuracy"))


def select_w(rows: DataFrame, threshold: float, low: int = -80, high: int = 80, max_delta: float = 1.0) -> DataFrame:
    """{w, balanced_accuracy}: the best weight of ``low``/20 .. ``high``/20 for {y, p, invention}; the most negative wins ties.

    The fused value never turns back as w grows, so each distinct (y, p, invention) changes sides
    at one step at most. That step is solved for, checked against its neighbours by the value
    itself, and the changes of each step are summed; the grid only sees prefix sums over its
    steps, however many rows there are.
    """
    rows = rows.groupBy("y", "p", "invention").agg(F.count(F.lit(1)).alias("n"))
    yes = lambda k: fuse_probability(F.col("p"), F.col("invention"), k / F.lit(20.0), max_delta) >= threshold
    p = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), F.col("p")))
    t = min(max(threshold, EDGE), 1 - EDGE)
    at = F.try_divide(20 * (math.log(t / (1 - t)) - F.ln(p / (1 - p))), F.col("invention") - 0.5)
    rows = rows.withColumns({"first": yes(F.lit(low)), "last": yes(F.lit(high)), "near": F.ceil(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), at))).cast("int")})
    turned = lambda k: yes(k) == F.col("last")
    flip = F.when(turned(F.col("near") - 1), F.col("near") - 1).when(turned(F.col("near")), F.col("near")).otherwise(F.col("near") + 1)
    begin = F.struct(F.lit(low).alias("k"), F.when(F.col("first"), F.col("n")).otherwise(0).alias("more"), F.col("n").alias("all"))
    change = F.struct(F.greatest(F.lit(low + 1), F.least(F.lit(high), flip)).alias("k"), F.when(F.col("last"), F.col("n")).otherwise(-F.col("n")).alias("more"), F.lit(0).cast("long").alias("all"))
    moves = rows.select("y", F.inline(F.when(F.col("first") == F.col("last"), F.array(begin)).otherwise(F.array(begin, change))))
    pos = F.col("y") == 1
    total = lambda c, of: F.sum(F.when(c, F.col(of)).otherwise(0))
    steps = moves.groupBy("k").agg(total(pos, "more").alias("tp"), total(~pos, "more").alias("fp"), total(pos, "all").alias("n_pos"), total(~pos, "all").alias("n_neg"))
    grid = rows.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("k")).join(steps, "k", "left").fillna(0)
    upto = W.orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    grid = grid.select("k", *(F.sum(c).over(upto).alias(c) for c in ("tp", "fp", "n_pos", "n_neg")))
    a, b, tn = F.greatest("n_pos", F.lit(1)), F.greatest("n_neg", F.lit(1)), F.col("n_neg") - F.col("fp")
    scores = grid.select((F.col("k") / 20).alias("w"), (F.col("tp") * b + tn * a).alias("exact"), ((F.col("tp") / a + tn / b) / 2).alias("balanced_accuracy"))
    return scores.orderBy(F.desc("exact"), "w").limit(1).select("w", "balanced_accuracy")


def fusion_report(rows: DataFrame, threshold: float, w: float, max_delta: float = 1.0) -> DataFrame:
    """{ba_base, ba_fused, auc_base, auc_fused, brier_base, brier_fused, flips, w}: unless fusion improves balanced accuracy, w is 0 and what is fused is the base."""
    fused = rows.withColumn("fused", fuse_probability(F.col("p"), F.col("invention"), F.lit(w), max_delta))
    base, after = (_at(fused, F.col(c), threshold).select(F.col("exact").alias(f"x_{c}"), F.col("balanced_accuracy").alias(f"ba_{c}")) for c in ("p", "fused"))
    aucs = [auc_rank(fused.select("y", F.col(c).alias("score"))).withColumnRenamed("auc", f"auc_{c}") for c in ("p", "fused")]
    rest = fused.agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier_p"), F.avg(F.pow(F.col("fused") - F.col("y"), 2)).alias("brier_fused"), F.avg(((F.col("p") >= threshold) != (F.col("fused") >= threshold)).cast("double")).alias("flips"))
    out = base.crossJoin(after).crossJoin(rest).crossJoin(aucs[0]).crossJoin(aucs[1])  # one row each
    better = F.col("x_fused") > F.col("x_p")
    kept = lambda name: [F.col(f"{name}_p").alias(f"{name}_base"), F.when(better, F.col(f"{name}_fused")).otherwise(F.col(f"{name}_p")).alias(f"{name}_fused")]
    return out.select(*kept("ba"), *kept("auc"), *kept("brier"), F.when(better, F.col("flips")).otherwise(0.0).alias("flips"), F.when(better, F.lit(w)).otherwise(0.0).alias("w"))


def merge_scores(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """``rows`` with {invention, probe_detected}; 0.5 and false where a call has none."""
    return rows.join(scores.select("call_id", "invention", "probe_detected"), "call_id", "left").fillna({"invention": 0.5, "probe_detected": False})


def choose_variant(variants: DataFrame) -> DataFrame:
    """{name}: best balanced accuracy of {name, balanced_accuracy, is_base}; the base wins ties."""
    return variants.agg(F.max_by("name", F.struct("balanced_accuracy", "is_base")).alias("name"))
