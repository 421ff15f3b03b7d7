"""Sinks: feature tables, score files, metrics records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_feature_table(features: DataFrame, path: str, source: str) -> None:
    """Partitioned by source and split, so reading one split prunes the rest. ``features`` holds split."""
    features.withColumn("source", F.lit(source)).write.mode("append").partitionBy("source", "split").parquet(path)


def write_scores_csv(scores: DataFrame, path: str) -> None:
    """Ordered files, replaced as a whole."""
    scores.orderBy("call_id", "model").write.mode("overwrite").csv(path, header=True)


#: The keys that a full training record has.
REQUIRED_KEYS = (
    "feature_contract", "git_sha", "seed", "n_train", "n_val", "threshold", "balanced_accuracy", "tpr_synthetic", "tnr_human", "accuracy", "roc_auc", "auc_target", "auc_pass", "brier", "brier_before_calibration", "brier_target",
    "brier_pass", "eer", "ece", "reliability_table", "confusion_matrix", "error_by_duration_band", "top_feature_importances", "cv_auc_mean", "cv_auc_std", "val_auc", "cv_val_auc_gap", "ba_train_oof", "ba_val_gap",
    "anti_self_deception_triggered", "anti_self_deception_evidence", "cross_check",
)


def export_metrics(parts: list[DataFrame], required: tuple[str, ...] = ()) -> DataFrame:
    """{record}: one-row frames as one JSON record, in which null stays null.

    A record without one of the ``required`` keys (REQUIRED_KEYS for a full one) or with a key
    that two parts give is refused.
    """
    names = [c for p in parts for c in p.columns]
    missing, twice = [k for k in required if k not in names], sorted({n for n in names if names.count(n) > 1})
    if missing or twice:
        raise ValueError(f"record without {missing}, twice with {twice}")
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out.select(F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"}).alias("record"))


def write_events(events: DataFrame, path: str) -> None:
    """Detection events partitioned by day."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)
