"""How a model's confidence grows over a call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.events import timeline_cuts
from parley.operators.features import CONTRACT, extract_features
from parley.operators.intervals import truncate_turns
from parley.operators.trees import Ensemble, score_model


def features_at(turns: DataFrame, cuts: DataFrame) -> DataFrame:
    """{call_id, i, t, the 23 features} as they stand at each cut {call_id, i, t}: of the turns begun before t, ended at t at the latest, in a call that ends at t."""
    key = F.struct("call_id", "i").alias("call_id")
    at = truncate_turns(turns, cuts).select(key, "turn_id", "channel", "s", "e")
    f = extract_features(at, cuts.select(key, F.col("t").alias("dur")))
    return f.select("call_id.*", *CONTRACT).join(cuts, ["call_id", "i"]).select("call_id", "i", "t", *CONTRACT)


def confidence_timeline(turns: DataFrame, calls: DataFrame, model: Ensemble, a: float = -1.0, b: float = 0.0, threshold: float = 0.5, points: int = 16, served: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """{call_id, i, t, confidence}: the model's confidence at ``points`` even times within a call, and at its end as point ``points`` + 1.

    The last point is what was ``served`` {call_id, confidence}, not scored again; without it, and
    for calls that it lacks, the whole call is scored. ``digits`` rounds features before they meet the model's thresholds.
    """
    cuts = timeline_cuts(calls, points)
    if served is not None:
        known = served.select("call_id", F.col("confidence").alias("final"))
        ends = cuts.filter(F.col("i") > points).join(known, "call_id")
        cuts = cuts.join(ends.select("call_id", "i"), ["call_id", "i"], "left_anti")
    f = features_at(turns, cuts)
    if digits is not None:
        f = f.select("call_id", "i", "t", *((F.round(n, digits) + F.lit(0.0)).alias(n) for n in CONTRACT))
    scored = score_model(f, model, a, b, threshold).select("call_id", "i", "t", "confidence")
    return scored if served is None else scored.unionByName(ends.select("call_id", "i", "t", F.col("final").alias("confidence")))
