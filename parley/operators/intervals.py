"""Interval operators over turns {call_id, turn_id, channel, s, e}; channel 0 is the caller, 1 the agent.

All are keyed by call_id, so Spark deals the turns out once and the joins, windows and
aggregates of a plan share that exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CALLER, AGENT = 0, 1


def split_channels(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(caller turns, agent turns)."""
    return turns.filter(F.col("channel") == CALLER), turns.filter(F.col("channel") == AGENT)


def overlap_join(turns: DataFrame, bin_seconds: float | None = None) -> DataFrame:
    """{call_id, ai, ci, cs, ce, os, oe}: agent and caller turns that overlap, and their common span.

    With ``bin_seconds`` both sides are also dealt by time bin, for calls of very many turns; a
    pair counts in the bin where its common span starts, so it appears once.
    """
    caller, agent = split_channels(turns)
    a = agent.select("call_id", F.col("turn_id").alias("ai"), F.col("s").alias("as"), F.col("e").alias("ae"))
    c = caller.select("call_id", F.col("turn_id").alias("ci"), F.col("s").alias("cs"), F.col("e").alias("ce"))
    on = ["call_id"]
    if bin_seconds:
        bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin_seconds), F.floor(F.col(e) / bin_seconds)))
        a, c, on = a.withColumn("bin", bins("as", "ae")), c.withColumn("bin", bins("cs", "ce")), ["call_id", "bin"]
    pairs = a.join(c, on).filter((F.col("as") < F.col("ce")) & (F.col("cs") < F.col("ae")))
    if bin_seconds:
        pairs = pairs.filter(F.col("bin") == F.floor(F.greatest("as", "cs") / bin_seconds))
    return pairs.select("call_id", "ai", "ci", "cs", "ce", F.greatest("as", "cs").alias("os"), F.least("ae", "ce").alias("oe"))


def next_start_asof(points: DataFrame, starts: DataFrame, inclusive: bool = True) -> DataFrame:
    """``points`` {call_id, k, t, ...} with nt, the first of ``starts`` {call_id, s} at or after t; points without one go.

    Both sides are merged into one ordered stream per call, so no pairs are formed.
    """
    others = [c for c in points.columns if c not in ("call_id", "t")]
    stream = points.select("call_id", "t", F.lit(False).alias("_start"), *others)
    stream = stream.unionByName(starts.select("call_id", F.col("s").alias("t"), F.lit(True).alias("_start")), allowMissingColumns=True)
    order = W.partitionBy("call_id").orderBy("t").rangeBetween(W.currentRow, W.unboundedFollowing)
    at = F.when(F.col("_start"), F.col("t"))
    if not inclusive:
        # Starts sort before points at the same time, and the frame begins behind the point.
        order = W.partitionBy("call_id").orderBy("t", F.desc("_start")).rowsBetween(1, W.unboundedFollowing)
    return stream.withColumn("nt", F.min(at).over(order)).filter(~F.col("_start") & F.col("nt").isNotNull()).select("call_id", "t", *others, "nt")


def merge_intervals(spans: DataFrame) -> DataFrame:
    """The union of {call_id, s, e}; spans that touch merge."""
    order = W.partitionBy("call_id").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = spans.select("call_id", "s", "e", F.when(F.col("s") <= reach, 0).otherwise(1).alias("new"))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return islands.groupBy("call_id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def silence_gaps(turns: DataFrame, calls: DataFrame, min_gap: float = 2.0) -> DataFrame:
    """{call_id, g, g_end}: stretches longer than ``min_gap`` in which nobody speaks, from 0 to the call's end."""
    order = W.partitionBy("call_id").orderBy("s", "e")
    reach = F.greatest(F.coalesce(F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)), F.lit(0.0))
    inner = turns.select("call_id", reach.alias("g"), F.col("s").alias("g_end"))
    last = turns.groupBy("call_id").agg(F.greatest(F.max("e"), F.lit(0.0)).alias("g"))
    tail = calls.join(last, "call_id", "left").select("call_id", F.coalesce("g", F.lit(0.0)).alias("g"), F.col("dur").alias("g_end"))
    return inner.union(tail).filter(F.col("g_end") - F.col("g") > min_gap)


def truncate_turns(turns: DataFrame, cuts: DataFrame) -> DataFrame:
    """For each cut {call_id, i, t}: the turns that start before t, ended at t at the latest."""
    return turns.join(cuts, "call_id").filter(F.col("s") < F.col("t")).withColumn("e", F.least("e", "t")).select("call_id", "i", "turn_id", "channel", "s", "e")


def turn_counts(turns: DataFrame) -> DataFrame:
    """{call_id, caller, agent}."""
    return turns.groupBy("call_id").agg(F.count_if(F.col("channel") == CALLER).alias("caller"), F.count_if(F.col("channel") == AGENT).alias("agent"))


def find_answer_turn(turns: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes`` {call_id, probe_turn} with answer_turn: the first caller turn after it, null if there is none."""
    answers = turns.filter(F.col("channel") == CALLER).select("call_id", F.col("turn_id").cast("double").alias("s"))
    found = next_start_asof(probes.select("call_id", F.col("probe_turn").cast("double").alias("t"), "probe_turn"), answers, inclusive=False)
    return probes.join(found.select("call_id", "probe_turn", F.col("nt").cast("long").alias("answer_turn")), ["call_id", "probe_turn"], "left")
