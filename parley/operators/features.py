"""The 23 turn-taking features of contract fc-1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators.intervals import AGENT, CALLER, next_start_asof, overlap_join, split_channels

# Fixed names in their fixed order.
CONTRACT = (
    "resp_latency_mean", "resp_latency_median", "resp_latency_std", "resp_latency_cv", "latency_monotony_index", "resp_latency_min",
    "overlap_count", "overlap_rate_per_min", "overlap_total_dur", "caller_bargein_count", "recovery_delay_mean", "recovery_delay_cv",
    "recovery_abort_ratio", "caller_turn_dur_mean", "caller_turn_dur_std", "caller_turn_dur_cv", "short_turn_ratio", "fragmentation_rate",
    "caller_speech_ratio", "speech_balance", "silence_break_delay_mean", "silence_break_delay_cv", "turn_count_caller",
)
NEAR_MEDIAN, ABORT, SHORT, FRAGMENT = 0.15, 0.4, 1.0, 0.5


def _share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def response_latency(turns: DataFrame) -> DataFrame:
    """F-01..06: from each agent turn's end to the next caller start."""
    caller, agent = split_channels(turns)
    delays = next_start_asof(agent.select("call_id", F.col("e").alias("t"), F.lit(1).alias("k")), caller).select("call_id", (F.col("nt") - F.col("t")).alias("d"))
    medians = delays.groupBy("call_id").agg(F.median("d").alias("md"))
    return delays.join(medians, "call_id").groupBy("call_id").agg(
        F.avg("d").alias("resp_latency_mean"), F.min("md").alias("resp_latency_median"), F.stddev_pop("d").alias("resp_latency_std"),
        _share(F.abs(F.col("d") - F.col("md")) <= NEAR_MEDIAN).alias("latency_monotony_index"), F.min("d").alias("resp_latency_min"),
    )


def overlap_stats(turns: DataFrame) -> DataFrame:
    """F-07, F-09, F-13 before the rates."""
    return overlap_join(turns).groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("oe") - F.col("os")).alias("overlap_total_dur"), F.count_if(F.col("ce") - F.col("os") <= ABORT).alias("aborts"))


def barge_ins(turns: DataFrame) -> DataFrame:
    """F-10: caller turns that start strictly inside an agent turn."""
    caller, agent = split_channels(turns)
    a = agent.select("call_id", F.col("s").alias("as"), F.col("e").alias("ae"))
    hit = caller.join(a, (caller["call_id"] == a["call_id"]) & (a["as"] < caller["s"]) & (caller["s"] < a["ae"]), "left_semi")
    return hit.groupBy("call_id").agg(F.count(F.lit(1)).alias("bargeins"))


def delays_after(points: DataFrame, turns: DataFrame, name: str) -> DataFrame:
    """Mean and variation of the delay from ``points`` {call_id, t} to the next caller start (F-11, F-12, F-21)."""
    caller, _ = split_channels(turns)
    d = next_start_asof(points, caller).withColumn("d", F.col("nt") - F.col("t"))
    return d.groupBy("call_id").agg(F.avg("d").alias(f"{name}_mean"), F.stddev_pop("d").alias(f"{name}_std"))


def caller_turns(turns: DataFrame) -> DataFrame:
    """F-14..18, F-22 before the rates."""
    caller, _ = split_channels(turns)
    d = F.col("e") - F.col("s")
    following = F.lead("s").over(W.partitionBy("call_id").orderBy("s", "e"))
    return caller.withColumn("next", following).groupBy("call_id").agg(
        F.count(F.lit(1)).alias("caller_n"), F.avg(d).alias("caller_turn_dur_mean"), F.stddev_pop(d).alias("caller_turn_dur_std"), F.sum(d).alias("caller_total"),
        _share(d < SHORT).alias("short_turn_ratio"), F.count_if(F.col("next") - F.col("e") < FRAGMENT).alias("fragments"),
    )


def _ordered(turns: DataFrame) -> DataFrame:
    """``turns`` in order of start, the caller first at ties, with what each sees of the others: the latest end so far, the
    latest agent end among those that started earlier, and the next caller start."""
    order = W.partitionBy("call_id").orderBy("s", "channel", "e")
    so_far, later = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    of = lambda channel, x: F.when(F.col("channel") == channel, F.col(x))
    return turns.select(
        "call_id", "channel", "s", "e", F.greatest(F.coalesce(F.max("e").over(so_far), F.lit(0.0)), F.lit(0.0)).alias("reach"),
        F.max(of(AGENT, "e")).over(so_far).alias("agent_e"), F.min(of(CALLER, "s")).over(later).alias("next_s"),
    )


def _stream(turns: DataFrame, calls: DataFrame, min_gap: float = 2.0) -> DataFrame:
    """{call_id, k, t, d, x, y}: caller turns (k 0), agent turns (k 1, at their end), overlaps (k 2, at their end) and silences (k 3).

    d is the length of the turn or overlap; x the pause until the next caller turn, or how long
    the caller talks on in an overlap; y is 1 where a caller turn starts inside an agent turn.
    """
    point = lambda k, t, d, x, y: F.struct(F.lit(k).alias("k"), t.alias("t"), d.alias("d"), x.alias("x"), y.alias("y"))
    none, d = F.lit(None).cast("double"), F.col("e") - F.col("s")
    own = F.when(F.col("channel") == CALLER, point(0, F.col("s"), d, F.col("next_s") - F.col("e"), (F.col("agent_e") > F.col("s")).cast("double")))
    own = own.when(F.col("channel") == AGENT, point(1, F.col("e"), d, none, none))
    silent = F.when(F.col("s") - F.col("reach") > min_gap, point(3, F.col("reach"), none, none, none))
    rows = _ordered(turns).select("call_id", F.inline(F.array_compact(F.array(own, silent))))
    pairs = overlap_join(turns).select("call_id", F.inline(F.array(point(2, F.col("oe"), F.col("oe") - F.col("os"), F.col("ce") - F.col("os"), none))))
    last = turns.groupBy("call_id").agg(F.greatest(F.max("e"), F.lit(0.0)).alias("g"))
    tails = calls.join(last, "call_id", "left").filter(F.col("dur") - F.coalesce("g", F.lit(0.0)) > min_gap)
    return rows.union(pairs).union(tails.select("call_id", F.inline(F.array(point(3, F.coalesce("g", F.lit(0.0)), none, none, none)))))


def extract_features(turns: DataFrame, calls: DataFrame) -> DataFrame:
    """{call_id, the 23 features}; a statistic of nothing is 0.

    One ordered stream per call, one window for the next caller start and one aggregate.
    """
    ahead = W.partitionBy("call_id").orderBy("t").rangeBetween(W.currentRow, W.unboundedFollowing)
    s = _stream(turns, calls).withColumn("wait", F.min(F.when(F.col("k") == 0, F.col("t"))).over(ahead) - F.col("t"))
    k = F.col("k")
    of = lambda n, x: F.when(k == n, F.col(x))
    wait = {"resp_latency": of(1, "wait"), "recovery_delay": of(2, "wait"), "silence_break_delay": of(3, "wait"), "caller_turn_dur": of(0, "d")}
    c = s.groupBy("call_id").agg(
        *[f(x).alias(f"{name}_{how}") for name, x in wait.items() for how, f in (("mean", F.avg), ("std", F.stddev_pop))],
        F.median(wait["resp_latency"]).alias("resp_latency_median"), F.min(wait["resp_latency"]).alias("resp_latency_min"), F.collect_list(wait["resp_latency"]).alias("waits"),
        F.count_if(k == 2).alias("n"), F.sum(of(2, "d")).alias("overlap_total_dur"), F.count_if((k == 2) & (F.col("x") <= ABORT)).alias("aborts"),
        F.count_if((k == 0) & (F.col("y") == 1)).alias("bargeins"), F.count_if(k == 0).alias("caller_n"), F.sum(of(0, "d")).alias("caller_total"), F.sum(of(1, "d")).alias("agent_total"),
        F.avg(F.when(k == 0, (F.col("d") < SHORT).cast("double"))).alias("short_turn_ratio"), F.count_if((k == 0) & (F.col("x") < FRAGMENT)).alias("fragments"),
    )
    near = F.size(F.filter("waits", lambda d: F.abs(d - F.col("resp_latency_median")) <= NEAR_MEDIAN))
    out = calls.select("call_id", "dur").join(c, "call_id", "left")
    per_minute = lambda n: F.when(F.col("dur") > 0, F.coalesce(n, F.lit(0)) / (F.col("dur") / 60.0))
    cv = lambda x: F.col(f"{x}_std") / F.nullif(F.col(f"{x}_mean"), F.lit(0.0))
    made = {
        "resp_latency_cv": cv("resp_latency"), "latency_monotony_index": F.try_divide(near, F.size("waits")), "overlap_count": F.col("n").cast("double"), "overlap_rate_per_min": per_minute(F.col("n")),
        "caller_bargein_count": F.col("bargeins").cast("double"), "recovery_delay_cv": cv("recovery_delay"), "recovery_abort_ratio": F.try_divide("aborts", "n"),
        "caller_turn_dur_cv": cv("caller_turn_dur"), "fragmentation_rate": per_minute(F.col("fragments")),
        "caller_speech_ratio": F.when(F.col("dur") > 0, F.col("caller_total") / F.col("dur")), "speech_balance": F.when(F.col("agent_total") > 0, F.coalesce("caller_total", F.lit(0.0)) / F.col("agent_total")),
        "silence_break_delay_cv": cv("silence_break_delay"), "turn_count_caller": F.col("caller_n").cast("double"),
    }
    return out.select("call_id", *[F.coalesce(made.get(name, F.col(name) if name not in made else None), F.lit(0.0)).alias(name) for name in CONTRACT])


def features_long(features: DataFrame) -> DataFrame:
    """{call_id, idx, feature, value}, a row per feature in contract order."""
    pairs = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(name).alias("feature"), F.col(name).alias("value")) for i, name in enumerate(CONTRACT)])
    return features.select("call_id", F.inline(pairs))


def assert_contract(features: DataFrame) -> None:
    """Raises unless the columns after call_id are the contract's, in its order."""
    found = tuple(c for c in features.columns if c != "call_id")
    if found != CONTRACT:
        raise ValueError(f"columns differ from the contract: {found}")
