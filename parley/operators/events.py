"""Dialogue events, explanations and display aggregates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators.evaluate import ranged
from parley.operators.features import features_long
from parley.operators.intervals import overlap_join, silence_gaps, split_channels

# The sentence of each feature, with its value or its percentage in so many decimals, and the number of agent turns.
PHRASES = {
    "resp_latency_mean": "Mean response latency was {value:.2f}s",
    "resp_latency_median": "Median response latency was {value:.2f}s",
    "resp_latency_std": "Response latency varied by {value:.2f}s (std)",
    "resp_latency_cv": "Response latency stayed within CV {value:.2f} across {agent} agent turns",
    "latency_monotony_index": "{percent:.0f}% of response latencies landed within ±0.15s of the median",
    "resp_latency_min": "The fastest response latency was {value:.2f}s",
    "overlap_count": "{value:.0f} caller/agent overlaps were detected",
    "overlap_rate_per_min": "Overlaps occurred at {value:.2f} per minute",
    "overlap_total_dur": "Overlapping speech totalled {value:.2f}s",
    "caller_bargein_count": "The caller barged in on the agent {value:.0f} time(s)",
    "recovery_delay_mean": "After an overlap, the caller resumed after {value:.2f}s on average",
    "recovery_delay_cv": "Recovery delay after interruption had CV {value:.2f}",
    "recovery_abort_ratio": "The caller yielded the floor within 0.4s in {percent:.0f}% of overlaps",
    "caller_turn_dur_mean": "Caller turns averaged {value:.2f}s",
    "caller_turn_dur_std": "Caller turn duration varied by {value:.2f}s (std)",
    "caller_turn_dur_cv": "Caller turn duration had CV {value:.2f}",
    "short_turn_ratio": "{percent:.0f}% of caller turns were short backchannels (<1.0s)",
    "fragmentation_rate": "Caller turns fragmented at {value:.2f} per minute",
    "caller_speech_ratio": "The caller held the floor for {percent:.0f}% of the call",
    "speech_balance": "Caller/agent speech balance was {value:.2f}",
    "silence_break_delay_mean": "After a mutual silence, the caller spoke after {value:.2f}s on average",
    "silence_break_delay_cv": "Silence-break delay had CV {value:.2f}",
    "turn_count_caller": "The caller produced {value:.0f} turns over the call",
}
OTHER_PHRASE = "{feature} measured {value:.3f}"
PLACE = re.compile(r"\{(value|percent):\.(\d)f\}")


def dialogue_events(turns: DataFrame, calls: DataFrame) -> DataFrame:
    """{call_id, kind, s, e}: overlaps, interruptions (a caller start inside an agent turn, its start included), silences."""
    pairs = overlap_join(turns)
    overlaps = pairs.filter("oe > os").select("call_id", F.lit("overlap").alias("kind"), F.col("os").alias("s"), F.col("oe").alias("e"))
    caller, agent = split_channels(turns)
    a = agent.select("call_id", F.col("s").alias("as"), F.col("e").alias("ae"))
    within = (a["as"] <= caller["s"]) & (caller["s"] < a["ae"])
    cuts = caller.join(a, (caller["call_id"] == a["call_id"]) & within, "left_semi").select("call_id", F.lit("interruption").alias("kind"), "s", "e")
    silences = silence_gaps(turns, calls).select("call_id", F.lit("silence").alias("kind"), F.col("g").alias("s"), F.col("g_end").alias("e"))
    return overlaps.unionByName(cuts).unionByName(silences)


def top_factors(features: DataFrame, meta: DataFrame, k: int = 5) -> DataFrame:
    """The k features that speak loudest: {call_id, rank, feature, value, direction, weight}.

    ``meta`` {feature, mean, std, importance, sign} has one row per feature of the contract.
    """
    z = F.when(F.abs("std") <= 1e-12, 0.0).otherwise((F.col("value") - F.col("mean")) / F.col("std"))
    scored = features_long(features).join(meta, "feature").withColumn("z", z).withColumn("score", F.abs(F.col("importance") * F.col("z")))
    order = W.partitionBy("call_id").orderBy(F.desc("score"), "idx")
    top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    total = F.sum("score").over(W.partitionBy("call_id"))
    side = F.col("sign") * F.col("z")
    direction = F.when(side > 0, "synthetic").when(side < 0, "human").otherwise("neutral")
    return top.withColumn("weight", F.when(total <= 1e-12, 1.0 / k).otherwise(F.col("score") / total)).select("call_id", "rank", "feature", "value", direction.alias("direction"), "weight")


def fixed_point(x: Column, digits: int) -> Column:
    """``x`` with so many decimals; a value exactly between two goes to the even one."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits if digits else "0"))


def sentence(template: str) -> Column:
    """A sentence of ``PHRASES`` over the columns feature, value and agent."""
    place = PLACE.search(template)
    x = F.col("value") * 100 if place[1] == "percent" else F.col("value")
    said = F.replace(F.lit(template), F.lit(place[0]), fixed_point(x, int(place[2])))
    for name in ("agent", "feature"):
        said = F.replace(said, F.lit(f"{{{name}}}"), F.col(name).cast("string")) if f"{{{name}}}" in template else said
    return said


def rationale(factors: DataFrame, counts: DataFrame, n: int = 3) -> DataFrame:
    """{call_id, rationale}: one sentence for each of the first n factors, also for features without one of their own; ``counts`` {call_id, agent}."""
    said = sentence(OTHER_PHRASE)
    for name, template in PHRASES.items():
        said = F.when(F.col("feature") == name, sentence(template)).otherwise(said)
    line = F.concat(said, F.lit(" ("), "feature", F.lit(", "), "direction", F.lit(" signal, weight "), fixed_point(F.col("weight") * 100, 0), F.lit("%)."))
    rows = factors.filter(F.col("rank") <= n).join(counts.select("call_id", F.coalesce("agent", F.lit(0)).alias("agent")), "call_id", "left").fillna({"agent": 0})
    return rows.groupBy("call_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("text")))), lambda x: x["text"]), " ").alias("rationale"))


def timeline_cuts(calls: DataFrame, points: int = 16) -> DataFrame:
    """{call_id, i, t}: ``points`` interior times of each call and its end."""
    return calls.select("call_id", "dur", F.explode(F.sequence(F.lit(1), F.lit(points + 1))).alias("i")).select("call_id", "i", F.when(F.col("i") > points, F.col("dur")).otherwise(F.col("dur") * F.col("i") / (points + 1)).alias("t"))


def interpolate_timeline(points: DataFrame, at: DataFrame) -> DataFrame:
    """``at`` {call_id, t} with p between the neighbouring ``points`` {call_id, t, p}; ends are held.

    Points and times form one ordered stream per call; each time looks back and ahead for its neighbours.
    """
    stream = points.select("call_id", "t", "p", F.struct("t", "p").alias("here")).unionByName(at.select("call_id", "t"), allowMissingColumns=True)
    order = W.partitionBy("call_id").orderBy("t")
    left = F.last("here", ignorenulls=True).over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
    right = F.first("here", ignorenulls=True).over(order.rangeBetween(W.currentRow, W.unboundedFollowing))
    out = stream.withColumns({"l": left, "r": right}).filter(F.col("here").isNull())
    span = F.col("r.t") - F.col("l.t")
    p = F.when(F.col("l").isNull(), F.col("r.p")).when(F.col("r").isNull() | (span <= 0), F.col("l.p")).otherwise(F.col("l.p") + (F.col("r.p") - F.col("l.p")) * (F.col("t") - F.col("l.t")) / span)
    return out.select("call_id", "t", p.alias("p"))


def waveform_envelope(samples: DataFrame, bucket: int = 400) -> DataFrame:
    """{call_id, channel, b, peak}: the largest |x| of every ``bucket`` samples {call_id, channel, i, x}."""
    return samples.groupBy("call_id", "channel", F.floor(F.col("i") / bucket).alias("b")).agg(F.round(F.max(F.abs("x")), 3).alias("peak"))


def downsample_peaks(peaks: DataFrame, n: int) -> DataFrame:
    """{call_id, channel, g, peak}: the largest of n groups of each envelope {call_id, channel, b, peak}, at most 1.

    A peak's groups are computed from its place and lie next to each other; none meets all groups.
    """
    size = peaks.groupBy("call_id", "channel").agg((F.max("b") + 1).alias("size"))
    step = F.col("size") / F.lit(float(n))
    first, last = F.greatest(F.floor(F.col("b") / step) - 1, F.lit(0)), F.least(F.floor((F.col("b") + 1) / step) + 1, F.lit(n - 1))
    near = peaks.join(size, ["call_id", "channel"]).select("call_id", "channel", "b", "peak", step.alias("step"), F.explode(F.sequence(first.cast("int"), F.greatest(first, last).cast("int"))).alias("g"))
    start = F.floor(F.col("g") * F.col("step"))
    inside = (F.col("b") >= start) & (F.col("b") < F.greatest(start + 1, F.floor((F.col("g") + 1) * F.col("step"))))
    return near.filter(inside & (F.col("g") < n)).groupBy("call_id", "channel", "g").agg(F.least(F.max("peak"), F.lit(1.0)).alias("peak"))


def verdict(rows: DataFrame, threshold: float) -> DataFrame:
    """Adds is_synthetic and confidence (of the asserted class, 0..1, 4 digits) to {p}."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p")))
    yes = F.col("p") >= threshold
    return rows.withColumns({"is_synthetic": yes, "confidence": F.round(F.when(yes, p).otherwise(1 - p), 4)})


def fallback_verdict(calls: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every call with a verdict, false at 0.5 where none was reached; the incidents)."""
    joined = calls.select("call_id").join(verdicts, "call_id", "left")
    out = joined.select("call_id", F.coalesce("is_synthetic", F.lit(False)).alias("is_synthetic"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"))
    return out, joined.filter(F.col("confidence").isNull()).select("call_id", F.lit("fallback").alias("reason"))


def verdict_band(is_synthetic: Column, confidence: Column, sure: float = 0.7) -> Column:
    return F.when(confidence < sure, "review").when(is_synthetic, "synthetic").otherwise("verified")


def review_queue(events: DataFrame, threshold: float, band: float = 0.20) -> DataFrame:
    """Events near the threshold with their priority of the day: the closest first, then the oldest.

    Distances are dealt to ranges of about equal counts, which get prefix sums for each day; then each range of a
    day is numbered by itself, so no task orders a whole day.
    """
    near = events.withColumns({"_far": F.abs(F.col("confidence") - threshold), "_day": F.to_date("ts")}).filter(F.col("_far") <= band)
    near = ranged(near, "_far", "_part")
    parts = near.groupBy("_day", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_day").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy("_day", "_part").orderBy("_far", "ts", "request_id"))
    on = F.col("_day").eqNullSafe(F.col("_d")) & (F.col("_part") == F.col("_p"))
    told = near.withColumn("_own", own).join(parts.select(F.col("_day").alias("_d"), F.col("_part").alias("_p"), before.alias("_before")), on)
    return told.withColumn("priority", F.col("_before") + F.col("_own")).select(*events.columns, F.col("_far").alias("distance"), "priority")


def review_summary(events: DataFrame, threshold: float, now: Column, band: float = 0.20) -> DataFrame:
    """{waiting, oldest_wait_s} of the review queue."""
    near = events.filter(F.abs(F.col("confidence") - threshold) <= band)
    return near.agg(F.count(F.lit(1)).alias("waiting"), (F.unix_timestamp(now) - F.unix_timestamp(F.min("ts"))).alias("oldest_wait_s"))


def build_analysis(verdicts: DataFrame, turns: DataFrame, events: DataFrame, features: DataFrame, factors: DataFrame, reasons: DataFrame) -> DataFrame:
    """One nested record per call; a part that is missing stays null."""
    listed = lambda df, *cols: df.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct(*cols))))
    long = features_long(features).groupBy("call_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "value")))).alias("features"))
    out = verdicts.select("call_id", F.struct("is_synthetic", "confidence", "p").alias("verdict"))
    for part in (listed(turns, "s", "e", "channel").toDF("call_id", "turns"), listed(events, "s", "e", "kind").toDF("call_id", "events"), long, listed(factors, "rank", "feature", "value", "direction", "weight").toDF("call_id", "top_factors"), reasons):
        out = out.join(part, "call_id", "left")
    return out
