"""Time-bucket monitoring over detection events, and what the live feed and the executive view show."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "1d": "1 day"}
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
QUANTILES = (0.50, 0.95, 0.99)
#: Relative error of sketched quantiles; the bucket of values of 0 or less.
SKETCH_ERROR, NO_POWER = 0.01, -(1 << 31)


def _quantiles(x: str) -> list[Column]:
    return [F.expr(f"percentile({x}, {q})").alias(f"p{round(100 * q)}") for q in QUANTILES]


def sketch_index(x: Column, error: float = SKETCH_ERROR) -> Column:
    """The exponential bucket of a value: powers of (1 + error) / (1 - error), so that a bucket's middle is within ``error`` of all in it. Values of 0 or less share one bucket; null has none."""
    return F.when(x > 0, F.ceil(F.ln(x) / math.log((1 + error) / (1 - error))).cast("int")).when(x.isNotNull(), NO_POWER)


def sketch_value(index: Column, error: float = SKETCH_ERROR) -> Column:
    """The middle of a bucket."""
    base = (1 + error) / (1 - error)
    return F.when(index == NO_POWER, 0.0).otherwise(F.exp(index * math.log(base)) * 2 / (base + 1))


def sketch_quantile(sketch: Column, q: float, error: float = SKETCH_ERROR) -> Column:
    """A quantile of a sketch MAP<INT, BIGINT> (bucket -> count): the first bucket with more than q * (n - 1) values up to it; null without any."""
    entries = F.array_sort(F.map_entries(sketch))
    n = F.aggregate(entries, F.lit(0).cast("long"), lambda t, e: t + e["value"])
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("at"))
    found = F.aggregate(entries, start, lambda t, e: F.struct((t["seen"] + e["value"]).alias("seen"), F.when(t["at"].isNull() & (t["seen"] + e["value"] > q * (n - 1)), e["key"]).otherwise(t["at"]).alias("at")))
    return sketch_value(found["at"], error)


def sketched(parts: DataFrame, *by: str) -> DataFrame:
    """{by.., the sums of all numbers, sketch} of rows {by.., index, n, ..}: sketches merge by adding up their buckets' counts."""
    rest = [c for c in parts.columns if c not in (*by, "index")]
    buckets = parts.groupBy(*by, "index").agg(*(F.sum(c).alias(c) for c in rest))
    entries = F.collect_list(F.when(F.col("index").isNotNull(), F.struct("index", "n")))
    return buckets.groupBy(*by).agg(*(F.sum(c).alias(c) for c in rest), F.map_from_entries(entries).alias("sketch"))


def stats_1m(events: DataFrame, bucket: str = "1 minute", sketch: bool = False) -> DataFrame:
    """{bucket, n, n_synthetic, p50, p95, p99, confidence}; with ``sketch`` a mergeable sketch of exponential buckets instead of exact percentiles."""
    window = F.window("ts", bucket).alias("w")
    if sketch:
        index = sketch_index(F.col("latency_ms")).alias("index")
        parts = events.groupBy(window, index).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_synthetic").alias("n_synthetic"), F.sum("confidence").alias("c"), F.count("confidence").alias("nc"))
        out = sketched(parts.withColumn("bucket", F.col("w.start")).drop("w"), "bucket")
        return out.select("bucket", "n", "n_synthetic", "sketch", F.try_divide("c", "nc").alias("confidence"))
    out = events.groupBy(window).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_synthetic").alias("n_synthetic"), *_quantiles("latency_ms"), F.avg("confidence").alias("confidence"))
    return out.select(F.col("w.start").alias("bucket"), *out.columns[1:])


def stats_readable(stats: DataFrame) -> DataFrame:
    """Sketches of ``stats_1m(sketch=True)`` as p50, p95 and p99, each within SKETCH_ERROR of a value of that rank."""
    return stats.select("bucket", "n", "n_synthetic", *[sketch_quantile(F.col("sketch"), q).alias(f"p{round(100 * q)}") for q in QUANTILES], "confidence")


def lookback_seconds(window: str) -> int:
    """``<n>[smhd]``; a day if it can't be read."""
    m = re.fullmatch(r"(\d+)([smhd])", window or "")
    return int(m[1]) * UNITS[m[2]] if m else 86400


def history(stats: DataFrame, window: str, bucket: str, now: Column) -> DataFrame:
    """Coarser buckets of the last ``window``: counts add up, percentiles are averaged unweighted, confidence by count. An unknown bucket gives no rows."""
    size = BUCKETS.get(bucket)
    recent = stats.filter((F.col("bucket") > now - F.make_dt_interval(secs=F.lit(lookback_seconds(window)))) & (F.col("bucket") <= now) & F.lit(size is not None))
    out = recent.groupBy(F.window("bucket", size or "1 minute").alias("w")).agg(
        F.sum("n").alias("n"), F.sum("n_synthetic").alias("n_synthetic"), *[F.avg(f"p{round(100 * q)}").alias(f"p{round(100 * q)}") for q in QUANTILES],
        (F.sum(F.col("confidence") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("confidence"),
    )
    return out.select(F.col("w.start").alias("bucket"), *out.columns[1:])


def history_exact(stats: DataFrame, window: str, bucket: str, now: Column) -> DataFrame:
    """The same from merged sketches: percentiles of all events of a bucket. An unknown bucket gives no rows."""
    size = BUCKETS.get(bucket)
    recent = stats.filter((F.col("bucket") > now - F.make_dt_interval(secs=F.lit(lookback_seconds(window)))) & (F.col("bucket") <= now) & F.lit(size is not None))
    recent = recent.withColumn("bucket", F.window("bucket", size or "1 minute")["start"]).withColumn("confidence", F.col("confidence") * F.col("n"))
    counts = recent.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_synthetic").alias("n_synthetic"), F.try_divide(F.sum("confidence"), F.sum("n")).alias("confidence"))
    sketches = sketched(recent.select("bucket", F.explode("sketch").alias("index", "n")), "bucket").select("bucket", "sketch")
    return stats_readable(counts.join(sketches, "bucket", "left"))


def route_metrics(events: DataFrame, most_ms: int = 10_000) -> DataFrame:
    """{route, outcome, n, fallbacks, p50, p95, p99}: rollup of routes and outcomes, null for all of them; fallbacks count as 0 ms, slower samples than ``most_ms`` leave the percentiles only."""
    ms = F.when(F.col("outcome") == "fallback", 0).otherwise(F.col("latency_ms"))
    rows = events.select("route", "outcome", F.when(ms <= most_ms, ms).alias("ms"), F.when(F.col("outcome") == "fallback", 1).otherwise(0).alias("fallback"))
    return rows.rollup("route", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("fallback").alias("fallbacks"), *_quantiles("ms"))


def latency_percentiles(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """{p50, p95, p99} of ``latency`` in ms; values all below 100 are seconds."""
    out = rows.groupBy(*by).agg(F.max("latency").alias("_max"), *_quantiles("latency"))
    scale = F.when(F.col("_max") < 100, 1000.0).otherwise(1.0)
    return out.select(*by, *[(F.col(f"p{round(100 * q)}") * scale).alias(f"p{round(100 * q)}") for q in QUANTILES])


def load_gates(log: DataFrame, rss_mb: float, p99_ms: float = 5000, most_mb: float = 1536) -> DataFrame:
    """{p99, non_200, p99_ok, rss_ok, status_ok, passed} of {status, latency_ms}."""
    out = log.agg(F.expr("percentile(latency_ms, 0.99)").alias("p99"), F.count_if(F.col("status") != 200).alias("non_200"))
    out = out.withColumns({"p99_ok": F.col("p99") <= p99_ms, "rss_ok": F.lit(rss_mb <= most_mb), "status_ok": F.col("non_200") == 0})
    return out.withColumn("passed", F.col("p99_ok") & F.col("rss_ok") & F.col("status_ok"))


def assign_event_id(events: DataFrame) -> DataFrame:
    """Adds id: the call's, or evt-<n> numbered over the events without one, in order of arrival.

    The numbering is a prefix sum over minutes, then a count within each minute, so no task orders
    all events of a day. Events without a time come first.
    """
    minute = F.coalesce(F.date_trunc("minute", "ts"), F.lit("0001-01-01").cast("timestamp"))
    e = events.withColumns({"_minute": minute, "_new": F.when(F.coalesce(F.col("call_id"), F.lit("")) == "", 1).otherwise(0)})
    minutes = e.groupBy("_minute").agg(F.sum("_new").alias("_n"))
    minutes = minutes.select("_minute", F.coalesce(F.sum("_n").over(W.orderBy("_minute").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = F.sum("_new").over(W.partitionBy("_minute").orderBy("ts", "request_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    return e.join(minutes, "_minute").withColumn("id", F.when(F.col("_new") == 0, F.col("call_id")).otherwise(F.concat(F.lit("evt-"), (F.col("_base") + own).cast("string")))).drop("_minute", "_new", "_base")


def feed_recent(events: DataFrame, n: int = 50, ring: int = 500) -> DataFrame:
    """The newest n events, at most ``ring``: a top-k, not a sort."""
    return events.orderBy(F.desc("ts"), F.desc("request_id")).limit(min(n, ring))


def latest_per_id(events: DataFrame) -> DataFrame:
    """The last event of each id; max_by keeps one row per id and task, so a busy id is no hot spot."""
    rest = [c for c in events.columns if c != "id"]
    return events.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("ts", "request_id")).alias("_e")).select("id", *[F.col(f"_e.{c}").alias(c) for c in rest])


def retained_analyses(events: DataFrame, n: int = 50) -> DataFrame:
    """The n distinct ids pushed last, each as pushed last."""
    return latest_per_id(events).orderBy(F.desc("ts"), F.desc("request_id")).limit(n)


def lookup_analysis(retained: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` {id} with their retained record, found false where there is none."""
    return ids.join(retained.withColumn("_hit", F.lit(True)), "id", "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def dedupe_feed(events: DataFrame, n: int = 500) -> DataFrame:
    return retained_analyses(events, n)


def adapt_feed_event(events: DataFrame) -> DataFrame:
    """Flat events as analysis rows: p from the asserted class's confidence, signals as a record in which null stays null."""
    p = F.when(F.col("is_synthetic"), F.col("confidence")).otherwise(1 - F.col("confidence"))
    signals = F.struct(F.lit(True).alias("behavioral"), F.when(F.col("semantic_available"), F.lit(True)).alias("semantic"), F.lit(None).cast("boolean").alias("acoustic"))
    return events.select("id", F.unix_micros("ts").alias("ts_us"), "is_synthetic", "confidence", p.alias("p"), signals.alias("signals"), "model_version")


def feed_stats(events: DataFrame, threshold: float = 0.5, band: float = 0.20) -> DataFrame:
    """{n, synthetic_rate, review_count, degradation_rate}."""
    return events.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_synthetic").cast("double")).alias("synthetic_rate"), F.count_if(F.abs(F.col("confidence") - threshold) <= band).alias("review_count"), F.avg((~F.col("semantic_available")).cast("double")).alias("degradation_rate"))


def exec_summary(events: DataFrame, now: Column) -> DataFrame:
    """The last 24 hours: {processed, flagged, share_synthetic, share_review, share_verified, p95, degradation_rate}."""
    e = events.filter((F.col("ts") > now - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") <= now))
    review = F.col("confidence") < 0.7
    share = lambda c: F.avg(c.cast("double"))
    return e.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if("is_synthetic").alias("flagged"), share(~review & F.col("is_synthetic")).alias("share_synthetic"), share(review).alias("share_review"),
        share(~review & ~F.col("is_synthetic")).alias("share_verified"), F.expr("percentile(latency_ms, 0.95)").alias("p95"), share(~F.col("semantic_available")).alias("degradation_rate"),
    )


def business_case(params: DataFrame) -> DataFrame:
    """{.., attacks, caught, saved, cost, net} of {volume, share, fraud, recall, loss, unit_cost}."""
    p = params.withColumn("attacks", F.col("volume") * F.col("share") * F.col("fraud"))
    p = p.withColumn("caught", F.col("attacks") * F.col("recall")).withColumns({"saved": F.col("caught") * F.col("loss"), "cost": F.col("volume") * F.col("unit_cost")})
    return p.withColumn("net", F.col("saved") - F.col("cost"))


#: A block of ``incident_throttle`` covers so many times the pause.
BLOCK_STEPS = 64


def _blocks(batches: Iterator[pa.RecordBatch], by: int = 2) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each value of the first ``by`` columns in turn, of batches sorted by them."""
    now, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        codes = [c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in b.columns[:by]]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            here = tuple(c[i].as_py() for c in b.columns[:by])
            if held and here != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = here
            held.append(b.slice(i, j - i))
    if held:
        yield now, pa.Table.from_batches(held)


def chain_ends(us: np.ndarray, begin: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end): where the chain of kept times ends that starts at each time a block may start with; ``us`` is sorted.

    Whatever was kept before the block, its first kept time is one of those within a step of its
    begin, or the next one. Of starts with one end the last stands for all.
    """
    n = len(us)
    # Pointer doubling: where 1, 2, 4, .. jumps lead, while any chain still goes on.
    end, jump = np.arange(n), np.append(np.searchsorted(us, us + step), n)
    jumps = [jump]
    while (jumps[-1] < n).any():
        jumps.append(jumps[-1][jumps[-1]])
    for jump in reversed(jumps):
        end = np.where(jump[end] < n, jump[end], end)
    starts = min(int(np.searchsorted(us, begin + step)) + 1, len(us))
    first, end = us[:starts], us[end[:starts]]
    last = np.append(end[1:] != end[:-1], True)
    return first[last], end[last]


def kept_times(us: np.ndarray, last: int | None, step: int) -> np.ndarray:
    """Places of the times at least a step after the last one kept."""
    kept, at = [], 0 if last is None else int(np.searchsorted(us, last + step))
    while at < len(us):
        kept.append(at)
        at = int(np.searchsorted(us, us[at] + step))
    return np.array(kept, np.int64)


def incident_throttle(events: DataFrame, seconds: int = 60, block_steps: int = BLOCK_STEPS) -> DataFrame:
    """{key, ts}: of each key's incidents those at least ``seconds`` after the last one kept.

    What is kept depends on what was kept before. So time is cut into blocks, and each block of a key
    tells, for every time it may have to start with, where its chain of kept times ends: a map from
    what was kept before it to what is kept last. The maps, a ``block_steps``-th of the events or
    less, are composed in order for each key, and with what precedes it each block keeps its times by
    itself. So a key that never pauses spreads over tasks. Rows without a time are left out.
    """
    step, size = seconds * 1_000_000, seconds * 1_000_000 * block_steps

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, block), rows in _blocks(batches):
            first, end = chain_ends(rows.column("us").to_numpy(), block * size, step)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(first), pa.string()), pa.array([block] * len(first), pa.int64()), pa.array(first), pa.array(end)], ["key", "block", "us", "end"])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for (key, block), rows in _blocks(batches):
            if now is None or key != now[0]:
                now, last = (key,), None
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([block], pa.int64()), pa.array([last], pa.int64())], ["key", "block", "last"])
            at = 0 if last is None else int(np.searchsorted(rows.column("us").to_numpy(), last + step))
            if at < rows.num_rows:
                last = rows.column("end")[at].as_py()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _blocks(batches):
            places = kept_times(rows.column("us").to_numpy(), rows.column("last")[0].as_py(), step)
            yield from rows.select(["key", "us"]).take(pa.array(places)).to_batches()

    order = ["key", "block", "us"]
    e = events.filter(F.col("ts").isNotNull()).select(F.col("key").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    e = e.select("key", F.floor(F.col("us") / size).cast("long").alias("block"), "us")
    maps = e.repartition("key", "block").sortWithinPartitions(*order).mapInArrow(ends, "key string, block long, us long, end long")
    before = maps.repartition("key").sortWithinPartitions(*order).mapInArrow(compose, "key string, block long, last long")
    told = e.join(before.withColumnsRenamed({"key": "k", "block": "b"}), F.col("key").eqNullSafe(F.col("k")) & (F.col("block") == F.col("b"))).select("key", "block", "us", "last")
    kept = told.repartition("key", "block").sortWithinPartitions(*order).mapInArrow(keep, "key string, us long")
    return kept.select(F.col("key").cast(events.schema["key"].dataType).alias("key"), F.timestamp_micros("us").alias("ts"))
