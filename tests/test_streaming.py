"""Streams against their batch forms: sketches, late rows, bounded storage, throttling in event time and by blocks."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import monitor
from parley.streaming import jobs

EVENTS = "ts timestamp, is_synthetic boolean, confidence double, latency_ms int"


def put(spark, path, rows, schema, key="ts"):
    names = [c.split()[0] for c in schema.split(", ")]
    plain = spark.createDataFrame(rows, schema.replace(f"{key} timestamp", f"{key} string"))
    plain.select(*(F.col(c).cast("timestamp") if c == key else F.col(c) for c in names)).coalesce(1).write.mode("append").parquet(path)


def at(seconds):
    return f"2024-01-01 {seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"


def test_sketch_is_within_its_error(spark):
    rng = random.Random(2)
    values = {0: [rng.randrange(1, 10**6) for _ in range(500)], 1: [rng.choice([0, -5, 7]) for _ in range(40)], 2: [1], 3: [None, None], 4: [0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k int, v int")
    parts = df.groupBy("k", monitor.sketch_index(F.col("v")).alias("index")).agg(F.count(F.lit(1)).alias("n"))
    got = monitor.sketched(parts, "k").select("k", "n", F.size("sketch").alias("size"), *(monitor.sketch_quantile(F.col("sketch"), q).alias(f"q{q}") for q in (0, 0.5, 0.95, 0.99, 1)))
    for r in got.collect():
        own = sorted(max(v, 0) for v in values[r["k"]] if v is not None)
        assert r["n"] == len(values[r["k"]]) and r["size"] <= 700
        for q in (0, 0.5, 0.95, 0.99, 1):
            if own:
                assert r[f"q{q}"] == pytest.approx(own[math.floor(q * (len(own) - 1))], rel=0.0101)
            else:
                assert r[f"q{q}"] is None


def test_stream_quantiles_late_rows_and_storage(spark, tmp_path):
    """Three runs with late rows: p50, p95 and p99 within the sketch's error, two generations of a day at most, a batch run twice counts once."""
    rng, seen = random.Random(3), []
    source, path = f"{tmp_path}/in", f"{tmp_path}/stats"
    for run in range(4):
        rows = [(at(rng.randrange(run * 300, run * 300 + 900)), rng.random() < 0.5, 0.5, rng.randrange(1, 5000)) for _ in range(400)]
        seen += rows
        put(spark, source, rows, EVENTS)
        jobs.start_stats(spark.readStream.schema(EVENTS).parquet(source), path, f"{tmp_path}/state").awaitTermination()
        assert all(len(gens) <= 2 for gens in jobs._generations(spark, path).values())
    got = {r["bucket"].strftime("%H:%M"): r for r in jobs.read_stats(spark, path).collect()}
    by = {}
    for ts, synthetic, confidence, ms in seen:
        by.setdefault(ts[11:16], []).append((ms, synthetic, confidence))
    assert set(got) == set(by)
    for k, rows in by.items():
        ms = sorted(m for m, _, _ in rows)
        assert (got[k]["n"], got[k]["n_synthetic"], got[k]["latency_sum"], got[k]["confidence_sum"]) == (len(rows), sum(s for _, s, _ in rows), sum(ms), pytest.approx(0.5 * len(rows)))
        for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
            assert got[k][name] == pytest.approx(ms[math.floor(q * (len(ms) - 1))], rel=0.0101)
    assert jobs.read_stats(spark, f"{tmp_path}/none").count() == 0


def kept(rows, seconds):
    """(key, second) of what a throttle keeps of all rows in the order of their times."""
    last, out = {}, []
    for key, t in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if key not in last or t - last[key] >= seconds:
            last[key] = t
            out.append((key, t))
    return sorted(out, key=str)


def test_throttle_of_batches_out_of_order(spark, tmp_path):
    """What a stream keeps of three batches, the second before the first in time, is what the batch form keeps of all rows."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, rows = random.Random(5), []
    try:
        for begin in (1000, 0, 2500):
            part = [(rng.choice("abc"), begin + rng.randrange(1500)) for _ in range(60)] + ([("idle", 7)] if not begin else [])
            rows += part
            put(spark, f"{tmp_path}/in", [(k, at(t)) for k, t in part], "key string, ts timestamp")
            source = spark.readStream.schema("key string, ts timestamp").parquet(f"{tmp_path}/in")
            run = lambda s: jobs.throttle(s, 60, "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
            run(source)
        put(spark, f"{tmp_path}/in", [("end", "2100-01-01 00:00:00")], "key string, ts timestamp")
        run(source)
        out = spark.read.schema("key string, us long").parquet(f"{tmp_path}/out").filter("key <> 'end'")
        base = spark.sql("SELECT unix_micros(TIMESTAMP '2024-01-01 00:00:00') AS t").first()["t"]
        assert sorted(((r["key"], (r["us"] - base) // 1_000_000) for r in out.collect()), key=str) == kept(rows, 60)
    finally:
        spark.conf.set(provider, before)


@pytest.mark.parametrize("steps", [1, 2, 7, 64])
def test_throttle_by_blocks(spark, steps):
    """Dense and sparse keys, null keys, rows at one time, times before 1970: the same whatever the blocks."""
    rng = random.Random(steps)
    rows = [(rng.choice(["dense", "dense", "dense", "sparse", None]), rng.randrange(-2000, 4000)) for _ in range(1500)]
    rows = [r for r in rows if r[0] != "sparse" or r[1] % 7 == 0] + [("dense", 5)] * 3
    df = spark.createDataFrame(rows, "key string, s long").selectExpr("key", "timestamp_seconds(s) AS ts").repartition(3)
    got = sorted(map(tuple, monitor.incident_throttle(df.unionByName(spark.sql("SELECT 'dense' AS key, CAST(NULL AS TIMESTAMP) AS ts")), 60, steps).selectExpr("key", "unix_seconds(ts)").collect()), key=str)
    assert got == kept(rows, 60)


def test_chain_ends():
    rng = random.Random(9)
    for _ in range(200):
        begin, step = rng.randrange(-50, 50), rng.randrange(1, 9)
        us = np.array(sorted(begin + rng.randrange(40) for _ in range(rng.randrange(1, 30))))
        first, end = monitor.chain_ends(us, begin, step)
        for last in [None, *range(begin - step - 3, begin)]:
            places = monitor.kept_times(us, last, step)
            k = 0 if last is None else int(np.searchsorted(first, last + step))
            assert (us[places[-1]] if len(places) else None) == (end[k] if k < len(first) else None)


def test_a_key_that_never_pauses_spreads(spark):
    """The blocks of one dense key are dealt to all tasks, and what is composed in one task is a small part of it."""
    us = np.arange(0, 40_000) * 50_000  # twenty a second
    first, _ = monitor.chain_ends(us[: 64 * 60 * 20], 0, 60_000_000)
    assert len(first) <= 60 * 20 + 1
    df = spark.range(40_000).selectExpr("'k' AS key", "timestamp_micros(id * 50000) AS ts")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # so little data would go to one task
    try:
        n = [r["count"] for r in monitor.incident_throttle(df, 1, 8).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
    finally:
        spark.conf.unset(coalesce)
    assert sum(n) == 2000 and len(n) == 4 and max(n) < 900


def test_generations_of_missing_folders(spark, tmp_path):
    assert jobs._generations(spark, f"{tmp_path}/x") == {}
    os.makedirs(f"{tmp_path}/y/day=2024-01-01/gen=3")
    assert jobs._generations(spark, f"{tmp_path}/y") == {"day=2024-01-01": [3]}
