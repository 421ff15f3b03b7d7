"""Queries on monitoring, feed and streaming."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import events as ev
from parley.operators import monitor as mo
from parley.plans.q_intervals import rounding
from parley.plans.registry import query, rounded, shared
from parley.plans.views import oracle, recursive, view
from parley.streaming import jobs

NOW = "2024-01-20 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "detections")


def as_us(df: DataFrame, name: str) -> DataFrame:
    """A timestamp as microseconds, alike in both engines."""
    return df.withColumn(name, F.unix_micros(name))


_Q = "quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95, quantile_cont(latency_ms, 0.99) AS p99"
STATS = f"""s AS (SELECT date_trunc('minute', ts) AS bucket, count(*) AS n, count(*) FILTER (WHERE is_synthetic) AS n_synthetic, {_Q}, avg(confidence) AS confidence
 FROM detections GROUP BY 1)"""


@query(oracle("detections", f"{STATS} SELECT epoch_us(bucket) AS bucket, n, n_synthetic, {rounding('p50 p95 p99 confidence')} FROM s"))
def stats_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(as_us(mo.stats_1m(detections(spark, sf_dir)), "bucket"))


_BASE = math.log(1.01 / 0.99)


def _sketched(rows: str, bucket: str) -> str:
    """DuckDB's tables i, c, k and p: the quantiles of latency_ms in exponential buckets."""
    pick = ", ".join(f"min(CASE WHEN seen>{q}e0*(total-1) THEN CASE WHEN i=-1000000 THEN 0e0 ELSE exp(i*{_BASE!r}e0)*2/({1.01 / 0.99!r}e0+1) END END) AS {n}" for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")))
    return f"""i AS (SELECT {bucket} AS bucket, CASE WHEN latency_ms>0 THEN CAST(ceil(ln(latency_ms)/{_BASE!r}e0) AS INT)
 WHEN latency_ms IS NOT NULL THEN -1000000 END AS i FROM {rows}),
c AS (SELECT bucket, i, count(*) AS n FROM i WHERE i IS NOT NULL GROUP BY bucket, i),
k AS (SELECT bucket, i, sum(n) OVER (PARTITION BY bucket ORDER BY i) AS seen, sum(n) OVER (PARTITION BY bucket) AS total FROM c), p AS (SELECT bucket, {pick}
 FROM k GROUP BY bucket)"""


@query(oracle("detections", f"""{_sketched('detections', "date_trunc('hour', ts)")},
 t AS (SELECT date_trunc('hour', ts) AS bucket, count(*) AS n, count(*) FILTER (WHERE is_synthetic) AS n_synthetic, avg(confidence) AS confidence
 FROM detections GROUP BY 1)
SELECT epoch_us(t.bucket) AS bucket, n, n_synthetic, {rounding('p50 p95 p99 confidence')} FROM t LEFT JOIN p ON p.bucket=t.bucket"""))
def stats_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(as_us(mo.stats_readable(mo.stats_1m(detections(spark, sf_dir), "1 hour", sketch=True)), "bucket"))


@query(oracle("detections", f"""{STATS}, h AS (SELECT date_trunc('hour', bucket) AS bucket, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_synthetic) AS BIGINT) AS n_synthetic, avg(p50) AS p50,
 avg(p95) AS p95, avg(p99) AS p99, sum(confidence*n)/sum(n) AS confidence FROM s WHERE bucket > TIMESTAMP '{NOW}' - INTERVAL 7 DAY
 AND bucket <= TIMESTAMP '{NOW}' GROUP BY 1) SELECT epoch_us(bucket) AS bucket, n, n_synthetic, {rounding('p50 p95 p99 confidence', 7)} FROM h"""))
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(as_us(mo.history(mo.stats_1m(detections(spark, sf_dir)), "7d", "1h", now()), "bucket"), 7)


_RECENT = f"(SELECT * FROM detections WHERE date_trunc('minute', ts) > TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND date_trunc('minute', ts) <= TIMESTAMP '{NOW}')"


@query(oracle("detections", f"""{_sketched(_RECENT, "date_trunc('hour', ts)")},
 t AS (SELECT date_trunc('hour', ts) AS bucket, count(*) AS n, count(*) FILTER (WHERE is_synthetic) AS n_synthetic, avg(confidence) AS confidence FROM {_RECENT}
 GROUP BY 1)
SELECT epoch_us(t.bucket) AS bucket, n, n_synthetic, {rounding('p50 p95 p99 confidence')} FROM t LEFT JOIN p ON p.bucket=t.bucket"""))
def history_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(as_us(mo.history_exact(mo.stats_1m(detections(spark, sf_dir), sketch=True), "7d", "1h", now()), "bucket"))


@query(oracle("detections", """r AS (SELECT route, outcome, CASE WHEN outcome='fallback' THEN 0 ELSE latency_ms END AS ms FROM detections)
 SELECT route, outcome, count(*) AS n, CAST(sum(CASE WHEN outcome='fallback' THEN 1
 ELSE 0 END) AS BIGINT) AS fallbacks, round(quantile_cont(ms, 0.5) FILTER (WHERE ms<=10000), 6) + 0e0 AS p50, round(quantile_cont(ms, 0.95) FILTER (WHERE
 ms<=10000), 6) + 0e0 AS p95, round(quantile_cont(ms, 0.99) FILTER (WHERE ms<=10000), 6) + 0e0 AS p99 FROM r GROUP BY ROLLUP (route, outcome)"""))
def route_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mo.route_metrics(detections(spark, sf_dir)))


@query(oracle("detections", """SELECT route, round(quantile_cont(latency_ms, 0.5)*k, 6) + 0e0 AS p50, round(quantile_cont(latency_ms, 0.95)*k, 6) + 0e0 AS p95,
 round(quantile_cont(latency_ms, 0.99)*k, 6) + 0e0 AS p99 FROM (SELECT *, CASE WHEN max(latency_ms) OVER (PARTITION BY route) < 100 THEN 1e3 ELSE 1e0 END AS k
 FROM detections) GROUP BY route, k"""))
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mo.latency_percentiles(detections(spark, sf_dir).withColumn("latency", F.col("latency_ms")), ("route",)))


@query(oracle("detections", """q AS (SELECT quantile_cont(latency_ms, 0.99) AS p99, count(*) FILTER (WHERE outcome<>'ok') AS non_200 FROM detections)
 SELECT round(p99, 6) + 0e0 AS p99, non_200, p99<=5000 AS p99_ok, TRUE AS rss_ok, non_200=0 AS status_ok, p99<=5000 AND non_200=0 AS passed FROM q"""))
def load_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = detections(spark, sf_dir).select(F.when(F.col("outcome") == "ok", 200).otherwise(500).alias("status"), "latency_ms")
    return rounded(mo.load_gates(log, rss_mb=135.0))


IDS = """f AS (SELECT *, CASE WHEN call_id<>'' THEN call_id ELSE concat('evt-', CAST(sum(CASE WHEN call_id='' THEN 1
 ELSE 0 END) OVER (ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS VARCHAR)) END AS id FROM detections)"""
LATEST = f"{IDS}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY ts DESC, request_id DESC) AS rn FROM f)"


def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.assign_event_id(detections(spark, sf_dir))


@query(oracle("detections", f"{IDS} SELECT request_id, id FROM f"))
def assign_event_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(spark, sf_dir).select("request_id", "id")


@query(oracle("detections", "SELECT request_id, epoch_us(ts) AS ts FROM detections ORDER BY detections.ts DESC, request_id DESC LIMIT 50"))
def feed_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_us(mo.feed_recent(detections(spark, sf_dir)).select("request_id", "ts"), "ts")


@query(oracle("detections", f"{LATEST} SELECT id, request_id FROM k WHERE rn=1 ORDER BY ts DESC, request_id DESC LIMIT 50"))
def retained_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.retained_analyses(identified(spark, sf_dir)).select("id", "request_id")


@query(oracle("detections", f"{LATEST} SELECT id, request_id FROM k WHERE rn=1 ORDER BY ts DESC, request_id DESC LIMIT 500"))
def dedupe_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.dedupe_feed(identified(spark, sf_dir)).select("id", "request_id")


@query(oracle("detections", f"""{LATEST}, t AS (SELECT id, request_id FROM k WHERE rn=1 ORDER BY ts DESC, request_id DESC LIMIT 50), i AS (SELECT DISTINCT id FROM f)
 SELECT i.id, t.request_id, t.id IS NOT NULL AS found FROM i LEFT JOIN t ON i.id=t.id"""))
def lookup_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = identified(spark, sf_dir)
    return mo.lookup_analysis(mo.retained_analyses(e), e.select("id").distinct()).select("id", "request_id", "found")


@query(oracle("detections", f"""{IDS} SELECT id, epoch_us(ts) AS ts_us, is_synthetic, round(CASE WHEN is_synthetic THEN confidence ELSE 1-confidence END, 6) + 0e0 AS p, CASE
 WHEN semantic_available THEN 'true' END AS semantic, model_version FROM f"""))
def adapt_feed_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mo.adapt_feed_event(identified(spark, sf_dir)).select("id", "ts_us", "is_synthetic", "p", F.col("signals.semantic").cast("string").alias("semantic"), "model_version"))


@query(oracle("detections", """SELECT count(*) AS n, round(avg(CASE WHEN is_synthetic THEN 1e0
 ELSE 0e0 END), 6) + 0e0 AS synthetic_rate, count(*) FILTER (WHERE abs(confidence-0.5e0)<=0.2e0) AS review_count, round(avg(CASE
 WHEN semantic_available THEN 0e0 ELSE 1e0 END), 6) + 0e0 AS degradation_rate FROM detections"""))
def feed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mo.feed_stats(detections(spark, sf_dir)))


@query(oracle("detections", f"""SELECT count(*) AS waiting, CAST(epoch(TIMESTAMP '{NOW}') - floor(epoch(min(ts))) AS BIGINT) AS oldest_wait_s FROM detections
 WHERE abs(confidence-0.6e0)<=0.2e0"""))
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.review_summary(detections(spark, sf_dir), 0.6, now())


@query(oracle("detections", f"""e AS (SELECT * FROM detections WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{NOW}'),
q AS (SELECT count(*) AS processed, count(*) FILTER (WHERE is_synthetic) AS flagged, avg(CASE WHEN confidence>=0.7e0 AND is_synthetic THEN 1e0
 ELSE 0e0 END) AS share_synthetic, avg(CASE WHEN confidence<0.7e0 THEN 1e0 ELSE 0e0 END) AS share_review,
 avg(CASE WHEN confidence>=0.7e0 AND NOT is_synthetic THEN 1e0 ELSE 0e0 END) AS share_verified, quantile_cont(latency_ms, 0.95) AS p95, avg(CASE
 WHEN semantic_available THEN 0e0 ELSE 1e0 END) AS degradation_rate FROM e)
SELECT processed, flagged, {rounding('share_synthetic share_review share_verified p95 degradation_rate')} FROM q"""))
def exec_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mo.exec_summary(detections(spark, sf_dir), now()))


@query(oracle("detections", """p AS (SELECT route, count(*) AS volume, avg(CASE WHEN is_synthetic THEN 1e0 ELSE 0e0 END) AS share FROM detections GROUP BY route),
 a AS (SELECT *, volume*share*0.5e0 AS attacks FROM p)
SELECT route, round(attacks, 4) + 0e0 AS attacks, round(attacks*0.88e0, 4) + 0e0 AS caught, round(attacks*0.88e0*1200, 4) + 0e0 AS saved, round(volume*0.02e0,
 4) + 0e0 AS cost, round(attacks*0.88e0*1200-volume*0.02e0, 4) + 0e0 AS net FROM a"""))
def business_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = detections(spark, sf_dir).groupBy("route").agg(F.count(F.lit(1)).alias("volume"), F.avg(F.col("is_synthetic").cast("double")).alias("share"))
    params = params.withColumns({"fraud": F.lit(0.5), "recall": F.lit(0.88), "loss": F.lit(1200.0), "unit_cost": F.lit(0.02)})
    return rounded(mo.business_case(params).select("route", "attacks", "caught", "saved", "cost", "net"), 4)


def _incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).filter("is_synthetic").select(F.col("route").alias("key"), "ts")


@query(oracle("detections", """e AS (SELECT route AS key, epoch_us(ts) AS us FROM detections WHERE is_synthetic), l AS (SELECT key, list(us ORDER BY us) AS ts FROM e GROUP BY key),
k AS (SELECT key, list_reduce(ts, lambda a, t: CASE WHEN t - (a % 10000000000000000) >= 3600000000 THEN t ELSE a END) AS last_kept FROM l)
 SELECT key, last_kept AS us FROM k"""))
def incident_throttle_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last incident kept per key, at most one an hour."""
    return as_us(mo.incident_throttle(_incidents(spark, sf_dir), 3600), "ts").groupBy("key").agg(F.max("ts").alias("us"))


@query(recursive(oracle("detections", """e AS (SELECT route AS key, epoch_us(ts) AS us FROM detections WHERE is_synthetic),
k AS (SELECT key, min(us) AS us FROM e GROUP BY key UNION ALL SELECT k.key, min(e.us) FROM k JOIN e ON e.key=k.key AND e.us>=k.us+3600000000 GROUP BY k.key)
 SELECT key, us AS ts FROM k""")))
def incident_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_us(mo.incident_throttle(_incidents(spark, sf_dir), 3600), "ts")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream of detection events; the tables are not in time order, so the watermark in these queries is long."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = spark.readStream.schema(source.schema).option("pathGlobFilter", "*").parquet(f"{sf_dir}/events.parquet*")
    e = raw.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("ts", F.col("event_id").cast("string").alias("request_id"), F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("id"), (F.col("event_type") == "error").alias("is_synthetic"), (0.5 + (F.col("event_id") * 37) % 500 / 1e3).alias("confidence"), F.floor(F.col("value") * 10).cast("int").alias("latency_ms"), F.col("event_type").alias("route"))


_LATENCIES = "(SELECT ts, event_type='error' AS is_synthetic, CAST(floor(value*10e0) AS INT) AS latency_ms, 0.5e0+((event_id*37)%500)/1e3 AS confidence FROM events)"


@query(f"""WITH {_sketched(_LATENCIES, "date_trunc('hour', ts)")},
 t AS (SELECT date_trunc('hour', ts) AS bucket, count(*) AS n, count(*) FILTER (WHERE is_synthetic) AS n_synthetic, CAST(sum(latency_ms) AS BIGINT) AS
 latency_sum, sum(confidence) AS confidence_sum FROM {_LATENCIES} GROUP BY 1)
SELECT epoch_us(t.bucket) AS bucket, n, n_synthetic, latency_sum, {rounding('confidence_sum p50 p95 p99')} FROM t LEFT JOIN p ON p.bucket=t.bucket""")
def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = shared(spark)
    jobs.start_stats(_stream(spark, sf_dir), f"{base}/stats", f"{base}/state", late="60 days", bucket="1 hour").awaitTermination()
    return rounded(as_us(jobs.read_stats(spark, f"{base}/stats"), "bucket"))


@query("SELECT CAST(event_id AS VARCHAR) AS request_id, CAST(floor(value*10e0) AS INT) AS latency_ms FROM events")
def stream_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = shared(spark)
    jobs.start_sink(_stream(spark, sf_dir), f"{base}/out", f"{base}/dead", f"{base}/state", {"availableNow": True}).awaitTermination()
    return spark.read.parquet(f"{base}/out/batch=*").select("request_id", "latency_ms")


@query("""WITH k AS (SELECT concat('u-', CAST(user_id AS VARCHAR)) AS id, CAST(event_id AS VARCHAR) AS request_id, ts, ROW_NUMBER() OVER (PARTITION BY user_id
 ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS rn FROM events) SELECT id, request_id FROM k WHERE rn=1 ORDER BY ts DESC, request_id DESC LIMIT 50""")
def stream_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = shared(spark)
    q = jobs.start_retention(_stream(spark, sf_dir), f"{base}/kept", f"{base}/state")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/kept/batch={q.lastProgress['batchId'] if q.lastProgress else 0}").select("id", "request_id")


@query("SELECT DISTINCT concat('u-', CAST(user_id AS VARCHAR)) AS id FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = shared(spark)
    q = jobs.dedupe_stream(_stream(spark, sf_dir), "60 days").select("id").writeStream.format("parquet").option("path", f"{base}/ids").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/ids").select("id")


@query(f"""WITH d AS (SELECT date_trunc('hour', ts) AS b, CAST(floor(value*10e0) AS INT) AS l FROM events)
 SELECT epoch_us(b) AS bucket, count(*) AS n, CAST(sum(l) AS BIGINT) AS latency_sum FROM d WHERE b <= TIMESTAMP '{NOW}' - INTERVAL 1 HOUR GROUP BY b""")
def stream_late_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader sees at NOW: late rows are folded into their buckets, the open one is hidden."""
    base = shared(spark)
    jobs.start_stats(_stream(spark, sf_dir), f"{base}/stats", f"{base}/state", late="60 days", bucket="1 hour").awaitTermination()
    return as_us(jobs.read_stats(spark, f"{base}/stats", now(), "1 hour"), "bucket").select("bucket", "n", "latency_sum")


@query(recursive("""WITH e AS (SELECT concat('u-', CAST(user_id AS VARCHAR)) AS key, epoch_us(ts) AS us FROM events WHERE event_type='error'),
k AS (SELECT key, min(us) AS us FROM e GROUP BY key UNION ALL SELECT k.key, min(e.us) FROM k JOIN e ON e.key=k.key AND e.us>=k.us+3600000000 GROUP BY k.key)
 SELECT key, us FROM k"""))
def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incidents of every user that a stream keeps, at most one an hour; a last row far ahead lets the watermark pass all others."""
    base, provider = shared(spark), "spark.sql.streaming.stateStore.providerClass"
    spark.sql("SELECT '' AS key, TIMESTAMP '2100-01-01 00:00:00' AS ts").write.parquet(f"{base}/end")
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = _stream(spark, sf_dir).filter("is_synthetic").select(F.col("id").alias("key"), "ts")
        end = spark.readStream.schema("key string, ts timestamp").parquet(f"{base}/end")
        kept = jobs.throttle(rows.union(end), 3600, "60 days")
        kept.writeStream.format("parquet").option("path", f"{base}/kept").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema("key string, us long").parquet(f"{base}/kept").filter("key <> ''")
