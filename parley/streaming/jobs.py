"""Structured Streaming: bucket statistics with late data, sink, dedupe, retention, throttle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from parley.operators.monitor import QUANTILES, sketch_index, sketch_quantile, sketched


SUMS = {"n": "long", "n_synthetic": "long", "latency_sum": "long", "confidence_sum": "double"}


def stats_stream(events: DataFrame, late: str = "1 hour", bucket: str = "1 minute") -> DataFrame:
    """{bucket, index, n, n_synthetic, latency_sum, confidence_sum}: sums for each exponential bucket of latencies, which merge and are a sketch of their quantiles.

    The state holds a row for each time bucket and the few hundred powers its latencies fall in;
    events later than ``late`` are dropped.
    """
    w = events.withWatermark("ts", late).groupBy(F.window("ts", bucket).alias("w"), sketch_index(F.col("latency_ms")).alias("index"))
    out = w.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_synthetic").alias("n_synthetic"), F.sum("latency_ms").alias("latency_sum"), F.sum("confidence").alias("confidence_sum"))
    return out.select(F.col("w.start").alias("bucket"), "index", *SUMS)


def _generations(spark, path: str) -> dict[str, list[int]]:
    """Day folder -> the batches that have written it, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[str, list[int]] = {}
    if fs.exists(folder):
        for day in fs.listStatus(folder):
            if (name := day.getPath().getName()).startswith("day="):
                out[name] = sorted(int(g.getPath().getName()[4:]) for g in fs.listStatus(day.getPath()) if g.getPath().getName().startswith("gen="))
    return out


def start_stats(events: DataFrame, path: str, checkpoint: str, late: str = "1 hour", bucket: str = "1 minute", trigger: dict | None = None) -> StreamingQuery:
    """Every batch rewrites the days it changed, as a generation of its own beside the one before, and drops older ones.

    So the table holds two generations of a day at most, a reader of the last one is not
    disturbed, and a batch that is run again replaces its own generation from the same one before.
    """

    def upsert(changed: DataFrame, batch: int) -> None:
        spark = changed.sparkSession
        changed = changed.withColumn("day", F.to_date("bucket")).persist()
        try:
            days = [f"day={r['day']}" for r in changed.select("day").distinct().collect()]
            if not days:
                return
            earlier = {d: [g for g in gens if g < batch] for d, gens in _generations(spark, path).items() if d in days}
            last = [f"{path}/{d}/gen={gens[-1]}" for d, gens in earlier.items() if gens]
            rows = changed.drop("day").withColumn("new", F.lit(True))
            if last:
                rows = rows.unionByName(spark.read.schema(_stored()).parquet(*last).withColumn("new", F.lit(False)))
            rows = rows.groupBy("bucket", "index").agg(F.max_by(F.struct(*SUMS), "new").alias("s")).select("bucket", "index", *(F.col(f"s.{c}").alias(c) for c in SUMS))
            out = rows.withColumns({"day": F.to_date("bucket"), "gen": F.lit(batch)})
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "gen").parquet(path)
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            for d, gens in earlier.items():
                for g in gens[:-1]:
                    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{d}/gen={g}"), True)
        finally:
            changed.unpersist()

    return stats_stream(events, late, bucket).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _stored() -> str:
    return "bucket timestamp, index int, " + ", ".join(f"{c} {t}" for c, t in SUMS.items())


def read_stats(spark, path: str, now=None, hide: str = "1 minute") -> DataFrame:
    """{bucket, n, n_synthetic, latency_sum, confidence_sum, p50, p95, p99} of the last generation of each day; with ``now``, without the open last minute."""
    last = [f"{path}/{d}/gen={gens[-1]}" for d, gens in _generations(spark, path).items() if gens]
    rows = spark.read.schema(_stored()).parquet(*last) if last else spark.createDataFrame([], _stored())
    if now is not None:
        rows = rows.filter(F.col("bucket") <= now - F.expr(f"INTERVAL {hide}"))
    return sketched(rows, "bucket").select("bucket", *SUMS, *(sketch_quantile(F.col("sketch"), q).alias(f"p{round(100 * q)}") for q in QUANTILES))


def start_sink(events: DataFrame, path: str, dead: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Events by day in small batches; a batch that fails goes to ``dead`` instead of being lost."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("day", F.to_date("ts"))
        try:
            rows.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={number}")
        except Exception:
            rows.write.mode("overwrite").json(f"{dead}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()


def dedupe_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first of each id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


class Throttle(StatefulProcessor):
    """Keeps of a key's incidents those at least ``seconds`` after the last one kept, in the order of their times.

    Rows wait in the state until the watermark has passed them, so it does not matter in which
    batch they come; a timer set for the earliest one wakes the key. A key with nothing waiting
    is forgotten once the watermark is ``seconds`` past what it kept last.
    """

    def __init__(self, seconds: int = 60) -> None:
        self.step = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")
        self.due = handle.getValueState("due", "ms long")
        self.waiting = handle.getListState("waiting", "us long")

    def _wake(self, us: int) -> None:
        ms = us // 1000 + 1
        if self.due.exists():
            if self.due.get()[0] <= ms:
                return
            self.handle.deleteTimer(self.due.get()[0])
        self.due.update((ms,))
        self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        times = [t for part in rows for t in part["us"].tolist() if t >= passed]
        if times:
            self.waiting.appendList([(t,) for t in times])
            self._wake(min(times))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        times = sorted(t for (t,) in self.waiting.get()) if self.waiting.exists() else []
        last, kept = self.last.get()[0] if self.last.exists() else None, []
        for t in times:
            if t >= passed:
                break
            if last is None or t - last >= self.step:
                kept.append(t)
                last = t
        rest = [t for t in times if t >= passed]
        self.due.clear()
        if rest:
            self.waiting.put([(t,) for t in rest])
            self._wake(rest[0])
        else:
            self.waiting.clear()
        if last is not None and (rest or last + self.step > passed):
            self.last.update((last,))
            if not rest:
                self._wake(last + self.step)
        else:
            self.last.clear()
        if kept:
            yield pd.DataFrame({"key": [key[0]] * len(kept), "us": kept})

    def close(self) -> None:
        pass


def throttle(events: DataFrame, seconds: int = 60, late: str = "1 hour") -> DataFrame:
    """{key, us} of a stream {key, ts}: what ``incident_throttle`` keeps of all rows that are not later than ``late``; needs the RocksDB state store.

    A row is kept or dropped when the watermark passes it, in the order of times.
    """
    rows = events.filter(F.col("ts").isNotNull()).withWatermark("ts", late).select("key", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("key").transformWithStateInPandas(Throttle(seconds), outputStructType="key string, us long", outputMode="append", timeMode="eventTime")


def start_retention(events: DataFrame, path: str, checkpoint: str, n: int = 50, trigger: dict | None = None) -> StreamingQuery:
    """Keeps the n ids pushed last: each batch merges its own latest n with the stored ones into a new folder."""
    order = (F.desc("ts"), F.desc("request_id"))

    def keep(batch: DataFrame, number: int) -> None:
        from parley.operators.monitor import retained_analyses

        spark = batch.sparkSession
        rows = retained_analyses(batch, n)
        if number:
            rows = retained_analyses(rows.unionByName(spark.read.parquet(f"{path}/batch={number - 1}")), n)
        rows.orderBy(*order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
