"""Streaming forms: ingest with idempotent batches, delayed redelivery, failure routing, a cache with expiry, a running summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.operations import RETRY_SECONDS, failed_status, quality_summary, route_failures


def trace_stream(traces: DataFrame, window: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """The quality summary over a trace feed; with a window, per window of created_at with a watermark."""
    if window is None:
        return quality_summary(traces)
    timed = traces.withWatermark("created_at", delay).withColumn("window", F.window("created_at", window))
    return quality_summary(timed, "window")


def ingest_stream(jobs: DataFrame, base: str, catalogue: Callable[[], DataFrame], ingest: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str):
    """Run `ingest_batch` on each micro-batch of jobs."""
    return jobs.writeStream.foreachBatch(lambda rows, batch_id: ingest_batch(rows, batch_id, base, catalogue, ingest)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def ingest_batch(jobs: DataFrame, batch_id: int, base: str, catalogue: Callable[[], DataFrame], ingest: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> None:
    """One batch of jobs, written below `base`, each table in the batch's own folder: running a batch again changes nothing.

    jobs: job_id, doc_id, operation, previous_status, retry_count, at. catalogue() reads the documents that exist now
    (doc_id, ...). ingest(jobs of existing documents) gives chunks (doc_id, chunk_index, text) and failures (doc_id,
    error_class, http_status, error). Jobs without a document are skipped; where a document went meanwhile, its chunks are
    not published. Of several jobs of a document in a batch the last one counts. Transient failures go to `retry`, due 30 s
    later; others, and those out of retries, to `dead`, and set the status.
    """
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch_id}")
    get = lambda name: jobs.sparkSession.read.parquet(f"{base}/{name}/batch={batch_id}")
    last = jobs.groupBy("doc_id").agg(F.max_by(F.struct(*jobs.columns), F.struct("at", "job_id")).alias("j")).select("j.*")
    put(last.join(catalogue().select("doc_id"), "doc_id", "left_semi"), "taken")
    taken = get("taken")
    chunks, failures = ingest(taken)
    put(chunks, "made")
    put(taken.join(failures, "doc_id").withColumn("failed_at", F.col("at")), "failed")
    put(get("made").join(get("failed"), "doc_id", "left_anti").join(catalogue().select("doc_id"), "doc_id", "left_semi"), "chunks")
    routed = route_failures(get("failed"))
    put(routed.where("route = 'retry'"), "retry")
    put(routed.where("route = 'dlq'"), "dead")
    n = get("chunks").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    ready = taken.join(n, "doc_id").select("doc_id", "job_id", "operation", "previous_status", F.lit("READY").alias("status"), F.col("chunk_count").cast("int"), F.lit(None).cast("string").alias("error"), F.col("at").alias("event_time"))
    dead = get("dead").select("doc_id", "job_id", "operation", "previous_status", failed_status(F.col("operation"), F.col("previous_status")).alias("status"), F.lit(None).cast("int").alias("chunk_count"), F.concat(F.lit("ingest failed: "), F.coalesce("error", F.lit(""))).alias("error"), F.col("at").alias("event_time"))
    put(ready.union(dead.withColumn("error", F.left("error", F.lit(2000)))), "status")


def published(spark: SparkSession, base: str) -> DataFrame:
    """The chunks that readers see: those of each document's last batch that made it READY."""
    live = spark.read.parquet(f"{base}/status").where("chunk_count IS NOT NULL").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{base}/chunks").join(live, ["doc_id", "batch"], "left_semi").drop("batch")


class Cache(StatefulProcessor):
    """One key of a cache: its payload until it expires."""

    def init(self, handle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "payload string, expires_at timestamp")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        out = []
        steps = pd.concat(list(rows)).assign(order=lambda x: x["op"].map({"delete": 0, "get": 1, "set": 2})).sort_values(["at", "order"], kind="stable")
        entry = self.entry.get() if self.entry.exists() else None
        for r in steps.itertuples():
            if r.op == "set" and r.ttl > 0:
                entry = (r.payload, r.at + pd.Timedelta(seconds=int(r.ttl)))
                self.handle.registerTimer(int(entry[1].timestamp() * 1000))
            elif r.op == "delete":
                entry = None
            elif r.op == "get":
                hit = entry is not None and r.at < pd.Timestamp(entry[1])
                out.append((key[0], r.at, entry[0] if hit else None, hit))
        if entry is None:
            self.entry.clear()
        else:
            self.entry.update((entry[0], pd.Timestamp(entry[1]).to_pydatetime()))
        yield pd.DataFrame(out, columns=["key", "at", "payload", "cache_hit"]).astype({"cache_hit": bool})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        if self.entry.exists() and pd.Timestamp(self.entry.get()[1]).timestamp() * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype="object"), "at": pd.Series([], dtype="datetime64[ns]"), "payload": pd.Series([], dtype="object"), "cache_hit": pd.Series([], dtype="bool")})

    def close(self) -> None:
        pass


def answer_cache(feed: DataFrame, delay: str = "1 minute") -> DataFrame:
    """key, at, payload, cache_hit of every `get` of a feed (key, op, at, payload, ttl): a keyed state with expiry.

    op is get, set or delete; a set with ttl (seconds) <= 0 stores nothing; a get at the time of expiry or later misses. In
    one batch the steps of a key run in order of `at` (delete, get, set where it is equal). Entries leave the state when the
    watermark passes their expiry. Needs the RocksDB state store.
    """
    timed = feed.withColumns({"ttl": F.coalesce("ttl", F.lit(0)), "payload": F.coalesce("payload", F.lit(""))}).withWatermark("at", delay)
    return timed.groupBy("key").transformWithStateInPandas(Cache(), "key string, at timestamp, payload string, cache_hit boolean", "Append", "EventTime")


class Delay(StatefulProcessor):
    """A job that waits until its time has come."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "job string")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        for b in rows:
            if len(b):
                self.job.update((b["job"].iloc[-1],))
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        yield pd.DataFrame({"job_id": [], "job": []}, dtype="object")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        found = [self.job.get()[0]] if self.job.exists() else []
        self.job.clear()
        yield pd.DataFrame({"job_id": [key[0]] * len(found), "job": found}, dtype="object")

    def close(self) -> None:
        pass


def redelivered(failed: DataFrame, seconds: float = RETRY_SECONDS) -> DataFrame:
    """Jobs of the feed of retries (job_id, ...), each once its delay has passed: a delayed queue as keyed state with timers.

    A job that fails again while it waits is delivered once, as it came last. Needs the RocksDB state store.
    """
    rows = failed.select(F.col("job_id").cast("string").alias("job_id"), F.to_json(F.struct(*failed.columns)).alias("job"))
    out = rows.groupBy("job_id").transformWithStateInPandas(Delay(int(seconds * 1000)), "job_id string, job string", "Append", "ProcessingTime")
    return out.select(F.from_json("job", failed.schema).alias("j")).select("j.*")


def failure_stream(jobs: DataFrame, retry_path: str, dead_path: str, checkpoint: str):
    """Split failed jobs into a retry and a dead-letter table."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        routed = route_failures(rows).persist()
        routed.where("route = 'retry'").write.mode("overwrite").parquet(f"{retry_path}/batch={batch_id}")
        routed.where("route = 'dlq'").write.mode("overwrite").parquet(f"{dead_path}/batch={batch_id}")
        routed.unpersist()

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def due(retries: DataFrame, now) -> DataFrame:
    """Retries that may run: their delay has passed."""
    return retries.where(F.col("not_before") <= now)
