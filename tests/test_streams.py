"""Streams on small feeds: cache expiry, redelivery after a delay, ingest batches that may run twice."""

import json
import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators import chunking
from plumbline.streaming import streams

T0 = datetime(2026, 1, 1, 12)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(PROVIDER)


def put(path, name, rows):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/.{name}", "w") as f:
        f.write("\n".join(map(json.dumps, rows)))
    os.rename(f"{path}/.{name}", f"{path}/{name}")


def drain(df, out, checkpoint):
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)


def test_cache_entries_expire(rocks, tmp_path):
    feed, out, check = (str(tmp_path / x) for x in ("feed", "out", "check"))
    at = lambda s: (T0 + timedelta(seconds=s)).isoformat()
    step = lambda key, op, s, payload=None, ttl=None: {"key": key, "op": op, "at": at(s), "payload": payload, "ttl": ttl}
    stream = lambda: streams.answer_cache(rocks.readStream.schema("key string, op string, at timestamp, payload string, ttl int").json(feed))
    put(feed, "1.json", [step("a", "get", 0), step("a", "set", 1, '{"answer":"x"}', 100), step("a", "get", 50), step("b", "set", 1, "y", 0), step("b", "get", 2), step("c", "set", 1, "z", -5), step("c", "get", 2), step("d", "set", 1, "w", 1000), step("d", "delete", 2), step("d", "get", 3)])
    drain(stream(), out, check)
    put(feed, "2.json", [step("a", "get", 100), step("a", "get", 101), step("a", "set", 102, "new", 10_000), step("e", "set", 103, "e", 5)])
    drain(stream(), out, check)
    put(feed, "3.json", [step("a", "get", 5000), step("e", "get", 5000)])
    drain(stream(), out, check)
    got = {(r.key, (r.at - T0).total_seconds()): (r.cache_hit, r.payload) for r in rocks.read.parquet(out).collect()}
    assert got == {("a", 0): (False, None), ("a", 50): (True, '{"answer":"x"}'), ("b", 2): (False, None), ("c", 2): (False, None), ("d", 3): (False, None), ("a", 100): (True, '{"answer":"x"}'), ("a", 101): (False, None), ("a", 5000): (True, "new"), ("e", 5000): (False, None)}


def test_failed_jobs_come_back_after_their_delay(rocks, tmp_path):
    feed, out, check = (str(tmp_path / x) for x in ("feed", "out", "check"))
    put(feed, "1.json", [{"job_id": 1, "doc_id": 7, "retry_count": 1}, {"job_id": 2, "doc_id": 8, "retry_count": 2}])
    df = streams.redelivered(rocks.readStream.schema("job_id long, doc_id long, retry_count int").json(feed), seconds=6)
    began = time.time()
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(processingTime="1 second").start()
    try:
        got = []
        while len(got) < 2 and time.time() - began < 90:
            time.sleep(1)
            try:
                got = sorted(map(tuple, rocks.read.schema("job_id long, doc_id long, retry_count int").parquet(out).collect()))
            except Exception:  # nothing written yet
                got = []
        assert got == [(1, 7, 1), (2, 8, 2)] and time.time() - began >= 6
    finally:
        q.stop()


def test_ingest_batches_may_run_twice(spark, tmp_path):
    base, calls = str(tmp_path / "base"), []
    long = "Madde metni burada yer alir ve yeterince uzundur; cunku kisa parcalar atilir, uzun olanlar kalir. " * 2
    texts = spark.createDataFrame([(1, long), (2, long), (3, long), (4, long), (6, long)], "doc_id long, text string")
    gone = set()

    def catalogue():
        return texts.where(~F.col("doc_id").isin(sorted(gone) or [-1]))

    def ingest(jobs):
        calls.append(1)
        pages = jobs.join(texts, "doc_id").select("doc_id", F.lit(1).alias("page_number"), "text")
        bad = jobs.where("doc_id IN (2, 4, 6)").select("doc_id", F.when(F.col("doc_id") == 2, "SocketTimeoutException").otherwise("BadFormat").alias("error_class"), F.lit(None).cast("int").alias("http_status"), F.lit("boom").alias("error"))
        chunks = chunking.chunk_documents(pages).select("doc_id", "chunk_index", "text")
        if len(calls) == 1:
            gone.add(3)  # deleted while it was read
        return chunks, bad

    schema = "job_id long, doc_id long, operation string, previous_status string, retry_count int, at timestamp"
    jobs = spark.createDataFrame([(10, 1, "UPLOAD", None, 0, T0), (11, 2, "UPLOAD", None, 0, T0), (12, 3, "UPLOAD", None, 0, T0), (13, 4, "REINDEX", "READY", 0, T0), (14, 5, "UPLOAD", None, 0, T0), (15, 6, "UPLOAD", "PROCESSING", 3, T0)], schema)

    def state():
        read = lambda name, *c: sorted(map(tuple, spark.read.parquet(f"{base}/{name}").select(*c).collect()), key=str)
        live = sorted(map(tuple, streams.published(spark, base).select("doc_id", "chunk_index", "text").collect()))
        return read("status", "doc_id", "status", "chunk_count", "error"), read("retry", "doc_id", "retry_count", "not_before"), read("dead", "doc_id", "retry_count"), live

    streams.ingest_batch(jobs, 0, base, catalogue, ingest)
    once = state()
    assert once[0] == [(1, "READY", 1, None), (4, "READY", None, "ingest failed: boom"), (6, "FAILED", None, "ingest failed: boom")]
    assert once[1] == [(2, 1, T0 + timedelta(seconds=30))] and once[2] == [(4, 0), (6, 3)] and {r[0] for r in once[3]} == {1}
    streams.ingest_batch(jobs, 0, base, catalogue, ingest)
    assert state() == once
    streams.ingest_batch(jobs.where("doc_id = 1").withColumn("job_id", F.lit(20).cast("long")), 1, base, catalogue, ingest)
    assert state()[3] == once[3] and len(state()[0]) == 4
