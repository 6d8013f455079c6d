"""What several operators share: tables, the shared folder, words as numpy arrays, links to components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where it is unset, local runs (tests) get a folder of their own; on a cluster that would be one machine's, so it fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/plumbline/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it is counted to hold at most `rows` rows, else as it is (a shuffle join follows)."""
    return F.broadcast(df) if df.count() <= rows else df


# --- words of a whole Arrow batch, without a Python string for any of them -------------------------------------------

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and its n + 1 offsets; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each text (n + 1 numbers)."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = solid[1:] != solid[:-1]
    if len(data):
        edge[offsets] = True  # a word ends with its text
    at = np.flatnonzero(edge)
    keep = solid[at[:-1]] if len(at) > 1 else np.zeros(0, bool)
    starts, ends = at[:-1][keep], at[1:][keep]
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes of text that a task works on at once; hashing them takes some forty times as much memory.
SLICE_BYTES = 4 << 20


def byte_slices(batch, column: int = 0):
    """Slices of consecutive rows of an Arrow batch whose texts have SLICE_BYTES in all, or of one row with a longer text."""
    _, offsets = column_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, with its length mixed in; worked out SLICE_BYTES at a time."""
    n = ends - starts
    total = np.cumsum(n)
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(total, total[at] - n[at] + SLICE_BYTES, side="right")))
        out.append(_hash_some(data, starts[at:to], n[at:to]))
        at = to
    return np.concatenate(out)


def _hash_some(data: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = int(n.sum())
    first = np.cumsum(n) - n
    place = np.arange(total, dtype=np.int64) - np.repeat(first, n)
    with np.errstate(over="ignore"):
        powers = np.full(int(n.max()), _BASE, dtype=np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        terms = (data[place + np.repeat(starts, n)].astype(np.uint64) + np.uint64(1)) * powers[place]
        return mix(np.add.reduceat(terms, first) + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


# --- links to components ---------------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of `links` (a, b): component is the smallest node that links reach.

    Large-star and small-star steps by turns (both are joins and minimum aggregates; no group is gathered), each
    written to the shared folder, until no edge changes. Null ends are dropped; self links count for nothing.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = cut(edges, "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        # large star: neighbours above a node go to the smallest of its neighbours
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large, "large")
        # small star: a node and its neighbours below it go to the smallest of them
        small_low = cut(large.groupBy("a").agg(F.min("b").alias("m")), "small")
        small = large.join(small_low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = cut(small.where("a <> b").distinct(), "edges")
        now = after.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        edges = after
        if now == state:
            break
        state = now
    stars = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.union(roots).groupBy("node").agg(F.min("component").alias("component"))
