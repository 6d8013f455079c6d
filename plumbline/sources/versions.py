"""A table whose documents are replaced by publishing versions, so that a reader sees one version whole.

Rows lie in one folder for each bucket of their key. A publish reads and writes only the buckets that it touches, into a
new folder, and ends with one manifest row that names the folder of every bucket. Until that row is there, readers see the
version before; a publish that fails leaves files that no manifest names. Nothing that a manifest names is written again,
so that a reader of an older version ends undisturbed. One job publishes at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, StructType, VariantType

MANIFEST = "version long, batch string, key string, buckets int, columns string, folders map<int,string>"
BUCKET = "bucket_of_key"


def manifests(spark: SparkSession, base: str) -> DataFrame:
    """One row for each published version; none, if nothing was published."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{base}/manifest/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def newest(rows: DataFrame) -> Row | None:
    found = rows.orderBy(F.desc("version")).limit(1).collect()
    return found[0] if found else None


def live(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of the one that is named."""
    known = manifests(spark, base)
    of = newest(known if version is None else known.where(F.col("version") == version))
    if of is None:
        raise ValueError(f"{base} has no version {'' if version is None else version}".rstrip())
    return _rows(spark, base, of, of.folders.values())


def publish(spark: SparkSession, base: str, incoming: DataFrame | None = None, deleted: DataFrame | None = None, key: str = "doc_id", buckets: int = 64, files: int = 1, batch: str | None = None) -> int:
    """Publish a version in which the documents of `incoming` replace their former rows and those of `deleted` are gone.

    The first publish fixes columns, key and number of buckets. A batch that was published before changes nothing; its
    version is returned. Rows with a null key are added and never replaced. A document in both tables has its incoming
    rows. files: files a bucket, for tables with large or few buckets.
    """
    before = newest(manifests(spark, base))
    batch = batch or uuid.uuid4().hex
    again = newest(manifests(spark, base).where(F.col("batch") == batch))
    if again:
        return again.version
    if before:
        key, buckets, columns = before.key, before.buckets, StructType.fromJson(json.loads(before.columns))
    elif incoming is None:
        raise ValueError("the first version needs rows")
    else:
        columns = incoming.schema
    folders = dict(before.folders) if before else {}
    of = bucket_of(F.col(key), buckets)
    gone = [x.select(key) for x in (incoming, deleted) if x is not None]
    # at most one row a bucket
    touched = {r.b for x in gone for r in x.select(of.alias("b")).distinct().collect()}
    if touched:
        new = incoming.select(*columns.names) if incoming is not None else spark.createDataFrame([], columns)
        if before:
            old = _rows(spark, base, before, [folders[b] for b in touched if b in folders])
            for x in gone:
                old = old.join(x.where(F.col(key).isNotNull()).distinct(), key, "left_anti")
            new = old.select(*columns.names).unionByName(new)
        folder = f"data/{uuid.uuid4().hex}"
        plain = [c.name for c in columns if isinstance(c.dataType, AtomicType) and not isinstance(c.dataType, VariantType)]
        salt = F.pmod(F.hash(F.lit(1), *plain), F.lit(files))
        new.withColumn(BUCKET, of).repartition(F.col(BUCKET), salt).write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{base}/{folder}")
        has = spark.read.schema(f"{BUCKET} int").parquet(f"{base}/{folder}").distinct().collect()
        folders = {b: f for b, f in folders.items() if b not in touched} | {r[0]: f"{folder}/{BUCKET}={r[0]}" for r in has}
    version = before.version + 1 if before else 1
    row = (version, batch, key, buckets, columns.json(), folders)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{base}/manifest/version-{version:012d}")
    return version


def bucket_of(key: Column, buckets: int) -> Column:
    """Where the rows of a key lie."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _rows(spark: SparkSession, base: str, of: Row, folders) -> DataFrame:
    columns = StructType.fromJson(json.loads(of.columns))
    paths = [f"{base}/{f}" for f in sorted(folders)]
    return spark.read.schema(columns).parquet(*paths) if paths else spark.createDataFrame([], columns)
