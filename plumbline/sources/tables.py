"""Readers and writers: document files, index tables, evaluation cases, audit and chat rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

CASES = """cases array<struct<id:string,category:string,evaluationMode:string,question:string,candidateAnswer:string,topK:int,
chunks:array<struct<pageNumber:int,text:string,score:double>>,expectedSourceChunks:array<int>,requiredAnswerTerms:array<string>,
requiredAnswerTermGroups:array<array<string>>,forbiddenAnswerTerms:array<string>,shouldAnswer:boolean>>"""


def read_document_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Accepted files (path, kind, content) and rejected ones: pdf, docx and txt that are not empty are accepted.

    Spark's scan passes over files of no bytes: they are in neither table.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    f = f.withColumn("kind", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    fine = F.col("kind").isin("pdf", "docx", "txt") & (F.col("length") > 0)
    return f.where(fine).select("path", "kind", "content"), f.where(~fine).select("path", "kind", "length")


def extract_pages_txt(files: DataFrame) -> DataFrame:
    """(path, page_number, text) of text files; bytes that are no UTF-8 are left out."""
    text = F.replace(F.expr("make_valid_utf8(cast(content AS string))"), F.lit("�"), F.lit(""))
    return files.where("kind = 'txt'").select("path", F.lit(1).alias("page_number"), T.clean_text(text).alias("text")).where("text <> ''")


def extract_pages_docx(files: DataFrame) -> DataFrame:
    """(path, page_number, text) of Word files: paragraphs and table rows in body order, a merged cell once."""

    def run(batches):
        import io
        import zipfile
        from xml.etree import ElementTree

        import pandas as pd

        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        words = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")
                parts = []
                for e in body:
                    if e.tag == f"{w}p":
                        parts.append(words(e))
                    elif e.tag == f"{w}tbl":
                        for row in e.iter(f"{w}tr"):
                            cells = [words(c) for c in row.findall(f"{w}tc")]
                            parts.append(" | ".join(c for i, c in enumerate(cells) if c and (not i or c != cells[i - 1])))
                out.append((path, 1, "\n\n".join(p for p in parts if p)))
            yield pd.DataFrame(out, columns=["path", "page_number", "text"])

    pages = files.where("kind = 'docx'").select("path", "content").mapInPandas(run, "path string, page_number int, text string")
    return pages.withColumn("text", T.clean_text(F.col("text"))).where("text <> ''")


def replace_documents(current: DataFrame, incoming: DataFrame, key: str = "doc_id") -> DataFrame:
    """current without the incoming documents, plus incoming: idempotent."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming.select(*current.columns))


def delete_documents(rows: DataFrame, tombstones: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.join(tombstones.select(key).distinct(), key, "left_anti")


def delete_cascade(tombstones: DataFrame, *tables: DataFrame, key: str = "doc_id") -> list[DataFrame]:
    """Each table (chunks, profiles, chat rows, cached answers) without the rows of the deleted documents."""
    return [delete_documents(t, tombstones, key) for t in tables]


def write_version(rows: DataFrame, base: str, key: str = "doc_id") -> str:
    """Write a new version of a table beside the one that is read; returns its path."""
    path = f"{base.rstrip('/')}/version-{uuid.uuid4().hex}"
    rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.parquet(path)
    return path


def read_eval_cases(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Valid cases and rejected ones (missing fields, unknown mode, no candidate answer in guard mode, repeated id)."""
    c = spark.read.schema(CASES).json(paths, multiLine=True).select(F.explode("cases").alias("c")).select("c.*")
    c = c.withColumn("evaluationMode", F.coalesce("evaluationMode", F.lit("pipeline"))).withColumn("topK", F.coalesce("topK", F.lit(3))).withColumn("shouldAnswer", F.coalesce("shouldAnswer", F.lit(True)))
    twice = c.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("twice"))
    c = c.join(twice, "id", "left")
    why = F.when(F.col("id").isNull() | F.col("question").isNull() | F.col("chunks").isNull(), "missing-field").when(~F.col("evaluationMode").isin("pipeline", "guard"), "unknown-mode").when((F.col("evaluationMode") == "guard") & F.col("candidateAnswer").isNull(), "missing-candidate").when(F.col("twice"), "repeated-id")
    c = c.withColumn("reason", why).drop("twice")
    return c.where("reason IS NULL").drop("reason"), c.where("reason IS NOT NULL").select("id", "reason")


def case_sources(cases: DataFrame) -> DataFrame:
    s = cases.select("id", F.posexplode("chunks").alias("chunk_index", "c"))
    return s.select("id", "chunk_index", F.coalesce("c.pageNumber", F.lit(1)).alias("page_number"), F.coalesce("c.score", F.lit(1.0)).alias("score"), F.col("c.text").alias("text"))


def write_report(metrics: DataFrame, gates: DataFrame, path: str, mode: str = "offline") -> None:
    g = gates.agg(F.collect_list(F.struct("metric", "value", "minimum", "passed")).alias("gates"), F.bool_and("passed").alias("passed"))
    metrics.select(F.struct("*").alias("metrics")).join(g).select(F.lit(1).alias("schemaVersion"), F.lit(mode).alias("mode"), "metrics", "gates", "passed").coalesce(1).write.mode("overwrite").json(path)


def audit_rows(events: DataFrame) -> DataFrame:
    """actor, action, doc_id, details as JSON, created_at."""
    return events.select("actor_id", "action", "doc_id", F.coalesce(F.to_json("details"), F.lit('{"serializationError":true}')).alias("details"), "created_at")


def trace_rows(results: DataFrame) -> DataFrame:
    """Trace rows of answers and failures: a failure's provider is ai-service-error, durations are never negative."""
    failed = F.col("error").isNotNull()
    return results.withColumns({"provider": F.when(failed, "ai-service-error").otherwise(F.col("provider")), "duration_ms": F.greatest(F.expr("try_cast(duration_ms AS bigint)"), F.lit(0).cast("long")), "error": F.when(failed, F.concat_ws(": ", "error_class", "error"))})


def chat_rows(answers: DataFrame) -> DataFrame:
    return answers.select("owner_id", "doc_id", F.left("question", F.lit(2000)).alias("question"), "answer", F.coalesce(F.to_json("sources"), F.lit("[]")).alias("sources_json"), F.coalesce(F.to_json("citations"), F.lit("[]")).alias("citations_json"), "created_at")


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; local runs without it use the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return base or spark.conf.get("spark.sql.warehouse.dir")


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet below spark.checkpoint.dir (else the warehouse) and read back, where a plan would be computed twice."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_base(spark).rstrip('/')}/plumbline/step-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out evenly if it comes in fewer partitions than there are cores: a small table of long texts."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
