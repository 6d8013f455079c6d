"""A training corpus in five stages: each one works on what the stage before it kept, and is written as Parquet.

All stages but the last return the columns of documents, and take extra ones along, whatever their names. Rows are
identified by a hash of id and text (and source, where sizes are mixed), so that null and repeated ids stay apart. Null,
empty and very long texts, ties and empty tables have the results that the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from plumbline.llm import curriculum, decontaminate, jaccard, quality, shards
from plumbline.llm.common import cut, shared_dir

#: Slots within which the last stage shuffles: the curriculum's course holds to within so many sequences.
SHUFFLE_WINDOW = 16_384


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the weak-label classifier finds good. Null and empty texts score 0 and go; repeated rows fare alike."""
    return quality.good_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more, the smallest doc_id.

    A null doc_id comes last. Rows without words have no group and stay; of rows equal in doc_id and text one stays.
    """
    return jaccard.one_of_each(docs, n=5, num=80, den=100)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark passage; each row is judged by itself, also where ids are null or repeated."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The curriculum's training order: a row for each copy that the mix takes, range-sorted by position.

    Texts without words are taken 0 times; of rows equal in doc_id, source and text one takes part.
    """
    return curriculum.training_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Binary shards of token ids, read back: one row a sequence. Slots follow the files and rows of docs, the training
    order, and are shuffled within windows of SHUFFLE_WINDOW only."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:  # not read from Parquet files: written as such first
        docs = cut(docs, "ordered")
    out = shards.materialise(docs, in_order=True, window=SHUFFLE_WINDOW)
    return out.select("slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens", F.xxhash64("tokens").alias("token_hash"))


STAGES = [("quality classifier", classify), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminated), ("mixing sources to target weights", mixed), ("token-ID / binary output", tokens)]

#: The classifier is trained in floating point and the tokeniser has no SQL form: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def finished(spark: SparkSession, path: str) -> bool:
    """Whether the stage that writes to path has ended: its mark is written last."""
    try:
        return not spark.read.schema("stage string").parquet(f"{path}-done").isEmpty()
    except AnalysisException:
        return False


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages over documents. With a folder of an earlier run, its finished stages are read instead of run again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = folder or shared_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/stage{k + 1}"
        if not finished(spark, path):
            stage(spark, docs, sf_dir).write.mode("overwrite").option("compression", "zstd").parquet(path)
            spark.createDataFrame([(name,)], "stage string").write.mode("overwrite").parquet(f"{path}-done")
        docs = spark.read.parquet(path)
    return docs
