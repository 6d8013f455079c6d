"""Model hooks: a loader is called once in each task, and what it returns takes whole Arrow batches.

A loader takes nothing and returns a model, or None where there is none; a model takes pandas series and returns one value
for each row. Where the loader or the model fails, values are null, and each caller says what stands in for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from . import retrieval as R

#: Characters of a source that a reranker reads.
MOST_RERANKED = 3000


def predicted(loader: Callable, returns: str, *inputs: Column) -> Column:
    """The model's value for each row; null where there is no model or it fails on the row's batch."""

    def run(batches):
        try:
            model = loader()
        except Exception:  # a model that is not there is no error: callers have a fallback
            model = None
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            none = pd.Series([None] * len(columns[0]), dtype=object)
            try:
                yield none if model is None else pd.Series(list(model(*columns)), dtype=object)
            except Exception:
                yield none

    if len(inputs) == 1:
        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    else:
        run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, returns)(*inputs)


def embedder(loader: Callable, dim: int = R.DIM) -> Callable:
    """An embedder for `embed_questions` and `hash_vectors`' callers: key, vec, by_model; unit vectors of the model, and
    hashed ones of dim numbers where it fails. Vectors of the two kinds are not to be compared: by_model tells them apart.
    Texts that are null or give neither vector have no row; nor do zero vectors."""

    def embed(rows: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
        own = rows.select(*key, F.col(text_col).alias("text")).where("text IS NOT NULL").withColumn("own", predicted(loader, "array<double>", F.col("text")))
        size = F.sqrt(F.aggregate("own", F.lit(0.0), lambda s, x: s + x * x))
        own = own.withColumn("size", size).withColumn("vec", F.when(F.col("size") > 0, F.transform("own", lambda x: x / F.col("size"))))
        own = written(own.select(*key, "vec", F.when(F.col("vec").isNull(), F.col("text")).alias("text")))
        hashed = R.hash_vectors(own.where("vec IS NULL"), key, "text", dim)
        return own.where("vec IS NOT NULL").select(*key, "vec", F.lit(True).alias("by_model")).unionByName(hashed.withColumn("by_model", F.lit(False)))

    return embed


def reranker_scores(questions: DataFrame, candidates: DataFrame, chunks: DataFrame, loader: Callable, q_key: list[str], c_key: list[str]) -> DataFrame:
    """q_key, c_key, reranker_score: the model's score of each question with the first 3,000 characters of each candidate.

    questions: q_key, question; candidates: q_key, c_key; chunks: c_key, text. Null where the model fails: `rerank` then keeps
    the given order.
    """
    pairs = candidates.select(*q_key, *c_key).join(questions.select(*q_key, "question"), q_key)
    pairs = pairs.join(chunks.select(*c_key, F.left(F.coalesce("text", F.lit("")), F.lit(MOST_RERANKED)).alias("read")), c_key)
    return pairs.select(*q_key, *c_key, predicted(loader, "double", F.coalesce("question", F.lit("")), F.col("read")).alias("reranker_score"))


def spans(questions: DataFrame, sources: DataFrame, loader: Callable, key: str = "question_id") -> DataFrame:
    """key, chunk_index, answer, score: the model's span of each source for its question, for `best_span`; none where it fails.

    questions: key, question; sources: key, source_index, text. The model returns (answer, score) for each row.
    """
    both = sources.select(key, F.col("source_index").alias("chunk_index"), "text").join(questions.select(key, "question"), key)
    # a struct's fields come from a map of strings, as models return plain pairs
    found = predicted(lambda: _pairs(loader()), "array<string>", F.col("question"), F.col("text"))
    return both.select(key, "chunk_index", found.alias("f")).where("f IS NOT NULL").select(key, "chunk_index", F.get("f", F.lit(0)).alias("answer"), F.get("f", F.lit(1)).cast("double").alias("score"))


def _pairs(model):
    """The model with its pairs as lists of two strings; None stays None."""
    return model and (lambda *columns: [[None if a is None else str(a), repr(float(s))] for a, s in model(*columns)])
