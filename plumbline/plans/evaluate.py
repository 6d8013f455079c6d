"""The evaluation as one plan: case tables to guard and pipeline branches, scores, aggregates and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answering, citations, evaluation, guard, profile, retrieval as R, verification as V
from ..sources import tables as S


def hybrid_in_case(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, chunk_index, text, score, rank: the k best chunks of each question's own document, k from a column.

    asked: question_id, question, k; chunks: question_id, chunk_index, text. A document's chunks meet its own question only.
    """
    q = asked.select("question_id", "k", F.col("question").alias("text"), T.meaningful_terms(F.col("question")).alias("q_terms"))
    q = q.join(R.hash_vectors(q, ["question_id"]).withColumnRenamed("vec", "q_vec"), "question_id", "left").drop("text")
    c = chunks.join(R.hash_vectors(chunks, ["question_id", "chunk_index"]), ["question_id", "chunk_index"], "left").join(q, "question_id")
    dot = F.aggregate(F.zip_with("q_vec", "vec", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    c = c.withColumns({"dense": F.coalesce(F.round(dot, 9), F.lit(0.0)), "sparse": R.lexical_score(F.col("q_terms"), T.meaningful_terms(F.col("text")))}).drop("q_vec", "vec", "q_terms")
    by = lambda *order: F.row_number().over(Window.partitionBy("question_id").orderBy(*order, "chunk_index"))
    c = c.withColumns({"dense_rank": by(F.desc("dense")), "sparse_rank": by(F.desc("sparse"))})
    near, met = F.col("dense_rank") <= F.greatest(F.col("k") * 5, F.lit(1)), F.col("sparse") > 0
    part = lambda test, rank: F.when(test, F.lit(1.0) / (R.RRF + F.col(rank))).otherwise(0.0)
    c = c.where(near | met).withColumns({"hybrid": part(near, "dense_rank") + part(met, "sparse_rank"), "score": F.greatest(F.when(near, F.col("dense")).otherwise(0.0), F.least("sparse", F.lit(1.0)))})
    return c.withColumn("rank", by(F.desc("hybrid"), F.desc("score"))).where(F.col("rank") <= F.greatest("k", F.lit(1))).select("question_id", "chunk_index", "text", "score", "rank")


def selected_sources(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, chunk_index, text, score, source_index: first or last k chunks for questions about order, the first k for
    summaries, else the hybrid k best. asked: question_id, question, mode, direction, k."""
    plain = asked.where("direction IS NULL AND mode <> 'summary'")
    found = hybrid_in_case(plain, chunks.join(plain.select("question_id"), "question_id", "left_semi"))
    rest = asked.where("direction IS NOT NULL OR mode = 'summary'").select("question_id", "direction", "k").join(chunks.select("question_id", "chunk_index", "text"), "question_id")
    place = lambda order: F.row_number().over(Window.partitionBy("question_id").orderBy(order))
    rest = rest.withColumns({"up": place(F.asc("chunk_index")), "down": place(F.desc("chunk_index"))})
    rest = rest.where(F.when(F.col("direction") == "last", F.col("down")).otherwise(F.col("up")) <= F.greatest("k", F.lit(1)))
    rest = rest.select("question_id", "chunk_index", "text", F.lit(1.0).alias("score"), place(F.asc("chunk_index")).alias("rank"))
    return found.unionByName(rest).withColumn("source_index", F.col("rank") - 1).drop("rank")


def guard_results(cases: DataFrame, sources: DataFrame) -> DataFrame:
    """question_id, answer, provider, guard_reason, supported of the cases that bring their answer."""
    q = cases.where("evaluationMode = 'guard'").select(F.col("id").alias("question_id"), "question", R.classify_response_mode(F.col("question")).alias("mode"), F.col("candidateAnswer").alias("answer"))
    s = sources.select("question_id", F.col("chunk_index").alias("source_index"), "text").join(q.select("question_id"), "question_id", "left_semi")
    out = answering.finalize_candidates(q.drop("answer"), q.select("question_id", "answer"), s)
    return out.select("question_id", "answer", "provider", F.col("reason").alias("guard_reason"), "supported")


def pipeline_results(cases: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(question_id, answer, provider, guard_reason, supported), the sources shown (question_id, chunk_index, rank) and the
    chunks cited (question_id, chunk_index) of the cases that run from retrieval to citation."""
    x = F.col("question")
    asked = S.written(cases.where("evaluationMode = 'pipeline'").select(F.col("id").alias("question_id"), F.col("id").alias("doc_id"), "question", F.col("topK").alias("k"), R.classify_response_mode(x).alias("mode"), R.order_direction(x).alias("direction")))
    own = sources.join(asked.select("question_id"), "question_id", "left_semi")
    picked = S.written(selected_sources(asked, own))
    held = picked.groupBy("question_id").agg(F.array_distinct(F.flatten(F.collect_list(T.meaningful_terms(F.col("text"))))).alias("terms"), F.max("score").alias("best"))
    checked = asked.join(held, "question_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    # questions about order skip the guard
    checked = S.written(checked.withColumn("reason", F.when(F.col("direction").isNull(), guard.guard_reason(x, F.col("terms"), F.col("best")))).drop("terms"))
    refused = checked.where("reason IS NOT NULL").select("question_id", guard.guard_answer(F.col("reason"), F.col("best")).alias("a")).select("question_id", "a.answer", "a.provider", F.col("a.reason").alias("guard_reason"), F.lit(None).cast("boolean").alias("supported"))
    left = checked.where("reason IS NULL").select("question_id", "doc_id", "question", "mode")
    shown = picked.join(left.select("question_id"), "question_id", "left_semi")
    numbered = shown.select("question_id", "source_index", "text")
    profiles = profile.build_profile(own.withColumnRenamed("question_id", "doc_id").select("doc_id", "chunk_index", "text"))
    built = S.written(answering.build_answers(left, numbered, profiles=profiles).join(left.select("question_id", "question", "mode"), "question_id"))
    claimed = built.where("provider IN ('extractive-fallback', 'application-requirements-structure')")
    verdict = V.validate_answers(claimed, numbered, "question_id").select("question_id", "supported")
    supported = F.when(F.col("provider") == "document-profile", True).otherwise(F.col("supported"))
    matches = V.match_claims(claimed.where(~T.is_no_answer_response(F.col("answer"))), numbered, "question_id")
    marked = S.written(citations.attach_citations(claimed.select("question_id", "answer"), matches, numbered, "question_id"))
    cited = marked.select("question_id", F.explode("citations.source_index").alias("source_index")).join(shown, ["question_id", "source_index"]).select("question_id", "chunk_index")
    answered = built.drop("question", "mode").join(verdict, "question_id", "left").join(marked.select("question_id", F.col("answer").alias("marked")), "question_id", "left")
    answered = answered.select("question_id", F.coalesce("marked", "answer").alias("answer"), "provider", F.lit(None).cast("string").alias("guard_reason"), supported.alias("supported"))
    return refused.unionByName(answered), shown.select("question_id", "chunk_index", (F.col("source_index") + 1).alias("rank")), cited


def run_evaluation(cases: DataFrame) -> DataFrame:
    """A score row for each case (rows of `read_eval_cases`): guard cases judge the answer that they bring against all their
    chunks, pipeline cases retrieve topK chunks, pass the guard, are answered, verified and cited."""
    cases = S.written(cases)
    sources = S.written(S.case_sources(cases).select(F.col("id").alias("question_id"), F.col("chunk_index").cast("int").alias("chunk_index"), F.coalesce("text", F.lit("")).alias("text")))
    results, shown, cited = pipeline_results(cases, sources)
    results = results.unionByName(guard_results(cases, sources))
    gold = cases.where("evaluationMode = 'pipeline'").select(F.col("id").alias("question_id"), F.explode("expectedSourceChunks").alias("chunk_index")).distinct()
    metrics = evaluation.retrieval_metrics(shown, gold, "question_id")
    citing = evaluation.citation_correct(cited, gold, "question_id")
    none = F.array().cast("array<array<string>>")
    required = F.concat(F.transform(F.coalesce("requiredAnswerTerms", F.array().cast("array<string>")), lambda t: F.array(t)), F.coalesce("requiredAnswerTermGroups", none))
    c = cases.select(F.col("id").alias("question_id"), F.coalesce("category", F.lit("uncategorized")).alias("category"), F.col("evaluationMode").alias("evaluation_mode"), F.col("shouldAnswer").alias("should_answer"), required.alias("required"), F.coalesce("forbiddenAnswerTerms", F.array().cast("array<string>")).alias("forbidden"))
    rows = c.join(results, "question_id", "left").join(metrics, "question_id", "left").join(citing, "question_id", "left")
    rows = rows.withColumn("citation_correct", F.when(F.col("should_answer"), F.col("citation_correct"))).withColumn("answer", F.coalesce("answer", F.lit("")))
    return evaluation.score_cases(rows.withColumnRenamed("question_id", "case_id"))


def evaluate_files(spark: SparkSession, paths: list[str], report: str) -> tuple[DataFrame, DataFrame]:
    """Read case files, run them, write the report, and return scores and gates. Cases that are not valid stop the run."""
    cases, rejected = S.read_eval_cases(spark, paths)
    if bad := [f"{r.id}: {r.reason}" for r in rejected.limit(20).collect()]:
        raise ValueError("rejected cases: " + "; ".join(bad))
    scores = S.written(run_evaluation(cases))
    metrics = S.written(evaluation.aggregate_results(scores))
    gates = S.written(evaluation.quality_gates(metrics))
    S.write_report(metrics, gates, report)
    return scores, gates
