"""Evaluation metrics, aggregates and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import ranked

# fixed values: the published minimums
GATES = {"casePassRate": 0.90, "recallAtK": 0.90, "precisionAtK": 0.30, "meanReciprocalRank": 0.80, "answerCorrectness": 0.90, "groundedness": 0.90, "citationAccuracy": 0.90, "noAnswerAccuracy": 1.0, "guardAccuracy": 1.0}


def retrieval_metrics(retrieved: DataFrame, gold: DataFrame, key: str = "case_id", item: str = "chunk_index") -> DataFrame:
    """key, recall, precision, reciprocal_rank from retrieved (key, item, rank) and gold (key, item)."""
    g = gold.select(key, item).distinct().withColumn("hit", F.lit(1))
    r = retrieved.join(g, [key, item], "left").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"), F.countDistinct(F.when(F.col("hit") == 1, F.col(item))).alias("found"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    want = g.groupBy(key).agg(F.count(F.lit(1)).alias("wanted"))
    out = want.join(r, key, "left").fillna(0, ["n", "hits", "found"])
    return out.select(key, (F.col("found") / F.col("wanted")).alias("recall"), F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0).alias("precision"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def score_cases(cases: DataFrame) -> DataFrame:
    """answer_correct, grounded, guard_correct (guard cases only), failures and pass flag of each case.

    cases: case_id, answer, should_answer, required (array of any-of groups), forbidden, supported, recall (null where it
    does not apply); perhaps citation_correct (null where it does not apply) and evaluation_mode (pipeline, if not given).
    """
    a = T.eval_normalize(F.col("answer"))
    missing = F.filter("required", lambda g: ~F.exists(g, lambda t: T.contains_term(a, T.eval_normalize(t))))
    bad = F.filter("forbidden", lambda t: T.contains_term(a, T.eval_normalize(t)))
    refused = T.is_no_answer(F.col("answer"))
    correct = F.when(F.col("should_answer"), ~refused & (F.size(missing) == 0) & (F.size(bad) == 0)).otherwise(refused)
    grounded = F.when(~F.col("should_answer") & refused, True).otherwise(F.coalesce("supported", F.lit(False)))
    guard = F.col("evaluation_mode") == "guard" if "evaluation_mode" in cases.columns else F.lit(False)
    cited = F.coalesce("citation_correct", F.lit(True)) if "citation_correct" in cases.columns else F.lit(True)
    out = cases.withColumns({"answer_correct": correct, "grounded": grounded})
    out = out.withColumn("guard_correct", F.when(guard, F.col("answer_correct")))
    failures = [(F.coalesce(F.col("recall") < 1, F.lit(False)), "expected-source-not-retrieved"), (~F.col("answer_correct"), "answer-expectation-failed"), (~F.col("grounded"), "answer-not-grounded"), (~cited, "supporting-source-not-cited"), (guard & ~F.col("answer_correct"), "guard-expectation-failed")]
    return out.withColumn("failures", F.array_compact(F.array(*(F.when(test, name) for test, name in failures)))).withColumn("passed", F.size("failures") == 0)


def latency(rows: DataFrame, *by: str) -> DataFrame:
    """by, average_ms, p50_ms, p95_ms, max_ms of duration_ms; percentiles are exact, interpolated between two ranks.

    Ranks come from sorted ranges and their counts, so that no group's values meet in one task. Null durations are left out
    (a group without others has zeros).
    """
    d = F.col("duration_ms").cast("double")
    rows = rows.select(*by, d.alias("duration_ms"))
    placed = ranked(rows.where("duration_ms IS NOT NULL"), list(by), [F.asc("duration_ms")], "place")
    n = rows.groupBy(*by).agg(F.count("duration_ms").alias("n"), F.avg("duration_ms").alias("mean"), F.max("duration_ms").alias("most"))
    n = n.select(F.struct(*by, F.lit(0).alias("one")).alias("of"), "*")
    at = {p: 1 + p * (F.col("n") - 1) for p in (0.5, 0.95)}
    pick = lambda place, name: F.max(F.when(F.col("place") == place, F.col("duration_ms"))).alias(name)
    both = placed.select(F.struct(*by, F.lit(0).alias("one")).alias("own"), "place", "duration_ms").join(n.select("of", "n"), F.col("own").eqNullSafe(F.col("of")))
    ends = both.groupBy("own").agg(*(pick(f(a), f"{name}{k}") for k, a in enumerate(at.values()) for f, name in ((F.floor, "low"), (F.ceil, "high"))))
    out = n.join(ends, F.col("of").eqNullSafe(F.col("own")), "left")
    value = lambda k, a: F.col(f"low{k}") + (F.col(f"high{k}") - F.col(f"low{k}")) * (a - F.floor(a))
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 2)
    return out.select(*by, r(F.col("mean")).alias("average_ms"), *(r(value(k, a)).alias(f"{name}_ms") for k, (a, name) in enumerate(zip(at.values(), ("p50", "p95")))), r(F.col("most")).alias("max_ms"))


def aggregate_results(scores: DataFrame) -> DataFrame:
    """One row of rates over the populations that each applies to: filtered means, 0 where a population is empty."""
    mean = lambda test, value: F.round(F.coalesce(F.avg(F.when(test, value)), F.lit(0.0)), 4)
    d = lambda c: F.col(c).cast("double")
    on, asked = F.lit(True), F.col("recall").isNotNull()
    return scores.agg(
        F.count(F.lit(1)).alias("caseCount"), mean(on, d("passed")).alias("casePassRate"), mean(asked, d("recall")).alias("recallAtK"), mean(asked, d("precision")).alias("precisionAtK"), mean(asked, d("reciprocal_rank")).alias("meanReciprocalRank"),
        mean(asked, (F.col("recall") == 1).cast("double")).alias("hitRate"), mean(on, d("answer_correct")).alias("answerCorrectness"), mean(F.col("should_answer"), d("grounded")).alias("groundedness"), mean(~F.col("should_answer"), d("answer_correct")).alias("noAnswerAccuracy"),
        *(mean(F.col(c).isNotNull(), d(c)).alias(name) for c, name in (("citation_correct", "citationAccuracy"), ("guard_correct", "guardAccuracy")) if c in scores.columns),
    )


def quality_gates(metrics: DataFrame, gates: dict[str, float] = GATES) -> DataFrame:
    """metric, value, minimum, passed of each gate; a gate whose metric is missing or null has no value and fails."""
    value = lambda m: F.col(m).cast("double") if m in metrics.columns else F.lit(None).cast("double")
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), value(m).alias("value"), F.lit(gates[m]).alias("minimum")) for m in gates))
    return metrics.select(F.explode(pairs).alias("g")).select("g.*", F.coalesce(F.col("g.value") >= F.col("g.minimum"), F.lit(False)).alias("passed"))


def citation_correct(cited: DataFrame, gold: DataFrame, key: str = "case_id", item: str = "chunk_index") -> DataFrame:
    """key, citation_correct of every case with gold: one of its citations names a gold item."""
    met = cited.join(gold.select(key, item).distinct(), [key, item], "left_semi").select(key).distinct().withColumn("hit", F.lit(True))
    return gold.select(key).distinct().join(met, key, "left").select(key, F.coalesce("hit", F.lit(False)).alias("citation_correct"))

