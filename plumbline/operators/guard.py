"""Relevance guard: refusals before any model sees a question. Input: question text and terms of its sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon, text as T
from .retrieval import classify_response_mode

THRESHOLD = 0.10
# fixed value: the refusal of the default language pack
REFUSAL = "Bu bilgi yüklenen belgede açıkça yer almıyor. Belgedeki başlıklar, kavramlar, kişiler, tarihler, maddeler veya bilgiler hakkında daha açık bir soru sor."


def lits(words) -> Column:
    return F.array(*map(F.lit, words))


def is_gibberish(question: Column) -> Column:
    tokens = F.regexp_extract_all(T.normalize_for_matching(question), F.lit("[a-z]+"), F.lit(0))
    token = F.coalesce(F.get(tokens, F.lit(0)), F.lit(""))
    return (F.size(tokens) == 1) & (F.length(token) >= 7) & (F.regexp_count(token, F.lit("[aeiou]")) < F.length(token) * 0.15)


def is_low_information(question: Column, source_terms: Column) -> Column:
    n = T.normalize_for_matching(question)
    tokens = F.regexp_extract_all(n, F.lit("[a-z0-9]+"), F.lit(0))
    terms = T.meaningful_terms(question)
    overlap = T.term_overlap(terms, source_terms)
    return (
        F.when(F.size(tokens) == 0, True).when(T.any_of(n, lexicon.NOISE_PHRASES), True).when(F.arrays_overlap(tokens, lits(lexicon.SLANG)) & (F.size(tokens) <= 3), True)
        .when(F.size(terms) == 0, True).when((F.size(terms) <= 2) & ~overlap, True).when((F.size(terms) <= 3) & ~overlap & ~T.any_of(n, lexicon.QUESTION_SHAPES), True).otherwise(False)
    )


def has_document_anchor(normal: Column) -> Column:
    return T.any_of(normal, lexicon.ANCHORS)


def is_existential(question: Column) -> Column:
    return F.arrays_overlap(T.meaningful_terms(question), lits(lexicon.ABSTRACT_TERMS)) & T.any_of(T.normalize_for_matching(question), lexicon.ABSTRACT_MARKERS)


def is_general_knowledge(question: Column, source_terms: Column) -> Column:
    n, terms = T.normalize_for_matching(question), T.meaningful_terms(question)
    overlap = T.term_overlap(terms, source_terms)
    outside = (T.any_of(n, lexicon.PROCEDURE_MARKERS) | F.arrays_overlap(terms, lits(lexicon.EXTERNAL_TOPICS))) & ~overlap
    return ~has_document_anchor(n) & (is_existential(question) | T.any_of(n, lexicon.DEFINITION_MARKERS) | outside)


def guard_answer(reason: Column, best_score: Column, threshold: float = THRESHOLD) -> Column:
    """The standard refusal with its trace, no sources and no citations, where there is a reason; else null."""
    none = F.expr("cast(array() as array<string>)")
    scores = F.round(F.coalesce(best_score, F.lit(0.0)), 4).alias("max_score"), F.lit(min(1.0, max(0.0, threshold))).alias("min_score")
    return F.when(reason.isNotNull(), F.struct(F.lit(REFUSAL).alias("answer"), none.alias("sources"), none.alias("citations"), F.lit("retrieval-guard").alias("provider"), reason.alias("reason"), *scores))


def guard_reason(question: Column, source_terms: Column, best_score: Column, threshold: float = THRESHOLD) -> Column:
    """Reason of refusal, or null: general knowledge first; overview questions skip the other tests."""
    overview = classify_response_mode(question) == "summary"
    return (
        F.when(is_general_knowledge(question, source_terms), "general-knowledge-question").when(overview, None).when(is_gibberish(question), "gibberish-question")
        .when(is_low_information(question, source_terms), "low-information-question").when(F.coalesce(best_score, F.lit(0.0)) < min(1.0, max(0.0, threshold)), "low-retrieval-score")
    )
