"""Claims of answers against windows of their evidence. Features are computed once per claim and window, then joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import facts as K, lexicon, text as T


def split_claims(answer: Column) -> Column:
    # most texts have single blanks, and few have the opening: one search is much faster than what it saves
    spaced = T.once(answer, lambda x: F.when(x.rlike(r"(?U)^ | $|  |[\s&&[^ ]]"), T.normalize_whitespace(x)).otherwise(x))
    a = T.once(spaced, lambda x: F.when(F.lower(F.left(x, F.lit(7))) == "belgeye", F.regexp_replace(x, r"(?iu)^belgeye\s+göre\s*:?\s+", "")).otherwise(x))
    parts = F.split(a, rf"(?<!\d[.!?])(?<=[.!?])\s+(?=[{T.UPPER}])|\s*;\s+")
    return F.filter(F.transform(parts, lambda c: F.btrim(c, F.lit(" -"))), lambda c: c != "")


def evidence_units(text: Column) -> Column:
    """The sentence units of a text, in order."""
    flat = F.regexp_replace(text, r"(?<!\n)\n(?!\n)", " ")
    return F.filter(F.transform(F.split(flat, r"(?<!\d[.!?])(?<=[.!?])\s+|\s+(?=\([0-9]+\)\s)|\n{2,}"), T.normalize_whitespace), lambda u: u != "")


def unit_windows(units: Column) -> Column:
    """array<struct<ord, units, first, text>>: all runs of one, two and three units, and the place of the first unit of each."""
    run = lambda n: F.transform(F.slice(units, 1, F.greatest(F.size(units) - (n - 1), F.lit(0))), lambda u, i: F.struct(F.lit(n).alias("units"), i.alias("first"), (F.concat_ws(" ", u, *(F.get(units, i + k) for k in range(1, n))) if n > 1 else u).alias("text")))
    return F.transform(F.concat(run(1), run(2), run(3)), lambda w, i: F.struct(i.alias("ord"), w["units"].alias("units"), w["first"].alias("first"), w["text"].alias("text")))


def each_text_once(windows: Column) -> Column:
    """The first window of every text, by text."""
    by_text = F.sort_array(F.transform(windows, lambda w: F.struct(w["text"].alias("text"), w["ord"].alias("ord"), w["units"].alias("units"), w["first"].alias("first"))))
    return T.once(by_text, lambda x: F.filter(x, lambda w, i: (i == 0) | (F.get(x, i - 1)["text"] != w["text"])))


def window_features(w: Column) -> Column:
    """What claims are held against in a window, its terms aside; only critical claims have facts, and those meet single units."""
    text = w["text"]
    return F.struct(w["ord"].alias("ord"), w["units"].alias("units"), w["first"].alias("first"), K.extract_claim_facts(F.when(w["units"] == 1, text)).alias("w_facts"), T.relation_concepts(text).alias("w_relations"), T.has_negative_polarity(text).alias("w_negative"), T.normalize_for_matching(text).alias("w_normal"))


def features(rows: DataFrame, column: str) -> DataFrame:
    """rows with the features of a column."""
    c = F.col(column)
    made = F.struct(T.claim_content_terms(c).alias("terms"), K.extract_claim_facts(c).alias("facts"), T.relation_concepts(c).alias("relations"), T.extract_acronyms(c).alias("acronyms"), T.has_negative_polarity(c).alias("negative"), T.normalize_for_matching(c).alias("normal"))
    # a generator of one row: features are worked out once here, not again for each use of them
    return rows.select("*", F.explode(F.array(made)).alias("made")).select(*rows.columns, "made.*")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows by key in as many partitions as Spark shuffles to: with a number given they are not put together again, small as they are."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def match_claims(answers: DataFrame, sources: DataFrame, key: str = "answer_id") -> DataFrame:
    """Best window of every claim: key, claim_no, claim, supported, reason, source_index, coverage, matched terms.

    answers: key, answer, mode. sources: key, source_index, text. The join is on the key; factual claims meet single units only.
    """
    # dealt out by key first, for a small table of much work is few partitions
    said = dealt(answers.select(key, "mode", "answer"), key).select(key, "mode", F.posexplode(split_claims(F.col("answer"))).alias("claim_no", "claim"))
    claims = features(said, "claim").withColumn("critical", K.has_facts(F.col("facts")))
    # the work is that of the sources' windows: sources of other keys meet no claim
    asked = sources.select(key, "source_index", "text").join(answers.select(key).hint("merge"), key, "left_semi")
    # a window's terms are those of its units, and each unit stands in up to six windows: claims look for theirs in units
    w = dealt(asked, key).select(key, "source_index", F.explode(F.array(evidence_units(F.col("text")))).alias("each"))
    w = w.select(key, "source_index", F.explode(F.array(F.struct(F.transform("each", T.claim_content_terms).alias("held"), F.transform(each_text_once(unit_windows(F.col("each"))), window_features).alias("windows")))).alias("made"))
    # merged: Spark guesses windows and their features no larger than the sources, and would send them all through the driver
    c = claims.hint("merge").join(w.select(key, "source_index", "made.*"), key)
    c = c.withColumn("met", F.transform("held", lambda held: T.terms_met(F.col("terms"), held))).drop("held")
    c = c.select(*(x for x in c.columns if x != "windows"), F.inline("windows")).where("NOT critical OR units = 1")
    matched = F.sort_array(F.array_distinct(F.flatten(F.slice("met", F.col("first") + 1, F.col("units")))))
    c = c.withColumn("matched", matched).withColumn("coverage", F.size("matched") / F.greatest(F.size("terms"), F.lit(1))).drop("met")
    common = F.array_intersect("relations", "w_relations")
    c = c.withColumns({"facts_ok": ~F.col("critical") | K.facts_supported(F.col("facts"), F.col("w_facts")), "related": F.size(common) > 0, "acronyms_ok": F.forall("acronyms", lambda a: F.contains(F.col("w_normal"), a)), "polarity_ok": F.col("negative") == F.col("w_negative")})
    relations_ok = (F.size("relations") == 0) | F.col("related")
    minimum = F.when(F.col("critical") | (F.col("mode") == "summary"), 0.35).otherwise(0.65)
    fewest = F.when(F.size("terms") <= 2, 1).otherwise(2)
    supported = F.col("facts_ok") & relations_ok & F.col("acronyms_ok") & F.col("polarity_ok") & (F.size("matched") >= fewest) & (F.col("coverage") >= minimum)
    reason = (
        F.when(supported, "claim-supported").when(~F.col("facts_ok"), "critical-fact-mismatch").when(~F.col("polarity_ok"), "claim-polarity-mismatch").when(~F.col("acronyms_ok"), "named-entity-mismatch")
        .when(~relations_ok, "claim-relation-mismatch").when(F.col("coverage") < minimum, "insufficient-claim-coverage").otherwise("insufficient-claim-evidence")
    )
    add = lambda test, v: F.when(test, v).otherwise(0.0)
    score = F.col("coverage") + add(F.col("facts_ok") & F.col("critical"), 0.35) + add(F.col("related"), 0.15) + add(F.col("acronyms_ok") & (F.size("acronyms") > 0), 0.10) + add(F.col("polarity_ok"), 0.10) + add(supported, 10.0)
    best = c.withColumns({"supported": supported, "reason": reason, "score": score}).groupBy(key, "claim_no").agg(F.max_by(F.struct("supported", "reason", "source_index", F.round("coverage", 4).alias("coverage"), "matched"), F.struct("score", -F.col("source_index"), -F.col("ord"))).alias("b"))
    out = said.select(key, "claim_no", "claim").join(best.hint("merge"), [key, "claim_no"], "left")
    return out.select(key, "claim_no", "claim", F.coalesce("b.supported", F.lit(False)).alias("supported"), F.coalesce("b.reason", F.lit("no-source-evidence-window")).alias("reason"), F.col("b.source_index").alias("source_index"), F.coalesce("b.coverage", F.lit(0.0)).alias("coverage"), F.coalesce("b.matched", F.array().cast("array<string>")).alias("matched"))


def question_aligned(question: Column, answer: Column) -> Column:
    """Percentages, money, durations and dates of the question must all be in the answer."""
    both = F.struct(K.extract_claim_facts(question).alias("q"), K.extract_claim_facts(answer).alias("a"))
    return T.once(both, lambda x: F.size(F.concat(*(F.array_except(x["q"][k], x["a"][k]) for k in ("percentages", "money", "durations", "dates")))) == 0)


def validate_answers(answers: DataFrame, sources: DataFrame, key: str = "answer_id") -> DataFrame:
    """key, n_claims, n_supported, aligned, supported, reason of every answer (answers may have a `question` column)."""
    m = match_claims(answers, sources, key)
    per = m.groupBy(key).agg(F.count(F.lit(1)).alias("n_claims"), F.count_if("supported").alias("n_supported"))
    aligned = question_aligned(F.col("question"), F.col("answer")) if "question" in answers.columns else F.lit(True)
    out = answers.select(key, aligned.alias("aligned")).join(per.hint("merge"), key, "left").fillna(0, ["n_claims", "n_supported"])
    fine = (F.col("n_claims") > 0) & (F.col("n_supported") == F.col("n_claims")) & F.col("aligned")
    reason = F.when(F.col("n_claims") == 0, "answer-has-no-verifiable-claims").when(fine, "all-claims-supported").when(~F.col("aligned"), "question-fact-mismatch").otherwise("unsupported-answer-claims")
    return out.select(key, "n_claims", "n_supported", "aligned", fine.alias("supported"), reason.alias("reason"))


def evidence_support(questions: DataFrame, sources: DataFrame, key: str = "question_id") -> DataFrame:
    """Best source of each question: percentages need all of them with an entity and a relation; else entities and overlap."""
    q = dealt(questions.select(key, "question"), key).select(key, T.meaningful_terms(F.col("question")).alias("all"), K.extract_percentages(F.col("question")).alias("q_pct"), T.relation_concepts(F.col("question")).alias("q_rel"))
    lits = lambda x: F.array(*map(F.lit, x))
    q = q.withColumn("q_terms", F.array_except("all", lits(("hangi", "kac", "nedir")))).withColumn("q_ent", F.filter(F.array_except("all", lits(lexicon.NON_ENTITY_TERMS)), lambda t: ~t.rlike("^[0-9]+$")))
    s = dealt(sources.select(key, "source_index", "text"), key).select(key, "source_index", T.meaningful_terms(F.col("text")).alias("terms"), K.extract_percentages(F.col("text")).alias("pct"), T.relation_concepts(F.col("text")).alias("rel"))
    both = s.hint("merge").join(q, key)
    # a question's entities and terms are both among all its terms, which are looked for once
    both = both.withColumns({"m_pct": F.array_intersect("q_pct", "pct"), "m_rel": F.array_intersect("q_rel", "rel"), "met": T.terms_met(F.col("all"), F.col("terms"))})
    both = both.withColumns({"m_ent": F.array_intersect("q_ent", "met"), "m_terms": F.array_intersect("q_terms", "met")})
    some = lambda c: F.size(c) > 0
    ratio = F.size("m_terms") / F.greatest(F.size("q_terms"), F.lit(1))
    exact = (F.size(F.array_except("q_pct", "pct")) == 0) & some("m_ent") & some("m_rel")
    loose = some("m_ent") & (some("m_rel") | (F.size("m_terms") >= 3)) & (ratio >= 0.6)
    supported = F.when(some("q_pct"), exact).otherwise(loose)
    reason = F.when(some("q_pct"), F.when(exact, "exact-percentage-entity-relation-match").otherwise("percentage-without-entity-relation-support")).otherwise(F.when(loose, "entity-relation-match").otherwise("insufficient-claim-overlap"))
    strength = F.size("m_pct") * 4 + F.size("m_ent") * 2 + F.size("m_rel") + F.when(supported, 100).otherwise(0)
    best = both.withColumns({"supported": supported, "reason": reason, "strength": strength}).groupBy(key).agg(F.max_by(F.struct("supported", "reason", "source_index", "m_pct", "m_rel"), F.struct("strength", -F.col("source_index"))).alias("b"))
    none = F.array().cast("array<string>")
    return questions.select(key).join(best.hint("merge"), key, "left").select(key, F.coalesce("b.supported", F.lit(False)).alias("supported"), F.coalesce("b.reason", F.lit("no-retrieved-chunk-supports-main-claim")).alias("reason"), F.col("b.source_index").alias("source_index"), F.coalesce("b.m_pct", none).alias("percentages"), F.coalesce("b.m_rel", none).alias("relations"))


def grounded_answers(answers: DataFrame, sources: DataFrame, key: str = "answer_id") -> DataFrame:
    """key, grounded of every answer: empty ones are not; critiques must not contradict their sources; one that says there is
    no answer must be to a question without evidence; the others must have every claim supported.

    answers: key, answer, mode, and question, without which no-answer rows are not grounded.
    """
    context = sources.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("source_index", "text"))).alias("s")).select(key, F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("context"))
    said = answers.where(F.trim(F.coalesce("answer", F.lit(""))) != "")
    plain = said.where(~T.is_no_answer_response(F.col("answer")))
    silent = said.where(T.is_no_answer_response(F.col("answer"))).select(key, F.lit(False).alias("ok"))
    if "question" in answers.columns:
        asked = said.where(T.is_no_answer_response(F.col("answer")))
        silent = evidence_support(asked.select(key, F.coalesce("question", F.lit("")).alias("question")), sources.join(asked.select(key).hint("merge"), key, "left_semi"), key).select(key, (~F.col("supported")).alias("ok"))
    critiques = plain.where("mode = 'critique'").join(context.hint("merge"), key, "left").select(key, grounded_critique(F.col("answer"), F.coalesce("context", F.lit(""))).alias("ok"))
    claims = validate_answers(plain.where("mode <> 'critique'"), sources, key).select(key, F.col("supported").alias("ok"))
    return answers.select(key).join(critiques.union(claims).union(silent).hint("merge"), key, "left").select(key, F.coalesce("ok", F.lit(False)).alias("grounded"))


def grounded_critique(answer: Column, context: Column) -> Column:
    a, c = T.normalize_for_matching(answer), T.normalize_for_matching(context)
    # fixed values: what a context shows and a critique then must not deny
    dates = c.rlike(T.ascii_borders(r"\b(?:19|20)\d{2}\b")) & T.any_of(a, ("tarihlendirilmemis", "tarih yok"))
    skills = T.any_of(c, ("skills", "beceri", "react", "java", "python", "flask", "spring")) & a.rlike(r"(?:teknik )?becer\w*.{0,30}eksik")
    projects = T.any_of(c, ("projects", "proje", "implemented", "built", "gelistirdi")) & a.rlike(r"proje.{0,40}tamamlanmamis")
    return ~(dates | skills | projects)
