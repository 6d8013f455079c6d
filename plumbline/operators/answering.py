"""Answer waterfall and prompts: deterministic branches, candidate answers arrive as a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import written
from . import verification
from .guard import REFUSAL
from .retrieval import by_question, is_latest_course_question, latest_course, order_direction, ordered_sources, relevant_passage

# fixed values: sentences of the default language pack
NO_SOURCES = "Bu belge içinde soruyla ilişkili bir bölüm bulunamadı."
CRITIQUE_NOTICE = "Belgeye dayalı değerlendirme üretmek için yerel LLM yanıt üretimi etkin olmalıdır. İlgili kaynak parçaları aşağıda gösterilmiştir."
PREFIX = "Belgeye göre: "
LATEST_COURSE = "Belgeye göre en son dönem %s; bu dönemde görünen ders %s %s dersidir."
DISCOUNT = "Belgeye göre %s%%%s indirimli kontenjana yerleşen öğrenci %%%s öğrenim ücreti indirimi alır."
EXAM = "YKS'de "
WHO_APPLIES = "Belgeye göre %s başvurabilir."
DEPARTMENTS = "Uygun bölümler: %s."
CLASS_YEARS = ("tüm üniversitelerin 3. ve 4. sınıf mühendislik öğrencileri", "4. sınıfta öğrenim gören mühendislik öğrencileri")
GRADE_RULE = "Genel Not Ortalaması + (10.000 / Üniversiteye Giriş Sırası) kriteri teknik uzmanlık sınavı gerekliliğini belirler"
EXAM_STEPS = "süreç Genel Yetenek ve İngilizce sınavı, teknik mülakat, kurul mülakatı ve göreve başlama onayıyla ilerler"


def sanitize_answer(answer: Column) -> Column:
    a = F.regexp_replace(answer, r"(?iu)^\s*(?:cevap|yanıt|answer)\s*:\s*", "")
    a = F.regexp_replace(a, r"(?iu)\s*\(?(?:kaynak|source)\s*:?\s*\d+(?:\s*,\s*\d+)*\)?\s*$", "")
    return F.trim(F.regexp_replace(a, "[ \t]{2,}", " "))


# fixed value: said in place of a critique that its sources contradict
SAFE_CRITIQUE = "Belgeye dayalı değerlendirme: İncelenen kaynaklarda doğrulanabilir belirgin bir olumsuz tespit bulunmuyor. Daha güçlü bir sunum için hedeflenen pozisyona en uygun proje, teknoloji ve ölçülebilir sonuçlar özet bölümünde önceliklendirilebilir."


def safe_critique(answer: Column, context: Column, safe: str = SAFE_CRITIQUE) -> Column:
    """The critique, or the safe text where the context contradicts it."""
    return F.when(verification.grounded_critique(answer, context), answer).otherwise(F.lit(safe))


def checked_candidates(questions: DataFrame, candidates: DataFrame, sources: DataFrame, key: str = "question_id") -> DataFrame:
    """key, answer, provider of the candidates that say something: sanitised, and a critique that any of its sources contradicts
    is replaced by the safe text. questions: key, mode. Null and empty candidates have no row."""
    rows = candidates.select(key, sanitize_answer(F.coalesce("answer", F.lit(""))).alias("said")).where("said <> ''").join(questions.select(key, "mode"), key)
    critiques = rows.where("mode = 'critique'")
    read = sources.join(critiques.select(key), key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("source_index", "text"))).alias("s"))
    judged = critiques.join(read.select(key, F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("context")), key, "left")
    judged = judged.select(key, "said", safe_critique(F.col("said"), F.coalesce("context", F.lit(""))).alias("answer"))
    # fixed value: the provider's name of replaced critiques
    provider = F.when(F.col("answer") == F.col("said"), "generated").otherwise("ollama-safety-guard")
    others = rows.where("mode <> 'critique' OR mode IS NULL").select(key, F.col("said").alias("answer"), F.lit("generated").alias("provider"))
    return judged.select(key, "answer", provider.alias("provider")).unionByName(others)


def repaired_sources(sources: DataFrame) -> DataFrame:
    """sources with their texts repaired; null texts become empty, other columns stay."""
    return sources.withColumn("text", T.repair_text_artifacts(F.coalesce("text", F.lit(""))))


def combine_sources(sources: DataFrame, key: str = "question_id", n: int = 3) -> DataFrame:
    """key, context: the first n source texts, a line each."""
    first = sources.where(F.col("source_index") < n).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("source_index", "text"))).alias("s"))
    return first.select(key, F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("context"))


def best_span(spans: DataFrame, key: str = "question_id", least: float = 0.02) -> DataFrame:
    """key, answer: the span with the greatest score of a table of model spans."""
    fine = spans.where((F.col("score") >= least) & T.usable_span(F.col("answer")))
    return fine.groupBy(key).agg(F.max_by("answer", F.struct("score", -F.col("chunk_index"))).alias("answer")).select(key, F.concat(F.lit(PREFIX), "answer").alias("answer"))


def extractive_answers(questions: DataFrame, sources: DataFrame, key: str = "question_id") -> DataFrame:
    both = combine_sources(sources, key).join(questions.select(key, T.meaningful_terms(F.col("question")).alias("terms")), key)
    return both.select(key, F.concat(F.lit(PREFIX), relevant_passage(F.col("terms"), F.col("context"))).alias("answer"))


def build_answers(questions: DataFrame, sources: DataFrame, candidates: DataFrame | None = None, spans: DataFrame | None = None, profiles: DataFrame | None = None, key: str = "question_id") -> DataFrame:
    """key, answer, provider: no sources, application criteria, generated candidate, profile of a summary question, notice for
    a critique that no model wrote, best span, extractive passage.

    questions: key, question, mode (and doc_id, if there are profiles). Each branch takes the questions that the ones before
    it left (left anti joins), so that hooks see few rows.
    """
    with_sources = sources.select(key).distinct()
    out = questions.join(with_sources, key, "left_anti").select(key, F.lit(NO_SOURCES).alias("answer"), F.lit("retrieval").alias("provider"))
    left = questions.join(with_sources, key, "left_semi")
    branches = [(application_requirements(questions, sources, key), "application-requirements-structure")]
    if candidates is not None:
        branches.append((checked_candidates(left, candidates, sources, key), None))
    if profiles is not None:
        branches.append((left.where("mode = 'summary'").join(profiles, "doc_id").where("summary <> ''").select(key, F.col("summary").alias("answer")), "document-profile"))
    branches.append((questions.where("mode = 'critique'").select(key, F.lit(CRITIQUE_NOTICE).alias("answer")), "critique-fallback"))
    if spans is not None:
        branches.append((best_span(spans, key), "span"))
    branches.append((extractive_answers(questions, sources, key), "extractive-fallback"))
    for rows, provider in branches:
        took = left.select(key).join(rows, key)
        out = out.unionByName(took.select(key, "answer", F.lit(provider).alias("provider") if provider else "provider"))
        left = left.join(took, key, "left_anti")
    return out


def finalize(no_answer: Column, verified: Column, evidence: Column) -> Column:
    """keep, evidence-fallback, confirmed-no-answer or refuse, for a candidate answer."""
    return F.when(no_answer & evidence, "evidence-fallback").when(no_answer, "confirmed-no-answer").when(verified, "keep").when(evidence, "evidence-fallback").otherwise("refuse")


def evidence_answers(questions: DataFrame, sources: DataFrame, evidence: DataFrame, key: str = "question_id") -> DataFrame:
    """key, answer, passage: what the evidence source says; `passage` is the extract, `answer` a discount sentence where one fits.

    evidence: the rows of `evidence_support`. Questions whose evidence names no source read their first three sources.
    """
    named = evidence.where("source_index IS NOT NULL").select(key, "source_index").join(sources.select(key, "source_index", "text"), [key, "source_index"]).select(key, F.col("text").alias("own"))
    rows = questions.select(key, "question").join(evidence.select(key, "percentages", "relations"), key).join(named, key, "left").join(combine_sources(sources, key), key, "left")
    passage = F.concat(F.lit(PREFIX), relevant_passage(T.meaningful_terms(F.col("question")), F.coalesce("own", "context", F.lit(""))))
    asked = T.normalize_for_matching(F.col("question"))
    quota = (F.size("percentages") > 0) & F.array_contains("relations", "discount") & asked.contains("kontenjan")
    filled = F.format_string(DISCOUNT, F.when(asked.contains("yks"), EXAM).otherwise(""), F.get("percentages", F.lit(0)), F.get("percentages", F.lit(0)))
    return rows.select(key, passage.alias("passage"), quota.alias("quota"), filled.alias("filled")).select(key, F.when(F.col("quota"), F.col("filled")).otherwise(F.col("passage")).alias("answer"), "passage")


def evidence_fallback(questions: DataFrame, sources: DataFrame, evidence: DataFrame, key: str = "question_id") -> DataFrame:
    """key, answer, supported: the evidence answer if it stands up to verification, else the passage with its own verdict.

    questions: key, question, mode. Only answers that differ from their passage are verified twice.
    """
    both = written(questions.join(evidence_answers(questions, sources, evidence, key), key))
    verdict = lambda rows: verification.validate_answers(rows, sources, key).select(key, "supported")
    first = both.join(verdict(both.where("answer <> passage").select(key, "question", "mode", "answer")), key, "left")
    first = written(first.withColumn("stands", F.coalesce("supported", F.lit(False))))
    plain = both.select(key, "question", "mode", F.col("passage").alias("answer")).join(first.where("stands").select(key), key, "left_anti")
    kept = first.where("stands").select(key, "answer", F.lit(True).alias("supported"))
    return kept.unionByName(plain.select(key, "answer").join(verdict(plain), key))


def finalize_candidates(questions: DataFrame, candidates: DataFrame, sources: DataFrame, key: str = "question_id") -> DataFrame:
    """key, answer, provider, decision, reason, supported of every question with a candidate answer.

    questions: key, question, mode; candidates: key, answer; one row a key in both. Null candidates count as empty answers.
    """
    evidence = written(verification.evidence_support(questions, sources, key))
    rows = questions.join(candidates.select(key, F.coalesce("answer", F.lit("")).alias("answer")), key).withColumn("no_answer", T.is_no_answer_response(F.col("answer")))
    verdict = verification.validate_answers(rows.where("NOT no_answer").select(key, "question", "mode", "answer"), sources, key).select(key, F.col("supported").alias("verified"))
    rows = rows.join(verdict, key, "left").join(evidence.select(key, F.col("supported").alias("evidence")), key)
    rows = written(rows.withColumn("verified", F.coalesce("verified", F.lit(False))).withColumn("decision", finalize(F.col("no_answer"), F.col("verified"), F.col("evidence"))))
    replaced = questions.join(rows.where("decision = 'evidence-fallback'").select(key), key, "left_semi")
    other = evidence_fallback(replaced, sources, evidence, key).select(key, F.col("answer").alias("fallback"), F.col("supported").alias("fallback_supported"))
    out = rows.join(other, key, "left")
    decision = F.col("decision")
    answer = F.when(decision == "evidence-fallback", F.col("fallback")).when(decision == "refuse", REFUSAL).otherwise(F.col("answer"))
    provider = F.when(decision == "evidence-fallback", "evidence-supported-fallback").when(decision == "refuse", "answer-grounding-guard").otherwise("generated")
    reason = (
        F.when(decision == "confirmed-no-answer", "no-retrieved-chunk-supports-main-claim").when(decision == "refuse", "unsupported-generated-answer")
        .when((decision == "evidence-fallback") & F.col("no_answer"), "model-no-answer-despite-supported-evidence").when(decision == "evidence-fallback", "unsupported-generation-replaced-by-supported-evidence")
    )
    supported = F.when(decision == "confirmed-no-answer", True).when(decision == "evidence-fallback", F.coalesce("fallback_supported", F.lit(False))).otherwise(F.col("verified"))
    return out.select(key, answer.alias("answer"), provider.alias("provider"), "decision", reason.alias("reason"), supported.alias("supported"))


def application_requirements(questions: DataFrame, sources: DataFrame, key: str = "question_id") -> DataFrame:
    """key, answer of the questions about application criteria that the programme's own sources answer."""
    asked = T.normalize_for_matching(F.col("question"))
    wanted = questions.where(asked.contains("basvur") & T.any_of(asked, ("sart", "kriter", "kosul"))).select(key)
    texts = sources.join(wanted, key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("source_index", "text"))).alias("s"))
    rows = texts.select(key, F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("context")).withColumn("n", T.normalize_for_matching(F.col("context"))).where(F.contains("n", F.lit("aday muhendis")))
    lines = F.transform(F.split("context", r"\R"), lambda x: F.btrim(T.normalize_whitespace(x), F.lit(" ,-")))
    departments = F.slice(F.array_distinct(F.filter(lines, lambda x: (F.length(x) <= 80) & x.rlike("Mühendisliği|Muhendisligi") & ~F.lower(x).rlike("^(?:aday |hangi |staj|program)"))), 1, 8)
    both_years = F.col("n").rlike(r"(?:^|\D)3\s+ve\s+(?:\.?4s?\s+inif|4\s+sinif)")
    years = F.when(both_years, CLASS_YEARS[0]).when(F.contains("n", F.lit("4 sinifta ogrenim goren muhendislik ogrencileri")), CLASS_YEARS[1])
    has = lambda *markers: reduce(lambda a, b: a & b, [F.contains("n", F.lit(m)) for m in markers])
    steps = F.array_compact(F.array(F.when(has("genel not ortalamasi", "universiteye giris sirasi"), GRADE_RULE), F.when(has("genel yetenek", "ingilizce", "teknik mulakat"), EXAM_STEPS)))
    rows = rows.select(key, years.alias("years"), departments.alias("departments"), steps.alias("steps"))
    sentences = F.concat_ws(" ", F.format_string(WHO_APPLIES, "years"), F.when(F.size("departments") > 0, F.format_string(DEPARTMENTS, F.array_join("departments", ", "))), F.when(F.size("steps") > 0, F.concat(F.array_join("steps", "; "), F.lit("."))))
    sentences = F.when(F.col("years").isNotNull(), sentences).otherwise(F.concat_ws(" ", F.when(F.size("departments") > 0, F.format_string(DEPARTMENTS, F.array_join("departments", ", "))), F.when(F.size("steps") > 0, F.concat(F.array_join("steps", "; "), F.lit(".")))))
    return rows.select(key, sentences.alias("answer")).where("answer <> ''")


def answer_payload(answers: DataFrame, sources: DataFrame, citations: DataFrame, key: str = "question_id") -> DataFrame:
    """key, answer, sources, citations, trace: what one answer gives its reader; answers: key, answer, provider."""
    s = sources.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("source_index", "text"))).alias("sources"))
    c = citations.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", "source_index", "claim"))).alias("citations"))
    out = answers.join(s, key, "left").join(c, key, "left")
    n = F.coalesce(F.size("citations"), F.lit(0))
    trace = F.struct("provider", F.coalesce(F.size("sources"), F.lit(0)).alias("retrieved"), F.greatest(n, F.lit(0)).alias("citation_count"), F.when(n > 0, "claim-level").otherwise("none").alias("citation_mode"))
    return out.select(key, "answer", "sources", "citations", trace.alias("trace"))


def order_answers(questions: DataFrame, chunks: DataFrame, k: int = 3, key: str = "question_id") -> DataFrame:
    """key, answer, provider, strategy of the questions that ask for the first or last part of their document.

    questions: key, doc_id, question, mode; chunks: doc_id, chunk_index, text. A latest-course question whose document has
    course rows gets its latest course; the rest are answered from the first or last k chunks. Documents without chunks
    answer nothing.
    """
    each = by_question(questions, F.struct(order_direction(F.col("question")).alias("direction"), is_latest_course_question(F.col("question")).alias("latest")), "x")
    asked = written(each.where("x.direction IS NOT NULL").select(*questions.columns, "x.direction", "x.latest"))
    of = lambda rows: chunks.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    latest = asked.where("latest")
    course = latest.join(latest_course(of(latest)), "doc_id")
    found = written(course.select(key, F.format_string(LATEST_COURSE, "term", "code", "name").alias("answer"), F.lit("transcript-structure").alias("provider"), F.lit(None).cast("string").alias("strategy")))
    left = written(asked.drop("latest").join(found.select(key), key, "left_anti"))
    picked = reduce(DataFrame.unionByName, [ordered_sources(of(left.where(F.col("direction") == d)), d, k).withColumn("direction", F.lit(d)) for d in ("first", "last")])
    place = F.row_number().over(Window.partitionBy(key).orderBy("chunk_index")) - 1
    # the branches of build_answers read the sources several times
    sources = written(left.select(key, "doc_id", "direction").join(picked, ["doc_id", "direction"]).select(key, place.alias("source_index"), "text"))
    built = build_answers(left.join(sources.select(key).distinct(), key, "left_semi"), sources, key=key)
    return found.unionByName(built.join(left.select(key, F.concat(F.lit("document-order-"), "direction").alias("strategy")), key).select(key, "answer", "provider", "strategy"))


def build_prompts(questions: DataFrame, sources: DataFrame, key: str = "question_id", most: int = 1600) -> DataFrame:
    """key, prompt: instruction of the mode, numbered sources and the question, for external batch inference."""
    listed = sources.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("source_index", F.left("text", F.lit(most)).alias("text")))).alias("s"))
    numbered = F.array_join(F.transform("s", lambda x: F.concat(F.lit("["), (x["source_index"] + 1).cast("string"), F.lit("] "), x["text"])), "\n\n")
    task = F.when(F.col("mode") == "summary", "Summarise only what the sources say.").when(F.col("mode") == "critique", "Assess only what the sources show.").otherwise("Answer only from the sources.")
    return questions.join(listed, key, "left").select(key, F.concat_ws("\n\n", task, numbered, F.concat(F.lit("Question: "), "question")).alias("prompt"))
