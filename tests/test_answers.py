"""Decisions over candidate answers, ordered and structured answers, reused question vectors."""

from plumbline.operators import answering as A, retrieval as R

Q = "question_id long, question string, mode string"
S = "question_id long, source_index int, text string"


def test_finalize_candidates(spark):
    ask = "%50 burs oranı hangi öğrenci için uygulanır"
    q = spark.createDataFrame([(i, ask if i != 4 else "Yıldız sayısı kaç", "factual") for i in range(1, 6)], Q)
    fact = "Burs oranı %50 olarak başarılı öğrenci için uygulanır."
    s = spark.createDataFrame([(i, 0, fact) for i in (1, 2, 3)] + [(4, 0, "Başka bir konu anlatılır."), (5, 0, fact)], S)
    c = spark.createDataFrame([(1, fact), (2, "Burs oranı %90 olarak uygulanır."), (3, "Bu bilgi belgede yer almıyor"), (4, "Gökyüzünde 9000 yıldız görünür."), (5, None)], "question_id long, answer string")
    got = {r.question_id: r for r in A.finalize_candidates(q, c, s).collect()}
    assert [got[i].decision for i in range(1, 6)] == ["keep", "evidence-fallback", "evidence-fallback", "refuse", "evidence-fallback"]
    assert got[1].answer == fact and got[2].answer == A.PREFIX + fact and got[4].answer == A.REFUSAL
    assert got[2].reason == "unsupported-generation-replaced-by-supported-evidence" and got[3].reason == "model-no-answer-despite-supported-evidence" and got[2].supported
    assert A.finalize_candidates(q.limit(0), c, s).count() == 0


def test_application_requirements(spark):
    q = spark.createDataFrame([(1, "Başvuru şartları neler?", "factual"), (2, "Başvuru kriterleri?", "factual"), (3, "Ücret ne?", "factual")], Q)
    text = "Aday Mühendis programı\nBilgisayar Mühendisliği\nMakine Mühendisliği,\n4 sınıfta öğrenim gören mühendislik öğrencileri\nGenel Yetenek, İngilizce ve teknik mülakat"
    s = spark.createDataFrame([(1, 0, text), (2, 0, "Aday mühendis\nMakine Mühendisliği"), (3, 0, text)], S)
    got = dict(A.application_requirements(q, s).collect())
    assert got == {1: "Belgeye göre 4. sınıfta öğrenim gören mühendislik öğrencileri başvurabilir. Uygun bölümler: Bilgisayar Mühendisliği, Makine Mühendisliği. " + A.EXAM_STEPS + ".", 2: "Uygun bölümler: Makine Mühendisliği."}


def test_order_answers(spark):
    q = spark.createDataFrame([(1, 7, "en son aldığı ders hangisi", "factual"), (2, 8, "ilk bölüm neyi anlatır", "factual"), (3, 7, "ücret ne", "factual"), (4, 9, "ilk bölüm", "factual")], "question_id long, doc_id long, question string, mode string")
    chunks = spark.createDataFrame([(7, 0, "2022-2023 Güz\nBIL101-0001 Giriş 3 A1 4,0 5 x"), (7, 1, "2023-2024 Bahar\nBIL202-0001 Veri Yapıları 3 A1 4,0 5 x"), (8, 0, "Birinci bölüm tarihi anlatır."), (8, 1, "Orta."), (8, 2, "Son söz.")], "doc_id long, chunk_index int, text string")
    got = {r.question_id: r for r in A.order_answers(q, chunks, 1).collect()}
    assert set(got) == {1, 2} and got[1].provider == "transcript-structure" and "BIL202-0001 Veri Yapıları" in got[1].answer
    assert got[2].strategy == "document-order-first" and got[2].answer == "Belgeye göre: Birinci bölüm tarihi anlatır."


def test_embed_questions(spark):
    q = spark.createDataFrame([(1, "Same  question"), (2, "same question"), (3, None), (4, "")], "id long, text string")
    rows = R.embed_questions(q, ["id"]).collect()
    one, two = (sorted((r.bucket, r.weight) for r in rows if r.id == i) for i in (1, 2))
    assert one == two and len(one) == 2 and len(rows) == 4


def test_exploded_rows_are_not_sent_through_the_driver(spark):
    """Scopes, windows and features are many more bytes than the tables that Spark guesses their size from."""
    import __spark_entry__ as entry

    for name in ("accessible_documents", "document_permissions", "validate_notices", "question_alignment", "grounded_answers"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, name
        assert len(plan) < 250_000, name  # facts of questions and answers are named once


def test_courses_are_looked_for_where_they_are_asked_for(spark, monkeypatch):
    from plumbline.operators import answering

    read = []

    def spied(chunks):
        read.extend(r.doc_id for r in chunks.select("doc_id").distinct().collect())
        return latest(chunks)

    latest = answering.latest_course
    monkeypatch.setattr(answering, "latest_course", spied)
    q = spark.createDataFrame([(1, 1, "En son aldığı ders hangisi?", "factual"), (2, 2, "İlk bölüm neyi anlatır?", "factual"), (3, 3, None, "factual")], "question_id int, doc_id int, question string, mode string")
    c = spark.createDataFrame([(d, 0, "2020-2021 Güz\nDRS101-2020 Konu 3 A1 4,0 5") for d in (1, 2, 3)], "doc_id int, chunk_index int, text string")
    got = {r.question_id: r.strategy for r in answering.order_answers(q, c).collect()}
    assert got == {1: None, 2: "document-order-first"} and read == [1]


def test_claims_of_oddly_spaced_answers(spark):
    """Claims are those of the plain form, whatever blanks stand in an answer."""
    from pyspark.sql import functions as F

    from plumbline.operators import verification as V

    want = {"BELGEYE  göre:  Bir. İki ;  üç ; -": ["Bir.", "İki", "üç"], " a\t b\n": ["a b"], "No. 3. A; - x -": ["No. 3. A", "x"], "Belgeye göre": ["Belgeye göre"], "": [], " ; ": [";"]}
    rows = spark.createDataFrame([(x,) for x in want], "x string").select("x", V.split_claims(F.col("x")).alias("c")).collect()
    assert {r.x: r.c for r in rows} == want


def test_claims_look_for_their_terms_in_units(spark, monkeypatch):
    """A window's terms are those of its units: each claim and unit meet once, and matches are those of all windows, each text once."""
    import random

    from pyspark.sql import functions as F

    from plumbline.functions import text as T
    from plumbline.operators import verification as V

    rng = random.Random(5)
    word = lambda: rng.choice(["burs", "burslar", "oran", "ucret", "egitim", "egitimi", "okul", "kitap", "kitaplar", "gun", "12", "2024", "%5"])
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice(". .! ? .".split())
    sources = [(k, i, " ".join(sentence(rng.randrange(1, 6)) for _ in range(rng.randrange(0, 6)))) for k in range(12) for i in range(3)] + [(0, 3, None), (1, 3, "Burs var. Burs var. Burs var."), (2, 3, "a\n\nA b. a\n\nA b.")]
    answers = [(k, " ".join(sentence(rng.randrange(2, 7)) for _ in range(3)), rng.choice(["factual", "summary"])) for k in range(13)]
    s = spark.createDataFrame(sources, "answer_id int, source_index int, text string")
    windows = s.select("answer_id", "source_index", F.explode(V.each_text_once(V.unit_windows(V.evidence_units(F.col("text"))))).alias("w")).select("*", "w.*").collect()
    assert len({(w.answer_id, w.source_index, w.text) for w in windows}) == len(windows)
    units = {(r.answer_id, r.source_index): r.u for r in s.select("answer_id", "source_index", V.evidence_units(F.col("text")).alias("u")).collect()}
    assert all(w.text == " ".join(units[w.answer_id, w.source_index][w.first : w.first + w.units]) for w in windows)
    looked = []
    met = T.terms_met
    monkeypatch.setattr(V.T, "terms_met", lambda asked, held: looked.append(1) or met(asked, held))
    m = V.match_claims(spark.createDataFrame(answers, "answer_id int, answer string, mode string"), s)
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert looked and "transform(held" in plan
    terms = lambda texts: {r.t: r.x for r in spark.createDataFrame([(t,) for t in sorted(set(texts))], "t string").select("t", T.claim_content_terms(F.col("t")).alias("x")).collect()}
    got = m.collect()
    of, held = terms(r.claim for r in got), terms(w.text for w in windows)
    pairs = [(r.answer_id, r.claim_no, w.ord, w.source_index, of[r.claim], held[w.text]) for r in got for w in windows if w.answer_id == r.answer_id]
    best = spark.createDataFrame(pairs, "k int, n int, ord int, i int, a array<string>, h array<string>").select("*", F.array_sort(F.filter("a", lambda t: T.entity_matches(t, F.col("h")))).alias("m")).collect()
    every = {}
    for r in best:
        every.setdefault((r.k, r.n, r.i), []).append(r.m)
    assert sum(bool(r.matched) for r in got) > 20
    assert all(r.matched in every[r.answer_id, r.claim_no, r.source_index] and r.coverage == round(len(r.matched) / max(len(of[r.claim]), 1), 4) for r in got if r.source_index is not None)
