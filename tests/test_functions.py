from pyspark.sql import functions as F

from plumbline.functions import facts as K, text as T
from plumbline.operators import chunking, citations, guard, retrieval as R, verification as V


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t"))).first()[0]


def test_normal_forms(spark):
    assert one(spark, "IĞDIR İstanbul ÇÖP", T.normalize_for_matching) == "igdir istanbul cop"
    assert one(spark, "  a\t\n b  ", T.normalize_whitespace) == "a b"
    assert one(spark, "Straße", T.eval_normalize) == "strasse"


def test_terms_and_matches(spark):
    assert sorted(one(spark, "Bu belgede burs oranı ve ücret", T.meaningful_terms)) == ["burs", "orani", "ucret"]
    row = spark.sql("SELECT array('indirimi', 'burslar') AS s")
    assert row.select(T.term_matches(F.lit("indirim"), F.col("s")), T.entity_matches(F.lit("burslu"), F.col("s")), T.entity_matches(F.lit("oda"), F.col("s"))).first()[:] == (True, True, False)


def test_facts(spark):
    f = one(spark, "Ücret 48.000 TL, %12,50 indirim, 30 gün, son tarih 15.07.2026 ve 3 Mart 2025; 17 kişi.", K.extract_claim_facts)
    assert f.asDict() == {"percentages": ["12.5"], "money": ["48000:try"], "durations": ["30:gun"], "dates": ["2025-03-03", "2026-07-15"], "numbers": ["17"]}
    for raw, want in (("1.234,50", "1234.5"), ("1,234.50", "1234.5"), ("3,5", "3.5"), ("48.000", "48000"), ("1.2.3", "123"), ("007", "7"), ("10", "10"), ("2.50", "2.5")):
        assert one(spark, raw, K.canonical_number) == want, raw


def test_polarity_and_relations(spark):
    assert one(spark, "Bu ücret iade edilmez", T.has_negative_polarity)
    assert one(spark, "İndirim oranı ve ödeme tarihi", T.relation_concepts) == ["discount", "fee", "date", "payment"]


def test_words_end_at_accented_letters_of_other_languages(spark):
    """As in the queries' SQL: è is no letter of the normal form."""
    assert one(spark, "dans surenmentoiè", T.relation_concepts) == ["duration"]
    assert one(spark, "êburs oranı", T.relation_concepts) == ["scholarship"]
    assert one(spark, "la ilè", R.expand_aliases).startswith("la ilè yer konum")
    assert one(spark, "èkimdr", R.correct_typos) == "èkimdir"
    assert one(spark, "ilkè", R.order_direction) == "first"
    assert one(spark, "alinmazè", T.has_negative_polarity)
    assert one(spark, "è30 günè", K.extract_claim_facts)["durations"] == ["30:gun"]


def test_balances_are_usable_spans_as_sql_writes_them(spark):
    """The negative zero of a rounded balance is no plain number; large and small ones are written without an exponent."""
    rows = [(x,) for x in (-0.0, 0.0, 12.5, -3.0, 12345678.25, 1e12, 1e16, 0.0005, 1e-5, float("nan"), float("inf"), None)]
    out = spark.createDataFrame(rows, "x double").coalesce(1).select(T.usable_span(T.decimal_text(F.col("x"))))
    assert [r[0] for r in out.collect()] == [False, True, True, False, True, True, False, True, False, False, False, None]


def test_packing():
    assert chunking.pack_words("aa bb cccccc d".split(), 5) == ["aa bb", "ccccc", "c", "d"]
    blocks = ["x" * 50, "y" * 50, "z" * 50]
    assert chunking.pack_blocks(blocks, 110, 60) == ["x" * 50 + "\n\n" + "y" * 50, "y" * 50 + "\n\n" + "z" * 50]
    assert chunking.overlap_blocks(["aaaa", "bb", "cc"], 6) == ["bb", "cc"]


def test_chunks_are_dense_and_bounded(spark):
    text = "\n\n".join(f"Paragraph {i} says something about the matter at hand, at some length." for i in range(80))
    rows = chunking.chunk_documents(spark.createDataFrame([(1, 1, text), (2, 1, "short"), (3, 1, None)], "doc_id long, page_number int, text string")).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and all(80 <= len(r.text) <= 1200 for r in rows) and {r.doc_id for r in rows} == {1}


def test_heading_chunks(spark):
    body = "Metin burada uzunca devam eder ve bölümün içeriğini yeterince açık biçimde anlatır, örnekler verir."
    text = "\n".join(f"MADDE {i}\n{body}" for i in range(1, 5))
    rows = chunking.chunk_documents(spark.createDataFrame([(1, 1, text)], "doc_id long, page_number int, text string")).collect()
    assert len(rows) == 4 and all(r.text.startswith("MADDE") for r in rows)


def test_question_analysis(spark):
    assert one(spark, "Bu belgenin ana konusu nedir?", R.classify_response_mode) == "summary"
    assert one(spark, "Sence zayıf yönleri neler?", R.classify_response_mode) == "critique"
    assert one(spark, "en son ders hangisi", R.order_direction) == "last"
    assert "ders sorumlusu" in one(spark, "egitmen kimdr", R.expand_aliases)


def test_guard(spark):
    q = spark.createDataFrame([("asdkjhgtr",), ("Mars roket nasil gidilir",), ("burs orani nedir",)], "q string")
    got = [r[0] for r in q.select(guard.guard_reason(F.col("q"), F.array(F.lit("burs"), F.lit("orani")), F.lit(0.5))).collect()]
    assert got == ["gibberish-question", "general-knowledge-question", None]


def test_claims(spark):
    answers = spark.createDataFrame([(1, "Burs oranı %50 olarak uygulanır. Kayıt ücreti 300 TL tutar.", "factual")], "answer_id long, answer string, mode string")
    sources = spark.createDataFrame([(1, 0, "Başarı bursu verilir. Burs oranı %50 olarak uygulanır."), (1, 1, "Kayıt ücreti 250 TL tutar.")], "answer_id long, source_index int, text string")
    rows = {r.claim_no: r for r in V.match_claims(answers, sources).collect()}
    assert rows[0].supported and rows[0].source_index == 0
    assert not rows[1].supported and rows[1].reason == "critical-fact-mismatch"
    assert V.validate_answers(answers, sources).first().n_supported == 1


def test_citation_marks():
    text, numbers = citations.mark("A is one. B is two.", ["A is one.", "B is two.", "C"])
    assert text == "A is one [1]. B is two [2]." and numbers == [1, 2, 0]
    assert len(citations.quote("needle word", "x " * 400 + "needle word here. " + "y " * 400, 200)) <= 206


def test_rrf(spark):
    d = spark.createDataFrame([(1, 10, 0.5, 1)], "q int, c int, dense double, dense_rank int")
    s = spark.createDataFrame([(1, 11, 0.5, 1)], "q int, c int, sparse double, sparse_rank int")
    assert {r.c: round(r.hybrid, 6) for r in R.rrf_merge(d, s, ["q", "c"]).collect()} == {10: round(1 / 61, 6), 11: round(1 / 61, 6)}


def test_grounded_answers(spark):
    answers = spark.createDataFrame([(1, "Burs oranı %50 olarak uygulanır.", "factual"), (2, "", "factual"), (3, "Bu bilgi belgede yok", "factual"), (4, "Teknik beceriler eksik.", "critique"), (5, "Anlatım açık.", "critique"), (6, None, "critique")], "answer_id long, answer string, mode string")
    sources = spark.createDataFrame([(i, 0, "Burs oranı %50 olarak uygulanır. Java ve Python bilir.") for i in range(1, 7)], "answer_id long, source_index int, text string")
    assert dict(V.grounded_answers(answers, sources).collect()) == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}


def test_inflected_terms_match(spark):
    q = spark.createDataFrame([(1, "burs kitap"), (2, "xyz")], "q long, text string")
    c = spark.createDataFrame([(1, "kitaplar burada"), (2, "bursun kitabi ve kitap"), (3, None)], "c long, text string")
    assert {(r.q, r.c): r.sparse for r in R.lexical_search(q, c, ["q"], ["c"]).collect()} == {(1, 1): 0.5, (1, 2): 1.0}


def test_missing_gates_fail(spark):
    from plumbline.operators import evaluation

    rows = evaluation.quality_gates(spark.createDataFrame([(1.0, None)], "casePassRate double, recallAtK double")).collect()
    assert len(rows) == 9 and [r.metric for r in rows if r.passed] == ["casePassRate"]


def test_answer_payload(spark):
    from plumbline.operators import answering as A

    a = spark.createDataFrame([(1, "x", "generated"), (2, "y", "none")], "question_id long, answer string, provider string")
    s = spark.createDataFrame([(1, 0, "s"), (1, 1, "t")], "question_id long, source_index int, text string")
    c = spark.createDataFrame([(1, 1, 0, "x")], "question_id long, id int, source_index int, claim string")
    got = {r.question_id: r.trace for r in A.answer_payload(a, s, c).collect()}
    assert (got[1].retrieved, got[1].citation_count, got[1].citation_mode) == (2, 1, "claim-level") and (got[2].retrieved, got[2].citation_count, got[2].citation_mode) == (0, 0, "none")


def test_features_of_a_text_take_its_normal_form_once(spark):
    for f in (T.relation_concepts, T.has_negative_polarity):
        assert str(f(F.col("t"))).count("lower(") == 1
    assert "array_except" not in str(T.claim_content_terms(F.col("t")))
    assert one(spark, "Bu indirim, bu indirim uygulanmaz ve burs yok", T.claim_content_terms) == ["indirim", "uygulanmaz", "burs", "yok"]
    assert one(spark, "Gelmez", T.has_negative_polarity) and not one(spark, "Kamera mezun", T.has_negative_polarity)
    assert one(spark, None, T.relation_concepts) == [] and one(spark, None, T.has_negative_polarity) is None


def test_windows_of_asked_sources_only(spark):
    answers = spark.createDataFrame([(1, "Burs oranı yüzde 50.", "factual")], "answer_id int, answer string, mode string")
    sources = spark.createDataFrame([(1, 0, "Burs oranı yüzde 50."), (2, 0, "x")], "answer_id int, source_index int, text string")
    m = V.match_claims(answers, sources)
    assert "LeftSemi" in m._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.answer_id, r.supported) for r in m.collect()] == [(1, True)]


def test_rare_dates_are_looked_for_only_where_they_can_be(spark):
    assert str(K.extract_dates(F.col("t"))).count("CASE WHEN") >= 2
    assert one(spark, "1 mayis 2024, 2023-02-03 ve 4.5.2022", K.extract_dates) == ["2022-05-04", "2023-02-03", "2024-05-01"]
    assert one(spark, None, K.extract_dates) is None


def test_blocks_of_a_row_are_semantic_blocks(spark):
    """Packing takes its blocks from each page's row, and cuts the texts of few rows at once."""
    texts = ["one\ntwo\n\n 1. three\n2. four\r\nfive:\nsix", "\n \n", None, "A LOUD LINE\nsoft\nLOUD AGAIN\n\n\nend", ""]
    pages = spark.createDataFrame([(i % 3, i, t) for i, t in enumerate(texts)], "doc_id long, page_number int, text string")
    want = {}
    for r in sorted(chunking.semantic_blocks(pages).collect(), key=lambda r: r.block_no):
        want.setdefault(r.page_number, []).append(r.block)
    assert {r.page_number: r.blocks for r in chunking.page_blocks(pages).collect() if r.blocks} == want and want[3] == ["A LOUD LINE\nsoft", "LOUD AGAIN", "end"]
    rows = spark.range(300).selectExpr("id", "array('a', 'b') AS x").coalesce(1)
    out = chunking.cut_rows(rows, ["x"], lambda x: x)
    assert sorted(map(tuple, out.collect())) == [(i, k, t) for i in range(300) for k, t in enumerate("ab")]


def test_terms_met_are_those_of_entity_matches(spark):
    """One search in all held terms as a text finds what a look at each of them finds: parts, wholes, beginnings, no match across terms."""
    import random

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("ab1") for _ in range(rng.randrange(3, 11)))
    rows = [([word() for _ in range(rng.randrange(0, 9))], [word() for _ in range(rng.randrange(0, 4))]) for _ in range(400)]
    rows += [(["kitaplar", "ara"], ["kit", "apl", "kitaptan"]), (["abc"], None), (None, ["abc"]), (["bca", "aabb"], ["aab", "cab"])]
    df = spark.createDataFrame(rows, "a array<string>, h array<string>")
    one = F.filter("a", lambda t: T.entity_matches(t, F.col("h")))
    got = df.select("a", "h", one.alias("want"), T.terms_met(F.col("a"), F.col("h")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    assert 100 < sum(len(r.got or []) for r in got) < sum(len(r.a or []) for r in got) - 100


def test_facts_take_a_text_a_few_times_and_no_border_first(spark):
    """Each pattern runs over the whole text once and begins with a character that few places have; its matches are those of the plain pattern."""
    import random

    plan = str(K.extract_claim_facts(F.col("t")))
    assert plan.count("regexp_extract_all(") <= 8
    rng = random.Random(3)
    bits = ["1", "30", "2024", "19", ".", ",", "/", "-", " ", "%", "yuzde ", "tl", "euro", "₺", "gun", "ay", "'", "a", "_", "mart", "è", "x", "\n", "007"]
    rows = [("".join(rng.choice(bits) for _ in range(rng.randrange(1, 12))),) for _ in range(3000)]
    rows += [("5 tl'3",), ("a5 tl 6tl",), ("%%5 yuzde 6 xyuzde 7",), ("45.12.2024 1.2.34 è3-4-56",), ("2024-01-02-03",), ("a12b 3,4c 5.6",)]
    df = spark.createDataFrame(rows, "t string")
    every = lambda p, i: F.regexp_extract_all("t", F.lit(p), F.lit(i))
    for pattern in (K.MONEY, K.LIRA, K.DURATION, K.PERCENT, K.DAY_FIRST, K.ISO, K.NAMED, r"(?<![a-z])\d+(?:[.,]\d+)*(?![a-z])"):
        assert df.where(every(T.ascii_borders(pattern), 0) != every(K.fast(pattern), 0)).collect() == [], pattern
        assert not K.fast(pattern).startswith("(?:(?<!"), pattern
    both = df.select(F.arrays_zip(every(K.fast(K.MONEY), 1).alias("a"), every(K.fast(K.MONEY), 2).alias("b")).alias("x"), F.transform(every(K.fast(K.MONEY), 0), lambda m: F.struct(K.group(m, K.MONEY, 1).alias("a"), K.group(m, K.MONEY, 2).alias("b"))).alias("y"))
    assert both.where("x <> y").count() == 0 and both.where("size(x) > 0").count() > 50
