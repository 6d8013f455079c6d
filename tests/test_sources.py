"""Readers, writers and row builders: round trips over small files and rows."""

import io
import json
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import answering, verification as V
from plumbline.sources import tables as S

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_document_files(spark, tmp_path):
    p = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    cell = lambda x: f"<w:tc>{p(x)}</w:tc>"
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.TXT").write_bytes("  Bir\x00iki \n\n\n\n üç".encode() + b"\xff")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "blank.txt").write_bytes(b" \n ")
    (tmp_path / "x.exe").write_bytes(b"MZ")
    (tmp_path / "deep" / "b.docx").write_bytes(docx(p("First") + f"<w:tbl><w:tr>{cell('left')}{cell('left')}{cell('right')}</w:tr></w:tbl>" + p("") + p("Last")))
    fine, rejected = S.read_document_files(spark, str(tmp_path))
    name = lambda path: path.rsplit("/", 1)[1]
    assert {name(r.path) for r in fine.collect()} == {"a.TXT", "blank.txt", "b.docx"}
    assert {name(r.path): r.kind for r in rejected.collect()} == {"x.exe": "exe"}
    assert [(name(r.path), r.page_number, r.text) for r in S.extract_pages_txt(fine).collect()] == [("a.TXT", 1, "Bir iki \n\n üç")]
    assert [(name(r.path), r.text) for r in S.extract_pages_docx(fine).collect()] == [("b.docx", "First\n\nleft | right\n\nLast")]


def test_eval_cases_and_sources(spark, tmp_path):
    chunk = {"text": "t"}
    cases = [{"id": "a", "question": "q", "chunks": [chunk, {"pageNumber": 4, "text": "u", "score": 0.5}]}, {"id": "g", "question": "q", "chunks": [chunk], "evaluationMode": "guard"}, {"id": "m", "question": "q", "chunks": [chunk], "evaluationMode": "other"}, {"id": "n", "chunks": [chunk]}, {"id": "t", "question": "q", "chunks": []}, {"id": "t", "question": "q", "chunks": []}]
    (tmp_path / "cases.json").write_text(json.dumps({"cases": cases}, indent=1))
    fine, rejected = S.read_eval_cases(spark, [str(tmp_path / "cases.json")])
    assert [(r.id, r.evaluationMode, r.topK, r.shouldAnswer) for r in fine.collect()] == [("a", "pipeline", 3, True)]
    assert sorted(map(tuple, rejected.collect())) == [("g", "missing-candidate"), ("m", "unknown-mode"), ("n", "missing-field"), ("t", "repeated-id"), ("t", "repeated-id")]
    assert sorted(map(tuple, S.case_sources(fine).collect())) == [("a", 0, 1, 1.0, "t"), ("a", 1, 4, 0.5, "u")]


def test_report(spark, tmp_path):
    metrics = spark.createDataFrame([(0.5, 3)], "recall double, cases long")
    gates = spark.createDataFrame([("recall", 0.5, 0.4, True), ("mrr", 0.1, 0.4, False)], "metric string, value double, minimum double, passed boolean")
    S.write_report(metrics, gates, str(tmp_path / "report"))
    got = spark.read.json(str(tmp_path / "report")).collect()
    assert len(got) == 1 and got[0].passed is False and got[0].metrics.cases == 3 and {g.metric: g.passed for g in got[0].gates} == {"recall": True, "mrr": False} and got[0].schemaVersion == 1


def test_audit_and_chat_rows(spark):
    at = datetime(2024, 1, 2)
    events = spark.createDataFrame([(1, "share", 5, {"scope": "DEPARTMENT"}, at), (1, "open", 6, None, at)], "actor_id long, action string, doc_id long, details map<string,string>, created_at timestamp")
    assert [r.details for r in S.audit_rows(events).orderBy("doc_id").collect()] == ['{"scope":"DEPARTMENT"}', '{"serializationError":true}']
    chats = spark.createDataFrame([(1, 2, "q" * 3000, "a", [{"n": 1}], None, at)], "owner_id long, doc_id long, question string, answer string, sources array<map<string,int>>, citations array<string>, created_at timestamp")
    row = S.chat_rows(chats).collect()[0]
    assert len(row.question) == 2000 and row.sources_json == '[{"n":1}]' and row.citations_json == "[]"
    back = S.chat_rows(chats).select(T.json_or_empty(F.col("sources_json"), "array<map<string,int>>").alias("s"), T.json_or_empty(F.lit(None).cast("string"), "array<string>").alias("c")).collect()[0]
    assert back.s == [{"n": 1}] and back.c == []


def test_cache_key_and_sanitised_answers(spark):
    q = spark.createDataFrame([("d", "Ne  kadar?", 3, "v1"), ("d", " ne kadar? ", 3, "v1"), ("d", "ne kadar?", 3, "v2"), ("d", "ne kadar?", 4, "v1"), ("e", "ne kadar?", 3, "v1")], "doc string, q string, k int, v string")
    keys = [r[0] for r in q.select(T.answer_cache_key(F.col("doc"), F.col("q"), F.col("k"), F.col("v"), "m")).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 4
    a = spark.createDataFrame([("Cevap:  iki   söz (Kaynak: 1, 2)",), ("ANSWER : x",), ("düz",), (None,)], "a string")
    assert [r[0] for r in a.select(answering.sanitize_answer(F.col("a"))).collect()] == ["iki söz", "x", "düz", None]


def test_repaired_sources(spark):
    s = spark.createDataFrame([(1, "/uni0130zm/idotaccentr caf/uni00e9 ü"), (2, None), (3, ""), (4, "/uniD800 /unizz")], "id long, text string")
    assert [r.text for r in answering.repaired_sources(s).orderBy("id").collect()] == ["İzmir café ü", "", "", "/uniD800 /unizz"]


def test_no_answer_is_grounded_without_evidence(spark):
    a = spark.createDataFrame([(1, "Bu bilgi belgede yer almıyor.", "factual", "%50 burs oranı nedir"), (2, "Bu bilgi belgede yer almıyor.", "factual", "%90 burs oranı nedir"), (3, "Bu bilgi belgede yer almıyor.", "factual", None), (4, " ", "factual", "x")], "answer_id long, answer string, mode string, question string")
    s = spark.createDataFrame([(i, 0, "Burs oranı %50 olarak uygulanır.") for i in (1, 2, 3, 4)], "answer_id long, source_index int, text string")
    assert dict(V.grounded_answers(a, s).collect()) == {1: False, 2: True, 3: True, 4: False}
    assert V.grounded_answers(a.limit(0), s).count() == 0


def test_checked_candidates(spark):
    q = spark.createDataFrame([(1, "critique"), (2, "critique"), (3, "factual"), (4, "critique"), (5, "critique")], "question_id long, mode string")
    bad = "Cevap: Deneyimler tarihlendirilmemiş"
    c = spark.createDataFrame([(1, bad), (2, bad), (3, bad), (4, None), (5, bad)], "question_id long, answer string")
    s = spark.createDataFrame([(1, 0, "x"), (1, 5, "2019 yılı"), (2, 0, "yıl yok"), (3, 0, "2019")], "question_id long, source_index int, text string")
    got = {r.question_id: (r.answer, r.provider) for r in answering.checked_candidates(q, c, s).collect()}
    kept = ("Deneyimler tarihlendirilmemiş", "generated")
    assert got == {1: (answering.SAFE_CRITIQUE, "ollama-safety-guard"), 2: kept, 3: kept, 5: kept}
