"""The whole evaluation on case files: guard and pipeline branches, per-case k, gates with guard cases, the report."""

import json

import pytest

from plumbline.plans import evaluate

FEE = "Öğrenim ücreti yıllık 90.000 TL olarak belirlenmiştir ve iki taksitte ödenir."
GRANT = "Burs oranı %50 olarak başarılı öğrenci için uygulanır."
OTHER = "Kampüste kütüphane, spor salonu ve yemekhane bulunur; ulaşım servisle sağlanır."


def case(i, question, **more):
    return {"id": i, "question": question, "chunks": [{"text": t} for t in (OTHER, FEE, GRANT)]} | more


def write(path, cases):
    path.write_text(json.dumps({"cases": cases}))
    return str(path)


def test_cases_from_files(spark, tmp_path):
    one = write(tmp_path / "pipeline.json", [
        case("fee", "Öğrenim ücreti yıllık ne kadar belirlenmiştir?", topK=1, expectedSourceChunks=[1], requiredAnswerTerms=["90.000"], forbiddenAnswerTerms=["80.000"]),
        case("wrong-gold", "Öğrenim ücreti yıllık ne kadar belirlenmiştir?", topK=2, expectedSourceChunks=[0], requiredAnswerTermGroups=[["seksen", "90.000"]]),
        case("noise", "asdfghjklqwrt", shouldAnswer=False),
    ])
    ask = "%50 burs oranı hangi öğrenci için uygulanır"
    two = write(tmp_path / "guard.json", [
        case("kept", ask, evaluationMode="guard", candidateAnswer=GRANT, requiredAnswerTerms=["50"]),
        case("wrong-percent", ask, evaluationMode="guard", candidateAnswer="Burs oranı %90 olarak uygulanır.", requiredAnswerTerms=["50"], forbiddenAnswerTerms=["90"]),
        case("invented", "Yıldız sayısı kaç", evaluationMode="guard", candidateAnswer="Gökyüzünde 9000 yıldız görünür.", shouldAnswer=False),
        case("let-through", ask, evaluationMode="guard", candidateAnswer=GRANT, shouldAnswer=False),
    ])
    scores, gates = evaluate.evaluate_files(spark, [one, two], str(tmp_path / "report"))
    got = {r.case_id: r for r in scores.collect()}
    assert len(got) == 7
    assert got["fee"].failures == [] and got["fee"].recall == 1 and got["fee"].precision == 1 and got["fee"].citation_correct and "90.000" in got["fee"].answer
    assert got["wrong-gold"].failures[0] == "expected-source-not-retrieved" or got["wrong-gold"].failures == ["supporting-source-not-cited"]
    assert got["noise"].provider == "retrieval-guard" and got["noise"].guard_reason == "gibberish-question" and got["noise"].passed
    assert got["kept"].passed and got["kept"].guard_correct and got["wrong-percent"].provider == "evidence-supported-fallback" and got["wrong-percent"].passed
    assert got["invented"].guard_reason == "unsupported-generated-answer" and got["invented"].passed
    assert got["let-through"].failures == ["answer-expectation-failed", "guard-expectation-failed"] and got["let-through"].guard_correct is False
    gates = {r.metric: r for r in gates.collect()}
    assert gates["guardAccuracy"].value == 0.75 and not gates["guardAccuracy"].passed and gates["noAnswerAccuracy"].value == pytest.approx(2 / 3, abs=1e-4)
    report = spark.read.json(str(tmp_path / "report")).first()
    assert report.passed is False and report.metrics.caseCount == 7 and len(report.gates) == 9


def test_cases_that_are_not_valid_stop_the_run(spark, tmp_path):
    bad = write(tmp_path / "bad.json", [case("x", "Soru?", evaluationMode="guard"), case("y", "Soru?"), case("y", "Soru?")])
    with pytest.raises(ValueError, match="missing-candidate"):
        evaluate.evaluate_files(spark, [bad], str(tmp_path / "report"))
