"""Publishing of versions, access by scope, and model hooks with their fallbacks."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import answering, models, operations as O, retrieval as R
from plumbline.sources import versions

DOCS = "doc_id long, chunk_index int, text string, tags map<string,string>"


def rows(df):
    return sorted(((r.doc_id, r.chunk_index, r.text) for r in df.collect()), key=str)


@pytest.fixture
def base(spark, tmp_path):
    docs = [(i, c, f"old {i}.{c}", {"a": "b"}) for i in range(20) for c in range(2)] + [(None, 0, "no key", None)]
    versions.publish(spark, str(tmp_path), spark.createDataFrame(docs, DOCS), buckets=4, files=2, batch="first")
    return str(tmp_path)


def test_publish_replaces_and_deletes(spark, base):
    before = rows(versions.live(spark, base))
    new = spark.createDataFrame([(3, 0, "new 3", None), (40, 0, "new 40", None), (5, 0, "new 5", None)], DOCS)
    gone = spark.createDataFrame([(4,), (5,), (99,)], "doc_id long")
    assert versions.publish(spark, base, new, gone, batch="second") == 2
    want = [r for r in before if r[0] not in (3, 4, 5)] + [(3, 0, "new 3"), (40, 0, "new 40"), (5, 0, "new 5")]
    assert rows(versions.live(spark, base)) == sorted(want, key=str)
    assert rows(versions.live(spark, base, 1)) == before


def test_a_batch_that_comes_twice_changes_nothing(spark, base):
    new = spark.createDataFrame([(None, 0, "another", None), (1, 0, "new", None)], DOCS)
    assert [versions.publish(spark, base, new, batch="b"), versions.publish(spark, base, new, batch="b")] == [2, 2]
    assert [r[2] for r in rows(versions.live(spark, base)) if r[0] is None] == ["another", "no key"]
    assert versions.manifests(spark, base).count() == 2


def test_readers_keep_their_version(spark, base):
    reader = versions.live(spark, base)
    before = rows(reader)
    versions.publish(spark, base, deleted=spark.range(20).select(F.col("id").alias("doc_id")))
    assert rows(reader) == before and [r[2] for r in rows(versions.live(spark, base))] == ["no key"]


def test_a_failed_publish_leaves_the_version_before(spark, base):
    before = rows(versions.live(spark, base))
    bad = spark.createDataFrame([(1, 0, "x", None)], DOCS).withColumn("text", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        versions.publish(spark, base, bad)
    assert rows(versions.live(spark, base)) == before
    assert versions.publish(spark, base, spark.createDataFrame([(1, 0, "x", None)], DOCS)) == 2


def test_untouched_buckets_are_not_written(spark, base):
    versions.publish(spark, base, spark.createDataFrame([(7, 0, "new", None)], DOCS))
    one, two = (versions.newest(versions.manifests(spark, base).where(F.col("version") == v)).folders for v in (1, 2))
    assert sum(one[b] != two[b] for b in one) == 1


def test_empty_tables_and_unknown_versions(spark, base, tmp_path):
    with pytest.raises(ValueError):
        versions.live(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        versions.live(spark, base, 9)
    versions.publish(spark, str(tmp_path / "empty"), spark.createDataFrame([], DOCS))
    assert rows(versions.live(spark, str(tmp_path / "empty"))) == []


def test_access_by_scope(spark):
    users = spark.createDataFrame([(1, "ADMIN", None), (2, "MANAGER", 7), (3, None, 7), (4, "EMPLOYEE", None)], "user_id long, role string, department_id int")
    docs = spark.createDataFrame([(10, 3, 7, "DEPARTMENT"), (11, 3, 7, None), (12, 4, None, "DEPARTMENT"), (13, None, 8, "DEPARTMENT")], "doc_id long, owner_id long, department_id int, sharing_scope string")
    every = {(1, d): 0 for d in (10, 11, 12, 13)} | {(2, 10): 2, (3, 10): 1, (3, 11): 1, (4, 12): 1}
    assert {(r.user_id, r.doc_id): r.branch for r in O.accessible_documents(users, docs).collect()} == every
    asked = spark.createDataFrame([(u, d) for u in (1, 2, 3, 4, 9) for d in (10, 11, 12, 13, 99)] * 2, "user_id long, doc_id long")
    got = {(r.user_id, r.doc_id): tuple(r)[2:] for r in O.check_permissions(asked, users, docs).collect()}
    assert len(got) == 25 and {k for k, v in got.items() if v[0]} == set(every)
    assert got[2, 10] == (True, False, True) and got[3, 10] == (True, True, True) and got[1, 13] == (True, True, True) and got[9, 10] == got[1, 99] == (False,) * 3


C = "q long, c long, rank int"


def test_rerank_keeps_the_order_where_it_must(spark):
    found = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 1), (2, 2, 2), (3, 1, 1), (3, 2, 2), (3, 3, 3)], C)
    scores = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9), (1, 3, 0.9), (2, 1, 0.1), (2, 2, 0.9), (3, 1, 0.1), (3, 2, None), (3, 3, 0.9)], "q long, c long, reranker_score double")
    order = lambda df: {q: [r.c for r in sorted(df.collect(), key=lambda r: r["rank"]) if r.q == q] for q in (1, 2, 3)}
    # ties in the given order; no more candidates than asked for; a candidate without score
    assert order(R.rerank(found, scores, ["q"], ["c"], 2)) == {1: [2, 3], 2: [1, 2], 3: [1, 2]}
    assert order(R.rerank(found, None, ["q"], ["c"], 0)) == {1: [1], 2: [1], 3: [1]}


def test_models_read_3000_characters_and_may_fail(spark):
    q = spark.createDataFrame([(1, "x")], "q long, question string")
    chunks = spark.createDataFrame([(1, "a" * 5000), (2, None)], "c long, text string")
    found = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], C)
    score = lambda loader: {r.c: r.reranker_score for r in models.reranker_scores(q, found, chunks, loader, ["q"], ["c"]).collect()}
    assert score(lambda: lambda a, b: [float(len(x)) for x in b]) == {1: 3000.0, 2: 0.0}
    assert score(lambda: None) == score(lambda: 1 / 0) == score(lambda: lambda a, b: 1 / 0) == {1: None, 2: None}


def test_embedder_falls_back_row_by_row(spark):
    q = spark.createDataFrame([(1, "some words"), (2, "fail here"), (3, "!"), (4, None)], "id long, text string")
    loader = lambda: lambda texts: [None if "fail" in x else [0.0, 0.0] if x == "!" else [3.0, 4.0] for x in texts]
    got = {r.id: (r.by_model, r.vec) for r in models.embedder(loader)(q, ["id"]).collect()}
    hashed = {r.id: r.vec for r in R.hash_vectors(q, ["id"]).collect()}
    assert got[1] == (True, [0.6, 0.8]) and got[2] == (False, hashed[2]) and set(got) == {1, 2}


def test_spans(spark):
    q = spark.createDataFrame([(1, "?"), (2, "?")], "question_id long, question string")
    s = spark.createDataFrame([(1, 0, "low"), (1, 1, "best"), (1, 2, "equal"), (2, 0, "low")], "question_id long, source_index int, text string")
    loader = lambda: lambda a, b: [(x, {"low": 0.01, "best": 0.5, "equal": 0.5}[x]) for x in b]
    assert answering.best_span(models.spans(q, s, loader)).collect() == [(1, "Belgeye göre: best")]
    assert models.spans(q, s, lambda: None).count() == 0
    built = {r.question_id: r.provider for r in answering.build_answers(q.withColumn("mode", F.lit("factual")), s, spans=models.spans(q, s, loader)).collect()}
    assert built == {1: "span", 2: "extractive-fallback"}


def test_pairs_of_users_and_documents_are_not_shuffled(spark):
    """The last exchange stands before the join: pairs are made from blocks of documents, each once, for its first branch."""
    users = spark.range(40).selectExpr("id AS user_id", "CASE WHEN id = 0 THEN 'ADMIN' WHEN id % 3 = 0 THEN 'MANAGER' WHEN id % 3 = 1 THEN 'EMPLOYEE' END AS role", "CASE WHEN id % 5 > 0 THEN CAST(id % 3 AS int) END AS department_id")
    docs = spark.range(1500).selectExpr("id AS doc_id", "CASE WHEN id % 7 > 0 THEN id % 45 END AS owner_id", "CASE WHEN id % 11 > 0 THEN CAST(id % 3 AS int) END AS department_id", "CASE WHEN id % 2 = 0 THEN 'DEPARTMENT' END AS sharing_scope")
    u, x = users.collect(), docs.collect()
    want = {}
    for a in u:
        for b in x:
            branch = 0 if a.role == "ADMIN" else 1 if b.owner_id == a.user_id else 2 if b.sharing_scope and a.department_id is not None and a.department_id == b.department_id else None
            if branch is not None:
                want[a.user_id, b.doc_id] = (branch, a.role)
    for name in ("accessible_documents", "document_permissions"):
        df = getattr(O, name)(users, docs)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("SortMergeJoin")], name
        got = df.collect()
        assert len(got) == len(want), name
        for r in got:
            branch, role = want[r.user_id, r.doc_id]
            assert r.branch == branch if name == "accessible_documents" else (r.can_access, r.can_manage, r.can_reindex) == (True, branch <= 1, branch <= 1 or role == "MANAGER")
    none = spark.createDataFrame([(None, "EMPLOYEE", 1), (3, None, None)], "user_id long, role string, department_id int")
    odd = spark.createDataFrame([(None, None, 1, "DEPARTMENT"), (5, 3, 1, "DEPARTMENT")], "doc_id long, owner_id long, department_id int, sharing_scope string")
    assert sorted(map(tuple, O.accessible_documents(none, odd).collect()), key=str) == [(3, 5, 1), (None, 5, 2), (None, None, 2)]
