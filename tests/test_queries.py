import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["question_alignment", "grounded_answers", "checked_critiques", "repaired_sources", "latest_course", "application_requirements", "order_answers", "publish_documents", "check_permissions", "rerank", "model_embed", "best_span", "notice_facts", "split_claims", "validate_notices", "scan_chunks", "join_profile", "get_profile", "select_sources", "list_departments", "document_listing", "ready_documents", "submit_jobs", "submitted_status", "share_document", "rejected_shares", "assign_access", "chat_history", "invalidate_cache", "delete_cascade", "guard_answer", "file_names", "trace_rows", "trim_to_sentence", "heading_sections", "semantic_blocks", "chunk_documents", "without_chunks", "build_profile", "extract_claim_facts", "fulltext_search", "expand_questions", "hybrid_passages", "guard_reasons", "evidence_support", "match_claims", "validate_answers", "build_answers", "build_prompts", "score_cases", "retrieval_metrics", "quality_gates", "meaningful_terms", "shorten", "extract_percentages", "page_lines", "hash_embed", "lexical_search", "hybrid_search", "question_modes", "quality_summary", "accessible_documents", "document_permissions", "route_failures", "document_status"]


def key(row):
    return tuple(round(x, 5) if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = entry.queries()[name](spark, D)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(key, df.select(*cols).collect()), key=str) == sorted(map(key, want), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_durations_are_added_in_the_order_of_events(spark, tmp_path):
    """However rows fall into tasks, means are those of the SQL on one thread, which adds them row by row, with its rounding."""
    import random

    rng = random.Random(11)
    rows = [(0, 1, 1e16), (1, 1, 1.0), (2, 1, -1e16), (3, 1, 1.0), (4, 2, 0.44999999999999996), (5, 3, 1.8499999999999999), (6, 4, None)]
    rows += [(7 + i, 5 + i % 400, rng.randrange(10_000) / 100) for i in range(20_000)]
    kind = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    df = spark.createDataFrame([(i, None, u, rng.choice(["view", "click", "error"]), v, "{}") for i, u, v in rows], kind).cache()
    df.coalesce(1).sortWithinPartitions("event_id").write.parquet(str(tmp_path / "sorted"))
    df.repartition(7, (df.event_id * 7919) % 101).sortWithinPartitions(df.event_id.desc()).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"create view events as select * from '{tmp_path}/sorted/*.parquet'")
    got = entry.queries()["quality_by_user"](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({entry.oracle_sql()['quality_by_user']}) order by 1").fetchall()
    assert sorted(map(tuple, got.collect())) == want
    assert {r[0]: r[-1] for r in want[:4]} == {1: 0.3, 2: 0.5, 3: 1.9, 4: 0.0}
