"""Every stage of the pipeline, and its run, on small tables: clashing names, null and repeated ids, empty tables, resuming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from plumbline.llm import shards
from plumbline.llm.common import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, good boolean, target double, copies int, epoch int, position double, row string, key long, t string, h long"
ITEM = "the grey heron stood beside the frozen canal while seven children counted every wooden boat that passed under the bridge"


def sentence(rng, n=9):
    return "The " + " ".join(f"word{x}" for x in rng.integers(0, 400, n)) + " ends here."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(21)
    text = lambda n=8: " ".join(sentence(rng) for _ in range(n))
    rows = [(i, text(), "abc"[i % 3]) for i in range(60)]
    copy = text(20)
    rows += [(100, copy, "a"), (101, copy + " One more.", "b"), (102, copy, "a"), (100, copy, "a"), (None, copy, None)]
    rows += [(200, f"{text(3)} And {ITEM}. {text(3)}", "a"), (None, f"{text(3)} And {ITEM}. {text(2)}", "b"), (None, text(), "c"), (5, text(), "c")]
    rows += [(300 + i, " | ".join(["###", "$$"] * 30), "a") for i in range(12)] + [(400, None, "a"), (401, "", "b"), (402, text(4_000), "c")]
    path = shared_dir(spark, "corpus")
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.5, True, 1.0, 2, 3, 0.1, "r", 4, "t", 5) for i, t, s in rows], SCHEMA)
    docs.repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def ids(df):
    return sorted((str(r.doc_id), r.text or "") for r in df.collect())


def test_stages(spark, corpus):
    """Each stage on whole rows against what it must keep."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    every = ids(docs)
    good = P.classify(spark, docs, corpus)
    assert good.columns == docs.columns
    assert ids(good) == [x for x in every if x[0] not in ("400", "401") and not x[0].startswith("3") or x[0] in ("3", *map(str, range(30, 40)))]
    once = P.near_duplicates(spark, docs, corpus)
    assert once.columns == docs.columns
    copy = max((t for i, t in every if i == "100"), key=len)
    noise = {x for x in every if x[1].startswith("###")}
    assert ids(once) == sorted([x for x in every if x[0] not in ("100", "101", "102") and x[1] != copy and x not in noise] + [("100", copy), min(noise)])
    clean = P.decontaminated(spark, docs, corpus)
    assert clean.columns == docs.columns and ids(clean) == [x for x in every if ITEM not in x[1]]
    mixed = P.mixed(spark, once, corpus)
    assert mixed.columns == docs.columns
    counts = {}
    for x in ids(mixed):
        counts[x] = counts.get(x, 0) + 1
    assert set(counts) <= set(ids(once)) and max(counts.values()) <= 3 and any(i == "None" for i, _ in counts)
    out = P.tokens(spark, mixed, corpus)
    encode = shards.Tokenizer().load().encode_ordinary
    assert out.count() == sum(n * -(-(len(encode(t)) + 1) // 512) for (_, t), n in counts.items())


def test_empty_tables(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, corpus).count() == 0


def test_order_holds_through_tokens(spark, corpus, monkeypatch):
    monkeypatch.setattr(P, "SHUFFLE_WINDOW", 4)
    path = shared_dir(spark, "mixed")
    P.mixed(spark, spark.read.parquet(f"{corpus}/documents.parquet").where("length(text) < 2000"), corpus).write.parquet(path)
    docs = spark.read.parquet(path)
    want = [r.doc_id for r in docs.select("doc_id", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect()]
    got = [r.doc_id for r in P.tokens(spark, docs, corpus).orderBy("slot").collect()]
    assert len(got) == len(want) and all(sorted(map(str, got[i : i + 4])) == sorted(map(str, want[i : i + 4])) for i in range(0, len(got), 4))


def test_run_and_resume(spark, corpus, monkeypatch):
    folder = shared_dir(spark, "run")
    first = P.run(spark, corpus, folder)
    rows = sorted(first.select(F.col("slot"), "doc_id", "token_hash").collect(), key=lambda r: r.slot)
    kept = {r.doc_id for r in spark.read.parquet(f"{folder}/stage3").collect()}
    assert {r.doc_id for r in rows} <= kept and not {101, 102, 200, 300, 400, 401} & kept and {5, 100, None} <= kept

    def never(*_):
        raise AssertionError("a finished stage ran again")

    monkeypatch.setattr(P, "STAGES", [(name, never) for name, _ in P.STAGES])
    again = P.run(spark, corpus, folder)
    assert sorted(again.select("slot", "doc_id", "token_hash").collect(), key=lambda r: r.slot) == rows
