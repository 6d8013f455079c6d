"""Searches against brute force: pruned blocks, split ranks, suffix-tolerant terms, covers of inflected terms."""

import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import dense, retrieval as R


def test_dense_search_finds_what_all_pairs_find(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(600, 8)) * rng.choice([0.2, 1, 5], (600, 1)), 3)
    x[100:140] = x[7]  # copies: ties go to the smaller key
    label = rng.integers(0, 3, 600)
    rows = [(int(i), int(label[i]), "k", x[i].tolist() if i != 50 else None) for i in range(600)]
    c = spark.createDataFrame(rows, "id int, label int, bound string, vec array<double>")
    q = c.where("id % 60 < 2").select(F.col("id").alias("q_id"), "label", "vec")
    for within in ([], ["label"]):
        got = dense.dense_search(q, c, ["q_id"], ["id"], 5, within, block_rows=32).collect()
        want = []
        for i in range(600):
            if i % 60 < 2 and i != 50:
                at = [j for j in range(600) if j != 50 and (not within or label[i] == label[j])]
                best = sorted((-round(float(x[i] @ x[j]), 9), j) for j in at)[:5]
                want += [(i, j, s, r) for r, (s, j) in enumerate(best, 1)]
        assert sorted((r.q_id, r.id, round(-r.dense, 6), r.dense_rank) for r in got) == sorted((i, j, round(s, 6), r) for i, j, s, r in want)
    assert dense.dense_search(q.limit(0), c, ["q_id"], ["id"], 5).collect() == [] == dense.dense_search(q, c.limit(0), ["q_id"], ["id"], 5).collect()


def test_hash_vectors_are_hash_embed(spark):
    rows = spark.createDataFrame([(1, "one two two Üç " * 3), (2, "a b"), (3, None), (4, "")], "id int, text string")
    sparse = {(r.id, r.bucket): r.weight for r in R.hash_embed(rows, ["id"]).collect()}
    whole = {(r.id, b): w for r in R.hash_vectors(rows, ["id"]).collect() for b, w in enumerate(r.vec) if w}
    assert sparse.keys() == whole.keys() and all(abs(sparse[k] - whole[k]) < 1e-12 for k in sparse)


def test_lexical_ranks_of_many_terms(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 7))) for _ in range(120)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    qs = [(i, text(n)) for i, n in enumerate([1, 5, 90, 400])] + [(9, None), (10, "")]
    cs = [(i, text(rng.randrange(0, 9))) for i in range(80)] + [(200, None), (201, "x" * 5000 + words[0])]
    got = R.lexical_search(spark.createDataFrame(qs, "q int, text string"), spark.createDataFrame(cs, "c int, text string"), ["q"], ["c"]).collect()
    terms = lambda t: {w for w in (t or "").split() if len(w) > 2}
    want = []
    for q, t in qs:
        scored = []
        for c, u in cs:
            n = sum(any(a in b or b in a for b in terms(u)) for a in terms(t))
            if n:
                scored.append((-n / len(terms(t)), c))
        want += [(q, c, round(-s, 9), r) for r, (s, c) in enumerate(sorted(scored), 1)]
    assert sorted((r.q, r.c, round(r.sparse, 9), r.sparse_rank) for r in got) == sorted(want)


def test_first_lexical_ranks_and_asked_pairs_alone(spark):
    """Ranks among all chunks, though only the first ones and given pairs come back; ranges and blocks of few rows, null keys."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcd") for _ in range(4)) for _ in range(40)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    q = spark.createDataFrame([(i, text(6)) for i in range(12)] + [(None, text(3))], "q int, text string")
    c = spark.createDataFrame([(i, "k", text(rng.randrange(0, 9))) for i in range(90)] + [(None, "k", text(5))], "c int, k string, text string")
    every = {(r.q, r.c): (r.sparse, r.sparse_rank) for r in R.lexical_search(q, c, ["q"], ["c", "k"]).collect()}
    also = spark.createDataFrame([(1, 80, "k"), (3, 5, "k"), (3, 77, "k"), (4, 1000, "k")], "q int, c int, k string")
    got = {(r.q, r.c): (r.sparse, r.sparse_rank) for r in R.lexical_search(q, c, ["q"], ["c", "k"], 4, also, range_rows=7).collect()}
    assert got == {p: x for p, x in every.items() if x[1] <= 4 or p in {(1, 80), (3, 5), (3, 77), (4, 1000)}}


def test_inflected_questions_find_their_chunk(spark):
    chunks = [(1, "Kütüphaneden alınan kitapların süresi yedi gündür."), (2, "Kitap fuarı"), (3, "kitap kütüphane kitap ve sonra uzun bir ara ile kütüphane"), (4, None)]
    q = spark.createDataFrame([(7, "kitaplar kütüphanede"), (8, ""), (9, None)], "q int, text string")
    got = R.fulltext_search(q, spark.createDataFrame(chunks, "c int, text string"), ["q"], ["c"], 5).collect()
    # 3: covers (0,1), (1,2) and (2,9); 1: (0,2)
    assert [(r.q, r.c, r.sparse_rank) for r in sorted(got, key=lambda r: r.sparse_rank)] == [(7, 3, 1), (7, 1, 2)]
    assert {r.c: r.sparse for r in got} == {3: round(0.2 + 0.1 / 7, 9), 1: 0.05}


def test_postings_hold_asked_stems_alone(spark):
    """Words of other stems are neither stemmed nor shuffled; short words, marks at the start and rows of one key count as before."""
    chunks = spark.createDataFrame([(1, "... kitaplar ev Kitap kitapta"), (1, "kitap"), (2, "evde"), (3, None), (4, "")], "c int, text string")
    asked = spark.createDataFrame([("kitap",), ("ev",), ("kitap",)], "stem string")
    got = {(r.c, r.stem): r.places for r in R.positional_postings(chunks, ["c"], asked).collect()}
    assert got == {(1, "kitap"): [0, 0, 2, 3], (1, "ev"): [1]}


def test_stems(spark):
    words = {"kitaplardan": "kitap", "kitaplari": "kitap", "ogrencilerin": "ogrenci", "evde": "evde", "sinavlarinda": "sinav", "kutuphane": "kutuphane", "kutuphaneye": "kutuphane", "abc1": "abc1"}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", R.stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == words


def test_normal_form_of_every_letter(spark):
    s = "IİıiÇĞÖŞÜçğöşü Straße ÀÉ ǅ"
    old = F.translate(F.lower(F.translate(F.lit(s), "Iİ", "ıi")), "çğıöşü", "cgiosu")
    r = spark.range(1).select(old.alias("a"), T.normalize_for_matching(F.lit(s)).alias("b")).first()
    assert r.a == r.b


def test_percentiles_are_exact_in_every_group(spark):
    from plumbline.operators.evaluation import latency

    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(100, 30, 501), "b": np.array([10.0, 30.0]), None: np.array([7.0, 7.0, 1.0, 2.0]), "c": np.array([])}
    rows = [(g, float(x), "p") for g, xs in groups.items() for x in xs] + [("c", None, "p"), ("a", None, "p")]
    df = spark.createDataFrame(rows, "g string, duration_ms double, place string").repartition(7)
    got = {r.g: tuple(r)[1:] for r in latency(df, "g").collect()}
    want = {g: tuple(round(float(v), 2) for v in (x.mean(), np.quantile(x, 0.5), np.quantile(x, 0.95), x.max())) if len(x) else (0.0,) * 4 for g, x in groups.items()}
    assert got.keys() == want.keys() and all(np.allclose(got[g], want[g], atol=0.011) for g in want)
    every = np.concatenate(list(groups.values()))
    assert np.allclose(tuple(latency(df).first()), (every.mean(), np.quantile(every, 0.5), np.quantile(every, 0.95), every.max()), atol=0.011)
    assert tuple(latency(df.limit(0)).first()) == (0.0,) * 4


def test_a_question_is_judged_once_however_often_it_is_asked(spark):
    from pyspark.sql import types

    calls = spark.sparkContext.accumulator(0)

    def judged(x):
        calls.add(1)
        return None if x is None else len(x)

    q = spark.createDataFrame([(i, "abc" if i % 2 else None if i % 3 else "") for i in range(60)], "id int, question string")
    got = R.by_question(q, F.udf(judged, types.IntegerType())(F.col("question")), "n").collect()
    assert {r.id: r.n for r in got} == {i: 3 if i % 2 else None if i % 3 else 0 for i in range(60)}
    assert calls.value == 3
