"""Phrases, languages and hard negatives against brute force, edge rows included."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language, negatives, phrases
from plumbline.llm.common import table

# --- hard negatives --------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, label int, embedding array<float>, row string, anchor long, score double, d int, windows string"


def vector_rows():
    rng = random.Random(13)
    rows = [(i, rng.randrange(4), [rng.randrange(-3, 9) / 4 for _ in range(4)]) for i in range(240)]
    rows += [(0, 1, [0.5, 0.5, 0.5, 0.5]), (50, 2, [0.0, 0.0, 0.0, 0.0]), (50, 2, [1.0, 1.0, 1.0, 1.0]), (7, None, [1.0] * 4), (8, 1, None), (9, 1, [1.0, None, 1.0, 1.0]), (10, 1, [1.0, math.nan, 1.0, 1.0]), (11, 1, [math.inf] * 4), (None, 1, [1.0] * 4)]
    rows += [(300, 1, []), (301, 1, []), (302, 2, []), (350, 3, [1.0, 2.0]), (351, 3, [2.0, 1.0]), (352, 1, [1.0, 1.0])]
    return rows + rows[:60:7] + [(400, 1, [1e9] * 4), (401, 1, [2e9, 1e9, 0.0, 1.0]), (402, 2, [1e9, 0.0, 0.0, 0.0])]


def best_negatives(rows):
    take = [(i, y, [math.floor(256 * x) for x in np.array(v, np.float32).astype(float)]) for i, y, v in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, y, v) in enumerate(take):
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z == y) for n, (j, z, w) in enumerate(take) if n != k and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2]][:5]:
            found = [(t, m) for t, m, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, j, r, m, -s, -t) for r, (t, m) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [16_384, 17])
def test_negatives_by_brute_force(spark, block_rows):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "x", 1, 0.5, 3, "w") for r in rows], VECTORS)
    got = negatives.mine(df, F.col("id") % 50 == 0, block_rows=block_rows).collect()
    assert sorted(map(tuple, got)) == best_negatives(rows)


def test_products_are_exact_at_any_size():
    a, b = np.array([[3_000_000_019, -7]]), np.array([[2_999_999_999, 11], [1, 1]])
    assert [list(x) for x in negatives.products(a, b)] == [[3_000_000_019 * 2_999_999_999 - 77, 3_000_000_012]]
    huge = np.array([[2**61, 2**61]])
    assert [list(x) for x in negatives.products(huge, huge)] == [[2**63 - 1]]


def test_no_vectors(spark):
    assert negatives.mine(spark.createDataFrame([], VECTORS), F.col("id") % 50 == 0).collect() == []


# --- phrases ---------------------------------------------------------------------------------------------------------

TEXTS = "doc_id long, lang string, text string, word string, n long, a string, h string"


def best_phrases(rows, least, most):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * m >= 50 * a and m >= least for q, m in c.items()):
                continue
            s, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, total[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def phrase_rows():
    rng = random.Random(11)
    words = ["a", "b", "É", "the", "The", "of", "x" * 3000, "%", "ß z", "\U0001f600"]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([3, 10])]) + rng.choice(["", "", "", ".", "\t", "\x0b", "!"]) for _ in range(n))
    rows = [(rng.choice(["en", "fr", None, "und", ""]), text(rng.randrange(0, 60))) for _ in range(150)]
    return rows + [("en", None), (None, ""), ("de", " .,\n"), ("en", "one"), ("en", "New York City " * 4000), ("en", "The Of the"), ("en", "The Of the")]


@pytest.mark.parametrize("run", [1 << 20, 50])
def test_phrases_by_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(phrases, "RUN", run)
    rows = phrase_rows()
    df = spark.createDataFrame([(i, lang, text, "w", 3, "a", "h") for i, (lang, text) in enumerate(rows)], TEXTS).repartition(5)
    got = phrases.mine(df, least=10, most=25).collect()
    assert sorted(map(tuple, got)) == best_phrases(rows, 10, 25)


def test_prefix_counts_are_those_of_a_counter():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 6, (3, 4000)).astype(np.uint64)
    weight = rng.integers(1, 5, 4000)
    want = [Counter(), Counter(), Counter()]
    for column, w in zip(keys.T.tolist(), weight.tolist()):
        for d in range(3):
            want[d][tuple(column[: d + 1])] += w
    for least in (1, 60):
        for d, (at, n) in enumerate(phrases.prefix_counts(keys, weight, least)):
            got = {tuple(keys[: d + 1, i].tolist()): int(c) for i, c in zip(at, n)}
            assert len(got) == len(at) and got == {k: c for k, c in want[d].items() if c >= least}


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """All words of the first seed share one hash: the counts are made again with the next one."""
    class Clumsy(phrases.Words):
        def __init__(self, part, seed):
            super().__init__(part, seed)
            if seed == 0 and len(self.hash):
                self.hash = np.full(len(self.hash), 5, np.uint64)

    monkeypatch.setattr(phrases, "Words", Clumsy)
    rows = [("en", "red house blue house")] * 12
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    assert sorted(map(tuple, phrases.mine(df).collect())) == best_phrases(rows, 10, 2000)


def test_words_of_a_task_are_counted_once():
    """Batches of one task give one row for each word, and words that share a hash are told apart inside a slice."""
    from types import SimpleNamespace

    import pyarrow as pa

    batch = lambda *texts: pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    every = SimpleNamespace(value=np.full(2 ** (phrases.BITS - 3), 255, np.uint8))
    out = pa.Table.from_batches(phrases.words_of(0, every)(iter([batch("red house", "red"), batch("Red blue")]))).to_pylist()
    assert sorted((r["word"] or "", r["n"]) for r in out) == [("", 5), ("blue", 1), ("house", 1), ("red", 3)]
    w = phrases.Words(batch("red house red reds"), 0)
    assert phrases.same_spans(w, np.array([0, 1, 2, 3]), np.array([0, 0, 0, 0])).tolist() == [True, False, True, False]


def test_texts_are_sent_for_the_best_phrases_alone(spark, monkeypatch):
    """Of 30 frequent pairs two are returned: no text of the words of the others is looked for, but of those that equal the last."""
    sent = []
    real = phrases.words_of
    monkeypatch.setattr(phrases, "words_of", lambda seed, bits: (sent.append(int(np.unpackbits(bits.value).sum())), real(seed, bits))[1])
    rows = [("en", f"a{i} b{i}. a{i}") for i in range(27) for _ in range(10)] + [("en", f"c{i} d{i}") for i in range(3) for _ in range(10)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert sorted(map(tuple, phrases.mine(df, most=2).collect())) == best_phrases(rows, 10, 2)
    assert sent == [6]


def test_words_of_tasks_that_share_a_hash_are_seen():
    """Words are counted by hash over tasks; another text with the same hash is told by the second one, as is another language."""
    from types import SimpleNamespace

    import pyarrow as pa

    class Fixed(phrases.Words):
        def __init__(self, part, seed):
            super().__init__(part, seed)
            self.hash = np.full(len(self.hash), 5, np.uint64)

    every = SimpleNamespace(value=np.full(2 ** (phrases.BITS - 3), 255, np.uint8))
    batch = lambda lang, *texts: pa.RecordBatch.from_arrays([pa.array([lang] * len(texts)), pa.array(texts)], names=["lang", "text"])
    with pytest.MonkeyPatch.context() as m:
        m.setattr(phrases, "Words", Fixed)
        task = lambda *batches: list(phrases.word_counts(0, every, 1)(iter(batches)))
        summed = lambda *parts: [tuple(r.values())[1:] for b in phrases.words_added(iter(sum(parts, []))) for r in b.to_pylist()]
        assert summed(task(batch("en", "red red"), batch("en", "red")), task(batch("en", "red"))) == [("en", 4, False)]
        assert [x[2] for x in summed(task(batch("en", "red")), task(batch("en", "blue")))] == [True]
        assert [x[2] for x in summed(task(batch("en", "red")), task(batch("tr", "red")))] == [True]
        assert [x[2] for x in summed(task(batch("en", "red blue")))] == [True]


def test_no_texts(spark):
    assert phrases.mine(spark.createDataFrame([], TEXTS)).collect() == []


# --- languages -------------------------------------------------------------------------------------------------------


def test_language_of_held_out_texts(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").where("doc_id < 3000")
    out = language.predict(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).join(docs, "doc_id").collect()
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert len(held) > 500 and np.mean([r.lang_pred == r.lang for r in held]) > 0.99


def lang_rows():
    words = {"en": "the and with that this of house were", "de": "und der mit das dieses von haus waren", "fr": "et le avec que cette maison étaient du", "xx": "zq qz zzq qqz zqz qzq"}
    rng = random.Random(12)
    return [(i, lang, " ".join(rng.choice(w.split()) for _ in range(rng.randrange(3, 40)))) for i, (lang, w) in enumerate(list(words.items()) * 40)]


def test_language_edge_rows(spark):
    rows = lang_rows()
    edge = [(None, None, "the house and that"), (1, "en", None), (2, "en", ""), (3, "de", "123 --- 5"), (4, "fr", "THE HOUSE WITH THAT"), (4, "fr", "THE HOUSE WITH THAT"), (5, None, "der mit dem haus und " * 80_000), (6, "en", "x" * 2_500_000)]
    schema = "doc_id long, lang string, text string, row string, score double, t string, h long, letters boolean"
    df = spark.createDataFrame([(*r, "r", 0.1, "t", 2, True) for r in rows + edge], schema)
    model = language.fit(spark.createDataFrame([(*r, "r", 0.1, "t", 2, True) for r in rows], schema))
    assert model.langs == ["de", "en", "fr", "xx"] and ("de", "en") in model.machines and "romance" in model.machines
    got = model.rows(df).select("row.doc_id", "row.text", "row.lang", "row.score", "lang_pred", F.col("score").alias("sure")).collect()
    assert len(got) == len(rows) + len(edge)
    pred = {(r.doc_id, (r.text or "")[:9]): (r.lang_pred, r.sure) for r in got[len(rows):]}
    assert pred[None, "the house"][0] == "en" and pred[4, "THE HOUSE"][0] == "en" and pred[5, "der mit d"][0] == "de"
    assert all(pred[k] == ("und", 0.0) for k in ((1, ""), (2, ""), (3, "123 --- 5")))
    assert np.mean([r.lang_pred == r.lang for r in got[: len(rows)]]) > 0.97
    assert all(r.score == 0.1 for r in got)


def test_language_without_or_with_one_language(spark):
    schema = "doc_id long, lang string, text string"
    none = spark.createDataFrame([(1, None, "the house"), (2, "en", None)], schema)
    assert {tuple(r) for r in language.predict(none, F.lit(False)).collect()} == {(1, False, "und", 0.0), (2, False, "und", 0.0)}
    one = spark.createDataFrame([(1, "en", "the house"), (5, "de", "das haus"), (None, "de", "das"), (7, "en", "1")], schema)
    out = {r.doc_id: (r.held_out, r.lang_pred) for r in language.predict(one, F.col("doc_id") == 5).collect()}
    assert out == {1: (False, "en"), 5: (True, "en"), None: (False, "en"), 7: (False, "und")}
    assert language.predict(spark.createDataFrame([], schema), F.lit(False)).collect() == []


def test_a_long_text_counts_whole(monkeypatch):
    import pyarrow as pa

    text = "été der the " * 50 + "zzz"
    part = pa.RecordBatch.from_arrays([pa.array(["the", text, "", "und"])], names=["t"])

    def counts():
        out = np.zeros((4, language.SLOTS), np.int64)
        for data, offsets, owner in language.stretches(part):
            t, s = language.grams(data, offsets)
            np.add.at(out, (owner[t], s), 1)
        return out

    whole = counts()
    monkeypatch.setattr(language, "STRETCH", 40)
    assert whole[1].sum() > 1500 and (counts() == whole).all()
