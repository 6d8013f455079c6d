"""Embedding, question analysis and retrieval of whole tables of questions against tables of chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon, text as T
from ..sources.tables import spread, written

RRF, DIM, CANDIDATES = 60, 384, 20
#: Chunks of a range and questions of a block that a task of lexical search holds, pairs of a term and a question counted at once.
RANGE_ROWS, BLOCK_QUESTIONS, PAIRS_AT_ONCE = 2048, 512, 1 << 22


def hash_embed(rows: DataFrame, key: list[str], text_col: str = "text", dim: int = DIM) -> DataFrame:
    """key, bucket, weight: the sparse unit vector of token counts, a row for each bucket in use.

    A token is a run of two word characters or more of the lower-cased text; its bucket is its MD5's first 32 bits mod dim.
    """
    tokens = F.regexp_extract_all(F.lower(text_col), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    each = rows.select(*key, F.explode(tokens).alias("t"))
    bucket = F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long") % dim
    counts = each.groupBy(*key, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    norm = counts.groupBy(*key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norm, key).select(*key, "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def embed_questions(questions: DataFrame, key: list[str], text_col: str = "text", embedder=hash_embed) -> DataFrame:
    """key and the embedder's columns: every distinct normalised question is embedded once, then joined back.

    embedder takes rows, a key and a text column. Null and empty questions have no vector.
    """
    asked = questions.select(*key, T.normalize_cache_text(F.col(text_col)).alias("question_text")).where("question_text <> ''")
    once = asked.select("question_text", F.col("question_text").alias("text")).distinct()
    return asked.join(embedder(once, ["question_text"], "text"), "question_text").drop("question_text")


def hash_vectors(rows: DataFrame, key: list[str], text_col: str = "text", dim: int = DIM) -> DataFrame:
    """key, vec: `hash_embed` with every bucket in place, made row by row; texts without tokens have no row."""
    tokens = F.regexp_extract_all(F.lower(text_col), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))

    def count(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            n = np.diff(b.column(0).offsets.to_numpy())
            owner, words = np.repeat(np.arange(len(n)), n), b.column(0).flatten().dictionary_encode()
            bucket = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % dim for w in words.dictionary.to_pylist()], np.int64)
            x = np.bincount(owner * dim + bucket[words.indices.to_numpy()], minlength=len(n) * dim).reshape(len(n), dim)
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(list(x), pa.list_(pa.float64()))], names=[*b.schema.names[1:], "vec"])

    each = spread(rows).select(tokens.alias("tokens"), *key).where(F.size("tokens") > 0)
    return each.mapInArrow(count, each.select(*key, F.array(F.lit(0.0)).alias("vec")).schema)


def top_k(scored: DataFrame, key: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= k)


def inverted(rows: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """key and term, a row for each distinct meaningful term."""
    return rows.select(*key, F.explode(T.meaningful_terms(F.col(text_col))).alias("term"))


def stem(term: Column, rules=lexicon.SUFFIX_RULES) -> Column:
    """A term without its inflections: each rule takes one ending off, from the outermost in, if four letters stay."""
    return reduce(lambda t, endings: F.regexp_replace(t, rf"^([a-z]{{4,}}?)(?:{'|'.join(endings)})$", "$1"), rules, term)


def positional_postings(chunks: DataFrame, c_key: list[str], asked: DataFrame) -> DataFrame:
    """c_key, stem, places: where each stem of `asked` stands in each chunk, in words from 0.

    Each distinct word is stemmed once. A stem keeps the first four letters of its word, or all of a shorter one: words that
    begin like no asked stem are not stemmed, and words of no asked stem are not shuffled.
    """
    # marks at the start go first, so that the first part is the first word; what is empty equals no stem
    words = F.split(F.regexp_replace(T.normalize_for_matching(F.col("text")), "^[^a-z0-9]+", ""), "[^a-z0-9]+")
    each, stems = spread(chunks).select(*c_key, F.posexplode(words).alias("place", "term")), asked.select("stem").distinct()
    begins = stems.select(F.left("stem", F.lit(4)).alias("begin")).distinct()
    known = each.select("term", F.left("term", F.lit(4)).alias("begin")).join(begins, "begin", "left_semi").select("term").distinct()
    known = written(known.select("term", stem(F.col("term")).alias("stem"))).join(stems, "stem", "left_semi")
    return each.join(written(known), "term").groupBy(*c_key, "stem").agg(F.array_sort(F.collect_list("place")).alias("places"))


def cover_density(occurrences: Column, need: Column) -> Column:
    """Sum over the minimal covers of 0.1 / (1 + other words inside). occurrences: (place, term 0..need-1), sorted.

    A sweep over the occurrences keeps the last one of each term; the smallest of these begins a cover that ends here. It is
    minimal if it begins later than the one before.
    """
    numbered = F.transform(occurrences, lambda o, i: F.struct(o["place"].alias("place"), o["term"].alias("term"), i.alias("i")))
    none = F.struct(F.transform(F.sequence(F.lit(1), need), lambda _: F.lit(-1)).alias("last"), F.lit(-1).alias("begin"), F.lit(0.0).alias("score"))

    def step(s, o):
        last = F.transform(s["last"], lambda v, t: F.when(t == o["term"], o["i"]).otherwise(v))
        begin = F.array_min(last)
        between = o["place"] - F.get(occurrences, F.greatest(begin, F.lit(0)))["place"] - (o["i"] - begin)
        score = s["score"] + F.when(begin > s["begin"], F.lit(0.1) / (1 + between)).otherwise(0.0)
        return F.struct(last.alias("last"), F.greatest(begin, s["begin"]).alias("begin"), score.alias("score"))

    return F.aggregate(numbered, none, step, lambda s: s["score"])


def fulltext_search(questions: DataFrame, chunks: DataFrame, q_key: list[str], c_key: list[str], k: int) -> DataFrame:
    """q_key, c_key, sparse, sparse_rank: the k chunks that hold every term of a question, by the density of its covers.

    Terms match by their stems. Candidates come from the postings of a question's rarest stem; the others are looked up.
    """
    q = written(questions.select(*q_key, F.array_distinct(F.transform(T.meaningful_terms(F.col("text")), lambda t: stem(t))).alias("stems")).select(*q_key, F.size("stems").alias("need"), F.posexplode("stems").alias("term", "stem")))
    postings = written(positional_postings(chunks, c_key, q))
    spreads = postings.groupBy("stem").agg(F.count(F.lit(1)).alias("n"))
    rarest = q.join(spreads, "stem", "left").groupBy(*q_key).agg(F.min_by("stem", F.struct(F.coalesce("n", F.lit(0)), "stem")).alias("stem"))
    found = rarest.join(postings.select(*c_key, "stem"), "stem").drop("stem")
    met = found.join(q, q_key).join(postings, [*c_key, "stem"]).groupBy(*q_key, *c_key, "need").agg(F.collect_list(F.struct("places", "term")).alias("met")).where(F.size("met") == F.col("need"))
    places = F.array_sort(F.flatten(F.transform("met", lambda m: F.transform(m["places"], lambda p: F.struct(p.alias("place"), m["term"].alias("term"))))))
    met = met.withColumn("occurrences", places)
    scored = met.select(*q_key, *c_key, F.round(cover_density(F.col("occurrences"), F.col("need")), 9).alias("sparse"))
    return top_k(scored, q_key, [F.desc("sparse"), *map(F.asc, c_key)], k, "sparse_rank")


def matching_terms(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(term, other): distinct terms of `asked` with the distinct terms of `held` that equal, contain or are in them.

    Either way is an equi-join on parts of the longer term; a held term is cut into parts of three, four and five letters, so that
    a long one has no more parts than three times its letters. Terms have three letters or more; a pair may come twice.
    """
    q, v = written(asked.select("term").distinct()), written(held.select(F.col("term").alias("other")).distinct())
    # where a held term has the first letters of an asked one (all, up to five), the rest is compared
    begins = q.select("term", F.left("term", F.lit(5)).alias("part"))
    at = v.select("other", F.explode(F.sequence(F.lit(1), F.greatest(F.length("other") - 2, F.lit(1)))).alias("i"))
    at = at.select("other", "i", F.explode(F.array(*(F.when(F.col("i") + n - 1 <= F.length("other"), F.substring(F.col("other"), F.col("i"), F.lit(n))) for n in (3, 4, 5)))).alias("part"))
    inside = at.join(begins, "part").where(F.substring(F.col("other"), F.col("i"), F.length("term")) == F.col("term"))
    parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(3), F.length("term")), lambda n: F.transform(F.sequence(F.lit(1), F.length("term") - n + 1), lambda i: F.substring(F.col("term"), i, n)))))
    around = q.select("term", F.explode(parts).alias("other")).join(v, "other").where("term <> other")
    return inside.select("term", "other").union(around.select("term", "other"))


def numbered_terms(chunks: DataFrame, c_key: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """c, no, terms: each chunk's distinct meaningful terms and its number in the order of c_key. The numbers of a range of
    about `range_rows` chunks share no >> 33, which grows with the ranges."""
    rows = chunks.select(F.struct(*c_key).alias("c"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(c_key)), "text")
    keys = [f"k{i}" for i in range(len(c_key))]
    n = max(2 * chunks.sparkSession.sparkContext.defaultParallelism, -(-chunks.count() // range_rows))
    placed = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("no", F.monotonically_increasing_id())
    return written(placed.select("c", "no", T.meaningful_terms(F.col("text")).alias("terms")))


def packed_hits(batches):
    """Task: rows (range, block, place, ids) as one row for each range and block, of up to PAIRS_AT_ONCE pairs of a place and an id, each once."""
    import numpy as np
    import pyarrow as pa

    held, n = [], 0

    def packed():
        of, pair = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((pair, of))
        of, pair = of[order], pair[order]
        new = np.append(True, (of[1:] != of[:-1]) | (pair[1:] != pair[:-1]))
        of, pair = of[new], pair[new]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.append(first, len(x)).astype(np.int32)), pa.array(x.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(of[first] >> 24), pa.array(of[first] & (2**24 - 1)), lists(pair >> 32), lists(pair & (2**32 - 1))], names=["range", "block", "place", "ids"])

    for b in batches:
        width = np.diff(b.column(3).offsets.to_numpy())
        of = b.column(0).to_numpy() << 24 | b.column(1).to_numpy()
        held.append((np.repeat(of, width), np.repeat(b.column(2).to_numpy().astype(np.int64) << 32, width) | b.column(3).flatten().to_numpy()))
        n += len(held[-1][1])
        if n >= PAIRS_AT_ONCE:
            yield packed()
            held, n = [], 0
    if n:
        yield packed()


def counted_pairs(most: int | None):
    """Task of a range of chunks and a block of questions: a row for each question that a chunk meets, with the number of chunks
    by terms met (from 1), and those chunks: their terms met and place among the chunks of as many, in order of their keys."""

    def run(hits, asked):
        import numpy as np
        import pyarrow as pa

        names, flat = ["q", "range", "total", "levels", "found"], lambda t, c: t.column(c).combine_chunks().flatten()
        keys = flat(asked, "cs")
        if not (hits.num_rows and asked.num_rows):
            kinds = [asked.schema.field("qs").type.value_type, pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.struct([("c", keys.type), ("n", pa.int32()), ("own", pa.int32())]))]
            return pa.table([pa.array([], kind) for kind in kinds], names=names)
        k, of, total, kept_q, kept = (flat(asked, c).to_numpy() for c in ("ks", "qnos", "totals", "kept_q", "kept"))
        terms, questions = int(k.max()) + 1, len(total)
        met = np.unique(flat(hits, "place").to_numpy().astype(np.int64) * terms + flat(hits, "ids").to_numpy())
        local, term = met // terms, met % terms
        order = np.argsort(k, kind="stable")
        of, per_term = of[order], np.bincount(k, minlength=terms)
        start, width = (np.cumsum(per_term) - per_term)[term], per_term[term]
        ends, counts, at = np.cumsum(width), np.zeros(len(keys) * questions, np.int32), 0
        while at < len(met):  # so many pairs of a chunk's term and a question at once
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - width[at] + PAIRS_AT_ONCE, side="right")))
            w = width[at:to]
            inside = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
            cells = np.repeat(local[at:to], w) * questions + of[np.repeat(start[at:to], w) + inside]
            low = int(local[at]) * questions
            part = np.bincount(cells - low)
            counts[low : low + len(part)] += part.astype(np.int32)
            at = to
        counts = counts.reshape(len(keys), questions)
        asked_for = np.zeros(counts.shape if len(kept_q) else (0, 0), bool)
        if len(kept_q):
            asked_for[kept, kept_q] = True
        rows, levels, chunk, n, own = [], [], [], [], []
        for q in np.flatnonzero(counts.any(axis=0)):
            c = np.flatnonzero(counts[:, q])
            c = c[np.argsort(-counts[c, q], kind="stable")]
            x = counts[c, q]
            level = np.bincount(x, minlength=total[q] + 1)
            mine = np.arange(len(c)) - (len(c) - np.cumsum(level))[x] + 1
            if most is not None:
                keep = (np.arange(len(c)) < most) | (asked_for[c, q] if len(kept_q) else False)
                c, x, mine = c[keep], x[keep], mine[keep]
            rows.append(q)
            levels.append(level[1:])
            chunk.append(c)
            n.append(x)
            own.append(mine)
        lists = lambda arrays, values: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), values)
        joined = lambda arrays: pa.array(np.concatenate([np.zeros(0, np.int32), *arrays]).astype(np.int32))
        c = keys.take(pa.array(np.concatenate([np.zeros(0, np.int64), *chunk])))
        found = pa.StructArray.from_arrays([c, joined(n), joined(own)], names=["c", "n", "own"])
        at = pa.array(np.array(rows, np.int64))
        return pa.table([flat(asked, "qs").take(at), pa.array(np.full(len(rows), asked.column("range")[0].as_py())), flat(asked, "totals").take(at), lists(levels, joined(levels)), lists(chunk, found)], names=names)

    return run


def lexical_search(questions: DataFrame, chunks: DataFrame, q_key: list[str], c_key: list[str], most: int | None = None, also: DataFrame | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """q_key, c_key, sparse, sparse_rank: the share of a question's terms that a chunk matches, over an inverted join.

    Terms match as in `term_matches`, so that inflected forms count; vocabularies are matched once. With `most`, only ranks up
    to it are returned, and those of the pairs (q_key, c_key) of `also`; ranks are those among all chunks.

    A range of chunks meets a block of questions in one task, which counts terms met and places the chunks of as many terms.
    Ranks add up what better or earlier chunks the other ranges have, which are few numbers: pairs are not sorted.
    """
    asked = questions.select(F.struct(*q_key).alias("q"), T.meaningful_terms(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    asked = written(asked)
    blocks = -(-asked.count() // BLOCK_QUESTIONS)
    asked = asked.select("q", F.pmod(F.xxhash64("q"), F.lit(max(blocks, 1))).alias("block"), F.size("terms").alias("total"), F.explode("terms").alias("term"))
    place = lambda c: (F.dense_rank().over(Window.partitionBy("block").orderBy(c)) - 1).cast("int")
    asked = written(asked.withColumns({"k": place("term"), "qno": place("q")}))
    held = numbered_terms(chunks, c_key, range_rows)
    each, place_of = held.select("no", F.explode("terms").alias("term")), F.col("no").bitwiseAND((1 << 33) - 1).cast("int")
    match = matching_terms(asked, each).join(asked.select("term", "block", "k").distinct(), "term")
    match = written(match.groupBy(F.col("other").alias("term"), "block").agg(F.collect_list("k").alias("ids")))
    hits = each.join(match, "term").select(F.shiftright("no", 33).alias("range"), "block", place_of.alias("place"), "ids")
    hits = hits.mapInArrow(packed_hits, "range long, block long, place array<int>, ids array<int>")
    packed = asked.groupBy("block").agg(F.collect_list("k").alias("ks"), F.collect_list("qno").alias("qnos"))
    own = asked.select("block", "q", "qno", "total").distinct().groupBy("block").agg(F.array_sort(F.collect_list(F.struct("qno", "q", "total"))).alias("x"))
    packed = packed.join(own.select("block", F.col("x")["q"].alias("qs"), F.col("x")["total"].alias("totals")), "block")
    ranges = held.groupBy(F.shiftright("no", 33).alias("range")).agg(F.array_sort(F.collect_list(F.struct("no", "c"))).alias("x")).select("range", F.col("x")["c"].alias("cs"))
    packed = ranges.crossJoin(packed)
    none = F.array().cast
    if also is None:
        packed = packed.withColumns({"kept_q": none("array<int>"), "kept": none("array<int>")})
    else:
        pairs = also.select(F.struct(*q_key).alias("q"), F.struct(*c_key).alias("c")).distinct()
        kept = pairs.join(asked.select("q", "block", "qno").distinct(), "q").join(held.select("c", "no"), "c")
        kept = kept.groupBy(F.shiftright("no", 33).alias("range"), "block").agg(F.collect_list("qno").alias("kept_q"), F.collect_list(place_of).alias("kept"))
        packed = packed.join(kept, ["range", "block"], "left").withColumns({"kept_q": F.coalesce("kept_q", none("array<int>")), "kept": F.coalesce("kept", none("array<int>"))})
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    out = f"q {kind(asked, 'q')}, range long, total int, levels array<int>, found array<struct<c:{kind(held, 'c')},n:int,own:int>>"
    met = hits.groupBy("range", "block").cogroup(packed.groupBy("range", "block")).applyInArrow(counted_pairs(most), out)
    met = written(met)
    level = met.select("q", "range", F.posexplode("levels").alias("n", "here")).where("here > 0")
    before = F.sum("here").over(Window.partitionBy("q").orderBy(F.desc("n"), "range")) - F.col("here")
    before = level.select("q", "range", F.struct((F.col("n") + 1).alias("n"), before.alias("before")).alias("b")).groupBy("q", "range").agg(F.map_from_entries(F.collect_list("b")).alias("before"))
    rows = met.select("q", "range", "total", "found").join(before, ["q", "range"]).select("q", "total", "before", F.explode("found").alias("f"))
    rows = rows.select("q.*", "f.c.*", (F.col("f.n") / F.col("total")).alias("sparse"), (F.col("f.own") + F.col("before")[F.col("f.n")]).alias("sparse_rank"))
    if most is None:
        return rows
    rows = written(rows)
    best = rows.where(F.col("sparse_rank") <= most)
    if also is None:
        return best
    key = [*q_key, *c_key]
    return best.unionByName(rows.where(F.col("sparse_rank") > most).join(also.select(*key).distinct(), key, "left_semi"))


def ranked(rows: DataFrame, key: list[str], order: list[Column], rank: str) -> DataFrame:
    """rows with their rank in each key, without a key's rows meeting in one task: sorted ranges are numbered one by one, and
    the numbers of a key's rows in the ranges before are added."""
    spread = rows.repartitionByRange(*key, *order).withColumn("range", F.spark_partition_id())
    spread = written(spread)
    n = spread.groupBy(*key, "range").agg(F.count(F.lit(1)).alias("n"))
    before = n.withColumn("before", F.sum("n").over(Window.partitionBy(*key).orderBy("range")) - F.col("n"))
    before = before.select(F.struct(*key, "range").alias("of"), "before")
    own = F.row_number().over(Window.partitionBy("range", *key).orderBy(*order))
    out = spread.withColumn(rank, own).withColumn("own", F.struct(*key, "range"))
    # structs are equal where their nulls are too
    return out.join(before, F.col("own").eqNullSafe(F.col("of"))).withColumn(rank, F.col(rank) + F.col("before")).drop("range", "before", "own", "of")


def lexical_score(question_terms: Column, chunk_terms: Column) -> Column:
    """Share of the question's terms with a suffix-tolerant match, for chunks already joined by document."""
    return F.size(F.filter(question_terms, lambda t: T.term_matches(t, chunk_terms))) / F.greatest(F.size(question_terms), F.lit(1))


def rrf_merge(dense: DataFrame, sparse: DataFrame, key: list[str]) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists; the absent side adds nothing."""
    both = dense.join(sparse, key, "full")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(RRF) + F.col(c)), F.lit(0.0))
    return both.withColumn("hybrid", part("dense_rank") + part("sparse_rank")).withColumn("score", F.greatest(F.coalesce("dense", F.lit(0.0)), F.least(F.coalesce("sparse", F.lit(0.0)), F.lit(1.0))))


def hybrid_search(dense: DataFrame, sparse: DataFrame, q_key: list[str], c_key: list[str], k: int) -> DataFrame:
    """The k best of the fused lists. dense: a ranked list of max(5k, CANDIDATES) chunks a question; sparse: all ranked.

    A chunk outside the dense list can only come among the k best with one of the first ranks of the sparse one.
    """
    key, cap = [*q_key, *c_key], max(5 * k, CANDIDATES)
    dense = dense.where(F.col("dense_rank") <= cap)
    near = sparse.where(F.col("sparse_rank") <= k + cap).unionByName(sparse.where(F.col("sparse_rank") > k + cap).join(dense.select(*key), key, "left_semi"))
    return top_k(rrf_merge(dense, near, key), q_key, [F.desc("hybrid"), F.desc("score"), *map(F.asc, c_key)], k)


def candidate_count(k: int, reranker: bool, least: int = CANDIDATES) -> int:
    return max(k, min(50, max(4, least))) if reranker else k


def rerank(candidates: DataFrame, scores: DataFrame | None, q_key: list[str], c_key: list[str], k: int) -> DataFrame:
    """The first max(k, 1) candidates of each question by a table of model scores (q_key, c_key, reranker_score).

    The given order (`rank`) settles ties. It stays whole without scores, for a question that has no more than k candidates,
    and for one with a candidate that has no score, as the model failed there.
    """
    k = max(k, 1)
    if scores is None:
        return candidates.where(F.col("rank") <= k)
    each = Window.partitionBy(*q_key)
    joined = candidates.join(scores.select(*q_key, *c_key, "reranker_score"), [*q_key, *c_key], "left")
    fine = (F.count(F.lit(1)).over(each) > k) & (F.count("reranker_score").over(each) == F.count(F.lit(1)).over(each))
    joined = joined.withColumn("reranked", fine).withColumnRenamed("rank", "given")
    order = [F.desc(F.when(F.col("reranked"), F.col("reranker_score"))), F.asc("given")]
    return top_k(joined, q_key, order, k).drop("given")


def scan_chunks(chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """All chunks (of the given documents), score 1, in document order within each partition."""
    rows = chunks if documents is None else chunks.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    return rows.withColumn("score", F.lit(1.0)).repartition("doc_id").sortWithinPartitions("doc_id", "chunk_index")


def join_profile(questions: DataFrame, profiles: DataFrame) -> DataFrame:
    """questions with title, summary and index_version of their document; index_missing where it has no profile."""
    p = profiles.select("doc_id", "title", "summary", index_version(F.col("updated_at")).alias("index_version"), F.lit(False).alias("index_missing"))
    out = questions.join(p, "doc_id", "left")
    return out.withColumns({"index_missing": F.coalesce("index_missing", F.lit(True)), "index_version": F.coalesce("index_version", F.lit("missing"))})


def index_version(updated_at: Column) -> Column:
    return F.coalesce(F.date_format(updated_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("missing"))


def by_question(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows with a value of their `question`, worked out once for each distinct question."""
    values = written(rows.select("question").distinct().withColumn(name, value)).withColumnRenamed("question", "of")
    # null questions have a value, too
    return rows.join(values, F.col("question").eqNullSafe(F.col("of")), "left").drop("of")


def select_sources(questions: DataFrame, chunks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """question_id, doc_id, chunk_index, strategy, rank: ordered chunks for questions about order, the first k for summaries,
    and for the rest the k best of `found` (question_id, doc_id, chunk_index, rank).

    questions: question_id, doc_id, question; chunks: doc_id, chunk_index.
    """
    x = F.col("question")
    strategy = F.coalesce(order_direction(x), F.when(classify_response_mode(x) == "summary", "summary"), F.lit("hybrid"))
    asked = written(by_question(questions.select("question_id", "doc_id", "question"), strategy, "strategy").drop("question"))
    most = max(k, 1)

    def by(strategies, pick):
        """The picked chunks of the documents that these strategies are for."""
        rows = asked.where(F.col("strategy").isin(*strategies))
        c = chunks.select("doc_id", "chunk_index").join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
        return rows.join(pick(c), "doc_id").select("question_id", "doc_id", "chunk_index", "strategy", "rank")

    first = by(("first", "summary"), lambda c: top_k(c, ["doc_id"], [F.asc("chunk_index")], most))
    last = by(("last",), lambda c: top_k(top_k(c, ["doc_id"], [F.desc("chunk_index")], most).drop("rank"), ["doc_id"], [F.asc("chunk_index")], most))
    hybrid = asked.where("strategy = 'hybrid'").select("question_id", "strategy").join(found.where(F.col("rank") <= k), "question_id").select("question_id", "doc_id", "chunk_index", "strategy", "rank")
    return first.unionByName(last).unionByName(hybrid)


def initial_chunks(chunks: DataFrame, k: int, key: str = "doc_id", order: str = "chunk_index") -> DataFrame:
    return top_k(chunks, [key], [F.asc(order)], k)


def ordered_sources(chunks: DataFrame, direction: str, k: int, key: str = "doc_id", order: str = "chunk_index") -> DataFrame:
    """The first or last k chunks of each document."""
    return top_k(chunks, [key], [F.asc(order) if direction == "first" else F.desc(order)], max(k, 1)).drop("rank")


def order_direction(question: Column) -> Column:
    n = T.normalize_for_matching(question)
    # fixed values: words that ask for the last or the first part
    return F.when(n.rlike(T.ascii_borders(r"\b(?:en\s+son|son|sonuncu|en\s+yeni|guncel|latest)\b")), "last").when(n.rlike(T.ascii_borders(r"\b(?:ilk|birinci|baslangic|en\s+eski|oldest)\b")), "first")


def classify_response_mode(question: Column) -> Column:
    n = T.normalize_for_matching(question)
    return F.when(T.any_of(n, lexicon.CRITIQUE_MARKERS), "critique").when(T.any_of(n, lexicon.SUMMARY_MARKERS), "summary").otherwise("factual")


def correct_typos(question: Column, typos=lexicon.TYPOS) -> Column:
    return reduce(lambda q, t: F.regexp_replace(q, T.ascii_borders(rf"\b{t[0]}\b"), t[1]), typos, T.normalize_for_matching(question))


def expand_aliases(question: Column, groups=lexicon.ALIAS_GROUPS) -> Column:
    """The corrected question with the aliases of every group that it triggers, first seen once."""
    q = correct_typos(question)
    words = lambda found, aliases: F.when(found, F.array(*map(F.lit, aliases))).otherwise(F.array().cast("array<string>"))
    parts = [words(reduce(lambda a, b: a | b, [T.question_marker(q, m) for m in triggers]), aliases) for triggers, aliases in groups]
    parts.append(words(classify_response_mode(q) == "summary", lexicon.SUMMARY_ALIASES))
    return T.normalize_whitespace(F.concat_ws(" ", q, F.array_join(F.array_distinct(F.concat(*parts)), " ")))


def is_latest_course_question(question: Column) -> Column:
    n = T.normalize_for_matching(question)
    return F.contains(n, F.lit("ders")) & T.any_of(n, lexicon.LATEST_COURSE_MARKERS)


def latest_course(chunks: DataFrame) -> DataFrame:
    """(doc_id, term, code, name): the last course row of each document's latest term, terms carried forward over lines."""
    lines = F.filter(F.transform(F.split("text", r"\R"), T.normalize_whitespace), lambda x: x != "")
    rows = chunks.select("doc_id", "chunk_index", F.posexplode(lines).alias("line_no", "line"))
    # fixed values: the shapes of a term and of a course row in a transcript
    found = r"(\d{4}-\d{4})\s*((?i:Güz|Bahar|Yaz))"
    year, season = F.regexp_extract("line", found, 1), F.regexp_extract("line", found, 2)
    rows = rows.withColumn("t", F.when(year != "", F.struct(T.term_sort_key(year, season).alias("key"), F.concat_ws(" ", year, season).alias("label"))))
    order = Window.partitionBy("doc_id").orderBy("chunk_index", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("t", F.last("t", ignorenulls=True).over(order))
    course = rf"\b([{T.UPPER}]{{2,}}\d{{3}}-\d{{4}})\s+(.+?)\s+(\d+)\s+(A1|A2|A3|B1|B2|B3|C1|C2|C3|D1|D2|D3|F1|F2|F3|FF|DZ|YT|YZ)\s+[\d,]+\s+\d+\b"
    rows = rows.where(F.col("t").isNotNull()).withColumn("code", F.regexp_extract("line", course, 1)).withColumn("name", F.regexp_extract("line", course, 2)).where("code <> ''")
    best = rows.groupBy("doc_id").agg(F.max_by(F.struct("t", "code", "name", "chunk_index"), F.struct(F.col("t.key"), "chunk_index", "line_no")).alias("x"))
    return best.select("doc_id", F.col("x.t.label").alias("term"), "x.code", "x.name", "x.chunk_index")


def relevant_passage(question_terms: Column, text: Column) -> Column:
    """The two sentences with most of the question's terms, in text order, 550 characters at most; else the first one."""
    flat = F.regexp_replace(text, r"(?<!\n)\n(?!\n)", " ")
    parts = F.filter(F.transform(F.split(flat, r"(?<=[.!?])\s+|\n{2,}"), T.normalize_whitespace), lambda s: s != "")
    scored = F.transform(parts, lambda s, i: F.struct((-F.size(F.array_intersect(T.meaningful_terms(s), question_terms))).alias("o"), i.alias("i"), s.alias("s")))
    best = F.slice(F.array_sort(F.filter(scored, lambda x: x["o"] < 0)), 1, 2)
    text_order = F.array_sort(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
    found = F.array_join(F.transform(text_order, lambda x: x["s"]), " ")
    return F.when(F.size(best) > 0, T.shorten(found, 550)).otherwise(T.shorten(F.coalesce(F.get(parts, F.lit(0)), F.lit("")), 450))
