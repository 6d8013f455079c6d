"""The operators' queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, curriculum, decontaminate, html, jaccard, language, licenses, negatives, phrases, quality, secrets, shards, warc
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.materialise(table(spark, sf_dir, "documents"))
    return out.select("slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens", F.xxhash64("tokens").alias("token_hash"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "first_position")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.permutation_search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents")).select("doc_id", F.round("score", 6).alias("score"), "good")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(e.select("vec_id", label.alias("label"), "embedding"), F.col("id") % 50 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_licenses, op3_warc, op4_shards, op5_main_text, op6_mix, op7_ann, op8_jaccard, op9_quality, op10_secrets, op11_phrases, op12_language, op13_negatives, pipeline)}

#: DuckDB SQL. The base-32 text of a SHA-1 is built from its eight groups of 20 bits.
_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * g + 1}, 5))::INT >> {s}) & 31), 1)" for g in range(8) for s in (15, 10, 5, 0))
ORACLE_SQL = {
    "op3_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages WHERE page_id IS NOT NULL),
q AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_B32} AS payload_digest, min(page_id) OVER (PARTITION BY body) AS holder FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> holder THEN holder END AS refers_to FROM q""",
    "op13_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""",
    "op11_phrases": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, doc, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT lang, doc, string_split_regex(x, '[.,;:!?\x0A-\x0D]') AS l FROM d)),
w AS (SELECT lang, doc, i, unnest(l) AS w, generate_subscripts(l, 1) AS j FROM (SELECT lang, doc, i, regexp_extract_all(p, '[^\x20\x09]+') AS l FROM p)),
s AS (SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc, i ORDER BY j)),
c1 AS (SELECT lang, w, count(*) AS n FROM s GROUP BY 1, 2), c2 AS (SELECT lang, w, w2, count(*) AS n FROM s WHERE w2 IS NOT NULL GROUP BY 1, 2, 3),
c3 AS (SELECT lang, w, w2, w3, count(*) AS n FROM s WHERE w3 IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING n >= 10),
t AS (SELECT c3.lang, c3.w || ' ' || c3.w2 || ' ' || c3.w3 AS phrase, c3.n AS a, [x.n, y.n] AS ls, [z.n, u.n] AS rs, [(1000000::HUGEINT * c3.n * c3.n) // (x.n::HUGEINT * z.n), (1000000::HUGEINT * c3.n * c3.n) // (y.n::HUGEINT * u.n)] AS q
  FROM c3 JOIN c1 x ON x.lang = c3.lang AND x.w = c3.w JOIN c2 y ON y.lang = c3.lang AND y.w = c3.w AND y.w2 = c3.w2 JOIN c2 z ON z.lang = c3.lang AND z.w = c3.w2 AND z.w2 = c3.w3 JOIN c1 u ON u.lang = c3.lang AND u.w = c3.w3),
m AS (SELECT lang, w, w2, max(n) AS longer FROM (SELECT lang, w, w2, n FROM c3 UNION ALL SELECT lang, w2, w3, n FROM c3) GROUP BY 1, 2, 3),
b AS (SELECT c2.lang, c2.w || ' ' || c2.w2 AS phrase, c2.n AS a, x.n AS l, y.n AS r, (1000000::HUGEINT * c2.n * c2.n) // (x.n::HUGEINT * y.n) AS score FROM c2 JOIN c1 x ON x.lang = c2.lang AND x.w = c2.w JOIN c1 y ON y.lang = c2.lang AND y.w = c2.w2
  LEFT JOIN m ON m.lang = c2.lang AND m.w = c2.w AND m.w2 = c2.w2 WHERE c2.n >= 10 AND (longer IS NULL OR 100 * longer < 50 * c2.n)),
g AS (SELECT * FROM b UNION ALL SELECT lang, phrase, a, CASE WHEN q[1] <= q[2] THEN ls[1] ELSE ls[2] END, CASE WHEN q[1] <= q[2] THEN rs[1] ELSE rs[2] END, least(q[1], q[2]) FROM t),
n AS (SELECT lang, count(*) AS n FROM s GROUP BY 1)
SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase))::INT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM g JOIN n USING (lang) QUALIFY rank <= 2000""",
}
