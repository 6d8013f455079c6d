"""Every registered query over whole driver tables, and the SQL that it is held against.

Documents are pages (one each), benchmark items questions, conversations chats, events traces, jobs and cache events, and
customers users of departments (nations).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import facts as K, lexicon, text as T
from ..operators import answering, chunking, citations, dense, evaluation, guard, models, operations as O, profile, retrieval as R, verification as V
from ..sources import tables as S, versions
from ..streaming import streams
from . import evaluate

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.lit(1).alias("page_number"), T.squeeze(F.coalesce("text", F.lit(""))).alias("text"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "benchmark").select("item_id", "text")


def turns(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "conversations")


def traces(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    failed = F.col("event_type") == "error"
    return e.select(F.col("event_id").alias("id"), F.col("user_id"), F.when(F.col("event_type") == "click", "ollama-chat").otherwise("extractive").alias("provider"), F.when(failed, "failed").alias("error"), F.col("value").alias("duration_ms"), F.col("ts").alias("created_at"))


def q_list(words) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def norm(c: str) -> str:
    return f"translate(lower(translate({c}, 'Iİ', 'ıi')), 'çğıöşü', 'cgiosu')"


def terms_sql(c: str, drop=()) -> str:
    return f"list_filter(list_distinct(regexp_extract_all({norm(c)}, '[a-z0-9]+')), lambda x: length(x) > 2 AND NOT list_contains({q_list([*lexicon.STOP_WORDS, *drop])}, x))"


def like(c: str, markers) -> str:
    return "(" + " OR ".join(f"contains({c}, '{m}')" for m in markers) + ")"


TR = norm("text")
WS = r"trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g'), ' ')"


# --- scalar functions ------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({TR}) AS normal, md5({WS}) AS spaced, sha256({TR}) AS hash, lower({WS}) = {WS} AS is_lower FROM documents")
def normal_forms(spark, d):
    x = F.col("text")
    n, w = T.normalize_for_matching(x), T.normalize_whitespace(x)
    return t(spark, d, "documents").select("doc_id", F.md5(n).alias("normal"), F.md5(w).alias("spaced"), T.stable_hash(n).alias("hash"), (T.normalize_cache_text(x) == w).alias("is_lower"))


@query(f"SELECT doc_id, len(l)::INT AS n_terms, md5(array_to_string(list_sort(l), ' ')) AS terms FROM (SELECT doc_id, {terms_sql('text')} AS l FROM documents)")
def meaningful_terms(spark, d):
    return t(spark, d, "documents").withColumn("l", T.meaningful_terms(F.col("text"))).select("doc_id", F.size("l").alias("n_terms"), F.md5(F.array_join(F.array_sort("l"), " ")).alias("terms"))


@query(f"SELECT conv_id, turn, len(l)::INT AS n_terms FROM (SELECT conv_id, turn, {terms_sql('text', lexicon.GENERIC_ANSWER_TERMS)} AS l FROM conversations)")
def claim_content_terms(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.size(T.claim_content_terms(F.col("text"))).alias("n_terms"))


_LET, _UP = "A-Za-zÇĞİÖŞÜçğıöşü", "A-ZÇĞİÖŞÜ"


@query(f"SELECT doc_id, regexp_matches(text, '[{_LET}]') AS letters, (len(regexp_extract_all(text, '[{_LET}]')) > 0 AND NOT contains(text, '?') AND len(regexp_extract_all(text, '[{_UP}]')) >= 0.7 * len(regexp_extract_all(text, '[{_LET}]'))) AS heading FROM documents")
def heading_flags(spark, d):
    return t(spark, d, "documents").select("doc_id", T.contains_letters(F.col("text")).alias("letters"), T.looks_like_heading(F.col("text")).alias("heading"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, chr(0), ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS cleaned FROM documents")
def clean_text(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("cleaned"))


@query("""
WITH a AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x FROM documents), b AS (SELECT *, left(x, 1000) AS s FROM a),
c AS (SELECT *, greatest(CASE WHEN contains(s, '. ') THEN length(s) - instr(reverse(s), ' .') - 1 ELSE -1 END, CASE WHEN contains(s, chr(10)) THEN length(s) - instr(reverse(s), chr(10)) ELSE -1 END) AS cut FROM b)
SELECT doc_id, md5(CASE WHEN length(x) <= 1000 THEN x ELSE regexp_replace(CASE WHEN cut > 300 THEN left(s, cut + 1) ELSE s END, '^\\s+|\\s+$', '', 'g') || '...' END) AS short FROM c""")
def shorten(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(T.shorten(F.col("text"), 1000)).alias("short"))


@query("""
WITH a AS (SELECT doc_id, trim(text, ' ') AS x, length(trim(text, ' ')) AS n FROM documents),
c AS (SELECT *, list_max(list_transform(['. ', '? ', '! ', chr(10)], lambda m: CASE WHEN contains(x, m) THEN n - instr(reverse(x), reverse(m)) - length(m) + 1 ELSE -1 END)) AS cut FROM a)
SELECT doc_id, md5(CASE WHEN n >= 300 AND cut > floor(n * 0.55) THEN left(x, cut + 1) ELSE x END) AS trimmed FROM c""")
def trim_to_sentence(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(T.trim_to_sentence(F.col("text"))).alias("trimmed"))


@query(rf"""
WITH n AS (SELECT doc_id, {TR} AS x FROM documents),
p AS (SELECT doc_id, list_transform(regexp_extract_all(x, '(?:%\s*|\byuzde\s+)(\d+(?:[.,]\d+)?)', 1), lambda v: CASE WHEN contains(replace(v, ',', '.'), '.') THEN regexp_replace(replace(v, ',', '.'), '\.?0+$', '') ELSE replace(v, ',', '.') END) AS l FROM n)
SELECT doc_id, array_to_string(list_sort(list_distinct(l)), ',') AS percentages FROM p""")
def extract_percentages(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_join(K.extract_percentages(F.col("text")), ",").alias("percentages"))


def _number(l: str) -> str:
    """SQL: the numbers of list l as canonical strings, one step a list."""
    both = "CASE WHEN contains(v, ',') AND contains(v, '.') THEN CASE WHEN instr(reverse(v), ',') < instr(reverse(v), '.') THEN replace(replace(v, '.', ''), ',', '.') ELSE replace(v, ',', '') END WHEN contains(v, ',') THEN replace(v, ',', '.') WHEN regexp_matches(v, '^[0-9]{0,3}[.][0-9]{3}$') OR length(v) - length(replace(v, '.', '')) > 1 THEN replace(v, '.', '') ELSE v END"
    plain = "CASE WHEN regexp_matches(v, '^([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN regexp_replace(CASE WHEN contains(v, '.') THEN rtrim(rtrim(v, '0'), '.') ELSE v END, '^0+([0-9])', '\\1') ELSE v END"
    return f"list_transform(list_transform({l}, lambda v: {both}), lambda v: {plain})"


def _facts_sql(table: str, keys: str) -> str:
    every = lambda pattern, *k: ", ".join(f"regexp_extract_all(n, '{pattern}', {i}) AS {name}" for i, name in enumerate(k, 1))
    rest = "n"
    for pattern in (rf"{K.DAY_FIRST}|{K.ISO}", K.NAMED, K.PERCENT, rf"{K.MONEY}|{K.LIRA}", K.DURATION):
        rest = f"regexp_replace({rest}, '{pattern.replace(chr(39), chr(39) * 2)}', ' ', 'g')"
    money, lasting = K.MONEY.replace("'", "''"), K.DURATION.replace("'", "''")
    months = q_list(lexicon.MONTHS)
    line = lambda c: f"array_to_string(list_sort(list_distinct({c})), ',')"
    # every letter twice, so that a number sees the letters at both its ends; a digit beside a letter belongs to a shorter number
    seen = f"list_filter(list_transform(regexp_extract_all(regexp_replace({rest}, '([a-z])', '\\1\\1', 'g'), '[a-z]?[0-9]+(?:[.,][0-9]+)*[a-z]?'), lambda x: regexp_replace(regexp_replace(x, '^[a-z][0-9][.,]?', ''), '[.,]?[0-9]?[a-z]$', '')), lambda x: regexp_matches(x, '^[0-9]'))"
    return rf"""WITH a AS (SELECT {keys}, regexp_replace(regexp_replace({TR}, '(^|[^0-9])[.]([0-9])(\s+ve\b)', '\1\2\3', 'g'), '(^|[^0-9])[.]([0-9])s?\s+inif\b', '\1\2 sinif', 'g') AS n FROM {table}),
b AS (SELECT {keys}, n, {every(money, 'm1', 'm2')}, {every(K.LIRA, 'l1')}, {every(lasting, 'u1', 'u2')}, {every(K.DAY_FIRST, 'd1', 'd2', 'd3')}, {every(K.ISO, 'i1', 'i2', 'i3')}, {every(K.NAMED, 'n1', 'n2', 'n3')}, {every(K.PERCENT, 'p1')}, {seen} AS seen FROM a)
SELECT {keys}, {line("list_transform(p1, lambda v: CASE WHEN contains(replace(v, ',', '.'), '.') THEN rtrim(rtrim(replace(v, ',', '.'), '0'), '.') ELSE v END)")} AS percentages,
{line(f"list_concat(list_transform(list_zip({_number('m1')}, m2), lambda x: x[1] || ':' || CASE WHEN x[2] IN ('tl', 'lira') THEN 'try' WHEN x[2] IN ('usd', 'dolar') THEN 'usd' ELSE 'eur' END), list_transform({_number('l1')}, lambda x: x || ':try'))")} AS money,
{line(f"list_transform(list_zip({_number('u1')}, u2), lambda x: x[1] || ':' || x[2])")} AS durations,
{line(f"list_concat(list_concat(list_transform(list_zip(d1, d2, d3), lambda x: CASE WHEN length(x[3]) = 2 THEN '20' ELSE '' END || x[3] || '-' || lpad(x[2], 2, '0') || '-' || lpad(x[1], 2, '0')), list_transform(list_zip(i1, i2, i3), lambda x: x[1] || '-' || x[2] || '-' || x[3])), list_transform(list_zip(n1, n2, n3), lambda x: x[3] || '-' || lpad(list_position({months}, x[2])::VARCHAR, 2, '0') || '-' || lpad(x[1], 2, '0')))")} AS dates,
{line(_number('seen'))} AS numbers FROM b"""


@query(_facts_sql("documents", "doc_id"))
def extract_claim_facts(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.explode(F.array(K.extract_claim_facts(F.col("text")))).alias("f"))
    return x.select("doc_id", *(F.array_join(F.col("f")[k], ",").alias(k) for k in K.KINDS))


@query(rf"SELECT conv_id, turn, ({like(chr(39) + ' ' + chr(39) + ' || ' + TR, lexicon.NEGATIVE_MARKERS)} OR regexp_matches({TR}, '\b[a-z]+(?:maz|mez|miyor|miyorlar)\b')) AS negative, {like(TR, lexicon.NO_ANSWER_MARKERS)} AS no_answer FROM conversations")
def polarity(spark, d):
    x = F.col("text")
    return turns(spark, d).select("conv_id", "turn", T.has_negative_polarity(x).alias("negative"), T.is_no_answer_response(x).alias("no_answer"))


def _relations_sql() -> str:
    test = lambda m: f"contains(x, '{m}')" if " " in m else rf"regexp_matches(x, '\b{m}[a-z]*\b')"
    return " || ".join(f"CASE WHEN {' OR '.join(map(test, ms))} THEN '{name},' ELSE '' END" for name, ms in lexicon.RELATIONS.items())


@query(f"SELECT conv_id, turn, rtrim({_relations_sql()}, ',') AS relations FROM (SELECT conv_id, turn, {TR} AS x FROM conversations)")
def relation_concepts(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.array_join(T.relation_concepts(F.col("text")), ",").alias("relations"))


@query("SELECT doc_id, regexp_replace(source || ' ' || doc_id, '[^a-zA-Z0-9_-]', '_', 'g') AS safe, left(text, 1000) = text AS is_short, sha256(sha256(text)) AS twice FROM documents")
def identifiers(spark, d):
    return t(spark, d, "documents").select("doc_id", T.safe_id(F.concat_ws(" ", "source", "doc_id")).alias("safe"), (T.truncate(F.col("text"), 1000) == F.col("text")).alias("is_short"), T.stable_hash(T.stable_hash(F.col("text"))).alias("twice"))


# --- chunks and profiles ---------------------------------------------------------------------------------------------

_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text,''), chr(0), ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(rf"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex({_CLEAN}, '\r\n|[\n\r\x0b\x0c]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'), ' ')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, len(l)::BIGINT AS n_lines, md5(array_to_string(l, '|')) AS lines FROM l WHERE len(l) > 0""")
def page_lines(spark, d):
    x = chunking.page_lines(pages(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return x.select("doc_id", "n_lines", F.md5(F.array_join(F.transform("l", lambda r: r["line"]), "|")).alias("lines"))


_SPACED = lambda c: rf"trim(regexp_replace({c}, '\s+', ' ', 'g'), ' ')"
_LOUD = lambda c: f"(regexp_matches({c}, '[{_LET}]') AND NOT contains({c}, '?') AND len(regexp_extract_all({c}, '[{_UP}]')) >= 0.7 * len(regexp_extract_all({c}, '[{_LET}]')))"
_LINES = rf"(SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split_regex({_CLEAN}, '\r\n|[\n\r\x0b\x0c]'), lambda x: {_SPACED('x')}), lambda x: x <> '') AS l FROM documents))"


@query(rf"""
WITH h AS (SELECT *, trim({norm('line')}, ' ') AS n FROM {_LINES}),
f AS (SELECT *, CASE WHEN n = '' OR length(line) > 180 OR ends_with(line, '.') THEN false WHEN regexp_matches(n, '^(?:madde|bolum|chapter|section)\s+[0-9ivxlcdm]+(?:\b|[.)-])') OR regexp_matches(n, '^[0-9]+(?:\.[0-9]+){{0,4}}[.)-]?\s+\S+') OR regexp_matches(n, '^[a-z]\)\s+\S+') OR list_contains({q_list(lexicon.SECTION_WORDS)}, n) THEN true
      ELSE length(line) <= 140 AND (ends_with(line, ':') OR {_LOUD('line')}) END AS head FROM h),
s AS (SELECT *, (sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS section FROM f)
SELECT doc_id, section, coalesce(arg_min(line, i) FILTER (head), '') AS heading, md5(string_agg(line, chr(10) ORDER BY i)) AS text FROM s GROUP BY 1, 2""")
def heading_sections(spark, d):
    return chunking.heading_sections(pages(spark, d)).select("doc_id", "section", "heading", F.md5("text").alias("text"))


@query(rf"""
WITH p AS (SELECT doc_id, list_filter(string_split_regex({_CLEAN}, '\n\s*\n+'), lambda x: trim(x, ' ') <> '') AS p FROM documents),
u AS (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS paragraph FROM p),
l AS (SELECT doc_id, paragraph, list_filter(list_transform(string_split_regex(p, '\r\n|[\n\r\x0b\x0c]'), lambda x: {_SPACED('x')}), lambda x: x <> '') AS l FROM u),
r AS (SELECT doc_id, paragraph, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM l),
c AS (SELECT *, sum((i > 1 AND (regexp_matches({norm('line')}, '^(?:{'|'.join(lexicon.BLOCK_HEADINGS)})') OR regexp_matches(line, '^\d+(?:\.\d+)*[.)-]\s+\S+') OR (length(line) <= 140 AND (ends_with(line, ':') OR {_LOUD('line')}))))::INT) OVER (PARTITION BY doc_id, paragraph ORDER BY i) AS part FROM r),
b AS (SELECT doc_id, paragraph, part, string_agg(line, chr(10) ORDER BY i) AS block FROM c GROUP BY 1, 2, 3)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY paragraph, part) - 1)::INT AS block_no, md5(block) AS block FROM b""")
def semantic_blocks(spark, d):
    return chunking.semantic_blocks(pages(spark, d)).select("doc_id", "block_no", F.md5("block").alias("block"))


def _packed(items: str, name: str) -> str:
    """CTEs that pack items (block, k, grp, size, solo, item) of the table `items` into lines of up to size characters, as
    (block, line, text). Only lengths are carried from item to item."""
    return f"""
{name}_f AS (SELECT block, k, grp, solo, length(item) AS n, 1 AS line FROM {items} WHERE k = 1 UNION ALL
  SELECT i.block, i.k, i.grp, i.solo, CASE WHEN fresh THEN length(item) ELSE n + 1 + length(item) END, line + fresh::INT
  FROM (SELECT i.*, f.n, f.line, i.grp <> f.grp OR i.solo OR f.solo OR f.n + 1 + length(i.item) > i.size AS fresh FROM {name}_f f JOIN {items} i ON i.block = f.block AND i.k = f.k + 1) i),
{name} AS (SELECT block, line, string_agg(item, ' ' ORDER BY k) AS text FROM {name}_f JOIN {items} USING (block, k) GROUP BY 1, 2)"""


def _oversized(blocks: str, name: str) -> str:
    """CTEs that cut the texts of `blocks` (block, size, body) into pieces (block, line, text): whole, by sentences or by words."""
    return rf"""
{name}_s AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(regexp_replace(body, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: {_SPACED('x')}), lambda x: x <> '') AS l FROM {blocks}),
{name}_u AS (SELECT block, size, CASE WHEN length(body) <= size THEN 0 WHEN len(l) < 2 THEN 2 ELSE 1 END AS way, unnest(CASE WHEN length(body) <= size OR len(l) < 2 THEN [body] ELSE l END) AS s, generate_subscripts(CASE WHEN length(body) <= size OR len(l) < 2 THEN [body] ELSE l END, 1) AS nth FROM {name}_s),
{name}_w AS (SELECT *, way > 0 AND (way = 2 OR length(s) > size) AS wide FROM {name}_u),
{name}_x AS (SELECT block, size, wide, nth, unnest(CASE WHEN wide THEN list_filter(string_split_regex(s, '\s+'), lambda x: x <> '') ELSE [s] END) AS w, generate_subscripts(CASE WHEN wide THEN list_filter(string_split_regex(s, '\s+'), lambda x: x <> '') ELSE [s] END, 1) AS place FROM {name}_w),
{name}_y AS (SELECT block, size, nth, place, CASE WHEN wide THEN nth ELSE 0 END AS own, wide AND length(w) > size AS solo, unnest(CASE WHEN wide AND length(w) > size THEN list_transform(range(0, length(w), size), lambda p: substr(w, p + 1, size)) ELSE [w] END) AS item, generate_subscripts(CASE WHEN wide AND length(w) > size THEN range(0, length(w), size) ELSE [0] END, 1) AS part FROM {name}_x),
{name}_i AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY nth, place, part) AS k, CASE WHEN own > 0 THEN own ELSE -(count(*) FILTER (own > 0) OVER (PARTITION BY block ORDER BY nth, place, part)) END AS grp FROM {name}_y),
{_packed(f'{name}_i', name)}"""


_CHUNKS = rf"""
hs AS (SELECT row_number() OVER (ORDER BY doc_id, section) AS block, * FROM ({ORACLE_SQL['heading_sections'].replace('md5(string_agg(line, chr(10) ORDER BY i))', 'string_agg(line, chr(10) ORDER BY i)')})),
hd AS (SELECT doc_id FROM hs WHERE heading <> '' GROUP BY 1 HAVING count(*) >= 3),
hb AS (SELECT block, CASE WHEN length(text) <= 1200 THEN 1200 ELSE greatest(300, 1200 - length(heading) - 2) END AS size, CASE WHEN length(text) <= 1200 OR heading = '' THEN text ELSE regexp_replace(substr(text, length(heading) + 1), '^\s+|\s+$', '', 'g') END AS body FROM hs JOIN hd USING (doc_id)),
{_oversized('hb', 'hp')},
hc AS (SELECT doc_id, block AS section, line AS part, trim(CASE WHEN heading <> '' AND length(hs.text) > 1200 THEN heading || chr(10) || chr(10) || hp.text ELSE hp.text END, ' ' || chr(10)) AS text FROM hp JOIN hs USING (block)),
hk AS (SELECT * FROM hc WHERE length(text) >= 80),
bb AS (SELECT row_number() OVER (ORDER BY doc_id, block_no) AS block, doc_id, block_no, 1200 AS size, block AS body FROM ({ORACLE_SQL['semantic_blocks'].replace('md5(block)', 'block')}) WHERE doc_id NOT IN (SELECT doc_id FROM hk)),
{_oversized('(SELECT block, size, body FROM bb)', 'bp')},
pp AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block, line) AS k, bp.text FROM bp JOIN bb USING (block)),
pl AS (SELECT doc_id, list(text ORDER BY k) AS p, list(length(text) + 2 ORDER BY k) AS n FROM pp GROUP BY 1),
pf AS (SELECT doc_id, 1 AS k, 1 AS first, NULL::INT AS closed, NULL::INT AS opened FROM pl UNION ALL
  SELECT doc_id, k + 1, CASE WHEN list_sum(n[first:k + 1]) - 2 <= 1200 THEN first WHEN list_sum(n[kept:k + 1]) - 2 <= 1200 THEN kept ELSE k + 1 END, CASE WHEN list_sum(n[first:k + 1]) - 2 > 1200 THEN k END, first
  FROM (SELECT f.*, l.n, len(l.p) AS most, coalesce(list_min(list_filter(range(1, f.k + 1), lambda s: list_sum(l.n[s:f.k]) - 2 <= 200)), f.k + 1) AS kept FROM pf f JOIN pl l USING (doc_id)) WHERE k < most),
pe AS (SELECT doc_id, opened AS a, closed AS b FROM pf WHERE closed IS NOT NULL UNION ALL SELECT doc_id, first, k FROM pf JOIN pl USING (doc_id) WHERE k = len(p)),
pc AS (SELECT doc_id, b AS section, 0 AS part, trim(array_to_string(p[a:b], chr(10) || chr(10)), ' ' || chr(10)) AS text FROM pe JOIN pl USING (doc_id)),
chunks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY section, part) - 1)::INT AS chunk_index, text FROM (SELECT * FROM hk UNION ALL SELECT * FROM pc WHERE length(text) >= 80))"""


@query(f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, chunk_index, length(text)::INT AS n, md5(text) AS hash FROM chunks")
def chunk_documents(spark, d):
    return chunking.chunk_documents(pages(spark, d)).select("doc_id", "chunk_index", F.length("text").alias("n"), F.md5("text").alias("hash"))


_BARE = lambda c: f"regexp_replace({c}, '[.:]+$', '')"


@query(rf"""WITH RECURSIVE {_CHUNKS},
tl AS (SELECT doc_id, chunk_index, list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c]'), lambda x: {_SPACED('x')}) AS l FROM chunks WHERE chunk_index < 3),
tu AS (SELECT doc_id, chunk_index, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM tl),
tf AS (SELECT *, {norm('line')} AS n, lag(line) OVER (PARTITION BY doc_id ORDER BY chunk_index, i) AS above FROM tu WHERE length(line) BETWEEN 12 AND 280 AND regexp_matches(line, '[{_LET}]')),
tt AS (SELECT doc_id, arg_min(CASE WHEN coalesce({_LOUD('above')} AND NOT {like(norm('above'), lexicon.INSTITUTION_MARKERS)}, false) THEN {_BARE('above')} || ' — ' || {_BARE('line')} ELSE {_BARE('line')} END, (chunk_index, i)) FILTER ({like('n', lexicon.TITLE_MARKERS)}) AS marked,
       arg_min({_BARE('line')}, (chunk_index, i)) FILTER (NOT list_contains({q_list(lexicon.METADATA_LABELS)}, n)) AS plain FROM tf GROUP BY 1),
ts AS (SELECT doc_id, {_BARE(_SPACED("string_split(regexp_replace(text, '([.!?])" + chr(92) + "s+', '" + chr(92) + "1' || chr(1), 'g'), chr(1))[1]"))} AS sentence FROM chunks WHERE chunk_index = 0),
tn AS (SELECT doc_id, coalesce(marked, plain, nullif(sentence, ''), '') AS title FROM ts LEFT JOIN tt USING (doc_id))
SELECT doc_id, title, CASE WHEN title = '' THEN 'Bu belge için güvenilir bir başlık veya özet çıkarılamadı.' ELSE 'Bu belge, “' || title || '” başlıklı bir ' || CASE {' '.join(f"WHEN contains({norm('title')}, '{m}') THEN '{kind}'" for m, kind in lexicon.DOCUMENT_KINDS)} ELSE 'belgedir' END || '.' END AS summary FROM tn""")
def build_profile(spark, d):
    return profile.build_profile(chunking.chunk_documents(pages(spark, d)))


@query(f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, 'no readable text' AS error FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM chunks)")
def without_chunks(spark, d):
    p = pages(spark, d)
    return chunking.without_chunks(p, chunking.chunk_documents(p))


# --- embedding and retrieval -----------------------------------------------------------------------------------------


@query(r"""
WITH k AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS w FROM benchmark),
c AS (SELECT item_id, (('0x' || substr(md5(w), 1, 8))::BIGINT % 384) AS bucket, count(*) AS n FROM k GROUP BY ALL)
SELECT item_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS weight FROM c""")
def hash_embed(spark, d):
    return R.hash_embed(questions(spark, d), ["item_id"]).select("item_id", "bucket", F.round("weight", 6).alias("weight"))


@query(r"""
WITH k AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS w FROM conversations WHERE role = 'user'),
c AS (SELECT conv_id, turn, (('0x' || substr(md5(w), 1, 8))::BIGINT % 384) AS bucket, count(*) AS n FROM k GROUP BY ALL)
SELECT conv_id, turn, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)), 6) AS weight FROM c""")
def embed_questions(spark, d):
    asked = turns(spark, d).where("role = 'user'")
    return R.embed_questions(asked, ["conv_id", "turn"]).select("conv_id", "turn", "bucket", F.round("weight", 6).alias("weight"))


_LEX = f"""
q AS (SELECT item_id, unnest({terms_sql('text')}) AS term FROM benchmark), n AS (SELECT item_id, count(*) AS total FROM q GROUP BY 1),
c AS (SELECT doc_id, unnest({terms_sql('text')}) AS term FROM documents),
v AS (SELECT a.term, b.term AS held FROM (SELECT DISTINCT term FROM q) a JOIN (SELECT DISTINCT term FROM c) b ON contains(a.term, b.term) OR contains(b.term, a.term)),
m AS (SELECT q.item_id, c.doc_id, count(DISTINCT q.term) / any_value(total) AS sparse FROM q JOIN v USING (term) JOIN c ON c.term = v.held JOIN n ON n.item_id = q.item_id GROUP BY 1, 2),
s AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sparse DESC, doc_id) AS sparse_rank FROM m)"""


@query(f"WITH {_LEX} SELECT item_id, doc_id, round(sparse, 6) AS sparse, sparse_rank FROM s")
def lexical_search(spark, d):
    s = R.lexical_search(questions(spark, d), t(spark, d, "documents"), ["item_id"], ["doc_id"])
    return s.select("item_id", "doc_id", F.round("sparse", 6).alias("sparse"), "sparse_rank")


def _hybrid(spark, d):
    docs, q = t(spark, d, "documents").select("doc_id", "text"), questions(spark, d)
    near = dense.dense_search(R.hash_vectors(q, ["item_id"]), R.hash_vectors(docs, ["doc_id"]), ["item_id"], ["doc_id"], R.CANDIDATES)
    near = S.written(near.where("dense > 0"))
    found = R.lexical_search(q, docs, ["item_id"], ["doc_id"], most=4 + R.CANDIDATES, also=near)
    return R.hybrid_search(near, found, ["item_id"], ["doc_id"], 4)


_VEC = lambda table, key: rf"""(SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS weight FROM (SELECT {key}, (('0x' || substr(md5(w), 1, 8))::BIGINT % 384) AS bucket, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS w FROM {table}) GROUP BY ALL))"""


@query(f"""WITH {_LEX},
e AS (SELECT item_id, doc_id, round(sum(a.weight * b.weight), 9) AS dense FROM {_VEC('benchmark', 'item_id')} a JOIN {_VEC('documents', 'doc_id')} b USING (bucket) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY dense DESC, doc_id) AS dense_rank FROM e QUALIFY dense_rank <= 20),
h AS (SELECT coalesce(r.item_id, s.item_id) AS item_id, coalesce(r.doc_id, s.doc_id) AS doc_id, coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0) AS hybrid, greatest(coalesce(dense, 0), least(coalesce(sparse, 0), 1)) AS score
      FROM r FULL JOIN s ON r.item_id = s.item_id AND r.doc_id = s.doc_id)
SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY hybrid DESC, score DESC, doc_id) AS rank, round(score, 6) AS score FROM h QUALIFY rank <= 4""")
def hybrid_search(spark, d):
    return _hybrid(spark, d).select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def _passages(rows: str, key: str) -> str:
    """CTEs that end in `passages` (key, passage), from a table of key, asked, text."""
    return rf"""
pb AS (SELECT {key}, asked, replace(replace(regexp_replace(text, '\n{{2,}}', chr(2), 'g'), chr(10), ' '), chr(2), chr(10) || chr(10)) AS flat FROM {rows}),
pp AS (SELECT {key}, asked, list_filter(list_transform(string_split(regexp_replace(regexp_replace(flat, '([.!?])\s+', '\1' || chr(1), 'g'), '\n{{2,}}', chr(1), 'g'), chr(1)), lambda x: {_SPACED('x')}), lambda x: x <> '') AS p FROM pb),
pu AS (SELECT {key}, asked, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM pp),
po AS (SELECT {key}, s, i, len(list_intersect({terms_sql('s')}, {terms_sql('asked')})) AS n FROM pu),
pk AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, i) AS place FROM po WHERE n > 0),
pf AS (SELECT {key}, string_agg(s, ' ' ORDER BY i) AS found FROM pk WHERE place <= 2 GROUP BY 1),
pg AS (SELECT {key}, coalesce(found, p[1], '') AS x, CASE WHEN found IS NULL THEN 450 ELSE 550 END AS most FROM pp LEFT JOIN pf USING ({key})),
ph AS (SELECT *, left(x, most) AS s FROM pg), pc AS (SELECT *, CASE WHEN contains(s, '. ') THEN length(s) - instr(reverse(s), ' .') - 1 ELSE -1 END AS cut FROM ph),
passages AS (SELECT {key}, CASE WHEN length(x) <= most THEN x ELSE trim(CASE WHEN cut > 300 THEN left(s, cut + 1) ELSE s END, ' ') || '...' END AS passage FROM pc)"""


@query(f"""WITH top AS (SELECT item_id, doc_id, score FROM ({ORACLE_SQL['hybrid_search']}) WHERE rank = 1),
rows AS (SELECT item_id, b.text AS asked, x.text FROM top JOIN benchmark b USING (item_id) JOIN documents x USING (doc_id)), {_passages('rows', 'item_id')}
SELECT item_id, doc_id, score, passage FROM top JOIN passages USING (item_id)""")
def hybrid_passages(spark, d):
    top = _hybrid(spark, d).where("rank = 1").select("item_id", "doc_id", "score")
    both = top.join(questions(spark, d).select("item_id", T.meaningful_terms(F.col("text")).alias("terms")), "item_id").join(t(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return both.select("item_id", "doc_id", F.round("score", 6).alias("score"), R.relevant_passage(F.col("terms"), F.col("text")).alias("passage"))


_STEM = lambda c: reduce(lambda t, endings: f"regexp_replace({t}, '^([a-z]{{4,}}?)(?:{'|'.join(endings)})$', '{chr(92)}1')", lexicon.SUFFIX_RULES, c)


# tiny models stand in for trained ones: the hooks are what is run


def _shared_words():
    """A reranker: how many of the question's distinct words the text has."""
    return lambda questions, texts: [float(len(set(q.split(" ")) & set(x.split(" ")))) for q, x in zip(questions, texts)]


def _measures():
    """A sentence model: length, number of spaces and one; it has nothing to say of texts of more than 400 characters."""
    return lambda texts: [[float(len(x)), float(x.count(" ")), 1.0] if len(x) <= 400 else None for x in texts]


def _openings():
    """A span model: the first 20 characters, with a score from the text's length."""
    return lambda questions, texts: [(x[:20], len(x) % 100 / 100) for x in texts]


@query(f"""WITH h AS ({ORACLE_SQL['hybrid_search']}),
x AS (SELECT h.item_id, h.doc_id, h.rank AS given, len(list_intersect(list_distinct(string_split(b.text, ' ')), list_distinct(string_split(left(x.text, 3000), ' ')))) AS s, count(*) OVER (PARTITION BY h.item_id) AS n FROM h JOIN benchmark b USING (item_id) JOIN documents x USING (doc_id))
SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN n > 2 THEN s END DESC, given)::INT AS rank, s::DOUBLE AS reranker_score FROM x QUALIFY rank <= 2""")
def rerank(spark, d):
    """The two best of hybrid search's four documents, by a model."""
    found = S.written(_hybrid(spark, d).select("item_id", "doc_id", "rank"))
    q = questions(spark, d).select("item_id", F.col("text").alias("question"))
    scores = models.reranker_scores(q, found, t(spark, d, "documents").select("doc_id", "text"), _shared_words, ["item_id"], ["doc_id"])
    return R.rerank(found, scores, ["item_id"], ["doc_id"], 2).select("item_id", "doc_id", "rank", "reranker_score")


@query(f"""WITH x AS (SELECT conv_id, turn, lower({WS}) AS x FROM conversations WHERE role = 'user'), v AS (SELECT *, length(x)::DOUBLE AS a, (length(x) - length(replace(x, ' ', '')))::DOUBLE AS b FROM x WHERE x <> '')
SELECT conv_id, turn, length(x) <= 400 AS by_model, CASE WHEN length(x) <= 400 THEN 3 ELSE {R.DIM} END::INT AS size, CASE WHEN length(x) <= 400 THEN round(a / sqrt(a * a + b * b + 1), 6) END AS first, CASE WHEN length(x) <= 400 THEN round(b / sqrt(a * a + b * b + 1), 6) END AS second FROM v WHERE length(x) <= 400 OR regexp_matches(x, '[\\p{{L}}\\p{{N}}_]{{2,}}')""")
def model_embed(spark, d):
    """Vectors of the questions by a model; each distinct text is embedded once."""
    asked = turns(spark, d).where("role = 'user'")
    v = R.embed_questions(asked, ["conv_id", "turn"], embedder=models.embedder(_measures))
    own = lambda k: F.when(F.col("by_model"), F.round(F.get("vec", F.lit(k)), 6))
    return v.select("conv_id", "turn", "by_model", F.size("vec").alias("size"), own(0).alias("first"), own(1).alias("second"))


@query(rf"""
WITH q AS (SELECT DISTINCT item_id, {_STEM('term')} AS term FROM (SELECT item_id, unnest({terms_sql('text')}) AS term FROM benchmark)), w AS (SELECT item_id, count(*) AS need FROM q GROUP BY 1),
x AS (SELECT doc_id, regexp_extract_all({TR}, '[a-z0-9]+') AS l FROM documents), y AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS place FROM x),
v AS (SELECT word, {_STEM('word')} AS term FROM (SELECT DISTINCT word FROM y)), k AS (SELECT doc_id, term, place FROM y JOIN v USING (word) WHERE term IN (SELECT term FROM q)),
f AS (SELECT item_id, doc_id FROM (SELECT DISTINCT doc_id, term FROM k) JOIN q USING (term) JOIN w USING (item_id) GROUP BY 1, 2, need HAVING count(*) = need),
o AS (SELECT item_id, doc_id, term, place, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY place) AS i FROM f JOIN q USING (item_id) JOIN k USING (doc_id, term)),
l AS (SELECT e.item_id, e.doc_id, e.i, b.term, max(b.i) AS i0, max(b.place) AS p0, any_value(e.place) AS p FROM o e JOIN o b ON e.item_id = b.item_id AND e.doc_id = b.doc_id AND b.i <= e.i GROUP BY 1, 2, 3, 4),
c AS (SELECT item_id, doc_id, i, min(i0) AS begin, min(p0) AS p0, any_value(p) AS p FROM l JOIN w USING (item_id) GROUP BY 1, 2, 3, need HAVING count(*) = need),
d AS (SELECT *, lag(begin) OVER (PARTITION BY item_id, doc_id ORDER BY i) AS earlier FROM c),
s AS (SELECT item_id, doc_id, round(sum(0.1::DOUBLE / (1 + (p - p0) - (i - begin))), 9) AS sparse FROM d WHERE earlier IS NULL OR begin > earlier GROUP BY 1, 2)
SELECT item_id, doc_id, sparse, row_number() OVER (PARTITION BY item_id ORDER BY sparse DESC, doc_id) AS sparse_rank FROM s QUALIFY sparse_rank <= 20""")
def fulltext_search(spark, d):
    return R.fulltext_search(questions(spark, d), t(spark, d, "documents"), ["item_id"], ["doc_id"], 20)


@query("""
WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.e, b.e), 9) AS s FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank, round(s, 6) AS score FROM p QUALIFY rank <= 4""")
def dense_search(spark, d):
    """The exact nearest inside a document (here a label), for every 50th vector as a question: itself and four more."""
    e = t(spark, d, "embeddings").select("vec_id", "label", dense.unit(F.col("embedding")).alias("vec"))
    found = dense.dense_search(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e, ["query_id"], ["vec_id"], 5, within=["label"])
    return R.top_k(found.where("query_id <> vec_id"), ["query_id"], [F.desc("dense"), F.asc("vec_id")], 4).select("query_id", "vec_id", "rank", F.round("dense", 6).alias("score"))


_MODE = f"CASE WHEN {like(TR, lexicon.CRITIQUE_MARKERS)} THEN 'critique' WHEN {like(TR, lexicon.SUMMARY_MARKERS)} THEN 'summary' ELSE 'factual' END"


@query(rf"SELECT conv_id, turn, {_MODE} AS mode, CASE WHEN regexp_matches({TR}, '\b(?:en\s+son|son|sonuncu|en\s+yeni|guncel|latest)\b') THEN 'last' WHEN regexp_matches({TR}, '\b(?:ilk|birinci|baslangic|en\s+eski|oldest)\b') THEN 'first' END AS direction FROM conversations WHERE role = 'user'")
def question_modes(spark, d):
    x = F.col("text")
    return turns(spark, d).where("role = 'user'").select("conv_id", "turn", R.classify_response_mode(x).alias("mode"), R.order_direction(x).alias("direction"))


_MARKED = lambda ms: "(" + " OR ".join(f"contains(q, '{m}')" if " " in m else rf"regexp_matches(q, '\b{m}\b')" for m in ms) + ")"


@query(f"""
WITH a AS (SELECT conv_id, turn, {TR} AS n, {reduce(lambda q, x: f"regexp_replace({q}, '{chr(92)}b{x[0]}{chr(92)}b', '{x[1]}', 'g')", lexicon.TYPOS, TR)} AS q FROM conversations WHERE role = 'user'),
b AS (SELECT *, flatten([{', '.join(f"CASE WHEN {_MARKED(triggers)} THEN {q_list(aliases)} ELSE [] END" for triggers, aliases in lexicon.ALIAS_GROUPS)}, CASE WHEN NOT {like(norm('q'), lexicon.CRITIQUE_MARKERS)} AND {like(norm('q'), lexicon.SUMMARY_MARKERS)} THEN {q_list(lexicon.SUMMARY_ALIASES)} ELSE [] END]) AS l FROM a)
SELECT conv_id, turn, {_SPACED("q || ' ' || coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' '), '')")} AS expanded, contains(n, 'ders') AND {like('n', lexicon.LATEST_COURSE_MARKERS)} AS latest_course FROM b""")
def expand_questions(spark, d):
    x = F.col("text")
    return turns(spark, d).where("role = 'user'").select("conv_id", "turn", R.expand_aliases(x).alias("expanded"), R.is_latest_course_question(x).alias("latest_course"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations QUALIFY rank <= 3")
def initial_chunks(spark, d):
    return R.initial_chunks(turns(spark, d), 3, "conv_id", "turn").select("conv_id", "turn", "rank")


@query("SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def ordered_sources(spark, d):
    return R.ordered_sources(turns(spark, d), "last", 2, "conv_id", "turn").select("conv_id", "turn")


def transcripts(spark, d):
    """A transcript for each order: a chunk for each line number, with its course, and its term on lines not divisible by three."""
    line = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_index")).agg(F.min(F.struct("l_shipdate", "l_partkey", "l_suppkey")).alias("x"))
    year, season = F.year("x.l_shipdate"), F.element_at(F.array(F.lit("Güz"), F.lit("Bahar"), F.lit("Yaz")), F.month("x.l_shipdate") % 3 + 1)
    term = F.when(F.col("chunk_index") % 3 != 0, F.concat(year, F.lit("-"), year + 1, F.lit(" "), season, F.lit("\n"))).otherwise("")
    course = F.concat(F.lit("DRS"), 100 + F.col("x.l_suppkey") % 900, F.lit("-2020 Konu "), F.col("x.l_partkey"), F.lit(" 3 A1 4,0 5"))
    return line.select("doc_id", "chunk_index", F.concat(term, course).alias("text"))


_COURSES = """g AS (SELECT l_orderkey AS doc_id, l_linenumber AS chunk_index, min({'d': l_shipdate, 'p': l_partkey, 's': l_suppkey}) AS x FROM lineitem GROUP BY 1, 2),
w AS (SELECT doc_id, chunk_index, 'DRS' || (100 + x.s % 900) || '-2020' AS code, 'Konu ' || x.p AS name, year(x.d) AS y, month(x.d) % 3 + 1 AS season,
      CASE WHEN chunk_index % 3 <> 0 THEN year(x.d) || '-' || (year(x.d) + 1) || ' ' || ['Güz', 'Bahar', 'Yaz'][month(x.d) % 3 + 1] END AS term FROM g),
v AS (SELECT *, last_value(CASE WHEN term IS NOT NULL THEN {'y': y, 's': season, 't': term} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS k FROM w),
l AS (SELECT doc_id, k.t AS term, code, name, chunk_index FROM v WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k.y DESC, k.s DESC, chunk_index DESC) = 1)"""


@query(f"WITH {_COURSES} SELECT doc_id, term, code, name, chunk_index FROM l")
def latest_course(spark, d):
    return R.latest_course(transcripts(spark, d))


# --- guard, verification, answers ------------------------------------------------------------------------------------


def _asked(spark, d):
    """Each user turn with the other speakers' turns of its conversation as sources."""
    c = turns(spark, d)
    q = c.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "conv_id", F.col("text").alias("question"))
    s = c.where("role <> 'user'").select("conv_id", "turn", "text")
    s = q.select("question_id", "conv_id").join(s, "conv_id").withColumn("source_index", F.row_number().over(Window.partitionBy("question_id").orderBy("turn")) - 1)
    return q, s.select("question_id", "source_index", "text")


_ASKED = f"""q AS (SELECT conv_id * 1000 + turn AS question_id, conv_id, text, {TR} AS n, {terms_sql('text')} AS terms FROM conversations WHERE role = 'user'),
s AS (SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY c.turn) - 1)::INT AS source_index, c.text FROM q JOIN conversations c USING (conv_id) WHERE c.role <> 'user')"""
_EXISTS = lambda a, test: f"(len(list_filter({a}, lambda y: {test})) > 0)"
_CONTAINED = "(y = x OR (length(x) >= 3 AND length(y) >= 3 AND (contains(x, y) OR contains(y, x))))"


@query(f"""
WITH {_ASKED}, k AS (SELECT question_id, list_distinct(flatten(list({terms_sql('text')}))) AS held FROM s GROUP BY 1),
a AS (SELECT q.*, coalesce(held, []) AS held, regexp_extract_all(n, '[a-z0-9]+') AS tokens, regexp_extract_all(n, '[a-z]+') AS letters FROM q LEFT JOIN k USING (question_id)),
b AS (SELECT *, len(list_filter(terms, lambda x: {_EXISTS('held', _CONTAINED)})) / greatest(len(terms), 1) AS score,
      len(list_filter(terms, lambda x: {_EXISTS('held', '(y = x OR (least(length(x), length(y)) >= 5 AND (starts_with(x, y) OR starts_with(y, x))))')})) > 0 AS overlap,
      list_has_any(terms, {q_list(lexicon.ABSTRACT_TERMS)}) AND {like('n', lexicon.ABSTRACT_MARKERS)} AS existential, list_has_any(terms, {q_list(lexicon.EXTERNAL_TOPICS)}) OR {like('n', lexicon.PROCEDURE_MARKERS)} AS beyond FROM a)
SELECT question_id, CASE WHEN NOT {like('n', lexicon.ANCHORS)} AND (existential OR {like('n', lexicon.DEFINITION_MARKERS)} OR (beyond AND NOT overlap)) THEN 'general-knowledge-question'
  WHEN NOT {like('n', lexicon.CRITIQUE_MARKERS)} AND {like('n', lexicon.SUMMARY_MARKERS)} THEN NULL
  WHEN len(letters) = 1 AND length(letters[1]) >= 7 AND len(regexp_extract_all(letters[1], '[aeiou]')) < length(letters[1]) * 0.15 THEN 'gibberish-question'
  WHEN len(tokens) = 0 OR {like('n', lexicon.NOISE_PHRASES)} OR (list_has_any(tokens, {q_list(lexicon.SLANG)}) AND len(tokens) <= 3) OR len(terms) = 0 OR (len(terms) <= 2 AND NOT overlap) OR (len(terms) <= 3 AND NOT overlap AND NOT {like('n', lexicon.QUESTION_SHAPES)}) THEN 'low-information-question'
  WHEN score < 0.1 THEN 'low-retrieval-score' END AS reason, round(score, 4) AS score FROM b""")
def guard_reasons(spark, d):
    q, s = _asked(spark, d)
    terms = s.groupBy("question_id").agg(F.array_distinct(F.flatten(F.collect_list(T.meaningful_terms(F.col("text"))))).alias("terms"))
    x = q.join(terms, "question_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    x = x.withColumn("score", R.lexical_score(T.meaningful_terms(F.col("question")), F.col("terms")))
    return x.select("question_id", guard.guard_reason(F.col("question"), F.col("terms"), F.col("score")).alias("reason"), F.round("score", 4).alias("score"))


def _answers(spark, d):
    """Each assistant turn is an answer; the turns of its conversation before it are its sources."""
    c = turns(spark, d)
    a = c.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "conv_id", F.col("turn").alias("at"), F.col("text").alias("answer"), F.lit("factual").alias("mode"))
    s = a.select("answer_id", "conv_id", "at").join(c.select("conv_id", "turn", "text"), "conv_id").where("turn < at").select("answer_id", F.col("turn").cast("int").alias("source_index"), "text")
    return a.select("answer_id", "answer", "mode"), s


_PCT = lambda n: rf"list_distinct(list_transform(regexp_extract_all({n}, '(?:%\s*|\byuzde\s+)(\d+(?:[.,]\d+)?)', 1), lambda v: CASE WHEN contains(replace(v, ',', '.'), '.') THEN regexp_replace(replace(v, ',', '.'), '\.?0+$', '') ELSE v END))"
_TAILED = lambda n, m: f"contains({n}, '{m}')" if " " in m else rf"regexp_matches({n}, '\b{m}[a-z]*\b')"
_RELATED = lambda n: "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(_TAILED(n, m) for m in ms)} THEN '{name}' END" for name, ms in lexicon.RELATIONS.items()) + "], lambda x: x IS NOT NULL)"
_SHORT = "least(length(x), length(y))"
_ENTITY = f"({_CONTAINED} OR ({_SHORT} >= greatest(4, ceil({_SHORT} * 0.75)) AND left(x, greatest(4, ceil({_SHORT} * 0.75))::INT) = left(y, greatest(4, ceil({_SHORT} * 0.75))::INT)))"


def _featured(table: str, keys: str) -> str:
    """SQL: keys, text and the features of a table's texts."""
    apart = r"regexp_replace(text, '([^\p{L}\p{N}_/])', '\1\1', 'g')"
    acronyms = rf"list_transform(regexp_extract_all({apart}, '(?:^|[^\p{{L}}\p{{N}}_])([{_UP}]{{2,}}(?:/[{_UP}]{{2,}})*)(?:$|[^\p{{L}}\p{{N}}_])', 1), lambda x: {norm('x')})"
    negative = rf"({like(chr(39) + ' ' + chr(39) + ' || ' + TR, lexicon.NEGATIVE_MARKERS)} OR regexp_matches({TR}, '\b[a-z]+(?:maz|mez|miyor|miyorlar)\b'))"
    return f"(SELECT *, percentages || money || durations || dates || numbers <> '' AS critical, {terms_sql('text', lexicon.GENERIC_ANSWER_TERMS)} AS terms, {_RELATED(TR)} AS relations, {acronyms} AS acronyms, {negative} AS negative, {TR} AS n FROM ({_facts_sql(table, keys + ', text')}))"


_ENDS = lambda c: rf"regexp_replace({c}, '(^|[^0-9])([.!?])\s+([{_UP}])', '\1\2' || chr(1) || '\3', 'g')"
_UNITS = r"regexp_replace(regexp_replace(f, '(^|[^0-9])([.!?])\s+', '\1\2' || chr(1), 'g'), '\s+(\([0-9]+\)\s)', chr(1) || '\1', 'g')"
_LACKS = lambda k: f"len(list_filter(string_split(c.{k}, ','), lambda x: x <> '' AND NOT list_contains(string_split(w.{k}, ','), x))) = 0"
_CLAIMS = rf"""
c0 AS (SELECT conv_id * 1000 + turn AS answer_id, conv_id, turn AS until, regexp_replace({_SPACED('text')}, '(?i)^belgeye\s+göre\s*:?\s+', '') AS a FROM conversations WHERE role = 'assistant'),
c1 AS (SELECT answer_id, conv_id, until, list_filter(list_transform(string_split({_ENDS(_ENDS("regexp_replace(a, '" + chr(92) + "s*;" + chr(92) + "s+', chr(1), 'g')"))}, chr(1)), lambda x: trim({_SPACED('x')}, ' -')), lambda x: x <> '') AS l FROM c0),
c2 AS (SELECT answer_id, conv_id, until, unnest(l) AS text, (generate_subscripts(l, 1) - 1)::INT AS claim_no FROM c1),
s0 AS (SELECT conv_id, turn AS source_index, replace(replace(regexp_replace(text, '\n{{2,}}', chr(2), 'g'), chr(10), ' '), chr(2), chr(10) || chr(10)) AS f FROM conversations),
s1 AS (SELECT conv_id, source_index, list_filter(list_transform(string_split(regexp_replace({_UNITS}, '\n{{2,}}', chr(1), 'g'), chr(1)), lambda x: {_SPACED('x')}), lambda x: x <> '') AS l FROM s0),
s2 AS (SELECT conv_id, source_index, list_concat(list_concat(list_transform(l, lambda x: {{'t': x, 'u': 1}}), list_transform(range(1, len(l)), lambda i: {{'t': l[i] || ' ' || l[i + 1], 'u': 2}})), list_transform(range(1, len(l) - 1), lambda i: {{'t': l[i] || ' ' || l[i + 1] || ' ' || l[i + 2], 'u': 3}})) AS w FROM s1),
s3 AS (SELECT conv_id, source_index, unnest(w) AS w, generate_subscripts(w, 1) AS ord FROM s2),
s4 AS (SELECT conv_id, source_index, w.t AS text, min(ord) AS ord, arg_min(w.u, ord) AS units FROM s3 GROUP BY 1, 2, 3),
c AS MATERIALIZED {_featured('c2', 'answer_id, conv_id, until, claim_no')}, w AS MATERIALIZED {_featured('s4', 'conv_id, source_index, ord, units')},
m0 AS (SELECT c.answer_id, c.claim_no, w.source_index, w.ord, c.critical, len(c.terms) AS most, len(c.acronyms) > 0 AS named, len(c.relations) = 0 AS free, {' AND '.join(map(_LACKS, K.KINDS))} AS facts_ok, list_has_any(c.relations, w.relations) AS related, len(list_filter(c.acronyms, lambda x: NOT contains(w.n, x))) = 0 AS acronyms_ok, c.negative = w.negative AS polarity_ok,
       len(list_filter(c.terms, lambda x: {_EXISTS('w.terms', _ENTITY)})) AS met FROM c JOIN w ON c.conv_id = w.conv_id AND w.source_index < c.until AND (NOT c.critical OR w.units = 1)),
m1 AS (SELECT *, met::DOUBLE / greatest(most, 1) AS coverage, CASE WHEN critical THEN 0.35::DOUBLE ELSE 0.65::DOUBLE END AS least_share FROM m0),
m2 AS (SELECT *, facts_ok AND (free OR related) AND acronyms_ok AND polarity_ok AND met >= CASE WHEN most <= 2 THEN 1 ELSE 2 END AND coverage >= least_share AS ok FROM m1),
m3 AS (SELECT *, CASE WHEN ok THEN 'claim-supported' WHEN NOT facts_ok THEN 'critical-fact-mismatch' WHEN NOT polarity_ok THEN 'claim-polarity-mismatch' WHEN NOT acronyms_ok THEN 'named-entity-mismatch' WHEN NOT (free OR related) THEN 'claim-relation-mismatch' WHEN coverage < least_share THEN 'insufficient-claim-coverage' ELSE 'insufficient-claim-evidence' END AS reason,
       coverage + CASE WHEN facts_ok AND critical THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN related THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN acronyms_ok AND named THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN polarity_ok THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN ok THEN 10 ELSE 0 END AS score FROM m2),
m4 AS (SELECT * FROM m3 QUALIFY row_number() OVER (PARTITION BY answer_id, claim_no ORDER BY score DESC, source_index, ord) = 1),
matches AS (SELECT c2.answer_id, c2.claim_no, c2.text AS claim, coalesce(ok, false) AS supported, coalesce(reason, 'no-source-evidence-window') AS reason, source_index::INT AS source_index, coalesce(round(coverage, 4), 0) AS coverage FROM c2 LEFT JOIN m4 USING (answer_id, claim_no))"""


@query(f"WITH {_CLAIMS} SELECT * FROM matches")
def match_claims(spark, d):
    return V.match_claims(*_answers(spark, d)).drop("matched")


@query(f"""WITH {_CLAIMS}, v AS (SELECT c0.answer_id, count(claim) AS n_claims, count(claim) FILTER (supported) AS n_supported FROM c0 LEFT JOIN matches USING (answer_id) GROUP BY 1)
SELECT answer_id, n_claims, n_supported, true AS aligned, n_claims > 0 AND n_claims = n_supported AS supported, CASE WHEN n_claims = 0 THEN 'answer-has-no-verifiable-claims' WHEN n_claims = n_supported THEN 'all-claims-supported' ELSE 'unsupported-answer-claims' END AS reason FROM v""")
def validate_answers(spark, d):
    return V.validate_answers(*_answers(spark, d))


@query(rf"""
WITH {_ASKED}, a AS (SELECT question_id, {_PCT('n')} AS q_pct, {_RELATED('n')} AS q_rel, list_filter(terms, lambda x: x NOT IN ('hangi', 'kac', 'nedir')) AS q_terms, list_filter(terms, lambda x: NOT list_contains({q_list(lexicon.NON_ENTITY_TERMS)}, x) AND NOT regexp_matches(x, '^[0-9]+$')) AS q_ent FROM q),
b AS (SELECT question_id, source_index, {_PCT(TR)} AS pct, {_RELATED(TR)} AS rel, {terms_sql('text')} AS held FROM s),
c AS (SELECT *, len(list_intersect(q_pct, pct)) AS m_pct, len(list_intersect(q_rel, rel)) AS m_rel, len(list_filter(q_ent, lambda x: {_EXISTS('held', _ENTITY)})) AS m_ent, len(list_filter(q_terms, lambda x: {_EXISTS('held', _ENTITY)})) AS m_terms FROM a JOIN b USING (question_id)),
e AS (SELECT *, len(q_pct) > 0 AS exact, CASE WHEN len(q_pct) > 0 THEN m_pct = len(q_pct) AND m_ent > 0 AND m_rel > 0 ELSE m_ent > 0 AND (m_rel > 0 OR m_terms >= 3) AND m_terms / greatest(len(q_terms), 1) >= 0.6 END AS ok FROM c),
r AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY m_pct * 4 + m_ent * 2 + m_rel + CASE WHEN ok THEN 100 ELSE 0 END DESC, source_index) = 1)
SELECT q.question_id, coalesce(ok, false) AS supported, CASE WHEN ok IS NULL THEN 'no-retrieved-chunk-supports-main-claim' WHEN exact AND ok THEN 'exact-percentage-entity-relation-match' WHEN exact THEN 'percentage-without-entity-relation-support' WHEN ok THEN 'entity-relation-match' ELSE 'insufficient-claim-overlap' END AS reason, source_index FROM q LEFT JOIN r USING (question_id)""")
def evidence_support(spark, d):
    return V.evidence_support(*_asked(spark, d)).drop("percentages", "relations")


def _replied(spark, d):
    """User turns with the reply that follows as candidate answer, and all turns before each as sources."""
    order = Window.partitionBy("conv_id").orderBy("turn", "text")
    c = turns(spark, d).withColumns({"reply": F.lead("text").over(order), "by": F.lead("role").over(order), "before": F.collect_list("text").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    q = c.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"), R.classify_response_mode(F.col("text")).alias("mode"), "reply", "by", "before")
    return q.drop("reply", "by", "before"), q.where("by = 'assistant'").select("question_id", F.col("reply").alias("answer")), q.select("question_id", F.posexplode("before").alias("source_index", "text"))


@query()
def finalize_candidates(spark, d):
    return answering.finalize_candidates(*_replied(spark, d))


@query()
def evidence_answers(spark, d):
    q, _, s = _replied(spark, d)
    q, s = S.written(q), S.written(s)  # every step reads them
    return answering.evidence_fallback(q, s, S.written(V.evidence_support(q, s)))


@query("""
WITH c AS (SELECT c_custkey AS k, 'Uygun bölümler: ' || n_name || ' Mühendisliği.' AS departments FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 <> 0)
SELECT k AS question_id, concat_ws(' ', CASE WHEN k % 2 = 0 THEN 'Belgeye göre 4. sınıfta öğrenim gören mühendislik öğrencileri başvurabilir.' END, departments, CASE WHEN k % 3 = 0 THEN 'süreç Genel Yetenek ve İngilizce sınavı, teknik mülakat, kurul mülakatı ve göreve başlama onayıyla ilerler.' END) AS answer FROM c""")
def application_requirements(spark, d):
    """A programme for each customer: its nation names the department, and its key says which rules the sources hold."""
    c = t(spark, d, "customer").join(t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").withColumnRenamed("c_custkey", "question_id")
    k = F.col("question_id")
    first = F.concat(F.when(k % 5 != 0, "Aday Mühendis programı\n").otherwise("Burs programı\n"), "n_name", F.lit(" Mühendisliği"))
    second = F.concat_ws("\n", F.lit("Koşullar aşağıdadır"), F.when(k % 2 == 0, "4 sınıfta öğrenim gören mühendislik öğrencileri"), F.when(k % 3 == 0, "Genel Yetenek, İngilizce ve teknik mülakat"))
    s = c.select("question_id", F.posexplode(F.array(first, second)).alias("source_index", "text"))
    return answering.application_requirements(c.select("question_id", F.lit("Başvuru şartları neler?").alias("question"), F.lit("factual").alias("mode")), s)


@query(f"""
WITH {_COURSES}, r AS (SELECT doc_id, chunk_index, concat_ws(' ', term, code, name, '3 A1 4,0 5') AS text, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS up, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index DESC) AS down FROM w),
p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'first' ELSE 'last' END AS direction, 'Belgeye göre: ' || string_agg(text, ' ' ORDER BY chunk_index) AS answer FROM r WHERE CASE WHEN doc_id % 3 = 1 THEN up ELSE down END <= 3 GROUP BY 1)
SELECT p.doc_id AS question_id, CASE WHEN p.doc_id % 3 = 0 AND term IS NOT NULL THEN 'Belgeye göre en son dönem ' || term || '; bu dönemde görünen ders ' || code || ' ' || name || ' dersidir.' ELSE answer END AS answer,
CASE WHEN p.doc_id % 3 = 0 AND term IS NOT NULL THEN 'transcript-structure' ELSE 'extractive-fallback' END AS provider, CASE WHEN p.doc_id % 3 = 0 AND term IS NOT NULL THEN NULL ELSE 'document-order-' || direction END AS strategy FROM p LEFT JOIN l USING (doc_id)""")
def order_answers(spark, d):
    """A question about each transcript: its latest course, or what its first or last part says."""
    c = S.written(transcripts(spark, d))
    ask = F.element_at(F.array(*map(F.lit, ("En son aldığı ders hangisi?", "İlk bölüm neyi anlatır?", "Son bölüm neyi anlatır?"))), (F.col("doc_id") % 3 + 1).cast("int"))
    q = c.select("doc_id").distinct().select(F.col("doc_id").alias("question_id"), "doc_id", ask.alias("question"))
    return answering.order_answers(q.withColumn("mode", R.classify_response_mode(F.col("question"))), c)


@query()
def attach_citations(spark, d):
    a, s = _answers(spark, d)
    return citations.attach_citations(a, V.match_claims(a, s), s).select("answer_id", "answer", F.size("citations").alias("n_citations"))


@query(f"""WITH {_ASKED}, k AS (SELECT question_id, string_agg(text, chr(10) ORDER BY source_index) AS text FROM s WHERE source_index < 3 GROUP BY 1),
rows AS (SELECT question_id, q.text AS asked, k.text FROM q JOIN k USING (question_id)), {_passages('rows', 'question_id')}
SELECT question_id, CASE WHEN passage IS NULL THEN 'Bu belge içinde soruyla ilişkili bir bölüm bulunamadı.' WHEN {like('n', lexicon.CRITIQUE_MARKERS)} THEN 'Belgeye dayalı değerlendirme üretmek için yerel LLM yanıt üretimi etkin olmalıdır. İlgili kaynak parçaları aşağıda gösterilmiştir.' ELSE 'Belgeye göre: ' || passage END AS answer,
CASE WHEN passage IS NULL THEN 'retrieval' WHEN {like('n', lexicon.CRITIQUE_MARKERS)} THEN 'critique-fallback' ELSE 'extractive-fallback' END AS provider FROM q LEFT JOIN passages USING (question_id)""")
def build_answers(spark, d):
    q, s = _asked(spark, d)
    return answering.build_answers(q.withColumn("mode", R.classify_response_mode(F.col("question"))), s)


@query(rf"""
WITH {_ASKED}, x AS (SELECT question_id, source_index, left(text, 20) AS a, (length(text) % 100)::DOUBLE / 100 AS score FROM s),
u AS (SELECT *, trim(regexp_replace(a, '\s+', ' ', 'g'), ' ') AS c FROM x WHERE score >= 0.02)
SELECT question_id, 'Belgeye göre: ' || arg_max(a, (score, -source_index)) AS answer FROM u WHERE regexp_full_match(c, '[0-9]+([.,][0-9]+)?') OR (length(c) >= 3 AND len(regexp_extract_all(c, '[{_LET}]')) >= 2) GROUP BY 1""")
def best_span(spark, d):
    q, s = _asked(spark, d)
    return answering.best_span(models.spans(q, s, _openings))


@query(f"""
WITH {_ASKED}, k AS (SELECT question_id, string_agg('[' || (source_index + 1) || '] ' || left(text, 1600), chr(10) || chr(10) ORDER BY source_index) AS listed FROM s GROUP BY 1),
m AS (SELECT question_id, text, {_MODE} AS mode FROM q)
SELECT question_id, concat_ws(chr(10) || chr(10), CASE mode WHEN 'summary' THEN 'Summarise only what the sources say.' WHEN 'critique' THEN 'Assess only what the sources show.' ELSE 'Answer only from the sources.' END, listed, 'Question: ' || text) AS prompt FROM m LEFT JOIN k USING (question_id)""")
def build_prompts(spark, d):
    q, s = _asked(spark, d)
    return answering.build_prompts(q.withColumn("mode", R.classify_response_mode(F.col("question"))), s)


# --- evaluation ------------------------------------------------------------------------------------------------------


def sentences(rows: DataFrame, key: str) -> DataFrame:
    """key, sentence: distinct sentences of twenty characters or more."""
    return rows.select(key, F.explode(F.array_distinct(F.filter(F.split("text", r"\.\s+"), lambda x: F.length(x) >= 20))).alias("sentence"))


def _scores(spark, d):
    """Lexical retrieval of the benchmark, held against the documents that quote a sentence of the item."""
    q, x = questions(spark, d), t(spark, d, "documents")
    found = R.lexical_search(q, x, ["item_id"], ["doc_id"], most=3)
    gold = sentences(q, "item_id").join(sentences(x, "doc_id"), "sentence").select("item_id", "doc_id").distinct()
    return found.withColumnRenamed("sparse_rank", "rank"), gold


_SENTENCES = lambda table, key: f"SELECT DISTINCT {key}, sentence FROM (SELECT {key}, unnest(string_split_regex(text, '\\.\\s+')) AS sentence FROM {table}) WHERE length(sentence) >= 20"
_EVAL = f"""{_LEX}, g AS (SELECT DISTINCT item_id, doc_id FROM ({_SENTENCES('benchmark', 'item_id')}) JOIN ({_SENTENCES('documents', 'doc_id')}) USING (sentence)), f AS (SELECT item_id, doc_id, sparse_rank AS rank FROM s WHERE sparse_rank <= 3),
w AS (SELECT item_id, count(*) AS wanted FROM g GROUP BY 1), h AS (SELECT f.item_id, count(*) AS n, count(g.doc_id) AS hits, min(CASE WHEN g.doc_id IS NOT NULL THEN rank END) AS first FROM f LEFT JOIN g ON f.item_id = g.item_id AND f.doc_id = g.doc_id GROUP BY 1),
r AS (SELECT item_id, coalesce(hits, 0) / wanted AS recall, CASE WHEN coalesce(n, 0) > 0 THEN hits / n ELSE 0 END AS precision, coalesce(1.0 / first, 0)::DOUBLE AS reciprocal_rank FROM w LEFT JOIN h USING (item_id))"""


@query(f"WITH {_EVAL} SELECT item_id, round(recall, 6) AS recall, round(precision, 6) AS precision, round(reciprocal_rank, 6) AS reciprocal_rank FROM r")
def retrieval_metrics(spark, d):
    m = evaluation.retrieval_metrics(*_scores(spark, d), "item_id", "doc_id")
    return m.select("item_id", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "reciprocal_rank")))


@query("SELECT event_type, round(avg(value), 2) AS average_ms, round(quantile_cont(value, 0.5), 2) AS p50_ms, round(quantile_cont(value, 0.95), 2) AS p95_ms, round(max(value), 2) AS max_ms FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    return evaluation.latency(t(spark, d, "events").select("event_type", F.col("value").alias("duration_ms")), "event_type")


_FOLDED = lambda c: _SPACED(f"translate(lower(replace(replace({c}, 'İ', 'i̇'), 'ß', 'ss')), 'çğıöşü', 'cgiosu')")


@query(f"""WITH {_EVAL},
y AS (SELECT b.item_id AS case_id, recall, {_FOLDED('text')} AS a, {_FOLDED('substring(text, 1, 12)')} AS needed FROM benchmark b LEFT JOIN r USING (item_id)),
k AS (SELECT *, {like('a', lexicon.EVALUATION_NO_ANSWER_MARKERS)} AS refused, needed <> '' AND CASE WHEN regexp_matches(needed, '^[0-9]+$') THEN regexp_matches(a, '(?:^|[^a-z0-9])' || needed || '(?:$|[^a-z0-9])') ELSE contains(a, needed) END AS met, contains(a, 'yuzde 100') AS bad FROM y),
z AS (SELECT *, CASE WHEN case_id % 5 <> 0 THEN NOT refused AND met AND NOT bad ELSE refused END AS answer_correct, coalesce(recall > 0, false) OR (case_id % 5 = 0 AND refused) AS grounded, coalesce(recall < 1, false) AS short FROM k)
SELECT case_id, answer_correct, grounded, answer_correct AND grounded AND NOT short AS passed, concat_ws(',', CASE WHEN short THEN 'expected-source-not-retrieved' END, CASE WHEN NOT answer_correct THEN 'answer-expectation-failed' END, CASE WHEN NOT grounded THEN 'answer-not-grounded' END) AS failures FROM z""")
def score_cases(spark, d):
    m = evaluation.retrieval_metrics(*_scores(spark, d), "item_id", "doc_id")
    cases = questions(spark, d).join(m, "item_id", "left").select(F.col("item_id").alias("case_id"), F.col("text").alias("answer"), (F.col("item_id") % 5 != 0).alias("should_answer"), F.array(F.array(F.substring("text", 1, 12))).alias("required"), F.array(F.lit("yuzde 100")).alias("forbidden"), (F.col("recall") > 0).alias("supported"), "recall", "precision", "reciprocal_rank")
    return evaluation.score_cases(cases).select("case_id", "answer_correct", "grounded", "passed", F.array_join("failures", ",").alias("failures"))


def _cases(spark, d):
    """Retrieval metrics, and the question's own verdicts: every item that documents quote should be answered."""
    found, gold = _scores(spark, d)
    found = S.written(found)
    m = evaluation.retrieval_metrics(found, gold, "item_id", "doc_id")
    cited = evaluation.citation_correct(found, gold, "item_id", "doc_id")
    hit = F.coalesce(F.col("recall") > 0, F.lit(False))
    return questions(spark, d).join(m, "item_id", "left").join(cited, "item_id", "left").select("item_id", hit.alias("passed"), F.col("recall").isNotNull().alias("should_answer"), hit.alias("answer_correct"), hit.alias("grounded"), "recall", "precision", "reciprocal_rank", "citation_correct")


@query(f"""WITH {_EVAL}, a AS (SELECT b.item_id, r.*, coalesce(recall > 0, false) AS hit FROM benchmark b LEFT JOIN r USING (item_id)),
x AS (SELECT avg(hit::INT) AS passes, coalesce(avg(recall), 0) AS recall, coalesce(avg(precision), 0) AS precision, coalesce(avg(reciprocal_rank), 0) AS mrr, coalesce(avg(hit::INT) FILTER (recall IS NOT NULL), 0) AS correct, avg((recall > 0)::INT) AS cited, coalesce(avg(hit::INT) FILTER (recall IS NULL), 0) AS none FROM a),
k AS (SELECT unnest([{{'metric': 'casePassRate', 'value': passes, 'minimum': 0.9}}, {{'metric': 'recallAtK', 'value': recall, 'minimum': 0.9}}, {{'metric': 'precisionAtK', 'value': precision, 'minimum': 0.3}}, {{'metric': 'meanReciprocalRank', 'value': mrr, 'minimum': 0.8}}, {{'metric': 'answerCorrectness', 'value': passes, 'minimum': 0.9}}, {{'metric': 'groundedness', 'value': correct, 'minimum': 0.9}}, {{'metric': 'citationAccuracy', 'value': coalesce(cited, 0), 'minimum': 0.9}}, {{'metric': 'noAnswerAccuracy', 'value': none, 'minimum': 1.0}}, {{'metric': 'guardAccuracy', 'value': NULL, 'minimum': 1.0}}]) AS g FROM x)
SELECT k.g.metric AS metric, round(k.g.value, 3) AS value, coalesce(round(k.g.value, 4) >= k.g.minimum, false) AS passed FROM k""")
def quality_gates(spark, d):
    """All nine gates; no case here is a guard case, so that the guard's gate has no value and fails."""
    return evaluation.quality_gates(evaluation.aggregate_results(_cases(spark, d))).select("metric", F.round("value", 3).alias("value"), "passed")


def _case_table(spark, d):
    """Conversations as evaluation cases: the last user turn asks, the other speakers' turns are the chunks, and the turn after
    the question is expected; every third case brings that reply as a candidate for the guard, every fifth expects none."""
    c = turns(spark, d).where("text IS NOT NULL")
    q = c.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"), F.max("turn").alias("asked"))
    chunks = c.where("role <> 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    both = q.join(chunks, "conv_id").withColumn("place", F.size(F.filter("x", lambda y: y["turn"] < F.col("asked"))))
    reply = F.get(F.col("x"), F.least("place", F.size("x") - 1))["text"]
    guard = F.col("conv_id") % 3 == 0
    chunk = F.transform("x", lambda y: F.struct(F.lit(1).alias("pageNumber"), y["text"].alias("text"), F.lit(1.0).alias("score")))
    return both.select(F.col("conv_id").cast("string").alias("id"), F.lit("conversation").alias("category"), F.when(guard, "guard").otherwise("pipeline").alias("evaluationMode"), "question", F.when(guard, reply).alias("candidateAnswer"), (3 + F.col("conv_id") % 2).cast("int").alias("topK"), chunk.alias("chunks"), F.array(F.least("place", F.size("x") - 1)).alias("expectedSourceChunks"), F.slice(T.meaningful_terms(reply), 1, 1).alias("requiredAnswerTerms"), F.lit(None).cast("array<array<string>>").alias("requiredAnswerTermGroups"), F.array(F.lit("yuzde 100")).alias("forbiddenAnswerTerms"), (F.col("conv_id") % 5 != 0).alias("shouldAnswer"))


@query()
def run_evaluation(spark, d):
    return evaluate.run_evaluation(_case_table(spark, d)).select("case_id", "evaluation_mode", "provider", "guard_reason", "answer_correct", "grounded", "citation_correct", "guard_correct", F.array_join("failures", ",").alias("failures"), "passed")


# --- operations ------------------------------------------------------------------------------------------------------

_TRACE = "(SELECT event_id AS id, user_id, CASE WHEN event_type = 'click' THEN 'ollama-chat' ELSE 'extractive' END AS provider, CASE WHEN event_type = 'error' THEN 'failed' END AS error, value AS duration_ms, ts AS created_at FROM events)"
_SUMMARY = "count(*) AS total, count(*) FILTER (error IS NULL) AS successes, count(*) FILTER (error IS NOT NULL) AS failures, count(*) FILTER (error IS NULL AND provider LIKE 'ollama%') AS model_answers, count(*) FILTER (error IS NULL AND provider NOT LIKE 'ollama%') AS fallbacks, round(count(*) FILTER (error IS NULL) * 100.0::DOUBLE / count(*), 1) AS success_rate, round(coalesce(avg(duration_ms), 0), 1) AS mean_ms"


@query(f"SELECT {_SUMMARY} FROM {_TRACE}")
def quality_summary(spark, d):
    return O.quality_summary(traces(spark, d))


@query(f"SELECT user_id, {_SUMMARY} FROM {_TRACE} GROUP BY user_id")
def quality_by_user(spark, d):
    return O.quality_by(traces(spark, d), "user_id")


@query(f"SELECT id, user_id, provider, error FROM {_TRACE} ORDER BY created_at DESC, id DESC LIMIT 100")
def recent_traces(spark, d):
    return O.newest(traces(spark, d)).select("id", "user_id", "provider", "error")


@query("""
SELECT hits, misses, sets, deletes, errors, hits + misses AS reads, round(hits * 100.0::DOUBLE / (hits + misses), 1) AS hit_rate FROM (
SELECT count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'click') AS misses, count(*) FILTER (event_type = 'purchase') AS sets, count(*) FILTER (event_type = 'signup') AS deletes, count(*) FILTER (event_type = 'error') AS errors FROM events)""")
def cache_summary(spark, d):
    kinds = F.create_map(*(x for k, v in (("view", "hits"), ("click", "misses"), ("purchase", "sets"), ("signup", "deletes"), ("error", "errors")) for x in (F.lit(k), F.lit(v))))
    return O.cache_summary(t(spark, d, "events").select(F.element_at(kinds, F.col("event_type")).alias("kind"), F.lit(1).alias("amount")))


def _users(spark, d):
    c = t(spark, d, "customer")
    role = F.when(F.col("c_custkey") % 500 == 0, "ADMIN").when(F.col("c_custkey") % 10 == 0, "MANAGER").when(F.col("c_custkey") % 7 == 0, None).otherwise("EMPLOYEE")
    return c.select(F.col("c_custkey").alias("user_id"), role.alias("role"), F.when(F.col("c_custkey") % 13 != 0, F.col("c_nationkey")).alias("department_id"))


def _catalogue(spark, d):
    x = t(spark, d, "documents")
    return x.select("doc_id", (F.col("doc_id") % 997).alias("owner_id"), (F.col("doc_id") % 25).cast("int").alias("department_id"), F.when(F.col("doc_id") % 4 == 0, "DEPARTMENT").when(F.col("doc_id") % 4 == 1, "PRIVATE").alias("sharing_scope"))


_ACCESS = """
u AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 500 = 0 THEN 'ADMIN' WHEN c_custkey % 10 = 0 THEN 'MANAGER' ELSE 'EMPLOYEE' END AS role, CASE WHEN c_custkey % 13 <> 0 THEN c_nationkey END AS department_id FROM customer),
x AS (SELECT doc_id, doc_id % 997 AS owner_id, doc_id % 25 AS department_id, doc_id % 4 = 0 AS shared FROM documents),
a AS (SELECT user_id, doc_id, CASE WHEN role = 'ADMIN' THEN 0 WHEN owner_id = user_id THEN 1 ELSE 2 END AS branch, role, owner_id FROM u JOIN x ON role = 'ADMIN' OR owner_id = user_id OR (shared AND u.department_id = x.department_id))"""


@query(f"WITH {_ACCESS} SELECT user_id, doc_id, branch FROM a")
def accessible_documents(spark, d):
    return O.accessible_documents(_users(spark, d), _catalogue(spark, d))


@query(f"WITH {_ACCESS} SELECT user_id, doc_id, true AS can_access, (role = 'ADMIN' OR owner_id = user_id) AS can_manage, (role = 'ADMIN' OR owner_id = user_id OR (role = 'MANAGER' AND branch = 2)) AS can_reindex FROM a")
def document_permissions(spark, d):
    return O.document_permissions(_users(spark, d), _catalogue(spark, d))


@query(f"""WITH {_ACCESS}, p AS (SELECT DISTINCT o_custkey AS user_id, o_orderkey % 1000 AS doc_id FROM orders)
SELECT user_id, doc_id, branch IS NOT NULL AS can_access, coalesce(branch <= 1, false) AS can_manage, coalesce(branch <= 1 OR role = 'MANAGER', false) AS can_reindex FROM p LEFT JOIN a USING (user_id, doc_id)""")
def check_permissions(spark, d):
    asked = t(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 1000).alias("doc_id"))
    return O.check_permissions(asked, _users(spark, d), _catalogue(spark, d))


@query("SELECT c_custkey AS user_id, n_name AS name FROM customer LEFT JOIN nation ON CASE WHEN c_custkey % 13 <> 0 THEN c_nationkey END = n_nationkey")
def list_users(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("department_id"), F.col("n_name").alias("name"))
    return O.list_users(_users(spark, d), n).select("user_id", "name")


def _jobs(spark, d):
    e = t(spark, d, "events").where("event_type IN ('error', 'purchase')")
    status = F.element_at(F.array(*map(F.lit, (500, 404, 429, 503, 400))), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(F.col("event_id"), (F.col("user_id") % 50).alias("doc_id"), (F.col("event_id") % 4).cast("int").alias("retry_count"), F.lit(None).cast("string").alias("error_class"), status.alias("http_status"), F.col("props").alias("error"), F.col("ts").alias("failed_at"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 IN (0, 2, 3) AND event_id % 4 < 3 THEN 'retry' ELSE 'dlq' END AS route, (event_id % 4 + CASE WHEN event_id % 5 IN (0, 2, 3) AND event_id % 4 < 3 THEN 1 ELSE 0 END)::INT AS retry_count FROM events WHERE event_type IN ('error', 'purchase')""")
def route_failures(spark, d):
    return O.route_failures(_jobs(spark, d)).select("event_id", "route", "retry_count")


@query("""
SELECT user_id AS doc_id, arg_max(CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'READY' WHEN event_type = 'error' THEN 'FAILED' WHEN event_type = 'purchase' THEN 'READY' ELSE 'PROCESSING' END, (ts, event_id)) AS status FROM events GROUP BY 1""")
def document_status(spark, d):
    e = t(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "READY").otherwise("PROCESSING")
    rows = e.select(F.col("user_id").alias("doc_id"), "event_id", F.col("ts").alias("event_time"), status.alias("status"), F.when(F.col("event_id") % 2 == 0, "REINDEX").otherwise("INGEST").alias("operation"), F.lit("READY").alias("previous_status"), F.col("props").alias("error"))
    return O.document_status(rows).select("doc_id", "status")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'new' ELSE source END AS source FROM documents")
def replace_documents(spark, d):
    x = t(spark, d, "documents").select("doc_id", "source")
    new = x.join(t(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").withColumn("source", F.lit("new"))
    return S.replace_documents(x, new)


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'new' ELSE source END AS source FROM documents WHERE doc_id % 10 <> 3 OR doc_id IN (SELECT doc_id FROM labels)")
def publish_documents(spark, d):
    """The catalogue as its first version; then one that replaces the labelled documents and deletes every tenth."""
    base = f"{S.shared_base(spark).rstrip('/')}/plumbline/versions-{uuid.uuid4().hex}"
    x = t(spark, d, "documents").select("doc_id", "source")
    new = x.join(t(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").withColumn("source", F.lit("new"))
    versions.publish(spark, base, x)
    versions.publish(spark, base, new, x.where("doc_id % 10 = 3"))
    return versions.live(spark, base)


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def delete_documents(spark, d):
    return S.delete_documents(t(spark, d, "documents").select("doc_id", "n_chars"), t(spark, d, "labels"))


@query("SELECT event_id AS id, user_id FROM events WHERE event_type <> 'view'")
def cache_misses(spark, d):
    """Requests without a living answer: views were cached a minute before."""
    e = t(spark, d, "events")
    cache = e.where("event_type = 'view'").select(F.col("event_id").alias("key"), (F.col("ts") - F.expr("INTERVAL 1 MINUTE")).alias("stored_at"))
    _, misses = O.cached_answers(e.select(F.col("event_id").alias("key"), F.col("ts").alias("now"), "user_id"), cache)
    return misses.select(F.col("key").alias("id"), "user_id")


@query(f"SELECT {_SUMMARY} FROM {_TRACE}")
def trace_stream(spark, d):
    """The running summary after a stream has read the whole feed."""
    import os

    path = os.path.join(S.shared_base(spark), f"trace-{uuid.uuid4().hex}")
    traces(spark, d).write.parquet(f"{path}/feed")
    feed = spark.read.parquet(f"{path}/feed")
    live = streams.trace_stream(spark.readStream.schema(feed.schema).parquet(f"{path}/feed"))

    def keep(rows, batch_id):
        rows.write.mode("overwrite").parquet(f"{path}/out")

    run = live.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{path}/out")


# --- notices: sentences of the language pack made from the orders' lines, so that facts, claims and guards have work -------


def notices(spark, d):
    line = t(spark, d, "lineitem")
    pct, fee, day = F.round(F.col("l_discount") * 100).cast("int"), F.col("l_quantity").cast("int"), F.date_format("l_shipdate", "dd.MM.yyyy")
    text = F.concat(F.lit("Burs oranı %"), pct, F.lit(" olarak uygulanır. Kayıt ücreti "), fee, F.lit(".000 TL tutar. Süre "), F.col("l_linenumber"), F.lit(" gün olup son tarih "), day, F.lit(" olarak belirlendi."))
    return line.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_index"), pct.alias("pct"), fee.alias("fee"), text.alias("text"))


@query("""SELECT l_orderkey AS doc_id, l_linenumber AS chunk_index, round(l_discount * 100)::INT::VARCHAR AS percentages, (l_quantity::INT * 1000) || ':try' AS money, l_linenumber || ':gun' AS durations, strftime(l_shipdate, '%Y-%m-%d') AS dates, '' AS numbers FROM lineitem""")
def notice_facts(spark, d):
    x = notices(spark, d).select("doc_id", "chunk_index", F.explode(F.array(K.extract_claim_facts(F.col("text")))).alias("f"))
    return x.select("doc_id", "chunk_index", *(F.array_join(F.col("f")[k], ",").alias(k) for k in K.KINDS))


@query("""SELECT l_orderkey AS doc_id, l_linenumber AS chunk_index, unnest([0, 1, 2]) AS claim_no, unnest(['Burs oranı %' || round(l_discount * 100)::INT || ' olarak uygulanır.', 'Kayıt ücreti ' || l_quantity::INT || '.000 TL tutar.', 'Süre ' || l_linenumber || ' gün olup son tarih ' || strftime(l_shipdate, '%d.%m.%Y') || ' olarak belirlendi.']) AS claim FROM lineitem""")
def split_claims(spark, d):
    return notices(spark, d).select("doc_id", "chunk_index", F.posexplode(V.split_claims(F.col("text"))).alias("claim_no", "claim"))


@query("""SELECT c_custkey AS answer_id, 3::BIGINT AS n_claims, (CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 2 END)::BIGINT AS n_supported, c_custkey % 2 = 0 AS supported, CASE WHEN c_custkey % 2 = 0 THEN 'all-claims-supported' ELSE 'unsupported-answer-claims' END AS reason FROM customer""")
def validate_notices(spark, d):
    """A notice for each customer, as an answer, against itself; for odd keys the source names another fee."""
    c = t(spark, d, "customer")
    said = lambda fee: F.concat(F.lit("Burs oranı %"), (F.col("c_nationkey") + 1), F.lit(" olarak uygulanır. Kayıt ücreti "), fee, F.lit(".000 TL tutar. Süre "), (F.col("c_custkey") % 30 + 1), F.lit(" gün olup son tarih 15.07.2026 olarak belirlendi."))
    fee = F.col("c_custkey") % 500 + 1
    a = c.select(F.col("c_custkey").alias("answer_id"), said(fee).alias("answer"), F.lit("factual").alias("mode"))
    s = c.select(F.col("c_custkey").alias("answer_id"), F.lit(0).alias("source_index"), said(F.when(F.col("c_custkey") % 2 == 1, fee + 100).otherwise(fee)).alias("text"))
    return V.validate_answers(a, s).select("answer_id", "n_claims", "n_supported", "supported", "reason")


def _told(spark, d):
    """Customers with what a notice says of them: key k, its percentage p, and the notice with a given fee."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("answer_id"), (F.col("c_nationkey") + 1).alias("p"))
    said = lambda fee: F.concat(F.lit("Burs oranı %"), F.col("p"), F.lit(" olarak uygulanır. Kayıt ücreti "), F.col("answer_id") % 500 + fee, F.lit(".000 TL tutar."))
    return c, said, c.select("answer_id", F.lit(0).alias("source_index"), said(1).alias("text"))


@query("""SELECT c_custkey AS answer_id, 2::BIGINT AS n_claims, 2::BIGINT AS n_supported, c_custkey % 3 <> 0 AS aligned, c_custkey % 3 <> 0 AS supported, CASE WHEN c_custkey % 3 <> 0 THEN 'all-claims-supported' ELSE 'question-fact-mismatch' END AS reason FROM customer""")
def question_alignment(spark, d):
    """Notices as answers to questions about their percentage, or, for keys divisible by three, about another one."""
    c, said, s = _told(spark, d)
    asked = F.concat(F.lit("Burs oranı %"), F.col("p") + F.when(F.col("answer_id") % 3 == 0, 40).otherwise(0), F.lit(" mi?"))
    return V.validate_answers(c.select("answer_id", said(1).alias("answer"), F.lit("factual").alias("mode"), asked.alias("question")), s)


@query("SELECT c_custkey AS answer_id, c_custkey % 5 IN (0, 3, 4) AS grounded FROM customer")
def grounded_answers(spark, d):
    """By key mod 5: the right fee, another one, no answer in spite of evidence, no answer without any, a critique."""
    c, said, s = _told(spark, d)
    k = F.col("answer_id") % 5
    answer = F.when(k == 0, said(1)).when(k == 1, said(2)).when(k == 4, "Kayıt adımları daha açık yazılabilir.").otherwise("Bu bilgi belgede yer almıyor.")
    asked = F.concat(F.lit("Burs oranı %"), F.col("p") + F.when(k == 3, 40).otherwise(0), F.lit(" mi?"))
    return V.grounded_answers(c.select("answer_id", answer.alias("answer"), F.when(k == 4, "critique").otherwise("factual").alias("mode"), asked.alias("question")), s)


@query(f"""SELECT c_custkey AS question_id, CASE WHEN c_custkey % 7 = 0 THEN 'Belgeye göre: ' || 'Java becerileri, 20' || (10 + c_nationkey) || ' yılı.' WHEN c_custkey % 2 = 0 AND c_custkey % 3 > 0 THEN '{answering.SAFE_CRITIQUE}' ELSE ['Özet kısa kalmış.', 'Deneyimler tarihlendirilmemiş.', 'Teknik becerileri eksik.'][c_custkey % 3 + 1] END AS answer,
CASE WHEN c_custkey % 7 = 0 THEN 'extractive-fallback' WHEN c_custkey % 2 = 0 AND c_custkey % 3 > 0 THEN 'ollama-safety-guard' ELSE 'generated' END AS provider FROM customer""")
def checked_critiques(spark, d):
    """Three critiques by key mod 3, as candidates of critique questions where the key is even; the source contradicts two of
    them. Every seventh question is factual and has an empty candidate."""
    c = t(spark, d, "customer").withColumnRenamed("c_custkey", "question_id")
    k = F.col("question_id")
    q = c.select("question_id", F.lit("Bu metin ne diyor?").alias("question"), F.when((k % 7 == 0) | (k % 2 == 1), "factual").otherwise("critique").alias("mode"))
    said = F.element_at(F.array(*map(F.lit, ("Cevap: Özet kısa kalmış.", "Deneyimler tarihlendirilmemiş. (Kaynak: 1)", "Teknik becerileri eksik."))), (k % 3 + 1).cast("int"))
    s = c.select("question_id", F.lit(0).alias("source_index"), F.concat(F.lit("Java becerileri, 20"), 10 + F.col("c_nationkey"), F.lit(" yılı.")).alias("text"))
    return answering.build_answers(q, s, c.select("question_id", F.when(k % 7 == 0, " ").otherwise(said).alias("answer")))


@query("SELECT doc_id, md5(nfc_normalize(coalesce(text, ''))) AS repaired FROM documents")
def repaired_sources(spark, d):
    """Texts broken as PDF extraction breaks them: glyph names for some letters, accents apart from others."""
    x = F.coalesce("text", F.lit(""))
    for letter, broken in (("i", "/idotaccent"), ("é", "/uni00E9"), ("ç", "/uni00e7"), ("ü", "u\u0308"), ("ñ", "n\u0303")):
        x = F.replace(x, F.lit(letter), F.lit(broken))
    return answering.repaired_sources(t(spark, d, "documents").select("doc_id", x.alias("text"))).select("doc_id", F.md5("text").alias("repaired"))


# --- what exists as single functions and small plans -------------------------------------------------------------------


@query("SELECT conv_id AS doc_id, turn AS chunk_index, 1.0::DOUBLE AS score, md5(text) AS hash FROM conversations")
def scan_chunks(spark, d):
    return R.scan_chunks(turns(spark, d).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), "text")).select("doc_id", "chunk_index", "score", F.md5("text").alias("hash"))


def _profiles(spark, d):
    e = t(spark, d, "orders")
    return e.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("summary"), F.col("o_orderdate").alias("updated_at"))


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS title, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') ELSE 'missing' END AS index_version, o_orderkey % 3 = 0 AS index_missing FROM orders")
def join_profile(spark, d):
    return R.join_profile(t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")), _profiles(spark, d)).select("doc_id", "title", "index_version", "index_missing")


@query("SELECT o_orderkey AS doc_id, o_orderpriority AS title, o_orderstatus AS summary FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def get_profile(spark, d):
    return O.get_profile(_profiles(spark, d), t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"))).select("doc_id", "title", "summary")


@query("""
WITH q AS (SELECT DISTINCT l_orderkey AS doc_id, CASE l_orderkey % 3 WHEN 0 THEN 'last' WHEN 1 THEN 'summary' ELSE 'hybrid' END AS strategy FROM lineitem),
c AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS chunk_index FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS up, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index DESC) AS down FROM c),
f AS (SELECT q.doc_id AS question_id, r.doc_id, chunk_index, strategy, up, down FROM q JOIN r USING (doc_id))
SELECT question_id, doc_id, chunk_index, strategy, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN strategy = 'hybrid' THEN down ELSE up END)::INT AS rank FROM f WHERE CASE WHEN strategy = 'summary' THEN up <= 2 ELSE down <= 2 END""")
def select_sources(spark, d):
    line = t(spark, d, "lineitem")
    texts = F.element_at(F.array(*map(F.lit, ("En son ne yazıyor?", "Bu belgenin ana konusu nedir?", "Burs oranı kaç?"))), (F.col("l_orderkey") % 3 + 1).cast("int"))
    q = line.select(F.col("l_orderkey").alias("question_id"), F.col("l_orderkey").alias("doc_id"), texts.alias("question"))
    q = S.written(q.distinct())
    c = S.written(line.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_index")).distinct())
    found = R.top_k(q.join(c, "doc_id").select("question_id", "doc_id", "chunk_index"), ["question_id"], [F.desc("chunk_index")], 5)
    return R.select_sources(q, c, found, 2)


def _departments(spark, d):
    return t(spark, d, "nation").select(F.col("n_nationkey").alias("department_id"), F.col("n_name").alias("name"))


@query("SELECT n_nationkey AS department_id, n_name AS name FROM nation")
def list_departments(spark, d):
    return O.list_departments(_departments(spark, d))


def _catalogue_rows(spark, d):
    status = F.element_at(F.create_map(F.lit("F"), F.lit("READY"), F.lit("O"), F.lit("PROCESSING"), F.lit("P"), F.lit("FAILED")), F.col("o_orderstatus"))
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("owner_id"), F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 25).cast("int")).alias("department_id"), F.when(F.col("o_orderkey") % 2 == 0, "DEPARTMENT").alias("sharing_scope"), status.alias("status"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("int").alias("chunk_count"))


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'READY' WHEN 'O' THEN 'PROCESSING' WHEN 'P' THEN 'FAILED' END"


@query(f"SELECT o_orderkey AS doc_id, o_custkey AS owner_id, CASE WHEN o_orderkey % 2 = 0 THEN 'DEPARTMENT' ELSE 'PRIVATE' END AS sharing_scope, {_STATUS} AS status, 0 AS chunk_count FROM orders")
def document_listing(spark, d):
    return O.document_listing(_catalogue_rows(spark, d)).select("doc_id", "owner_id", "sharing_scope", "status", "chunk_count")


@query("SELECT o_orderkey AS doc_id FROM orders WHERE o_orderstatus = 'F'")
def ready_documents(spark, d):
    return O.ready_documents(_catalogue_rows(spark, d)).select("doc_id")


def _requests(spark, d):
    op = F.when(F.col("o_orderkey") % 4 == 0, "REINDEX").otherwise("INGEST")
    return t(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("doc_id"), op.alias("operation"), (F.col("o_orderkey") % 7 != 0).alias("published"))


@query(f"SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN 'REINDEX' ELSE 'INGEST' END AS operation, {_STATUS} AS previous_status, 0 AS retry_count FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0")
def submit_jobs(spark, d):
    return O.submit_jobs(_catalogue_rows(spark, d), _requests(spark, d))[0].select("doc_id", "operation", "previous_status", "retry_count")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 7 <> 0 THEN 'PROCESSING' WHEN o_orderkey % 4 = 0 AND o_orderstatus = 'F' THEN 'READY' ELSE 'FAILED' END AS status FROM orders WHERE o_orderkey % 3 = 0")
def submitted_status(spark, d):
    return O.submit_jobs(_catalogue_rows(spark, d), _requests(spark, d))[1]


def _share(spark, d):
    return t(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("doc_id"), F.lit("DEPARTMENT").alias("sharing_scope"))


@query("SELECT o_orderkey AS doc_id, CASE WHEN (o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0) OR o_orderkey % 2 = 0 THEN 'DEPARTMENT' END AS sharing_scope FROM orders")
def share_document(spark, d):
    return O.share_document(_catalogue_rows(spark, d), _share(spark, d))[0].select("doc_id", "sharing_scope")


@query("SELECT o_orderkey AS doc_id, 'document-has-no-department' AS reason FROM orders WHERE o_orderkey % 15 = 0")
def rejected_shares(spark, d):
    return O.share_document(_catalogue_rows(spark, d), _share(spark, d))[1]


@query("SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 30 < 25 THEN 'MANAGER' ELSE CASE WHEN c_custkey % 500 = 0 THEN 'ADMIN' WHEN c_custkey % 10 = 0 THEN 'MANAGER' WHEN c_custkey % 7 = 0 THEN NULL ELSE 'EMPLOYEE' END END AS role, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 30 < 25 THEN (c_custkey % 30)::INT WHEN c_custkey % 13 <> 0 THEN c_nationkey END AS department_id FROM customer")
def assign_access(spark, d):
    changes = t(spark, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("user_id"), F.lit("MANAGER").alias("role"), (F.col("c_custkey") % 30).cast("int").alias("department_id"))
    return O.assign_access(_users(spark, d), changes, _departments(spark, d))[0]


@query("SELECT conv_id AS document_id, turn AS id, md5(text) AS hash FROM conversations")
def chat_history(spark, d):
    m = turns(spark, d).select((F.col("conv_id") % 7).alias("owner_id"), F.col("conv_id").alias("document_id"), F.col("turn").alias("created_at"), F.col("turn").alias("id"), "text")
    return O.chat_history(m).select("document_id", "id", F.md5("text").alias("hash"))


@query("SELECT event_id AS key, user_id AS doc_id FROM events WHERE event_id % 5 = 0 OR user_id NOT IN (SELECT doc_id FROM labels)")
def invalidate_cache(spark, d):
    cache = t(spark, d, "events").select(F.col("event_id").alias("key"), F.col("user_id").alias("doc_id"), F.when(F.col("event_id") % 5 == 0, "embedding").otherwise("answer").alias("kind"))
    return O.invalidate(cache, t(spark, d, "labels")).select("key", "doc_id")


@query("SELECT 'chat' AS part, conv_id AS doc_id, count(*) AS n FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels) GROUP BY 2 UNION ALL SELECT 'cache', user_id, count(*) FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels) GROUP BY 2")
def delete_cascade(spark, d):
    chat, cache = S.delete_cascade(t(spark, d, "labels"), turns(spark, d).select(F.col("conv_id").alias("doc_id")), t(spark, d, "events").select(F.col("user_id").alias("doc_id")))
    n = lambda rows, part: rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "doc_id", "n")
    return n(chat, "chat").union(n(cache, "cache"))


@query(f"SELECT question_id, reason IS NOT NULL AS refused, reason, CASE WHEN reason IS NOT NULL THEN 'retrieval-guard' END AS provider, CASE WHEN reason IS NOT NULL THEN score END AS max_score, CASE WHEN reason IS NOT NULL THEN 0.1::DOUBLE END AS min_score FROM ({ORACLE_SQL['guard_reasons']})")
def guard_answer(spark, d):
    a = guard_reasons(spark, d).select("question_id", F.explode(F.array(guard.guard_answer(F.col("reason"), F.col("score")))).alias("a"))
    return a.select("question_id", F.col("a").isNotNull().alias("refused"), "a.reason", "a.provider", "a.max_score", "a.min_score")


@query("SELECT c_custkey AS id, regexp_replace(c_name, '[^a-zA-Z0-9._-]', '_', 'g') AS name, regexp_matches(c_acctbal::VARCHAR, '^\\s*[0-9]+([.,][0-9]+)?\\s*$') AS usable FROM customer")
def file_names(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.sanitize_filename(F.col("c_name")).alias("name"), T.usable_span(T.decimal_text(F.col("c_acctbal").cast("double"))).alias("usable"))


@query("SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'ai-service-error' ELSE 'extractive' END AS provider, greatest(round(value)::BIGINT, 0) AS duration_ms, CASE WHEN event_type = 'error' THEN 'Timeout: ' || props END AS error FROM events")
def trace_rows(spark, d):
    failed = F.col("event_type") == "error"
    r = t(spark, d, "events").select(F.col("event_id").alias("id"), F.lit("extractive").alias("provider"), F.round("value").cast("string").alias("duration_ms"), F.when(failed, F.col("props")).alias("error"), F.when(failed, F.lit("Timeout")).alias("error_class"))
    return S.trace_rows(r.withColumn("duration_ms", F.regexp_replace("duration_ms", r"\.0$", ""))).select("id", "provider", "duration_ms", "error")
