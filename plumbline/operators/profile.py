"""Document profiles: a title from the opening chunks and a one-sentence summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon, text as T
from .retrieval import initial_chunks


def fallback_summary(title: Column) -> Column:
    n = T.normalize_for_matching(title)
    out = F.when(F.coalesce(title, F.lit("")) == "", "Bu belge için güvenilir bir başlık veya özet çıkarılamadı.")
    for marker, kind in lexicon.DOCUMENT_KINDS:
        out = out.when(F.contains(n, F.lit(marker)), F.concat(F.lit("Bu belge, “"), title, F.lit(f"” başlıklı bir {kind}.")))
    return out.otherwise(F.concat(F.lit("Bu belge, “"), title, F.lit("” başlıklı bir belgedir.")))


def document_title(chunks: DataFrame) -> DataFrame:
    """(doc_id, title): the first line with a title marker, after its heading line if it has one; else the first good line."""
    opening = initial_chunks(chunks, 3)
    lines = opening.select("doc_id", "chunk_index", F.posexplode(F.transform(F.split("text", r"\R"), T.normalize_whitespace)).alias("line_no", "line"))
    fit = lines.where((F.length("line") >= 12) & (F.length("line") <= 280) & T.contains_letters(F.col("line")))
    w = Window.partitionBy("doc_id").orderBy("chunk_index", "line_no")
    fit = fit.withColumn("before", F.lag("line").over(w)).withColumn("n", T.normalize_for_matching(F.col("line")))
    bare = lambda c: F.regexp_replace(c, "[.:]+$", "")
    above = T.looks_like_heading(F.col("before")) & ~T.any_of(T.normalize_for_matching(F.col("before")), lexicon.INSTITUTION_MARKERS)
    marked = F.when(T.any_of(F.col("n"), lexicon.TITLE_MARKERS), F.when(F.coalesce(above, F.lit(False)), F.concat(bare("before"), F.lit(" — "), bare("line"))).otherwise(bare("line")))
    plain = F.when(~F.col("n").isin(*lexicon.METADATA_LABELS), bare("line"))
    place = F.struct("chunk_index", "line_no")
    rows = fit.withColumns({"marked": marked, "plain": plain})
    found = rows.groupBy("doc_id").agg(F.min_by("marked", F.when(F.col("marked").isNotNull(), place)).alias("marked"), F.min_by("plain", F.when(F.col("plain").isNotNull(), place)).alias("plain"))
    sentence = bare(T.normalize_whitespace(F.get(F.split("text", r"(?<=[.!?])\s+"), F.lit(0))))
    first = opening.where("rank = 1").select("doc_id", sentence.alias("sentence"))
    return first.join(found, "doc_id", "left").select("doc_id", F.coalesce("marked", "plain", F.when(F.col("sentence") != "", F.col("sentence"))).alias("title"))


def build_profile(chunks: DataFrame) -> DataFrame:
    t = document_title(chunks)
    return t.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), fallback_summary(F.col("title")).alias("summary"))
