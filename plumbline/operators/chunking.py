"""Pages to chunks: lines, heading sections, semantic blocks, packing.

All steps are keyed by (doc_id, page_number); the only shuffles are by document (section numbers, chunk numbers). Packing
is an ordered fold over one page's pieces, run as an Arrow function over single rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon, text as T
from ..sources.tables import spread, written

SIZE, OVERLAP, LEAST = 1200, 200, 80
#: Rows whose texts a task cuts at once.
SLICE_ROWS = 64


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, line_no, line): non-empty lines with single blanks."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), r"\R"), T.normalize_whitespace)
    return pages.select("doc_id", "page_number", F.posexplode(F.filter(lines, lambda x: x != "")).alias("line_no", "line"))


def is_section_heading(line: Column) -> Column:
    n = F.trim(T.normalize_for_matching(line))
    length = F.length(line)
    return (
        F.when((n == "") | (length > 180) | F.endswith(line, F.lit(".")), False)
        .when(n.rlike(T.ascii_borders(r"^(?:madde|bolum|chapter|section)\s+[0-9ivxlcdm]+(?:\b|[.)-])")), True)
        .when(n.rlike(r"^[0-9]+(?:\.[0-9]+){0,4}[.)-]?\s+\S+"), True)
        .when(n.rlike(r"^[a-z]\)\s+\S+"), True)
        .when(n.isin(*lexicon.SECTION_WORDS), True)
        .otherwise((length <= 140) & (F.endswith(F.rtrim(line), F.lit(":")) | T.looks_like_heading(line)))
    )


def starts_semantic_block(line: Column) -> Column:
    n = T.normalize_for_matching(line)
    known = n.rlike(f"^(?:{'|'.join(lexicon.BLOCK_HEADINGS)})")
    short = F.length(line) <= 140
    return known | line.rlike(r"^\d+(?:\.\d+)*[.)-]\s+\S+") | (short & (F.endswith(F.rtrim(line), F.lit(":")) | T.looks_like_heading(line)))


def heading_sections(pages: DataFrame) -> DataFrame:
    """(doc_id, section, page_number, heading, text): lines from one heading to the next, across pages."""
    lines = page_lines(pages).withColumn("head", is_section_heading(F.col("line")))
    order = Window.partitionBy("doc_id").orderBy("page_number", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = lines.withColumn("section", F.sum(F.col("head").cast("long")).over(order))
    rows = F.array_sort(F.collect_list(F.struct("page_number", "line_no", "line", "head")))
    out = numbered.groupBy("doc_id", "section").agg(rows.alias("rows"))
    first = F.get("rows", F.lit(0))
    return out.select("doc_id", "section", first["page_number"].alias("page_number"), F.when(first["head"], first["line"]).otherwise("").alias("heading"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))


def semantic_blocks(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, block_no, block): paragraphs, cut before each line that starts a block."""
    paragraphs = F.filter(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n+"), lambda p: F.trim(p) != "")
    p = pages.select("doc_id", "page_number", F.posexplode(paragraphs).alias("paragraph", "p"))
    lines = F.filter(F.transform(F.split("p", r"\R"), T.normalize_whitespace), lambda x: x != "")
    rows = p.select("doc_id", "page_number", "paragraph", F.posexplode(lines).alias("line_no", "line"))
    order = Window.partitionBy("doc_id", "page_number", "paragraph").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = starts_semantic_block(F.col("line")) & (F.col("line_no") > 0)
    cut = rows.withColumn("part", F.sum(starts.cast("long")).over(order))
    blocks = cut.groupBy("doc_id", "page_number", "paragraph", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n").alias("block"))
    number = Window.partitionBy("doc_id", "page_number").orderBy("paragraph", "part")
    return blocks.select("doc_id", "page_number", (F.row_number().over(number) - 1).alias("block_no"), "block")


def page_blocks(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, blocks): the blocks of `semantic_blocks` in order, made inside each page's row; none
    for a page without lines."""
    paragraphs = F.filter(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n+"), lambda p: F.trim(p) != "")
    lines = lambda p: F.filter(F.transform(F.split(p, r"\R"), T.normalize_whitespace), lambda x: x != "")
    told = lambda ls: F.transform(ls, lambda x, i: F.struct(x.alias("line"), ((i == 0) | F.coalesce(starts_semantic_block(x), F.lit(False))).alias("starts")))
    rows = spread(pages).select("doc_id", "page_number", F.flatten(F.transform(paragraphs, lambda p: told(lines(p)))).alias("lines"))
    begins = F.filter(F.transform("lines", lambda x, i: F.when(x["starts"], i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "page_number", "lines", begins.alias("begins"))
    ends = lambda i: F.coalesce(F.get("begins", i + 1), F.size("lines"))
    block = lambda at, i: F.array_join(F.transform(F.slice("lines", at + 1, ends(i) - at), lambda x: x["line"]), "\n")
    return rows.select("doc_id", "page_number", F.transform("begins", block).alias("blocks"))


def pack_words(words, size: int) -> list[str]:
    """Join parts with single blanks as long as they fit; a longer part is cut into pieces."""
    out, line = [], ""
    for w in words:
        if len(w) > size:
            out += [line] * bool(line) + [w[i : i + size] for i in range(0, len(w), size)]
            line = ""
        elif line and len(line) + 1 + len(w) > size:
            out.append(line)
            line = w
        else:
            line = f"{line} {w}" if line else w
    return out + [line] * bool(line)


def split_oversized(block: str, size: int) -> list[str]:
    """Sentences packed up to size; a sentence that is too long is packed by words."""
    import re

    if len(block) <= size:
        return [block]
    sentences = [s for s in (" ".join(x.split()) for x in re.split(r"(?<=[.!?])\s+|\n+", block)) if s]
    if len(sentences) < 2:
        return pack_words(block.split(), size)
    out, run = [], []
    for s in sentences:
        if len(s) > size:
            out += pack_words(run, size) + pack_words(s.split(), size)
            run = []
        else:
            run.append(s)
    return out + pack_words(run, size)


def overlap_blocks(blocks: list[str], overlap: int) -> list[str]:
    """The longest run of last blocks whose joined length is within the overlap."""
    total, n = 0, 0
    for b in reversed(blocks):
        total += len(b) + (2 if n else 0)
        if total > overlap:
            break
        n += 1
    return blocks[len(blocks) - n :] if n else []


def pack_blocks(blocks: list[str], size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Texts of up to `size` characters from a page's blocks, each begun with what overlaps from the one before."""
    out, held = [], []
    joined = lambda x: sum(map(len, x)) + 2 * max(len(x) - 1, 0)
    for piece in (p for b in blocks for p in split_oversized(b, size)):
        if held and joined([*held, piece]) > size:
            out.append("\n\n".join(held))
            held = overlap_blocks(held, overlap)
            if held and joined([*held, piece]) > size:
                held = []
        held.append(piece)
    return out + (["\n\n".join(held)] if held else [])


def heading_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, n): how many section headings each document has, without a shuffle of its text."""
    lines = page_lines(pages).where(is_section_heading(F.col("line")))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def cut_rows(rows: DataFrame, columns: list[str], cut) -> DataFrame:
    """rows without `columns`, and a row (part, text) for each string of cut(*columns), numbered from 0. A task holds the strings
    of few rows at once, however long a batch is."""
    kept = [c for c in rows.columns if c not in columns]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, SLICE_ROWS)
                at += SLICE_ROWS
                found = [cut(*x) for x in zip(*(part.column(c).to_pylist() for c in columns))]
                owner = pa.array([i for i, x in enumerate(found) for _ in x], pa.int32())
                texts = [pa.array([n for x in found for n in range(len(x))], pa.int32()), pa.array([t for x in found for t in x], pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(owner) for c in kept), *texts], names=[*kept, "part", "text"])

    whole = rows.select(*kept, *columns)
    return whole.mapInArrow(run, rows.select(*kept, F.lit(0).alias("part"), F.lit("").alias("text")).schema)


def chunk_by_headings(pages: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, place, page_number, text) of documents with three headed sections or more."""
    headed = heading_lines(pages).where("n >= 3").select("doc_id")

    def pieces(h, t):
        if len(t) <= size:
            return [t]
        body = t[len(h) :].strip() if h else t
        return [f"{h}\n\n{p}" if h else p for p in split_oversized(body, max(300, size - len(h) - 2))]

    sections = heading_sections(pages.join(headed, "doc_id", "left_semi")).withColumnRenamed("text", "body")
    return cut_rows(sections, ["heading", "body"], pieces).select("doc_id", F.struct("section", "part").alias("place"), "page_number", "text")


def chunk_pages(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, place, page_number, text): each page's blocks packed."""
    blocks = page_blocks(pages)
    rows = cut_rows(blocks, ["blocks"], lambda b: pack_blocks(b, size, overlap))
    return rows.select("doc_id", F.struct(F.col("page_number").cast("long").alias("section"), "part").alias("place"), "page_number", "text")


def number_chunks(pieces: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, chunk_index, page_number, text): pieces of `least` characters or more, numbered from 0 in each document."""
    kept = pieces.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).where(F.length("text") >= least)
    return kept.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("place")) - 1).alias("chunk_index"), "page_number", "text")


def chunk_documents(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Heading chunks of each document, or its packed pages if none survive. Documents without chunks are missing."""
    by_heading = written(number_chunks(chunk_by_headings(pages, size)))
    rest = pages.join(by_heading.select("doc_id").distinct(), "doc_id", "left_anti")
    return by_heading.unionByName(number_chunks(chunk_pages(rest, size, overlap)))


def without_chunks(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    return pages.select("doc_id").distinct().join(chunks, "doc_id", "left_anti").withColumn("error", F.lit("no readable text"))
