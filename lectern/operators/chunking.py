"""Splitting text into titled chunks, in narrow operations: no step shuffles.

Headings, questions and page markers are split points inside a text, so a split by zero-width
pattern replaces exploding lines and grouping them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values.
MAX_CHARS, OVERLAP = 6000, 300


def heading_split(c, boilerplate=()) -> Column:
    """Sections of a text: each but the first begins at a heading line."""
    lines = F.split(T.col(c), "\n")
    bare = lambda x: T.without_hashes(T.strip(x))
    marked = F.transform(lines, lambda x, i: F.when((i > 0) & x.rlike(T.MAY_HEAD) & (T.is_section_line(bare(x)) | T.is_form_title(bare(x), boilerplate)), F.concat(F.lit("\x01"), x)).otherwise(x))
    return F.split(F.array_join(marked, "\n"), "\n\x01")


def nonblank(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, T.strip), lambda x: x != "")


def faq_split(c) -> Column:
    return nonblank(F.split(T.col(c), T.FAQ_START))


def page_refine(section: Column, max_chars: int = MAX_CHARS) -> Column:
    """A section's pages, unless it fits and has its own heading, or has one page only."""
    pages = nonblank(F.split(section, f"(?i){T.PAGE_MARKER}"))
    whole = (F.length(section) <= max_chars) & T.own_heading(section).isNotNull()
    # As the element of an array, the pages are split off once.
    return F.when(whole, F.array(section)).otherwise(F.flatten(F.transform(F.array(pages), lambda p: F.when(F.size(p) > 1, p).otherwise(F.array(section)))))


def _starts(size: Column, max_chars: int, overlap: int) -> Column:
    return F.when(size > max_chars, F.sequence(F.lit(0), size - 1, F.lit(max_chars - overlap))).otherwise(F.array(F.lit(0)))


def _slice(text: Column, title: Column, start: Column, k: Column, max_chars: int) -> Column:
    piece = F.when(F.length(text) > max_chars, F.substring(text, start + 1, F.lit(max_chars))).otherwise(text)
    return F.when(k > 0, F.concat(F.lit("[continued — "), title, F.lit("]\n\n"), piece)).otherwise(piece)


def slices(df: DataFrame, text: str = "text", title: str = "title", max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """df with slice_pos and piece: overlapping slices of texts above max_chars, later ones marked."""
    out = df.select("*", F.posexplode(_starts(F.length(text), max_chars, overlap)).alias("slice_pos", "_start"))
    return out.withColumn("piece", _slice(F.col(text), F.col(title), F.col("_start"), F.col("slice_pos"), max_chars)).drop("_start")


def chunk(docs: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, boilerplate=(), faq: bool = False) -> DataFrame:
    """(doc_id, source, chunk_id, section_pos, piece_pos, slice_pos, title, text) from doc_id, source, text.

    chunk_id counts a document's chunks from 0 in reading order. faq: texts that look like a list of
    questions are split at their questions instead, and keep short blocks. A document's chunks are one
    array of its row until they are numbered, so nothing shuffles.
    """
    generic = docs.where(~T.is_faq("text")) if faq else docs
    found = generic.select("doc_id", "source", "text", nonblank(heading_split("text", boilerplate)).alias("_s"))
    found = found.select("doc_id", "source", F.when(F.size("_s") > 0, F.col("_s")).otherwise(F.array("text")).alias("_s"))
    parts = F.flatten(F.transform("_s", lambda s, i: F.transform(page_refine(s, max_chars), lambda p, j: F.struct(i.alias("section_pos"), j.alias("piece_pos"), p.alias("part")))))
    found = found.select("doc_id", "source", parts.alias("_p"))
    titled = F.transform("_p", lambda e: F.struct(e["section_pos"].alias("section_pos"), e["piece_pos"].alias("piece_pos"), e["part"].alias("part"), T.chunk_title(e["part"], "source", boilerplate).alias("title")))
    found = found.select("doc_id", "source", titled.alias("_p"))
    pieces = F.flatten(F.transform("_p", lambda e: F.transform(_starts(F.length(e["part"]), max_chars, overlap), lambda at, k: F.struct(e["section_pos"].alias("section_pos"), e["piece_pos"].alias("piece_pos"), k.alias("slice_pos"), e["title"].alias("title"), _slice(e["part"], e["title"], at, k, max_chars).alias("text")))))
    found = found.select("doc_id", "source", pieces.alias("_p"))
    out = found.select("doc_id", "source", F.posexplode(F.filter("_p", lambda e: T.has_body(e["text"]))).alias("chunk_id", "_c")).select("doc_id", "source", "chunk_id", "_c.*")
    if not faq:
        return out
    blocks = docs.where(T.is_faq("text")).select("doc_id", "source", F.posexplode(faq_split("text")).alias("chunk_id", "text"))
    title = F.coalesce(T.faq_question("text"), T.chunk_title("text", "source", boilerplate))
    return out.unionByName(blocks.select("doc_id", "source", "chunk_id", F.col("chunk_id").alias("section_pos"), F.lit(0).alias("piece_pos"), F.lit(0).alias("slice_pos"), title.alias("title"), "text"))
