"""Folder scan and readers: text, markdown, and pluggable readers for binary formats.

``binaryFile`` keeps line ends and gives percent-encoded names; both are set right here. Formats
without a built-in reader are pluggable: a reader is a function from the scanned files to rows
(source, text), registered by extension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from . import documents

Reader = Callable[[DataFrame], DataFrame]


class ReaderNotInstalled(RuntimeError):
    """A file format is known but no reader for it has been registered."""


class EmptyFolder(FileNotFoundError):
    """A knowledge folder has no usable file."""


def scan(spark: SparkSession, folder: str, ext: str | None = None) -> DataFrame:
    """(source, ext, content, mtime) of every file of a folder, or of those with an extension, plain names.

    With an extension other files are not opened. Raises FileNotFoundError where the folder is missing.
    """
    return _named(spark, folder, ext).withColumn("ext", T.extension("source")).select("source", "ext", "content", "mtime")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(source, size, mtime) of a folder's files, none of which is opened."""
    return _named(spark, folder, None).select("source", F.col("length").alias("size"), "mtime")


def _named(spark: SparkSession, folder: str, ext: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    if ext:
        reader = reader.option("pathGlobFilter", "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext))
    try:
        raw = reader.load(folder)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no folder at {folder}") from error
        raise
    name = F.url_decode(F.regexp_replace(F.regexp_extract(F.col("_metadata.file_name"), r"[^/]*\z", 0), r"\+", "%2B"))
    return raw.select(name.alias("source"), "content", F.col("modificationTime").alias("mtime"), "length")


def read_markdown(files: DataFrame) -> DataFrame:
    """Strict UTF-8, newlines made one kind, reasoning blocks removed."""
    return files.select("source", T.strip_thinking_paged(T.newlines(F.decode("content", "UTF-8"))).alias("text"))


def read_text(files: DataFrame) -> DataFrame:
    """UTF-8 with broken bytes replaced."""
    return files.select("source", T.strip_thinking_paged(T.newlines(F.make_valid_utf8(F.col("content").cast("string")))).alias("text"))


def _missing(ext: str) -> Reader:
    def reader(files: DataFrame) -> DataFrame:
        if files.isEmpty():
            return files.select("source", F.lit("").alias("text"))
        raise ReaderNotInstalled(f"no reader for {ext} files is registered; pass readers={{'{ext}': reader}}")

    return reader


READERS: dict[str, Reader] = {".md": read_markdown, ".txt": read_text, ".pdf": _missing(".pdf")}


def load(spark: SparkSession, folder: str, readers: dict[str, Reader] | None = None) -> DataFrame:
    """(source, text) of a folder's files with a reader; blank texts are dropped, other files passed over."""
    out = None
    for ext, reader in (READERS | (readers or {})).items():
        part = reader(scan(spark, folder, ext)).select("source", "text")
        out = part if out is None else out.unionByName(part)
    return out.where(T.strip("text") != "")


def load_and_chunk(spark: SparkSession, folder: str, readers: dict[str, Reader] | None = None, max_chars: int = chunking.MAX_CHARS, overlap: int = chunking.OVERLAP, boilerplate=()) -> DataFrame:
    """Chunks of a folder; ``in_order`` sorts them. ``.txt`` files that are question lists are split at questions.

    Raises FileNotFoundError where the folder is missing, EmptyFolder, which is one, where no file can be used.
    """
    docs = load(spark, folder, readers).withColumn("doc_id", F.col("source"))
    if docs.isEmpty():
        raise EmptyFolder(folder)
    plain = chunking.chunk(docs.where(T.extension("source") != ".txt"), max_chars, overlap, boilerplate)
    return plain.unionByName(chunking.chunk(docs.where(T.extension("source") == ".txt"), max_chars, overlap, boilerplate, faq=True))


def in_order(chunks: DataFrame) -> DataFrame:
    """Chunks by source name, each source's in reading order."""
    return chunks.orderBy("source", "chunk_id")


#: Chunk size of a single file's load.
MARKDOWN_CHARS = 3500


def load_markdown(spark: SparkSession, path: str, max_chars: int = MARKDOWN_CHARS, overlap: int = chunking.OVERLAP, boilerplate=()) -> DataFrame:
    """Chunks of one markdown file, or of all that a pattern names."""
    docs = read_markdown(scan(spark, path)).withColumn("doc_id", F.col("source"))
    return chunking.chunk(docs, max_chars, overlap, boilerplate)


def find_phrase(spark: SparkSession, folder: str, phrase: str) -> DataFrame:
    """(source, snippet) of a folder's .md and .txt files that hold the phrase, case ignored."""
    both = scan(spark, folder, ".md").unionByName(scan(spark, folder, ".txt"))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return both.select("source", T.snippet(text, phrase).alias("snippet")).where("snippet is not null")


def last_updated(files: DataFrame) -> DataFrame:
    return files.agg(F.max("mtime").alias("last_updated"))


def tiered_pages(pages: DataFrame, curated: DataFrame) -> DataFrame:
    """Pages (source, page_num, text) with tier: 1 with native text, else 3 if curated, else 2."""
    known = curated.select("source", "page_num").distinct().withColumn("_curated", F.lit(True))
    tier = F.when(F.length(T.strip("text")) >= T.MIN_NATIVE_CHARS, 1).when(F.col("_curated"), 3).otherwise(2)
    return pages.join(known, ["source", "page_num"], "left").withColumn("tier", tier).drop("_curated")


def docx_text(blocks: DataFrame) -> DataFrame:
    """(source, text) from a reader's blocks (source, block_pos, kind, style, text, cells): paragraphs, then tables, a row a line.

    row_pos, where blocks have it, orders the rows of a table; without it a row is a table of its own.
    """
    style = F.lower(F.coalesce("style", F.lit("")))
    heads = F.when(style.contains("heading 1"), "# ").when(style.contains("heading 2"), "## ").when(style.contains("heading 3"), "### ").otherwise("")
    row = F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))
    table = F.col("kind") == "table"
    line = F.when(table, row).otherwise(F.concat(heads, F.col("text")))
    at = F.col("row_pos") if "row_pos" in blocks.columns else F.lit(0)
    # Lines without text stand last in their block: one alone keeps the block's place.
    rows = blocks.where(table | (T.strip("text") != "")).select("source", F.struct(table.alias("t"), F.col("block_pos").alias("b"), line.isNull().alias("none"), at.alias("at"), line.alias("line")).alias("_x"))
    whole = rows.groupBy("source").agg(F.array_sort(F.collect_list("_x")).alias("_xs"))

    def joined(x, i):
        before = F.get("_xs", i - 1)
        start = ~(before["t"].eqNullSafe(x["t"]) & before["b"].eqNullSafe(x["b"]))
        mark = F.when(i == 0, "").when(start, "\n\n").when(x["none"], "").otherwise("\n")
        return F.concat(mark, F.coalesce(x["line"], F.lit("")))

    return whole.select("source", F.array_join(F.transform("_xs", joined), "").alias("text"))


def read_docx(files: DataFrame) -> DataFrame:
    """DOCX files, their reasoning blocks removed; raises BrokenDocument for what is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, content in zip(batch["source"], batch["content"], strict=True):
                yield pd.DataFrame([(source, *row) for row in documents.docx_blocks(bytes(content))], columns=["source", "block_pos", "row_pos", "kind", "style", "text", "cells"])

    blocks = files.select("source", "content").mapInPandas(run, "source string, block_pos int, row_pos int, kind string, style string, text string, cells array<string>")
    return docx_text(blocks).select("source", T.strip_thinking("text").alias("text"))


READERS[".docx"] = read_docx
