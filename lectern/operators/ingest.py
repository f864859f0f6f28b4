"""Resumable, budgeted ingest: resume, budgets, quota, checkpoints, uploads, page assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values.
MAX_PAGES, MAX_VISION_PAGES, CHECKPOINT_EVERY = 150, 60, 10
SIZE_LIMITS = {".md": 5 * 1024 * 1024, ".txt": 5 * 1024 * 1024, ".docx": 5 * 1024 * 1024, ".pdf": 25 * 1024 * 1024}
PAGE_JOIN = "\n\n---\n\n"
#: What an uploader is told, with the extension, the size in MB and the limit in MB.
BAD_TYPE, TOO_LARGE, EMPTY = "Unsupported file type '%s'. Only .md, .txt, .docx, .pdf are accepted here.", "File too large (%.1f MB). Limit for %s is %.0f MB.", "File is empty."


def resume(pages: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """pages (source, page_num) with text and tier of those done, and todo for the rest."""
    done = checkpoint.select(F.col("source").alias("_s"), F.col("page_num").alias("_p"), F.col("text").alias("done_text"), F.col("tier").alias("done_tier"))
    out = pages.join(done, (F.col("source") == F.col("_s")) & (F.col("page_num") == F.col("_p")), "left")
    return out.withColumn("todo", F.col("done_tier").isNull()).drop("_s", "_p")


def select_pages(pages: DataFrame, done: DataFrame, redo: DataFrame | None = None) -> DataFrame:
    """Pages to work on: those of redo if given, else those not done."""
    if redo is not None:
        return pages.join(redo.distinct(), ["source", "page_num"], "left_semi")
    return pages.join(done.where(T.strip("text") != ""), ["source", "page_num"], "left_anti")


def vision_budget(pages: DataFrame, wants: Column, succeeds: Column, budget: int = MAX_VISION_PAGES) -> DataFrame:
    """pages with vision: the first ``budget`` wanting pages of a source in order whose calls succeed; failures cost nothing."""
    before = Window.partitionBy("source").orderBy("page_num").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.when(wants & succeeds, 1).otherwise(0)).over(before), F.lit(0))
    return pages.withColumn("vision", wants & succeeds & (used < budget))


def quota(pages: DataFrame, exhausted: Column) -> DataFrame:
    """pages with paused: the first exhausted page of a source and all after it."""
    upto = Window.partitionBy("source").orderBy("page_num").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("paused", F.max(exhausted.cast("int")).over(upto) == 1)


def is_checkpoint(tier: Column, page_num: Column) -> Column:
    return (tier == 3) | (page_num % CHECKPOINT_EVERY == 0)


def page_caps(pages: DataFrame, n_pages: int, max_pages: int = MAX_PAGES) -> DataFrame:
    """(source, done, beyond, over_cap): pages with text, pages numbered outside 1 to n_pages, whether there are more than max_pages."""
    got = pages.groupBy("source")
    return got.agg(F.count_if(T.strip("text") != "").alias("done"), F.count_if(~F.col("page_num").between(1, n_pages)).alias("beyond"), (F.count("*") > max_pages).alias("over_cap"))


def run_stats(pages: DataFrame) -> DataFrame:
    """(source, total_pages, vision_pages_used, ocr_pages, native_text_pages)."""
    out = pages.groupBy("source").agg(F.count("*").alias("total_pages"), F.count_if(F.col("tier") == 3).alias("vision_pages_used"), F.count_if(F.col("tier") == 2).alias("ocr_pages"))
    return out.withColumn("native_text_pages", F.col("total_pages") - F.col("vision_pages_used") - F.col("ocr_pages"))


def page_markdown(pages: DataFrame) -> DataFrame:
    """(source, markdown): pages 1 to the last in order, missing ones empty, each behind its marker; of a page that occurs twice, the greatest text."""
    got = pages.groupBy("source", "page_num").agg(F.max("text").alias("text")).groupBy("source").agg(F.max("page_num").alias("n"), F.map_from_entries(F.collect_list(F.struct("page_num", "text"))).alias("m"))
    parts = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit("<!-- Page "), i.cast("string"), F.lit(" -->\n\n"), F.coalesce(F.try_element_at("m", i), F.lit(""))))
    return got.select("source", F.array_join(parts, PAGE_JOIN).alias("markdown"))


def validate_upload(files: DataFrame) -> DataFrame:
    """files (name, n_bytes, is_blank) with ok and message."""
    ext = T.extension("name")
    limit = F.lit(None).cast("long")
    for e, n in SIZE_LIMITS.items():
        limit = F.when(F.col("_ext") == e, F.lit(n).cast("long")).otherwise(limit)
    out = files.withColumn("_ext", ext).withColumn("_limit", limit)
    message = (
        F.when(F.col("_limit").isNull(), F.format_string(BAD_TYPE, "_ext"))
        .when(F.col("n_bytes") > F.col("_limit"), F.format_string(TOO_LARGE, F.bround(F.col("n_bytes") / 1e6, 1), "_ext", F.col("_limit") / 1e6))
        .when(F.col("is_blank"), F.lit(EMPTY))
    )
    return out.withColumn("ok", message.isNull()).withColumn("message", F.coalesce(message, F.lit(""))).drop("_ext", "_limit")


def final_names(uploads: DataFrame, existing: DataFrame, epoch: int) -> DataFrame:
    """uploads (name) with final_name: a name that exists gets the epoch before its extension."""
    there = existing.select(F.col("name").alias("_there")).distinct()
    out = uploads.join(there, F.col("name") == F.col("_there"), "left")
    return out.withColumn("final_name", F.when(F.col("_there").isNotNull(), F.concat(T.stem("name"), F.lit(f"_{epoch}"), T.extension("name"))).otherwise(F.col("name"))).drop("_there")
