"""Page transcription: the loop over a document's pages, calls with retry and key rotation, uploads.

The loop decides page after page; here its order is a window over each source, so a batch of documents
is one plan over what calls gave. ``page_loop`` makes the calls themselves, one at a time for a source.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import ingest

# Fixed values.
ATTEMPTS, BACKOFF_S = 3, 10


class RateLimited(RuntimeError):
    """A call was refused for its rate or quota."""


def call(function: Callable, item, attempts: int = ATTEMPTS, backoff: float = BACKOFF_S, sleep: Callable = time.sleep) -> tuple[str, bool]:
    """(text, exhausted) of function(item): tried again after a linearly growing wait; exhausted where the last failure was RateLimited."""
    for n in range(attempts):
        try:
            return function(item) or "", False
        except Exception as error:
            if n == attempts - 1:
                return "", isinstance(error, RateLimited)
            sleep(backoff * (n + 1))
    return "", False


class Keys:
    """Calls with the first key that is not used up: a refused one gives way to the next for good, the last stays."""

    def __init__(self, keys: Sequence[str]):
        if not keys:
            raise ValueError("no key is given")
        self.keys, self.at = list(keys), 0

    def call(self, function: Callable, item):
        """function(key, item); raises RateLimited where the last key is refused."""
        while True:
            try:
                return function(self.keys[self.at], item)
            except RateLimited:
                if self.at + 1 == len(self.keys):
                    raise
                self.at += 1


def wants_vision() -> Column:
    """A picture of some size, or columns on a page without native text."""
    native = F.length(T.strip("native_text")) >= T.MIN_NATIVE_CHARS
    return F.col("significant") | (~F.coalesce(native, F.lit(False)) & (F.col("n_columns") >= 2))


def transcribe(pages: DataFrame, checkpoint: DataFrame, budget: int = ingest.MAX_VISION_PAGES, max_pages: int = ingest.MAX_PAGES, degrade: bool = False) -> DataFrame:
    """(source, page_num, status, tier, text, checkpoint) for every page.

    pages: source, page_num, native_text, ocr_text, n_columns, significant, vision_text, exhausted
    (what a call gave, null where none can be made). checkpoint: source, page_num, text, tier of an
    earlier run; its pages are resumed, and its vision pages count to the budget. Status is refused for
    all pages of a source of more than max_pages, resumed for those of the checkpoint, else done, or paused
    from the first call that finds the quota used up on, unless degrade, which goes on with local text. A
    failed call costs no budget. checkpoint says that the state is saved after the page. Null texts are empty; pages or
    checkpoint rows that occur twice count once, the last by tier and text.
    """
    pages = pages.groupBy("source", "page_num").agg(*[F.max_by(c, F.struct("native_text", "ocr_text", "vision_text")).alias(c) for c in ("native_text", "ocr_text", "n_columns", "significant", "vision_text", "exhausted")])
    last = checkpoint.groupBy("source", "page_num").agg(F.max(F.struct("tier", "text")).alias("_done"))
    rows = pages.join(last, ["source", "page_num"], "left")
    whole, order = Window.partitionBy("source"), Window.partitionBy("source").orderBy("page_num")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    todo = F.col("_done").isNull()
    native = T.strip(F.coalesce("native_text", F.lit("")))
    local = F.coalesce(F.nullif("ocr_text", F.lit("")), native)
    plain = ~F.col("significant") & (F.length(native) >= T.MIN_NATIVE_CHARS)
    seen = F.length(F.coalesce("vision_text", F.lit(""))) > 0
    rows = rows.withColumn("_wants", todo & wants_vision() & (F.col("vision_text").isNotNull() | F.coalesce("exhausted", F.lit(False))))
    spent = F.when(todo, F.col("_wants") & seen).otherwise(F.col("_done.tier") == 3).cast("int")
    rows = rows.withColumn("_tried", F.col("_wants") & (F.coalesce(F.sum(spent).over(before), F.lit(0)) < budget))
    rows = rows.withColumn("_stop", F.min(F.when(F.col("_tried") & F.coalesce("exhausted", F.lit(False)), F.col("page_num"))).over(whole))
    late = F.coalesce(F.col("page_num") >= F.col("_stop"), F.lit(False))
    vision = F.col("_tried") & ~late & seen
    status = F.when(F.count("*").over(whole) > max_pages, "refused").when(~todo, "resumed").when(late & F.lit(not degrade), "paused").otherwise("done")
    rows = rows.withColumns({"status": status, "_vision": vision})
    tier = F.when(F.col("status").isin("refused", "paused"), F.lit(None)).when(F.col("status") == "resumed", F.col("_done.tier")).when(F.col("_vision"), 3).when(plain, 1).otherwise(2).cast("int")
    rows = rows.withColumn("tier", tier)
    text = F.when(F.col("status") == "resumed", F.col("_done.text")).when(F.col("tier") == 3, F.col("vision_text")).when(F.col("tier") == 1, native).when(F.col("tier") == 2, local)
    saved = (F.col("status") == "done") & ingest.is_checkpoint(F.col("tier"), F.col("page_num"))
    return rows.select("source", "page_num", "status", "tier", text.alias("text"), F.coalesce(saved, F.lit(False)).alias("checkpoint"))


def outcomes(pages: DataFrame) -> DataFrame:
    """(source, state, pages_done, total_pages, vision_pages_used, ocr_pages, native_text_pages, resumed, markdown) of what transcribe gave.

    state is refused, paused, blank (no page has text) or done; markdown is there for done ones alone.
    Of a paused source all pages of its checkpoint are done, and vision_pages_used, ocr_pages and native_text_pages count up to the stop.
    """
    there = F.col("status").isin("done", "resumed")
    marked = F.concat(F.lit("<!-- Page "), F.col("page_num").cast("string"), F.lit(" -->\n\n"), T.strip_thinking("text"))
    got = pages.groupBy("source").agg(
        F.count("*").alias("total_pages"), F.count_if(there).alias("pages_done"), F.min(F.when(F.col("status") == "paused", F.col("page_num"))).alias("_stop"), (F.count_if(F.col("status") == "resumed") > 0).alias("resumed"), F.max(F.col("status") == "refused").alias("_refused"), F.max(F.col("status") == "paused").alias("_paused"),
        F.max(F.length(T.strip(F.coalesce("text", F.lit("")))) > 0).alias("_some"), F.array_sort(F.collect_list(F.struct("page_num", marked.alias("m"), "tier"))).alias("_pages"),
    )
    of_tier = lambda n: F.size(F.filter("_pages", lambda x: (x["tier"] == n) & (F.col("_stop").isNull() | (x["page_num"] < F.col("_stop"))))).cast("long")
    got = got.withColumns({"vision_pages_used": of_tier(3), "ocr_pages": of_tier(2), "native_text_pages": of_tier(1)})
    state = F.when(F.col("_refused"), "refused").when(F.col("_paused"), "paused").when(~F.col("_some"), "blank").otherwise("done")
    got = got.withColumn("state", state)
    markdown = F.when(F.col("state") == "done", F.array_join(F.transform("_pages", lambda x: x["m"]), ingest.PAGE_JOIN))
    return got.select("source", "state", "pages_done", "total_pages", "vision_pages_used", "ocr_pages", "native_text_pages", "resumed", markdown.alias("markdown"))


def upload(files: DataFrame, outcome: DataFrame, existing: DataFrame, epoch: int) -> DataFrame:
    """(file_id, ok, needs_decision, final_name, body, checkpoint_action, message) for a batch of uploads.

    files: file_id, name, n_bytes, is_blank, text; outcome: outcomes() of the PDF files, with source =
    file_id as a string; existing: name. A checkpoint is kept while its upload is paused, deleted when
    it is done; other uploads have none. A name that exists gets the epoch.
    """
    checked = ingest.validate_upload(files.withColumn("_name", F.col("name"))).withColumn("_pdf", T.extension("name") == ".pdf")
    joined = checked.join(outcome, F.col("file_id").cast("string") == F.col("source"), "left")
    pdf, safe = F.col("ok") & F.col("_pdf"), T.safe_filename("_name")
    joined = joined.withColumn("_ok", F.when(pdf, F.coalesce(F.col("state") == "done", F.lit(False))).otherwise(F.col("ok")))
    joined = joined.withColumn("name", F.when(pdf, F.concat(T.stem(safe), F.lit("_transcribed.md"))).otherwise(safe))
    named = ingest.final_names(joined, existing, epoch)
    number = lambda c: F.col(c).cast("string")
    note = F.concat(number("total_pages"), F.lit(" pages: "), number("native_text_pages"), F.lit(" native, "), number("ocr_pages"), F.lit(" OCR, "), number("vision_pages_used"), F.lit(" vision"), F.when(F.col("resumed"), F.lit(", resumed")).otherwise(F.lit("")))
    message = (
        F.when(~F.col("ok"), F.col("message")).when(~pdf, F.lit(""))
        .when(F.col("state") == "refused", F.concat(F.lit("too many pages: "), number("total_pages")))
        .when(F.col("state") == "paused", F.concat(F.lit("paused after "), number("pages_done"), F.lit(" of "), number("total_pages"), F.lit(" pages")))
        .when(F.col("state") == "done", note).otherwise(F.lit("no readable text"))
    )
    action = F.when(pdf & (F.col("state") == "paused"), "keep").when(pdf & (F.col("state") == "done"), "delete").otherwise("none")
    body = F.when(F.col("_ok"), F.when(pdf, F.col("markdown")).otherwise(F.col("text")))
    return named.select("file_id", F.col("_ok").alias("ok"), (pdf & F.coalesce(F.col("state") == "paused", F.lit(False))).alias("needs_decision"), F.when(F.col("_ok"), F.col("final_name")).alias("final_name"), body.alias("body"), action.alias("checkpoint_action"), message.alias("message"))


def invalid_pages(redo: DataFrame, totals: DataFrame) -> DataFrame:
    """(source, page_num) of redo outside 1 to the source's total_pages, or of a source that is not there."""
    out = redo.distinct().join(totals.select("source", "total_pages"), "source", "left")
    return out.where(F.col("total_pages").isNull() | ~F.col("page_num").between(1, F.col("total_pages"))).select("source", "page_num")


def redo_all(checkpoint: DataFrame, backup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(checkpoint, backup) before every page is done again: the first is emptied, the second gains the sources it lacks."""
    return checkpoint.limit(0), backup.unionByName(checkpoint.join(backup.select("source").distinct(), "source", "left_anti").select(*backup.columns))
