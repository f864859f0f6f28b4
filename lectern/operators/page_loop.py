"""The page loop with its calls: each page is decided, and called for, only after all before it.

A source's pages are a sequence (budget, quota and resume decide whether the next page may be called
for), so the unit of work is a source, and sources run side by side. A source over the page limit is
refused before anything of it is gathered, so a group never exceeds that limit. ``transcribe_calling`` runs
over tables; ``lectern.streaming.page_loop`` runs the same steps over pages as they arrive.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import ingest
from .transcription import ATTEMPTS, BACKOFF_S, Keys, call

RESULT = "source string, page_num int, status string, tier int, text string, checkpoint boolean, called boolean"
_PAGE = ("native_text", "ocr_text", "n_columns", "significant", "item")


@dataclass
class State:
    """What a source's loop knows after its last page."""

    used: int = 0
    stopped: bool = False


@dataclass(frozen=True)
class Limits:
    budget: int = ingest.MAX_VISION_PAGES
    max_pages: int = ingest.MAX_PAGES
    degrade: bool = False


def wants(page) -> bool:
    """A picture of some size, or columns on a page without native text; as transcription.wants_vision."""
    native = len((page.native_text or "").strip())
    return bool(page.significant) or (native < T.MIN_NATIVE_CHARS and (page.n_columns or 0) >= 2)


def may_call(page, state: State, limits: Limits) -> bool:
    return wants(page) and state.used < limits.budget and not state.stopped


def resumed(state: State, text: str, tier: int) -> tuple:
    """A page of the checkpoint: (status, tier, text, checkpoint, called)."""
    if tier == 3:
        state.used += 1
    return "resumed", tier, text, False, False


def finished(page, state: State, limits: Limits, answer: tuple[str, bool] | None) -> tuple:
    """A page after its call, if it had one: (status, tier, text, checkpoint, called).

    answer is (text, exhausted). An exhausted one stops the source: it pauses, or goes on without calls.
    """
    called = answer is not None
    text, exhausted = answer or ("", False)
    native = (page.native_text or "").strip()
    if exhausted:
        state.stopped = True
        if not limits.degrade:
            return "paused", None, None, False, True
    if text and not exhausted:
        state.used += 1
        tier = 3
    elif not page.significant and len(native) >= T.MIN_NATIVE_CHARS:
        tier, text = 1, native
    else:
        tier, text = 2, page.ocr_text or native
    return "done", tier, text, tier == 3 or page.page_num % ingest.CHECKPOINT_EVERY == 0, called


def run(pages: list, done: dict[int, tuple[str, int]], limits: Limits, ask: Callable) -> Iterator[tuple]:
    """Rows of one source, whose pages come in order; ask(page) gives (text, exhausted)."""
    state = State()
    for page in pages:
        if page.page_num in done:
            # Also after a stop: what is done stays done.
            yield page.page_num, *resumed(state, *done[page.page_num])
        elif state.stopped and not limits.degrade:
            yield page.page_num, "paused", None, None, False, False
        else:
            yield page.page_num, *finished(page, state, limits, ask(page) if may_call(page, state, limits) else None)


def plain(text: str) -> str:
    """An answer without reasoning blocks and outer white space."""
    return re.sub(T.THINK.replace(r"\z", r"\Z"), "", text).strip()


class CallLog:
    """Answers kept in a folder, a file a call, so that a task that runs again asks nothing twice.

    folder is one that all executors see (any URI that Arrow opens). A file is written under a name of
    its own and then renamed, so a half-written answer is never read. Refusals and errors are not kept.
    """

    def __init__(self, folder: str):
        from pyarrow import fs

        self.store, self.path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        self.store.create_dir(self.path, recursive=True)

    def _name(self, *key) -> str:
        return f"{self.path}/{hashlib.sha256(json.dumps(key, default=str).encode()).hexdigest()}.json"

    def get(self, *key) -> str | None:
        try:
            with self.store.open_input_stream(self._name(*key)) as file:
                return json.loads(file.read())["text"]
        except FileNotFoundError:
            return None

    def put(self, text: str, *key) -> None:
        name = self._name(*key)
        part = f"{name}.{uuid.uuid4().hex}"
        with self.store.open_output_stream(part) as file:
            file.write(json.dumps({"text": text}).encode())
        self.store.move(part, name)


def asker(function: Callable, keys: Sequence[str], attempts: int = ATTEMPTS, backoff: float = BACKOFF_S, log: str | None = None) -> Callable:
    """ask(source, page) for a task: function(key, item) with retry, the keys in turn, and the log in front."""
    pool, kept = Keys(keys), CallLog(log) if log else None

    def ask(source, page) -> tuple[str, bool]:
        if kept is not None and (text := kept.get(source, page.page_num, page.item)) is not None:
            return text, False
        text, exhausted = call(lambda item: pool.call(function, item), page.item, attempts, backoff, time.sleep)
        text = plain(text)
        if kept is not None and text and not exhausted:
            kept.put(text, source, page.page_num, page.item)
        return text, exhausted

    return ask


def transcribe_calling(pages: DataFrame, checkpoint: DataFrame, function: Callable, keys: Sequence[str], folder: str, limits: Limits = Limits(), attempts: int = ATTEMPTS, backoff: float = BACKOFF_S) -> DataFrame:
    """(source, page_num, status, tier, text, checkpoint, called) for every page, calls made on the way.

    pages: source, page_num, native_text, ocr_text, n_columns, significant, item (what function(key, item)
    reads); checkpoint: source, page_num, text, tier. A source makes limits.budget successful calls at most, its
    vision pages of the checkpoint included, and none after the first that finds the quota used up; a
    failed call costs no budget; pages of the checkpoint make none and stay, whatever happens before
    them. Status is as transcription.transcribe gives it. Results are written to folder before anything
    reads them, and answers are logged there, so that neither a retried task nor a second reading of the
    result calls again. Null texts are empty; a page that occurs twice counts once, as do rows of checkpoint (the last by tier and text).
    """
    spark = pages.sparkSession
    pages = pages.groupBy("source", "page_num").agg(*[F.max_by(c, F.struct(*_PAGE)).alias(c) for c in _PAGE])
    last = checkpoint.groupBy("source", "page_num").agg(F.max(F.struct("tier", "text")).alias("_done"))
    rows = pages.join(last, ["source", "page_num"], "left").withColumn("_all", F.count("*").over(Window.partitionBy("source")))
    over = rows.where(F.col("_all") > limits.max_pages)
    refused = over.select("source", "page_num", F.lit("refused").alias("status"), F.lit(None).cast("int").alias("tier"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("checkpoint"), F.lit(False).alias("called"))
    log = f"{folder}/answers"

    def loop(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ask = asker(function, keys, attempts, backoff, log)
        some = list(group.astype(object).where(group.notna(), None).sort_values("page_num").itertuples(index=False))
        done = {p.page_num: (p.done_text, p.done_tier) for p in some if p.done_tier is not None}
        out = [(key[0], *row) for row in run(some, done, limits, lambda page: ask(key[0], page))]
        return pd.DataFrame(out, columns=["source", "page_num", "status", "tier", "text", "checkpoint", "called"]).astype({"tier": "Int32"})

    small = rows.where(F.col("_all") <= limits.max_pages).select("source", "page_num", *_PAGE, F.col("_done.text").alias("done_text"), F.col("_done.tier").alias("done_tier"))
    out = small.groupBy("source").applyInPandas(loop, RESULT).unionByName(refused)
    out.write.parquet(f"{folder}/pages")
    return spark.read.schema(RESULT).parquet(f"{folder}/pages")

