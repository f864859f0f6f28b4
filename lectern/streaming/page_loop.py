"""The page loop over pages as they arrive: a source's state decides whether its next page may be called for.

State by source holds what the loop knows, the pages of the checkpoint, and pages that came before
their turn (no more than the page limit). It is saved with each micro-batch, so a restart from the
query's checkpoint goes on behind the last page and repeats no call; with a log of answers, neither does
a batch that failed half-way. The session needs Spark's RocksDB state store.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import page_loop as L
from ..operators.transcription import ATTEMPTS, BACKOFF_S, Keys, RateLimited

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class PageLoop(StatefulProcessor):
    def __init__(self, function: Callable, keys: Sequence[str], limits: L.Limits, attempts: int, backoff: float, log: str | None, timer: bool):
        self.function, self.names, self.limits, self.attempts, self.backoff, self.folder, self.timer = function, list(keys), limits, attempts, backoff, log, timer

    def init(self, handle) -> None:
        self.handle, self.keys, self.log = handle, Keys(self.names), L.CallLog(self.folder) if self.folder else None
        self.loop = handle.getValueState("loop", "next int, used int, stopped boolean, attempt int, waits boolean")
        self.early = handle.getListState("early", "page_num int, native_text string, ocr_text string, n_columns int, significant boolean, item string")
        self.done = handle.getListState("done", "page_num int, text string, tier int")

    def handleInitialState(self, key, row, timerValues) -> None:
        self.done.put([(p["page_num"], p["text"], p["tier"]) for p in row.pages])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new, refused = {}, set()
        for r in rows:
            if r.total_pages > self.limits.max_pages:
                refused.add(r.page_num)
            else:
                new[r.page_num] = (r.native_text, r.ocr_text, r.n_columns, r.significant, r.item)
        if refused:
            yield from (self._row(key, n, "refused", None, None, False, False) for n in sorted(refused))
        else:
            self._load()
            new = {n: page for n, page in new.items() if n >= self.next}  # else it came before
            yield from self._advance(key, timerValues, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._load()
        self.waits = False
        yield from self._advance(key, timerValues, {})

    def close(self) -> None:
        pass

    def _load(self) -> None:
        at = self.loop.get() if self.loop.exists() else (1, 0, False, 0, False)
        self.next, self.state, self.attempt, self.waits = at[0], L.State(at[1], at[2]), at[3], at[4]

    @staticmethod
    def _row(key, *values) -> Row:
        return Row(source=key[0], page_num=values[0], status=values[1], tier=values[2], text=values[3], checkpoint=values[4], called=values[5])

    def _ask(self, source, page) -> tuple[str, bool] | None:
        """(text, exhausted), or None where the call is to be tried again later."""
        if self.log is not None and (text := self.log.get(source, page.page_num, page.item)) is not None:
            return text, False
        while True:
            try:
                text = L.plain(self.keys.call(self.function, page.item) or "")
                if self.log is not None and text:
                    self.log.put(text, source, page.page_num, page.item)
                return text, False
            except Exception as error:
                self.attempt += 1
                if self.attempt >= self.attempts:
                    return "", isinstance(error, RateLimited)
                if self.timer:
                    return None
                time.sleep(self.backoff * self.attempt)

    def _advance(self, key, timerValues, new) -> Iterator[Row]:
        """Pages in turn, until one is missing or a call has to wait.

        new: pages that came now. Each call to the state is a message to the JVM, so its lists are read and written as wholes.
        """
        held, done = ({p[0]: tuple(p)[1:] for p in pages.get()} if pages.exists() else {} for pages in (self.early, self.done))
        pages = {**held, **new}
        while not self.waits:
            n = self.next
            if n in done:
                out = L.resumed(self.state, *done[n])
            elif n not in pages:
                break
            else:
                page = Row("native_text", "ocr_text", "n_columns", "significant", "item", "page_num")(*pages[n], n)
                if self.state.stopped and not self.limits.degrade:
                    out = ("paused", None, None, False, False)
                else:
                    answer = None
                    if L.may_call(page, self.state, self.limits):
                        answer = self._ask(key[0], page)
                        if answer is None:
                            self.waits = True
                            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.backoff * self.attempt))
                            break
                    out = L.finished(page, self.state, self.limits, answer)
            self.next, self.attempt = n + 1, 0
            yield self._row(key, n, *out)
        waiting = {n: page for n, page in pages.items() if n >= self.next}
        if waiting and waiting != held:
            self.early.put([(n, *page) for n, page in waiting.items()])
        elif held and not waiting:
            self.early.clear()
        if done and max(done) < self.next:
            self.done.clear()
        self.loop.update((self.next, self.state.used, self.state.stopped, self.attempt, self.waits))


def transcribe_stream(pages: DataFrame, checkpoint: DataFrame, function: Callable, keys: Sequence[str], limits: L.Limits = L.Limits(), attempts: int = ATTEMPTS, backoff: float = BACKOFF_S, log: str | None = None, timer: bool = True) -> DataFrame:
    """Rows as page_loop.transcribe_calling gives them, from a stream of pages (its columns and total_pages), in append mode.

    A source's pages are numbered from 1 without gaps and may arrive in any order and more than once.
    checkpoint: source, page_num, text, tier of an earlier run, read when the query first starts; its pages
    need not arrive. With timer a failed call is tried again by a timer of its source, while other sources go on;
    Spark then runs batches until the query is stopped, so for availableNow pass timer=False: a task
    waits for its call.
    """
    last = checkpoint.groupBy("source", "page_num").agg(F.max(F.struct("tier", "text")).alias("d"))
    start = last.groupBy("source").agg(F.collect_list(F.struct("page_num", F.col("d.text").alias("text"), F.col("d.tier").alias("tier"))).alias("pages"))
    processor = PageLoop(function, keys, limits, attempts, backoff, log, timer)
    return pages.groupBy("source").transformWithState(processor, L.RESULT, "Append", "ProcessingTime" if timer else "None", initialState=start.groupBy("source"))
