"""Progress of a page stream: counts that Spark observes on the way, told batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "page_progress"


@dataclass(frozen=True)
class Progress:
    """After a batch: pages so far and of it, the last page, and pages so far by tier (None: without one)."""

    batch: int
    done: int
    pages: int
    last_page: int | None
    tiers: dict


def observed(pages: DataFrame) -> DataFrame:
    """pages (page_num, tier), watched: the counts cost no pass of their own."""
    tiers = [F.count_if(F.col("tier") == n).alias(f"t{n}") for n in (1, 2, 3)]
    return pages.observe(NAME, F.count(F.lit(1)).alias("pages"), F.max("page_num").alias("last_page"), *tiers, F.count_if(F.col("tier").isNull()).alias("none"))


class ProgressListener(StreamingQueryListener):
    """tell(Progress) for each batch with pages, in the order of batches. Register it with spark.streams.addListener."""

    def __init__(self, tell: Callable[[Progress], None]):
        self.tell, self.done, self.tiers = tell, {}, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row, run = event.progress.observedMetrics.get(NAME), event.progress.runId
        if row is None or not row.pages:
            return
        self.done[run] = self.done.get(run, 0) + row.pages
        tiers = self.tiers.setdefault(run, {1: 0, 2: 0, 3: 0, None: 0})
        for key, n in ((1, row.t1), (2, row.t2), (3, row.t3), (None, row.none)):
            tiers[key] += n
        self.tell(Progress(event.progress.batchId, self.done[run], row.pages, row.last_page, dict(tiers)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.done.pop(event.runId, None)
        self.tiers.pop(event.runId, None)
