"""Checkpoints of page transcription in a content store: written by batch, resumed by content, ended by outcome.

A document's checkpoint is one JSON text under the key of its content, so the same bytes find it under
any name. A micro-batch is one commit that carries the query's name and the batch's number: run again, it changes
nothing. Writing is best effort, as a checkpoint is: a batch that can't be written is counted and passed
over, and a later resume begins at the last that was.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import checkpoints
from ..sources.content_store import ContentStore

#: Fixed values.
BRANCH, FOLDER = "checkpoints", "checkpoints"


def path(key: str = "key"):
    return F.concat(F.lit(f"{FOLDER}/"), F.col(key), F.lit(".json"))


class Checkpoints:
    def __init__(self, store: ContentStore, base: str | None = None):
        self.store = store
        if not store.ensure_branch(BRANCH, base):
            raise ValueError(f"no branch {base}")

    def state(self, version: int | None = None) -> DataFrame:
        """(key, sha, json) of the checkpoints there are."""
        held = self.store.read(BRANCH, version)
        key = F.regexp_extract("path", rf"^{FOLDER}/(.*)\.json$", 1)
        return held.select(key.alias("key"), "sha", F.make_valid_utf8(F.col("content").cast("string")).alias("json"))

    def resume(self, keys: DataFrame) -> DataFrame:
        """(key, page_num, text, tier) of what is done of the documents in keys (key); corrupt checkpoints give no page."""
        mine = self.state().join(keys.select(F.col("key").alias("_k")).distinct(), F.col("key") == F.col("_k"), "left_semi")
        return checkpoints.read_tiered(mine.select("key", "json"), "json")

    def save(self, pages: DataFrame, tag: str | None = None) -> DataFrame:
        """Add pages (key, page_num, text, tier, seq) to their checkpoints; the store's outcome by path.

        Of a page that occurs twice the one of the greatest seq counts, and a new one replaces an old
        one. A corrupt checkpoint is begun anew.
        """
        new = pages.where("key is not null and page_num is not null").groupBy("key", "page_num").agg(F.max(F.struct("seq", "tier", "text")).alias("_n"))
        held = self.state().join(new.select(F.col("key").alias("_k")).distinct(), F.col("key") == F.col("_k"), "left_semi")
        old = checkpoints.read_tiered(held.select("key", "json"), "json")
        both = new.select("key", "page_num", F.lit(1).alias("_age"), F.col("_n.text").alias("text"), F.col("_n.tier").alias("tier")).unionByName(old.select("key", "page_num", F.lit(0).alias("_age"), "text", "tier"))
        last = both.groupBy("key", "page_num").agg(F.max_by(F.struct("text", "tier"), "_age").alias("_page"))
        entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("page_num").cast("string"), "_page"))))
        json = F.to_json(F.struct(entries.alias("pages")))
        made = last.groupBy("key").agg(json.alias("_json"))
        shas = held.select(F.col("key").alias("_k"), "sha")
        changes = made.join(shas, F.col("key") == F.col("_k"), "left").select(path().alias("path"), F.col("_json").cast("binary").alias("content"), F.col("sha").alias("expected"))
        return self.store.put(BRANCH, changes, "checkpoint", tag)

    def finish(self, outcomes: DataFrame) -> DataFrame:
        """Delete the checkpoints of outcomes (key, state) that are done; those of paused and other states stay. (path, outcome, sha) of the deleted."""
        done = outcomes.where("state = 'done'").select(F.col("key").alias("_k")).distinct()
        mine = self.state().join(done, F.col("key") == F.col("_k"), "left_semi")
        return self.store.delete(BRANCH, mine.select(path().alias("path"), F.col("sha").alias("expected")), "transcription complete")

    def sink(self, stream: DataFrame, name: str, location: str, failed: Callable[[int, Exception], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
        """Save the pages of a stream (key, page_num, text, tier, seq), a micro-batch a commit tagged with name and the batch's number.

        failed(batch, error) is told of a batch that could not be written; the stream goes on, unless it raises.
        """

        def write(batch: DataFrame, epoch: int) -> None:
            try:
                self.save(batch, f"{name}:{epoch}").count()
            except Exception as error:
                logging.getLogger(__name__).warning("checkpoint %s of %s was not written: %s", epoch, name, error)
                if failed is not None:
                    failed(epoch, error)

        return stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", location).trigger(**(trigger or {"availableNow": True})).start()
