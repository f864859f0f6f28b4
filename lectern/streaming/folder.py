"""A folder as a source of changes: what is new, changed, renamed or gone since the last poll, by content.

State is a table of names with size, time and digest; which table counts is kept in a content store, by
compare-and-set. A poll lists the folder without opening anything; only files whose name, size or time
the state does not know are opened, and of these only new content is handed on, so a touched or renamed
file is not cut into chunks again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources.content_store import ContentStore
from ..sources.documents import store_of

STATE = "source string, size long, mtime timestamp, digest string"


class Overtaken(RuntimeError):
    """Another poll of the same state was first."""


def _opened(folder: str):
    """Rows with the content of the file of their name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = store_of(folder)
        for batch in batches:
            for k in range(len(batch)):
                row = batch.iloc[k : k + 1]
                with store.open_input_file(f"{path}/{row['source'].iloc[0]}") as file:
                    yield row.assign(content=[file.read()])

    return run


class FolderWatch:
    """poll(handle) gives the changes (source, change, digest, was, content) to handle, then keeps the new state.

    change is added, changed, renamed (was: a name before, the first of those with this content that are
    gone) or removed; content is there for added and changed files alone. A file whose time alone is new is no
    change. If handle fails, the state stays, and the next poll gives the changes again. Folders in the folder are passed
    over, and so are empty files: one that becomes empty is removed. Raises FileNotFoundError where the folder is missing, Overtaken where another poll was first.
    """

    def __init__(self, spark: SparkSession, folder: str, store: ContentStore, name: str = "folder"):
        self.spark, self.folder, self.store, self.name = spark, folder, store, name

    def state(self) -> tuple[str | None, DataFrame]:
        """The digest of the state, and its rows."""
        row = self.store.read(self.name).where("path = 'state'").first()
        if row is None:
            return None, self.spark.createDataFrame([], STATE)
        return row.sha, self.spark.read.schema(STATE).parquet(json.loads(bytes(row.content))["table"])

    def poll(self, handle: Callable[[DataFrame], None]) -> None:
        sha, before = self.state()
        base = f"{self.store.root}/state/{uuid.uuid4().hex}"
        old = before.select(F.col("source").alias("_s"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("digest").alias("_digest"))
        both = files.listing(self.spark, self.folder).join(old, F.col("source") == F.col("_s"), "left")
        known = F.coalesce((F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime")), F.lit(False))
        both.select("source", "size", "mtime", F.when(known, F.col("_digest")).alias("digest")).write.parquet(f"{base}/listed")
        listed = self.spark.read.schema(STATE).parquet(f"{base}/listed")
        listed.where("digest is null").select("source", "mtime").mapInPandas(_opened(self.folder), "source string, mtime timestamp, content binary").write.parquet(f"{base}/opened")
        opened = self.spark.read.parquet(f"{base}/opened").withColumn("digest", F.sha2("content", 256))
        now = listed.where("digest is not null").unionByName(opened.select("source", F.octet_length("content").cast("long").alias("size"), "mtime", "digest"))
        now.write.parquet(f"{base}/state")
        now = self.spark.read.schema(STATE).parquet(f"{base}/state")

        gone = before.join(now.select("source"), "source", "left_anti")
        origin = gone.groupBy("digest").agg(F.min("source").alias("was")).withColumnRenamed("digest", "_d")
        new = opened.join(old.select("_s", "_digest"), F.col("source") == F.col("_s"), "left").where(F.col("_digest").isNull() | (F.col("_digest") != F.col("digest")))
        new = new.join(origin, (F.col("digest") == F.col("_d")) & F.col("_s").isNull(), "left")
        change = F.when(F.col("_s").isNotNull(), "changed").when(F.col("was").isNotNull(), "renamed").otherwise("added")
        content = F.when(F.col("was").isNull(), F.col("content"))
        moved = new.where("was is not null").select(F.col("was").alias("source"))
        removed = gone.join(moved, "source", "left_anti")
        handle(new.select("source", change.alias("change"), "digest", "was", content.alias("content")).unionByName(removed.select("source", F.lit("removed").alias("change"), "digest", F.lit(None).cast("string").alias("was"), F.lit(None).cast("binary").alias("content"))))
        row = self.spark.createDataFrame([("state", bytearray(json.dumps({"table": f"{base}/state"}).encode()), sha)], "path string, content binary, expected string")
        if self.store.put(self.name, row, "poll").first().outcome not in ("created", "updated"):
            raise Overtaken(self.folder)
