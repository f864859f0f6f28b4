"""Structured Streaming form of resumable ingest: finished pages arrive, checkpoints are kept by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest


def latest(pages: DataFrame) -> DataFrame:
    """The newest row of each (source, page_num) by seq."""
    return pages.withColumn("_r", F.row_number().over(Window.partitionBy("source", "page_num").orderBy(F.col("seq").desc()))).where("_r = 1").drop("_r")


def checkpoint_pages(stream: DataFrame, save: Callable[[DataFrame, int], None], location: str) -> StreamingQuery:
    """Write each micro-batch's newest pages through ``save(batch, epoch)``.

    The epoch lets save be idempotent: a batch that is run again comes with the same epoch.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        save(latest(batch).withColumn("is_checkpoint", ingest.is_checkpoint(F.col("tier"), F.col("page_num"))), epoch)

    return stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", location).trigger(availableNow=True).start()


def progress(stream: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Pages done by source and tier in windows of ten minutes, late rows up to the watermark."""
    return stream.withWatermark("ts", watermark).groupBy(F.window("ts", "10 minutes"), "source", "tier").agg(F.count("*").alias("pages"))
