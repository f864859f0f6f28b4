"""Sinks: page markdown, checkpoints, conversations, upserts and deletes by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conversations, ingest


def write_markdown(pages: DataFrame, folder: str) -> None:
    """One markdown text per source, partitioned by source."""
    ingest.page_markdown(pages).withColumnRenamed("markdown", "value").write.mode("overwrite").partitionBy("source").text(folder)


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with the rows of changes in place of those with the same key."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def ensure(spark: SparkSession, name: str, schema: str) -> None:
    """Create a table unless it exists."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def save_conversations(store: DataFrame, limit: int = conversations.MAX_CONVERSATIONS) -> DataFrame:
    """The last conversations by insertion, as they are to be written."""
    return conversations.retained(store, limit)


def commit_message(stats: DataFrame) -> DataFrame:
    """stats with message: counts of a finished run."""
    n = lambda c: F.col(c).cast("string")
    return stats.withColumn("message", F.concat(n("total_pages"), F.lit(" pages ("), n("native_text_pages"), F.lit(" text layer, "), n("ocr_pages"), F.lit(" local OCR, "), n("vision_pages_used"), F.lit(" vision-transcribed)")))
