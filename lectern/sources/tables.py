"""Tables of texts with work for all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(texts: DataFrame) -> DataFrame:
    """texts, dealt over the session's tasks if its files have fewer splits than these.

    A split is a group of rows in a file, and one task cuts all texts of it, so a table of one file keeps
    one core busy. Such a table is small: it has fewer splits than tasks, each of
    ``spark.sql.files.maxPartitionBytes`` or one row group. A table with more splits stays as it is, without a
    shuffle. Filters and column selection after this still reach the scan.
    """
    tasks = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(tasks) if texts.rdd.getNumPartitions() < tasks else texts
