"""Retrieval evaluation and phrase lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def must_contain(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, passed): the phrase occurs, case ignored, in the joined texts of the case's results.

    results has query_id, rank, text, cases case_id, must_contain; a case without results fails.
    """
    joined = results.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("joined"))
    out = cases.join(joined, F.col("case_id") == F.col("query_id"), "left")
    return out.select("case_id", F.coalesce(F.lower("joined").contains(F.lower("must_contain")), F.lit(False)).alias("passed"))


def top_titles(results: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, titles): the first k titles of each query with their scores, as one line."""
    line = F.format_string("%s (%.2f)", "title", "score")
    got = results.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("a"))
    return got.select("query_id", F.array_join(F.transform("a", lambda x: x["l"]), ", ").alias("titles"))


def accuracy(passed: DataFrame) -> DataFrame:
    return passed.agg(F.count_if("passed").alias("n_passed"), F.count("*").alias("n_cases"))
