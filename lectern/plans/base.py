"""Registration of queries and the inputs they derive from the driver's tables."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread


class Queries:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def register(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one all executors share, ``spark.checkpoint.dir``; on a local master that has none, in a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks: the title is the start of the first line."""
    return texts(spark, d).select(F.col("doc_id").alias("chunk_id"), "source", F.substring(F.split("text", "\n")[0], 1, 80).alias("title"), "text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


CHUNKS_SQL = "chunks AS (SELECT doc_id AS chunk_id, source, substr(split_part(text, chr(10), 1), 1, 80) AS title, text FROM documents)"


def manual(spark: SparkSession, d: str) -> DataFrame:
    """Documents made into manual pages: page markers, numbered and all-caps headings, reasoning blocks."""
    n = F.col("doc_id")
    s = lambda x: x.cast("string")
    body = F.concat(
        F.when(n % 3 == 0, F.lit("preface words here\n")).otherwise(F.lit("")), F.lit("<!-- Page 1 -->\n\n"), F.when(n % 2 == 0, F.lit("## ")).otherwise(F.lit("")), s(n % 9 + 1), F.lit("."), s(n % 5), F.lit(" Heading Of Part\n"),
        F.col("text"), F.lit("\n\n---\n\n<!-- Page 2 -->\n\nASSET RECORD FORM\n"), F.substring("text", 1, 200), F.lit("\n4.2 V (at a peak load of 6 A)\nGENERAL OFFICE\n**Note 7:** see below\n<!-- Page 3 -->\n"), F.substring("text", 50, 300), F.lit("\n6.6 Last Part\n"),
    )
    return texts(spark, d).select("doc_id", "source", body.alias("text"))


MANUAL_SQL = """manual AS (SELECT doc_id, source, concat(
  CASE WHEN doc_id % 3 = 0 THEN 'preface words here' || chr(10) ELSE '' END, '<!-- Page 1 -->', chr(10), chr(10), CASE WHEN doc_id % 2 = 0 THEN '## ' ELSE '' END,
  doc_id % 9 + 1, '.', doc_id % 5, ' Heading Of Part', chr(10), text, chr(10), chr(10), '---', chr(10), chr(10), '<!-- Page 2 -->', chr(10), chr(10), 'ASSET RECORD FORM', chr(10),
  substr(text, 1, 200), chr(10), '4.2 V (at a peak load of 6 A)', chr(10), 'GENERAL OFFICE', chr(10), '**Note 7:** see below', chr(10), '<!-- Page 3 -->', chr(10), substr(text, 50, 300), chr(10), '6.6 Last Part', chr(10)) AS text
FROM documents)"""
#: Letterhead lines that the registered queries pass over.
BOILERPLATE = ("general office",)


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def heading_sql(x: str) -> str:
    """Whether a line is a heading, in SQL."""
    bare = f"regexp_replace({strip_sql(x)}, '^#{{1,4}}\\s+', '')"
    return f"""(regexp_matches({bare}, '^\\d+\\.\\d+(?:\\.\\d+)?\\s+[A-Z][a-z].{{1,69}}$')
      OR (regexp_matches({bare}, '^[A-Z][A-Z0-9 &/()'',.\\-]{{7,}}$') AND lower({bare}) <> 'general office'
          AND len(list_filter(regexp_split_to_array({bare}, '\\s+'), lambda t: regexp_matches(t, '^[A-Z]{{3,}}$'))) >= 2))"""
