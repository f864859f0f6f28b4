"""JSON checkpoints and conversation stores; malformed JSON gives an empty result, not an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

PAGES = "map<string,string>"
TIERED_PAGES = "struct<pages:map<string,struct<text:string,tier:int>>>"
MESSAGES = "array<struct<role:string,content:string>>"


def read_pages(df: DataFrame, json: str) -> DataFrame:
    """df's rows exploded to page_num and text; keys that are no numbers are dropped, texts cleaned again."""
    pages = F.coalesce(F.from_json(json, PAGES), F.create_map().cast(PAGES))
    out = df.select(*[c for c in df.columns if c != json], F.explode(pages).alias("_key", "text"))
    return out.withColumn("page_num", F.expr("try_cast(_key as int)")).where("page_num is not null").withColumn("text", T.strip_thinking("text")).drop("_key")


def write_pages(pages: DataFrame, key: str) -> DataFrame:
    """(key, json) from key, page_num, text; of a page that occurs twice, the greatest text."""
    pages = pages.groupBy(key, "page_num").agg(F.max("text").alias("text"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("page_num").cast("string"), "text"))))
    return pages.groupBy(key).agg(F.to_json(entries).alias("json"))


def read_tiered(df: DataFrame, json: str) -> DataFrame:
    """df's rows exploded to page_num, text, tier, from the checkpoint of an automatic run."""
    got = F.from_json(json, TIERED_PAGES)["pages"]
    out = df.select(*[c for c in df.columns if c != json], F.explode(got).alias("_key", "_page"))
    return out.select(*[c for c in out.columns if c[0] != "_"], F.expr("try_cast(_key as int)").alias("page_num"), "_page.text", "_page.tier").where("page_num is not null")


def write_conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, json) from conv_id, turn, role, text."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return messages.groupBy("conv_id").agg(F.to_json(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))).alias("json"))


def read_conversations(df: DataFrame, json: str) -> DataFrame:
    return df.withColumn("messages", F.coalesce(F.from_json(json, MESSAGES), F.array().cast(MESSAGES))).drop(json)
