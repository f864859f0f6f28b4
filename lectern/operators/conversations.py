"""Conversations: windows of turns, follow-up rewriting, titles, retention, prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values.
HISTORY_TURNS, MAX_CONVERSATIONS = 3, 20
#: What a model says that finds no answer.
REFUSAL, REFUSAL_MIN_SCORE = "i don't know based on the provided sources", 0.5


def dialogue(messages: DataFrame) -> DataFrame:
    """Messages of users and assistants only, as they are stored."""
    return messages.where(F.col("role").isin("user", "assistant"))


def history(messages: DataFrame, turns: int = HISTORY_TURNS) -> DataFrame:
    """messages with history: the last 2 * turns messages before each, oldest first."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2 * turns, -1)
    return messages.withColumn("history", F.collect_list(F.struct("role", F.col("text").alias("content"))).over(before))


def rewrite(messages: DataFrame, turns: int = HISTORY_TURNS) -> DataFrame:
    """Questions with search_query: a follow-up gets the last question of its history before it."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2 * turns, -1)
    prior = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before)
    asked = messages.withColumn("prior_question", prior).where(F.col("role") == "user")
    follow = T.is_followup("text") & F.col("prior_question").isNotNull()
    return asked.withColumn("search_query", F.when(follow, F.concat("prior_question", F.lit("\n"), "text")).otherwise(F.col("text")))


def titles(messages: DataFrame) -> DataFrame:
    """(conv_id, title): the first question, cut; New chat where there is none or it is blank."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(first.alias("_q")).select("conv_id", F.coalesce(F.nullif(T.conversation_title("_q"), F.lit("")), F.lit("New chat")).alias("title"))


def retained(conversations: DataFrame, limit: int = MAX_CONVERSATIONS, order: str = "created_seq") -> DataFrame:
    """The last conversations by insertion; a global top-k, which Spark cuts in every partition first."""
    return conversations.orderBy(F.col(order).desc()).limit(limit)


def prompts(results: DataFrame, header: str = "Context excerpts:", before: str = "Question: ", after: str = "Use these excerpts alone.") -> DataFrame:
    """(query_id, prompt) from query_id, question, rank, title, text: header, numbered excerpts, question, closing line."""
    part = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(": "), "title", F.lit("]\n"), "text")
    got = results.groupBy("query_id").agg(F.first("question").alias("question"), F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))).alias("parts"))
    context = F.array_join(F.transform("parts", lambda x: x["p"]), "\n\n---\n\n")
    return got.select("query_id", F.concat(F.lit(header + "\n\n"), context, F.lit("\n\n---\n\n" + before), "question", F.lit("\n\n" + after)).alias("prompt"))


def message_list(history_: str, prompt: str, system: str):
    """Column: system message, history, then the prompt."""
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.concat(F.array(one("system", F.lit(system))), F.col(history_), F.array(one("user", F.col(prompt))))


def needs_retry(answer, top_score):
    return F.lower(answer).contains(REFUSAL) & top_score.isNotNull() & (top_score >= REFUSAL_MIN_SCORE)


def answer(requests: DataFrame, ask: Callable[[list[dict]], str]) -> DataFrame:
    """requests (query_id, messages, top_score) with answer and calls: ask(messages) is called, and once more where it refuses although there is a source.

    The second answer counts, whatever it is. messages is an array of (role, content); ask gets it as a list of
    dicts. Rows with null messages have no call and a null answer. Written results are read again without
    a call; the column alone calls whenever it is computed.
    """

    @F.pandas_udf("answer string, calls int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for messages, scores in batches:
            rows = []
            for some, score in zip(messages, scores, strict=True):
                if some is None:
                    rows.append((None, 0))
                    continue
                some = [dict(m) for m in some]
                text, calls = ask(some) or "", 1
                if REFUSAL in text.lower() and score is not None and score >= REFUSAL_MIN_SCORE:
                    text, calls = ask(some) or "", 2
                rows.append((text, calls))
            yield pd.DataFrame(rows, columns=["answer", "calls"])

    out = requests.withColumn("_a", run.asNondeterministic()("messages", "top_score"))
    return out.select(*requests.columns, "_a.answer", "_a.calls")
