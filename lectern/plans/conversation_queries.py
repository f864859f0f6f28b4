"""Queries of the conversation operators, over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import conversations as C
from .base import Queries, table

Q = Queries()
_D = "d AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant'))"
_FOLLOW = r"""(len(list_filter(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+'), lambda x: x <> '')) <= 6
  OR coalesce(lower(regexp_replace(list_filter(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+'), lambda x: x <> '')[1], '^[?.,!]+|[?.,!]+$', '', 'g')) IN ('it', 'that', 'this', 'next', 'then', 'also', 'too', 'again', 'and'), false))"""


def _dialogue(spark, d):
    return C.dialogue(table(spark, d, "conversations"))


@Q(f"""WITH {_D} SELECT conv_id, turn, coalesce(string_agg(h.role || ': ' || h.text, chr(10) ORDER BY h.turn), '') AS history FROM (
  SELECT a.conv_id, a.turn, b.role, b.text, b.turn AS bt, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn DESC) AS k FROM d a LEFT JOIN d b ON a.conv_id = b.conv_id AND b.turn < a.turn) AS h0
  , LATERAL (SELECT h0.role, h0.text, h0.bt AS turn) h WHERE k <= 6 GROUP BY conv_id, h0.turn""".replace("conv_id, turn, coalesce", "h0.conv_id, h0.turn, coalesce").replace("GROUP BY conv_id,", "GROUP BY h0.conv_id,"))
def history_window(spark, d):
    joined = F.array_join(F.transform("history", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")
    return C.history(_dialogue(spark, d)).select("conv_id", "turn", joined.alias("history"))


@Q(f"""WITH {_D}, w AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS prior FROM d)
SELECT conv_id, turn, CASE WHEN {_FOLLOW} AND prior IS NOT NULL THEN concat(prior, chr(10), text) ELSE text END AS search_query FROM w WHERE role = 'user'""")
def followup_rewrite(spark, d):
    return C.rewrite(_dialogue(spark, d)).select("conv_id", "turn", "search_query")


@Q(rf"""WITH {_D}, f AS (SELECT conv_id, arg_min(regexp_replace(text, '^\s+|\s+$', '', 'g'), turn) FILTER (WHERE role = 'user') AS q FROM d GROUP BY conv_id)
SELECT conv_id, coalesce(nullif(CASE WHEN length(q) > 45 THEN concat(substr(q, 1, 45), '…') ELSE q END, ''), 'New chat') AS title FROM f""")
def conversation_titles(spark, d):
    return C.titles(_dialogue(spark, d))


@Q(f"WITH {_D} SELECT DISTINCT conv_id FROM d ORDER BY conv_id DESC LIMIT 20")
def retention_cap(spark, d):
    return C.retained(_dialogue(spark, d).select("conv_id").distinct(), order="conv_id")


@Q(f"WITH {_D} SELECT conv_id, string_agg(concat(role, '=', text), '|' ORDER BY turn) AS messages FROM d GROUP BY conv_id")
def conversation_json(spark, d):
    """Messages written as JSON and read again."""
    from ..sources.checkpoints import read_conversations, write_conversations

    back = read_conversations(write_conversations(_dialogue(spark, d)), "json")
    out = back.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|").alias("messages"))
    return out


@Q(f"WITH {_D} SELECT conv_id, turn, {_FOLLOW} AS incomplete FROM d WHERE role = 'user'")
def followup_predicate(spark, d):
    return _dialogue(spark, d).where("role = 'user'").select("conv_id", "turn", T.is_followup("text").alias("incomplete"))


@Q("SELECT conv_id, turn, contains(lower(concat(text, CASE WHEN turn % 2 = 0 THEN ' I don''t know based on the provided sources.' ELSE '' END)), 'i don''t know based on the provided sources') AND (conv_id % 10) / 10.0 >= 0.5 AS retry FROM conversations WHERE role = 'assistant'")
def refusal_retry(spark, d):
    answer = F.concat("text", F.when(F.col("turn") % 2 == 0, F.lit(" I don't know based on the provided sources.")).otherwise(F.lit("")))
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", C.needs_retry(answer, (F.col("conv_id") % 10) / 10.0).alias("retry"))


@Q(f"WITH {_D}, q AS (SELECT conv_id, max(turn) AS t FROM d WHERE role = 'user' GROUP BY 1) SELECT d.conv_id, least(count(*) FILTER (WHERE d.turn < q.t), 6) + 2 AS n_messages FROM d JOIN q USING (conv_id) GROUP BY d.conv_id")
def message_lists(spark, d):
    asked = C.history(_dialogue(spark, d)).where("role = 'user'")
    last = asked.groupBy("conv_id").agg(F.max_by(F.struct("history", "text"), "turn").alias("m")).select("conv_id", "m.*")
    return last.select("conv_id", F.size(C.message_list("history", "text", "Answer from the sources.")).cast("long").alias("n_messages"))


def _reply(messages):
    """Stands in for a hosted model: it does not know what has a length divisible by three."""
    text = messages[-1]["content"]
    return "Sorry: I don't know based on the provided sources." if len(text) % 3 == 0 else f"{len(text)} characters"


@Q("""SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN 'Sorry: I don''t know based on the provided sources.' ELSE concat(length(text), ' characters') END AS answer,
  CASE WHEN length(text) % 3 = 0 AND (conv_id % 10) / 10.0 >= 0.5 THEN 2 ELSE 1 END AS calls FROM conversations WHERE role = 'user' AND text IS NOT NULL""")
def answers_with_retry(spark, d):
    asked = table(spark, d, "conversations").where("role = 'user' and text is not null")
    messages = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    return C.answer(asked.select("conv_id", "turn", messages.alias("messages"), ((F.col("conv_id") % 10) / 10.0).alias("top_score")), _reply).select("conv_id", "turn", "answer", "calls")
