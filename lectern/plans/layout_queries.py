"""Queries of the layout operators, over word boxes and rectangles derived from lineitem."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import layout as L
from .base import Queries, table

Q = Queries()

#: A line item is a word, an order a page; positions are arithmetic on its numbers.
_WORDS = """words AS (SELECT l_orderkey AS page_id, l_linenumber AS word_pos, concat('w', l_partkey % 97) AS text, CAST((l_partkey * 37) % 600 AS INT) AS lft, CAST((l_suppkey * 7 + l_linenumber * 5) % 90 AS INT) AS top,
  CAST((l_partkey * 37) % 600 + 20 + l_linenumber % 5 * 8 AS INT) AS rgt FROM lineitem)"""
_CUTS = """ext AS (SELECT page_id, min(lft) AS ml, max(rgt) AS mr FROM words GROUP BY 1),
bins AS (SELECT DISTINCT page_id, unnest(range((lft - ml) // 5, (rgt - ml) // 5 + 1)) AS bin FROM words JOIN ext USING (page_id)),
gaps AS (SELECT page_id, lag(bin) OVER (PARTITION BY page_id ORDER BY bin) + 1 AS a, bin AS b FROM bins),
inner0 AS (SELECT page_id, list(CAST((a + b) // 2 * 5 + ml AS INT) ORDER BY a) FILTER (WHERE a IS NOT NULL AND (b - a) * 5 >= 15) AS cuts FROM gaps JOIN ext USING (page_id) GROUP BY 1),
cuts AS (SELECT page_id, list_concat(list_concat([CAST(ml - 1 AS INT)], coalesce(cuts, [])), [CAST(mr + 1 AS INT)]) AS cuts FROM ext JOIN inner0 USING (page_id))"""
_GROUPS = """cols AS (SELECT w.*, len(list_filter(cuts, lambda b: b <= lft)) - 1 AS col FROM words w JOIN cuts USING (page_id)),
ord AS (SELECT *, row_number() OVER (PARTITION BY page_id, col ORDER BY top, word_pos) AS k FROM cols),
grp AS (SELECT page_id, col, k, word_pos, lft, text, top, top AS anchor, 0 AS g FROM ord WHERE k = 1
  UNION ALL SELECT o.page_id, o.col, o.k, o.word_pos, o.lft, o.text, o.top, CASE WHEN o.top - g.anchor >= 12 THEN o.top ELSE g.anchor END, CASE WHEN o.top - g.anchor >= 12 THEN g.g + 1 ELSE g.g END
  FROM ord o JOIN grp g ON o.page_id = g.page_id AND o.col = g.col AND o.k = g.k + 1)"""


def _listed_words(item: str) -> list[tuple]:
    """Stands in for an OCR engine: a page is a list of its words."""
    return [(w["text"], w["left"], w["top"], w["width"]) for w in json.loads(item)]


def _words(spark, d):
    c = F.col
    left = (c("l_partkey") * 37) % 600
    return table(spark, d, "lineitem").select(
        c("l_orderkey").alias("page_id"), c("l_linenumber").alias("word_pos"), F.concat(F.lit("w"), (c("l_partkey") % 97).cast("string")).alias("text"), left.cast("int").alias("left"),
        ((c("l_suppkey") * 7 + c("l_linenumber") * 5) % 90).cast("int").alias("top"), (left + 20 + c("l_linenumber") % 5 * 8).cast("int").alias("right"),
    )


@Q(f"WITH {_WORDS}, {_CUTS} SELECT page_id, array_to_string(cuts, ',') AS cuts FROM cuts")
def column_gaps(spark, d):
    out = L.page_words(_words(spark, d)).withColumn("cuts", L.boundaries("words"))
    return out.select("page_id", F.array_join(F.transform("cuts", lambda x: x.cast("string")), ",").alias("cuts"))


@Q(f"WITH {_WORDS}, {_CUTS} SELECT page_id, word_pos, CAST(len(list_filter(cuts, lambda b: b <= lft)) - 1 AS INT) AS col FROM words JOIN cuts USING (page_id)")
def column_assign(spark, d):
    pages = L.page_words(_words(spark, d)).withColumn("cuts", L.boundaries("words"))
    ones = pages.select("page_id", F.explode("words").alias("w"), "cuts")
    return ones.select("page_id", F.col("w.word_pos").alias("word_pos"), L.column_of(F.col("w.left"), F.col("cuts")).alias("col"))


@Q(f"WITH RECURSIVE {_WORDS}, {_CUTS}, {_GROUPS} SELECT page_id, word_pos, CAST(col AS INT) AS col, CAST(g AS INT) AS line FROM grp")
def line_groups(spark, d):
    pages = L.page_words(_words(spark, d)).withColumn("cuts", L.boundaries("words"))
    ones = pages.select("page_id", F.explode("words").alias("w"), "cuts").withColumn("col", L.column_of(F.col("w.left"), F.col("cuts")))
    columns = ones.groupBy("page_id", "col").agg(F.collect_list("w").alias("ws"))
    return columns.select("page_id", "col", F.explode(L.line_groups(F.col("ws"), None)).alias("g")).select("page_id", F.col("g.word_pos").alias("word_pos"), "col", F.col("g.group").alias("line"))


@Q(f"""WITH RECURSIVE {_WORDS}, {_CUTS}, {_GROUPS}, ln AS (SELECT page_id, col, g, string_agg(text, ' ' ORDER BY lft, top, word_pos) AS line FROM grp GROUP BY ALL),
cl AS (SELECT page_id, col, concat(string_agg(line, chr(10) ORDER BY g), chr(10)) AS t FROM ln GROUP BY ALL)
SELECT page_id, regexp_replace(string_agg(t, chr(10) ORDER BY col), '^\\s+|\\s+$', '', 'g') AS text, CAST(count(*) AS INT) AS column_count FROM cl GROUP BY 1""")
def reading_order(spark, d):
    return L.reading_order(_words(spark, d))


@Q(f"""WITH RECURSIVE {_WORDS}, {_CUTS}, {_GROUPS}, ln AS (SELECT page_id, col, g, string_agg(text, ' ' ORDER BY lft, top, word_pos) AS line FROM grp GROUP BY ALL),
cl AS (SELECT page_id, col, concat(string_agg(line, chr(10) ORDER BY g), chr(10)) AS t FROM ln GROUP BY ALL)
SELECT page_id, regexp_replace(string_agg(t, chr(10) ORDER BY col), '^\\s+|\\s+$', '', 'g') AS text, CAST(count(*) AS INT) AS column_count FROM cl GROUP BY 1""")
def ocr_reading_order(spark, d):
    """reading_order of words that an extractor gives for each page."""
    word = F.struct("text", "left", "top", (F.col("right") - F.col("left")).alias("width"))
    pages = _words(spark, d).groupBy("page_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("word_pos", word.alias("w")))), lambda x: x["w"])).alias("item"))
    return L.ocr(pages, _listed_words).select("page_id", F.col("ocr_text").alias("text"), F.col("n_columns").alias("column_count"))


@Q("""WITH RECURSIVE v AS (SELECT l_orderkey AS page_id, CAST((l_partkey * 13) % 120 AS DOUBLE) AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_partkey * 13) % 120, l_linenumber) AS k FROM lineitem),
c AS (SELECT page_id, k, x AS s, 1.0::DOUBLE AS n, 0 AS g FROM v WHERE k = 1
  UNION ALL SELECT v.page_id, v.k, CASE WHEN abs(v.x - c.s / c.n) <= 12 THEN c.s + v.x ELSE v.x END, CASE WHEN abs(v.x - c.s / c.n) <= 12 THEN c.n + 1 ELSE 1 END, CASE WHEN abs(v.x - c.s / c.n) <= 12 THEN c.g ELSE c.g + 1 END FROM v JOIN c ON v.page_id = c.page_id AND v.k = c.k + 1)
SELECT page_id, CAST(g AS INT) AS cluster, round(arg_max(s / n, k), 6) AS mean FROM c GROUP BY page_id, g""")
def coordinate_clusters(spark, d):
    values = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.collect_list((F.col("l_partkey") * 13) % 120).alias("v"))
    return values.select("page_id", F.posexplode(L.clusters(F.col("v"))).alias("cluster", "mean")).withColumn("mean", F.round("mean", 6))


#: The rectangles that stay, one after the other.
KEPT_SQL = """WITH RECURSIVE r AS (SELECT l_orderkey AS page_id, l_linenumber AS pos, l_linenumber % 2 = 0 AS block, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, (l_partkey * 3) % 40, (l_suppkey * 3) % 40) AS n,
  CAST((l_partkey * 3) % 40 AS DOUBLE) AS x, CAST((l_suppkey * 3) % 40 AS DOUBLE) AS y, 200.0 AS w, 150.0 AS h FROM lineitem),
f AS (SELECT page_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(pos BIGINT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[]) AS kept FROM r GROUP BY page_id
  UNION ALL
  SELECT f.page_id, r.n, CASE WHEN block AND len(list_filter(kept, lambda k: greatest(least(k.x, r.x) + 200 - greatest(k.x, r.x), 0) * greatest(least(k.y, r.y) + 150 - greatest(k.y, r.y), 0) > 0.9 * 30000)) > 0
    THEN kept ELSE list_append(kept, {'pos': CAST(r.pos AS BIGINT), 'x': r.x, 'y': r.y, 'w': CAST(r.w AS DOUBLE), 'h': CAST(r.h AS DOUBLE)}) END
  FROM f JOIN r ON r.page_id = f.page_id AND r.n = f.n + 1),
e AS (SELECT page_id, arg_max(kept, n) AS kept FROM f GROUP BY page_id)"""


def image_rects(spark, d):
    c = F.col
    x, y = ((c("l_partkey") * 3) % 40).cast("double"), ((c("l_suppkey") * 3) % 40).cast("double")
    origin = F.when(c("l_linenumber") % 2 == 0, "text_dict").otherwise("get_images")
    return table(spark, d, "lineitem").select(c("l_orderkey").alias("page_id"), c("l_linenumber").alias("pos"), origin.alias("origin"), x.alias("x0"), y.alias("y0"), (x + 200).alias("x1"), (y + 150).alias("y1"))


@Q(KEPT_SQL + " SELECT page_id, CAST(unnest(kept).pos AS INT) AS pos FROM e")
def image_dedupe(spark, d):
    """An order-dependent fold."""
    return L.distinct_images(image_rects(spark, d))
