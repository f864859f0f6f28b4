"""Queries of the page audit, over features derived from documents, part and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from . import layout_queries
from .base import Queries, table, texts

Q = Queries()

_INFO = r"""ls AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
info AS (SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS char_count, len(l) AS line_count, len(list_filter(l, lambda x: length(x) <= 35)) AS short_line_count,
  CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: length(x) <= 35)) / len(l)::DOUBLE ELSE 0.0 END AS short_line_ratio,
  CASE WHEN len(l) > 0 THEN list_sum(list_transform(l, lambda x: length(x))) / len(l)::DOUBLE ELSE 0.0 END AS avg_line_length,
  len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')) AS block_count FROM ls)"""
#: Page features as arithmetic on part keys, so that every class that rules can reach occurs.
_FEATURES = """feat AS (SELECT p_partkey AS page_id, CAST(CASE p_partkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 60 ELSE p_size * 37 END AS INT) AS char_count, CAST(p_partkey % 12 AS INT) AS block_count,
  CAST(p_partkey % 15 AS INT) AS line_count, (p_partkey % 10) / 10.0::DOUBLE AS short_line_ratio, CAST(p_partkey % 11 AS INT) AS x_columns, CAST(p_partkey % 13 AS INT) AS y_rows,
  CAST(CASE WHEN p_partkey % 5 < 3 THEN 0 ELSE p_partkey % 3 END AS INT) AS image_count, CASE WHEN p_partkey % 5 < 3 OR p_partkey % 3 = 0 THEN 0.0::DOUBLE ELSE (p_partkey % 17) / 20.0::DOUBLE END AS largest_image_ratio,
  CASE WHEN p_partkey % 5 < 3 OR p_partkey % 3 = 0 THEN 0.0::DOUBLE ELSE (p_partkey % 17) / 16.0::DOUBLE END AS total_image_ratio, CAST(p_partkey % 53 AS INT) AS drawing_count, CAST(p_partkey % 5 AS INT) AS horizontal_lines,
  CAST(p_partkey % 4 AS INT) AS vertical_lines, CAST(p_partkey % 14 AS INT) AS rectangles, CAST(p_partkey % 10 AS INT) AS filled_shapes, CAST(CASE WHEN p_partkey % 6 = 0 THEN p_partkey % 2 + 1 ELSE 0 END AS INT) AS total_tables FROM part)"""
_SCORES = """cls AS (SELECT *, CASE WHEN image_count = 0 THEN NULL WHEN char_count >= 20 AND x_columns >= 4 AND y_rows >= 3 THEN 'IMAGE_FLOW_CANDIDATE'
    WHEN char_count >= 20 AND (largest_image_ratio >= 0.15 OR (largest_image_ratio >= 0.3 AND block_count >= 5)) THEN 'IMAGE_CONTENT'
    WHEN char_count < 20 AND largest_image_ratio >= 0.55 THEN 'OCR' WHEN largest_image_ratio >= 0.15 THEN 'IMAGE_CONTENT' END AS image_class FROM feat),
sc AS (SELECT *,
  CAST(least(100, CASE WHEN total_tables > 0 THEN 70 ELSE 0 END + CASE WHEN horizontal_lines + vertical_lines >= 6 THEN 20 WHEN horizontal_lines + vertical_lines >= 3 THEN 10 ELSE 0 END
    + CASE WHEN rectangles >= 10 THEN 15 WHEN rectangles >= 5 THEN 8 ELSE 0 END + CASE WHEN line_count >= 8 AND short_line_ratio >= 0.55 THEN 10 ELSE 0 END) AS INT) AS table_score,
  CAST(least(100, CASE WHEN x_columns >= 8 THEN 30 WHEN x_columns >= 6 THEN 25 WHEN x_columns >= 4 THEN 15 ELSE 0 END + CASE WHEN y_rows >= 10 THEN 25 WHEN y_rows >= 6 THEN 20 WHEN y_rows >= 3 THEN 10 ELSE 0 END
    + CASE WHEN block_count >= 8 THEN 10 ELSE 0 END + CASE WHEN drawing_count >= 40 THEN 30 WHEN drawing_count >= 20 THEN 20 WHEN drawing_count >= 10 THEN 10 ELSE 0 END + CASE WHEN filled_shapes >= 8 THEN 15 ELSE 0 END) AS INT) AS flow_table_score,
  CAST(least(100, CASE WHEN image_count > 0 THEN 30 ELSE 0 END + CASE WHEN largest_image_ratio >= 0.55 THEN 40 WHEN largest_image_ratio >= 0.3 THEN 30 WHEN largest_image_ratio >= 0.15 THEN 20 ELSE 0 END
    + CASE WHEN total_image_ratio >= 0.6 THEN 20 WHEN total_image_ratio >= 0.3 THEN 10 ELSE 0 END) AS INT) AS image_score,
  CAST(least(100, CASE WHEN char_count < 20 THEN 60 WHEN char_count < 100 THEN 20 ELSE 0 END + CASE WHEN image_count > 0 THEN 20 ELSE 0 END + CASE WHEN largest_image_ratio >= 0.55 THEN 30 ELSE 0 END) AS INT) AS ocr_score,
  CAST(least(100, CASE WHEN largest_image_ratio >= 0.55 THEN 40 WHEN largest_image_ratio >= 0.3 THEN 25 ELSE 0 END + CASE WHEN drawing_count >= 40 THEN 30 WHEN drawing_count >= 20 THEN 20 ELSE 0 END
    + CASE WHEN image_class IN ('IMAGE_CONTENT', 'IMAGE_FLOW_CANDIDATE') THEN 20 ELSE 0 END) AS INT) AS vision_score FROM cls),
fin AS (SELECT *, CASE WHEN image_class IN ('IMAGE_CONTENT', 'IMAGE_FLOW_CANDIDATE') THEN image_class WHEN ocr_score >= 70 AND char_count < 20 THEN 'OCR' WHEN flow_table_score >= 60 THEN 'FLOW_TABLE'
  WHEN table_score >= 60 THEN 'TABLE' WHEN vision_score >= 70 THEN 'VISION' WHEN greatest(table_score, flow_table_score, ocr_score, vision_score) >= 40 THEN 'REVIEW' ELSE 'NORMAL' END AS classification FROM sc)"""


def _features(spark, d):
    k = F.col("p_partkey")
    i = lambda x: x.cast("int")
    none = (k % 5 < 3) | (k % 3 == 0)
    return table(spark, d, "part").select(
        k.alias("page_id"), i(F.when(k % 4 == 0, 5).when(k % 4 == 1, 60).otherwise(F.col("p_size") * 37)).alias("char_count"), i(k % 12).alias("block_count"), i(k % 15).alias("line_count"), ((k % 10) / 10.0).alias("short_line_ratio"),
        i(k % 11).alias("x_columns"), i(k % 13).alias("y_rows"), i(F.when(k % 5 < 3, 0).otherwise(k % 3)).alias("image_count"), F.when(none, 0.0).otherwise((k % 17) / 20.0).alias("largest_image_ratio"),
        F.when(none, 0.0).otherwise((k % 17) / 16.0).alias("total_image_ratio"), i(k % 53).alias("drawing_count"), i(k % 5).alias("horizontal_lines"), i(k % 4).alias("vertical_lines"), i(k % 14).alias("rectangles"), i(k % 10).alias("filled_shapes"),
        i(F.when(k % 6 == 0, k % 2 + 1).otherwise(0)).alias("total_tables"),
    )


@Q(f"WITH {_INFO} SELECT doc_id, char_count, line_count, short_line_count, round(short_line_ratio, 6) AS short_line_ratio, round(avg_line_length, 6) AS avg_line_length, block_count FROM info")
def audit_text_stats(spark, d):
    out = A.text_info(texts(spark, d))
    counts = [F.col(c).cast("long").alias(c) for c in ("char_count", "line_count", "short_line_count", "block_count")]
    return out.select("doc_id", *counts, F.round("short_line_ratio", 6).alias("short_line_ratio"), F.round("avg_line_length", 6).alias("avg_line_length"))


@Q("""WITH s AS (SELECT l_orderkey AS page_id, l_quantity AS w, CAST(CASE l_partkey % 4 WHEN 0 THEN l_partkey % 4 ELSE l_suppkey % 60 END AS DOUBLE) AS h, l_returnflag = 'R' AS filled FROM lineitem)
SELECT page_id, count(*) AS drawing_count, count(*) FILTER (WHERE w > 20 AND h <= 3) AS horizontal_lines, count(*) FILTER (WHERE h > 20 AND w <= 3) AS vertical_lines,
  count(*) FILTER (WHERE w > 10 AND h > 10) AS rectangles, count(*) FILTER (WHERE filled) AS filled_shapes FROM s GROUP BY 1""")
def audit_drawings(spark, d):
    height = F.when(F.col("l_partkey") % 4 == 0, F.col("l_partkey") % 4).otherwise(F.col("l_suppkey") % 60).cast("double")
    shapes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_quantity").alias("width"), height.alias("height"), (F.col("l_returnflag") == "R").alias("has_fill"))
    return A.drawing_info(shapes)


@Q("""SELECT l_orderkey AS page_id, count(*) AS image_count, round(max(l_quantity * l_linenumber / 1000.0), 6) AS largest_image_ratio, round(sum(l_quantity * l_linenumber / 1000.0), 6) AS total_image_ratio FROM lineitem WHERE l_quantity * l_linenumber > 0 GROUP BY 1""")
def audit_images(spark, d):
    zero = F.lit(0.0)
    rects = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), zero.alias("x0"), zero.alias("y0"), F.col("l_quantity").alias("x1"), F.col("l_linenumber").cast("double").alias("y1"))
    out = A.image_info(rects, F.lit(1000.0))
    return out.select("page_id", "image_count", *[F.round(c, 6).alias(c) for c in ("largest_image_ratio", "total_image_ratio")])


@Q(layout_queries.KEPT_SQL + """ SELECT page_id, count(*) AS image_count, round(max(w * h / 90000.0), 6) AS largest_image_ratio, round(sum(w * h / 90000.0), 6) AS total_image_ratio
FROM (SELECT page_id, unnest(kept).w AS w, unnest(kept).h AS h FROM e) GROUP BY 1""")
def audit_image_twins(spark, d):
    """Images of both lists of a page, twins counted once."""
    out = A.image_blocks(layout_queries.image_rects(spark, d), F.lit(90000.0))
    return out.select("page_id", "image_count", *[F.round(c, 6).alias(c) for c in ("largest_image_ratio", "total_image_ratio")])


@Q(f"WITH {_FEATURES}, {_SCORES} SELECT page_id, table_score, flow_table_score, image_score, ocr_score, vision_score, image_class FROM fin")
def audit_scores(spark, d):
    return A.audit(_features(spark, d)).select("page_id", "table_score", "flow_table_score", "image_score", "ocr_score", "vision_score", "image_class")


@Q(f"""WITH {_FEATURES}, {_SCORES} SELECT page_id, array_to_string(list_filter([
  CASE WHEN total_tables > 0 THEN concat('native PDF table detected (', total_tables, ')') END,
  CASE WHEN horizontal_lines + vertical_lines >= 6 THEN concat('table-like lines (', horizontal_lines + vertical_lines, ')') WHEN horizontal_lines + vertical_lines >= 3 THEN concat('some table-like lines (', horizontal_lines + vertical_lines, ')') END,
  CASE WHEN rectangles >= 10 THEN concat('many rectangles (', rectangles, ')') WHEN rectangles >= 5 THEN concat('multiple rectangles (', rectangles, ')') END,
  CASE WHEN line_count >= 8 AND short_line_ratio >= 0.55 THEN 'short structured text' END], lambda x: x IS NOT NULL), '; ') AS table_reasons,
 array_to_string(list_filter([CASE WHEN char_count < 20 THEN 'little/no native text' WHEN char_count < 100 THEN 'very little native text' END, CASE WHEN image_count > 0 THEN 'image content present' END,
  CASE WHEN largest_image_ratio >= 0.55 THEN 'very large image' END], lambda x: x IS NOT NULL), '; ') AS ocr_reasons FROM fin""")
def audit_reasons(spark, d):
    return A.audit(_features(spark, d)).select("page_id", F.array_join("table_reasons", "; ").alias("table_reasons"), F.array_join("ocr_reasons", "; ").alias("ocr_reasons"))


@Q(f"WITH {_FEATURES}, {_SCORES} SELECT page_id, classification FROM fin")
def audit_classify(spark, d):
    return A.audit(_features(spark, d)).select("page_id", "classification")


@Q(f"""WITH {_FEATURES}, {_SCORES}, cats AS (SELECT unnest(range(8)) AS ordinal, unnest(['NORMAL', 'TABLE', 'FLOW_TABLE', 'IMAGE_CONTENT', 'IMAGE_FLOW_CANDIDATE', 'OCR', 'VISION', 'REVIEW']) AS category)
SELECT CAST(ordinal AS INT) AS ordinal, category, count(classification) AS pages FROM cats LEFT JOIN fin ON category = classification GROUP BY ALL""")
def audit_summary(spark, d):
    return A.summary(A.audit(_features(spark, d))).select("ordinal", "category", "pages")


@Q(f"WITH {_FEATURES}, {_SCORES} SELECT classification, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) AS page_list FROM fin WHERE classification <> 'NORMAL' GROUP BY 1")
def audit_page_lists(spark, d):
    got = A.audit(_features(spark, d)).where("classification <> 'NORMAL'").groupBy("classification").agg(F.array_sort(F.collect_list("page_id")).alias("l"))
    return got.select("classification", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("page_list"))


@Q("SELECT l_orderkey AS page_id, sum(l_quantity * l_linenumber) / 1000.0 >= 0.15 AS significant FROM lineitem GROUP BY 1")
def significant_image(spark, d):
    got = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.sum(F.col("l_quantity") * F.col("l_linenumber")).alias("area"))
    return got.select("page_id", A.significant(F.col("area"), F.lit(1000.0)).alias("significant"))


@Q(f"""WITH {_FEATURES} SELECT page_id, CAST(CASE WHEN NOT (total_image_ratio >= 0.15) AND char_count >= 20 THEN 1 WHEN (total_image_ratio >= 0.15 OR x_columns >= 2) AND page_id % 3 <> 0 THEN 3 ELSE 2 END AS INT) AS tier FROM feat""")
def auto_tier(spark, d):
    f = _features(spark, d)
    return f.select("page_id", A.auto_tier(F.col("char_count"), F.col("total_image_ratio") >= 0.15, F.col("x_columns"), F.col("page_id") % 3 != 0).alias("tier"))


@Q("SELECT p_partkey AS page_id, CASE WHEN p_size >= 8 THEN 40 WHEN p_size >= 6 THEN 30 WHEN p_size >= 4 THEN 20 ELSE 0 END AS column_score, CASE WHEN p_size >= 10 THEN 40 WHEN p_size >= 6 THEN 30 WHEN p_size >= 3 THEN 20 ELSE 0 END AS row_score FROM part")
def spatial_scores(spark, d):
    n = F.col("p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), A.structure_score(n, (8, 6, 4)).alias("column_score"), A.structure_score(n, (10, 6, 3)).alias("row_score"))


@Q("SELECT p_partkey AS page_id, printf('%.1f%%', p_size / 64.0 * 100) AS pct FROM part")
def percent_format(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), T.percentage(F.col("p_size") / 64.0).alias("pct"))


@Q("SELECT p_partkey AS page_id, CAST(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE greatest(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size % 4 END, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size % 3 END) END AS INT) AS total_tables FROM part")
def native_tables(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    pages = table(spark, d, "part").select(k.alias("page_id"), (k % 5 != 0).alias("supported"), F.when(k % 3 != 0, n % 4).cast("int").alias("lines_tables"), F.when(k % 7 != 0, n % 3).cast("int").alias("text_tables"))
    return A.native_tables(pages).select("page_id", "total_tables")


_ADVICE = ", ".join("'" + x.replace("'", "''") + "'" for x in A.RECOMMENDATIONS)
_CATEGORIES = ", ".join(f"'{x}'" for x in A.CATEGORIES)


@Q(f"""WITH {_FEATURES}, {_SCORES}, cats AS (SELECT unnest([{_CATEGORIES}]) AS category, unnest([{_ADVICE}]) AS advice),
n AS (SELECT category, advice, count(classification) AS pages FROM cats LEFT JOIN fin ON category = classification GROUP BY ALL)
SELECT '1 summary' AS section, 'pages' AS item, CAST(count(*) AS VARCHAR) AS value FROM fin UNION ALL SELECT '2 classes', category, CAST(pages AS VARCHAR) FROM n
UNION ALL SELECT '3 images', 'pages with images', CAST(count(*) FILTER (WHERE image_count > 0) AS VARCHAR) FROM fin
UNION ALL SELECT '4 pages', classification, string_agg(CAST(page_id AS VARCHAR), ', ' ORDER BY page_id) FROM fin WHERE classification <> 'NORMAL' GROUP BY classification
UNION ALL SELECT '5 advice', category, advice FROM n WHERE pages > 0""")
def audit_report(spark, d):
    return A.report(A.audit(_features(spark, d)))
