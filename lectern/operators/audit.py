"""Page audit: statistics of text, images and drawings, rule scores, classes, summary.

A page is a row; all rules are column expressions of counts, so an audit is one narrow pass over
the counts, and only the summary groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import layout

# Fixed values.
CATEGORIES = ("NORMAL", "TABLE", "FLOW_TABLE", "IMAGE_CONTENT", "IMAGE_FLOW_CANDIDATE", "OCR", "VISION", "REVIEW")
RECOMMENDATIONS = (
    "Native text extraction", "Table-aware extraction", "Preserve spatial structure", "Inspect image content",
    "Treat image as important visual content; OCR/Vision or image-aware extraction", "Local Tesseract OCR", "Visual/Vision processing", "Manual inspection",
)
CONTENT_RATIO, LARGE_RATIO, VERY_LARGE_RATIO = 0.15, 0.30, 0.55
TABLE_LIMIT, FLOW_LIMIT, OCR_LIMIT, VISION_LIMIT, REVIEW_LIMIT = 60, 60, 70, 70, 40
COORDINATE_TOLERANCE = 12.0


def text_info(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with char_count, line_count, short_line_count, short_line_ratio, avg_line_length, block_count."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), T.strip), lambda x: x != "")
    out = docs.withColumn("_lines", lines).withColumn("char_count", F.length(T.strip(text))).withColumn("line_count", F.size("_lines"))
    out = out.withColumn("short_line_count", F.size(F.filter("_lines", lambda x: F.length(x) <= T.SHORT_LINE_CHARS)))
    total = F.aggregate("_lines", F.lit(0), lambda s, x: s + F.length(x))
    some = F.col("line_count") > 0
    out = out.withColumn("short_line_ratio", F.when(some, F.col("short_line_count") / F.col("line_count")).otherwise(0.0))
    out = out.withColumn("avg_line_length", F.when(some, total / F.col("line_count")).otherwise(0.0))
    return out.withColumn("block_count", F.size(F.filter(F.split(F.col(text), "\n\\s*\n"), lambda x: T.strip(x) != ""))).drop("_lines")


def image_info(rects: DataFrame, page_area: Column) -> DataFrame:
    """(page_id, image_count, largest_image_ratio, total_image_ratio) from page_id, x0, y0, x1, y1."""
    area = F.abs((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    ratio = F.when(page_area > 0, area / page_area).otherwise(0.0)
    return rects.where(area > 0).groupBy("page_id").agg(F.count("*").alias("image_count"), F.max(ratio).alias("largest_image_ratio"), F.sum(ratio).alias("total_image_ratio"))


def image_blocks(rects: DataFrame, page_area: Column) -> DataFrame:
    """image_info of both lists of a page's images (page_id, pos, origin and corners), without twins.

    An image block of the text layer that a listed image covers is the same image and counts once.
    """
    return image_info(layout.kept_images(rects), page_area)


def drawing_info(drawings: DataFrame) -> DataFrame:
    """(page_id, counts) from page_id, width, height, has_fill; shapes without a rectangle count in the total."""
    w, h = F.col("width"), F.col("height")
    return drawings.groupBy("page_id").agg(
        F.count("*").alias("drawing_count"), F.count_if((w > 20) & (h <= 3)).alias("horizontal_lines"), F.count_if((h > 20) & (w <= 3)).alias("vertical_lines"),
        F.count_if((w > 10) & (h > 10)).alias("rectangles"), F.count_if(F.col("has_fill")).alias("filled_shapes"),
    )


class Rules:
    """Points of the first rule that holds in each group, with their reasons."""

    def __init__(self):
        self.points: list[Column] = []
        self.reasons: list[Column] = []

    def first_of(self, *rules: tuple[Column, int, Column | str | None]) -> Rules:
        points, reason = None, None
        for holds, n, why in rules:
            why = F.lit(why) if isinstance(why, str) or why is None else why
            points = F.when(holds, n) if points is None else points.when(holds, n)
            reason = F.when(holds, why) if reason is None else reason.when(holds, why)
        self.points.append(points.otherwise(0))
        self.reasons.append(reason)
        return self

    def score(self) -> Column:
        return F.least(F.lit(100), sum(self.points[1:], self.points[0]))

    def why(self) -> Column:
        return F.array_compact(F.array(*[r.cast("string") for r in self.reasons]))


def _n(label: str, value: Column) -> Column:
    return F.concat(F.lit(label + " ("), value.cast("string"), F.lit(")"))


# Points, limits and the wording of reasons in the rules below.


def table_rules() -> Rules:
    c = F.col
    lines = c("horizontal_lines") + c("vertical_lines")
    return (
        Rules()
        .first_of((c("total_tables") > 0, 70, _n("native PDF table detected", c("total_tables"))))
        .first_of((lines >= 6, 20, _n("table-like lines", lines)), (lines >= 3, 10, _n("some table-like lines", lines)))
        .first_of((c("rectangles") >= 10, 15, _n("many rectangles", c("rectangles"))), (c("rectangles") >= 5, 8, _n("multiple rectangles", c("rectangles"))))
        .first_of(((c("line_count") >= 8) & (c("short_line_ratio") >= 0.55), 10, "short structured text"))
    )


def flow_rules() -> Rules:
    c = F.col
    x, y, d = c("x_columns"), c("y_rows"), c("drawing_count")
    return (
        Rules()
        .first_of((x >= 8, 30, _n("many aligned columns", x)), (x >= 6, 25, _n("multiple aligned columns", x)), (x >= 4, 15, _n("multiple aligned columns", x)))
        .first_of((y >= 10, 25, _n("many aligned rows", y)), (y >= 6, 20, _n("multiple aligned rows", y)), (y >= 3, 10, _n("multiple aligned rows", y)))
        .first_of((c("block_count") >= 8, 10, _n("many text blocks", c("block_count"))))
        .first_of((d >= 40, 30, _n("many vector shapes", d)), (d >= 20, 20, _n("many vector shapes", d)), (d >= 10, 10, _n("multiple vector shapes", d)))
        .first_of((c("filled_shapes") >= 8, 15, _n("filled visual shapes", c("filled_shapes"))))
    )


def image_rules() -> Rules:
    c = F.col
    big, total = c("largest_image_ratio"), c("total_image_ratio")
    pct = lambda label, v: F.concat(F.lit(label + " ("), T.percentage(v), F.lit(")"))
    return (
        Rules()
        .first_of((c("image_count") > 0, 30, _n("image block detected", c("image_count"))))
        .first_of((big >= VERY_LARGE_RATIO, 40, pct("very large image", big)), (big >= LARGE_RATIO, 30, pct("large image", big)), (big >= CONTENT_RATIO, 20, pct("significant image", big)))
        .first_of((total >= 0.60, 20, F.concat(F.lit("image content covers "), T.percentage(total), F.lit(" of page"))), (total >= 0.30, 10, F.concat(F.lit("multiple image content ("), T.percentage(total), F.lit(" page)"))))
        .first_of((c("char_count") >= 100, 0, "native text also exists"))
    )


def ocr_rules() -> Rules:
    c = F.col
    return (
        Rules()
        .first_of((c("char_count") < T.MIN_NATIVE_CHARS, 60, "little/no native text"), (c("char_count") < 100, 20, "very little native text"))
        .first_of((c("image_count") > 0, 20, "image content present"))
        .first_of((c("largest_image_ratio") >= VERY_LARGE_RATIO, 30, "very large image"))
    )


def vision_rules() -> Rules:
    c = F.col
    return (
        Rules()
        .first_of((c("largest_image_ratio") >= VERY_LARGE_RATIO, 40, "very large visual content"), (c("largest_image_ratio") >= LARGE_RATIO, 25, "large visual content"))
        .first_of((c("drawing_count") >= 40, 30, "many vector drawings"), (c("drawing_count") >= 20, 20, "many vector drawings"))
        .first_of((c("image_class").isin("IMAGE_CONTENT", "IMAGE_FLOW_CANDIDATE"), 20, "embedded visual content"))
    )


def image_class() -> Column:
    c = F.col
    some, big = c("char_count") >= T.MIN_NATIVE_CHARS, c("largest_image_ratio")
    return (
        F.when(c("image_count") == 0, F.lit(None).cast("string"))
        .when(some & (c("x_columns") >= 4) & (c("y_rows") >= 3), "IMAGE_FLOW_CANDIDATE")
        .when(some & (((big >= LARGE_RATIO) & (c("block_count") >= 5)) | (big >= CONTENT_RATIO)), "IMAGE_CONTENT")
        .when(~some & (big >= VERY_LARGE_RATIO), "OCR")
        .when(big >= CONTENT_RATIO, "IMAGE_CONTENT")
    )


def classification() -> Column:
    c = F.col
    most = F.greatest(*[c(x) for x in ("table_score", "flow_table_score", "ocr_score", "vision_score")])
    return (
        F.when(c("image_class").isin("IMAGE_FLOW_CANDIDATE", "IMAGE_CONTENT"), c("image_class"))
        .when((c("ocr_score") >= OCR_LIMIT) & (c("char_count") < T.MIN_NATIVE_CHARS), "OCR")
        .when(c("flow_table_score") >= FLOW_LIMIT, "FLOW_TABLE")
        .when(c("table_score") >= TABLE_LIMIT, "TABLE")
        .when(c("vision_score") >= VISION_LIMIT, "VISION")
        .when(most >= REVIEW_LIMIT, "REVIEW")
        .otherwise("NORMAL")
    )


def audit(features: DataFrame) -> DataFrame:
    """Scores, reasons, image_class and classification for rows of page features."""
    out = features.withColumn("image_class", image_class())
    for name, rules in (("table", table_rules()), ("flow_table", flow_rules()), ("image", image_rules()), ("ocr", ocr_rules()), ("vision", vision_rules())):
        out = out.withColumns({f"{name}_score": rules.score(), f"{name}_reasons": rules.why()})
    return out.withColumn("classification", classification())


def summary(audited: DataFrame) -> DataFrame:
    """(ordinal, category, pages, page_list, recommendation): every category, in fixed order."""
    spark = audited.sparkSession
    names = spark.createDataFrame([(i, c, r) for i, (c, r) in enumerate(zip(CATEGORIES, RECOMMENDATIONS, strict=True))], "ordinal int, category string, recommendation string")
    counted = audited.groupBy("classification").agg(F.count("*").alias("n"))
    return F.broadcast(names).join(counted, F.col("category") == F.col("classification"), "left").select("ordinal", "category", F.coalesce("n", F.lit(0)).alias("pages"), "recommendation")


def native_tables(pages: DataFrame) -> DataFrame:
    """pages with total_tables: the greater count of the two strategies, lines_tables and text_tables.

    A strategy that failed (null) counts 0, and so does a page whose reader finds no tables (supported false or null).
    """
    counted = F.greatest(F.coalesce("lines_tables", F.lit(0)), F.coalesce("text_tables", F.lit(0)))
    return pages.withColumn("total_tables", F.when(F.col("supported"), counted).otherwise(F.lit(0)))


def report(audited: DataFrame) -> DataFrame:
    """The audit as rows (section, item, value), all strings: counts of all classes, pages with images, lists of pages and advice by class.

    Lists are per class, of a document's pages; audit one document at a time where these may be many.
    """
    counts = summary(audited)
    listed = audited.groupBy("classification").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page_id")), lambda x: x.cast("string")), ", ").alias("pages"))
    total = audited.agg(F.count("*").cast("string").alias("total"), F.count_if(F.col("image_count") > 0).cast("string").alias("images"))
    parts = [
        total.select(F.lit("1 summary").alias("section"), F.lit("pages").alias("item"), F.col("total").alias("value")),
        counts.select(F.lit("2 classes"), F.col("category"), F.col("pages").cast("string")),
        total.select(F.lit("3 images"), F.lit("pages with images"), F.col("images")),
        listed.where("classification <> 'NORMAL'").select(F.lit("4 pages"), F.col("classification"), F.col("pages")),
        counts.where("pages > 0").select(F.lit("5 advice"), F.col("category"), F.col("recommendation")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def significant(area: Column, page_area: Column) -> Column:
    """Whether an image takes CONTENT_RATIO of its page."""
    return area / page_area >= CONTENT_RATIO


def structure_score(n: Column, steps: tuple[int, int, int]) -> Column:
    return F.when(n >= steps[0], 40).when(n >= steps[1], 30).when(n >= steps[2], 20).otherwise(0)


def auto_tier(native_chars: Column, significant: Column, columns: Column, vision_ok: Column) -> Column:
    """Tier of a page: 1 native text, 2 local OCR, 3 vision; vision_ok says that a call is possible and succeeds."""
    wants = significant | (columns >= 2)
    return F.when(~significant & (native_chars >= T.MIN_NATIVE_CHARS), 1).when(wants & vision_ok, 3).otherwise(2)
