"""Page layout: columns from gaps, lines from tops, reading order, coordinate clusters, duplicate images.

Words of a page are an array, and order-dependent rules are folds over the sorted array, so a page
is one row and nothing but the gathering of its words shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
BIN, MIN_GAP, LINE_TOLERANCE, DUPLICATE_SHARE = 5, 15, 12, 0.90
#: Items are taken for an extractor so many at a time, and handed on once they have so many words.
ITEMS, WORDS = 16, 100_000


def page_words(words: DataFrame) -> DataFrame:
    """(page_id, words) from page_id, word_pos, text, left, top, right; blank words are dropped."""
    own = F.struct("word_pos", "text", "left", "top", "right")
    return words.where(F.trim("text") != "").groupBy("page_id").agg(F.array_sort(F.collect_list(own)).alias("words"))


def _found(pages: DataFrame, extractor: Callable, item: str) -> DataFrame:
    """(page_id, words) of each row of pages: what the extractor gives, as an array; a row without words has an empty one."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        def rows(ids, ends, words):
            columns = [*zip(*words, strict=True)] or [()] * 5
            of = pa.StructArray.from_arrays([pa.array(c, pa.string() if k == 1 else pa.int32()) for k, c in enumerate(columns)], names=["word_pos", "text", "left", "top", "right"])
            return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), of)], names=["page_id", "words"])

        for batch in batches:
            ids, items, first, ends, words = batch.column("page_id"), batch.column("item"), 0, [0], []
            for lo in range(0, batch.num_rows, ITEMS):
                for value in items.slice(lo, ITEMS).to_pylist():
                    for k, (text, left, top, width) in enumerate([] if value is None else extractor(value)):
                        text = text and text.strip()
                        if text:
                            words.append((k, text, int(left), int(top), int(left + width)))
                    ends.append(len(words))
                done = min(lo + ITEMS, batch.num_rows)
                if len(words) >= WORDS or done == batch.num_rows:
                    yield rows(ids.slice(first, done - first), ends, words)
                    first, ends, words = done, [0], []

    own = "array<struct<word_pos:int,text:string,left:int,top:int,right:int>>"
    return pages.select("page_id", F.col(item).alias("item")).mapInArrow(run, f"page_id {kind}, words {own}")


def extract_words(pages: DataFrame, extractor: Callable, item: str = "item") -> DataFrame:
    """(page_id, word_pos, text, left, top, right) from what an OCR engine or a text layer gives for each page.

    extractor(value of item, as a Python value) gives (text, left, top, width) for each word, in its own order; it is sent to
    the executors, so an engine is best opened inside. Outer white space goes, and with it blank words; a null item has none.
    """
    return _found(pages, extractor, item).select("page_id", F.inline("words"))


def ocr(pages: DataFrame, extractor: Callable, item: str = "item") -> DataFrame:
    """(page_id, ocr_text, n_columns) of every page: its words in reading order; without words an empty text and no column."""
    words = _found(pages, extractor, item).groupBy("page_id").agg(F.flatten(F.collect_list("words")).alias("words"))
    return words.select("page_id", _read("words").alias("r")).select("page_id", F.col("r.text").alias("ocr_text"), F.col("r.columns").alias("n_columns"))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once; a lambda inside body would compute it for each element."""
    return F.transform(F.array(value), body)[0]


def boundaries(words: str = "words") -> Column:
    """Column boundaries of a page: middles of gaps of MIN_GAP pixels, with one before and one after all words."""
    right = F.array_max(F.transform(words, lambda w: w["right"]))

    def cuts(left):
        spans = F.array_sort(F.transform(words, lambda w: F.struct(F.floor((w["left"] - left) / BIN).cast("int").alias("a"), F.floor((w["right"] - left) / BIN).cast("int").alias("b"))))
        # Spans in order of their start: a gap lies between the furthest end so far and the next start.
        none = F.array().cast("array<int>")
        fold = F.aggregate(
            spans,
            F.struct(F.lit(-1).alias("end"), none.alias("cuts")),
            lambda s, w: F.struct(
                F.greatest(s["end"], w["b"]).alias("end"),
                F.when((s["end"] >= 0) & ((w["a"] - s["end"] - 1) * BIN >= MIN_GAP), F.concat(s["cuts"], F.array((F.floor((s["end"] + 1 + w["a"]) / 2) * BIN + left).cast("int")))).otherwise(s["cuts"]).alias("cuts"),
            ),
            lambda s: s["cuts"],
        )
        return F.concat(F.array((left - 1).cast("int")), fold, F.array((right + 1).cast("int")))

    return _bind(F.array_min(F.transform(words, lambda w: w["left"])), cuts)


def column_of(left: Column, cuts: Column) -> Column:
    """0-based column of a word: how many inner boundaries lie at or left of it."""
    return F.size(F.filter(cuts, lambda b: b <= left)) - 1


def line_groups(words: Column, key) -> Column:
    """Words sorted by top with group, a running number: a new one where the top is LINE_TOLERANCE below the group's first."""
    ordered = F.array_sort(F.transform(words, lambda w: F.struct(w["top"].alias("top"), w["word_pos"].alias("word_pos"), w["left"].alias("left"), w["text"].alias("text"))))
    none = F.array().cast("array<struct<group:int,left:int,word_pos:int,text:string,top:int>>")
    start = F.struct(F.lit(-1).alias("group"), F.lit(None).cast("int").alias("anchor"), none.alias("out"))

    def step(s, w):
        new = s["anchor"].isNull() | (w["top"] - s["anchor"] >= LINE_TOLERANCE)
        group = F.when(new, s["group"] + 1).otherwise(s["group"])
        one = F.struct(group.alias("group"), w["left"].cast("int").alias("left"), w["word_pos"].cast("int").alias("word_pos"), w["text"].alias("text"), w["top"].cast("int").alias("top"))
        return F.struct(group.alias("group"), F.when(new, w["top"]).otherwise(s["anchor"]).cast("int").alias("anchor"), F.concat(s["out"], F.array(one)).alias("out"))

    return F.aggregate(ordered, start, step, lambda s: s["out"])


def _read(words: str) -> Column:
    """(text, columns) of a page: its words in reading order, and how many columns have one.

    Words are sorted by column and top; a fold over them finds where lines begin, so a line is a slice.
    """
    none = F.array().cast("array<struct<at:int,gap:string>>")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("columns"), F.lit(None).cast("int").alias("col"), F.lit(None).cast("int").alias("anchor"), none.alias("lines"))

    def step(s, w):
        column = s["col"].eqNullSafe(w["col"])
        after = lambda columns, anchor, lines: F.struct((s["n"] + 1).alias("n"), columns.alias("columns"), w["col"].alias("col"), anchor.cast("int").alias("anchor"), lines.alias("lines"))
        begun = lambda gap: F.concat(s["lines"], F.array(F.struct(s["n"].alias("at"), F.lit(gap).alias("gap"))))
        # Words without a top come first in a column and have a line each.
        same_line = after(s["columns"], s["anchor"], s["lines"])
        return F.when(column & (w["top"] - s["anchor"] < LINE_TOLERANCE), same_line).when(column, after(s["columns"], w["top"], begun("\n"))).otherwise(after(s["columns"] + 1, w["top"], begun("\n\n")))

    def line(ordered, at, end):
        own = F.transform(F.slice(ordered, at + 1, end - at), lambda w: F.struct(w["left"].cast("int").alias("left"), w["top"].cast("int").alias("top"), w["word_pos"].cast("int").alias("word_pos"), w["text"].alias("text")))
        return F.array_join(F.transform(F.array_sort(own), lambda w: w["text"]), " ")

    def page(ordered, s):
        lines = F.transform(s["lines"], lambda x, k: F.concat(x["gap"], line(ordered, x["at"], F.coalesce(F.get(s["lines"], k + 1)["at"], s["n"]))))
        return F.struct(F.regexp_replace(F.array_join(lines, ""), r"^\s+|\s+\z", "").alias("text"), s["columns"].alias("columns"))

    placed = lambda cuts: F.array_sort(F.transform(words, lambda w: F.struct(column_of(w["left"], cuts).alias("col"), w["top"].alias("top"), w["word_pos"].alias("word_pos"), w["left"].alias("left"), w["text"].alias("text"))))
    return _bind(boundaries(words), lambda cuts: _bind(placed(cuts), lambda ordered: _bind(F.aggregate(ordered, start, step), lambda s: page(ordered, s))))


def reading_order(words: DataFrame) -> DataFrame:
    """(page_id, text, column_count): lines by column, top to bottom, an empty line after each column."""
    return page_words(words).select("page_id", _read("words").alias("r")).select("page_id", "r.text", F.col("r.columns").alias("column_count"))


def clusters(values: Column, tolerance: float = 12.0) -> Column:
    """Means of greedy clusters of sorted values: a value joins while it is within tolerance of the running mean."""
    none = F.array().cast("array<double>")
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("n"), none.alias("out"))

    def step(s, x):
        joins = (s["n"] > 0) & (F.abs(x - s["sum"] / F.greatest(s["n"], F.lit(1.0))) <= tolerance)
        closed = F.when(s["n"] > 0, F.concat(s["out"], F.array(s["sum"] / F.greatest(s["n"], F.lit(1.0))))).otherwise(s["out"])
        return F.struct(F.when(joins, s["sum"] + x).otherwise(x).alias("sum"), F.when(joins, s["n"] + 1).otherwise(F.lit(1.0)).alias("n"), F.when(joins, s["out"]).otherwise(closed).alias("out"))

    done = lambda s: F.when(s["n"] > 0, F.concat(s["out"], F.array(s["sum"] / s["n"]))).otherwise(s["out"])
    return F.aggregate(F.array_sort(F.transform(values, lambda x: x.cast("double"))), start, step, done)


def kept_images(rects: DataFrame) -> DataFrame:
    """(page_id, pos, x0, y0, x1, y1): rectangles with area that no kept one before them covers by DUPLICATE_SHARE of the smaller."""
    area = lambda r: F.abs((r["x1"] - r["x0"]) * (r["y1"] - r["y0"]))
    shared = lambda a, b: F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0)) * F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    page = rects.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x0", "y0", "x1", "y1", "origin"))).alias("rs"))
    none = F.filter("rs", lambda r: F.lit(False))
    # Only rectangles of the second kind are tested; the first kind has no duplicates of its own.
    twin = lambda s, r: (r["origin"] == "text_dict") & F.exists(s, lambda k: shared(k, r) > DUPLICATE_SHARE * F.least(area(k), area(r)))
    kept = F.aggregate("rs", none, lambda s, r: F.when((area(r) <= 0) | twin(s, r), s).otherwise(F.concat(s, F.array(r))))
    return page.select("page_id", F.explode(kept).alias("r")).select("page_id", *[f"r.{c}" for c in ("pos", "x0", "y0", "x1", "y1")])


def distinct_images(rects: DataFrame) -> DataFrame:
    """(page_id, pos) of kept_images."""
    return kept_images(rects).select("page_id", "pos")
