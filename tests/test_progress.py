"""Progress of a stream, answers with one retry, images without twins."""

import time

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import audit, conversations, layout
from lectern.streaming import progress


def test_progress_in_order(spark, tmp_path):
    schema = "page_num int, tier int"
    for rows in ([(1, 1), (2, 3)], [(3, 3), (4, None), (5, 2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    told = []
    listener = progress.ProgressListener(told.append)
    spark.streams.addListener(listener)
    try:
        pages = progress.observed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        pages.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination(120)
        end = time.time() + 30
        while len(told) < 2 and time.time() < end:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert [p.batch for p in told] == [0, 1] and sorted(p.pages for p in told) == [2, 3] and told[-1].done == 5
    assert told[-1].tiers == {1: 1, 2: 1, 3: 2, None: 1} and max(p.last_page for p in told) == 5


def test_answers(spark, tmp_path):
    seen = str(tmp_path / "calls")

    def ask(messages):
        with open(seen, "a+") as f:
            f.write(messages[-1]["content"] + "\n")
            f.seek(0)
            n = f.read().split("\n").count(messages[-1]["content"])
        return None if messages[-1]["content"] == "none" else "Hm. I DON'T KNOW based on the provided sources." if n == 1 else "found"

    rows = [(1, [("user", "a")], 0.5), (2, [("system", "s"), ("user", "b")], 0.49), (3, [("user", "c")], None), (4, None, 0.9), (5, [("user", "none")], 0.9)]
    df = spark.createDataFrame(rows, "query_id int, messages array<struct<role:string,content:string>>, top_score double").coalesce(1)
    conversations.answer(df, ask).write.parquet(str(tmp_path / "out"))
    got = {r.query_id: (r.answer, r.calls) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    refused = "Hm. I DON'T KNOW based on the provided sources."
    assert got == {1: ("found", 2), 2: (refused, 1), 3: (refused, 1), 4: (None, 0), 5: ("", 1)}
    assert sorted(open(seen).read().split()) == ["a", "a", "b", "c", "none"]


def test_image_blocks(spark):
    rows = [(1, 0, "get_images", 0.0, 0.0, 10.0, 10.0), (1, 1, "text_dict", 0.5, 0.0, 10.0, 10.0), (1, 2, "text_dict", 20.0, 0.0, 30.0, 5.0), (1, 3, "get_images", 0.0, 0.0, 10.0, 10.0), (1, 4, "get_images", 5.0, 5.0, 5.0, 9.0), (2, 0, "text_dict", 0.0, 0.0, 1.0, 1.0)]
    out = audit.image_blocks(spark.createDataFrame(rows, "page_id int, pos int, origin string, x0 double, y0 double, x1 double, y1 double"), F.lit(1000.0))
    got = {r.page_id: (r.image_count, round(r.largest_image_ratio, 4), round(r.total_image_ratio, 4)) for r in out.collect()}
    assert got == {1: (3, 0.1, 0.25), 2: (1, 0.001, 0.001)}


def test_golden_question_list(spark):
    detect = lambda text: spark.createDataFrame([(text,)], "x string").select(T.is_faq("x").alias("y")).first().y
    assert detect("Intro\n\n1. A b?\n\nans\n\n2. C d?\nans\n") is True
    assert detect("Intro\n1. A b?\n") is False


def test_words_of_an_engine(spark):
    pages = spark.createDataFrame([(1, "x"), (2, None), (3, ""), (None, "x")], "page_id int, item string")
    engine = lambda item: [(" right ", 300, 0, 40), ("  ", 10, 0, 5), ("left", 0, 2, 40), (None, 0, 0, 1), ("below", 5, 30, 30)] if item else []
    words = layout.extract_words(pages, engine).where("page_id = 1").collect()
    assert [(w.word_pos, w.text, w.left, w.top, w.right) for w in words] == [(0, "right", 300, 0, 340), (2, "left", 0, 2, 40), (4, "below", 5, 30, 35)]
    got = {r.page_id: (r.ocr_text, r.n_columns) for r in layout.ocr(pages, engine).collect()}
    assert got == {1: ("left\nbelow\n\nright", 2), 2: ("", 0), 3: ("", 0), None: ("left\nbelow\n\nright", 2)}
