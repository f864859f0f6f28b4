"""Calls with retry and key rotation, the page loop's odd inputs, redo."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import transcription as X

PAGES = "source string, page_num int, native_text string, ocr_text string, n_columns int, significant boolean, vision_text string, exhausted boolean"
DONE = "source string, page_num int, text string, tier int"


def test_call_waits_and_gives_up():
    waits, left = [], [X.RateLimited(), ValueError()]

    def flaky(item):
        if left:
            raise left.pop(0)
        return item.upper()

    assert X.call(flaky, "x", sleep=waits.append) == ("X", False) and waits == [10, 20]

    def refused(item):
        raise X.RateLimited

    def broken(item):
        raise ValueError

    assert X.call(refused, 1, sleep=waits.append) == ("", True) and X.call(broken, 1, sleep=waits.append) == ("", False)


def test_keys_rotate_for_good():
    seen = []

    def function(key, item):
        seen.append(key)
        if key == "a":
            raise X.RateLimited
        return key + item

    pool = X.Keys(["a", "b"])
    assert pool.call(function, "1") == "b1" and pool.call(function, "2") == "b2" and seen == ["a", "b", "b"]
    with pytest.raises(X.RateLimited):
        X.Keys(["a"]).call(function, "1")
    with pytest.raises(ValueError):
        X.Keys([])


def test_page_loop(spark):
    native = "a page with native text"
    rows = [("d", 1, native, None, 1, False, None, None), ("d", 2, "", "ocr", 1, False, None, None), ("d", 3, None, None, 2, False, "seen", False), ("d", 4, native, "o", 1, True, "", True), ("d", 5, native, "o", 1, True, "late", False), ("d", 5, native, "o", 1, True, "late", False)]
    pages, none = spark.createDataFrame(rows, PAGES), spark.createDataFrame([], DONE)
    got = lambda **k: [(r.page_num, r.status, r.tier, r.text) for r in X.transcribe(pages, k.pop("old", none), **k).orderBy("page_num").collect()]
    first = [(1, "done", 1, native), (2, "done", 2, "ocr"), (3, "done", 3, "seen")]
    assert got() == [*first, (4, "paused", None, None), (5, "paused", None, None)]
    assert got(degrade=True) == [*first, (4, "done", 2, "o"), (5, "done", 2, "o")]
    assert got(max_pages=4) == [(p, "refused", None, None) for p in range(1, 6)]
    old = spark.createDataFrame([("d", 4, "kept", 3)], DONE)
    assert got(old=old, budget=2) == [*first, (4, "resumed", 3, "kept"), (5, "done", 2, "o")]
    # What the checkpoint has after the stop stays.
    later = spark.createDataFrame([("d", 5, "kept", 3)], DONE)
    assert got(old=later) == [*first, (4, "paused", None, None), (5, "resumed", 3, "kept")]
    out = X.outcomes(X.transcribe(pages, later)).first()
    assert (out.state, out.pages_done, out.resumed, out.vision_pages_used) == ("paused", 4, True, 1)
    states = {r.state for r in X.outcomes(X.transcribe(pages, none)).collect()}
    assert states == {"paused"} and X.transcribe(pages.limit(0), none).count() == 0
    assert X.outcomes(X.transcribe(pages, old)).first().markdown.startswith("<!-- Page 1 -->")


def test_redo(spark):
    done = spark.createDataFrame([("d", 1, "t", 1), ("e", 1, "u", 1)], DONE)
    empty, backup = X.redo_all(done, done.where("source = 'd'").withColumn("text", F.lit("older")))
    assert empty.count() == 0 and {(r.source, r.text) for r in backup.collect()} == {("d", "older"), ("e", "u")}
    redo = spark.createDataFrame([("d", 0), ("d", 2), ("d", 3), ("x", 1)], "source string, page_num int")
    totals = spark.createDataFrame([("d", 2)], "source string, total_pages int")
    assert {tuple(r) for r in X.invalid_pages(redo, totals).collect()} == {("d", 0), ("d", 3), ("x", 1)}
