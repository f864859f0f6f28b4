"""The page loop with its calls: how many are made, for which pages, and never twice."""

import os
import time
import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.operators import page_loop as L
from lectern.operators.transcription import RateLimited
from lectern.plans.base import setting
from lectern.streaming import page_loop as S

PAGES = "source string, page_num int, native_text string, ocr_text string, n_columns int, significant boolean, item string"
DONE = "source string, page_num int, text string, tier int"


def counted(folder):
    """A function that leaves a file for each call; items name what it does."""

    def function(key, item):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{key} {item}")
        if item.startswith("quota"):
            raise RateLimited
        if item.startswith("broken") or item.startswith("once") and sum(open(f"{folder}/{n}").read().endswith(item) for n in os.listdir(folder)) == 1:
            raise ValueError
        return f"<think>hm</think> seen {item} "

    return function


def calls(folder):
    return sorted(open(f"{folder}/{n}").read().split(" ", 1)[1] for n in os.listdir(folder))


@pytest.fixture
def log(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "calls")


def row(source, n, item, significant=True, native=""):
    return (source, n, native, f"ocr {n}", 1, significant, item)


def test_budget_quota_and_resume(spark, tmp_path, log):
    rows = [row("many", n, f"many{n}") for n in range(1, 101)]
    rows += [row("stop", 1, "stop1"), row("stop", 2, "quota"), row("stop", 3, "stop3"), row("stop", 4, "stop4"), row("stop", 5, "x", False, "a page with native text")]
    rows += [row("over", n, f"over{n}") for n in range(1, 152)] + [row("fail", 1, "broken"), row("fail", 2, "fail2"), row("fail", 2, "fail2")]
    old = [("stop", 4, "kept", 3), ("many", 7, "old", 3), ("many", 7, "older", 2)]
    pages, done = spark.createDataFrame(rows, PAGES), spark.createDataFrame(old, DONE)
    out = L.transcribe_calling(pages, done, counted(log), ["k"], str(tmp_path / "out"), backoff=0)
    got = {(r.source, r.page_num): r for r in out.collect()}
    assert out.count() == len(got) == 258
    made = calls(log)
    assert len([c for c in made if c.startswith("many")]) == 59 and "many7" not in made  # a resumed vision page counts to the 60
    assert got["many", 7].text == "old" and got["many", 60].tier == 3 and got["many", 61].tier == 2 and got["many", 61].text == "ocr 61"
    assert [got["stop", n].status for n in range(1, 6)] == ["done", "paused", "paused", "resumed", "paused"] and [c for c in made if c.startswith("stop")] == ["stop1"]
    assert {got["over", n].status for n in range(1, 152)} == {"refused"} and not any(c.startswith("over") for c in made)
    assert made.count("broken") == 3 and got["fail", 1].tier == 2 and got["fail", 2].text == "seen fail2" and made.count("fail2") == 1
    # Answers are on record: the same pages again, elsewhere, from the same log.
    ask = L.asker(counted(log), ["k"], log=str(tmp_path / "out" / "answers"))
    assert ask("fail", got["fail", 2].__class__(item="fail2", page_num=2)) == ("seen fail2", False) and calls(log) == made


def test_degrade(spark, tmp_path, log):
    rows = [row("s", 1, "quota"), row("s", 2, "s2"), row("s", 3, "s3", False, "a page with native text")]
    out = L.transcribe_calling(spark.createDataFrame(rows, PAGES), spark.createDataFrame([], DONE), counted(log), ["a", "b"], str(tmp_path / "out"), L.Limits(degrade=True), attempts=1)
    assert [(r.page_num, r.status, r.tier, r.text) for r in out.orderBy("page_num").collect()] == [(1, "done", 2, "ocr 1"), (2, "done", 2, "ocr 2"), (3, "done", 1, "a page with native text")]
    assert calls(log) == ["quota", "quota"]  # one with each key


def test_queries_agree(spark):
    d, q = "/root/testdata/sf0.001", entry.queries()
    key = lambda df: sorted(map(tuple, df.select("source", "page_num", "status", "tier", "text", "checkpoint").collect()), key=str)
    expected = key(q["page_loop_pause"](spark, d))
    assert key(q["page_loop_calls"](spark, d)) == expected and key(q["page_loop_stream"](spark, d)) == expected
    assert {"resumed", "refused", "done"} <= {r[2] for r in expected}


def _stream(spark, folder, old, function, timer, backoff=0.01, limits=L.Limits(3, 20)):
    arriving = spark.readStream.schema(PAGES + ", total_pages int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = S.transcribe_stream(arriving, old, function, ["k"], limits, backoff=backoff, timer=timer)
    writer = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    return (writer.trigger(processingTime="100 milliseconds") if timer else writer.trigger(availableNow=True)).start()


def _add(spark, folder, rows, total):
    spark.createDataFrame(rows, PAGES).withColumn("total_pages", F.lit(total)).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_stream_restarts_without_a_second_call(spark, tmp_path, log):
    folder, old = str(tmp_path), spark.createDataFrame([("d", 2, "kept", 3), ("e", 1, "old", 1)], DONE)
    with setting(spark, *S.STATE_STORE):
        _add(spark, folder, [row("d", 3, "d3"), row("d", 1, "d1"), row("d", 5, "d5"), row("f", 1, "quota")], 6)
        _stream(spark, folder, old, counted(log), False).awaitTermination()
        assert calls(log) == ["d1", "d3", "quota", "quota", "quota"]
        _add(spark, folder, [row("d", 4, "d4"), row("d", 6, "d6"), row("d", 3, "d3"), row("f", 2, "f2"), row("e", 2, "e2")], 6)
        _add(spark, folder, [row("g", 1, "g1")], 21)
        _stream(spark, folder, old, counted(log), False).awaitTermination()
    assert calls(log) == ["d1", "d3", "e2", "quota", "quota", "quota"]  # d has spent its three
    got = sorted((r.source, r.page_num, r.status, r.tier) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == [("d", 1, "done", 3), ("d", 2, "resumed", 3), ("d", 3, "done", 3), ("d", 4, "done", 2), ("d", 5, "done", 2), ("d", 6, "done", 2), ("e", 1, "resumed", 1), ("e", 2, "done", 3), ("f", 1, "paused", None), ("f", 2, "paused", None), ("g", 1, "refused", None)]


def test_stream_waits_by_timer(spark, tmp_path, log):
    folder = str(tmp_path)
    with setting(spark, *S.STATE_STORE):
        _add(spark, folder, [row("d", 1, "once"), row("d", 2, "d2"), row("e", 1, "e1")], 2)
        query = _stream(spark, folder, spark.createDataFrame([], DONE), counted(log), True, backoff=1)
        try:
            end = time.time() + 90
            while calls(log) != ["d2", "e1", "once", "once"] and time.time() < end:
                assert query.exception() is None
                time.sleep(0.3)
            time.sleep(2)
        finally:
            query.stop()
    assert calls(log) == ["d2", "e1", "once", "once"]
    assert sorted((r.source, r.page_num, r.text) for r in spark.read.parquet(f"{folder}/out").collect()) == [("d", 1, "seen once"), ("d", 2, "seen d2"), ("e", 1, "seen e1")]


def test_state_is_asked_by_source_not_by_page():
    asked = []

    class State:
        def __init__(self):
            self.value = []

        def __getattr__(self, name):
            asked.append(name)
            return {"exists": lambda: bool(self.value), "get": lambda: self.value, "put": self._set, "update": self._set, "clear": lambda: self._set([])}[name]

        def _set(self, value):
            self.value = value

    class Handle:
        def getValueState(self, name, schema):
            return State()

        getListState = getValueState

    page = lambda n: Row(**dict(zip(PAGES.replace(" string", "").replace(" int", "").replace(" boolean", "").split(", "), row("s", n, f"x{n}", False), strict=True)), total_pages=90)
    loop = S.PageLoop(lambda key, item: item, ["k"], L.Limits(3, 100), 1, 0, None, False)
    loop.init(Handle())
    loop.handleInitialState(("s",), Row(pages=[{"page_num": n, "text": "old", "tier": 1} for n in range(2, 90, 2)]), None)
    out = [r.page_num for part in (range(3, 91), [1]) for r in loop.handleInputRows(("s",), [page(n) for n in part], None)]
    assert out == list(range(1, 91)) and len(asked) < 25 and not loop.early.value and not loop.done.value
