"""Checkpoints: a batch run twice, a stream killed between batches, corrupt states, the end of an upload."""

import pytest

import __spark_entry__ as entry
from lectern.sources.content_store import ContentStore
from lectern.streaming.checkpoint_sink import BRANCH, Checkpoints

PAGES = "key string, page_num int, text string, tier int, seq long"


def pages_of(c, *keys):
    got = c.resume(c.store.spark.createDataFrame([(k,) for k in keys], "key string"))
    return sorted(tuple(r) for r in got.select("key", "page_num", "text", "tier").collect())


def test_save_resume_finish(spark, tmp_path):
    store = ContentStore(spark, str(tmp_path))
    c = Checkpoints(store)
    df = lambda *rows: spark.createDataFrame(rows, PAGES)
    c.save(df(("a", 1, "one", 1, 1), ("a", 1, "newer", 3, 2), ("a", 2, None, 2, 3), ("b", 1, "b", 2, 4), (None, 1, "x", 1, 5), ("b", None, "x", 1, 6)))
    c.save(df(("a", 3, "three", 3, 7), ("a", 1, "newest", 2, 1)))
    assert pages_of(c, "a", "b", "z") == [("a", 1, "newest", 2), ("a", 2, None, 2), ("a", 3, "three", 3), ("b", 1, "b", 2)]
    # The same batch again changes nothing, whatever it holds.
    c.save(df(("b", 2, "b2", 1, 8)), "q:5")
    head = store.head(BRANCH)
    c.save(df(("b", 2, "else", 1, 9)), "q:5")
    assert store.head(BRANCH) == head and ("b", 2, "b2", 1) in pages_of(c, "b")
    # A corrupt one is begun anew.
    sha = {r.key: r.sha for r in c.state().collect()}
    store.put(BRANCH, spark.createDataFrame([("checkpoints/b.json", b'{"pages": \xff', sha["b"])], "path string, content binary, expected string"))
    assert pages_of(c, "b") == []
    c.save(df(("b", 7, "again", 1, 1)))
    assert pages_of(c, "b") == [("b", 7, "again", 1)]
    ended = c.finish(spark.createDataFrame([("a", "done"), ("b", "paused"), ("z", "done")], "key string, state string"))
    assert [(r.path, r.outcome) for r in ended.collect()] == [("checkpoints/a.json", "deleted")]
    assert pages_of(c, "a", "b") == [("b", 7, "again", 1)]
    c.save(df().limit(0))
    with pytest.raises(ValueError):
        Checkpoints(store, "nowhere")


def test_stream_killed_between_batches(spark, tmp_path):
    store = ContentStore(spark, str(tmp_path / "store"))
    c = Checkpoints(store)
    for n in range(3):
        spark.createDataFrame([("a", n + 1, f"t{n}", 1, n)], PAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = lambda: spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    class Dies(Checkpoints):
        def save(self, pages, tag=None):
            out = super().save(pages, tag)
            if tag.endswith(":1"):
                raise InterruptedError  # after the commit, before Spark knows of it
            return out

    def stop(epoch, error):
        raise error

    query = Dies(store).sink(arriving(), "q", str(tmp_path / "log"), stop)
    with pytest.raises(Exception):
        query.awaitTermination(120)
    assert len(pages_of(c, "a")) == 2 and store.head(BRANCH) == 2
    c.sink(arriving(), "q", str(tmp_path / "log")).awaitTermination(120)
    assert [p[1:3] for p in pages_of(c, "a")] == [(n + 1, t) for n, t in enumerate(sorted(x[2] for x in pages_of(c, "a")))] and len(pages_of(c, "a")) == 3
    assert store.head(BRANCH) == 3  # batch 1 was not written twice


def test_a_failed_write_does_not_stop_the_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1, "t", 1, 1)], PAGES).coalesce(1).write.parquet(str(tmp_path / "in"))
    told = []

    class Broken(Checkpoints):
        def save(self, pages, tag=None):
            raise OSError("the store is away")

    Broken(ContentStore(spark, str(tmp_path / "store"))).sink(spark.readStream.schema(PAGES).parquet(str(tmp_path / "in")), "q", str(tmp_path / "log"), lambda n, e: told.append((n, str(e)))).awaitTermination(120)
    assert told == [(0, "the store is away")]


def test_query_against_python(spark):
    d = "/root/testdata/sf0.001"
    by, expected = {}, set()
    for r in sorted(spark.read.parquet(f"{d}/events.parquet").collect(), key=lambda r: r.event_id):
        by.setdefault(f"u{r.user_id}", []).append(r)
    for source, rows in by.items():
        if len(rows) % 2:
            expected |= {(source, n + 1, "" if r.event_id % 7 == 0 else r.event_type, r.event_id % 3 + 1) for n, r in enumerate(rows)}
    got = entry.queries()["checkpoint_lifecycle"](spark, d).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
