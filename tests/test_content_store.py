"""Compare-and-set, branches, reads as of a version, two writers."""

import hashlib
import threading

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.sources.content_store import ContentStore, Contended

CHANGE = "path string, content binary, expected string"


def sha(x):
    return hashlib.sha256(x).hexdigest()


def put(store, branch, *rows, **k):
    return {(r.path, r.outcome): r.sha for r in store.put(branch, store.spark.createDataFrame(rows, CHANGE), **k).collect()}


def held(store, branch, version=None):
    return {r.path: bytes(r.content) for r in store.read(branch, version).collect()}


def test_compare_and_set(spark, tmp_path):
    store = ContentStore(spark, str(tmp_path))
    assert store.head("main") == 0 and held(store, "main") == {}
    assert put(store, "main", ("a", b"1", None), ("b", b"2", None), ("c", b"", None)) == {("a", "created"): sha(b"1"), ("b", "created"): sha(b"2"), ("c", "created"): sha(b"")}
    assert put(store, "main", ("a", b"9", sha(b"1")), ("b", b"8", sha(b"stale")), ("b2", b"7", sha(b"gone")), ("c", b"x", None)) == {("a", "updated"): sha(b"9"), ("b", "conflict"): sha(b"2"), ("b2", "conflict"): None, ("c", "conflict"): sha(b"")}
    assert held(store, "main") == {"a": b"9", "b": b"2", "c": b""} and held(store, "main", 1)["a"] == b"1" and store.head("main") == 2
    # Nothing to write makes no version; rows of one path, nulls.
    assert put(store, "main", ("a", b"9", None)) == {("a", "unchanged"): sha(b"9")} and store.head("main") == 2
    got = put(store, "main", ("d", b"1", None), ("d", b"2", None), (None, b"x", None), ("e", None, None))
    assert sorted((p or "", o) for p, o in got) == [("", "conflict"), ("d", "conflict"), ("d", "created"), ("e", "conflict")] and held(store, "main")["d"] == min(b"1", b"2", key=sha)
    gone = store.delete("main", spark.createDataFrame([("a", sha(b"9")), ("b", "stale"), ("z", "x")], "path string, expected string"))
    assert {r.path: r.outcome for r in gone.collect()} == {"a": "deleted", "b": "conflict", "z": "missing"}
    assert set(held(store, "main")) == {"b", "c", "d"} and put(store, "main", ("a", b"again", None)) == {("a", "created"): sha(b"again")}
    assert "a" in held(store, "main", 3) and "a" not in held(store, "main", 4)
    before = held(store, "main")
    version = store.compact("main")
    assert held(store, "main") == before == held(store, "main", version) and held(store, "main", 1) == {"a": b"1", "b": b"2", "c": b""}
    assert put(store, "main", ("a", b"after", sha(b"again"))) == {("a", "updated"): sha(b"after")}


def test_branches_and_tags(spark, tmp_path):
    store = ContentStore(spark, str(tmp_path))
    assert not store.ensure_branch("side", "main")
    put(store, "main", ("a", b"1", None))
    assert store.ensure_branch("side", "main") and store.ensure_branch("side", "main") and store.ensure_branch("empty")
    put(store, "side", ("a", b"2", sha(b"1")), ("s", b"s", None))
    put(store, "main", ("m", b"m", None))
    assert held(store, "side") == {"a": b"2", "s": b"s"} and held(store, "main") == {"a": b"1", "m": b"m"} and held(store, "empty") == {}
    first = put(store, "side", ("t", b"t", None), tag="q:1")
    assert put(store, "side", ("t", b"other", sha(b"t")), tag="q:1") == first and held(store, "side")["t"] == b"t" and store.branches() == ["empty", "main", "side"]


def test_two_writers_leave_one_winner(spark, tmp_path):
    store, out, wait = ContentStore(spark, str(tmp_path)), {}, threading.Barrier(2)
    put(store, "main", ("a", b"0", None))

    class Slow(ContentStore):
        def _write(self, rows):
            data = super()._write(rows)
            if not self.__dict__.get("met"):
                self.met = True
                wait.wait(60)  # both have decided on version 1
            return data

    def write(name):
        out[name] = put(Slow(spark, str(tmp_path)), "main", ("a", name.encode(), sha(b"0")), (name, b"own", None))

    threads = [threading.Thread(target=write, args=(n,)) for n in ("x", "y")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    win = [n for n in out if ("a", "updated") in out[n]]
    lose = next(n for n in out if n not in win)
    assert len(win) == 1 and out[lose]["a", "conflict"] == sha(win[0].encode()) and out[lose][lose, "created"] == sha(b"own")
    assert held(store, "main") == {"a": win[0].encode(), "x": b"own", "y": b"own"} and store.head("main") == 3

    class Beaten(ContentStore):
        def _publish(self, *args, **more):
            return False

    with pytest.raises(Contended):
        put(Beaten(spark, str(tmp_path), attempts=2), "main", ("q", b"q", None))


def test_query_against_python(spark):
    d = "/root/testdata/sf0.001"
    pages = {r.page_id: (r.url, r.html) for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    expected = {}
    for n, (url, html) in pages.items():
        path = f"{url}#{n}"
        text, version = (html + "!", 2) if n % 3 == 0 else (html, 1)
        if n % 7 != 0:
            expected[path] = (sha(text.encode()), version)
    got = entry.queries()["content_store"](spark, d)
    assert {r.path: (r.sha, r.version) for r in got.collect()} == expected
    assert got.where(F.col("path").isNull()).count() == 0
