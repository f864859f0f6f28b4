"""Readers, checkpoints, sinks and the streaming form."""

import pytest
from pyspark.sql import functions as F

from lectern.sources import checkpoints, files, writers
from lectern.streaming import ingest as stream


def test_folder(spark, tmp_path):
    (tmp_path / "## Q & A+1.txt").write_bytes(b"1. A?\r\nx\r\n\r\n2. B?\r\ny\r\n\r\n3. C?\r\nz")
    (tmp_path / "m.MD").write_text("<think>no</think>2.1 Some Heading\nbody that is long enough\n")
    (tmp_path / "skip.csv").write_text("a,b")
    (tmp_path / "blank.txt").write_text(" \n")
    (tmp_path / "bad.txt").write_bytes(b"caf\xff and text\nlong enough body here")
    got = files.load_and_chunk(spark, str(tmp_path))
    rows = {(r.source, r.title): r.text for r in got.collect()}
    assert ("## Q & A+1.txt", "A?") in rows and ("m.MD", "2.1 Some Heading") in rows
    assert "\r" not in "".join(rows.values()) and "skip.csv" not in {k[0] for k in rows}
    assert any("caf�" in t for t in rows.values())
    assert files.last_updated(files.scan(spark, str(tmp_path))).first().last_updated is not None


def test_missing_reader(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    with pytest.raises(files.ReaderNotInstalled):
        files.load(spark, str(tmp_path)).collect()
    reader = lambda df: df.select("source", F.lit("text of a page").alias("text"))
    assert files.load(spark, str(tmp_path), {".pdf": reader}).first().text == "text of a page"
    (tmp_path / "a.pdf").unlink()
    (tmp_path / "a.csv").write_text("x")
    with pytest.raises(files.EmptyFolder):
        files.load_and_chunk(spark, str(tmp_path))


def test_folder_rules(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.load_and_chunk(spark, str(tmp_path / "none"))
    for name in ("b.md", "a.txt", "c.MD"):
        (tmp_path / name).write_text(f"1.2 Heading of {name[0]}\nthis body is long enough\n3.4 Second of it\nand its body is long as well")
    assert [(r.source, r.chunk_id) for r in files.in_order(files.load_and_chunk(spark, str(tmp_path))).collect()] == [(n, k) for n in ("a.txt", "b.md", "c.MD") for k in (0, 1)]
    assert {r.source: r.snippet for r in files.find_phrase(spark, str(tmp_path), "HEADING OF B").collect()} == {"b.md": "1.2 Heading of b this body is long enough 3.4 Second of it and its body is long as well"}
    (tmp_path / "b.md").write_text("9.1 Long Part\n" + "word " * 1000)
    got = files.load_markdown(spark, str(tmp_path / "b.md")).collect()
    assert [len(r.text) for r in got][0] == files.MARKDOWN_CHARS and len(got) == 2


def test_repeated_pages(spark):
    """A page that occurs twice is no error; one of its texts stays."""
    pages = spark.createDataFrame([("s", 1, "a"), ("s", 1, "b"), ("s", 3, "c")], "source string, page_num int, text string")
    assert checkpoints.write_pages(pages, "source").first().json == '{"1":"b","3":"c"}'


def test_docx_and_tiers(spark):
    blocks = spark.createDataFrame([("d", 0, "p", "Heading 2", "Head", None), ("d", 1, "table", None, None, ["a", "b"]), ("d", 2, "p", None, " para ", None), ("d", 3, "p", None, " ", None)], "source string, block_pos int, kind string, style string, text string, cells array<string>")
    assert files.docx_text(blocks).first().text == "## Head\n\n para \n\n| a | b |"
    pages = spark.createDataFrame([("d", 1, "x" * 20), ("d", 2, "x"), ("d", 3, "")], "source string, page_num int, text string")
    curated = spark.createDataFrame([("d", 1), ("d", 2)], "source string, page_num int")
    assert {r.page_num: r.tier for r in files.tiered_pages(pages, curated).collect()} == {1: 1, 2: 3, 3: 2}


def test_checkpoints(spark):
    df = spark.createDataFrame([("s", '{"1": "a<think>b", "x": "c", "2": null}'), ("t", "not json"), ("u", None)], "source string, json string")
    assert sorted((r.source, r.page_num, r.text) for r in checkpoints.read_pages(df, "json").collect()) == [("s", 1, "a"), ("s", 2, "")]
    df = spark.createDataFrame([("h", '{"pages": {"3": {"text": "a", "tier": 2}}}'), ("i", "{")], "file_hash string, json string")
    assert [tuple(r) for r in checkpoints.read_tiered(df, "json").collect()] == [("h", 3, "a", 2)]
    store = spark.createDataFrame([("a", "broken")], "conv_id string, json string")
    assert checkpoints.read_conversations(store, "json").first().messages == []


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "path string, v int")
    change = spark.createDataFrame([("b", 3), ("c", 4)], "path string, v int")
    assert sorted(map(tuple, writers.upsert(table, change, "path").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, writers.delete(table, change, "path").collect())) == [("a", 1)]
    pages = spark.createDataFrame([("s", 2, "two")], "source string, page_num int, text string")
    writers.write_markdown(pages, str(tmp_path / "md"))
    assert "<!-- Page 2 -->" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "md")).collect())


def test_stream(spark, tmp_path):
    rows = [("s", 1, "old", 3, 1), ("s", 1, "new", 3, 2), ("s", 2, "two", 1, 3)]
    schema = "source string, page_num int, text string, tier int, seq long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    query = stream.checkpoint_pages(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda batch, epoch: seen.extend((r.page_num, r.text, r.is_checkpoint) for r in batch.collect()), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert sorted(seen) == [(1, "new", True), (2, "two", False)]
