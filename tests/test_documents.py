"""The documents source: DOCX blocks, page readers, pushed filters."""

import io
import os
import shutil
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.operators import page_loop
from lectern.sources import documents as D
from lectern.sources import files
from tests import paged

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = f'<w:styles {NS}><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:type="character" w:styleId="H9"><w:name w:val="heading 3"/></w:style></w:styles>'


def docx(body, styles=STYLES):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {NS}><w:body>{body}</w:body></w:document>')
        if styles:
            z.writestr("word/styles.xml", styles)
    return out.getvalue()


def p(text, style=None):
    props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{props}<w:r><w:t>{escape(text)}</w:t></w:r></w:p>"


def cell(text, props=""):
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{''.join(p(t) for t in text.split(chr(10)))}</w:tc>"


TABLE = f"<w:tbl><w:tr>{cell('a')}{cell(' b')}</w:tr><w:tr>{cell('wide')}{cell('x')}</w:tr></w:tbl>"
MERGED = '<w:tbl><w:tr>{}{}</w:tr><w:tr>{}{}</w:tr></w:tbl>'.format(cell("two", '<w:vMerge w:val="restart"/>'), cell("r"), cell("", "<w:vMerge/>"), cell("s")) + "<w:tbl><w:tr>{}{}</w:tr></w:tbl>".format(cell("wide", '<w:gridSpan w:val="2"/>'), cell("l1\nl2"))
BODY = p("Title", "H1") + TABLE + p(" body ") + p("") + '<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>' + MERGED + p("last", "H9")
TEXT = "# Title\n\n body \n\na\tb\nlink\n\nlast\n\n| a | b |\n| wide | x |\n\n| two | r |\n| two | s |\n\n| wide | wide | l1\nl2 |"


def test_docx(spark, tmp_path):
    (tmp_path / "One.DOCX").write_bytes(docx(BODY))
    (tmp_path / "none.docx").write_bytes(docx("", None))
    (tmp_path / "skip.csv").write_text("x")
    got = D.read_documents(spark, str(tmp_path))
    assert {(r.source, r.text) for r in files.docx_text(got).collect()} == {("One.DOCX", TEXT)}
    assert [(r.kind, r.style) for r in got.where("block_pos in (0, 1)").orderBy("block_pos", "row_pos").collect()] == [("paragraph", "heading 1"), ("table", None), ("table", None)]
    assert files.load(spark, str(tmp_path)).collect() == [("One.DOCX", TEXT)]
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    with pytest.raises(Exception, match="no DOCX file"):
        D.read_documents(spark, str(tmp_path)).collect()
    assert D.read_documents(spark, str(tmp_path), broken="skip").select("source").distinct().count() == 1
    assert D.read_documents(spark, str(tmp_path)).where("source = 'One.DOCX'").count() == 10


@pytest.fixture
def opened():
    shutil.rmtree(paged.MARKS, ignore_errors=True)
    yield lambda: sorted(os.listdir(paged.MARKS)) if os.path.isdir(paged.MARKS) else []
    shutil.rmtree(paged.MARKS, ignore_errors=True)


def test_pages_in_ranges_and_unopened_files(spark, tmp_path, opened):
    for n in ("alpha", "beta"):
        (tmp_path / f"{n}.pdf").write_text("\f".join(f"{n} page {k} of it" for k in range(1, 6)))
    (tmp_path / "c.docx").write_bytes(b"never read")
    read = lambda **k: D.read_documents(spark, str(tmp_path), reader_pdf="tests.paged:Pages", **k)
    one = read(partBytes="10", rangePages="2").where((F.col("ext") == ".pdf") & F.col("source").startswith("al"))
    assert one.rdd.getNumPartitions() >= 3
    rows = one.select("block_pos", "text").orderBy("block_pos").collect()
    assert [r.text for r in rows] == [f"alpha page {k} of it" for k in range(1, 6)]
    assert opened() == ["alphapage1-1-2", "alphapage1-3-4", "alphapage1-5-5"]
    assert read().where("source in ('beta.pdf', 'x')").count() == 5 and read().where("source like '%ta.pdf' and text like '%page 2%'").count() == 1
    # Into the page loop.
    out = page_loop.transcribe_calling(D.pages(read().where("ext = '.pdf'")), spark.createDataFrame([], "source string, page_num int, text string, tier int"), lambda key, item: f"seen {item}", ["k"], str(tmp_path / "out"))
    got = {(r.source, r.page_num): (r.tier, r.text) for r in out.collect()}
    assert len(got) == 10 and got["alpha.pdf", 2] == (3, "seen alphapage12") and got["beta.pdf", 1][0] == 3
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("documents").load().collect()


def test_query_against_python(spark):
    d = "/root/testdata/sf0.001"
    expected = {(f"{r.doc_id}.docx", "\n\n".join(x for x in r.text.split("\n") if x.strip())) for r in spark.read.parquet(f"{d}/documents.parquet").collect() if r.text and r.text.strip()}
    got = entry.queries()["docx_documents"](spark, d).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_rows_come_in_batches_and_lines_meet_once(spark, tmp_path):
    (tmp_path / "One.DOCX").write_bytes(docx(BODY))
    (tmp_path / "long.docx").write_bytes(docx("".join(p(f"line {n}") for n in range(D.BATCH_ROWS + 7)), None))
    reader = D.DocumentReader({"path": str(tmp_path)})
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert [b.num_rows for b in batches] == [D.BATCH_ROWS, 17]
    got = files.docx_text(D.read_documents(spark, str(tmp_path)))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {tuple(r) for r in got.collect()} == {("One.DOCX", TEXT), ("long.docx", "\n\n".join(f"line {n}" for n in range(D.BATCH_ROWS + 7)))}


def test_lines_without_cells(spark):
    rows = [("a", 2, 1, "table", None, None, ["x"]), ("a", 2, 0, "table", None, None, None), ("a", 2, 2, "table", None, None, ["y", "z"]), ("a", 3, 0, "table", None, None, None), ("a", 4, 0, "table", None, None, ["end"]), ("a", 9, 0, "paragraph", None, "first", None)]
    blocks = spark.createDataFrame(rows, "source string, block_pos int, row_pos int, kind string, style string, text string, cells array<string>")
    assert files.docx_text(blocks).collect() == [("a", "first\n\n| x |\n| y | z |\n\n\n\n| end |")]
