"""Text expressions on small fixtures."""

import base64

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first()["y"]


@pytest.mark.parametrize("line,expected", [("4.4.1 EOP Flow", False), ("4.4.1 Flow of It", True), ("1.8 L (approx. 12 cups)", False), ("3.3 V input", False), ("1. Title", False), ("7.5 Goods Receipt", True)])
def test_section_line(spark, line, expected):
    assert one(spark, T.is_section_line("x"), line) is expected


@pytest.mark.parametrize("line,expected", [("ASSET DECLARATION FORM", True), ("RM 45000.00", False), ("GENERAL OFFICE", False), ("SAP ID XXUE/180018", False), ("CHECKLIST - END OF PROJECT (EOP)", True)])
def test_form_title(spark, line, expected):
    assert one(spark, T.is_form_title("x", ("general office",)), line) is expected


def test_strip_thinking(spark):
    assert one(spark, T.strip_thinking("x"), "a<think x>b</think >c<THINK>zz\nq") == "ac"
    assert one(spark, T.strip_thinking("x"), None) == ""
    assert one(spark, T.strip_thinking_paged("x"), "<think>x<!-- Page 2 -->y") == "<!-- Page 2 -->y"
    assert one(spark, T.strip_thinking_paged("x"), "a<think <!-- Page 2 -->b>c") == "a<think <!-- Page 2 -->b>c"


def test_faq(spark):
    assert one(spark, T.is_faq("x"), "Intro\n\n1. A b?\n\nans\n\n2. C d?\nans\n") is True
    assert one(spark, T.is_faq("x"), "1. A b?\nans\n2. C d?") is False
    assert one(spark, T.faq_question("x"), "3. What  is\nthis? More?") == "What is this?"


def test_titles(spark):
    title = T.chunk_title("x", F.lit("src"), ("letterhead",))
    assert one(spark, title, "x\n## Head  \n7.5 Own Heading") == "Head"
    assert one(spark, title, 'x\n* "7.5 Own Heading"') == "7.5 Own Heading"
    assert one(spark, title, "**List:**\n**Section 3:** b") == "Section 3"
    assert one(spark, title, "a\n**List:** b") == "List"
    assert one(spark, title, "LETTERHEAD\n<!-- Page 1 -->\n#### \n" + "y" * 100) == "y" * 100
    assert one(spark, title, "LETTERHEAD\n" + "y" * 100) == "y" * 80
    assert one(spark, title, " \n") == "src"


def test_tokens_and_names(spark):
    assert one(spark, T.tokens("x"), "RM500, é 3.1.1") == ["rm500", "3", "1", "1"]
    assert one(spark, T.safe_filename("x"), "../a b?.pdf") == "a b_.pdf"
    assert one(spark, T.safe_filename("x"), "") == "upload"
    assert one(spark, T.extension("x"), "d.x/a.PDF") == ".pdf"
    assert one(spark, T.extension("x"), ".bashrc") == ""
    assert one(spark, T.extension("x"), "a.") == "."
    assert one(spark, T.stem("x"), "a.b.md") == "a.b"
    assert one(spark, T.has_body("x"), "6.6.1 Virement Flow 77") is False
    assert one(spark, T.has_body("x"), "head\nten chars!") is True


@pytest.mark.parametrize("question,expected", [("what about step 2?", True), ("Then, what are the seven stages of it", True), ("How do I apply for a grant extension today?", False), ("", True)])
def test_followup(spark, question, expected):
    assert one(spark, T.is_followup("x"), question) is expected


def test_snippet_and_percentage(spark):
    text = "a" * 150 + "\nNEEDLE" + "b" * 300
    assert one(spark, T.snippet("x", "needle"), text) == "a" * 99 + " NEEDLE" + "b" * 200
    assert one(spark, T.snippet("x", "absent"), text) is None
    for v in (0.0625, 0.5625, 0.333, 1.0, 0.0):
        assert one(spark, T.percentage(F.lit(v)), "") == f"{v * 100:.1f}%"


def test_base64_is_one_line(spark):
    text = "https://www.example.org/" + "ä" * 300
    assert one(spark, T.base64_text("x"), text) == base64.b64encode(text.encode()).decode()
    assert one(spark, T.text_of_base64(T.base64_text("x")), text) == text


def test_own_headings_look_at_few_lines(spark):
    texts = ["\n \n<!-- Page 3 -->\n GENERAL OFFICE \r\n\tFirst line \nsecond", "a\n - \"4.2 Heading Of It\"\nb", "x\n**bold one**\n**bold 2:**\n", "<!-- Page\n1 -->\nz", " \n<!-- Page 1 -->\n", "## \n1.2.3 Some Part\n"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "x string").coalesce(1).select(T.chunk_title("x", F.lit("src"), ("general office",)).alias("t")).collect()]
    assert got == ["First line", "4.2 Heading Of It", "bold 2", "<!-- Page", "src", "1.2.3 Some Part"]
    plan = spark.range(1).select(F.lit("x").alias("x")).select(T.own_heading("x").alias("t"))._jdf.queryExecution().analyzed().toString()
    assert "split(" not in plan  # no text is cut into all of its lines
