"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or v != v or str(v) == "<NA>":
        return None
    return round(v, 5) if isinstance(v, float) else v


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    assert rows
    if name in registry.ORACLE_SQL:
        want = duck.sql(registry.ORACLE_SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(rows, got.columns) == canon(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_texts(spark):
    """Page markers and questions over whole texts: no character of a document is left out of the input."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert max(map(len, texts.values())) > 10_000
    queries = entry.queries()
    for r in queries["strip_thinking_paged"](spark, SF).collect():
        assert r.cleaned.endswith("<!-- Page 3 -->" + texts[r.doc_id]) and texts[r.doc_id][: len(texts[r.doc_id]) // 2] in r.cleaned
    size = {}
    for r in queries["faq_split"](spark, SF).collect():
        size[r.doc_id] = size.get(r.doc_id, 0) + len(r.block)
    assert all(size[d] >= len(t.strip()) for d, t in texts.items())
    assert {r.doc_id for r in queries["faq_detect"](spark, SF).collect()} == set(texts)
