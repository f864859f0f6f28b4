"""An index that grows against one built anew; the pair scorer."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.operators import retrieval as R
from lectern.operators import scoring, segments

CHUNK, VECTOR, QUERY = "chunk_id long, source string, title string, text string", "chunk_id long, embedding array<double>", "query_id long, text string, embedding array<double>"
WORDS = "alpha beta gamma delta common".split()


def chunk(n, extra=""):
    return (n, f"s{n % 2}", f"Title {n}", f"common {WORDS[n % 4]} {WORDS[n % 3]} {extra} " + "pad " * (n % 7))


def vector(n):
    return (n, [1.0 / (n + 2), 1.0])


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_grown_equals_built(spark, tmp_path):
    index = segments.GrowingIndex(spark, str(tmp_path / "grown"))
    chunks, vectors, ids = (lambda ns, x="": spark.createDataFrame([chunk(n, x) for n in ns], CHUNK)), (lambda ns: spark.createDataFrame([vector(n) for n in ns], VECTOR)), (lambda *ns: spark.createDataFrame([(n,) for n in ns], "chunk_id long"))
    queries = spark.createDataFrame([(1, "alpha common rare", [1.0, 0.0]), (2, "fresh pad", None), (3, "gone", [0.6, 0.8])], QUERY)

    def same(ns, fresh=()):
        built = spark.createDataFrame([chunk(n, "fresh" if n in fresh else "") for n in ns], CHUNK)
        there = R.build_index(built, vectors(ns), str(tmp_path / uuid.uuid4().hex))
        now = index.open()
        assert rows(R.bm25(queries, now)) == rows(R.bm25(queries, there))
        assert rows(R.hybrid_search(queries, now, None, "s1", min_score=0.0)) == rows(R.hybrid_search(queries, there, None, "s1", min_score=0.0))
        assert rows(now.corpus) == rows(there.corpus)
        df = lambda i: {r.term: (r.df, round(r.idf, 9)) for r in i.terms.collect()}
        assert df(now) == df(there)

    with pytest.raises(FileNotFoundError):
        index.open()
    index.delete(ids(1))
    index.merge()
    index.add(chunks(range(20), "gone"), vectors(range(20)))
    index.add(chunks(range(12, 30)).unionByName(chunks([12])), vectors(range(12, 30)))
    index.add(chunks(range(12)), vectors(range(12)))
    same(range(30))  # no chunk has the word "gone" any more, and the vocabulary neither
    index.delete(ids(3, 25, 99))
    left = [n for n in range(30) if n not in (3, 25)]
    same(left)
    index.add(chunks([3, 5], "fresh"), vectors([3, 5]))
    index.merge()
    same(sorted([*left, 3]), fresh=(3, 5))
    assert len(index._manifest()[0]["segments"]) == 1


def test_the_second_of_two_writers_is_told(spark, tmp_path):
    index, late = segments.GrowingIndex(spark, str(tmp_path)), segments.GrowingIndex(spark, str(tmp_path))
    add = lambda i, n: i.add(spark.createDataFrame([chunk(n)], CHUNK), spark.createDataFrame([vector(n)], VECTOR))
    add(index, 1)
    before = late._manifest()
    add(index, 2)
    late._manifest = lambda: before
    with pytest.raises(segments.Changed):
        add(late, 3)
    assert sorted(r.chunk_id for r in index.open().chunks.collect()) == [1, 2]


def test_queries_agree(spark):
    d, q = "/root/testdata/sf0.001", entry.queries()
    assert rows(q["grown_bm25_topk"](spark, d)) == rows(q["bm25_topk"](spark, d))
    assert rows(q["grown_hybrid_search"](spark, d)) == rows(q["hybrid_search"](spark, d)) == rows(q["model_hybrid_search"](spark, d))


def test_pair_scorer(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        def mark(kind, n):
            with open(f"{folder}/{kind}-{n}-{uuid.uuid4().hex}", "w"):
                pass

        mark("load", 0)

        def model(pairs):
            mark("batch", len(pairs))
            return [len(q) * 100 + len(t) for q, t in pairs]

        return model

    df = spark.range(50).coalesce(1).select("id", F.repeat(F.lit("q"), F.col("id").cast("int")).alias("q"), F.when(F.col("id") % 5 > 0, F.repeat(F.lit("t"), (F.col("id") % 5).cast("int"))).alias("t"))
    scored = df.withColumn("raw", scoring.pair_scorer(load)("q", "t"))
    out = scored.where("raw > 100").withColumn("twice", F.col("raw") + F.col("raw")).collect()
    assert sorted((r.id, r.raw, r.twice) for r in out) == [(n, n * 100 + n % 5, 2 * (n * 100 + n % 5)) for n in range(1, 50) if n * 100 + n % 5 > 100]
    names = [x.split("-")[:2] for x in os.listdir(folder)]
    assert sorted(int(n) for kind, n in names if kind == "batch") == [2, 16, 16, 16] and names.count(["load", "0"]) == 1
    # Another task of the same worker finds the model there.
    short = spark.range(3).coalesce(1).select(F.lit("q").alias("q"), F.lit("t").alias("t"))
    with pytest.raises(Exception, match="scores for"):
        short.select(scoring.pair_scorer(lambda: lambda pairs: [1.0])("q", "t")).collect()
