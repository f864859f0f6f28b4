"""The pipeline's stages on a small corpus, each against what brute force says of its input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import decontaminate, near_dup

from .test_operators import DOCS, groups, leak, quality_rows, sentence


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rng = random.Random(11)
    rows = quality_rows(300)
    rows += [(1000 + i, r[1] + " tail", *r[2:]) for i, r in enumerate(rows[1:40])]
    item = sentence(rng, 25)
    rows += [(2000 + i, sentence(rng, 100) + " " + item + " " + sentence(rng, 50), "en", "s1", 1) for i in range(5)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        out = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        seen[name] = [tuple(r) for r in docs.collect()], [tuple(r) for r in out.collect()]
        docs = out
    before, after = seen["quality classifier"]
    ids = {r[0] for r in after}
    assert sum(i in ids for i in range(300) if i % 10) > 260 and sum(i in ids for i in range(0, 300, 10)) < 3
    before, after = seen["minhash near-dedup"]
    assert {r[0] for r in after} == {c for _, _, c in groups(before)} and len(after) < len(before)
    before, after = seen["benchmark decontamination"]
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()
    assert {r[0] for r in after} == {r[0] for r in before if leak(r[1], [tuple(item)])[1] == 0} and len(after) < len(before)
    before, after = seen["mixing sources"]
    words = lambda rows: sum(len(r[1].split()) for r in rows)
    assert {r[0] for r in after} <= {r[0] for r in before} and abs(words(after) - words(before)) < 0.05 * words(before)
    assert len(seen["token output"][1]) == len(after)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert near_dup.THRESHOLD == 0.75 and decontaminate.WINDOW == 10


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_odd_columns(spark, sf_dir):
    """Columns named like results or inner names pass every stage with their values; rows of nulls and repeated rows break none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(2)).unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "", None, "s0", 0)], DOCS))
    for name in ("kept", "Quality", "_leak", "_row", "_id", "node", "taken", "_label", "n", "s"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert out.where("kept <> 'own kept' or Quality <> 'own Quality' or _leak <> 'own _leak' or _row <> 'own _row' or node <> 'own node' or _label <> 'own _label'").count() == 0
        assert 0 < out.count() <= 2 * docs.count()
    assert corpus_pipeline.token_output(spark, docs, sf_dir).count() == docs.count()
