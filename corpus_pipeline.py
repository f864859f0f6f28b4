"""The corpus pipeline: five stages from documents to token files, each on what its predecessor kept.

Every stage takes documents (doc_id, text, lang, source, n_chars, and any other columns) and, but for
the last, returns rows with the same columns. Nulls in any column, empty and very long texts, repeated
rows, ties, empty tables and columns named like a result are defined by each stage as its operator
defines them; none of these fails, and an empty table goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontaminate, mixing, near_dup, quality_model, token_files
from lectern.llm.common import Written, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model keeps.

    Null and empty texts have the statistics of no words and are judged by these and their site; rows
    without an id have no label. Equal rows are judged alike. Columns of docs named quality,
    own_quality, path_quality or kept pass unchanged.
    """
    same = ["quality", "own_quality", "path_quality", "kept"]
    names = {c: f"_doc_{c}" for c in docs.columns if c.lower() in same}
    kept = quality_model.classify(docs.withColumnsRenamed(names), table(spark, sf_dir, "labels")).where("kept")
    return kept.select(*[kept[names.get(c, c)].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id.

    Texts without words are no duplicates and all stay. Of rows equal in id and text one stays; rows
    without an id link like others, and one of a group of such rows alone stays.
    """
    return near_dup.distinct_documents(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; null and empty texts hold none and stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them; null sources are one source, empty texts add no words."""
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder; a row per document read back from them.

    Null ids come first, repeated rows are written as often as they occur, a null or empty text is
    its end id. An empty table writes no file.
    """
    import public_tokenizers

    return token_files.tokens_to_files(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mixing),
    ("token output", token_output),
]

#: The quality model and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each result written and read again."""
    docs, keep = table(spark, sf_dir, "documents"), Written(spark, "pipeline").keep
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = keep(docs)
    return docs
