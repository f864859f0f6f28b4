"""Benchmark decontamination: an Aho-Corasick automaton over normalised benchmark texts.

Items and documents are normalised alike: ASCII letters in lower case, words of ASCII letters and
digits and of anything beyond ASCII. A window is ten consecutive words of an item, or all words of
a shorter one. The automaton holds every window as a sequence of word numbers, and a document is
scanned once; hits are kept by word and mapped back to offsets in the original text.

The benchmark is the query set. Up to ``BLOCK`` windows are one automaton, and a text is read once,
one text's words in memory at a time. A larger benchmark goes to the workers in blocks of about that
many windows, each an automaton; a worker holds one, and texts are gathered up to ``GATHER``
characters, over which the automata pass in turn. Documents are never shuffled.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, only, small_batches, table, text_or_empty

WINDOW = 10
BLOCK = 100_000
#: Characters of texts that a worker holds where there are several blocks.
GATHER = 16_000_000
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ORIGINAL = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def windows(item: list[bytes]) -> list[tuple[bytes, ...]]:
    if not item:
        return []
    return [tuple(item[i : i + WINDOW]) for i in range(max(1, len(item) - WINDOW + 1))]


class Matcher:
    """The automaton of one block: (item id as a string, words) rows."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple, set[str]] = {}
        for item, item_words in items:
            for window in windows(item_words):
                owners.setdefault(tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window), set()).add(item)
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, ids in owners.items():
            self.found.add_word(key, (len(key), ids))
        if owners:
            self.found.make_automaton()
        self.empty = not owners

    def scan(self, text: list[bytes], hit: set[int], items: set[str]) -> None:
        """Add the hit words' positions and the items found."""
        if self.empty or not text:
            return
        numbers = tuple(map(self.numbers.get, text, repeat(0)))
        for end, (length, ids) in self.found.iter(numbers):
            hit.update(range(end - length + 1, end + 1))
            items |= ids


def spans(text: str, hit: set[int]) -> list[dict]:
    """Runs of hit words as [start, end) offsets in code points of the original text."""
    out: list[dict] = []
    last = -2
    for k, match in enumerate(_ORIGINAL.finditer(text)):
        if k in hit:
            if k == last + 1:
                out[-1]["end"] = match.end()
            else:
                out.append({"start": match.start(), "end": match.end()})
            last = k
    return out


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark in blocks of about ``block`` windows; one block is on the driver at a time."""
    rows, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), text_or_empty()).toLocalIterator():
        item = words(row[1])
        rows.append((row[0], item))
        size += max(1, len(item) - WINDOW + 1)
        if size >= block:
            yield rows
            rows, size = [], 0
    yield rows


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, spans array<struct<start:int,end:int>>"


def scan(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, result: str = "_leak") -> DataFrame:
    """docs with the struct column ``result``: n_words, n_hit, n_items, items_sha256, items, spans.

    docs has text, benchmark item_id and text; all rows and other columns of docs stay, but one named
    like the result gives way. Null, empty and word-less texts and items match nothing; an empty
    benchmark matches nothing, an empty docs gives no rows. Very long texts are read whole, alone.
    Repeated item ids count once; items without an id count as one, named null. Overlapping windows
    hit a word once. Repeated rows get equal results.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blocks = [(uuid.uuid4().hex, spark.sparkContext.broadcast(rows)) for rows in _blocks(benchmark, block)]

    def found(texts: list[str | None]) -> list[tuple]:
        hits: list[set[int]] = [set() for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        counts = [0] * len(texts)
        for name, part in blocks:
            matcher = only(name, lambda part=part: Matcher(part.value))
            for k, text in enumerate(texts):
                split = words(text)
                counts[k] = len(split)
                matcher.scan(split, hits[k], items[k])
        rows = []
        for text, n, hit, some in zip(texts, counts, hits, items, strict=True):
            ids = sorted(some, key=lambda x: x.encode())
            rows.append((n, len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), ids, spans(text, hit) if hit else []))
        return rows

    @F.pandas_udf(RESULT)
    def leak(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                size += int(batch.str.len().sum())
            if held and (batch is None or len(blocks) == 1 or size >= GATHER):
                yield pd.DataFrame(found([x for one in held for x in one]), columns=["n_words", "n_hit", "n_items", "items_sha256", "items", "spans"])
                held, size = [], 0

    return docs.withColumn(result, leak(F.col("text")))


def clean(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs, whatever their columns, in which no window of the benchmark occurs."""
    result = free_name(docs, "_leak")
    return scan(docs, benchmark, block, result).where(F.col(result).getField("n_hit") == 0).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "_leak.*")
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (SELECT DISTINCT item, w[i:i + least(len(w), 10) - 1] AS x, least(len(w), 10) AS n
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT rid, n, i, w[i:i + n - 1] AS x
        FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT rid, i, pos.n AS n, item FROM pos JOIN win ON pos.x = win.x AND pos.n = win.n),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM m GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
