"""Line dedup: every repeated run of lines goes, but at its first place.

A run is a stretch of lines with two that are not blank at least, or one line of more than LONG
words. It is repeated where the same bytes occur earlier, by doc_id and position, without
overlapping it. A longer run is repeated only if each of its pairs of neighbouring lines is, so these
pairs, and long lines, are the seeds: repeated seeds next to each other, with their first places next
to each other as well, grow to the whole shared run. What is removed is what brute force over all
runs would remove; there is no boundary that a passage could miss, as there is with chunks that a
rolling hash over the lines' hashes cuts.

Seeds travel as digests. Copies of a digest are found by grouped aggregation, the first place's
bytes are fetched once per distinct run, and a line goes only if its bytes are equal. A digest or
run with a large share of all rows is dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, hot_join, packed, text_or_empty

#: A line of more words is a run by itself.
LONG = 50
#: Keys are broadcast to filter texts up to this many; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: Rows whose lines are in memory together.
ROWS = 500


def _key(doc_id, text: str) -> bytes:
    """What tells documents apart: rows equal in id and text are one."""
    import hashlib

    return hashlib.md5(f"{'' if doc_id is None else doc_id}:{text}".encode()).digest()


def _key_column():
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_or_empty()).cast("binary")))


def seeds(lines: list[str]) -> list[tuple[int, int]]:
    """(position, lines) of each two neighbours that are not blank, with what is between, and of each long line."""
    out, last = [], None
    for k, line in enumerate(lines):
        if not line.strip():
            continue
        if last is not None:
            out.append((last, k - last + 1))
        if len(line) > 2 * LONG and len(line.split()) > LONG:
            out.append((k, 1))
        last = k
    return out


def _seeds(batches):
    import pyarrow as pa
    import xxhash

    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            some, rows = batch.slice(lo, ROWS), []
            for i, text in enumerate(some.column("text").to_pylist()):
                lines, own = text.split("\n"), set()
                for k, n in seeds(lines):
                    digest = xxhash.xxh3_128_digest("\n".join(lines[k : k + n]).encode("utf-8", "surrogatepass"))
                    if digest not in own:
                        own.add(digest)
                        rows.append((i, k, n, digest))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([some.column("doc").take(at), some.column("key").take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.binary())], names=["doc", "key", "pos", "n", "digest"])


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A document's repeated seeds, grown together where they overlap or touch here and at their first places."""
    for batch in batches:
        rows = []
        for key, some in zip(batch["key"], batch["seeds"], strict=True):
            begin = end = diagonal = None
            for first, shift, pos, n in sorted((x["first_key"], x["first_pos"] - x["pos"], x["pos"], x["n"]) for x in some):
                if diagonal == (first, shift) and pos <= end:
                    end = max(end, pos + n)
                    continue
                if diagonal is not None:
                    rows.append((key, begin, end - begin, diagonal[0], begin + diagonal[1]))
                begin, end, diagonal = pos, pos + n, (first, shift)
            rows.append((key, begin, end - begin, diagonal[0], begin + diagonal[1]))
        yield pd.DataFrame(rows, columns=["key", "pos", "n", "first_key", "first_pos"])


def _fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of the places in each text."""
    for batch in batches:
        rows = []
        for text, key, at in zip(batch["text"], batch["key"], batch["places"], strict=True):
            lines = text.split("\n")
            rows += [(key, p["first_pos"], p["n"], "\n".join(lines[p["first_pos"] : p["first_pos"] + p["n"]])) for p in at]
        yield pd.DataFrame(rows, columns=["_key", "_pos", "_n", "bytes"])


def repeated(lines: list[str], runs: list[tuple[int, list[str]]]) -> list[bool]:
    """Whether each line goes. runs: positions, and the lines that earlier documents have there."""
    mine = seeds(lines)
    at: dict[int, list[int]] = {}
    for k, n in mine:
        at.setdefault(k, []).append(n)
    elsewhere = set()
    for pos, there in runs:
        equal = [a == b for a, b in zip(lines[pos : pos + len(there)], there)]
        for k in range(pos, pos + len(equal)):
            elsewhere |= {(k, n) for n in at.get(k, ()) if k + n <= pos + len(equal) and all(equal[k - pos : k - pos + n])}
    first: dict[str, int] = {}
    gone = [False] * len(lines)
    for k, n in mine:
        begin = first.setdefault("\n".join(lines[k : k + n]), k)
        if (begin, n) in elsewhere or k >= begin + n:
            gone[k : k + n] = [True] * n
    return gone


RESULTS = ("n_lines", "n_removed_lines", "n_removed_chunks")


def dedup_runs(docs: DataFrame) -> DataFrame:
    """docs with text replaced, and n_lines, n_removed_lines, n_removed_chunks (stretches removed).

    docs has doc_id, of any type that orders, and text; other columns stay, whatever their names, but
    those named like a result give way. Null and empty texts stay as they are and lose nothing; very
    long texts are read whole. Single lines of LONG words at most are never removed, and the first
    place of a line always stays. Rows equal in id and text are one document and treated alike; null
    ids come after all others, and documents equal in id are ordered by a digest of their text. An
    empty table gives an empty result.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULTS])
    keep = Written(docs.sparkSession, "runs").keep
    slim = docs.select(F.col("doc_id").alias("doc"), _key_column().alias("key"), text_or_empty().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = keep(slim.mapInArrow(_seeds, f"doc {kind}, key binary, pos int, n int, digest binary"))
    order = F.struct(F.col("doc").isNull().alias("n"), "doc", "key", "pos")
    first = found.groupBy("digest").agg(F.min(order).alias("at"), F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi")
    first = keep(first.select(F.col("digest").alias("_d"), F.col("at.key").alias("first_key"), F.col("at.pos").alias("first_pos")))
    copies = hot_join(found.select("key", "pos", "n", "digest"), ["digest"], first, ["_d"], found.count()).where("key <> first_key")
    copies = copies.groupBy("key").agg(F.collect_set(F.struct("pos", "n", "first_key", "first_pos")).alias("seeds"))
    runs = keep(copies.mapInPandas(_runs, "key binary, pos int, n int, first_key binary, first_pos int"))

    # The bytes at the first places.
    places = keep(runs.select("first_key", "first_pos", "n").distinct().groupBy("first_key").agg(F.collect_list(F.struct("first_pos", "n")).alias("places")))
    ids = places.select(F.col("first_key").alias("_k"))
    ids = F.broadcast(ids) if places.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids
    holders = slim.select("key", "text").join(ids, F.col("key") == F.col("_k"), "left_semi")
    bytes_ = holders.join(places, F.col("key") == F.col("first_key")).select("key", "text", "places").mapInPandas(_fetch, "_key binary, _pos int, _n int, bytes string")
    bytes_ = keep(bytes_.dropDuplicates(["_key", "_pos", "_n"]))
    gone = hot_join(runs, ["first_key", "first_pos", "n"], bytes_, ["_key", "_pos", "_n"], runs.count())
    gone = gone.groupBy(F.col("key").alias("_k")).agg(F.collect_list(F.struct("pos", "bytes")).alias("_gone"))

    def rewrite(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, gones in batches:
            rows = []
            for text, gone_ in zip(texts, gones, strict=True):
                lines = text.split("\n")
                n = len(lines) if text else 0
                mine = [(p["pos"], p["bytes"].split("\n")) for p in gone_] if gone_ is not None else []
                if not mine and len(set(lines)) == n:
                    rows.append((text, n, 0, 0))
                    continue
                out = repeated(lines, mine)
                kept = "".join(x + ("\n" if k < len(lines) - 1 else "") for k, x in enumerate(lines) if not out[k])
                rows.append((kept, n, sum(out), sum(x and not (k and out[k - 1]) for k, x in enumerate(out))))
            yield pd.DataFrame(rows, columns=["text", *RESULTS])

    udf = F.pandas_udf(rewrite, "text string, n_lines long, n_removed_lines long, n_removed_chunks long")
    out = packed(docs).withColumn("_key", _key_column()).join(gone, F.col("_key") == F.col("_k"), "left")
    out = out.withColumn("_out", udf(text_or_empty(), F.col("_gone")))
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("_out.text"))
    return out.select(*[text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns], *[f"_out.{c}" for c in RESULTS])


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = dedup_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *RESULTS, F.crc32(text_or_empty().cast("binary")).alias("text_crc32"))
