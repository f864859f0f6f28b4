"""Suffix-array dedup: every byte that a repeated string of ``length`` bytes covers goes.

A window is a start of ``length`` bytes; it is repeated if the same bytes start anywhere else. Sorting
a tuple for each suffix of the corpus would move many times the corpus through the shuffle, so the
suffixes are sampled first, as induced sorting does: a window's anchor is its place of least hash (of
``context`` bytes), which depends on the window's bytes alone, so equal windows have equal anchors at
the same distance. The windows of one anchor are neighbours, and their stretch of text travels as two
digests: that of the bytes all its windows hold (the anchor's key) and that of all its bytes.

* A key that occurs once settles its windows: none is repeated.
* A stretch that occurs twice settles its windows: all are.
* What is left (the edges of repeated passages) is cut into ranges of windows by their distance from
  the anchor, with the same two digests and the same two rules. Windows that these leave open are
  settled by induced sorting within the windows' common bytes: Spark's sort, which spills to disk, delivers
  the anchors' suffixes in order, and the order of the suffixes that begin further left is induced from it
  byte by byte, by the byte before and the rank so far, with the common prefix of neighbours carried
  along. A common string with more than ``group`` holders is not sorted in one task: its ranges are cut
  smaller, down to single windows, whose digests are counted.

Counts are partial aggregations and joins deal hot keys over tasks, so no passage is gathered,
however often it occurs. Equality of stretches is that of 128-bit digests; keys may collide and only cost time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, Written, hot_join, table

#: Bytes of a repeated string, and of an anchor's context.
LENGTH, CONTEXT = 400, 64
#: Windows of a range, coarse to fine; the last has to be 1.
WIDTHS = (48, 8, 1)
#: Holders of a common string that one task sorts at most; tuples that it sorts together.
GROUP, TOGETHER = 1_000, 20_000
#: Windows of a text that are in memory together.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
RESULTS = ("n_bytes", "spans", "kept")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Anchors:
    """Stretches of windows that share an anchor."""

    def __init__(self, length: int, context: int, chunk: int = CHUNK):
        self.length, self.context, self.chunk = length, context, chunk
        self.up = self.down = np.zeros(0, np.uint64)

    def _hashes(self, b: np.ndarray) -> np.ndarray:
        """A mixed hash of the context bytes from each position."""
        if len(b) > len(self.up):
            size = min(max(1 << 16, 2 * len(b)), self.chunk + self.length)
            self.up, self.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.up[: len(b)], dtype=np.uint64)])
            h = (sums[self.context :] - sums[: -self.context]) * self.down[: len(b) - self.context + 1]
            for shift in (32, 29):
                h ^= h >> np.uint64(shift)
                h *= np.uint64(0xBF58476D1CE4E5B9)
            return h ^ (h >> np.uint64(32))

    def __call__(self, text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Arrays (first window, windows, distance of the anchor from the first, key), chunk by chunk of the text."""
        whole = np.frombuffer(text, np.uint8)
        for lo in range(0, len(whole) - self.length + 1, self.chunk):
            b = whole[lo : lo + self.chunk + self.length - 1]
            n, m = len(b) - self.length + 1, self.length - self.context + 1
            h = self._hashes(b)
            mask = np.uint64((1 << 21) - 1)
            v = np.full(-(-len(h) // m) * m, np.iinfo(np.uint64).max, np.uint64)
            v[: len(h)] = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
            v = v.reshape(-1, m)
            before, after = np.minimum.accumulate(v, axis=1).ravel(), np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
            at = (np.minimum(after[:n], before[m - 1 : m - 1 + n]) & mask).astype(np.int64)
            first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
            yield lo + first, np.diff(np.append(first, n)), at[first] - first, h[at[first]].view(np.int64)


def _stretches(length: int, context: int):
    def run(batches):
        import pyarrow as pa
        import xxhash

        anchors = Anchors(length, context)
        names = ["key", "digest", "t", "s", "n", "l"]
        for batch in batches:
            for t, text in zip(batch.column("t").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                view = memoryview(text)
                for s, n, at, key in anchors(text):
                    digests = [xxhash.xxh3_128_digest(view[a : a + k + length - 1]) for a, k in zip(s.tolist(), n.tolist(), strict=True)]
                    same = pa.array([t], pa.binary()).take(pa.array(np.zeros(len(s), np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(digests, pa.binary()), same, pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))], names=names)

    return run


def _cut_out(length: int):
    """The bytes of stretches of a text; a text that a task meets again is passed over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for batch in batches:
            rows = []
            for t, text, some in zip(batch["t"], batch["text"], batch["some"], strict=True):
                if t not in seen:
                    seen.add(t)
                    rows += [(x["key"], x["digest"], x["count"], x["l"], text[x["s"] : x["s"] + x["n"] + length - 1]) for x in some]
            for lo in range(0, len(rows), 5000):
                yield pd.DataFrame(rows[lo : lo + 5000], columns=["key", "digest", "count", "l", "bytes"])

    return run


def _ranges(length: int, width: int):
    """Ranges of windows of rows (g, l, bytes, lo, hi): those of distances lo to hi, cut at multiples of width."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            rows = []
            for g, sure, key, at, bytes_, lo, hi in zip(batch["g"], batch["sure"], batch["key"], batch["l"], batch["bytes"], batch["lo"], batch["hi"], strict=True):
                view = memoryview(bytes_)
                for r in range(lo // width, hi // width + 1):
                    a, b = max(lo, r * width), min(hi, r * width + width - 1)
                    inner = xxhash.xxh3_64_intdigest(view[at - r * width : at - r * width - width + 1 + length], key & 0xFFFFFFFF)
                    inner = (inner ^ (r * 0x9E3779B97F4A7C15)) & (2**64 - 1)
                    # Stretches are equal only where their ranges are, too.
                    outer = xxhash.xxh3_128_digest(view[at - b : at - a + length], (a << 16) | b)
                    rows.append((g, sure, a, b, inner - 2**64 if inner >= 2**63 else inner, outer))
            yield pd.DataFrame(rows, columns=["g", "sure", "lo", "hi", "inner", "outer"])

    return run


def _suffixes(length: int, width: int):
    """Suffix tuples: from the range's first distance to the right, and the bytes before it, nearest first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for inner, g, lo, hi, open_, at, bytes_ in zip(batch["inner"], batch["g"], batch["lo"], batch["hi"], batch["open"], batch["l"], batch["bytes"], strict=True):
                base = lo // width * width
                x = at - base
                rows.append((inner, g, base, lo - base, hi - base, open_, bytes_[x : at - lo + length], bytes_[at - hi : x][::-1]))
            yield pd.DataFrame(rows, columns=["inner", "g", "base", "near", "far", "open", "suffix", "before"])

    return run


def induce(group: np.ndarray, suffixes: list[bytes], before: list[bytes], far: np.ndarray, width: int, length: int) -> np.ndarray:
    """For tuples in the order of (group, suffix): whether the window k bytes further left (a column) has an equal in its group.

    The order of the suffixes from k + 1 bytes further left is that of the suffixes from k by the byte before
    them, equal bytes as they stood; the common prefix of two neighbours is one more than the least between
    them before. A tuple leaves when its bytes are used up (far).
    """
    n = len(group)
    right, lengths = np.zeros((n, length), np.uint8), np.array([len(x) for x in suffixes])
    left = np.zeros((n, width), np.uint8)
    for i, (a, b) in enumerate(zip(suffixes, before, strict=True)):
        right[i, : len(a)], left[i, : len(b)] = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    common = np.zeros(n + 1, np.int64)  # with the one before; none at either end
    if n > 1:
        other = right[1:] != right[:-1]
        most = np.minimum(lengths[1:], lengths[:-1])
        common[1:n] = np.where(group[1:] == group[:-1], np.minimum(np.where(other.any(axis=1), other.argmax(axis=1), length), most), 0)
    order, equal = np.arange(n), np.zeros((n, width), bool)
    for k in range(width):
        with_last = common >= length
        equal[order, k] = with_last[:-1] | with_last[1:]
        stay = np.flatnonzero(far[order] > k)
        if k == width - 1 or not len(stay):
            break
        kind = group[order[stay]] * 256 + left[order[stay], k]
        by = np.argsort(kind, kind="stable")
        stay, kind = stay[by], kind[by]
        new = np.zeros(len(stay) + 1, np.int64)
        pairs = np.flatnonzero(kind[1:] == kind[:-1])
        if len(pairs):
            spans = np.column_stack([stay[pairs] + 1, stay[pairs + 1] + 1]).ravel()
            new[pairs + 1] = 1 + np.minimum.reduceat(common, spans)[::2]
        order, common = order[stay], new
    return equal


def _induced(length: int, width: int):
    """Repeated windows of open ranges, from tuples sorted by common string and suffix."""

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        group = np.cumsum(np.append(0, part["inner"].to_numpy()[1:] != part["inner"].to_numpy()[:-1]))
        equal = induce(group, part["suffix"].tolist(), part["before"].tolist(), part["far"].to_numpy(), width, length)
        rows = []
        for g, base, near, far, row in zip(part["g"], part["base"], part["near"], part["far"], np.where(part["open"].to_numpy(bool)[:, None], equal, False), strict=True):
            ks = np.flatnonzero(row[near : far + 1]) + near
            if len(ks):
                cut = np.flatnonzero(np.diff(ks) > 1)
                rows += [(g, base + int(a), base + int(b)) for a, b in zip(ks[np.append(0, cut + 1)], ks[np.append(cut, len(ks) - 1)], strict=True)]
        return pd.DataFrame(rows, columns=["g", "lo", "hi"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            n += len(batch)
            if n >= TOGETHER:  # whole groups go; the last may go on
                part = pd.concat(held, ignore_index=True)
                end = int((part["inner"] != part["inner"].iloc[-1]).sum())
                if end:
                    yield settle(part.iloc[:end].reset_index(drop=True))
                held, n = [part.iloc[end:]], len(part) - end
        if n:
            yield settle(pd.concat(held, ignore_index=True))

    return run


def _removed(length: int):
    """(spans, kept) of texts, from the stretches in which windows are repeated."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, founds in batches:
            rows = []
            for text, found in zip(texts, founds, strict=True):
                windows = sorted((x["s"] + a, x["s"] + b) for x in (() if found is None else found) for a, b in (((0, x["n"] - 1),) if x["spans"] is None else ((y["a"], y["b"]) for y in x["spans"])))
                spans: list[list[int]] = []
                for a, b in windows:
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b + length)
                    else:
                        spans.append([a, b + length])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                rows.append(([{"start": a, "length": b - a} for a, b in spans], b"".join(kept) + text[at:]))
            yield pd.DataFrame(rows, columns=["spans", "kept"])

    return F.pandas_udf(run, "spans array<struct<start:int,length:int>>, kept binary")


def repeated_windows(docs: DataFrame, length: int, context: int, widths: tuple[int, ...], group: int) -> DataFrame:
    """(t, found) from docs (t, text as bytes): for each text's digest its stretches (s, n, spans) in which windows are repeated; null spans are the whole stretch."""
    keep = Written(docs.sparkSession, "suffixes").keep
    all_ = keep(docs.where(F.octet_length("text") >= length).mapInArrow(_stretches(length, context), "key long, digest binary, t binary, s int, n int, l int"))
    n_all = all_.count()
    again = keep(all_.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("_c")).where("_c > 1"))
    hot = again.where(F.col("_c") * HOT > n_all).select(F.col("_key").alias("key"))
    rows = keep(hot_join(all_, ["key"], again.select("_key"), ["_key"], n_all, hot=hot).drop("_key"))
    n_rows = rows.count()
    kinds = keep(rows.groupBy("key", "digest").agg(F.count("*").alias("count"), F.min(F.struct("t", "s", "n", "l")).alias("place")))
    several = keep(kinds.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("_c")).where("_c > 1"))
    n_kinds = kinds.count()
    hot = several.where(F.col("_c") * HOT > n_kinds).select(F.col("_key").alias("key"))
    mixed = hot_join(kinds, ["key"], several.select("_key"), ["_key"], n_kinds, hot=hot)
    by_text = keep(mixed.groupBy(F.col("place.t").alias("_t")).agg(F.collect_list(F.struct("key", "digest", "count", "place.s", "place.n", "place.l")).alias("some")))
    cut = hot_join(docs, ["t"], by_text, ["_t"], docs.count()).select("t", "text", "some").mapInPandas(_cut_out(length), "key long, digest binary, count long, l int, bytes binary")
    # A text that several tasks met gives equal rows.
    cut = keep(cut.dropDuplicates(["key", "digest"]).withColumn("g", F.monotonically_increasing_id()))

    windows = F.octet_length("bytes") - (length - 1)
    todo = cut.select("g", (F.col("count") > 1).alias("sure"), "key", "l", "bytes", (F.col("l") - windows + 1).alias("lo"), F.col("l").alias("hi"))
    found = None
    for width in widths:
        ranges = keep(todo.mapInPandas(_ranges(length, width), "g long, sure boolean, lo int, hi int, inner long, outer binary"))
        n_ranges = ranges.count()
        inner = keep(ranges.groupBy(F.col("inner").alias("_inner")).agg(F.count("*").alias("holders"), F.max(~F.col("sure")).alias("_wanted")).where("holders > 1 and _wanted").drop("_wanted"))
        hot = inner.where(F.col("holders") * HOT > n_ranges).select(F.col("_inner").alias("inner"))
        ranges = keep(hot_join(ranges, ["inner"], inner, ["_inner"], n_ranges, hot=hot).drop("_inner"))
        outer = keep(ranges.groupBy(F.col("outer").alias("_outer")).agg(F.count("*").alias("_c")).where("_c > 1"))
        n_ranges = ranges.count()
        hot = outer.where(F.col("_c") * HOT > n_ranges).select(F.col("_outer").alias("outer"))
        ranges = keep(hot_join(ranges, ["outer"], outer, ["_outer"], n_ranges, "left", hot=hot).withColumn("open", F.col("_c").isNull() & ~F.col("sure")))
        settled = ranges.where("not sure and _c is not null").select("g", "lo", "hi")
        found = settled if found is None else found.unionByName(settled)
        if width == 1:
            break
        still = keep(ranges.groupBy(F.col("inner").alias("_inner")).agg(F.max("open").alias("_open"), F.max("holders").alias("_h")).where("_open"))
        n_still = ranges.count()
        hot = still.where(F.col("_h") * HOT > n_still).select(F.col("_inner").alias("inner"))
        left = hot_join(ranges.drop("_c"), ["inner"], still.select("_inner"), ["_inner"], n_still, hot=hot).drop("_inner")
        left = keep(left.select(F.col("g").alias("_g"), "lo", "hi", "inner", "open", "holders").join(cut, F.col("_g") == F.col("g")).select("g", (F.col("count") > 1).alias("sure"), "key", "l", "bytes", "lo", "hi", "inner", "open", "holders"))
        tuples = left.where(F.col("holders") <= group).mapInPandas(_suffixes(length, width), "inner long, g long, base int, near int, far int, open boolean, suffix binary, before binary")
        tuples = tuples.repartition("inner").sortWithinPartitions("inner", "suffix")
        found = found.unionByName(keep(tuples.mapInPandas(_induced(length, width), "g long, lo int, hi int")))
        # Of a larger group all go on, as each may be another's equal.
        todo = left.where(F.col("holders") > group).select("g", (F.col("sure") | ~F.col("open")).alias("sure"), "key", "l", "bytes", "lo", "hi")
    spans = found.groupBy(F.col("g").alias("_g")).agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    spans = spans.join(cut.select("g", "key", "digest", "l"), F.col("_g") == F.col("g")).select("key", "digest", F.transform("_spans", lambda x: F.struct((F.col("l") - x["hi"]).alias("a"), (F.col("l") - x["lo"]).alias("b"))).alias("spans"))
    whole = kinds.where("count > 1").select("key", "digest", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    out = keep(whole.unionByName(spans).withColumnsRenamed({"key": "_key", "digest": "_digest"}))
    hot = kinds.where(F.col("count") * HOT > n_rows).select("key", "digest")
    got = hot_join(rows.select("key", "digest", "t", "s", "n"), ["key", "digest"], out, ["_key", "_digest"], n_rows, hot=hot)
    return keep(got.groupBy(F.col("t").alias("_t")).agg(F.collect_set(F.struct("s", "n", "spans")).alias("found")))


def remove_repeated(docs: DataFrame, length: int = LENGTH, context: int = CONTEXT, widths: tuple[int, ...] = WIDTHS, group: int = GROUP) -> DataFrame:
    """docs with n_bytes, spans (start and length of removed runs, in bytes) and kept (the other bytes).

    docs has text; each row is a document of its own, so of equal rows of length bytes or more nothing stays. Null and empty
    texts, and texts shorter than length, lose nothing. Ids are not read and may be of any kind. Very
    long texts are read in chunks of windows; a text of few different bytes in a row has an anchor a byte, which
    costs 48 bytes a window. Other columns stay, whatever their names, but those named like a result give way. An
    empty table gives an empty result.
    """
    if not 0 < context <= length or widths[-1] != 1 or any(w > length for w in widths):
        raise ValueError("context and widths have to fit into length, and the last width to be 1")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULTS])
    names = [f"c{i}" for i in range(len(docs.columns))]
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.unhex(F.md5(raw)).alias("t"), raw.alias("text"), F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in zip(docs.columns, names, strict=True) if c != "text"], F.col("text").isNull().alias("null")).alias("row"))
    found = repeated_windows(rows.select("t", "text"), length, context, widths, group)
    out = hot_join(rows, ["t"], found, ["_t"], rows.count(), "left")
    out = out.withColumn("_out", _removed(length)("text", "found"))
    text = F.when(~F.col("row.null"), F.col("text").cast("string"))
    return out.select(*[text.alias(c) if c == "text" else F.col("row")[n].alias(c) for c, n in zip(docs.columns, names, strict=True)], F.octet_length("text").cast("long").alias("n_bytes"), "_out.spans", "_out.kept")


def query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["length"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
