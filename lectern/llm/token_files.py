"""Token-id output: one zstandard frame per document, a seek table, and per-frame checksums.

A file is a run of independent frames, a skippable frame with the documents' ids, and the seek
table of the public zstandard seekable format, itself a skippable frame: for each frame its
compressed size, its content size and 32 bits of the content's XXH64. Any zstandard tool can
decompress the file; a reader of the table decompresses only the documents it wants.

A frame's content is the document's token ids as little-endian unsigned 32-bit integers, ended by
``END``. Each task of a range partitioning by doc_id writes one file under a name of its own into
the shared folder; only the manifest says which files count, so a task that ran twice, or was lost
half way, leaves no trace in the result.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, only, shared_dir, table, text_or_empty, whole_ids

END = 0
#: Rows that are encoded and framed together.
ROWS = 500
SEEK_MAGIC, IDS_MAGIC, SEEK_FOOTER = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
#: How the tokenizer's byte-level step cuts text, as its own format names no pattern: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points tried at start: Latin, Greek, Cyrillic, dashes and quotes, two signs.
TRIED = [*range(0x530), *range(0x2010, 0x2028), 0x20AC, 0x2122]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself where visible, else one from U+0100 on."""
    seen = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts under a byte-level tokenizer, as bytes, equal to the library's own.

    Where that is proved at start, a second merge loop over the same vocabulary, tiktoken's, takes the
    text: it merges the neighbours that form the vocabulary string of least id, the library those of
    the least merge. Both are the same if ids ascend with the merges and every string of the vocabulary,
    merged alone, becomes itself: neighbours that form a string are then always its own merge.
    Characters are cut alike if the library's ids of a probe of each are the same. Texts with other
    characters or the tokenizer's added strings go to the library, as do all if the proof fails.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.merged = self._merge_loop(spec)
        self.unproved = None
        if self.merged:
            probes = [f"x{c}x 1{c}1 !{c}! {c}{c}  {c} \n{c}\n" for c in map(chr, TRIED)]
            proved = [chr(c) for c, probe, ids in zip(TRIED, probes, self._library(probes), strict=True) if self._loop(probe) == ids]
            self.unproved = re.compile("[^" + "".join(map(re.escape, proved)) + "]")

    def _merge_loop(self, spec: dict):
        """tiktoken's encoding of the same vocabulary, or None where it is not proved equal."""
        import tiktoken

        model = spec["model"]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        plain = plain and model["type"] == "BPE" and not any([model["dropout"], model["unk_token"], model["continuing_subword_prefix"], model["end_of_word_suffix"], model["byte_fallback"], model["ignore_merges"]])
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.added} if plain else {}
        made = [vocab.get("".join(x), -1) for x in model["merges"]] if plain else []
        if not plain or any(a >= b for a, b in zip([len(vocab) - len(made) - 1, *made], made)) or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            return None
        if any([x.id for x in self.tokenizer.model.tokenize(k)] != [v] for k, v in vocab.items()):
            return None
        byte = byte_alphabet()
        return tiktoken.Encoding("proved", pat_str=PATTERN, mergeable_ranks={bytes(map(byte.__getitem__, k)): v for k, v in vocab.items()}, special_tokens={})

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _loop(self, text: str) -> bytes:
        return self.merged.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if self.merged and not self.unproved.search(text) and not any(x in text for x in self.added):
                yield self._loop(text)
            else:
                yield self._library([text])[0]


def encoder(path: str) -> Encoder:
    return only("encoder:" + path, lambda: Encoder(path))


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def trailer(doc_ids: list[int | None], entries: list[tuple[int, int, int]]) -> bytes:
    """The ids' frame and the seek table."""
    ids = b"".join(struct.pack("<?q", x is not None, x or 0) for x in doc_ids)
    seek = np.array(entries, dtype="<u4").reshape(-1, 3).tobytes() + struct.pack("<IBI", len(entries), 0x80, SEEK_FOOTER)
    return skippable(IDS_MAGIC, ids) + skippable(SEEK_MAGIC, seek)


def open_index(file) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, seek table, start of each frame) of an open file; raises ValueError if it is damaged."""
    size = file.seek(0, 2)
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEK_FOOTER or flags != 0x80:
        raise ValueError("no seek table")
    at = size - (8 + 12 * n + 9)
    file.seek(at - 9 * n - 8)
    raw = file.read(9 * n + 8 + 8 + 12 * n)
    if struct.unpack_from("<II", raw) != (IDS_MAGIC, 9 * n) or struct.unpack_from("<II", raw, 9 * n + 8) != (SEEK_MAGIC, 12 * n + 9):
        raise ValueError("the seek table does not match its frame")
    ids = [v if there else None for there, v in struct.iter_unpack("<?q", raw[8 : 8 + 9 * n])]
    table_ = np.frombuffer(raw, dtype="<u4", offset=9 * n + 16).reshape(-1, 3)
    starts = np.concatenate([[0], np.cumsum(table_[:, 0], dtype=np.int64)])
    if starts[-1] != at - 9 * n - 8:
        raise ValueError("the frames' sizes do not add up")
    return ids, table_, starts


def read_frame(file, table_: np.ndarray, starts: np.ndarray, k: int, decompressor) -> bytes:
    """Content of frame k alone, checked against the table."""
    import xxhash

    file.seek(int(starts[k]))
    content = decompressor.decompress(file.read(int(table_[k, 0])))
    if len(content) != table_[k, 1] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != table_[k, 2]:
        raise ValueError(f"frame {k} is damaged")
    return content


def _store(folder: str):
    """(file system, path in it); a plain path or any URI that Arrow can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + re.sub("^file:", "", folder))


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, level: int = 1) -> DataFrame:
    """Write docs' ids (doc_id, text; the rest is not read) in ascending doc_id order; the manifest.

    The manifest has a row per file in order: part, file, n_docs, n_tokens, first_token. Null ids
    come first; rows equal in id are ordered by text, and files may part them where their texts
    differ. A null or empty text is its end id alone; very long texts are encoded whole. Ids are
    whole numbers, as the format has them (TypeError else). An empty table writes no file. Columns
    beside the two cannot clash. tokenizer is a path that every executor has.
    """
    whole_ids(docs)

    def run(batches):
        import pyarrow as pa
        import xxhash
        import zstandard
        from pyspark import TaskContext

        encode, compressor = encoder(tokenizer).encode, zstandard.ZstdCompressor(level=level, write_checksum=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
        ids: list[int | None] = []
        entries: list[tuple[int, int, int]] = []
        end, out = struct.pack("<I", END), None
        store, path = _store(folder)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                some = batch.slice(lo, ROWS)
                ids += some.column("key").to_pylist()
                for content in encode(some.column("text").to_pylist()):
                    content += end
                    frame = compressor.compress(content)
                    out.write(frame)
                    entries.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        if out is not None:
            out.write(trailer(ids, entries))
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": [len(ids)], "n_tokens": [sum(x[1] for x in entries) // 4]})

    order = [F.col("key").asc_nulls_first(), "text"]
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), text_or_empty().alias("text"))
    # A text's start parts the rows of one id in the order of whole texts.
    rows = rows.repartitionByRange(F.col("key").asc_nulls_first(), F.substring("text", 1, 40)).sortWithinPartitions(*order)
    done = rows.mapInArrow(run, "part int, file string, n_docs long, n_tokens long")
    # Written before anything reads it: the files are made once, and the names that count are fixed here.
    done = Written(docs.sparkSession, "manifest").keep(done)
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return done.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, file, frame for every document of the manifest's files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        decompressor = zstandard.ZstdDecompressor()
        store, path = _store(folder)
        for batch in batches:
            for name, first in zip(batch["file"], batch["first_token"], strict=True):
                with store.open_input_file(f"{path}/{name}") as file:
                    ids, seek, starts = open_index(file)
                    at = int(first)
                    for lo in range(0, len(ids), 5000):
                        rows = []
                        for k in range(lo, min(lo + 5000, len(ids))):
                            content = read_frame(file, seek, starts, k, decompressor)
                            rows.append((ids[k], at, len(content) // 4, zlib.crc32(content), name, k))
                            at += len(content) // 4
                        frame = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "file", "frame"])
                        frame["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64")
                        yield frame

    spread = manifest.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2))
    return spread.select("file", "first_token").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, frame long")


def tokens_to_files(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write, then read back: one row per row of docs. folder: a new one in the shared folder."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_tokens(write_tokens(docs, tokenizer, folder), folder)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = tokens_to_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")
