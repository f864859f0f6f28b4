"""Statistics of whole texts that the quality operators share, computed in one pass over a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
WINDOW = 8
_UPPER = bytes(range(0x41, 0x5B))
_MARKS = b"!?.,;:\"'()[]{}-_/\\@=+~^`0123456789"
_SPACE = " \t\n\x0b\x0c\r"
#: Fields of the struct that ``text_statistics`` returns.
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long, n_distinct_words long, n_doubled_marks long"


def repeated_words(ids: np.ndarray, words: list[bytes]) -> int:
    """Words covered by windows of 8 words that occur twice or more in the text.

    Windows are found by 64-bit hashes; those whose hash repeats are compared word by word.
    """
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
        hashes ^= hashes >> np.uint64(29)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twin = np.zeros(n, dtype=bool)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    seen: dict[tuple, int] = {}
    hit = np.zeros(len(ids) + 1, dtype=np.int32)
    for i in np.flatnonzero(twin).tolist():
        key = tuple(words[i : i + WINDOW])
        first = seen.setdefault(key, i)
        if first != i:
            for at in (first, i):
                hit[at] += 1
                hit[at + WINDOW] -= 1
    return int((np.cumsum(hit[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple:
    """The values of FIELDS; a null or empty text has zeros."""
    if not text:
        return (0,) * 10
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # on ASCII white space only, as the contracts have it
    n_chars = len(text) - sum(map(text.count, _SPACE))
    lines = text.split("\n")
    dup = 0
    if len(lines) > 1:
        full = [x for x in lines if x.strip(_SPACE)]
        dup = len(full) - len(set(full))
    distinct: dict[bytes, int] = {}
    ids = np.fromiter((distinct.setdefault(w, len(distinct)) for w in words), dtype=np.uint64, count=len(words))
    repeat = repeated_words(ids + np.uint64(1), words) if len(words) > WINDOW else 0
    return (len(words), n_chars, sum(map(text.count, SYMBOLS)), dup, repeat, len(lines), len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _MARKS)), len(distinct), text.count("!!") + text.count("??"))


def _run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in FIELDS.split(", ")]
    for batch in batches:
        yield pd.DataFrame([statistics(x) for x in batch], columns=names, dtype="int64")


def text_statistics(col: str) -> Column:
    """A struct of FIELDS."""
    return F.pandas_udf(_run, FIELDS)(F.col(col))
