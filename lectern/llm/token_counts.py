"""Token counts with a whole-token shortcut for a sentencepiece model.

Offline, per process: no piece of the model joins a space mark to text before it, and none holds a
newline (``Shortcut`` proves both over the vocabulary, or refuses the model). So no merge crosses
the start of a run of spaces or either side of a newline, and a text's count is the sum over its
words. Every vocabulary string that is one word is encoded alone; those that give one token count 1
without any merge. The rest is merged once and remembered, up to a fixed number of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, small_batches, table, text_or_empty

MARK = "▁"
#: Words remembered per worker in the younger of two generations; it changes no count.
REMEMBERED = 300_000
LIMIT = 4096


class Shortcut:
    """Counts of whole texts under one model, equal to the library's own."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [(i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        if any(MARK in p.lstrip(MARK) or "\n" in p for _, p in normal) or len(self.model.encode("\n")) != 2:
            raise ValueError("a piece of this model crosses a word boundary; the shortcut does not hold")
        words = [(i, p[1:]) for i, p in normal if p[0] == MARK and len(p) > 1 and p[1] != MARK]
        self.whole = {w: 1 for (i, w), got in zip(words, self.model.encode([w for _, w in words], num_threads=1), strict=True) if got == [i]}
        self.known, self.older = dict(self.whole), {}

    @staticmethod
    def keys(text: str) -> tuple[list[str], int]:
        """What the text falls into, and its newlines, a token each.

        A key is a word that follows one space; with its spaces, one that follows more; with a
        newline before it, one that follows none.
        """
        lines = (" " + text.replace(MARK, " ")).split("\n")
        out: list[str] = []
        for line in lines:
            if "  " in line:
                for x in re.findall(r"^[^ ]+| +[^ ]*", line):
                    out.append("\n" + x if x[0] != " " else x if x[:2] == "  " else x[1:])
            else:
                head, *words = line.split(" ")
                if head:
                    out.append("\n" + head)
                out += words
        return out, len(lines) - 1

    def learn(self, keys: set[str]) -> None:
        for key in keys.intersection(self.older):
            self.known[key] = self.older[key]
        todo = list(keys.difference(self.known))
        got = self.model.encode([k[1:] if k[:1] == " " else k for k in todo], num_threads=1)
        # A key after a newline is encoded behind one, which adds the leading mark and the newline.
        self.known.update((k, len(g) - 2 if k[:1] == "\n" else len(g) if k else 1) for k, g in zip(todo, got, strict=True))

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = dict(self.whole), self.known
        split = [self.keys(text) if text else ([], 0) for text in texts]
        if new := set().union(*(keys for keys, _ in split)).difference(self.known):
            self.learn(new)
        get = self.known.__getitem__
        return [n + sum(map(get, keys)) for keys, n in split]


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text; the rest is not read).

    model is the path of a sentencepiece model that every executor has. Null and empty texts have 0
    bytes and tokens; very long texts are counted whole. Repeated rows and null ids are counted like
    any other row, nothing depends on an order, and no other column is read, so none can clash. An
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shortcut = only("shortcut:" + model, lambda: Shortcut(model))
        for batch in batches:
            texts, counts = batch["text"].tolist(), []
            for lo in range(0, len(texts), 1000):
                counts += shortcut.count(texts[lo : lo + 1000])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": counts})

    slim = docs.select(F.col("doc_id").cast("string"), F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), text_or_empty().alias("text"))
    out = slim.mapInPandas(run, "doc_id string, n_bytes long, n_tokens long")
    return out.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
