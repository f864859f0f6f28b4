"""Text encoders: any function from texts to vectors, run over a table in batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Texts that an encoder gets at a time.
BATCH = 64


def embed(df: DataFrame, key: str, encoder: Callable, text: str = "text", prefix: str = "", batch: int = BATCH) -> DataFrame:
    """(key, embedding): encoder(list of texts), which gives rows of numbers, scaled to unit length.

    prefix goes before every text; encoders that tell questions from passages have one for questions.
    A null text counts as empty; a vector of zeros stays one. Texts go to the encoder whole. The
    function is sent to the executors, so a model is best opened inside, once per process.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for rows in batches:
            for lo in range(0, rows.num_rows, batch):
                some = rows.slice(lo, batch)
                got = np.asarray(encoder([prefix + (x or "") for x in some.column("text").to_pylist()]), dtype=np.float64)
                got = got / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-12)
                offsets = np.arange(len(got) + 1, dtype=np.int32) * got.shape[1]
                yield pa.RecordBatch.from_arrays([some.column("key"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(got.ravel().astype(np.float32)))], names=["key", "embedding"])

    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, embedding array<float>")
    return out.withColumnRenamed("key", key)


def hashed_terms(width: int) -> Callable:
    """A stand-in encoder without a model: counts of a text's terms by a hash of the term."""

    def encode(texts: list[str]):
        import hashlib
        import re

        import numpy as np

        out = np.zeros((len(texts), width))
        for k, text in enumerate(texts):
            for term in re.findall(T.TERM, text.lower()):
                out[k, int(hashlib.md5(term.encode()).hexdigest()[:4], 16) % width] += 1
        return out

    return encode
