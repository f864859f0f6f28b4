"""Pair scorers: a reranking model over (question, text) pairs, called in batches inside the tasks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values.
BATCH = 16

Model = Callable[[list[tuple[str, str]]], Sequence[float]]
_MODELS: dict[str, Model] = {}


def _model(key: str, load: Callable[[], Model]) -> Model:
    if key not in _MODELS:
        _MODELS.clear()  # one model a process
        _MODELS[key] = load()
    return _MODELS[key]


def pair_scorer(load: Callable[[], Model], batch: int = BATCH) -> Callable[..., Column]:
    """A scorer for retrieval.hybrid_search: scorer(question, text) is the model's logit as a column.

    load opens the model; a worker process calls it once and keeps it for its later tasks. The model gets lists of ``batch``
    pairs, in the order of the rows, the last of an Arrow batch being shorter, and gives as many numbers
    (ValueError else). Null questions and texts are empty. The column is marked as nondeterministic, so that Spark
    computes it in one place and scores no pair twice.
    """
    key = uuid.uuid4().hex

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _model(key, load)
        for questions, texts in batches:
            pairs = list(zip(questions.fillna(""), texts.fillna(""), strict=True))
            out: list[float] = []
            for lo in range(0, len(pairs), batch):
                some = pairs[lo : lo + batch]
                got = [float(x) for x in model(some)]
                if len(got) != len(some):
                    raise ValueError(f"the model gave {len(got)} scores for {len(some)} pairs")
                out += got
            yield pd.Series(out, dtype="float64")

    return F.pandas_udf(score, "double").asNondeterministic()


def overlap_model() -> Model:
    """A stand-in model, as retrieval.overlap_logit: the share of the question's distinct tokens in the text."""
    token = re.compile(T.TERM)

    def model(pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for question, text in pairs:
            asked = set(token.findall(question.lower()))
            out.append(8.0 * (len(asked & set(token.findall(text.lower()))) / max(len(asked), 1)) - 5.0)
        return out

    return model
