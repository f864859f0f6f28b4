"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence is a logistic model of its statistics, fitted on a bounded sample of
labelled rows. Sites give the rest: each host (source) and each path under it (source and language)
has a posterior share of good documents, shrunk toward what stands above it (paths toward their host,
hosts toward the whole corpus) by a strength that the spread between sites sets. A document's
odds are its own, times what its path's posterior, without the document, says beyond the corpus.

Sites are grouped aggregations of integers (millionths), combined before the shuffle, so their
results do not depend on the order of rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, table
from .statistics import text_statistics

#: Labelled rows the document model is fitted on at most, chosen by a hash of the id.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.5
#: Labels are broadcast up to this many; beyond, the join with whole rows shuffles.
BROADCAST_ROWS = 500_000
UNIT = 1_000_000


def features(of: str = "") -> list[Column]:
    """The model's inputs from the statistics in the struct ``of``."""
    c = lambda name: F.col(of + name)
    words, chars, lines = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("word_chars"), F.lit(1)), F.greatest(c("n_lines"), F.lit(1))
    share = lambda a, b, k: F.asinh(F.lit(float(k)) * c(a) / b)
    return [F.log1p(c("n_words").cast("double")), F.log(chars / words), share("n_symbols", chars, 100), share("n_dup_lines", lines, 10), share("n_repeat_words", words, 10), share("n_upper", chars, 10), share("n_marks", chars, 20), share("n_doubled_marks", words, 20), c("n_distinct_words") / words, F.log(words / lines)]


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 40) -> tuple[list[float], float]:
    """Weights and intercept of a ridge logistic model, on the scale of x, by Newton steps."""
    if len(y) == 0 or y.min() == y.max():
        n = x.shape[1]
        share = (y.sum() + 1.0) / (len(y) + 2.0) if len(y) else 0.5
        return [0.0] * n, float(np.log(share / (1 - share)))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.diag([l2] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    weights = w[:-1] / scale
    return weights.tolist(), float(w[-1] - weights @ mean)


def _logit(p: Column) -> Column:
    return F.log(p / (1.0 - p))


def _strength(sites: DataFrame, mean: Column) -> Column:
    """Prior rows' worth of a level from the spread of its sites around ``mean``, by moments; 5 to 1000."""
    share = F.col("s") / F.col("n")
    spread = F.sum(F.col("n") * (share - mean) * (share - mean)) / F.sum("n")
    noise = F.sum(mean * (1.0 - mean)) / F.sum("n")
    between = F.greatest(spread - noise, F.lit(1e-6))
    return F.greatest(F.least(F.sum(F.col("n") * mean * (1.0 - mean)) / F.sum("n") / between - 1.0, F.lit(1000.0)), F.lit(5.0))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD, slim: bool = False) -> DataFrame:
    """docs with quality (0 to 1), own_quality, path_quality and kept; all rows and columns of docs (slim: doc_id alone).

    docs has doc_id, text, lang, source, labels doc_id and quality (0 or 1). Several labels of a
    document count as their mean, null labels not at all. Without labels of both classes the model
    is the labels' share, and sites decide. Null and empty texts have the statistics of no words.
    Null languages and sources are values of their own. The posteriors of a document's path and
    host leave out what it gave them itself, its label or else its model value. Repeated rows count as often
    as they occur and are judged alike; very long texts are read whole. Columns of docs that carry a
    result's name give way to it. An empty table gives an empty result.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("quality", "own_quality", "path_quality", "kept")])
    columns = ["doc_id"] if slim else docs.columns
    keep = Written(docs.sparkSession, "quality").keep
    # A document's own columns stay together in _row, out of the way of what is joined to it.
    rows = keep(docs.select("doc_id", "source", "lang", F.struct(*[F.col(c) for c in columns]).alias("_row"), text_statistics("text").alias("_s")))
    marks = keep(labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("_label")))
    names = [f"_f{i}" for i in range(len(features()))]
    facts = rows.join(marks, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "source", "lang", "_label", "_s.*")
    facts = keep(facts.select("doc_id", "source", "lang", "_label", *[f.alias(n) for f, n in zip(features(), names, strict=True)]))
    # A hash thins the labelled rows before they are ordered, so that tasks send about what is taken.
    labelled = facts.where("_label is not null")
    share = min(1.0, 1.5 * sample_rows / max(1, labelled.count()))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < round(1_000_000 * share)).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), *names).limit(sample_rows).select("_label", *names).collect()
    got = np.array([tuple(r) for r in sample], dtype=float).reshape(len(sample), len(names) + 1)
    weights, bias = fit(got[:, 1:], got[:, 0])
    own = lambda columns: 1.0 / (1.0 + F.exp(-sum((F.lit(w) * c for w, c in zip(weights, columns, strict=True)), F.lit(bias))))
    known = lambda p: F.round(F.least(F.greatest(p, F.lit(0.001)), F.lit(0.999)) * UNIT).cast("long")
    paths = keep(facts.select("source", "lang", F.coalesce(F.col("_label") * UNIT, known(own([F.col(n) for n in names]))).alias("u")).groupBy("source", "lang").agg(F.count("*").alias("n"), (F.sum("u") / UNIT).alias("s")))
    whole = keep(paths.agg(F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.5)).alias("m")).select(F.least(F.greatest("m", F.lit(0.001)), F.lit(0.999)).alias("m")))
    hosts = paths.groupBy("source").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).crossJoin(F.broadcast(whole))
    level = keep(hosts.agg(F.coalesce(_strength(hosts, F.col("m")), F.lit(5.0)).alias("k")))
    above = (F.col("k") * F.col("m") + F.col("s")) / (F.col("k") + F.col("n"))
    hosts = keep(hosts.crossJoin(F.broadcast(level)).select(F.col("source").alias("_host"), F.col("n").alias("hn"), F.col("s").alias("hs"), F.col("k").alias("hk"), above.alias("h")))
    under = paths.join(hosts, F.col("source").eqNullSafe(F.col("_host"))).drop("_host")
    level = keep(under.agg(F.coalesce(_strength(under, F.col("h")), F.lit(5.0)).alias("k")))
    sites = keep(under.crossJoin(F.broadcast(level)).crossJoin(F.broadcast(whole)).select(F.col("source").alias("_source"), F.col("lang").alias("_lang"), "n", "s", "hn", "hs", "hk", "k", "m"))
    taken = [f"_x{i}" for i in range(len(names))]
    flat = rows.withColumns(dict(zip(taken, features("_s."), strict=True)))
    flat = flat.withColumn("own_quality", own([F.col(x) for x in taken]))
    flat = flat.join(sites, F.col("source").eqNullSafe(F.col("_source")) & F.col("lang").eqNullSafe(F.col("_lang")))
    # Texts are not shuffled for labels while these are few.
    few = marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    flat = flat.join(F.broadcast(marks) if few else marks, F.col("doc_id") == F.col("_id"), "left")
    # Without what the document itself gave its path and host, so that its own evidence counts once.
    given = F.coalesce(F.col("_label") * UNIT, known(F.col("own_quality"))) / UNIT
    host = (F.col("hk") * F.col("m") + F.col("hs") - given) / (F.col("hk") + F.col("hn") - 1)
    path = (F.col("k") * host + F.col("s") - given) / (F.col("k") + F.col("n") - 1)
    flat = flat.withColumn("path_quality", F.least(F.greatest(path, F.lit(0.001)), F.lit(0.999)))
    odds = _logit(F.least(F.greatest(F.col("own_quality"), F.lit(1e-9)), F.lit(1 - 1e-9))) + _logit(F.col("path_quality")) - _logit(F.col("m"))
    flat = flat.withColumn("quality", 1.0 / (1.0 + F.exp(-odds)))
    return flat.select(*[F.col("_row").getField(c).alias(c) for c in columns], "quality", "own_quality", "path_quality", (F.col("quality") >= threshold).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), slim=True)
    return out.select("doc_id", F.round("quality", 6).alias("quality"), F.round("own_quality", 6).alias("own_quality"), F.round("path_quality", 6).alias("path_quality"), "kept")
