"""Quality rules: base limits, then robust multivariate outliers by minimum covariance determinant.

Texts become vectors of transformed statistics. For each pool of rows, by language and source, the
location and scatter of the three quarters of its rows with the least covariance determinant are
sought by concentration: from three deterministic starts, each step keeps the rows nearest by
Mahalanobis distance and takes their mean and covariance, until the determinant falls no more; the
start with the smallest determinant stays. The starts are the medians with the quartiles' spread, with
the spread of the outer twentieths, and with the covariance of spatial signs, whose shape no far row
can turn. Rows far outside by that estimate are rejected.

A step is two grouped aggregations over a table of a few numbers per row: quantile sketches and
sums of products, both combined before the shuffle. No pool is ever gathered in one task, so one
that holds a third of all rows costs what its rows cost anywhere else.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, SALTS, Written, hot_join, table
from .statistics import text_statistics

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Least standard deviation of each statistic: most plain texts have none of some at all.
FLOORS = [0.3, 0.05, 0.3, 0.3, 0.3, 0.3]
P = len(FLOORS)
COVERAGE = 0.75
#: Concentration ends where no logarithm of a determinant falls by more, or after so many steps.
LEAST_FALL, MOST_STEPS = 1e-2, 20
#: Groups of fewer rows are judged with the like groups of their language, then by all rows of it, then by all rows.
LEAST_ROWS = 100


def vector() -> list:
    """Transformed statistics, one column each."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    share = lambda a, b, k: F.asinh(F.lit(float(k)) * F.col(a) / b)
    return [F.log(words), F.log(chars / words), share("n_symbols", chars, 100), share("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1)), 10), share("n_repeat_words", words, 10), share("n_upper", chars, 10)]


def chi2_quantile(p: int, z: float) -> float:
    """Chi-squared quantile at the normal quantile z (Wilson and Hilferty)."""
    return p * (1 - 2 / (9 * p) + z * (2 / (9 * p)) ** 0.5) ** 3


def _distance() -> object:
    d = [F.col(f"x{i}") - F.col("mu")[i] for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total = total + d[i] * d[j] * F.col("inv")[i * P + j] * (1.0 if i == j else 2.0)
    return total


_ESTIMATE = "pool string, start int, mu array<double>, inv array<double>, logdet double"


def _estimates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean and inverse covariance from the sums of a pool's kept rows."""
    floor = np.diag(np.square(FLOORS))
    for batch in batches:
        rows = []
        for pool, start, n, s1, s2 in zip(batch["pool"], batch["start"], batch["n"], batch["s1"], batch["s2"], strict=True):
            mu = np.asarray(s1) / n
            second = np.zeros((P, P))
            second[np.triu_indices(P)] = np.asarray(s2) / n
            second = second + np.triu(second, 1).T
            cov = second - np.outer(mu, mu)
            cov = (cov + cov.T) / 2
            short = np.maximum(np.diag(floor) - np.diag(cov), 0.0)
            cov = cov + np.diag(short) + 1e-3 * floor
            rows.append((pool, start, mu.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
        yield pd.DataFrame(rows, columns=["pool", "start", "mu", "inv", "logdet"])


def _sign_starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Starts from the sums of a pool's spatial signs, on the scale of x."""
    for batch in batches:
        rows = []
        for pool, n, s2, mu, spread in zip(batch["pool"], batch["n"], batch["s2"], batch["mu"], batch["spread"], strict=True):
            shape = np.zeros((P, P))
            shape[np.triu_indices(P)] = P * np.asarray(s2) / n
            shape = shape + np.triu(shape, 1).T + 0.05 * np.eye(P)
            rows.append((pool, 2, list(mu), np.linalg.inv(np.outer(spread, spread) * shape).ravel().tolist()))
        yield pd.DataFrame(rows, columns=["pool", "start", "mu", "inv"])


def _group() -> Column:
    """A name of a row's group, null languages and sources included."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(x)), F.lit("-")) for x in ("lang", "source")])


def pools(facts: DataFrame, least: int) -> DataFrame:
    """_grp (a group's name), pool, wide for the groups of facts.

    pool says by whose estimate the group's rows are judged: 2 the group's, 1 that of its language's
    groups of fewer than ``least`` rows, 3 that of all rows of its language, 0 that of all rows, each
    where those before have too few. wide says that its language needs an estimate over all its rows.
    """
    own = facts.groupBy("lang", "source").agg(F.count("*").alias("_n"))
    key = lambda *c: F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(x)), F.lit("-")) for x in c])
    sparse = own.groupBy(F.col("lang").alias("_lang")).agg(F.coalesce(F.sum(F.when(F.col("_n") < least, F.col("_n"))), F.lit(0)).alias("_m"), F.sum("_n").alias("_all"))
    named = own.join(sparse, F.col("lang").eqNullSafe(F.col("_lang")))
    pool = F.when(F.col("_n") >= least, F.concat(F.lit("2"), key("lang", "source"))).when(F.col("_m") >= least, F.concat(F.lit("1"), key("lang"))).when(F.col("_all") >= least, F.concat(F.lit("3"), key("lang"))).otherwise(F.lit("0"))
    wide = F.when((F.col("_m") > 0) & (F.col("_m") < least) & (F.col("_all") >= least), F.concat(F.lit("3"), key("lang")))
    return named.select(_group().alias("_grp"), pool.alias("pool"), wide.alias("wide"))


def judge(docs: DataFrame, least: int = LEAST_ROWS, z: float = 8.0) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance, cutoff, kept for every row of docs.

    docs has doc_id, text, lang, source; the rest is not read. Null and empty texts have no words
    and fail the base rules. Null languages and sources are values of their own. Rows that fail the
    base rules take no part in the estimates. cutoff is the chi-squared quantile at the normal
    quantile z, far out as the statistics have longer tails than a normal; distances are scaled so
    that a pool's median is the chi-squared median. Groups of fewer than ``least`` rows are judged by
    a wider pool, at the widest by all rows however few; every row that passes the base rules has a
    distance. Repeated rows count as often as they occur; equal determinants go to the earlier start.
    Very long texts are read whole. No other column of docs is read, so none can clash. An empty table
    gives an empty result.
    """
    keep = Written(docs.sparkSession, "mcd").keep
    stats = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text_statistics("text").alias("_s")).select("doc_id", "lang", "source", "_s.*")
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    facts = keep(stats.select("doc_id", "lang", "source", _group().alias("grp"), *BASE, base_failed.alias("base_failed"), *[x.alias(f"x{i}") for i, x in enumerate(vector())]))
    named = keep(pools(facts.where(~F.col("base_failed")), least))
    # The pools that a row counts in: its own, and wider ones where some group is judged by them.
    every = F.lit(None).cast("string") if named.where("pool = '0'").isEmpty() else F.lit("0")
    counts = F.array_distinct(F.array_compact(F.array(F.col("pool"), F.col("wide"), every)))
    n_rows = facts.count()
    rows = hot_join(facts.where(~F.col("base_failed")), ["grp"], named, ["_grp"], n_rows)
    rows = rows.select(F.explode(counts).alias("pool"), *[f"x{i}" for i in range(P)])
    # A hot pool's rows are dealt over SALTS tasks wherever they meet its estimates, and these are few per pool.
    hot = F.broadcast(rows.groupBy("pool").agg(F.count("*").alias("c")).where(F.col("c") * HOT > n_rows).select(F.col("pool").alias("_hot")))
    rows = keep(rows.join(hot, F.col("pool") == F.col("_hot"), "left").withColumn("salt", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))).drop("_hot"))
    salts = keep(rows.groupBy("pool", "salt").agg(F.count("*").alias("_c")).drop("_c"))
    met = lambda few: rows.join(few.join(salts, "pool"), ["pool", "salt"])
    cuts = [0.05, 0.25, 0.5, 0.75, 0.95]
    marks = keep(rows.groupBy("pool").agg(*[F.percentile_approx(f"x{i}", cuts, 1000).alias(f"q{i}") for i in range(P)]))
    scale = lambda i, a, b, k: F.greatest((F.col(f"q{i}")[b] - F.col(f"q{i}")[a]) / k, F.lit(FLOORS[i]))
    diagonal = lambda a, b, k: F.array(*[F.lit(1.0) / (scale(i, a, b, k) * scale(i, a, b, k)) if i == j else F.lit(0.0) for i in range(P) for j in range(P)])
    starts = F.array(*[F.struct(F.lit(s).alias("start"), F.array(*[F.col(f"q{i}")[2] for i in range(P)]).alias("mu"), diagonal(*span).alias("inv")) for s, span in enumerate(((1, 3, 1.349), (0, 4, 3.29)))])
    pairs = [(i, j) for i in range(P) for j in range(i, P)]
    now = marks.select("pool", F.explode(starts).alias("s")).select("pool", "s.*")
    # Spatial signs: directions from the medians, on the quartiles' scale; their covariance is put back on the scale of x.
    spans = marks.select("pool", F.array(*[F.col(f"q{i}")[2] for i in range(P)]).alias("mu"), F.array(*[scale(i, 1, 3, 1.349) for i in range(P)]).alias("spread"))
    side = lambda i: (F.col(f"x{i}") - F.col("mu")[i]) / F.col("spread")[i]
    signs = met(spans).withColumn("_r", F.greatest(F.sqrt(sum(side(i) * side(i) for i in range(P))), F.lit(1e-9)))
    signs = signs.groupBy("pool").agg(F.count("*").alias("n"), F.array(*[F.sum(side(i) * side(j) / (F.col("_r") * F.col("_r"))) for i, j in pairs]).alias("s2")).join(spans, "pool")
    now = keep(now.unionByName(signs.mapInPandas(_sign_starts, "pool string, start int, mu array<double>, inv array<double>")))
    done = []
    for _ in range(MOST_STEPS):
        far = met(now).withColumn("d2", _distance())
        # Written, so that it is known to be small and no pool's rows are dealt by pool.
        near = keep(far.groupBy("pool", "start").agg(F.percentile_approx("d2", COVERAGE, 1000).alias("h")))
        inside = far.join(near.join(salts, "pool"), ["pool", "start", "salt"]).where("d2 <= h")
        sums = inside.groupBy("pool", "start").agg(F.count("*").alias("n"), F.array(*[F.sum(f"x{i}") for i in range(P)]).alias("s1"), F.array(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).alias("s2"))
        new = sums.mapInPandas(_estimates, _ESTIMATE)
        before = now.select(F.col("pool").alias("_p"), F.col("start").alias("_s"), (F.col("logdet") if "logdet" in now.columns else F.lit(None).cast("double")).alias("_logdet"))
        new = keep(new.join(before, (F.col("pool") == F.col("_p")) & (F.col("start") == F.col("_s"))).drop("_p", "_s"))
        done.append(new.drop("_logdet"))
        now = new.where(F.col("_logdet").isNull() | (F.col("_logdet") - F.col("logdet") > LEAST_FALL)).drop("_logdet")
        if now.isEmpty():
            break
    now = reduce(DataFrame.unionByName, done)
    best = now.groupBy("pool").agg(F.min_by(F.struct("mu", "inv"), F.struct("logdet", "start")).alias("b")).select("pool", "b.*")
    best = keep(best)
    middle = met(best).withColumn("d2", _distance()).groupBy("pool").agg((F.percentile_approx("d2", 0.5, 1000) / chi2_quantile(P, 0.0)).alias("unit"))
    best = keep(best.join(middle, "pool"))
    model = keep(named.select("_grp", "pool").join(best, "pool"))
    out = hot_join(facts, ["grp"], model, ["_grp"], n_rows, "left")
    distance = _distance() / F.greatest(F.col("unit"), F.lit(1.0))
    out = out.withColumn("distance", distance).withColumn("cutoff", F.lit(chi2_quantile(P, z)))
    return out.select("doc_id", *BASE, "base_failed", "distance", "cutoff", (~F.col("base_failed") & F.coalesce(F.col("distance") <= F.col("cutoff"), F.lit(True))).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("distance", "cutoff")
