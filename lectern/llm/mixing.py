"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document draws the exponential key ``-ln(u) / w`` from a uniform ``u`` that its id and the
seed fix, with ``w`` its quality weight. A source whose target is ``e`` times its size and a rest
takes ``e`` complete epochs; the rest is the documents with the smallest keys, up to the budget.

The order within a source is never sorted as a whole: keys fall into ``buckets`` ranges of equal ratio, a small
table of sums by (source, range) gives the range in which the budget ends, and only that range is
ordered. What is left of the order is one cut per source, so documents are decided where they
are read and their texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, text_or_empty, word_count

#: Characters that lower a text's quality weight.
SYMBOLS = "#*$%&|<>"


def quality_weight(col: str = "text") -> Column:
    """1 for plain text, falling with the share of symbols; in (0, 1]; 1 for null and empty texts."""
    text = text_or_empty(col)
    n = F.length(text)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.lit(1.0) / (F.lit(1.0) + F.lit(20.0) * (n - F.length(F.translate(text, SYMBOLS, ""))) / n))


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) with 52 bits, fixed by the id, where there is none by the text, and the seed."""
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def targets(sizes: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """(source, source_size) -> with target: weights in code point order, null last, filled up to cap.

    One row per source, so the windows over all of them hold the list of sources and no documents.
    """
    every = Window.partitionBy()
    ranked = sizes.withColumn("_rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") - 1) % len(weights) + 1))
    ranked = ranked.withColumn("_cap", cap * F.col("source_size").cast("double"))
    before = every.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    total, weight = F.sum(F.col("source_size").cast("double")).over(every), F.sum("_w").over(every)
    level = (share * total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (weight - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("_level", level).withColumn("_open", F.col("_level") < F.col("_cap") / F.col("_w"))
    ranked = ranked.withColumn("_level", F.min_by(F.when(F.col("_open"), F.col("_level")), F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), F.col("_rank")))).over(every))
    return ranked.select("source", "source_size", F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_w"))).alias("target"))


def _keyed(docs: DataFrame, seed: int, buckets: int, weight: Column | None) -> DataFrame:
    key = -F.log(uniform(F.col("doc_id"), F.col("text"), seed)) / (quality_weight() if weight is None else F.greatest(F.least(weight, F.lit(1.0)), F.lit(1e-6)))
    keyed = docs.withColumns({"_size": word_count(), "_key": key})
    # Ranges of equal ratio, so that they hold equal shares whatever the scale of the weights; keys lie in 2^-53 to 2^26.
    return keyed.withColumn("_bucket", F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor((F.log2("_key") + 53.0) * (buckets / 79.0)).cast("int"))))


def _tied(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with _to: the number (_at) of the last of the _m rows at _part that are taken.

    Numbers ascend by the task that wrote them, so the task in which the m-th lies is found by counts, and only
    its rows are ordered.
    """
    at = rows.select("source", F.struct("_key", "doc_id", "_size").alias("_place"), "_at").join(F.broadcast(plan.where("_part is not null").select(F.col("_s").alias("_s2"), "_part", "_m")), F.col("source").eqNullSafe(F.col("_s2")) & (F.col("_place") == F.col("_part")))
    at = at.select("source", "_at", "_m", F.shiftright("_at", 33).alias("_task"))
    tasks = at.groupBy("source", "_task").agg(F.count("*").alias("_n"), F.first("_m").alias("_m"))
    upto = F.sum("_n").over(Window.partitionBy("source").orderBy("_task"))
    tasks = tasks.withColumn("_k", F.col("_m") - upto + F.col("_n")).where((F.col("_k") > 0) & (F.col("_k") <= F.col("_n"))).select(F.col("source").alias("_s2"), F.col("_task").alias("_t2"), "_k")
    found = at.drop("_m").join(tasks, F.col("source").eqNullSafe(F.col("_s2")) & (F.col("_task") == F.col("_t2")))
    found = found.withColumn("_r", F.row_number().over(Window.partitionBy("source", "_task").orderBy("_at"))).where("_r = _k").select(F.col("source").alias("_s2"), F.col("_at").alias("_to"))
    return plan.join(found, F.col("_s").eqNullSafe(F.col("_s2")), "left").drop("_s2")


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.0, cap: float = 3.0, seed: int = 7, buckets: int = 65_536, weight: Column | None = None, slim: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and row for every document.

    docs has doc_id, text and source; row is the document with all its columns, so that none can
    clash with a result (slim: no row, and texts are read once).
    size counts words; a null or empty text has 0 and takes 0. Sources in code point order, null
    last, weigh ``weights`` repeating and share ``share`` of all words; no target is above ``cap``
    times its source. A document counts to the budget where its middle lies within it, so a source
    misses its target by half a document at most. Of rows equal in id, size and key as many are taken
    as the budget holds, whichever they are; rows without an id draw by their text. Texts are read
    whole. An empty table gives an empty result.
    """
    row = [] if slim else [F.struct(*[F.col(c) for c in docs.columns]).alias("row")]
    given = [] if weight is None else [weight.cast("double").alias("_weight")]
    keyed = _keyed(docs.select("doc_id", "text", "source", *given, *row), seed, buckets, None if weight is None else F.col("_weight")).drop("text", "_weight")
    written = Written(docs.sparkSession, "mix")
    # A row's number is stored with it: it tells equal rows apart.
    facts = keyed.select("doc_id", "source", "_size", "_key", "_bucket")
    facts = written.keep(facts.withColumn("_at", F.monotonically_increasing_id()) if slim else facts)
    if slim:
        keyed = facts
    sums = facts.groupBy("source", "_bucket").agg(F.sum("_size").alias("_sum"))
    goal = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, cap)
    goal = goal.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("_epochs") * F.col("source_size")))
    by = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    run = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(by), F.lit(0)))
    run = run.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).where("_before < _rest")
    last = run.groupBy("source").agg(F.max("_bucket").alias("_last"), F.max_by("_before", "_bucket").alias("_base"), F.first("_rest").alias("_rest"))
    edge = facts.join(last.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_last")))
    place = F.struct("_key", "doc_id", "_size")
    # Equal rows are one row with their number: m of them lie within the budget.
    edge = edge.groupBy("source", place.alias("_place")).agg(F.count("*").alias("_n"), F.first("_base").alias("_base"), F.first("_rest").alias("_rest"))
    size = F.col("_place._size")
    order = Window.partitionBy("source").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("_begin", F.col("_base") + F.coalesce(F.sum(size * F.col("_n")).over(order), F.lit(0)))
    fits = lambda m: F.col("_begin") + m * size - size / 2.0 <= F.col("_rest")
    near = F.greatest(F.lit(0), F.least(F.col("_n"), F.floor((F.col("_rest") - F.col("_begin")) / size + 0.5))).cast("long")
    edge = edge.withColumn("_m", F.when(size == 0, F.when(F.col("_begin") <= F.col("_rest"), F.col("_n")).otherwise(0)).otherwise(near))
    # The quotient may have been rounded over the border.
    m = F.col("_m") + F.when((size > 0) & (F.col("_m") < F.col("_n")) & fits(F.col("_m") + 1), 1).otherwise(0) - F.when((size > 0) & (F.col("_m") > 0) & ~fits(F.col("_m")), 1).otherwise(0)
    edge = edge.withColumn("_m", m)
    part = (F.col("_m") > 0) & (F.col("_m") < F.col("_n"))
    cut = edge.groupBy("source").agg(F.max(F.when(F.col("_m") == F.col("_n"), F.col("_place"))).alias("_cut"), F.max(F.when(part, F.struct("_place", "_m"))).alias("_part"))
    plan = goal.join(last.select(F.col("source").alias("_s"), "_last"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    plan = plan.join(cut.select(F.col("source").alias("_s"), "_cut", "_part"), F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("_s"), "source_size", "target", "_epochs", "_last", "_cut", F.col("_part._place").alias("_part"), F.col("_part._m").alias("_m"))
    plan = written.keep(plan)
    if plan.where("_part is not null").isEmpty():
        plan = plan.withColumn("_to", F.lit(None).cast("long"))
        keyed = keyed if slim else keyed.withColumn("_at", F.lit(0).cast("long"))
    else:
        if not slim:
            keyed = written.keep(keyed.withColumn("_at", F.monotonically_increasing_id()))
        plan = _tied(keyed, plan)
    out = keyed.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    more = F.coalesce(F.col("_bucket") < F.col("_last"), F.lit(False)) | F.coalesce((F.col("_bucket") == F.col("_last")) & (place <= F.col("_cut")), F.lit(False)) | F.coalesce((place == F.col("_part")) & (F.col("_at") <= F.col("_to")), F.lit(False))
    out = out.withColumn("taken", F.col("_size") * (F.col("_epochs") + more.cast("long"))).withColumn("_copies", F.col("_epochs") + more.cast("long"))
    return out.withColumnRenamed("_size", "size").drop("_s", "_key", "_bucket", "_last", "_cut", "_epochs", "_part", "_m", "_to", "_at")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs."""
    taken = mix(docs, **options).where("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return mix(table(spark, sf_dir, "documents"), slim=True).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         -ln((CAST(CAST(concat('0x', substr(md5(concat('7:', coalesce(CAST(doc_id AS VARCHAR), concat('null:', md5(coalesce(text, '')))))), 1, 13)) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
         / CASE WHEN length(coalesce(text, '')) = 0 THEN 1.0
                ELSE 1.0 / (1.0 + 20.0 * (length(text) - length(translate(text, '#*$%&|<>', ''))) / length(text)) END AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w,
             3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev
      FROM r WINDOW b AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, least(cap, w * (SELECT lev FROM l WHERE lev < cap / w ORDER BY cap / w, rk LIMIT 1)) AS t0, cap FROM l),
t AS (SELECT source, source_size, coalesce(t0, cap) AS target FROM g),
c AS (SELECT d.*, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS e,
             sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (e + CASE WHEN target - e * source_size > 0 AND upto - size / 2.0 <= target - e * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
