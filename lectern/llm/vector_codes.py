"""Vector code compression: product codes from weighted Lloyd rounds over distinct parts.

A vector becomes integers and is cut into parts. Equal parts of one position are one row with a weight
(partial aggregation in the tasks, so copies cost nothing), rounds run over these rows alone, and the
last assignment is joined back to the vectors, hot parts dealt over tasks. Sums are exact; the entries
(parts x entries x width integers, whatever the table's size) are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, Written, hot_join, table

#: Contract of the query: parts of a vector, entries of a part's codebook, rounds, integer steps in 1.
PARTS, ENTRIES, ROUNDS, STEPS = 16, 64, 2, 256
#: Integers beyond it are set to it.
MOST = 2**62
_LONG = 2**63 - 1
RESULTS = ("code", "error")


def _pack(x: np.ndarray) -> bytes:
    return (x.astype("<i4") if not x.size or (x.min() >= -(2**31) and x.max() < 2**31) else x.astype("<i8")).tobytes()


def _unpack(values: list[bytes], width: int) -> np.ndarray:
    """Rows of integers; Python's own where squares could leave 64 bits."""
    out = np.zeros((len(values), width), np.int64)
    narrow = np.array([len(v) == 4 * width for v in values], bool)
    for mask, kind in ((narrow, "<i4"), (~narrow, "<i8")):
        if width and mask.any():
            out[mask] = np.frombuffer(b"".join(v for v, m in zip(values, mask, strict=True) if m), kind).reshape(-1, width)
    return out


def _wide(*arrays: np.ndarray) -> bool:
    """Whether 64 bits may not hold a squared distance."""
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    return (2 * most) ** 2 * max(a.shape[-1] for a in arrays) > _LONG


def _parts(n_parts: int, steps: int):
    @F.pandas_udf("array<binary>")
    def run(vectors: pd.Series) -> pd.Series:
        rows = []
        for v in vectors:
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(np.asarray(v, np.float64) * steps), -float(MOST), float(MOST)).astype(np.int64)
            rows.append([_pack(p) for p in x.reshape(n_parts, -1)])
        return pd.Series(rows, dtype="object")

    return run


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry; ties go to the lower index."""
    if _wide(x, book):
        x, book = x.astype(object), book.astype(object)
    index, error = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    for lo in range(0, len(x), 2000):
        d = ((x[lo : lo + 2000, None, :] - book[None]) ** 2).sum(axis=2)
        index[lo : lo + 2000] = at = d.argmin(axis=1)
        error[lo : lo + 2000] = d[np.arange(len(d)), at]
    return index, error


def _assigned(books: np.ndarray):
    """Rows (part, values, weight) with code and error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            code, error = np.zeros(len(batch), np.int64), np.zeros(len(batch), object)
            for part, at in batch.groupby("part").indices.items():
                code[at], error[at] = nearest(_unpack(batch["values"].iloc[at].tolist(), books.shape[2]), books[part])
            yield pd.DataFrame({"part": batch["part"], "values": batch["values"], "code": code.astype(np.int32), "error": np.array([min(int(e), _LONG) for e in error], np.int64)})

    return run


def _summed(books: np.ndarray):
    """A task's sums by part and nearest entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from decimal import Decimal

        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for part, at in batch.groupby("part").indices.items():
                x, weight = _unpack(batch["values"].iloc[at].tolist(), books.shape[2]), batch["weight"].to_numpy()[at]
                code, _ = nearest(x, books[part])
                exact = object if x.size and int(np.abs(x).max()) * int(weight.sum()) > _LONG else np.int64
                for k in np.unique(code):
                    of = code == k
                    got = sums.setdefault((int(part), int(k)), [0, [0] * x.shape[1]])
                    got[0] += int(weight[of].sum())
                    more = (x[of].astype(exact) * weight[of, None].astype(exact)).sum(axis=0)
                    got[1] = [a + int(b) for a, b in zip(got[1], more, strict=True)]
        yield pd.DataFrame([(p, k, n, [Decimal(v) for v in s]) for (p, k), (n, s) in sums.items()], columns=["part", "code", "n", "sums"])

    return run


def compress(vectors: DataFrame, vector: str = "embedding", order: str = "vec_id", n_parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS, steps: int = STEPS) -> tuple[DataFrame, np.ndarray]:
    """(rows with code and error in place of the vector, codebooks as an array by part, entry and position).

    Rows whose vector is null or holds null, NaN or infinite components are left out. Codebooks start
    as the parts of the first n_entries vectors by ``order`` (nulls last, equal ones by their integers; fewer
    where there are fewer), and have 256 entries at most. code has two hex digits a part; error is the summed squared
    distance, in integer steps. Vectors have the commonest length that n_parts divides (of equally common ones
    the greatest); those of another length have a null code and error and touch nothing else. Integers
    stop at +-2^62 and errors at 2^63 - 1. Repeated rows count and come out as often as they occur;
    other columns stay, but those named code or error give way; an empty table gives no row and no entry.
    """
    if not 0 < n_entries <= 256:
        raise ValueError("a code has two hex digits")
    written = Written(vectors.sparkSession, "codes")
    keep = written.keep
    rest = [c for c in vectors.columns if c != vector and c.lower() not in RESULTS]
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    there = vectors.where(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    common = there.groupBy(F.size(vector).alias("n")).count().where(F.col("n") % n_parts == 0).orderBy(F.desc("count"), F.desc("n")).first()
    length = common.n if common else 0
    fits = F.size(vector) == length
    # The row's number is stored with it, so that it is the same whenever it is read.
    rows = keep(there.select(F.monotonically_increasing_id().alias("_row"), F.struct(F.col(order).alias("_order"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)]).alias("_rest"), F.when(fits, _parts(n_parts, steps)(F.when(fits, F.col(vector)).otherwise(F.array_repeat(F.lit(0).cast(vectors.schema[vector].dataType.elementType), n_parts)))).alias("_parts")))
    whole = rows.where("_parts is not null")
    first = whole.orderBy(F.col("_rest._order").asc_nulls_last(), "_parts").limit(n_entries).select("_parts").collect()
    width = length // n_parts
    books = np.zeros((n_parts, len(first), width), np.int64)
    for e, row in enumerate(first):
        books[:, e] = _unpack([bytes(p) for p in row[0]], width)

    named = [F.col("_rest").getField(f"c{i}").alias(c) for i, c in enumerate(rest)]
    if not first:
        return rows.select(*named, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), books
    places = whole.select("_row", F.posexplode("_parts").alias("part", "values"))
    distinct = keep(places.groupBy("part", "values").agg(F.count("*").alias("weight")))
    for _ in range(rounds):
        sums = distinct.mapInPandas(_summed(books), "part int, code int, n long, sums array<decimal(38,0)>")
        total = sums.groupBy("part", "code").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)])
        for r in total.collect():  # an entry a row
            books[r.part, r.code] = [int(r[f"s{j}"]) // r.n for j in range(width)]
    codes = distinct.mapInPandas(_assigned(books), "part int, values binary, code int, error long").withColumnsRenamed({"part": "_p", "values": "_v"})
    n = whole.count()
    hot = distinct.where(F.col("weight") * HOT > n * n_parts).select("part", "values")
    out = hot_join(places, ["part", "values"], codes, ["_p", "_v"], n * n_parts, hot=hot)
    digits = F.transform(F.array_sort(F.collect_list(F.struct("part", "code"))), lambda x: F.lpad(F.lower(F.hex(x["code"])), 2, "0"))
    error = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    out = out.groupBy("_row").agg(F.array_join(digits, "").alias("_code"), error.alias("_error")).withColumnRenamed("_row", "_r")
    out = rows.select("_row", "_rest").join(out, F.col("_row") == F.col("_r"), "left")
    return out.select(*named, F.col("_code").alias("code"), F.col("_error").alias("error")), books


def fingerprint(books: np.ndarray) -> str:
    """sha256 of all entries' integers."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings; label_error sums a label's errors, null labels together."""
    out, books = compress(table(spark, sf_dir, "embeddings"))
    out = Written(spark, "codes").keep(out.select("vec_id", "label", "code", "error").withColumns({"_null": F.col("label").isNull(), "_key": F.coalesce(F.col("label").cast("string"), F.lit(""))}))
    sums = out.groupBy(F.col("_null").alias("_n"), F.col("_key").alias("_k")).agg(F.sum("error").alias("label_error"))
    out = hot_join(out, ["_null", "_key"], sums, ["_n", "_k"], out.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def _assign_sql(k: int) -> str:
    return f"""a{k} AS MATERIALIZED (SELECT part, x, n, b.i AS code, b.q AS error FROM (SELECT d.part, d.x, any_value(d.n) AS n,
  min({{'q': list_sum(list_transform(range(1, len(d.x) + 1), lambda j: (d.x[j] - c.e[j]) * (d.x[j] - c.e[j]))), 'i': c.i}}) AS b FROM d JOIN c{k} c USING (part) GROUP BY d.part, d.x))"""


def _update_sql(k: int) -> str:
    return f"""s{k} AS (SELECT part, code AS i, j, sum(n) AS n, sum(n * x[j]) AS s FROM (SELECT *, unnest(range(1, len(x) + 1)) AS j FROM a{k}) GROUP BY ALL),
u{k} AS (SELECT part, i, list((s - ((s % n) + n) % n) // n ORDER BY j) AS e FROM s{k} GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.i, coalesce(u.e, c.e) AS e FROM c{k} c LEFT JOIN u{k} u USING (part, i))"""


SQL = f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({STEPS} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, vec_id, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS x FROM k, (SELECT unnest(range({PARTS})) AS part)),
d AS MATERIALIZED (SELECT part, x, count(*) AS n FROM p GROUP BY ALL),
c0 AS MATERIALIZED (SELECT part, i - 1 AS i, x AS e FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS i FROM p) WHERE i <= {ENTRIES}),
{_assign_sql(0)}, {_update_sql(0)}, {_assign_sql(1)}, {_update_sql(1)}, {_assign_sql(2)},
h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, i, j)) AS h FROM (SELECT part, i, unnest(range(1, len(e) + 1)) AS j, unnest(e) AS v FROM c2)),
o AS (SELECT r, string_agg(printf('%02x', code), '' ORDER BY part) AS code, sum(error) AS error FROM p JOIN a2 USING (part, x) GROUP BY r)
SELECT vec_id, o.code, CAST(o.error AS BIGINT) AS error, CAST(sum(o.error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM h) AS codebooks_sha256 FROM k JOIN o USING (r)"""
