"""Vector codes against plain Python, and odd rows."""

import random

import numpy as np
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from lectern.llm import vector_codes as V

SCHEMA = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("label", IntegerType()), StructField("_row", StringType()), StructField("Code", StringType())])


def brute(rows, n_parts, n_entries, rounds):
    """(codes by position in rows, errors, books) in Python's integers, vector by vector."""
    ints = [[int(np.floor(256 * x)) for x in r[1]] for r in rows]
    width = len(ints[0]) // n_parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(n_parts)] for v in ints]
    first = sorted(range(len(rows)), key=lambda i: rows[i][0])[:n_entries]
    books = [[cut[i][p] for i in first] for p in range(n_parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(n_parts):
            members = {}
            for v in cut:
                members.setdefault(near(v[p], books[p])[1], []).append(v[p])
            books[p] = [tuple(sum(c) // len(members[k]) for c in zip(*members[k])) if k in members else e for k, e in enumerate(books[p])]
    got = [[near(v[p], books[p]) for p in range(n_parts)] for v in cut]
    return ["".join(f"{k:02x}" for _, k in g) for g in got], [sum(d for d, _ in g) for g in got], books


def _made(n, dim, seed, scale=1.0):
    rng = random.Random(seed)
    pool = [[rng.choice([-1.5, -0.3, -0.004, 0.0, 0.25, 0.7, 1e-9]) * scale * rng.random() for _ in range(dim)] for _ in range(max(3, n // 3))]
    return [(i, list(rng.choice(pool)) if i % 2 else [rng.gauss(0, scale) for _ in range(dim)], rng.choice([1, 2, None]), "x", "y") for i in range(n)]


def _check(spark, rows, n_parts, n_entries, rounds=2):
    out, books = V.compress(spark.createDataFrame(rows, SCHEMA), n_parts=n_parts, n_entries=n_entries, rounds=rounds)
    codes, errors, expected = brute(rows, n_parts, n_entries, rounds)
    assert books.tolist() == [[list(e) for e in book] for book in expected]
    assert sorted((r.vec_id, r.code, r.error, r._row) for r in out.collect()) == sorted((r[0], c, e, "x") for r, c, e in zip(rows, codes, errors))
    assert out.columns == ["vec_id", "label", "_row", "code", "error"]


def test_against_python(spark):
    _check(spark, _made(120, 8, 1), 4, 10)
    _check(spark, _made(40, 4, 2, 1e6), 2, 64)
    _check(spark, [*_made(30, 4, 3), (30, [1e12, -1e12, 5.0, 0.0], 1, "x", "y")], 2, 5)


def test_hot_and_repeated_rows(spark):
    rows = [(i, [0.5, 0.5, 0.25, 0.25] if i % 2 else [i / 7, -i / 3, 0.1, 0.2], 1, "x", "y") for i in range(1500)]
    _check(spark, rows, 2, 8)
    out, _ = V.compress(spark.createDataFrame([(7, [1.0, 2.0], 1, "x", "y")] * 3, SCHEMA), n_parts=2)
    assert [(r.vec_id, r.code, r.error) for r in out.collect()] == [(7, "0000", 0)] * 3


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0], 1, None, "y"), (2, None, 1, None, "y"), (3, [1.0, None], 1, None, "y"), (4, [float("nan"), 1.0], None, None, "y"), (5, [float("inf"), 1.0], 1, None, "y"), (None, [3.0, 2.0], None, None, "y"), (6, [1.0], 1, None, "y"), (8, [], 1, None, "y"), (9, [1e300, -1e300], 1, None, "y")]
    out, books = V.compress(spark.createDataFrame(rows, SCHEMA), n_parts=2, rounds=0)
    got = {r.vec_id: (r.code, r.error) for r in out.collect()}
    assert set(got) == {1, None, 6, 8, 9} and got[1] == ("0000", 0) and got[6] == got[8] == (None, None) and got[None] == ("0200", 0) and got[9] == ("0101", 0)
    assert books[0].tolist() == [[256], [V.MOST], [768]]


def test_empty(spark):
    for rows in ([], [(1, None, 1, None, None)], [(1, [1.0], 1, None, None)]):
        out, books = V.compress(spark.createDataFrame(rows, SCHEMA), n_parts=2)
        assert [(r.code, r.error) for r in out.collect()] == [(None, None)] * (bool(rows) and rows[0][1] is not None) and books.size == 0
    assert V.fingerprint(np.array([[[1, -2]]])) == V.hashlib.sha256(b"1,-2").hexdigest()
