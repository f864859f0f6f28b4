"""Cascading erasure against plain Python, file by file."""

import hashlib
import math
import os
import random
import zlib
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lectern.llm import erasure as E

TYPES = {
    "clients": [("client_id", pa.int64()), ("master_id", pa.int64()), ("source", pa.string()), ("balance", pa.float64()), ("_name", pa.string()), ("c0", pa.int32())],
    "clicks": [("click_id", pa.int64()), ("ts", pa.timestamp("us")), ("client_id", pa.int64()), ("kind", pa.string()), ("value", pa.float64())],
    "sales": [("sale_id", pa.int64()), ("client_id", pa.int64()), ("total", pa.float64())],
    "sale_lines": [("sale_id", pa.int64()), ("line_no", pa.int32()), ("amount", pa.float64()), ("_row", pa.string())],
}
MONEY = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def made(n, seed):
    rng = random.Random(seed)
    masters = [m for m in range(6000) if zlib.crc32(str(m).encode()) % 200 == 0][:4] + list(range(10, 30))
    some = lambda f: None if rng.random() < 0.1 else f()
    money = lambda: some(lambda: rng.choice([-3.005, 0.1, 2.675, -0.0, float("nan"), float("inf")]) if rng.random() < 0.3 else round(rng.uniform(-9, 99), 2))
    clients = [(some(lambda i=i: i), some(lambda: rng.choice(masters)), some(lambda: rng.choice(["é", "", "b"])), money(), "n", None) for i in range(n)]
    clicks = [(some(lambda i=i: i), datetime(2024, 1, 1 + i % 28), some(lambda: 3 if rng.random() < 0.3 else rng.randrange(n)), "k", money()) for i in range(3 * n)]
    clicks += [(1, datetime(2024, 1, 1), 5, "same", 1.0)] * n
    sales = [(some(lambda i=i: i % (2 * n - 9)), some(lambda: rng.randrange(n)), money()) for i in range(2 * n)]
    lines = [(some(lambda: 7 if rng.random() < 0.3 else rng.randrange(2 * n + 9)), rng.randrange(3), money(), "x") for i in range(4 * n)]
    return {"clients": clients, "clicks": clicks, "sales": sales, "sale_lines": lines}


def brute(tables, most):
    """{(table, file_no): (rows left, erased)} of the final files."""
    pos = {t: {c: i for i, (c, _) in enumerate(kinds)} for t, kinds in TYPES.items()}
    get = lambda t, r, c: r[pos[t][c]]
    of_sale = {}
    for r in tables["sales"]:
        if r[0] is not None:
            of_sale.setdefault(r[0], set()).add(r[1])
    first = {s: min((c for c in cs if c is not None), default=None) for s, cs in of_sale.items()}
    crc = lambda v: zlib.crc32(b"" if v is None else str(v).encode())

    def value(x):  # Spark's order: nulls, numbers, NaN; strings by their bytes
        if x is None:
            return (0,)
        if isinstance(x, float):
            return (2,) if math.isnan(x) else (1, x)
        return (1, x.encode() if isinstance(x, str) else x)

    client = lambda t, r: first.get(r[0]) if t == "sale_lines" else get(t, r, "client_id")
    there = [r for r in tables["clients"] if r[1] is not None]
    count = {m: 0 for _, m, *_ in there}
    clicked = {}
    for r in tables["clicks"]:
        clicked[r[2]] = clicked.get(r[2], 0) + 1
    for m, c in {(r[1], r[0]) for r in there if r[0] is not None}:
        count[m] += clicked.get(c, 0)
    top = min(count, key=lambda m: (-count[m], m), default=None)
    bad_master = lambda m: m is not None and (zlib.crc32(str(m).encode()) % 200 == 0 or m == top)
    clients = {r[0] for r in tables["clients"] if bad_master(r[1])} - {None}
    sales = {r[0] for r in tables["sales"] if r[1] in clients} - {None}
    bad = {"clients": lambda r: bad_master(r[1]), "clicks": lambda r: r[2] in clients, "sales": lambda r: r[1] in clients, "sale_lines": lambda r: r[0] in sales}
    out = {}
    for t, rows in tables.items():
        rows = sorted(rows, key=lambda r: (crc(client(t, r)), [value(x) for x in r]))
        each = 1 + len(rows) // most
        for no in range(-(-len(rows) // each)):
            part = rows[no * each : (no + 1) * each]
            left = [r for r in part if not bad[t](r)]
            if left:
                out[t, no] = (left, len(part) - len(left))
    return out


def write(tables, folder):
    for t, kinds in TYPES.items():
        table = pa.table({c: pa.array([r[i] for r in tables[t]], k) for i, (c, k) in enumerate(kinds)})
        pq.write_table(table, f"{folder}/{t}.parquet")
    return str(folder)


def same(a, b):
    return [tuple("nan" if x != x else x for x in r) for r in a] == [tuple("nan" if x != x else x for x in r) for r in b]


@pytest.mark.parametrize("n,most", [(40, 7), (300, 5)])
def test_against_python(spark, tmp_path, n, most):
    tables = made(n, n)
    got = E.query(spark, write(tables, tmp_path), most).collect()
    expected = brute(tables, most)
    assert {(r.table_name, r.file_no) for r in got} == set(expected) and any(r.rewritten for r in got)
    for r in got:
        rows, erased = expected[r.table_name, r.file_no]
        kinds = TYPES[r.table_name]
        path = r.path.removeprefix("file:")
        found = pq.read_table(path, partitioning=None)
        assert found.column_names == [c for c, _ in kinds] and r.columns == ",".join(c for c, _ in kinds)
        assert same(zip(*[found.column(i).to_pylist() for i in range(len(kinds))]), rows)
        at = [c for c, _ in kinds].index(MONEY[r.table_name])
        cents = sum(math.floor(100 * x[at] + 0.5) for x in rows if x[at] is not None and math.isfinite(x[at]))
        assert (r.n_rows, r.n_erased, r.rewritten, r.cents) == (len(rows), erased, erased > 0, cents)
        assert r.ids_sha256 == hashlib.sha256(",".join("" if x[0] is None else str(x[0]) for x in rows).encode()).hexdigest()
        low = [pq.ParquetFile(path).metadata.row_group(g).column(0).statistics for g in range(pq.ParquetFile(path).num_row_groups)]
        ids = [x[0] for x in rows if x[0] is not None]
        assert not ids or min(s.min for s in low if s.has_min_max) == min(ids)
    folder = os.path.dirname(os.path.dirname(got[0].path.removeprefix("file:")))
    on_disk = {os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}
    assert on_disk == {r.path.removeprefix("file:") for r in got}


def test_empty_and_one_client(spark, tmp_path):
    none = {t: [] for t in TYPES}
    assert E.query(spark, write(none, tmp_path)).count() == 0
    # The only master is the one with most clicks, even of none: its client goes, and with it the file.
    one = none | {"clients": [(1, 9, "s", 1.0, "n", 1), (2, None, "s", 2.0, "n", 1)], "sale_lines": [(5, 1, 1.0, "x")], "sales": [(5, 1, 1.0), (6, 2, 2.5)]}
    assert sorted((r.table_name, r.n_rows, r.cents, r.n_erased) for r in E.query(spark, write(one, tmp_path), 1).collect()) == [("clients", 1, 200, 1), ("sales", 1, 250, 1)]
