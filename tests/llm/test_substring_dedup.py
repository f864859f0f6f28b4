"""Removal of repeated strings against brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lectern.llm import substring_dedup as S


def brute(texts, length):
    """(spans, kept) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans, at = [], 0
        while (a := gone.find(1, at)) >= 0:
            at = gone.find(0, a)
            at = len(b) if at < 0 else at
            spans.append((a, at - a))
        out.append((spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def corpus(seed, n, words, passage):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 8)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(passage) for _ in range(4)]
    texts = [prose(rng.randint(0, words)) + (rng.choice(shared)[rng.randint(0, 9) :] if rng.random() < 0.6 else "") + prose(rng.randint(0, words)) for _ in range(n)]
    for t in texts[: n // 4]:  # near copies
        k = rng.randrange(len(t) + 1)
        texts.append(t[:k] + rng.choice(["", "x", "yy zz"]) + t[k + rng.randint(0, 2) :])
    return [*texts, texts[0], texts[1], texts[1], None, "", "a" * 300, "b" * 130, "ab" * 120, "abc" * 31 + "é" * 50]


def check(spark, texts, **k):
    docs = spark.createDataFrame([(i, t, "k", i) for i, t in enumerate(texts)], "doc_id int, text string, Kept string, t int")
    got = {r.doc_id: r for r in S.remove_repeated(docs, **k).collect()}
    assert len(got) == len(texts)
    n = 0
    for i, (spans, kept) in enumerate(brute(texts, k["length"])):
        r = got[i]
        assert [tuple(s) for s in r.spans] == spans and bytes(r.kept) == kept and r.n_bytes == len((texts[i] or "").encode()) and r.text == texts[i] and r.t == i, (i, texts[i])
        n += bool(spans)
    assert n


@pytest.mark.parametrize("group", [0, 3])
def test_against_brute_force(spark, group):
    check(spark, corpus(group, 60, 30, 25), length=40, context=6, widths=(7, 3, 1), group=group)


def test_whole_contract(spark):
    check(spark, corpus(5, 25, 90, 160), length=S.LENGTH, context=S.CONTEXT, widths=S.WIDTHS, group=S.GROUP)


def test_many_holders(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh") for _ in range(60))
    texts = ["".join(rng.choice("xyz") for _ in range(rng.randint(5, 30))) + passage + "".join(rng.choice("uvw") for _ in range(rng.randint(0, 12))) for _ in range(600)]
    check(spark, texts, length=56, context=8, widths=(12, 4, 1), group=100)


def test_chunks_of_a_long_text():
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 100, 5000, np.uint8))
    for chunk in (64, 700, S.CHUNK):
        rows = [(int(s), int(n), int(a), int(k)) for part in S.Anchors(40, 6, chunk)(text) for s, n, a, k in zip(*part)]
        assert [x for s, n, _, _ in rows for x in range(s, s + n)] == list(range(5000 - 39))
        assert len({(text[s + a : s + a + 6], k) for s, _, a, k in rows}) == len({k for *_, k in rows})
        assert all(s + n - 1 <= s + a and s + a + 6 <= s + 40 for s, n, a, _ in rows)


def test_induced_order():
    rng = random.Random(4)
    length, width, rows = 12, 5, []
    for _ in range(400):
        near = rng.randint(0, 2)
        far = rng.randint(near, 4)
        rows.append((rng.randint(0, 3), bytes(rng.choice(b"ab") for _ in range(length - near)), bytes(rng.choice(b"ab") for _ in range(far)), near, far))
    rows.sort(key=lambda r: r[:2])
    equal = S.induce(np.array([r[0] for r in rows]), [r[1] for r in rows], [r[2] for r in rows], np.array([r[4] for r in rows]), width, length)
    window = lambda r, k: (r[0], (r[2][:k][::-1] + r[1])[:length])
    for k in range(width):
        held = [(i, window(r, k)) for i, r in enumerate(rows) if r[3] <= k <= r[4]]
        count = Counter(w for _, w in held)
        assert all(equal[i, k] == (count[w] > 1) for i, w in held)


def test_empty_and_short(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert S.remove_repeated(docs).count() == 0
    short = spark.createDataFrame([(1, "abc"), (1, "abc"), (None, None)], "doc_id int, text string")
    assert all(r.spans == [] and bytes(r.kept) == (r.text or "").encode() for r in S.remove_repeated(short).collect())
    with pytest.raises(ValueError):
        S.remove_repeated(docs, widths=(8, 2))
    assert hashlib.sha256(b"").hexdigest() == short.selectExpr("sha2(cast('' as binary), 256) as h").first().h
