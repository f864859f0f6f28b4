"""Operators on small fixtures, against rules restated in plain Python where order matters."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import audit, chunking, conversations, encoding, evaluation, ingest, layout, retrieval


def test_slices_cover(spark):
    rows = [(i, "".join(random.Random(i).choices("abc \n", k=n))) for i, n in enumerate((10, 6000, 6001, 11600, 20000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("title", F.lit("T"))
    got = {}
    for r in chunking.slices(df).orderBy("doc_id", "slice_pos").collect():
        got.setdefault(r.doc_id, []).append(r.piece)
    for i, text in rows:
        want = [text] if len(text) <= 6000 else [("" if s == 0 else "[continued — T]\n\n") + text[s : s + 6000] for s in range(0, len(text), 5700)]
        assert got[i] == want


def test_chunk_pipeline(spark):
    text = "\n".join(["intro text that is long", "## 4.4.1 First Part", "body of the first part", "<!-- Page 2 -->", "more body", "ASSET RECORD FORM", "<!-- Page 3 -->", "page three content here", "<!-- Page 4 -->", "x\nfour and more content", "6.6 Empty Part"])
    df = spark.createDataFrame([("d", "d", text), ("e", "e", "just one line")], "doc_id string, source string, text string")
    got = [(r.title, r.text) for r in chunking.chunk(df).where("doc_id = 'd'").orderBy("chunk_id").collect()]
    assert [t for t, _ in got] == ["4.4.1 First Part", "x"]
    assert got[0][1].startswith("## 4.4.1") or "body of the first part" in got[0][1]
    faq = "Intro\n\n1. How many?\nseven\n\n2. Why so?\nbecause\n3. no question\n"
    df = spark.createDataFrame([("f", "f", faq)], "doc_id string, source string, text string")
    got = chunking.chunk(df, faq=True).orderBy("section_pos").collect()
    assert [(r.title, r.text) for r in got] == [("Intro", "Intro"), ("How many?", "1. How many?\nseven"), ("Why so?", "2. Why so?\nbecause\n3. no question")]


@pytest.mark.parametrize(
    "rows,expected",
    [
        ([(0, "v", 0.97), (1, "o", 0.5)], [(0, 1.0)]),
        ([(0, "v", 0.10), (1, "o", 0.05)], [(0, 0.10)]),
        ([(0, "o", 0.9), (1, "v", 0.8)], [(0, 0.9), (1, 0.8)]),
        ([(0, "o", 0.9), (1, "o", 0.1), (2, "o", 0.3)], [(0, 0.9), (2, 0.3)]),
        ([(0, "o", 0.1), (1, "o", 0.05)], [(0, 0.1)]),
        ([(0, "v", 0.92), (1, "v", 0.95), (2, "o", 0.3)], [(0, 1.0)]),
    ],
)
def test_boost_collapse_threshold(spark, rows, expected):
    df = spark.createDataFrame([(1, p, s, r) for p, s, r in rows], "query_id int, cand_pos int, source string, raw double")
    out = retrieval.threshold(retrieval.collapse(retrieval.boost(df, F.col("source") == "v")))
    assert [(r.cand_pos, r.score) for r in out.orderBy("rank").collect()] == expected


def test_hybrid_search_is_bounded(spark):
    rng = np.random.default_rng(0)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    docs = [(i, f"s{i % 3}", f"t{i}", " ".join(rng.choice(words, 20))) for i in range(60)]
    vec = rng.normal(size=(60, 8))
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    chunks = spark.createDataFrame(docs, "chunk_id long, source string, title string, text string")
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(0, "alpha beta", vec[3].tolist()), (1, "zzz", vec[5].tolist())], "query_id long, text string, embedding array<double>")
    out = retrieval.hybrid_search(queries, chunks, vectors, "s1").collect()
    assert {r.query_id for r in out} == {0, 1}
    pairs = [(r.query_id, r.chunk_id) for r in out]
    assert len(pairs) == len(set(pairs)) and max(r["rank"] for r in out) <= 3
    dense = retrieval.cosine(queries, vectors, 5, max_queries_bytes=64).collect()
    for q, k in ((0, 3), (1, 5)):
        want = np.argsort(-(vec @ vec[k]), kind="stable")[:5].tolist()
        assert [r.chunk_id for r in sorted((r for r in dense if r.query_id == q), key=lambda r: r["rank"])] == want


def test_stored_index(spark, tmp_path):
    """An index gives what the chunks give; a question without a vector keeps its lexical leg; a batch of many terms shuffles."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(30)] + ["the"] * 5
    chunks = spark.createDataFrame([(i, f"s{i % 3}", f"t{i}", " ".join(rng.choice(words, 25))) for i in range(80)], "chunk_id long, source string, title string, text string")
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(70, 6)))] + [(75, None)], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(0, "the w1 w2", rng.normal(size=6).tolist()), (1, "w3 w4 unknown", None), (2, "", None)], "query_id long, text string, embedding array<double>")
    index = retrieval.build_index(chunks, vectors, f"{tmp_path}/index")
    again = retrieval.load_index(spark, f"{tmp_path}/index")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(retrieval.hybrid_search(queries, chunks, vectors, "s1", min_score=0.0))
    assert rows(retrieval.hybrid_search(queries, index, None, "s1", min_score=0.0)) == want == rows(retrieval.hybrid_search(queries, again, None, "s1", min_score=0.0))
    assert {r[0] for r in want} == {0, 1}
    few = retrieval.BROADCAST_TERMS
    try:
        retrieval.BROADCAST_TERMS = 0
        assert rows(retrieval.bm25(queries, again)) == rows(retrieval.bm25(queries, retrieval.indexed_text(chunks)))
    finally:
        retrieval.BROADCAST_TERMS = few


def test_encoder_hook(spark):
    df = spark.createDataFrame([("a", "one two"), ("b", None), ("c", "two two two")], "id string, text string")
    seen = lambda texts: [[len(t), t.count("q: "), 0.0] for t in texts]
    got = {r.id: r.embedding for r in encoding.embed(df, "id", seen, prefix="q: ", batch=2).collect()}
    assert got["a"] == pytest.approx((np.array([10, 1, 0]) / np.hypot(10, 1)).tolist()) and got["b"][1] > 0
    same = {r.id: np.array(r.embedding) for r in encoding.embed(df, "id", encoding.hashed_terms(16)).collect()}
    assert np.linalg.norm(same["a"]) == pytest.approx(1) and not same["b"].any() and same["a"] @ same["c"] == pytest.approx(0.5**0.5)


def _order(words):
    """Reading order by the rules, one word after the other."""
    if not words:
        return "", 0
    lo, hi = min(w["left"] for w in words), max(w["right"] for w in words)
    filled = set()
    for w in words:
        filled |= set(range((w["left"] - lo) // 5, (w["right"] - lo) // 5 + 1))
    cuts, prev = [], None
    for b in sorted(filled):
        if prev is not None and (b - prev - 1) * 5 >= 15:
            cuts.append((prev + 1 + b) // 2 * 5 + lo)
        prev = b
    cuts = [lo - 1, *cuts, hi + 1]
    lines, n = [], 0
    for a, b in zip(cuts, cuts[1:]):
        col = sorted((w for w in words if a <= w["left"] < b), key=lambda w: w["top"])
        groups = []
        for w in col:
            for g in groups:
                if abs(g[0]["top"] - w["top"]) < 12:
                    g.append(w)
                    break
            else:
                groups.append([w])
        if col:
            n += 1
            lines += [" ".join(w["text"] for w in sorted(g, key=lambda w: w["left"])) for g in groups] + [""]
    return "\n".join(lines).strip(), n


def test_reading_order(spark):
    rng = random.Random(1)
    pages, rows = {}, []
    for p in range(40):
        pages[p] = []
        for k in range(rng.randrange(1, 25)):
            left = rng.randrange(300)
            w = {"page_id": p, "word_pos": k, "text": f"w{k}", "left": left, "top": rng.randrange(80), "right": left + rng.randrange(5, 40)}
            pages[p].append(w)
            rows.append(w)
    df = spark.createDataFrame(rows, "page_id int, word_pos int, text string, left int, top int, right int")
    for r in layout.reading_order(df).collect():
        assert (r.text, r.column_count) == _order(pages[r.page_id])


def test_ocr_of_many_pages(spark, monkeypatch):
    """Pages are read once and handed on together; their words meet in one exchange and no join."""
    monkeypatch.setattr(layout, "WORDS", 50, raising=False)
    rng, pages = random.Random(3), {}
    for p in range(300):
        size = 0 if p % 7 == 0 else 1500 if p == 100 else rng.randrange(1, 25)
        pages[p] = [(f"w{k}", rng.randrange(300), rng.randrange(80), rng.randrange(5, 40)) for k in range(size)]
    # A page in two rows is one page.
    rows = [(p, json.dumps(words)) for p, words in pages.items()] + [(5, json.dumps(pages[6]))]
    df = spark.createDataFrame(rows, "page_id int, item string")
    out = layout.ocr(df, json.loads)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    words = lambda p: [{"word_pos": k, "text": t, "left": x, "top": y, "right": x + w} for k, (t, x, y, w) in enumerate(pages[p])]
    got = {r.page_id: (r.ocr_text, r.n_columns) for r in out.collect()}
    assert out.count() == 300 and set(got) == set(pages)
    want = {p: words(p) for p in pages} | {5: sorted(words(5) + words(6), key=lambda w: w["word_pos"])}
    for p in pages:
        assert got[p] == _order(want[p])


def test_clusters_and_images(spark):
    df = spark.createDataFrame([([0.0, 5.0, 14.0, 30.0],), ([],)], "v array<double>")
    got = [r.c for r in df.select(layout.clusters(F.col("v")).alias("c")).collect()]
    assert [round(x, 3) for x in got[0]] == [6.333, 30.0] and got[1] == []
    rng, rows = random.Random(2), []
    for p in range(30):
        for k in range(6):
            x, y = rng.randrange(30), rng.randrange(30)
            rows.append((p, k, "get_images" if k < 3 else "text_dict", float(x), float(y), float(x + rng.randrange(0, 200)), float(y + rng.randrange(50, 200))))
    kept = {(r.page_id, r.pos) for r in layout.distinct_images(spark.createDataFrame(rows, "page_id int, pos int, origin string, x0 double, y0 double, x1 double, y1 double")).collect()}
    area = lambda r: abs((r[5] - r[3]) * (r[6] - r[4]))
    want = set()
    for p in range(30):
        have = []
        for r in (r for r in rows if r[0] == p):
            both = lambda k: max(0, min(k[5], r[5]) - max(k[3], r[3])) * max(0, min(k[6], r[6]) - max(k[4], r[4]))  # noqa: E731, B023
            if area(r) > 0 and not (r[2] == "text_dict" and any(both(k) > 0.9 * min(area(k), area(r)) for k in have)):
                have.append(r)
                want.add((p, r[1]))
    assert kept == want


BASE = dict(char_count=200, block_count=1, line_count=3, short_line_ratio=0.0, x_columns=1, y_rows=1, image_count=0, largest_image_ratio=0.0, total_image_ratio=0.0, drawing_count=0, horizontal_lines=0, vertical_lines=0, rectangles=0, filled_shapes=0, total_tables=0)


@pytest.mark.parametrize(
    "change,expected",
    [
        ({}, "NORMAL"),
        (dict(char_count=0, image_count=1, largest_image_ratio=0.6), "OCR"),
        (dict(char_count=0), "REVIEW"),
        (dict(image_count=1, largest_image_ratio=0.01, x_columns=4, y_rows=3), "IMAGE_FLOW_CANDIDATE"),
        (dict(image_count=1, largest_image_ratio=0.2), "IMAGE_CONTENT"),
        (dict(total_tables=1), "TABLE"),
        (dict(x_columns=8, y_rows=10, block_count=8), "FLOW_TABLE"),
        (dict(x_columns=8, y_rows=3), "REVIEW"),
    ],
)
def test_page_classes(spark, change, expected):
    row = BASE | change
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if 'ratio' in k else 'int'}" for k in row))
    got = audit.audit(df).first()
    assert got.classification == expected
    assert all(0 <= got[f"{n}_score"] <= 100 for n in ("table", "flow_table", "image", "ocr", "vision"))


def test_conversations(spark):
    rows = [("a", 0, "user", "x" * 50), ("a", 1, "assistant", "yes"), ("a", 2, "user", "and then?"), ("b", 0, "assistant", "hello"), ("c", 0, "user", "  ")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert {r.conv_id: r.title for r in conversations.titles(df).collect()} == {"a": "x" * 45 + "…", "b": "New chat", "c": "New chat"}
    got = {(r.conv_id, r.turn): r.search_query for r in conversations.rewrite(df).collect()}
    assert got[("a", 2)] == "x" * 50 + "\nand then?" and got[("a", 0)] == "x" * 50


def test_ingest(spark):
    pages = spark.createDataFrame([("s", n, n != 3) for n in range(1, 7)], "source string, page_num int, ok boolean")
    got = [r.vision for r in ingest.vision_budget(pages, F.lit(True), F.col("ok"), 3).orderBy("page_num").collect()]
    assert got == [True, True, False, True, False, False]
    texts = spark.createDataFrame([("s", 1, "one"), ("s", 3, "three")], "source string, page_num int, text string")
    assert ingest.page_markdown(texts).first().markdown == "<!-- Page 1 -->\n\none\n\n---\n\n<!-- Page 2 -->\n\n\n\n---\n\n<!-- Page 3 -->\n\nthree"
    files = spark.createDataFrame([("a.exe", 1, False), ("a.md", 6_000_000, False), ("a.pdf", 30_000_000, False), ("a.txt", 5, True), ("a.txt", 5, False)], "name string, n_bytes long, is_blank boolean")
    got = [r.message for r in ingest.validate_upload(files).collect()]
    assert got == ["Unsupported file type '.exe'. Only .md, .txt, .docx, .pdf are accepted here.", "File too large (6.0 MB). Limit for .md is 5 MB.", "File too large (30.0 MB). Limit for .pdf is 26 MB.", "File is empty.", ""]
    names = spark.createDataFrame([("a.md",), ("b.md",)], "name string")
    assert {r.final_name for r in ingest.final_names(names, names.where("name = 'a.md'"), 7).collect()} == {"a_7.md", "b.md"}


def test_evaluation(spark):
    results = spark.createDataFrame([(1, 1, "has 3 MONTHS"), (2, 1, "no")], "query_id int, rank int, text string")
    cases = spark.createDataFrame([(1, "3 months"), (2, "x"), (3, "y")], "case_id int, must_contain string")
    got = evaluation.must_contain(results, cases)
    assert {r.case_id: r.passed for r in got.collect()} == {1: True, 2: False, 3: False}
    assert evaluation.accuracy(got).first().n_passed == 1
