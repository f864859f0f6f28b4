"""Corpus operators on small tables: brute force, defined results at the edges."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import common, decontaminate, html_text, line_dedup, mixing, near_dup, quality_model, quality_rules, ring, token_counts, token_files
from lectern.llm.statistics import statistics

tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def corpus(seed=0, n=120):
    rng = random.Random(seed)
    rows = [(i, sentence(rng, rng.randrange(1, 120)), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", None]), 1) for i in range(n)]
    base = sentence(rng, 80)
    for i in range(n, n + 30):  # near copies, some of copies
        words = base.split()
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words), "en", "s0", 1))
    rows += [(500, None, None, None, None), (501, "", "en", "s0", 0), (502, " \n\t ", "en", "s1", 0), (503, "one two", "en", "s1", 7), (504, "ONE two", "en", "s1", 7), (505, sentence(rng, 30_000), "en", "s2", 1), (None, "no id at all in this row of text", "en", "s1", 1)]
    return rows + rows[:3] + rows[:1]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def clashing(docs):
    """The same rows with extra columns named like results and inner names."""
    extra = {c: F.lit("extra") for c in ("size", "shard", "kept", "taken", "target", "quality", "node", "n_words", "_size", "_s", "value", "component_id", "h", "k", "m", "n", "s", "_leak", "_id", "_gone", "_out", "_row", "_k", "_key", "_node", "_d", "_label", "_salt", "key", "doc", "row")}
    return docs.withColumns(extra)


def n_words(text):
    return len((text or "").encode().split())


# Mixing


def test_mix(docs):
    out = mixing.mix(docs, slim=True).collect()
    assert len(out) == docs.count()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + n_words(r.text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [5, 2, 1, 5, 2]))
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while open_:  # reshare the excess until no target is above its cap
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    taken = {}
    for r in out:
        assert r["size"] * 3 >= r.taken and r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in order:
        most = max(r["size"] for r in out if r.source == s)
        assert abs(taken[s] - target[s]) <= most
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs, slim=True).collect()))


def test_mix_of_rows_without_ids(spark):
    """Rows without ids draw by their text; ranges of keys hold few rows at any scale of weights."""
    rows = [(None, f"text number {i}", "en", "x", 1) for i in range(2000)] + [(i, "a b c", "en", "y", 1) for i in range(2000)]
    for weight in (None, F.lit(1e-6), F.lit(1.0)):
        df = spark.createDataFrame(rows, DOCS)
        got = mixing.mix(df, weights=(1.0, 3.0), weight=weight).groupBy("source").agg(F.sum("taken"), F.first("target")).collect()
        assert all(abs(r[1] - r[2]) <= 3 for r in got)
        assert mixing._keyed(df, 7, 65_536, weight).groupBy("source", "_bucket").count().agg(F.max("count")).first()[0] < 12


def test_mix_weights(spark):
    """A source's rest prefers documents of higher weight."""
    rows = [(i, "a b c d", "en", "x" if i < 3000 else "y", 1) for i in range(6000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("w", F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.25))
    got = mixing.mix(df, weights=(1.0, 3.0), weight=F.col("w")).where("source = 'x' and taken > 0").collect()
    good = sum(r.doc_id % 2 == 0 for r in got)
    assert 0.65 < good / len(got) < 0.85
    everything = mixing.mixed(df.drop("w")).count()
    assert abs(everything - 6000) < 3


def test_mix_keeps_columns(clashing):
    assert mixing.mixed(clashing).columns == clashing.columns
    assert mixing.mixed(clashing).count() > 0


def test_mixing_splits_equal_rows(spark):
    """1,000 rows of one id and size take their target within one of them, also next to rows of other ids and a null one."""
    rows = [(7, "a b c", "x")] * 1000 + [(8, "a b", "y")] * 400 + [(i, "one two three four", "y") for i in range(100, 200)] + [(None, "n " * 5, None)] * 300 + [(None, "", None)] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for weights in ((5.0, 2.0, 1.0), (1.0, 1.0, 9.0), (3.0, 1.0, 0.2)):
        got = mixing.mix(docs, weights=weights, slim=True)
        for r in got.groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t"), F.max("size").alias("s")).collect():
            assert abs(r.n - r.t) <= r.s and r.n >= 0, r
        again = sorted(map(str, got.select("doc_id", "size", "taken").collect()))
        assert again == sorted(map(str, mixing.mix(docs.coalesce(1), weights=weights, slim=True).select("doc_id", "size", "taken").collect()))
        taken = mixing.mixed(docs, weights=weights)
        words = {r.source: r.n for r in taken.groupBy("source").agg(F.sum(common.word_count()).alias("n")).collect()}
        assert words == {r.source: r.n for r in got.groupBy("source").agg(F.sum("taken").alias("n")).collect() if r.n}



# Sharding


def place(keys, shards, replicas):
    """The ring, one arc after the other."""
    cell = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:4], 16)
    ring_ = {}
    for i in range(shards * replicas):
        s, v = i % shards, i // shards
        d = hashlib.md5(f"node:{s}:{v}".encode()).hexdigest()
        c = int(d[:4], 16)
        if c not in ring_ or d < ring_[c][0]:
            ring_[c] = (d, s)
    arcs = sorted(ring_)
    room = [len(keys) // shards + (i < len(keys) % shards) for i in range(shards)]
    by = {a: [] for a in arcs}
    for k in keys:
        c = cell(f"key:{k}")
        by[next((a for a in arcs if a >= c), arcs[0])].append(k)
    out, carry = {}, []
    for turn in range(2):
        for a in arcs:
            shard = ring_[a][1]
            # Cells after the last node come first in the first arc.
            mine = sorted(by[a], key=lambda k: (cell(f"key:{k}") <= a, cell(f"key:{k}"), hashlib.md5(f"key:{k}".encode()).hexdigest())) if turn == 0 else []
            take = min(len(mine), room[shard])
            fed = min(len(carry), room[shard] - take)
            for k in mine[:take] + carry[:fed]:
                out[k] = shard
            room[shard] -= take + fed
            carry = carry[fed:] + mine[take:]
    return out


def test_ring_against_brute_force(spark):
    keys = list(range(700))
    df = spark.createDataFrame([(k, f"t{k}") for k in keys], "doc_id long, text string")
    got = ring.assign(df, shards=7, replicas=16).collect()
    assert {r.doc_id: r.shard for r in got} == place(keys, 7, 16)


def test_ring_balance_and_movement(spark, docs):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    one, two = ({r.doc_id: r.shard for r in ring.assign(df, shards=s).collect()} for s in (40, 41))
    moved = sum(one[k] != two[k] for k in one)
    assert moved < 0.25 * len(one)  # of all keys, where a modulo moves 97 %
    out = ring.assign(docs, shards=40).collect()
    counts = {}
    for r in out:
        counts.setdefault(r.shard, []).append(r.slot)
    sizes = [len(counts.get(s, [])) for s in range(40)]
    assert len(out) == docs.count() and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in counts.values())
    for r in out:
        if r.doc_id == 503:
            assert (r["size"], r.text_crc32) == (7 + 16, zlib.crc32(b"one two"))


def test_ring_hot_cell(spark, monkeypatch):
    """Rows without ids share a cell; they are ordered in parts and still fill the shards evenly."""
    monkeypatch.setattr(ring, "HOT", 10_000)
    rows = [(None, "same")] * 300 + [(None, f"t{i}") for i in range(100)] + [(i, "x") for i in range(300)]
    out = ring.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards=7).collect()
    counts = {}
    for r in out:
        counts.setdefault(r.shard, []).append(r.slot)
    assert len(out) == 700 and all(sorted(x) == list(range(100)) for x in counts.values()) and len(counts) == 7


# Decontamination


def leak(text, items):
    w = decontaminate.words(text)
    hit, found = set(), set()
    for item, t in items:
        for win in decontaminate.windows(decontaminate.words(t)):
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add("null" if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


ITEMS = [(2, "A quick brown fox jumps over the lazy dog while ten cats sleep"), (10, "short item"), (3, None), (4, "?!"), (2, "repeated id here"), (None, "Ünïcode wörds, too")]


def test_decontamination(spark):
    rng = random.Random(3)
    texts = [None, "", "...", "A SHORT, item!", "xx quick BROWN fox--jumps over the lazy dog while ten cats; done", "fox jumps over the lazy dog while ten cats", "an ünïcode wörds too x", "short short item item short item"]
    texts += [" ".join(rng.choice("short item a quick brown fox repeated id here".split()) for _ in range(40)) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (100_000, 1):
        got = decontaminate.scan(df, bench, block).select("doc_id", "_leak.*").collect()
        for r in got:
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == leak(texts[r.doc_id], ITEMS)
    spans = {r.doc_id: r.spans for r in got}
    assert [texts[3][s.start : s.end] for s in spans[3]] == ["SHORT, item"]
    assert texts[4][spans[4][0].start : spans[4][-1].end].startswith("quick BROWN")
    assert decontaminate.scan(df, bench.limit(0)).where("_leak.n_hit > 0").count() == 0


# Near duplicates


def groups(rows):
    """Rows' component by brute force over full sets of shingles."""
    sets = [near_dup.shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)]


def chains(n, seed):
    """Families whose members are one edit apart from another member, near the threshold."""
    rng, rows = random.Random(seed), []
    for f in range(n):
        family = [sentence(rng, rng.choice([4, 5, 9, 60, 150, 300])).split()]
        for _ in range(12):
            words = list(rng.choice(family))
            for _ in range(max(1, len(words) // rng.choice([25, 35, 60]))):
                words[rng.randrange(len(words))] = f"y{rng.randrange(50)}"
            family.append(words)
        rows += [" ".join(w) for w in family]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_near_dup_chains(spark):
    rows = chains(20, 5) + [(9001, None), (9002, ""), (9003, "a b"), (9004, "A  b\n"), (9003, "a b"), (None, "zz yy"), (9005, "zz yy")]
    got = near_dup.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = [(d, n, d if n == 0 else c) for d, n, c in groups(rows)]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dup_large_group(spark, monkeypatch):
    """One group larger than a block, with members on both sides of the threshold."""
    monkeypatch.setattr(near_dup, "BLOCK", 5000)
    rng = random.Random(8)
    base, rows = sentence(rng, 140).split(), []
    for i in range(250):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(400)}"
        rows.append((i, " ".join(words)))
    got = near_dup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((d, c) for d, _, c in groups(rows))


def test_near_dup_blocks_on_both_sides(spark, monkeypatch):
    """No task holds many more probes or members of a home than a block; every pair meets in one task."""
    monkeypatch.setattr(near_dup, "BLOCK", 40)
    rows = [("h", f"n{i}", "h" if i < 50 else f"c{i}", [i]) for i in range(400)] + [(f"s{i}", f"m{i}{k}", f"s{i}" if k else "x", [i]) for i in range(9) for k in range(3)]
    at_home = spark.createDataFrame(rows, "home string, node string, comp string, hashes array<long>").withColumn("n", F.size("hashes"))
    probes, members = near_dup._dealt(near_dup._homes(at_home), 5)
    for held, c in ((probes, "p_"), (members, "")):
        assert held.where(f"{c}home = 'h'").groupBy(f"{c}task").count().agg(F.max("count")).first()[0] <= 80
    pairs = [tuple(r) for r in probes.join(members, (F.col("p_task") == F.col("task")) & (F.col("p_home") == F.col("home"))).select("home", "p_node", "node").collect()]
    assert sorted(pairs) == sorted((h, a, b) for h, a, comp, _ in rows if comp != h for g, b, *_ in rows if g == h)


def test_distinct_documents(docs, clashing):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = near_dup.distinct_documents(clashing)
    assert out.columns == clashing.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    comps = {}
    for (d, t), (_, n, c) in zip(rows, groups(rows), strict=True):
        comps.setdefault(c if n else ("empty", d), set()).add((d, t))
    full = [k for k in kept if n_words(k[1])]
    assert len(full) == len({c for c in comps if not isinstance(c, tuple)}) and len(full) == len(set(full))
    assert sum(not n_words(t) for _, t in kept) == sum(not n_words(t) for _, t in rows)


# Line chunks


def lines_corpus():
    rng = random.Random(12)
    passage = [sentence(rng, 12) for _ in range(8)]
    rows = [(i, "\n".join([sentence(rng, 6) for _ in range(rng.randrange(0, 9))] + (passage if i % 3 == 0 else []) + [sentence(rng, 6) for _ in range(rng.randrange(0, 9))])) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "\n\n\n\n\n\n"), (103, "a\nb"), (104, "a\nb"), (None, "a\nb"), rows[0], (105, "one line"), (106, "one line")], passage


def without_repeated_runs(rows):
    """Brute force over all runs of lines and all earlier places."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, line_dedup._key(r[0], r[1] or "")))
    places, want = {}, {}
    for o, (_, t) in enumerate(order):
        lines = (t or "").split("\n")
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                places.setdefault(tuple(lines[i : j + 1]), []).append((o, i))
    for o, (d, t) in enumerate(order):
        lines, gone = (t or "").split("\n"), set()
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                run = lines[i : j + 1]
                full = sum(bool(x.strip()) for x in run) > 1 or (len(run) == 1 and len(run[0].split()) > line_dedup.LONG)
                if full and run[0].strip() and run[-1].strip() and any(p < o or (p == o and q + len(run) <= i) for p, q in places[tuple(run)]):
                    gone |= set(range(i, j + 1))
        want[d, t] = (None if t is None else "".join(x + "\n" * (k < len(lines) - 1) for k, x in enumerate(lines) if k not in gone), len(gone))
    return want


def test_line_runs_against_brute_force(spark):
    """Shared passages of 2 lines and up, and long lines, in differing surroundings."""
    rng = random.Random(21)
    rows, passage = lines_corpus()
    shared = [[sentence(rng, 9) for _ in range(n)] for n in (2, 2, 3, 5, 10)] + [[sentence(rng, 60)], [sentence(rng, 7), "", sentence(rng, 7)]]
    for i in range(200, 260):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            lines += [sentence(rng, 6) for _ in range(rng.randrange(0, 3))] + rng.choice(shared) + [rng.choice(["", " ", "short", sentence(rng, 5)])]
        rows.append((i, "\n".join(lines) + rng.choice(["", "\n"])))
    rows += [(300 + i, "\n".join(rng.choice("abc ") for _ in range(rng.randrange(1, 9)))) for i in range(40)] + [(400, "q\nq\nq"), (401, "z\nz\nz\nz\nz")]
    want = without_repeated_runs(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("old", F.col("text")).withColumn("n_lines", F.lit("x")).repartition(3)
    got = line_dedup.dedup_runs(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, r.n_removed_lines) == want[r.doc_id, r.old]
        assert (r.n_removed_chunks > 0) == (r.n_removed_lines > 0)
    # Every line of every shared passage is left once, whatever stands around it.
    left = [x for r in got for x in (r.text or "").split("\n")]
    assert all(left.count(x) == 1 for run in shared for x in run if x)
    assert line_dedup.dedup_runs(df.limit(0)).count() == 0


def test_line_runs_keep_columns(clashing):
    out = line_dedup.dedup_runs(clashing)
    assert out.columns == [*clashing.columns, *line_dedup.RESULTS] and out.count() == clashing.count()
    assert out.where("_gone <> 'extra' or key <> 'extra' or _row <> 'extra'").count() == 0


def test_line_runs_of_hot_keys(spark, monkeypatch):
    """Keys with many rows are dealt over several tasks, with the same result; rows without ids are documents of their own."""
    monkeypatch.setattr(common, "HOT", 10_000)
    rows = [(None, f"{i} own line\nshared one\nshared two\nlast {i}") for i in range(300)] + [(7, "shared one\nshared two")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = line_dedup.dedup_runs(df).collect()
    assert sum(r.n_removed_lines for r in got) == 600 and all((r.n_removed_lines == 0) == (r.doc_id == 7) for r in got)


def test_string_ids(spark, docs):
    """Operators take ids of any type that orders; token files hold whole numbers and say so."""
    named = docs.withColumn("doc_id", F.concat(F.lit("doc "), F.col("doc_id")))
    n = docs.count()
    for out in (mixing.mix(named), ring.assign(named), near_dup.link(named), near_dup.distinct_documents(named).union(named.limit(0)), line_dedup.dedup_runs(named), quality_rules.judge(named), token_counts.count_tokens(named, tokenizers.path("piece_bpe_32k.model"))):
        assert out.schema["doc_id"].dataType.simpleString() == "string" and 0 < out.count() <= n
    with pytest.raises(TypeError, match="whole numbers"):
        token_files.tokens_to_files(named, tokenizers.path("byte_bpe_50k.json"))


# Tokens


def test_token_counts(docs):
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {}
    for r in token_counts.count_tokens(docs, path).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_tokens, r.over_limit))
    for r in docs.collect():
        n = len(model.encode(r.text or ""))
        assert (len((r.text or "").encode()), n, n > 4096) in got[r.doc_id]


ODD = ["", " ", "  ", " a", "a ", "\n", "\n\n", "a \n b", "  a  b ", "▁a", "\ta\tb", "日本語 é́", "<s> x</s>", "a b", "\x00", "😀😀 😀", "<|endoftext|>", "x <|endoftext|> y", "  <|endoftext|>", "I'm we'll  they've", "a.\nB, c.", "b\n\nc d\ne"]


def odd_texts(n=3000):
    rng = random.Random(4)
    return ODD + ["".join(rng.choice(" \n\tab.,é▁日 '<|>s1_") for _ in range(rng.randrange(40))) for _ in range(n)]


def test_shortcut_is_exact(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    short = token_counts.Shortcut(tokenizers.path("piece_bpe_32k.model"))
    texts = odd_texts()
    for lo in range(0, len(texts), 500):
        assert short.count(texts[lo : lo + 500]) == [len(x) for x in short.model.encode(texts[lo : lo + 500])]


def test_encoder_is_exact():
    enc = token_files.Encoder(tokenizers.path("byte_bpe_50k.json"))
    assert enc.merged and len(enc.unproved.findall("".join(map(chr, token_files.TRIED)))) == 0
    texts = odd_texts() + ["a" * 20_000, "=" * 20_000, " \n" * 5000, "ab " * 20_000]
    for lo in range(0, len(texts), 500):
        assert list(enc.encode(texts[lo : lo + 500])) == [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in enc.tokenizer.encode_batch(texts[lo : lo + 500], add_special_tokens=False)]


def test_token_files(docs, tmp_path):
    import zstandard
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    folder = str(tmp_path / "out")
    manifest = token_files.write_tokens(docs, tokenizers.path("byte_bpe_50k.json"), folder)
    got = sorted(token_files.read_tokens(manifest, folder).collect(), key=lambda r: r.start)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at = 0
    for r, (d, t) in zip(got, rows, strict=True):
        ids = model.encode(t, add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    # Any zstandard reader gets the whole run; a damaged frame is found.
    first = manifest.orderBy("part").first()
    raw = (tmp_path / "out" / first.file).read_bytes()
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert len(whole) == 4 * first.n_tokens
    (tmp_path / "out" / first.file).write_bytes(raw[:10] + bytes([raw[10] ^ 255]) + raw[11:])
    with pytest.raises(Exception, match="damaged|ZstdError|zstd"):
        token_files.read_tokens(manifest, folder).collect()


# Quality


def test_statistics_against_brute_force():
    rng = random.Random(6)
    for n in (0, 5, 8, 9, 40, 200):
        for _ in range(20):
            text = "".join(f"{rng.choice('abcé')}{rng.choice(['', '#', '&'])}{rng.choice([' ', ' ', chr(10), chr(9)])}" for _ in range(n))
            got = statistics(text)
            words = text.encode().split()
            seen, cover = {}, set()
            for i in range(len(words) - 7):
                seen.setdefault(tuple(words[i : i + 8]), []).append(i)
            for at in seen.values():
                if len(at) > 1:
                    cover |= {i + k for i in at for k in range(8)}
            lines = [x for x in text.split("\n") if x.encode().split()]
            assert got[:5] == (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))
    assert statistics(None) == (0,) * 10


def quality_rows(n=900):
    rng, rows = random.Random(9), []
    for i in range(n):
        text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(60, 400)))
        bad = i % 10 == 0
        if bad:
            text = " ".join(w + rng.choice("#%&*") * 3 for w in text.split()) if i % 20 else "\n".join(["SPAM!! NOW!!"] * 40)
        rows.append((i, text, rng.choice(["en", "de"]), rng.choice(["s0", "s0", "s1"]), 1))
    return rows


def test_robust_outliers(spark, docs, clashing):
    rows = quality_rows()
    out = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(not out[i].kept for i in range(0, 900, 10))
    assert sum(out[i].kept for i in range(900) if i % 10) > 0.98 * 810
    assert quality_rules.judge(docs).count() == docs.count()
    few = quality_rules.judge(clashing).collect()
    assert all(not r.kept for r in few if r.doc_id in (500, 501, 502, 503)) and any(r.kept for r in few)
    base = {r.doc_id: r for r in few}
    assert base[503].n_words == 2 and base[503].base_failed and not base[505].base_failed


def test_robust_outliers_of_small_pools(spark):
    """Rows of small groups are judged by their language, then by all rows, however few these are."""
    plain = [r for r in quality_rows() if r[0] % 10]
    odd = [r for r in quality_rows() if r[0] % 20 == 10]  # full of symbols; the base rules pass them
    rows = [(i, t, "en", "s0", 1) for i, t, *_ in plain[:300]] + [(odd[0][0], odd[0][1], "en", "rare", 1), (odd[1][0], odd[1][1], "xx", "s0", 1), (odd[2][0], odd[2][1], None, None, 1)]
    rows += [(plain[k][0], plain[k][1], lang, source, 1) for k, (lang, source) in enumerate([("en", "rare"), ("xx", "s0"), (None, None), ("yy", None)], 300)]
    for some in (rows, rows[230:]):
        out = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(some, DOCS)).collect()}
        assert len(out) == len(some) and all(r.distance is not None and not r.base_failed for r in out.values())
        assert not any(out[r[0]].kept for r in odd[:3])
        assert all(out[plain[k][0]].kept for k in range(300, 304)) and sum(r.kept for r in out.values()) > 0.97 * (len(some) - 3)


def mcd(x, cover=0.75):
    """The estimate of judge for one pool, in numpy: (squared distances, their unit)."""
    floors = np.array(quality_rules.FLOORS)
    at = lambda v, p: np.sort(v)[max(0, int(np.ceil(p * len(v))) - 1)]
    q = {p: np.array([at(c, p) for c in x.T]) for p in (0.05, 0.25, 0.5, 0.75, 0.95)}
    spread = np.maximum((q[0.75] - q[0.25]) / 1.349, floors)
    u = (x - q[0.5]) / spread
    u = u / np.maximum(np.linalg.norm(u, axis=1), 1e-9)[:, None]
    starts = [np.diag(spread**2), np.diag(np.maximum((q[0.95] - q[0.05]) / 3.29, floors) ** 2), np.outer(spread, spread) * (x.shape[1] * u.T @ u / len(x) + 0.05 * np.eye(x.shape[1]))]
    found = []
    for cov in starts:
        mu, last = q[0.5], np.inf
        for _ in range(20):
            d = np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu)
            some = x[d <= at(d, cover)]
            mu, cov = some.mean(0), np.cov(some.T, bias=True)
            cov = cov + np.diag(np.maximum(floors**2 - np.diag(cov), 0)) + 1e-3 * np.diag(floors**2)
            det = np.linalg.slogdet(cov)[1]
            found.append((det, mu, cov))
            if last - det <= quality_rules.LEAST_FALL:
                break
            last = det
    _, mu, cov = min(found, key=lambda f: f[0])
    d = np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu)
    return d / max(1.0, at(d, 0.5) / quality_rules.chi2_quantile(x.shape[1], 0.0))


def test_robust_outliers_against_brute_force(spark):
    rows = quality_rows()
    df = spark.createDataFrame(rows, DOCS)
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper".split()
    stats = spark.createDataFrame([(r[0], r[2], r[3], *statistics(r[1])[:7]) for r in rows], "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names))
    facts = stats.select("doc_id", "lang", "source", ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("failed"), F.array(*quality_rules.vector()).alias("x")).collect()
    want = {}
    for pool in {(r.lang, r.source) for r in facts}:
        some = [r for r in facts if (r.lang, r.source) == pool and not r.failed]
        assert len(some) >= quality_rules.LEAST_ROWS
        want |= dict(zip([r.doc_id for r in some], mcd(np.array([r.x for r in some])), strict=True))
    got = quality_rules.judge(df).collect()
    assert {r.doc_id for r in got if not r.base_failed} == set(want)
    for r in got:
        assert r.base_failed or r.distance == pytest.approx(want[r.doc_id], rel=1e-6)
        assert r.kept == (not r.base_failed and want[r.doc_id] <= quality_rules.chi2_quantile(quality_rules.P, 8.0))


def test_quality_model_against_brute_force(spark):
    """Every posterior, summed anew over all documents but the judged one."""
    rows = quality_rows(300) + [(700, "a lonely text on its own site", "en", "s9", 1), (701, None, None, None, None)]
    label = {i: int(i % 10 != 0) for i in range(0, 300, 4)} | {700: 0}
    got = {r.doc_id: r for r in quality_model.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, q, 0) for i, q in label.items()], "doc_id long, quality int, toxic int")).collect()}
    clip = lambda p: round(min(max(p, 0.001), 0.999) * 1e6) / 1e6
    given = {r[0]: label[r[0]] if r[0] in label else clip(got[r[0]].own_quality) for r in rows}
    site = {r[0]: (r[3], r[2]) for r in rows}
    m = sum(given.values()) / len(given)

    def strength(groups, means):
        n = sum(len(g) for g in groups)
        noise = sum(p * (1 - p) for p in means) / n
        spread = sum(len(g) * (sum(g) / len(g) - p) ** 2 for g, p in zip(groups, means)) / n
        return min(max(sum(len(g) * p * (1 - p) for g, p in zip(groups, means)) / n / max(spread - noise, 1e-6) - 1, 5), 1000)

    hosts, paths = {}, {}
    for d, u in given.items():
        hosts.setdefault(site[d][0], []).append(u)
        paths.setdefault(site[d], []).append(u)
    hk = strength(list(hosts.values()), [m] * len(hosts))
    above = {h: (hk * m + sum(us)) / (hk + len(us)) for h, us in hosts.items()}
    k = strength(list(paths.values()), [above[h] for h, _ in paths])
    logit = lambda p: np.log(p / (1 - p))
    for d, u in given.items():
        mine = [x for e, x in given.items() if e != d and site[e][0] == site[d][0]]
        host = (hk * m + sum(mine)) / (hk + len(mine))
        mine = [x for e, x in given.items() if e != d and site[e] == site[d]]
        path = min(max((k * host + sum(mine)) / (k + len(mine)), 0.001), 0.999)
        assert got[d].path_quality == pytest.approx(path, rel=1e-6)
        odds = logit(got[d].own_quality) + logit(path) - logit(m)
        assert got[d].quality == pytest.approx(1 / (1 + np.exp(-odds)), rel=1e-5, abs=1e-12) and got[d].kept == (got[d].quality >= 0.5)


def test_quality_model(spark, docs, clashing):
    rows = quality_rows()
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(0, 900) if i % 3 == 0] + [(1, None, 0), (None, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_model.classify(df, labels).collect()}
    held = [i for i in range(900) if i % 3]
    assert sum(got[i] == (i % 10 != 0) for i in held) > 0.97 * len(held)
    out = quality_model.classify(clashing, labels.limit(0))
    assert out.count() == docs.count() and "_size" in out.columns and out.columns.count("quality") == 1
    # A sparse path is drawn toward its host, a host toward the whole.
    r = quality_model.classify(df, labels).agg(F.min("path_quality"), F.max("path_quality")).first()
    assert 0 < r[0] < r[1] < 1


# HTML

PAGE = (
    "<html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>"
    "<div class='cookie-notice'>We use cookies</div><aside><p>Side words here</p></aside><article><header><h1>The  title</h1></header><p><b>Lead &amp; more<br>second&nbsp;line<p>Short.<div class='ad'>Buy now</div>"
    "<ul><li>item one</li><li>item <a href=z>two</a></li></ul><form><input><p>Your name</p></form><section id='comments'><p>First comment of a reader</p></section></article><footer>&copy; me</footer></body></html>"
)


def test_html(spark):
    assert html_text.main_text(PAGE) == "The title\n\nLead & more second line\n\nShort.\n\nitem one\n\nitem two"
    for page in (None, "", "<", "<p", "<article><p>cut of", "plain text only", "<div><p>" + "word " * 50 + "</p></div>"):
        html_text.main_text(page)
    assert html_text.main_text("<article><p>cut of") == "cut of"
    assert html_text.main_text("<article><p>one</p><p>two <a hre") == "one\n\ntwo"
    assert html_text.main_text("<div><a href=a>Home</a></div><div><p>" + "word " * 50 + "</p><p>" + "more " * 40 + "</p></div>") == ("word " * 50).strip() + "\n\n" + ("more " * 40).strip()
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, len(got[0].text)), (1, len(got[0].text)), (2, 0)]


def test_tree_on_held_out_blocks():
    """Leave one labelled block out at a time."""
    right = 0
    for i, row in enumerate(html_text.LABELLED):
        node = html_text.grow(html_text.LABELLED[:i] + html_text.LABELLED[i + 1 :])
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        right += node == row[-1]
    assert right >= 0.9 * len(html_text.LABELLED)


def test_html_wrappers():
    """Wrappers of any kind round a page leave its text; an element left open does not swallow the rest."""
    text = ("alpha beta gamma delta " * 12).strip() + "\n\n" + ("word " * 40).strip()
    inner = "".join(f"<p>{x}</p>" for x in text.split("\n\n"))
    for page in (
        f"<div class='site has-sidebar'><div>{inner}</div></div>", f"<body><form id='aspnetForm'><input>{inner}</form></body>", f"<div id='main-content' class='no-sidebar'><article>{inner}</article></div>",
        f"<div class='page-with-header'><main>{inner}</main></div>", f"<article>{inner}<button>Share</article>", f"<body><select><option>{inner}</body>",
    ):
        assert html_text.main_text(page).removesuffix("\n\nShare") == text, page
    assert html_text.main_text(f"<article><button>Share</button>{inner}<form><p>Your name</p></form></article>") == text


def test_html_words_and_links_decide():
    """Outside an article links and words decide; an article is whole, and furniture that names itself is shut."""
    menu = "<ul><li><a href=a>More about this</a><li><a href=b>Read that as well</a><li><a href=c>And this one</a></ul>"
    text = "word " * 40
    assert html_text.main_text(f"<div><p>{text}</p><div>{menu}</div><p>{text}</p></div>") == f"{text.strip()}\n\n{text.strip()}"
    assert html_text.main_text(f"<article><p>{text}</p><h2>Sources</h2>{menu}</article>").endswith("Sources\n\nMore about this\n\nRead that as well\n\nAnd this one")
    assert html_text.main_text(f"<article><p>{text}</p><p><a href=x>See the source</a></p><p>{text}</p></article>").count("\n\n") == 2
    # An article inside a wrapper of any name is an article; names are whole class names.
    assert html_text.main_text(f"<div class='sidebar'><article><p>One line.</p><p>{text}</p></article></div>") == f"One line.\n\n{text.strip()}"
    assert html_text.main_text(f"<div class='long-form share-price'><p>{text}</p></div>") == text.strip()
    long = "word " * 150
    assert html_text.main_text(f"<div class='promotion'><p>{long}</p><p>Buy it now</p></div>") == long.strip()
    assert html_text.main_text(f"<div class='site-footer'><p>{text}</p></div>") == ""
    assert html_text.main_text(f"<article hidden><p>{text}</p></article>") == html_text.main_text(f"<div style='display:none'><article><p>{long}</p></article></div>") == ""
    used, nodes = set(), [html_text.tree()]
    while nodes:
        if isinstance(node := nodes.pop(), tuple):
            used.add(node[0])
            nodes += node[2:]
    assert {0, 1, 6} <= used and used & {3, 5}


LONG = "word " * 150


@pytest.mark.parametrize("furniture", ["<section id=comments><p>{}</p></section>", "<div class=comment-body>{}</div>", "<div class='cookie-notice'>{}</div>", "<div class=ad><p>{}</p></div>", "<footer>{}</footer>", "<form><p>{}</p></form>", "<div id=comments><article><p>{}</p></article></div>", "<article class=comment>{}</article>", "<div class='related-articles'><p>{}</p></div>", "<aside>{}</aside>", "<nav><p>{}</p></nav>", "<div role=banner>{}</div>", "<span style='display:none'>{}</span>", "<p><b hidden>{}</b></p>", "<script>{}</script>"])
def test_long_furniture_is_no_text(furniture):
    """Whatever its length, beside an article, inside it, and on a page without one."""
    for page in ("<body><article><h1>Head</h1><p>Body of it.</p></article>{}</body>", "<body>{}<article><h1>Head</h1><p>Body of it.</p></article></body>", "<body><article><h1>Head</h1><p>Body of it.</p>{}</article></body>", "<body><div><h1>Head</h1><p>Body of it.</p></div>{}</body>"):
        assert html_text.main_text(page.format(furniture.format(LONG))) == "Head\n\nBody of it."


def test_short_pages_and_headings_stay():
    assert html_text.main_text("<body><p>Hello world.</p></body>") == "Hello world."
    assert html_text.main_text("<div><h1>Title here</h1><p>Short text of five.</p><p>Here are nine words that make up one block.</p></div>") == "Title here\n\nShort text of five.\n\nHere are nine words that make up one block."
    assert html_text.main_text(f"<div class=post><h2>A heading</h2><p>{LONG}</p><h2>Another</h2><p>Few.</p></div>") == f"A heading\n\n{LONG.strip()}\n\nAnother\n\nFew."
    assert html_text.main_text("<p>seen <span hidden>not <span>this</span> nor this</span> again</p>") == "seen again"
    assert html_text.main_text("<p>seen <span hidden>left open</p><p>next</p>") == "seen\n\nnext"


def test_pages_of_known_parts():
    """Pages put together from article parts and furniture: whole texts are compared."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    wrong = 0
    for _ in range(200):
        parts, html = [], []
        for _ in range(rng.randint(1, 8)):
            t = prose(rng.choice([1, 3, 12, 60, 200]))
            parts.append(t)
            html.append(rng.choice(["<p>{}</p>", "<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</li></ul>", "<pre>{}</pre>", "<div>{}</div>"]).format(t))
        odd = [rng.choice(["<div class='ad'>{}</div>", "<form>{}</form>", "<div class='comment'>{}</div>", "<aside><p>{}</p></aside>", "<div class='newsletter'>{}</div>"]).format(prose(rng.choice([2, 40, 200]))) for _ in range(4)]
        inner = "".join(html[:1] + odd[:1] + html[1:] + odd[1:2])
        tag = rng.choice(["article", "main", "div class=post"])
        page = f"<html><head><title>{word()}</title></head><body><header><a href=/>{word()}</a></header><nav><ul><li><a href=x>{word()}</a></ul></nav>{odd[2]}<{tag}>{inner}</{tag.split()[0]}>{odd[3]}<footer>{prose(30)}</footer></body></html>"
        wrong += html_text.main_text(page) != "\n\n".join(parts)
    assert wrong == 0


def test_deep_pages_are_linear():
    import time

    began = time.process_time()
    assert html_text.main_text("<div>" * 20_000 + "deep text" + "</div>" * 20_000) == "deep text"
    assert html_text.main_text("<div>" * 6_000 + "</span></section>" * 6_000 + "x") == "x" and html_text.main_text("<button>" * 9_000 + "x") == "x"
    assert time.process_time() - began < 3


# Empty tables


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    labels, bench = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    outs = [
        mixing.mix(none), mixing.mixed(none), ring.assign(none), decontaminate.scan(none, bench), line_dedup.dedup_runs(none), near_dup.link(none), near_dup.distinct_documents(none), quality_rules.judge(none), quality_model.classify(none, labels),
        token_counts.count_tokens(none, tokenizers.path("piece_bpe_32k.model")), token_files.tokens_to_files(none, tokenizers.path("byte_bpe_50k.json")), html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")),
    ]
    for k, out in enumerate(outs):
        assert out.count() == 0, k


def test_ids_are_the_librarys():
    """Of all documents of sf0.01, whole texts: the ids written are those that the library gives."""
    import pyarrow.parquet as pq
    from public_tokenizers import path
    from tokenizers import Tokenizer

    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    library.no_padding()
    library.no_truncation()
    expected = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    assert list(token_files.encoder(path("byte_bpe_50k.json")).encode(texts)) == expected
