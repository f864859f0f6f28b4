"""Near-duplicate documents by bottom-k sketches from one hash function.

1. A document's set is its distinct shingles. Documents with equal sets become one class; a class
   keeps the k smallest hashes of its set, its sketch.
2. Inverted lists hold retained values. Two sets with Jaccard similarity t or more share at least R
   retained values (exactly for small sets, up to a chance below one in a million else), so they
   share one among the rarest k - R + 1 of each; only those go to lists, and only classes with more
   than R values found elsewhere have any. Passages that many documents share stay out that way.
3. In every list all members are compared with its hub, the member whose values are most common.
   Union sketches filter the pairs, full sets confirm them, and the links give components.
4. Lists whose members are still in different components go to the largest of these, their home.
   At a home, in blocks on both sides, every node from outside is held against every node, on full
   sets, by one pass over an inverted index of the block; one link to each component it reaches is
   enough.

Full sets are those of 63-bit shingle hashes; they are made only for classes that share a list.

No list is emitted as pairs, and no group is held by one task beyond a block. Links, components and
sketches stay in tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, free_name, hot_join, table

SHINGLE, THRESHOLD, K = 5, 0.75, 64
#: Values of the full sets that a task holds at a time, of a home's members and of its nodes from outside.
BLOCK = 600_000
#: Ids are broadcast to filter texts up to this many; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
REMEMBERED = 200_000
#: Rows whose sets are in memory together.
ROWS = 500
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, ASCII letters in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles(text: str | None, size: int = SHINGLE) -> set[tuple[bytes, ...]]:
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


class Hasher:
    """Sorted distinct 63-bit hashes of a text's shingles."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def hashes(self, text: str | None) -> np.ndarray:
        import xxhash

        w = words(text)
        if not w:
            return np.zeros(0, dtype=np.int64)
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        for x in set(w).difference(known):
            known[x] = xxhash.xxh64_intdigest(x)
        ids = np.fromiter(map(known.__getitem__, w), dtype=np.uint64, count=len(w))
        size = min(self.size, len(w))
        n = len(ids) - size + 1
        out = np.full(n, np.uint64(size))
        for k in range(size):
            out = (out ^ ids[k : k + n]) * _MIX
            out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
        return np.unique(out >> np.uint64(1)).astype(np.int64)


def required(n: int, k: int = K, threshold: float = THRESHOLD) -> int:
    """Retained values that a set of n shares at least with any set at the threshold."""
    if n <= int(threshold * k):  # the other set is then within its sketch as well
        return max(1, int(np.ceil(threshold * n - 1e-9)))
    return max(1, int(threshold * k - 5.2 * (k * threshold * (1 - threshold)) ** 0.5))


def estimate(a: np.ndarray, b: np.ndarray, na: int, nb: int, k: int = K) -> float:
    """Jaccard similarity by the union's sketch; exact if both sets are within theirs."""
    union = np.union1d(a, b)
    if max(na, nb) > k:
        union = union[:k]
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)) / max(1, len(union))


def passes(a, b, na: int, nb: int, k: int = K, threshold: float = THRESHOLD) -> bool:
    slack = 0.0 if max(na, nb) <= k else 4.5 * (threshold * (1 - threshold) / k) ** 0.5
    return min(na, nb) >= threshold * max(na, nb) and estimate(a, b, na, nb, k) >= threshold - slack - 1e-9


def _lists(values: list[np.ndarray]):
    """An Arrow list array of whole numbers, without a Python object for each."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0, dtype=np.int64)]).astype(np.int64)))


def _digest(hashes: np.ndarray) -> str | None:
    import xxhash

    return xxhash.xxh3_128_hexdigest(hashes.tobytes()) if len(hashes) else None


def sketches(docs: DataFrame, size: int, k: int) -> DataFrame:
    """doc_id, n_shingles, node (a digest of the set; null for the empty set), sketch."""

    def run(batches):
        import pyarrow as pa

        hasher = Hasher(size)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                hashes = [hasher.hashes(x) for x in part.column("text").to_pylist()]
                n, node = pa.array([len(h) for h in hashes], pa.int64()), pa.array([_digest(h) for h in hashes], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), n, node, _lists([h[:k] for h in hashes])], names=["id", "n_shingles", "node", "sketch"])

    kind = docs.schema["doc_id"].dataType
    out = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInArrow(run, "id string, n_shingles long, node string, sketch array<long>")
    return out.select(F.col("id").cast(kind).alias("doc_id"), "n_shingles", "node", "sketch")


def components(edges: DataFrame, keep) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the component's least node.

    Alternates large and small stars until nothing changes; every step is a join with the least
    neighbour of each node, so a hub's edges are never gathered; a large hub's are dealt over tasks.
    """
    now = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen, n_edges = None, now.count()
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("m", "a").alias("m"))
        up = both.where("b > a")
        large = hot_join(up, ["a"], least, ["_a"], n_edges).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), "m")
        joined = large.join(least, F.col("a") == F.col("_a"))
        now = keep(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select(F.col("_a").alias("a"), F.col("m").alias("b"))).distinct())
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == seen:
            break
        seen, n_edges = sums, sums[0]
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets are at the threshold; sets is (node, hashes)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                x, y = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("ha", "hb"))
                if at_threshold(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), threshold):
                    rows.append(k)
            yield batch.select(["a", "b"]).take(pa.array(rows, pa.int64()))

    one = sets.select(F.col("node").alias("_a"), F.col("hashes").alias("ha"))
    two = sets.select(F.col("node").alias("_b"), F.col("hashes").alias("hb"))
    full = pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b"))
    return full.select("a", "b", "ha", "hb").mapInArrow(run, "a string, b string")


def at_threshold(both, na, nb, threshold: float):
    """Whether the Jaccard similarity is at the threshold, in whole numbers; takes arrays as well."""
    return 100 * both >= round(100 * threshold) * (na + nb - both)


def _passing(pairs: DataFrame, classes: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs whose union sketches pass."""

    @F.pandas_udf("boolean")
    def ok(sa: pd.Series, sb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        return pd.Series([passes(np.asarray(a), np.asarray(b), x, y, k, threshold) for a, b, x, y in zip(sa, sb, na, nb, strict=True)], dtype=bool)

    one = classes.select(F.col("node").alias("_a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    two = classes.select(F.col("node").alias("_b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    full = pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b"))
    return full.where(ok("sa", "sb", "na", "nb")).select("a", "b")


def _reach(threshold: float):
    """Links of a task's blocks: for each probe, one to every component it reaches."""

    def block(probes, members) -> list[tuple[str, str]]:
        import pyarrow as pa

        rows = []
        flat = pa.concat_arrays(members.column("hashes").chunks)
        n = np.diff(flat.offsets.to_numpy())
        flat, owner = flat.flatten().to_numpy(), np.repeat(np.arange(len(n), dtype=np.int32), n)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        del order
        node, comp = members.column("node").to_numpy(), members.column("comp").to_numpy()
        hashes = probes.column("p_hashes")
        for k, (name, own) in enumerate(zip(probes.column("p_node").to_pylist(), probes.column("p_comp").to_pylist(), strict=True)):
            mine = hashes[k].values.to_numpy()
            first, last = np.searchsorted(flat, mine), np.searchsorted(flat, mine, side="right")
            held = last > first
            if not held.any():
                continue
            both = np.bincount(np.concatenate([owner[i:j] for i, j in zip(first[held].tolist(), last[held].tolist(), strict=True)]), minlength=len(n))
            found = np.flatnonzero(at_threshold(both, n, len(mine), threshold) & (comp != own))
            seen: set[str] = set()
            for i in found.tolist():
                if comp[i] not in seen:
                    seen.add(comp[i])
                    rows.append((name, node[i]))
        return rows

    def run(probes, members):
        import pyarrow as pa
        import pyarrow.compute as pc

        rows: list[tuple[str, str]] = []
        if probes.num_rows and members.num_rows:
            for home in pc.unique(probes.column("p_home")):
                rows += block(probes.filter(pc.equal(probes.column("p_home"), home)), members.filter(pc.equal(members.column("home"), home)))
        return pa.table({"a": pa.array([a for a, _ in rows], pa.string()), "b": pa.array([b for _, b in rows], pa.string())})

    return run


def _homes(at_home: DataFrame) -> DataFrame:
    """at_home (home, comp, node, n values of its set) with blocks, those of the home's members, and p_blocks, those of its nodes from outside."""
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    homes = at_home.groupBy("home").agg(parts(F.sum("n")).alias("blocks"), parts(F.sum(F.when(F.col("comp") != F.col("home"), F.col("n")))).alias("p_blocks"))
    homes = homes.select(F.col("home").alias("_h"), "blocks", F.coalesce("p_blocks", F.lit(1)).alias("p_blocks"))
    return hot_join(at_home, ["home"], homes, ["_h"], at_home.count()).drop("_h")


def _dealt(at_home: DataFrame, spread: int) -> tuple[DataFrame, DataFrame]:
    """Probes and members by task: small homes share ``spread`` tasks, a large one has a task for every pair of a block of probes and a block of members."""
    task = lambda block, p_block: F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("home"), F.lit(spread)).cast("string")).otherwise(F.concat_ws(":", "home", block.cast("string"), p_block.cast("string")))
    at, every = lambda n: F.pmod(F.xxhash64("node"), F.col(n)), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = at_home.withColumn("_block", every("p_blocks")).withColumn("task", task(at("blocks"), F.col("_block"))).select("task", "home", "node", "comp", "hashes")
    probes = at_home.where("comp <> home").withColumn("_block", every("blocks")).withColumn("task", task(F.col("_block"), at("p_blocks")))
    # New attributes: a cogroup of a table with itself would mistake one side's columns for the other's.
    return probes.select(*[F.col(c).alias(f"p_{c}") for c in ("task", "home", "node", "comp", "hashes")]), members


def link(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, node for every row of docs (doc_id, text; the rest is not read).

    Rows are linked where 100 times the intersection of their sets is at least 100 * threshold times
    the union. component_id is the least doc_id reachable; kept says that the row has that id.
    Empty sets (null, empty, white space) link with nothing and keep their own id. Rows equal in id
    and text are kept or dropped together. Rows without an id link like others; a component of such
    rows alone has a null component_id and is kept. Very long texts are hashed whole. No other column
    is read, so none can clash. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    written = Written(spark, "neardup")
    keep = written.keep
    rows = keep(sketches(docs, size, k))
    classes = keep(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    # Lists: per class, the rarest retained values that two classes at least hold.
    need = F.when(F.col("n") <= int(threshold * k), F.greatest(F.lit(1), F.ceil(F.lit(threshold) * F.col("n") - 1e-9))).otherwise(required(10**9, k, threshold))
    values = classes.select("node", F.least(F.col("n"), F.lit(k)).alias("kn"), need.cast("int").alias("need"), F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    held = values.join(common.withColumnRenamed("value", "_v"), F.col("value") == F.col("_v")).drop("_v")
    by = Window.partitionBy("node")
    held = held.withColumns({"rank": F.row_number().over(by.orderBy("df", "value")), "m": F.count("*").over(by), "weight": F.sum("df").over(by)})
    lists = keep(held.where("rank <= kn - need + 1 - (kn - m)").select("value", "node", "weight"))
    hubs = lists.groupBy("value").agg(F.max_by("node", F.struct("weight", "node")).alias("b"), F.count("*").alias("c")).where("c > 1")
    lists = keep(lists.join(hubs.withColumnRenamed("value", "_v"), F.col("value") == F.col("_v")).select("value", "node", "b"))
    pairs = keep(lists.where("node <> b").select(F.col("node").alias("a"), "b").distinct())
    wanted = keep(lists.select("node").distinct().join(classes.select(F.col("node").alias("_n"), "rep"), F.col("node") == F.col("_n")).select("node", "rep"))
    sets = keep(_full_sets(docs, wanted, size))
    links = keep(_confirm(_passing(pairs, classes, k, threshold), sets, threshold))
    found = keep(components(links, keep))
    # Lists of several components meet at the largest of them.
    member = keep(lists.select("value", "node").join(found.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("value", "node", F.coalesce("comp", "node").alias("comp")))
    sizes = member.groupBy("value", "comp").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("value").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("c", "comp")).alias("home")).where("comps > 1").select(F.col("value").alias("_v"), "home")
    at_home = keep(member.join(mixed, F.col("value") == F.col("_v")).select("node", "comp", "home").distinct())
    if not at_home.isEmpty():
        at_home = keep(at_home.join(sets.select(F.col("node").alias("_n"), "n"), F.col("node") == F.col("_n")).drop("_n"))
        total = at_home.agg(F.sum("n")).first()[0]
        at_home = keep(_homes(at_home).drop("n").join(sets.select(F.col("node").alias("_n"), "hashes"), F.col("node") == F.col("_n")).drop("_n"))
        probes, members = _dealt(at_home, max(1, total // BLOCK))
        more = keep(probes.groupBy("p_task").cogroup(members.groupBy("task")).applyInArrow(_reach(threshold), "a string, b string"))
        if not more.isEmpty():
            found = keep(components(found.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more), keep))
    least = classes.select("node", "rep").join(found.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"))
    least = least.groupBy("comp").agg(F.min("rep").alias("component")).withColumnRenamed("comp", "_c")
    found = keep(found)
    reach = hot_join(found, ["comp"], least, ["_c"], found.count()).select(F.col("node").alias("_n"), "component")
    every = keep(classes.select("node", "rep").join(reach, F.col("node") == F.col("_n"), "left").select(F.col("node").alias("_n"), F.coalesce("component", "rep").alias("component_id")))
    out = rows.join(every, F.col("node") == F.col("_n"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "node")


def distinct_documents(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """docs without near duplicates: one row of each component stays, with all its columns, whatever their names.

    Rows are told apart by id. Where an id is null or occurs twice, the row's set decides, and of
    rows equal in both, one stays, that of the least text; rows with empty sets all stay. Very long
    texts are hashed whole. An empty table gives an empty result.
    """
    keep = Written(docs.sparkSession, "distinct").keep
    id_, gone_, row_, node_ = (free_name(docs, x) for x in ("_id", "_gone", "_row", "_node"))
    linked = keep(link(docs, size, threshold, k))
    several = keep(linked.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 or doc_id is null").select(F.col("doc_id").alias(id_)))
    gone = keep(linked.where("not kept and doc_id is not null").select(F.col("doc_id").alias(gone_)).distinct())
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    left = docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == F.col(gone_), "left_anti")
    if several.isEmpty():
        return left
    plain = left.join(several, left["doc_id"].eqNullSafe(F.col(id_)), "left_anti")
    odd = docs.join(several, docs["doc_id"].eqNullSafe(F.col(id_)), "left_semi")
    odd = sketch_nodes(odd.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns]).alias(row_)), size)
    verdict = linked.join(several, F.col("doc_id").eqNullSafe(F.col(id_)), "left_semi").where("kept and node is not null").select(F.col("doc_id").alias(id_), F.col("node").alias(node_)).distinct()
    full = odd.join(verdict, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col("node") == F.col(node_)))
    # A component of rows without ids has no least id; its least set stays for it. Copies are folded, not gathered.
    one = full.groupBy("doc_id", "node").agg(F.min("text").alias("_t")).withColumnRenamed("doc_id", id_).withColumnRenamed("node", node_)
    one = full.drop(id_, node_).join(one, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col("node") == F.col(node_)) & (F.col("text") == F.col("_t")))
    one = one.groupBy("doc_id", "node").agg(F.first(row_).alias(row_))
    empty = odd.join(linked.where("node is not null").select(F.col("node").alias(node_)).distinct(), F.col("node") == F.col(node_), "left_anti")
    unpack = [F.col(row_).getField(c).alias(c) for c in docs.columns]
    return plain.unionByName(one.select(*unpack)).unionByName(empty.select(*unpack))


def sketch_nodes(docs: DataFrame, size: int) -> DataFrame:
    """docs with node, the digest of each text's set."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        hasher = Hasher(size)
        for batch in batches:
            yield pd.Series([xxhash.xxh3_128_hexdigest(hasher.hashes(x).tobytes()) for x in batch], dtype="object")

    return docs.withColumn("node", F.pandas_udf(run, "string")(F.col("text")))


def _full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, n, hashes) of the wanted classes, from the texts of their representatives."""

    def run(batches):
        import pyarrow as pa

        hasher = Hasher(size)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                hashes = [hasher.hashes(x) for x in batch.column("text").slice(lo, ROWS).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(h) for h in hashes], pa.string()), pa.array([len(h) for h in hashes], pa.int64()), _lists(hashes)], names=["node", "n", "hashes"])

    # The ids are broadcast only while they are few.
    ids = wanted.select(F.col("rep").alias("_rep"))
    ids = F.broadcast(ids) if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids
    near = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
    full = near.select("text").mapInArrow(run, "node string, n long, hashes array<long>")
    full = full.join(wanted.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_semi")
    return full.dropDuplicates(["node"])


def query(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents")).drop("node")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT rid, hash(x) AS h, x FROM (
        SELECT rid, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS x
        FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.x = b.x AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT r.a AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""
