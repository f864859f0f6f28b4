"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring has 65,536 cells. Each shard owns ``replicas`` virtual nodes at hashed cells; a virtual
node's arc reaches back to the node before it. A key goes to the shard of its arc; where that shard
is full, it continues clockwise to the next shard with room. Loads are bounded as tightly as they
can be: with m rows and n shards every shard takes floor(m/n) or ceil(m/n) rows (law ``rows``).

Only counts by cell (65,536 rows at most, whatever the input) meet in one place. There one fold
over the arcs, in ring order, keeps the room left in each shard and the runs of keys carried on;
it yields pieces (arc, from, to, shard). A row finds its piece by its place in its arc, and its slot
from the piece, so rows are ordered only within their cell. A cell with more than one in ``HOT`` of all
rows, as that of rows without ids may be, is ordered in ``PARTS`` parts, dealt by a hash of the row's
number; their counts, HOT times PARTS at most, say where in the cell each part begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, table, text_or_empty

CELLS = 65_536
HOT, PARTS = 500, 64
_PIECE = "array<struct<arc:int,lo:bigint,hi:bigint>>"
_PLACED = "array<struct<arc:int,lo:bigint,hi:bigint,shard:int>>"


def _hash(text):
    return F.md5(text.cast("binary"))


def _cell(digest):
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def ring(spark, shards: int, replicas: int) -> DataFrame:
    """(arc, shard): one row per taken cell; where two virtual nodes meet, the smaller digest stays."""
    nodes = spark.range(0, shards * replicas, 1, 1).select(F.expr(f"cast(id % {shards} as int)").alias("shard"), _hash(F.concat(F.lit("node:"), F.expr(f"cast(id % {shards} as string)"), F.lit(":"), F.expr(f"cast(id div {shards} as string)"))).alias("digest"))
    return nodes.groupBy(_cell(F.col("digest")).alias("arc")).agg(F.min_by("shard", "digest").alias("shard"))


def _allocate(arcs: str, shards: int) -> str:
    """SQL of the fold: arcs is an array of (arc, n, shard) in ring order.

    A second turn round the ring places what is still carried: every shard is met again, and the
    rooms left add up to what is carried.
    """
    own = "least(e.n, s.room[e.shard])"
    room = f"(s.room[e.shard] - {own})"
    # Split the carried runs, first come first served: what fits into the room, and the rest.
    fed = f"""aggregate(s.carry, named_struct('left', {room}, 'got', cast(array() as {_PLACED}), 'kept', cast(array() as {_PIECE})),
        (t, p) -> named_struct(
          'left', t.left - least(t.left, p.hi - p.lo),
          'got', if(t.left > 0, concat(t.got, array(named_struct('arc', p.arc, 'lo', p.lo, 'hi', p.lo + least(t.left, p.hi - p.lo), 'shard', e.shard))), t.got),
          'kept', if(p.hi - p.lo > t.left, concat(t.kept, array(named_struct('arc', p.arc, 'lo', p.lo + t.left, 'hi', p.hi))), t.kept)))"""
    mine = f"if({own} > 0, array(named_struct('arc', e.arc, 'lo', 0L, 'hi', {own}, 'shard', e.shard)), cast(array() as {_PLACED}))"
    rest = f"if(e.n > {own}, array(named_struct('arc', e.arc, 'lo', {own}, 'hi', e.n)), cast(array() as {_PIECE}))"
    take = lambda used: f"transform(s.room, (x, i) -> if(i = e.shard, x - {used}, x))"
    plain = f"named_struct('room', {take(own)}, 'carry', {rest}, 'out', if({own} > 0, concat(s.out, {mine}), s.out))"
    mixed = f"""aggregate(array({fed}), s, (q, f) -> named_struct(
        'room', transform(q.room, (x, i) -> if(i = e.shard, f.left, x)),
        'carry', concat(f.kept, {rest.replace('s.', 'q.')}),
        'out', concat(q.out, {mine.replace('s.', 'q.')}, f.got)))"""
    total = f"aggregate({arcs}, 0L, (x, e) -> x + e.n)"
    rooms = f"transform(sequence(0, {shards - 1}), i -> {total} div {shards} + if(i < {total} % {shards}, 1L, 0L))"
    turns = f"concat({arcs}, transform({arcs}, a -> named_struct('arc', a.arc, 'n', 0L, 'shard', a.shard)))"
    return f"""aggregate({turns}, named_struct('room', {rooms}, 'carry', cast(array() as {_PIECE}), 'out', cast(array() as {_PLACED})),
        (s, e) -> if(size(s.carry) = 0, {plain}, if(s.room[e.shard] = 0 and e.n = 0, s, {mixed})), s -> s.out)"""


def assign(docs: DataFrame, shards: int = 40, replicas: int = 128) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs (doc_id, text; the rest is not read).

    size is the text's UTF-8 bytes plus 16. Null and empty texts count 16. Shards differ by one row
    at most; slots run from 0 without gaps. A null id is a key of its own; repeated rows are placed
    one by one, ties in any order. Very long texts count whole. No other column of docs is read, so
    none can clash. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id"), (F.octet_length(text_or_empty()) + 16).cast("long").alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32"), _hash(F.concat(F.lit("key:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("_digest"))
    # Written once, which fixes the rows' numbers.
    slim = Written(spark, "ring").keep(slim.withColumn("_cell", _cell(F.col("_digest"))).withColumn("_number", F.monotonically_increasing_id()))
    counts = slim.groupBy(F.col("_cell").alias("cell")).agg(F.count("*").alias("n"))
    hot = F.broadcast(counts.where(F.col("n") * HOT > slim.count()).select(F.col("cell").alias("_hot")))
    slim = slim.join(hot, F.col("_cell") == F.col("_hot"), "left").withColumn("_part", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("_number"), F.lit(PARTS))))
    parts = slim.where("_hot is not null").groupBy(F.col("_cell").alias("_c"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    parts = parts.select("_c", "_p", F.coalesce(F.sum("_n").over(Window.partitionBy("_c").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("_ahead"))
    nodes = ring(spark, shards, replicas)
    # As-of join on the ring: a cell belongs to the next virtual node clockwise, the last to the first.
    both = counts.select("cell", "n", F.lit(None).cast("int").alias("arc")).unionByName(nodes.select(F.col("arc").alias("cell"), F.lit(0).cast("long").alias("n"), "arc"))
    ahead = Window.partitionBy().orderBy(F.col("cell").desc(), F.col("arc").asc_nulls_last())
    owner = F.coalesce(F.last("arc", ignorenulls=True).over(ahead), F.min("arc").over(Window.partitionBy()))
    cells = both.withColumn("owner", owner).where("n > 0").select("cell", "n", F.col("owner").alias("arc"))
    # Cells after the last node come first in the first node's arc.
    turn = Window.partitionBy("arc").orderBy((F.col("cell") <= F.col("arc")).cast("int"), "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("start", F.coalesce(F.sum("n").over(turn), F.lit(0)))
    arcs = nodes.join(cells.groupBy("arc").agg(F.sum("n").alias("n")), "arc", "left").select(F.struct("arc", F.coalesce("n", F.lit(0)).alias("n"), "shard").alias("a"))
    pieces = arcs.agg(F.array_sort(F.collect_list("a")).alias("arcs")).select(F.explode(F.expr(_allocate("arcs", shards))).alias("p")).select("p.*")
    first = Window.partitionBy("shard").orderBy("arc", "lo").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_slot0", F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(first), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("_cell", "_part").orderBy("_digest", "doc_id", "text_crc32", "size"))
    placed = slim.withColumn("_rank", rank.cast("long") - 1).join(F.broadcast(parts), (F.col("_cell") == F.col("_c")) & (F.col("_part") == F.col("_p")), "left")
    placed = placed.withColumn("_rank", F.col("_rank") + F.coalesce("_ahead", F.lit(0).cast("long")))
    # Both sides below are bounded by the ring, not by the input: 65,536 cells, and pieces by arcs and shards.
    placed = placed.join(F.broadcast(cells.select(F.col("cell").alias("_cell"), "arc", "start")), "_cell").withColumn("_at", F.col("start") + F.col("_rank"))
    placed = placed.join(F.broadcast(pieces.withColumnRenamed("arc", "_arc")), (F.col("arc") == F.col("_arc")) & (F.col("_at") >= F.col("lo")) & (F.col("_at") < F.col("hi")))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("_slot0") + F.col("_at") - F.col("lo")).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The fold over the arcs as a recursion, an arc a step, with the rows carried on as a list.
SQL = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY x) AS w FROM (SELECT x, list_reduce(list_prepend(x, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) r(x))),
nodes AS (SELECT s AS shard, md5(concat('node:', s, ':', v)) AS digest FROM range(40) a(s), range(128) b(v)),
ring AS (SELECT CAST(concat('0x', substr(digest, 1, 4)) AS INT) AS arc, CAST(arg_min(shard, digest) AS INT) AS shard FROM nodes GROUP BY 1),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST(concat('0x', h) AS BIGINT))), lambda c, b: xor(w[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32,
  md5(concat('key:', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS digest FROM documents, crc),
k AS (SELECT *, row_number() OVER () AS id, CAST(concat('0x', substr(digest, 1, 4)) AS INT) AS cell FROM d),
o AS (SELECT k.*, coalesce(r.arc, (SELECT min(arc) FROM ring)) AS arc FROM k ASOF LEFT JOIN ring r ON k.cell <= r.arc),
p AS (SELECT *, row_number() OVER (PARTITION BY arc ORDER BY CAST(cell <= arc AS INT), cell, digest, doc_id, text_crc32, size) AS pos FROM o),
a AS (SELECT arc, shard, row_number() OVER (ORDER BY arc) AS i, coalesce(ids, []) AS ids FROM ring LEFT JOIN (SELECT arc, list(id ORDER BY pos) AS ids FROM p GROUP BY arc) USING (arc)),
turns AS (SELECT i, shard, ids FROM a UNION ALL SELECT i + (SELECT count(*) FROM a), shard, [] FROM a),
f AS (SELECT CAST(0 AS BIGINT) AS i, (SELECT list(n // 40 + CAST(s < n % 40 AS INT) ORDER BY s) FROM range(40) r(s), (SELECT count(*) AS n FROM d)) AS room, CAST([] AS BIGINT[]) AS carry, CAST([] AS BIGINT[]) AS got, CAST(NULL AS INT) AS shard
  UNION ALL
  SELECT i, list_transform(room, lambda x, j: CASE WHEN j = shard + 1 THEN x - len(got) ELSE x END), list_concat(carry[fed + 1:], ids[own + 1:]), got, shard
  FROM (SELECT *, list_concat(ids[:own], carry[:fed]) AS got FROM (SELECT t.i, t.shard, t.ids, f.room, f.carry, least(len(t.ids), f.room[t.shard + 1]) AS own, least(len(f.carry), f.room[t.shard + 1] - least(len(t.ids), f.room[t.shard + 1])) AS fed
    FROM f JOIN turns t ON t.i = f.i + 1))),
placed AS (SELECT unnest(got) AS id, shard FROM f WHERE len(got) > 0)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY arc, pos) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM p JOIN placed USING (id)
"""
