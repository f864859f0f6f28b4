"""A search index that grows: segments, tombstones, and statistics of what is live.

An upload becomes a segment of its own, with postings and lengths; nothing that is there is written
again. A chunk that is deleted or replaced is named by a tombstone of its segment. Statistics that scores depend on
(number and length of chunks, each term's documents) are those of before with the new segment's own, less what the
new tombstones take, so results are those of an index built anew. Which segments count is one small
manifest, kept in a content store and replaced by compare-and-set: a reader sees a change whole or not at all.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.content_store import ContentStore
from . import retrieval as R


#: The manifest of an index that holds nothing.
NOTHING = {"segments": [], "dead": None, "stats": None}


class Changed(RuntimeError):
    """Another writer changed the index meanwhile."""


class GrowingIndex:
    """An index under path. Chunks are chunk_id, source, title, text; vectors chunk_id, embedding; ids of one type."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = ContentStore(spark, f"{self.path}/manifest")

    def _manifest(self) -> tuple[dict, str | None]:
        row = self.store.read("index").where("path = 'manifest'").first()
        return (json.loads(bytes(row.content)), row.sha) if row else (NOTHING, None)

    def _table(self, *names: str) -> DataFrame:
        return self.spark.read.parquet("/".join((self.path, *names)))

    def _union(self, segments: list[str], name: str) -> DataFrame:
        """A table of all segments, with the segment."""
        out = None
        for s in segments:
            part = (self._postings(s) if name == "postings" else self._table(s, name)).withColumn("_segment", F.lit(s))
            out = part if out is None else out.unionByName(part)
        return out

    def _postings(self, segment: str) -> DataFrame:
        """A segment's pages; their blocks are named apart from those of others."""
        pages = R.read_postings(self._table(segment, "chunks"), f"{self.path}/{segment}/postings")
        return pages.withColumn("block", F.concat(F.lit(f"{segment}/"), F.col("block")))

    def _live(self, rows: DataFrame, dead: DataFrame | None) -> DataFrame:
        if dead is None:
            return rows.drop("_segment")
        gone = dead.select(F.col("segment").alias("_s"), F.col("chunk_id").alias("_c"))
        return rows.join(gone, (F.col("_segment") == F.col("_s")) & (F.col("chunk_id") == F.col("_c")), "left_anti").drop("_segment")

    def _dead(self, manifest: dict) -> DataFrame | None:
        return self._table("dead", manifest["dead"]) if manifest["dead"] else None

    def _build(self, chunks: DataFrame, vectors: DataFrame) -> str:
        """Write a segment."""
        name = f"segment-{uuid.uuid4().hex}"
        chunks.select("chunk_id", "source", "title", "text").write.parquet(f"{self.path}/{name}/chunks")
        vectors.select("chunk_id", "embedding").write.parquet(f"{self.path}/{name}/vectors")
        postings = R.write_postings(R.indexed_text(self._table(name, "chunks")), f"{self.path}/{name}/postings")
        R.posted_terms(postings).write.parquet(f"{self.path}/{name}/terms")
        return name

    def _publish(self, was: dict, segments: list[str], fresh: list[str], gone: DataFrame | None, expected: str | None, message: str) -> None:
        """Write tombstones and statistics of these segments, and make them the index.

        was is the manifest of before, or one of nothing; fresh segments are new, gone are tombstones beyond its own.
        """
        at = {"segments": segments, "dead": was["dead"], "stats": uuid.uuid4().hex}
        if gone is not None:
            at["dead"] = uuid.uuid4().hex
            gone.write.parquet(f"{self.path}/dead/{at['dead']}-new")
            gone, dead = self._table("dead", f"{at['dead']}-new"), self._dead(was)
            (gone if dead is None else dead.unionByName(gone)).write.parquet(f"{self.path}/dead/{at['dead']}")
        stats = f"{self.path}/stats/{at['stats']}"
        R.measured(self._live(R.posted_chunks(self._union(segments, "postings")), self._dead(at))).write.parquet(f"{stats}/corpus")
        parts = [self._table("stats", was["stats"], "terms")] if was["stats"] else []
        parts += [self._table(s, "terms") for s in fresh]
        if gone is not None:
            # Counted from the texts of the dead: a join a chunk, none a posting.
            texts = self._union(segments, "chunks").join(gone.select(F.col("segment").alias("_s"), F.col("chunk_id").alias("_c")), (F.col("_segment") == F.col("_s")) & (F.col("chunk_id") == F.col("_c")), "left_semi")
            parts.append(R.only_terms(R.vocabulary(R.indexed_text(texts))).withColumn("df", -F.col("df")))
        terms = None
        for part in parts:
            part = part.select("term", "df")
            terms = part if terms is None else terms.unionByName(part)
        terms.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").write.parquet(f"{stats}/words")
        R.weights(self._table("stats", at["stats"], "words"), self._table("stats", at["stats"], "corpus")).write.parquet(f"{stats}/terms")
        row = self.spark.createDataFrame([("manifest", bytearray(json.dumps(at).encode()), expected)], "path string, content binary, expected string")
        if self.store.put("index", row, message).first().outcome not in ("created", "updated"):
            raise Changed(self.path)

    def _tombstones(self, at: dict, ids: DataFrame) -> DataFrame | None:
        """The chunks of ids (chunk_id) that are live."""
        if not at["segments"]:
            return None
        rows = R.posted_chunks(self._union(at["segments"], "postings")).select(F.col("_segment").alias("segment"), "chunk_id")
        more = rows.join(ids.select(F.col("chunk_id").alias("_i")).distinct(), F.col("chunk_id") == F.col("_i"), "left_semi")
        dead = self._dead(at)
        return more if dead is None else more.join(dead, ["segment", "chunk_id"], "left_anti")

    def add(self, chunks: DataFrame, vectors: DataFrame) -> None:
        """Make chunks and their vectors searchable; those whose chunk_id is there already replace it.

        Of rows of one chunk_id one is taken, that of the greatest text. A chunk may have no vector. Raises Changed, and
        changes nothing, where another writer was first.
        """
        at, sha = self._manifest()
        chunks = chunks.groupBy("chunk_id").agg(F.max(F.struct("text", "title", "source")).alias("_c")).select("chunk_id", "_c.source", "_c.title", "_c.text")
        segment = self._build(chunks, vectors.dropDuplicates(["chunk_id"]))
        self._publish(at, [*at["segments"], segment], [segment], self._tombstones(at, self._table(segment, "chunks")), sha, "add")

    def delete(self, ids: DataFrame) -> None:
        """Take chunks (chunk_id) out; ids that are not there are passed over."""
        at, sha = self._manifest()
        if at["segments"]:
            self._publish(at, at["segments"], [], self._tombstones(at, ids), sha, "delete")

    def merge(self) -> None:
        """Write all that is live as one segment; results stay as they are."""
        at, sha = self._manifest()
        if at["segments"]:
            index = self.open()
            merged = [self._build(index.chunks, index.vectors)]
            self._publish(NOTHING, merged, merged, None, sha, "merge")

    def open(self) -> R.Index:
        """The index as it is now, for retrieval.bm25 and retrieval.hybrid_search. Raises FileNotFoundError where nothing was added yet."""
        at, _ = self._manifest()
        if not at["segments"]:
            raise FileNotFoundError(f"nothing is indexed at {self.path}")
        dead = self._dead(at)
        live = [self._live(self._union(at["segments"], name), dead) for name in ("chunks", "vectors")]
        stats = [self._table("stats", at["stats"], name) for name in ("terms", "corpus")]
        return R.Index(*live, self._union(at["segments"], "postings"), *stats, dead=None if dead is None else dead.withColumnRenamed("segment", "_segment"))
