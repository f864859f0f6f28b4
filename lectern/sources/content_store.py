"""A versioned store of contents by path: branches, compare-and-set by digest, reads as of a version.

Contents are Parquet; a commit is a folder of changed rows and one small log file, whose creation is
the commit: the file of a version can be created once, so of two writers one wins and the other decides
anew against what the first has written. A reader takes the log up to a version, so it never
sees half a commit. What a put or a delete decides is a join of the changes with the manifest.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "path string, version long, sha string, deleted boolean, content binary"


class Contended(RuntimeError):
    """Other writers published before this one, again and again."""


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


class ContentStore:
    """branch: folder of a log; every branch begins at a version of another, or empty."""

    def __init__(self, spark: SparkSession, root: str, attempts: int = 10):
        self.spark, self.root, self.attempts = spark, root.rstrip("/"), attempts

    # The log.

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _create(self, path: str, text: str) -> bool:
        """Create a file with its content; False if it exists."""
        fs, target = self._fs(path)
        fs.mkdirs(target.getParent())
        if fs.getScheme() == "file":  # Hadoop's own check is not atomic here
            plain = target.toUri().getPath()
            part = f"{os.path.dirname(plain)}/.{uuid.uuid4().hex}"
            with open(part, "w") as file:
                file.write(text)
            try:
                os.link(part, plain)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(part)
        try:
            out = fs.create(target, False)
        except Exception as error:
            if fs.exists(target):
                return False
            raise error
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _log(self, branch: str, version: int | None = None) -> list[dict]:
        """Entries of a branch up to a version, oldest first, after those of the version it began at."""
        folder = f"{self.root}/log/{branch}"
        fs, target = self._fs(folder)
        if not fs.exists(target):
            return []
        rows = self.spark.read.schema("value string").option("wholetext", "true").text(folder).select("value").collect()  # a row a commit
        own = sorted((json.loads(r.value) for r in rows), key=lambda e: e["version"])
        own = [e for e in own if version is None or e["version"] <= version]
        if own and own[0].get("base"):
            own = self._log(own[0]["base"], own[0]["at"]) + own
        return own

    def branches(self) -> list[str]:
        fs, target = self._fs(f"{self.root}/log")
        return sorted(x.getPath().getName() for x in fs.listStatus(target)) if fs.exists(target) else []

    def head(self, branch: str) -> int:
        """The newest version; 0 where there is none."""
        log = self._log(branch)
        return log[-1]["version"] if log else 0

    def ensure_branch(self, branch: str, base: str | None = None) -> bool:
        """Make a branch at the head of base, or empty; True also if it is there already, False if base is not."""
        if base is not None and base not in self.branches():
            return False
        at = self.head(base) if base else 0
        self._create(f"{self.root}/log/{branch}/{0 if not base else at:012d}.json", json.dumps({"version": at, "base": base, "at": at, "data": None, "tag": None, "message": "branch"}))
        return True

    # Reading.

    def _rows(self, branch: str, version: int | None) -> DataFrame:
        log = self._log(branch, version)
        whole = max((i for i, e in enumerate(log) if e.get("whole")), default=0)
        folders = [f"{self.root}/data/{e['data']}" for e in log[whole:] if e["data"]]
        return self.spark.read.schema(ROW).parquet(*folders) if folders else self.spark.createDataFrame([], ROW)

    def manifest(self, branch: str, version: int | None = None, deleted: bool = False) -> DataFrame:
        """(path, sha, version) of what a branch holds, at its head or as of a version; contents are not read."""
        last = self._rows(branch, version).groupBy("path").agg(F.max(F.struct("version", "sha", "deleted")).alias("_l"))
        out = last.select("path", F.col("_l.sha").alias("sha"), F.col("_l.version").alias("version"), F.col("_l.deleted").alias("deleted"))
        return out if deleted else out.where("not deleted").drop("deleted")

    def read(self, branch: str, version: int | None = None) -> DataFrame:
        """(path, sha, version, content)."""
        rows = self._rows(branch, version).where("not deleted").select(F.col("path").alias("_p"), F.col("version").alias("_v"), "content")
        there = self.manifest(branch, version)
        return there.join(rows, (F.col("path") == F.col("_p")) & (F.col("version") == F.col("_v"))).select("path", "sha", "version", "content")

    # Writing.

    def put(self, branch: str, changes: DataFrame, message: str = "", tag: str | None = None) -> DataFrame:
        """Write changes (path, content, expected); (path, outcome, sha) of each, sha being what the branch has then.

        expected is the digest that the writer knows, null for a path that is new. outcome is created,
        updated, unchanged (the branch has this content) or conflict: the path is there already, is gone,
        or has another content than expected; of several rows of a path the one of the least digest counts, the others conflict. A
        tag is written once: if the branch has a commit of this tag, nothing is done and the outcome is repeated.
        Null paths and contents are refused as conflict. All of a put is visible at once, or nothing.
        """

        def decide(held: DataFrame) -> DataFrame:
            new = changes.select("path", "content", "expected", digest(F.col("content")).alias("_sha"))
            first = new.groupBy("path").agg(F.min("_sha").alias("_first"))
            new = new.dropDuplicates(["path", "_sha", "expected"]).join(first.withColumnRenamed("path", "_f"), F.col("path") == F.col("_f"), "left")
            both = new.join(held.select(F.col("path").alias("_p"), F.col("sha").alias("_held")), F.col("path") == F.col("_p"), "left")
            outcome = (
                F.when(F.col("path").isNull() | F.col("content").isNull() | (F.col("_sha") != F.col("_first")), "conflict")
                .when(F.col("_held") == F.col("_sha"), "unchanged")
                .when(F.col("_held").isNull() & F.col("expected").isNull(), "created")
                .when(F.col("_held") == F.col("expected"), "updated").otherwise("conflict")
            )
            return both.select("path", F.coalesce(outcome, F.lit("conflict")).alias("outcome"), F.col("_sha").alias("sha"), F.col("_held").alias("held"), F.lit(False).alias("deleted"), "content")

        return self._commit(branch, decide, message, tag)

    def delete(self, branch: str, paths: DataFrame, message: str = "", tag: str | None = None) -> DataFrame:
        """Delete paths (path, expected); (path, outcome, sha): deleted, missing, or conflict where the digest is another."""

        def decide(held: DataFrame) -> DataFrame:
            both = paths.select("path", "expected").dropDuplicates(["path"]).join(held.select(F.col("path").alias("_p"), F.col("sha").alias("_held")), F.col("path") == F.col("_p"), "left")
            outcome = F.when(F.col("_held").isNull(), "missing").when(F.col("_held") == F.col("expected"), "deleted").otherwise("conflict")
            return both.select("path", outcome.alias("outcome"), F.lit(None).cast("string").alias("sha"), F.col("_held").alias("held"), F.lit(True).alias("deleted"), F.lit(None).cast("binary").alias("content"))

        return self._commit(branch, decide, message, tag)

    def compact(self, branch: str) -> int:
        """Publish all that a branch holds as one commit, so that reading needs no older one; the version."""
        for _ in range(self.attempts):
            at = self.head(branch)
            data = self._write(self.read(branch, at).select("path", "version", "sha", F.lit(False).alias("deleted"), "content"))
            if self._publish(branch, at + 1, data, "compact", None, whole=True):
                return at + 1
        raise Contended(branch)

    def _write(self, rows: DataFrame) -> str:
        data = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/data/{data}")
        return data

    def _publish(self, branch: str, version: int, data: str, message: str, tag: str | None, **more) -> bool:
        entry = {"version": version, "data": data, "message": message, "tag": tag} | more
        return self._create(f"{self.root}/log/{branch}/{version:012d}.json", json.dumps(entry))

    def _commit(self, branch: str, decide: Callable[[DataFrame], DataFrame], message: str, tag: str | None) -> DataFrame:
        report = lambda folder: self.spark.read.parquet(f"{self.root}/outcomes/{folder}")
        for _ in range(self.attempts):
            log = self._log(branch)
            if tag is not None and (done := next((e for e in log if e["tag"] == tag), None)):
                return report(done["data"])
            at = log[-1]["version"] if log else 0
            # Decided once: what is reported is what is written.
            folder = uuid.uuid4().hex
            decide(self.manifest(branch, at)).write.parquet(f"{self.root}/decided/{folder}")
            decided = self.spark.read.parquet(f"{self.root}/decided/{folder}")
            wins = F.col("outcome").isin("created", "updated", "deleted")
            result = decided.select("path", "outcome", F.when(F.col("outcome") == "conflict", F.col("held")).otherwise(F.col("sha")).alias("sha"))
            changed = decided.where(wins)
            if tag is None and changed.isEmpty():
                return result
            data = self._write(changed.select("path", F.lit(at + 1).cast("long").alias("version"), "sha", "deleted", "content"))
            result.write.parquet(f"{self.root}/outcomes/{data}")
            if self._publish(branch, at + 1, data, message, tag):
                return report(data)
        raise Contended(branch)
