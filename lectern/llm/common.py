"""Shared helpers: tables, the shared folder, written intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: A key with more than one in HOT rows is hot, and is dealt over SALTS tasks.
HOT, SALTS = 500, 32
#: Rows of an Arrow batch, where the session has not set its own: texts are long.
BATCH_ROWS = 1000
#: A word of the count contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one made here where it is unset.

    A folder made here is the machine's own, which only a local master shares with itself; on a
    cluster without the setting this raises RuntimeError.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", path)
        atexit.register(_forget, path.removeprefix("file://"))
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows from now on, if the session still has Spark's default of 10,000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


_ONLY: dict[str, object] = {}


def only(key: str, make):
    """A worker's one large object, by key. Workers are reused between stages: another key's gives way first."""
    if key not in _ONLY:
        _ONLY.clear()
        _release()
        _ONLY[key] = make()
    return _ONLY[key]


def _release() -> None:
    """Give freed memory back to the system, where the C library can."""
    import ctypes
    import gc

    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def hot_join(rows: DataFrame, by: list[str], other: DataFrame, on: list[str], n_rows: int, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """rows joined (how: inner or left) to other (a row for each key at most) where by = on, with hot keys of rows dealt over SALTS tasks.

    Hot is a key with more than one in HOT of n_rows, which rows has; so there are HOT of them at most,
    and their list comes to the driver. rows is a table that gives the same rows whenever it is read.
    hot: the hot keys, named as in by, where they are known already.
    """
    keys = [F.col(a) == F.col(b) for a, b in zip(by, on, strict=True)]
    names = [f"_h{i}" for i in range(len(by))]
    hot = rows.groupBy(*by).agg(F.count("*").alias("_c")).where(F.col("_c") * HOT > n_rows) if hot is None else hot
    hot = hot.select(*[F.col(c).alias(h) for c, h in zip(by, names, strict=True)])
    found = hot.collect()
    if not found:
        return rows.join(other, keys, how)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, hot.schema).withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    spread = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    match = lambda cs: [F.col(c) == F.col(h) for c, h in zip(cs, names, strict=True)]
    left = rows.join(hot, match(by), "left").withColumn("_salt", salt).drop(*names, "_hot")
    right = other.join(hot, match(on), "left").withColumn("_salt2", F.explode(spread)).drop(*names, "_hot")
    return left.join(right, [*keys, F.col("_salt") == F.col("_salt2")], how).drop("_salt", "_salt2")


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores before it, so that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """doc_id, text and ``names``, and in the struct _row the columns of docs beside doc_id and text, out of the way of all else."""
    rest = [F.col(c) for c in docs.columns if c not in ("text",)]
    return docs.select("doc_id", "text", *names, F.struct(*rest).alias("_row"))


def whole_ids(docs: DataFrame) -> None:
    """Raise TypeError unless doc_id is of a whole-number type."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id is {kind.simpleString()}; this operator takes whole numbers")


def _forget(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table through Hadoop's file system, whatever store holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _clear(spark: SparkSession, path: str) -> None:
    # At the process's end; a session that has stopped leaves its folder to the cluster.
    with contextlib.suppress(Py4JError, OSError):
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            remove(spark, path)


class Written:
    """Intermediate tables in the shared folder: they cut the lineage and outlive an executor.

    ``keep`` writes a table and reads it back, so that the planner knows its real size and
    broadcasts it only below the session's threshold. ``drop`` deletes tables that no later
    plan reads; the rest go when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}
        atexit.register(_clear, spark, self.base)

    def keep(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.base}/{self.n}", self.n + 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := self.paths.pop(id(df), None):
                remove(self.spark, path)


def text_or_empty(col="text"):
    return F.coalesce(F.col(col), F.lit(""))


def word_count(col="text"):
    """Words of a text as a long; null has none."""
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")
