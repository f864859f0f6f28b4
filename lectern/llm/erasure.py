"""Cascading erasure: rows of erased clients, and all that hangs on them, leave written Parquet files.

A table is laid out in files of equally many consecutive rows of its order, and erasure works on these
files alone: joins over their columns find the victims, Spark's hidden file metadata (name and row
index) says where they are, positions are gathered into a bitmap a file and block of rows, and files that hold some
are read again, lose these rows and are written anew. Files without victims are never opened for
writing. The driver holds names and counts of files, no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, hot_join, remove, shared_dir, table

#: A table has about this many files at most; one master in ONE_IN is a victim.
FILES, ONE_IN = 250, 200
#: Rows of a file whose positions share a bitmap.
BLOCK = 32_768


@dataclass
class Files:
    """A table's files: file_no to name, rows of the table, and rows of every file but the last."""

    folder: str
    names: dict[int, str]
    rows: int
    each: int


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _digits(col) -> Column:
    """crc32 of a column in decimal; null is the empty string."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def _files(spark: SparkSession, folder: str) -> list[str]:
    """Names of a folder's Parquet files, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(n for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path) if (n := x.getPath().getName()).endswith(".parquet"))


def _move(spark: SparkSession, source: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    if not path(target).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path(source), path(target)):
        raise OSError(f"{source} could not become {target}")


def _place(df: DataFrame, name: str, index: str) -> list[Column]:
    """Where Spark read each row."""
    m = df.metadataColumn("_metadata")
    return [m["file_name"].alias(name), m["row_index"].alias(index)]


def _publish(spark: SparkSession, rows: DataFrame, folder: str, mark: str) -> dict[int, str]:
    """Write rows (a partition a file, numbered by it) beside folder, then move its files into it; file_no to name."""
    staged = f"{folder}.{uuid.uuid4().hex}"
    rows.write.option("maxRecordsPerFile", 0).parquet(staged)
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    out = {}
    for name in _files(spark, staged):
        no = int(re.match(r"part-(\d+)", name)[1])
        out[no] = f"{no:05d}{mark}.parquet"
        _move(spark, f"{staged}/{name}", f"{folder}/{out[no]}")
    remove(spark, staged)
    return out


def lay_out(df: DataFrame, crc: Column, folder: str, data: str | None = None, most: int = FILES) -> Files:
    """Write df in the order of crc, then of all its columns from left to right (ascending, nulls first), in files of 1 + n div most rows.

    data: the struct column that holds the columns to write, if not all of df is data.

    Two passes, neither of which gathers anything: rows are range-partitioned by their whole order and
    written as sorted runs (equal rows, which may be any number, are parted by where they were read), then a row's number, which
    is its run's first number and its row index in the run, gives its file. A file is written by one
    task, streaming. df is a table that gives the same rows whenever it is read; columns have orderable types.
    """
    spark, columns = df.sparkSession, df.schema[data].dataType.names if data else df.columns
    written = Written(spark, "runs")
    order = ["_o", *[f"c{i}" for i in range(len(columns))], "_at"]
    of = lambda c: F.col(data).getField(c) if data else _quoted(c)
    rows = df.select(crc.alias("_o"), *[of(c).alias(f"c{i}") for i, c in enumerate(columns)], F.monotonically_increasing_id().alias("_at"))
    by = [F.col(c).asc_nulls_first() for c in order]
    runs = written.keep(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_o", "_at"))
    name, index = _place(runs, "_run", "_i")
    sizes = runs.select(name).groupBy("_run").count().orderBy("_run").collect()  # a row a run
    n = sum(r["count"] for r in sizes)
    each, starts, at = 1 + n // most, [], 0
    for r in sizes:
        starts.append((r["_run"], at))
        at += r["count"]
    if not n:
        written.drop(runs)
        return Files(folder, {}, 0, each)
    starts = F.broadcast(spark.createDataFrame(starts, "_first_run string, _first long"))
    rows = runs.select("*", name, index).join(starts, F.col("_run") == F.col("_first_run")).withColumn("_n", F.col("_first") + F.col("_i"))
    n_files = -(-n // each)
    rows = rows.repartitionById(n_files, F.expr(f"cast(_n div {each} as int)")).sortWithinPartitions("_n")
    rows = rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
    names = _publish(spark, rows, folder, "")
    written.drop(runs)
    return Files(folder, names, n, each)


def read(spark: SparkSession, files: Files) -> DataFrame:
    return spark.read.parquet(files.folder)


def positions(found: DataFrame, name: str, index: str) -> DataFrame:
    """(_file, _block, _bits) from the places of rows to drop: a bitmap for each file and BLOCK of its rows."""
    bits = F.bitmap_construct_agg(F.col(index) % BLOCK)
    return found.groupBy(F.col(name).alias("_file"), F.expr(f"{index} div {BLOCK}").alias("_block")).agg(bits.alias("_bits"))


def rewrite(spark: SparkSession, files: Files, marks: DataFrame) -> tuple[Files, dict[int, int]]:
    """The files without the rows that marks (see positions) has, and how many rows each file lost.

    Only files that marks names are read and written, each by one task, in its order; one that keeps
    no row is removed. New files are in place before old ones go.
    """
    lost = {r["_file"]: r.n for r in marks.groupBy("_file").agg(F.sum(F.bitmap_count("_bits")).alias("n")).collect()}  # a row a file
    numbers = {name: no for no, name in files.names.items()}
    if not lost:
        return files, {}
    old = spark.read.parquet(*[f"{files.folder}/{name}" for name in sorted(lost)])
    columns = old.columns
    rows = old.select(*[_quoted(c).alias(f"c{i}") for i, c in enumerate(columns)], *_place(old, "_name", "_i"))
    rows = rows.join(marks, (F.col("_name") == F.col("_file")) & (F.expr(f"_i div {BLOCK}") == F.col("_block")), "left")
    byte = F.expr(f"cast(conv(hex(substring(_bits, cast(_i % {BLOCK} div 8 as int) + 1, 1)), 16, 10) as int)")
    rows = rows.withColumn("_byte", byte).where(F.col("_bits").isNull() | (F.expr("shiftright(_byte, cast(_i % 8 as int)) & 1") == 0))
    n_files = -(-files.rows // files.each)
    rows = rows.repartitionById(n_files, F.expr("cast(substring(_name, 1, 5) as int)")).sortWithinPartitions("_i")
    full = lambda no: min(files.each, files.rows - no * files.each)
    gone = {numbers[name]: n for name, n in lost.items()}
    left = {no for no, n in gone.items() if n < full(no)}
    new = _publish(spark, rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]), files.folder, "-rewritten") if left else {}
    for name in lost:
        remove(spark, f"{files.folder}/{name}")
    for no in set(new) - left:  # Spark writes a first file even of no rows
        remove(spark, f"{files.folder}/{new.pop(no)}")
    names = {no: name for no, name in files.names.items() if no not in gone} | new
    return Files(files.folder, names, files.rows, files.each), gone


def victim_masters(clients: DataFrame, clicks: DataFrame) -> tuple[Column, int | None]:
    """Whether a row's master_id is a victim, and the master whose clients have most clicks (ties: the smallest; null if there is no master).

    A client_id that occurs with several masters counts to each; equal pairs count once.
    """
    pairs = clients.where("master_id is not null").select("master_id", "client_id").distinct()
    each = clicks.where("client_id is not null").groupBy(F.col("client_id").alias("_client")).agg(F.count("*").alias("_n"))
    most = pairs.join(each, F.col("client_id") == F.col("_client"), "left").groupBy("master_id").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"))
    top = most.orderBy(F.desc("_n"), "master_id").first()
    top = top.master_id if top else None
    return F.coalesce((_digits(F.col("master_id")) % ONE_IN == 0) & F.col("master_id").isNotNull() | (F.col("master_id") == F.lit(top)), F.lit(False)), top


def _found(spark: SparkSession, files: Files, key: str, ids: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Places, and the columns of also, of rows whose key is one of ids (its one column, _id)."""
    rows = read(spark, files)
    rows = rows.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_also_{c}") for c in also], *_place(rows, "_name", "_i")).where("_key is not null")
    return hot_join(rows, ["_key"], ids, ["_id"], files.rows).drop("_key", "_id")


@dataclass
class Erased:
    """files and lost by table name: the final files, and rows that each has lost."""

    files: dict[str, Files]
    lost: dict[str, dict[int, int]]


def erase(clients: DataFrame, clicks: DataFrame, sales: DataFrame, sale_lines: DataFrame, folder: str, most: int = FILES) -> Erased:
    """Lay the four tables out in ``folder``, then erase the victim masters' clients, their clicks and sales, and these sales' lines.

    Nulls: a null client_id or sale_id belongs to nobody and sorts as the empty string, a null master is
    no victim, and rows of a victim master are victims also without a client_id. A sale_id that occurs
    several times is all its clients' (its lines go with any of them) and sorts by the smallest.
    Equal rows stay as often as they occur. Other columns are kept in place, whatever their names; an empty
    table has no files.
    """
    spark = clients.sparkSession
    written = Written(spark, "erasure")
    # A line's sale gives its client; lines without a sale id stay out of the join.
    of = sales.where("sale_id is not null").groupBy(F.col("sale_id").alias("_sale")).agg(F.min("client_id").alias("_client"))
    lines = sale_lines.select(F.col("sale_id").alias("_key"), F.struct(*[_quoted(c) for c in sale_lines.columns]).alias("_row"))
    there = lines.where("_key is not null")
    joined = hot_join(there, ["_key"], of, ["_sale"], there.count(), "left").select("_row", "_client")
    lines = written.keep(joined.unionByName(lines.where("_key is null").select("_row", F.lit(None).cast(clients.schema["client_id"].dataType).alias("_client"))))

    own = lambda df, name: lay_out(df, _digits(F.col("client_id")), f"{folder}/{name}", most=most)
    files = {"clients": own(clients, "clients"), "clicks": own(clicks, "clicks"), "sales": own(sales, "sales")}
    files["sale_lines"] = lay_out(lines, _digits(F.col("_client")), f"{folder}/sale_lines", "_row", most)
    written.drop(lines)

    # Victims, by the files alone.
    none = spark.createDataFrame([], "_name string, _i long")
    places = dict.fromkeys(files, none)
    if files["clients"].rows:
        c = read(spark, files["clients"])
        clicked = read(spark, files["clicks"]) if files["clicks"].rows else clicks
        is_victim, _ = victim_masters(c, clicked)
        places["clients"] = c.where(is_victim).select(*_place(c, "_name", "_i"))
        ids = written.keep(c.where(is_victim).where("client_id is not null").select(F.col("client_id").alias("_id")).distinct())
        if files["clicks"].rows:
            places["clicks"] = _found(spark, files["clicks"], "client_id", ids)
        if files["sales"].rows:
            places["sales"] = found = written.keep(_found(spark, files["sales"], "client_id", ids, ("sale_id",)))
            if files["sale_lines"].rows:
                sold = written.keep(found.where("_also_sale_id is not null").select(F.col("_also_sale_id").alias("_id")).distinct())
                places["sale_lines"] = _found(spark, files["sale_lines"], "sale_id", sold)
    marks = {name: written.keep(positions(found, "_name", "_i")) for name, found in places.items()}
    out, lost = {}, {}
    for name, of_table in files.items():
        out[name], lost[name] = rewrite(spark, of_table, marks[name])
    return Erased(out, lost)


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A file's rows, cents and digest of its first column; a task has one file, in order."""
    import hashlib

    sha, n, cents, no = hashlib.sha256(), 0, 0, None
    for batch in batches:
        if not len(batch):
            continue
        no = int(batch["_no"].iloc[0])
        sha.update(("," if n else "").encode() + ",".join(batch["_first"].fillna("")).encode())
        n, cents = n + len(batch), cents + int(batch["_cents"].sum())
    if n:
        yield pd.DataFrame({"file_no": [no], "n_rows": [n], "cents": [cents], "ids_sha256": [sha.hexdigest()]})


def report(spark: SparkSession, erased: Erased, money: dict[str, str]) -> DataFrame:
    """A row per final file, read from it; money: the column of each table whose cents are added up (not finite: 0)."""
    out = spark.createDataFrame([], "file_no long, n_rows long, cents long, ids_sha256 string, table_name string, columns string, path string, n_erased long, rewritten boolean")
    for name, files in erased.files.items():
        if not files.names:
            continue
        rows = read(spark, files)
        x = F.col(money[name]).cast("double")
        cents = F.when(F.abs(x) < float("inf"), F.floor(x * 100 + 0.5)).otherwise(0)
        place = _place(rows, "_name", "_i")
        narrow = rows.select(_quoted(rows.columns[0]).cast("string").alias("_first"), F.coalesce(cents, F.lit(0)).cast("long").alias("_cents"), *place).withColumn("_no", F.expr("cast(substring(_name, 1, 5) as int)"))
        n_files = -(-files.rows // files.each)
        got = narrow.repartitionById(n_files, F.col("_no")).sortWithinPartitions("_i").select("_no", "_first", "_cents").mapInPandas(_digest, "file_no long, n_rows long, cents long, ids_sha256 string")
        lost = erased.lost[name]
        known = spark.createDataFrame([(no, f"{files.folder}/{file}", lost.get(no, 0), no in lost) for no, file in files.names.items()], "_n long, path string, n_erased long, rewritten boolean")
        got = got.join(F.broadcast(known), F.col("file_no") == F.col("_n")).drop("_n")
        out = out.unionByName(got.withColumns({"table_name": F.lit(name), "columns": F.lit(",".join(rows.columns))}))
    return out


def query(spark, sf_dir: str, most: int = FILES) -> DataFrame:
    """The shop's four tables laid out in a new folder, the victims erased, and a row per final file."""
    folder = f"{shared_dir(spark)}/erasure-{uuid.uuid4().hex}"
    erased = erase(*[table(spark, sf_dir, t) for t in ("clients", "clicks", "sales", "sale_lines")], folder, most)
    return report(spark, erased, {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"})
