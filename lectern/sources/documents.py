"""Documents as a Spark data source: DOCX blocks and the pages of formats with a page reader.

``spark.read.format("documents")`` lists a folder's files, keeps those that pushed filters on source and
ext leave, and deals them out: small files together, the pages of a large one as ranges. A file that no
partition has is never opened. DOCX is read here, block by block; a page reader is a class named by an
option, with ``count(content)`` and ``pages(content, first, last)``, so PDF libraries stay outside.
"""

from __future__ import annotations

import importlib
import io
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringEndsWith, StringStartsWith

SCHEMA = "source string, ext string, block_pos int, row_pos int, kind string, style string, text string, cells array<string>, ocr_text string, n_columns int, significant boolean, item string"
#: Bytes and files of a partition, and pages of a range, where the options do not say.
PART_BYTES, PART_FILES, RANGE_PAGES = 16 << 20, 200, 50
#: Rows and characters of an Arrow batch that a reader gives at most, but for what its last row goes beyond them.
BATCH_ROWS, BATCH_CHARS = 5000, 4 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def store_of(path: str):
    """(file system, path in it) of a plain path or any URI that Arrow opens."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


class BrokenDocument(ValueError):
    """A file is not what its name says."""


def _style_names(package: zipfile.ZipFile) -> tuple[dict[str, str], str]:
    """Names of paragraph styles by id, and that of the default."""
    names, default = {}, ""
    if "word/styles.xml" in package.namelist():
        with package.open("word/styles.xml") as file:
            for _, style in ElementTree.iterparse(file):
                if style.tag == f"{_W}style":
                    name = style.find(f"{_W}name")
                    key, value = style.get(f"{_W}styleId"), "" if name is None else name.get(f"{_W}val")
                    if style.get(f"{_W}type", "paragraph") == "paragraph":
                        names[key] = value
                        if style.get(f"{_W}default") in ("1", "true"):
                            default = value
                    style.clear()
    return names, default


def _text(paragraph) -> str:
    """A paragraph's runs, those of links included; tabs and breaks as characters."""
    out = []

    def run(node):
        for x in node:
            if x.tag == f"{_W}t":
                out.append(x.text or "")
            elif x.tag == f"{_W}tab":
                out.append("\t")
            elif x.tag in (f"{_W}br", f"{_W}cr"):
                out.append("\n" if x.get(f"{_W}type", "textWrapping") == "textWrapping" else "")
            elif x.tag == f"{_W}noBreakHyphen":
                out.append("-")

    for x in paragraph:
        if x.tag == f"{_W}r":
            run(x)
        elif x.tag == f"{_W}hyperlink":
            for r in x.findall(f"{_W}r"):
                run(r)
    return "".join(out)


def _cells(rows) -> Iterator[list[str]]:
    """Cell texts by grid column: a cell over several columns or rows stands in each."""
    above: dict[int, str] = {}
    for row in rows:
        at, out, now = 0, [], {}
        for cell in row.findall(f"{_W}tc"):
            p = cell.find(f"{_W}tcPr")
            span = merge = None
            if p is not None:
                span, merge = p.find(f"{_W}gridSpan"), p.find(f"{_W}vMerge")
            width = int(span.get(f"{_W}val")) if span is not None else 1
            text = "\n".join(_text(x) for x in cell.findall(f"{_W}p")).strip()
            if merge is not None and merge.get(f"{_W}val", "continue") == "continue":
                text = above.get(at, text)
            for k in range(at, at + width):
                now[k] = text
                out.append(text)
            at += width
        above = now
        yield out


def docx_blocks(content: bytes) -> Iterator[tuple[int, int, str, str | None, str | None, list[str] | None]]:
    """(block_pos, row_pos, kind, style, text, cells): a body's paragraphs and the rows of its tables, in order.

    Raises BrokenDocument where content is no DOCX file.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as package:
            names, default = _style_names(package)
            with package.open("word/document.xml") as file:
                depth, pos = [], 0
                for event, node in ElementTree.iterparse(file, events=("start", "end")):
                    if event == "start":
                        depth.append(node.tag)
                        continue
                    depth.pop()
                    if not depth or depth[-1] != f"{_W}body":
                        continue
                    if node.tag == f"{_W}p":
                        style = node.find(f"{_W}pPr/{_W}pStyle")
                        yield pos, 0, "paragraph", default if style is None else names.get(style.get(f"{_W}val"), default), _text(node), None
                    elif node.tag == f"{_W}tbl":
                        for n, cells in enumerate(_cells(node.findall(f"{_W}tr"))):
                            yield pos, n, "table", None, None, cells
                    pos += 1
                    node.clear()
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
        raise BrokenDocument(f"no DOCX file: {error}") from error


def page_reader(name: str):
    """The class that an option names, as package.module:Class, made."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)()


@dataclass
class Part(InputPartition):
    """Files of a folder by name, each with its pages from first to last (None: all of it)."""

    folder: str
    files: list[tuple[str, str, int | None, int | None]]


def _batched(rows):
    """Arrow batches of rows of SCHEMA: a row at a time would be converted value by value."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    fields = [(name, kinds[kind]) for name, kind in (x.split(" ") for x in SCHEMA.split(", "))]

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*held, strict=True), fields, strict=True)], names=[name for name, _ in fields])

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str)) + sum(map(len, row[7] or ()))
        if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


class DocumentReader(DataSourceReader):
    def __init__(self, options):
        path = options.get("path")
        if not path:
            raise ValueError("the documents source needs a path")
        self.store, self.folder = store_of(path)
        self.paged = {k.removeprefix("reader"): v for k, v in options.items() if k.startswith("reader.")}  # by .ext
        self.bytes, self.files, self.pages = (int(options.get(k, v)) for k, v in (("partbytes", PART_BYTES), ("partfiles", PART_FILES), ("rangepages", RANGE_PAGES)))
        self.broken = options.get("broken", "fail")
        self.tests: list = []

    def pushFilters(self, filters):
        for f in filters:
            if len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in ("source", "ext") and isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)):
                self.tests.append(f)
            else:
                yield f

    def _passes(self, source: str, ext: str) -> bool:
        value = {"source": source, "ext": ext}
        for f in self.tests:
            x = value[f.attribute[0]]
            if isinstance(f, EqualTo) and x != f.value or isinstance(f, In) and x not in f.value or isinstance(f, StringStartsWith) and not x.startswith(f.value) or isinstance(f, StringEndsWith) and not x.endswith(f.value):
                return False
        return True

    def _open(self, path: str) -> bytes:
        with self.store.open_input_file(path) as file:
            return file.read()

    def partitions(self):
        from pyarrow import fs

        out, held, size = [], [], 0
        for info in sorted(self.store.get_file_info(fs.FileSelector(self.folder)), key=lambda x: x.base_name):
            ext = os.path.splitext(info.base_name)[1].lower()
            if info.type != fs.FileType.File or ext not in (".docx", *self.paged) or not self._passes(info.base_name, ext):
                continue
            if ext in self.paged and info.size > self.bytes:  # only a large file is asked for its pages here
                n = page_reader(self.paged[ext]).count(self._open(info.path))
                out += [Part(self.folder, [(info.base_name, ext, k, min(k + self.pages - 1, n))]) for k in range(1, n + 1, self.pages)]
                continue
            if held and (size + info.size > self.bytes or len(held) >= self.files):
                out.append(Part(self.folder, held))
                held, size = [], 0
            held.append((info.base_name, ext, None, None))
            size += info.size
        return [*out, Part(self.folder, held)]

    def read(self, partition: Part):
        return _batched(self._rows(partition))

    def _rows(self, partition: Part):
        for source, ext, first, last in partition.files:
            content = self._open(f"{partition.folder.rstrip('/')}/{source}")
            try:
                if ext == ".docx":
                    for row in docx_blocks(content):
                        yield source, ext, *row, None, None, None, None
                else:
                    pages = page_reader(self.paged[ext])
                    last = pages.count(content) if last is None else last
                    for p in pages.pages(content, first or 1, last):
                        yield source, ext, p["page_num"], 0, "page", None, p.get("native_text"), None, p.get("ocr_text"), p.get("n_columns", 1), p.get("significant", False), p.get("item")
            except BrokenDocument as error:
                if self.broken == "fail":
                    raise BrokenDocument(f"{source}: {error}") from error


class Documents(DataSource):
    """Options: path; reader.<ext> (a page reader, e.g. reader.pdf), partBytes, partFiles, rangePages; broken = fail or skip."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocumentReader:
        return DocumentReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Register the source, and let the session push filters into Python sources."""
    spark.dataSource.register(Documents)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_documents(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Blocks and pages of a folder's documents. Conditions on source and ext decide which files are opened."""
    register(spark)
    reader = spark.read.format("documents")
    for k, v in options.items():
        reader = reader.option(k.replace("_", "."), v)
    return reader.load(folder)


def pages(documents: DataFrame) -> DataFrame:
    """Pages as the page loop takes them, from what read_documents gave."""
    return documents.where("kind = 'page'").selectExpr("source", "block_pos as page_num", "text as native_text", "ocr_text", "n_columns", "significant", "item")
