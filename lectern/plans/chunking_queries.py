"""Queries of the text and chunking operators, over manuals and question lists made from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..sources import documents, files
from .base import BOILERPLATE, MANUAL_SQL, Queries, chunks, heading_sql, manual, scratch, strip_sql, table, texts

Q = Queries()

_LINES = f"""{MANUAL_SQL},
lines AS (SELECT doc_id, source, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM manual)),
flags AS (SELECT *, CASE WHEN pos > 1 AND {heading_sql('line')} THEN 1 ELSE 0 END AS head FROM lines),
secs AS (SELECT doc_id, source, sec, string_agg(line, chr(10) ORDER BY pos) AS raw FROM (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM flags) GROUP BY ALL),
sections AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS section_pos, {strip_sql('raw')} AS section FROM secs WHERE {strip_sql('raw')} <> '')"""
_BARE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^[*\\-]+', ''), '^\\s+|\\s+$', '', 'g'), '^\"+|\"+$', '', 'g'), '^\\s+|\\s+$', '', 'g')"
_OWN = f"list_filter(list_transform(string_split({{0}}, chr(10)), lambda x: {_BARE}), lambda y: regexp_matches(y, '^\\d+\\.\\d+(?:\\.\\d+)?\\s+[A-Z][a-z].{{{{1,69}}}}$'))[1]"


def _own(x: str) -> str:
    return _OWN.format(x)


def _title(x: str, source: str = "source") -> str:
    bold = f"list_transform(regexp_extract_all({x}, '(?m)^\\*\\*([^*]{{3,80}})\\*\\*', 1), lambda b: regexp_replace(regexp_replace(regexp_replace(b, '^\\s+|\\s+$', '', 'g'), ':+$', ''), '^\\s+|\\s+$', '', 'g'))"
    lines = f"list_filter(list_transform(string_split({x}, chr(10)), lambda b: regexp_replace(b, '^\\s+|\\s+$', '', 'g')), lambda b: b <> '' AND NOT regexp_matches(b, '(?i)^<!--\\s*Page\\s+\\d+\\s*-->') AND lower(b) <> 'general office')"
    return f"""coalesce(list_transform(regexp_extract_all({x}, '(?m)^#{{1,4}}\\s+(.+)$', 1), lambda b: regexp_replace(b, '^\\s+|\\s+$', '', 'g'))[1], {_own(x)},
      list_filter({bold}, lambda b: regexp_matches(b, '\\d'))[1], {bold}[1], substr(regexp_replace({lines}[1], '^#+\\s*', ''), 1, 80), {source})"""


_PAGES = f"""{_LINES},
pg AS (SELECT *, list_filter(list_transform(regexp_split_to_array(section, '(?i)<!--\\s*Page\\s+\\d+\\s*-->'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS pages, {_own('section')} IS NOT NULL AND length(section) <= 6000 AS whole FROM sections),
parts AS (SELECT doc_id, source, section_pos, unnest(range(len(ps))) AS piece_pos, unnest(ps) AS part FROM (SELECT *, CASE WHEN NOT whole AND len(pages) > 1 THEN pages ELSE [section] END AS ps FROM pg))"""


@Q("SELECT doc_id, regexp_replace(concat('a', CASE WHEN doc_id % 2 = 0 THEN '<think x>' || text || '</think >' ELSE '<THINK>' || text END, 'tail'), '(?is)<think\\b[^>]*>.*?(?:</think\\s*>|\\z)', '', 'g') AS cleaned FROM documents")
def strip_thinking(spark, d):
    text = F.concat(F.lit("a"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<think x>"), "text", F.lit("</think >"))).otherwise(F.concat(F.lit("<THINK>"), "text")), F.lit("tail"))
    return texts(spark, d).select("doc_id", T.strip_thinking(text).alias("cleaned"))


def _halves():
    """A text's halves, which together are the whole of it."""
    return F.expr("substring(text, 1, length(text) div 2)"), F.expr("substring(text, length(text) div 2 + 1)")


@Q("""SELECT doc_id, concat('p <!-- Page 2 -->', regexp_replace(concat(substr(text, 1, length(text) // 2), '<think a>', substr(text, length(text) // 2 + 1), CASE WHEN doc_id % 2 = 0 THEN '</think>' ELSE '' END), '(?is)<think\\b[^>]*>.*?(?:</think\\s*>|\\z)', '', 'g'),
  '<!-- Page 3 -->', text) AS cleaned FROM documents""")
def strip_thinking_paged(spark, d):
    one, two = _halves()
    text = F.concat(F.lit("p <think>secret<!-- Page 2 -->"), one, F.lit("<think a>"), two, F.when(F.col("doc_id") % 2 == 0, F.lit("</think>")).otherwise(F.lit("")), F.lit("<!-- Page 3 -->"), "text")
    return texts(spark, d).select("doc_id", T.strip_thinking_paged(text).alias("cleaned"))


@Q(f"WITH {_LINES} SELECT doc_id, section_pos, section FROM sections")
def heading_split(spark, d):
    return manual(spark, d).select("doc_id", F.posexplode(C.nonblank(C.heading_split("text", BOILERPLATE))).alias("section_pos", "section")).withColumn("section_pos", F.col("section_pos").cast("long"))


@Q(f"""WITH {_LINES} SELECT doc_id, pos, line FROM lines WHERE regexp_matches(line, '^[A-Z][A-Z0-9 &/()'',.\\-]{{7,}}$') AND lower(line) <> 'general office'
  AND len(list_filter(regexp_split_to_array(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '\\s+'), lambda t: regexp_matches(t, '^[A-Z]{{3,}}$'))) >= 2""")
def form_title_detect(spark, d):
    lines = manual(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(T.is_form_title("line", BOILERPLATE)).select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "line")


def _faq(spark, d):
    """Question lists of whole texts: the first half asks and the second answers, then the other way round."""
    one, two = _halves()
    part = lambda k, ask, answer: F.concat(F.lit(f"\n\n{k}. What is "), ask, F.lit(" then?\n"), answer)
    docs = texts(spark, d).withColumn("text", F.regexp_replace("text", r"[?\n]", " "))
    return docs.select("doc_id", "source", F.concat(F.lit("Intro"), part(1, one, two), F.when(F.col("doc_id") % 2 == 0, part(2, two, one)).otherwise(F.lit("")), F.lit("\n3. no question here\nand more"), F.lit("\n4. Last one of these?\nyes")).alias("text"))


_FAQ = r"""src AS (SELECT doc_id, source, regexp_replace(text, '[?\n]', ' ', 'g') AS t FROM documents),
half AS (SELECT doc_id, source, substr(t, 1, length(t) // 2) AS one, substr(t, length(t) // 2 + 1) AS two FROM src),
faq AS (SELECT doc_id, source, concat('Intro', chr(10), chr(10), '1. What is ', one, ' then?', chr(10), two,
  CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), chr(10), '2. What is ', two, ' then?', chr(10), one) ELSE '' END,
  chr(10), '3. no question here', chr(10), 'and more', chr(10), '4. Last one of these?', chr(10), 'yes') AS text FROM half),
fl AS (SELECT doc_id, source, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM faq)),
ff AS (SELECT *, CASE WHEN regexp_matches(line, '^\s*\d+\.\s+.+\?\s*$') THEN 1 ELSE 0 END AS q FROM fl),
fs AS (SELECT doc_id, source, blk, string_agg(line, chr(10) ORDER BY pos) AS raw FROM (SELECT *, sum(q) OVER (PARTITION BY doc_id ORDER BY pos) AS blk FROM ff) GROUP BY ALL),
blocks AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY blk) - 1 AS block_pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS block FROM fs WHERE regexp_replace(raw, '^\s+|\s+$', '', 'g') <> '')"""


@Q(f"WITH {_FAQ} SELECT doc_id, block_pos, block, nullif(regexp_replace(regexp_replace(regexp_extract(block, '(?ms)^\\s*\\d+\\.\\s+(.+?\\?)', 1), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '') AS question FROM blocks")
def faq_split(spark, d):
    out = _faq(spark, d).select("doc_id", F.posexplode(C.faq_split("text")).alias("block_pos", "block"))
    return out.select("doc_id", F.col("block_pos").cast("long").alias("block_pos"), "block", T.faq_question("block").alias("question"))


@Q(f"""WITH {_FAQ}, pv AS (SELECT *, CASE WHEN q = 1 AND lag(line) OVER (PARTITION BY doc_id ORDER BY pos) = '' THEN 2 ELSE q END AS n FROM ff)
SELECT doc_id, sum(n) >= 3 AS looks_like_faq FROM pv GROUP BY doc_id""")
def faq_detect(spark, d):
    return _faq(spark, d).select("doc_id", T.is_faq("text").alias("looks_like_faq"))


@Q(f"WITH {_PAGES} SELECT doc_id, section_pos, piece_pos, part FROM parts")
def page_marker_refine(spark, d):
    sections = manual(spark, d).select("doc_id", F.posexplode(C.nonblank(C.heading_split("text", BOILERPLATE))).alias("section_pos", "section"))
    out = sections.select("doc_id", "section_pos", F.posexplode(C.page_refine(F.col("section"))).alias("piece_pos", "part"))
    return out.withColumns({c: F.col(c).cast("long") for c in ("section_pos", "piece_pos")})


@Q("""WITH c AS (SELECT doc_id, text, substr(split_part(text, chr(10), 1), 1, 80) AS title FROM documents),
s AS (SELECT *, unnest(CASE WHEN length(text) > 6000 THEN range(0, length(text), 5700) ELSE [0] END) AS st FROM c)
SELECT doc_id, CAST(st // 5700 AS INT) AS slice_pos, CASE WHEN length(text) <= 6000 THEN text WHEN st = 0 THEN substr(text, 1, 6000) ELSE concat('[continued — ', title, ']', chr(10), chr(10), substr(text, st + 1, 6000)) END AS piece FROM s""")
def overlap_slices(spark, d):
    return C.slices(chunks(spark, d)).select(F.col("chunk_id").alias("doc_id"), "slice_pos", "piece")


@Q(f"WITH {_PAGES} SELECT doc_id, section_pos, piece_pos FROM parts WHERE length(regexp_replace(regexp_extract(part, '(?s)^[^\\n]*\\n(.*)$', 1), '^\\s+|\\s+$', '', 'g')) >= 10")
def low_content_filter(spark, d):
    sections = manual(spark, d).select("doc_id", F.posexplode(C.nonblank(C.heading_split("text", BOILERPLATE))).alias("section_pos", "section"))
    out = sections.select("doc_id", "section_pos", F.posexplode(C.page_refine(F.col("section"))).alias("piece_pos", "part")).where(T.has_body("part"))
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("section_pos", "piece_pos")])


@Q(f"WITH {_PAGES} SELECT doc_id, section_pos, piece_pos, {_title('part')} AS title FROM parts")
def chunk_titles(spark, d):
    sections = manual(spark, d).select("doc_id", "source", F.posexplode(C.nonblank(C.heading_split("text", BOILERPLATE))).alias("section_pos", "section"))
    out = sections.select("doc_id", "source", "section_pos", F.posexplode(C.page_refine(F.col("section"))).alias("piece_pos", "part"))
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("section_pos", "piece_pos")], T.chunk_title("part", "source", BOILERPLATE).alias("title"))


@Q(f"""WITH {_PAGES}, tt AS (SELECT *, {_title('part')} AS t0 FROM parts),
s AS (SELECT *, unnest(CASE WHEN length(part) > 6000 THEN range(0, length(part), 5700) ELSE [0] END) AS st FROM tt),
p AS (SELECT *, CASE WHEN length(part) <= 6000 THEN part WHEN st = 0 THEN substr(part, 1, 6000) ELSE concat('[continued — ', t0, ']', chr(10), chr(10), substr(part, st + 1, 6000)) END AS piece FROM s)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_pos, piece_pos, st) - 1 AS chunk_id, t0 AS title, piece AS text, source FROM p
WHERE length(regexp_replace(regexp_extract({strip_sql('piece')}, '(?s)^[^\\n]*\\n(.*)$', 1), '^\\s+|\\s+$', '', 'g')) >= 10""")
def chunk_pipeline(spark, d):
    return C.chunk(manual(spark, d), boilerplate=BOILERPLATE).select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "title", "text", "source")


@Q("SELECT DISTINCT source FROM documents")
def distinct_sources(spark, d):
    return table(spark, d, "documents").select("source").distinct()


def _write_docx(folder: str):
    """Write a DOCX file per row (doc_id, text), a paragraph a line."""

    def run(batches):
        import io
        import zipfile
        from xml.sax.saxutils import escape

        import pandas as pd

        store, path = documents.store_of(folder)
        store.create_dir(path, recursive=True)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as package:
                    package.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{lines}</w:body></w:document>')
                with store.open_output_stream(f"{path}/{doc_id}.docx") as file:
                    file.write(out.getvalue())
            yield pd.DataFrame({"n": [len(batch)]})

    return run


@Q()
def docx_documents(spark, d):
    """Documents written as DOCX files, a paragraph a line, and read back through the documents source. Writes the files."""
    folder = scratch(spark, "docx")
    text = F.regexp_replace("text", "[\\x00-\\x08\\x0B-\\x1F]", "")
    texts(spark, d).where("text is not null").select("doc_id", text.alias("text")).mapInPandas(_write_docx(folder), "n long").agg(F.sum("n")).collect()
    return files.docx_text(documents.read_documents(spark, folder).where("ext = '.docx'"))
