"""Queries of the ingest operators, over pages, events and customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest as I
from ..operators import page_loop
from ..operators import transcription as X
from ..sources import checkpoints, writers
from ..sources.content_store import ContentStore
from ..streaming import checkpoint_sink
from ..streaming import page_loop as stream_loop
from .base import Queries, scratch, setting, table

Q = Queries()

#: A user's events are a source's pages: every event is a page, numbered by id.
_PAGES = "pg AS (SELECT concat('u', user_id) AS source, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS page_num, event_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS text, CAST(event_id % 3 + 1 AS INT) AS tier FROM events)"


def _pages(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = F.col("event_id")
    return table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), n.alias("page_num"), e, F.when(e % 7 == 0, "").otherwise(F.col("event_type")).alias("text"), (e % 3 + 1).cast("int").alias("tier"))


@Q(f"WITH {_PAGES} SELECT source, page_num, CASE WHEN event_id % 2 = 0 THEN tier END AS done_tier, event_id % 2 <> 0 AS todo FROM pg")
def resume_pages(spark, d):
    pages = _pages(spark, d)
    return I.resume(pages.select("source", "page_num"), pages.where("event_id % 2 = 0")).select("source", "page_num", "done_tier", "todo")


@Q(f"WITH {_PAGES} SELECT source, page_num, 'redo' AS kind FROM pg WHERE event_id % 11 = 0 UNION ALL SELECT source, page_num, 'todo' FROM pg WHERE NOT (event_id % 2 = 0 AND text <> '')")
def redo_semi_done_anti(spark, d):
    pages = _pages(spark, d)
    keys = pages.select("source", "page_num")
    redo = I.select_pages(keys, pages, pages.where("event_id % 11 = 0").select("source", "page_num")).withColumn("kind", F.lit("redo"))
    return redo.unionByName(I.select_pages(keys, pages.where("event_id % 2 = 0")).withColumn("kind", F.lit("todo")))


@Q(f"WITH {_PAGES} SELECT source, page_num, tier = 3 OR page_num % 10 = 0 AS checkpoint FROM pg")
def checkpoint_cadence(spark, d):
    return _pages(spark, d).select("source", "page_num", I.is_checkpoint(F.col("tier"), F.col("page_num")).alias("checkpoint"))


@Q(f"WITH {_PAGES} SELECT source, page_num, max(CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY page_num) = 1 AS paused FROM pg")
def quota_pause(spark, d):
    return I.quota(_pages(spark, d), F.col("event_id") % 23 == 0).select("source", "page_num", "paused")


@Q(f"""WITH {_PAGES}, w AS (SELECT *, tier >= 2 AND event_id % 5 <> 0 AS ok FROM pg)
SELECT source, page_num, ok AND coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 5 AS vision FROM w""")
def vision_budget(spark, d):
    return I.vision_budget(_pages(spark, d), F.col("tier") >= 2, F.col("event_id") % 5 != 0, 5).select("source", "page_num", "vision")


@Q(f"WITH {_PAGES} SELECT source, count(*) AS total_pages, count(*) FILTER (WHERE tier = 3) AS vision_pages_used, count(*) FILTER (WHERE tier = 2) AS ocr_pages, count(*) FILTER (WHERE tier = 1) AS native_text_pages FROM pg GROUP BY 1")
def run_stats(spark, d):
    return I.run_stats(_pages(spark, d))


@Q(f"""WITH {_PAGES} SELECT source, concat(count(*), ' pages (', count(*) FILTER (WHERE tier = 1), ' text layer, ', count(*) FILTER (WHERE tier = 2), ' local OCR, ', count(*) FILTER (WHERE tier = 3), ' vision-transcribed)') AS message FROM pg GROUP BY 1""")
def commit_messages(spark, d):
    return writers.commit_message(I.run_stats(_pages(spark, d))).select("source", "message")


@Q(f"""WITH {_PAGES}, k AS (SELECT source, page_num + page_num // 3 AS page_num, text FROM pg), n AS (SELECT source, unnest(range(1, max(page_num) + 1)) AS page_num FROM k GROUP BY source)
SELECT source, string_agg(concat('<!-- Page ', page_num, ' -->', chr(10), chr(10), coalesce(text, '')), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY page_num) AS markdown FROM n LEFT JOIN k USING (source, page_num) GROUP BY 1""")
def page_markdown_assemble(spark, d):
    """Every third page number is missing, and comes out empty."""
    return I.page_markdown(_pages(spark, d).withColumn("page_num", F.expr("page_num + page_num div 3").cast("int")))


#: Pages of a document with what extraction, OCR and a vision call would give; a checkpoint of an earlier run.
_LOOP = f"""{_PAGES},
p AS (SELECT source, page_num, CASE WHEN event_id % 3 = 0 THEN concat(' ', event_id, ' words of a page with native text ') ELSE 'short' END AS native, CASE WHEN event_id % 13 = 0 THEN '' ELSE concat('ocr ', event_id) END AS ocr,
  event_id % 3 AS n_columns, event_id % 5 = 0 AS significant, CASE WHEN event_id % 17 = 0 THEN '' ELSE concat('seen ', event_id) END AS seen, event_id % 41 = 0 AS exhausted, event_id % 7 = 0 AND page_num < 30 AS resumed, CAST(event_id % 3 + 1 AS INT) AS done_tier FROM pg),
w AS (SELECT *, trim(native) AS nat, NOT resumed AND (significant OR (length(trim(native)) < 20 AND n_columns >= 2)) AS wants FROM p),
u AS (SELECT *, wants AND coalesce(sum(CASE WHEN resumed THEN CAST(done_tier = 3 AS INT) ELSE CAST(wants AND seen <> '' AND NOT exhausted AS INT) END) OVER (PARTITION BY source ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 5 AS tried FROM w),
st AS (SELECT *, coalesce(page_num >= min(page_num) FILTER (WHERE tried AND exhausted) OVER (PARTITION BY source), false) AS late, count(*) OVER (PARTITION BY source) AS total FROM u),
done AS (SELECT *, CASE WHEN total > 60 THEN 'refused' WHEN resumed THEN 'resumed' WHEN late AND {{pause}} THEN 'paused' ELSE 'done' END AS status FROM st),
tr AS (SELECT *, CAST(CASE WHEN status IN ('refused', 'paused') THEN NULL WHEN status = 'resumed' THEN done_tier WHEN tried AND NOT late AND seen <> '' THEN 3 WHEN NOT significant AND length(nat) >= 20 THEN 1 ELSE 2 END AS INT) AS tier FROM done),
tx AS (SELECT *, CASE WHEN status = 'resumed' THEN concat('old ', page_num) WHEN tier = 3 THEN seen WHEN tier = 1 THEN nat WHEN tier = 2 THEN coalesce(nullif(ocr, ''), nat) END AS text FROM tr)"""


def _loop_tables(spark, d):
    e = F.col("event_id")
    s = e.cast("string")
    raw = _pages(spark, d)
    pages = raw.select(
        "source", "page_num", F.when(e % 3 == 0, F.concat(F.lit(" "), s, F.lit(" words of a page with native text "))).otherwise(F.lit("short")).alias("native_text"), F.when(e % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("ocr "), s)).alias("ocr_text"),
        (e % 3).alias("n_columns"), (e % 5 == 0).alias("significant"), F.when((e % 17 == 0) | (e % 41 == 0), F.lit("")).otherwise(F.concat(F.lit("seen "), s)).alias("vision_text"), (e % 41 == 0).alias("exhausted"),
    )
    old = raw.where((e % 7 == 0) & (F.col("page_num") < 30)).select("source", "page_num", F.concat(F.lit("old "), F.col("page_num").cast("string")).alias("text"), (e % 3 + 1).cast("int").alias("tier"))
    return pages, old


def _loop(spark, d, degrade):
    return X.transcribe(*_loop_tables(spark, d), 5, 60, degrade)


def _answer(key: str, item: str) -> str:
    """Stands in for a hosted model: refuses one item."""
    if item == "refuse":
        raise X.RateLimited
    return item


def _asking(spark, d):
    """Pages that have to be called for, and the checkpoint."""
    pages, old = _loop_tables(spark, d)
    item = F.when(F.col("exhausted"), "refuse").otherwise(F.col("vision_text"))
    return pages.withColumn("item", item).drop("vision_text", "exhausted"), old


@Q()
def page_loop_calls(spark, d):
    """The page loop with its calls made in turn; the rows are those of page_loop_pause. Writes its results."""
    pages, old = _asking(spark, d)
    return page_loop.transcribe_calling(pages, old, _answer, ["key"], scratch(spark, "calls"), page_loop.Limits(5, 60), attempts=1).drop("called")


@Q()
def page_loop_stream(spark, d):
    """The same over a stream: pages arrive in three files, the later ones first. Writes its results."""
    pages, old = _asking(spark, d)
    folder = scratch(spark, "loop")
    total = pages.groupBy("source").agg(F.count("*").cast("int").alias("total_pages"))
    pages.join(total, "source").withColumn("part", 2 - F.col("page_num") % 3).write.partitionBy("part").parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").drop("part").schema
    with setting(spark, *stream_loop.STATE_STORE):
        arriving = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 3).parquet(f"{folder}/in")
        done = stream_loop.transcribe_stream(arriving, old, _answer, ["key"], page_loop.Limits(5, 60), attempts=1, timer=False)
        done.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(page_loop.RESULT).parquet(f"{folder}/out").drop("called")


_LOOP_OUT = "SELECT source, page_num, status, tier, text, status = 'done' AND (tier = 3 OR page_num % 10 = 0) AS checkpoint FROM tx"


@Q(f"WITH {_LOOP.format(pause='true')} {_LOOP_OUT}")
def page_loop_pause(spark, d):
    return _loop(spark, d, False)


@Q(f"WITH {_LOOP.format(pause='false')} {_LOOP_OUT}")
def page_loop_degrade(spark, d):
    return _loop(spark, d, True)


_OUTCOME = """sp AS (SELECT *, coalesce(page_num < min(page_num) FILTER (WHERE status = 'paused') OVER (PARTITION BY source), true) AS before FROM tx),
oc AS (SELECT source, count(*) AS total_pages, count(*) FILTER (WHERE status IN ('done', 'resumed')) AS pages_done, count(*) FILTER (WHERE tier = 3 AND before) AS vision_pages_used, count(*) FILTER (WHERE tier = 2 AND before) AS ocr_pages,
  count(*) FILTER (WHERE tier = 1 AND before) AS native_text_pages, count(*) FILTER (WHERE status = 'resumed') > 0 AS resumed,
  CASE WHEN bool_or(status = 'refused') THEN 'refused' WHEN bool_or(status = 'paused') THEN 'paused' WHEN max(length(trim(coalesce(text, '')))) = 0 THEN 'blank' ELSE 'done' END AS state,
  string_agg(concat('<!-- Page ', page_num, ' -->', chr(10), chr(10), text), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY page_num) AS md FROM sp GROUP BY source)"""


@Q(f"""WITH {_LOOP.format(pause='true')}, {_OUTCOME}
SELECT source, state, pages_done, total_pages, vision_pages_used, ocr_pages, native_text_pages, resumed, CASE WHEN state = 'done' THEN md END AS markdown FROM oc""")
def transcription_outcomes(spark, d):
    return X.outcomes(_loop(spark, d, False))


@Q(f"""WITH {_LOOP.format(pause='true')}, {_OUTCOME}, fl AS (SELECT *, CAST(substr(source, 2) AS BIGINT) AS id FROM oc),
f AS (SELECT *, concat('doc ', id % 9, CASE id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.pdf' ELSE '.PDF' END) AS name, id % 11 = 0 AS is_blank, id % 3 > 0 AS pdf FROM fl),
g AS (SELECT *, CASE WHEN pdf THEN concat('doc ', id % 9, '_transcribed.md') ELSE name END AS safe, NOT is_blank AND (NOT pdf OR state = 'done') AS ok FROM f)
SELECT id AS file_id, ok, NOT is_blank AND pdf AND state = 'paused' AS needs_decision, CASE WHEN ok THEN CASE WHEN id % 9 = 4 AND pdf THEN 'doc 4_transcribed_1700000000.md' ELSE safe END END AS final_name,
  CASE WHEN ok THEN CASE WHEN pdf THEN md ELSE source END END AS body, CASE WHEN NOT is_blank AND pdf THEN CASE state WHEN 'paused' THEN 'keep' WHEN 'done' THEN 'delete' ELSE 'none' END ELSE 'none' END AS checkpoint_action,
  CASE WHEN is_blank THEN 'File is empty.' WHEN NOT pdf THEN '' WHEN state = 'refused' THEN concat('too many pages: ', total_pages) WHEN state = 'paused' THEN concat('paused after ', pages_done, ' of ', total_pages, ' pages')
    WHEN state = 'done' THEN concat(total_pages, ' pages: ', native_text_pages, ' native, ', ocr_pages, ' OCR, ', vision_pages_used, ' vision', CASE WHEN resumed THEN ', resumed' ELSE '' END) ELSE 'no readable text' END AS message FROM g""")
def upload_pipeline(spark, d):
    outcome = X.outcomes(_loop(spark, d, False))
    n = F.substring("source", 2, 20).cast("long")
    name = F.concat(F.lit("doc "), (n % 9).cast("string"), F.when(n % 3 == 0, ".md").when(n % 3 == 1, ".pdf").otherwise(".PDF"))
    files = outcome.select(n.alias("file_id"), name.alias("name"), F.lit(1000).cast("long").alias("n_bytes"), (n % 11 == 0).alias("is_blank"), F.col("source").alias("text"))
    there = spark.createDataFrame([("doc 4_transcribed.md",)], "name string")
    return X.upload(files, outcome.withColumn("source", n.cast("string")), there, 1_700_000_000)


@Q(f"WITH {_PAGES}, t AS (SELECT source, count(*) - 2 AS n FROM pg GROUP BY 1) SELECT source, page_num FROM pg JOIN t USING (source) WHERE page_num > n")
def invalid_redo_pages(spark, d):
    """Pages to do again that the document does not have: it lost its last two."""
    pages = _pages(spark, d).select("source", "page_num")
    return X.invalid_pages(pages, pages.groupBy("source").agg((F.count("*") - 2).alias("total_pages")))


@Q(f"WITH {_PAGES} SELECT source, page_num, text FROM pg")
def json_checkpoint_roundtrip(spark, d):
    return checkpoints.read_pages(checkpoints.write_pages(_pages(spark, d), "source"), "json").select("source", "page_num", "text")


_NAMES = """f AS (SELECT page_id, concat('dir', page_id % 3, '/', CASE page_id % 5 WHEN 0 THEN 'a b?' WHEN 1 THEN 'Report ' WHEN 2 THEN 'x_y' WHEN 3 THEN '*' ELSE '' END, CASE WHEN page_id % 5 = 4 THEN '' ELSE concat(page_id % 20, CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.md' WHEN 2 THEN '.exe' ELSE '.txt' END) END) AS name,
  length(html) * CASE WHEN page_id % 6 = 0 THEN 20000 ELSE 1 END AS n_bytes, page_id % 10 = 1 AS is_blank, html FROM pages)"""


def _files(spark, d):
    n = F.col("page_id")
    s = lambda x: x.cast("string")
    base = F.when(n % 5 == 0, "a b?").when(n % 5 == 1, "Report ").when(n % 5 == 2, "x_y").when(n % 5 == 3, "*").otherwise("")
    ext = F.when(n % 4 == 0, ".PDF").when(n % 4 == 1, ".md").when(n % 4 == 2, ".exe").otherwise(".txt")
    name = F.concat(F.lit("dir"), s(n % 3), F.lit("/"), base, F.when(n % 5 == 4, "").otherwise(F.concat(s(n % 20), ext)))
    return table(spark, d, "pages").select("page_id", name.alias("name"), (F.length("html") * F.when(n % 6 == 0, 20000).otherwise(1)).cast("long").alias("n_bytes"), (n % 10 == 1).alias("is_blank"), "html")


_EXT = "lower(regexp_extract(regexp_extract({0}, '[^/]*$'), '^\\.*[^.].*(\\.[^.]*)$', 1))"
_SAFE = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(name, '[^/]*$'), '^\\s+|\\s+$', '', 'g'), '[^A-Za-z0-9 ._-]', '_', 'g'), '^\\s+|\\s+$', '', 'g'), ''), 'upload')"


@Q(f"WITH {_NAMES} SELECT page_id, {_SAFE} AS safe_name FROM f")
def safe_filename(spark, d):
    return _files(spark, d).select("page_id", T.safe_filename("name").alias("safe_name"))


@Q(f"""WITH {_NAMES}, e AS (SELECT *, {_EXT.format('name')} AS ext FROM f), l AS (SELECT *, CASE WHEN ext = '.pdf' THEN 26214400 WHEN ext IN ('.md', '.txt', '.docx') THEN 5242880 END AS lim FROM e),
m AS (SELECT *, CASE WHEN lim IS NULL THEN concat('Unsupported file type ''', ext, '''. Only .md, .txt, .docx, .pdf are accepted here.')
  WHEN n_bytes > lim THEN concat('File too large (', printf('%.1f', n_bytes / 1e6), ' MB). Limit for ', ext, ' is ', printf('%.0f', lim / 1e6), ' MB.') WHEN is_blank THEN 'File is empty.' END AS msg FROM l)
SELECT page_id, msg IS NULL AS ok, coalesce(msg, '') AS message FROM m""")
def upload_validate(spark, d):
    return I.validate_upload(_files(spark, d)).select("page_id", "ok", "message")


@Q(f"""WITH {_NAMES}, s AS (SELECT page_id, {_SAFE} AS name FROM f), x AS (SELECT DISTINCT name FROM s WHERE page_id % 2 = 0)
SELECT page_id, CASE WHEN x.name IS NULL THEN s.name WHEN {_EXT.format('s.name')} = '' THEN concat(s.name, '_1700000000') ELSE concat(regexp_replace(s.name, '\\.[^.]*$', ''), '_1700000000', {_EXT.format('s.name')}) END AS final_name FROM s LEFT JOIN x ON s.name = x.name""")
def name_collision(spark, d):
    names = _files(spark, d).select("page_id", T.safe_filename("name").alias("name"))
    return I.final_names(names, names.where("page_id % 2 = 0"), 1_700_000_000).select("page_id", "final_name")


@Q("SELECT page_id, substr(sha256(html), 1, 16) AS content_key FROM pages")
def content_key(spark, d):
    return table(spark, d, "pages").select("page_id", T.content_key(F.col("html").cast("binary")).alias("content_key"))


@Q("SELECT page_id, to_base64(encode(url)) AS encoded, url AS decoded FROM pages")
def base64_roundtrip(spark, d):
    encoded = table(spark, d, "pages").select("page_id", T.base64_text("url").alias("encoded"))
    return encoded.withColumn("decoded", T.text_of_base64("encoded"))


@Q("SELECT strftime(max(ts), '%Y-%m-%d %H:%M UTC') AS updated FROM events")
def freshness(spark, d):
    return table(spark, d, "events").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm 'UTC'").alias("updated"))


@Q("SELECT event_id, contains(lower(concat(event_type, CASE event_id % 3 WHEN 0 THEN ' Error 429' WHEN 1 THEN ' RATE_LIMIT hit' ELSE ' ok' END)), '429') OR contains(lower(concat(event_type, CASE event_id % 3 WHEN 0 THEN ' Error 429' WHEN 1 THEN ' RATE_LIMIT hit' ELSE ' ok' END)), 'rate_limit') AS limited FROM events")
def rate_limit_predicate(spark, d):
    n = F.col("event_id")
    message = F.concat("event_type", F.when(n % 3 == 0, " Error 429").when(n % 3 == 1, " RATE_LIMIT hit").otherwise(" ok"))
    return table(spark, d, "events").select("event_id", T.is_rate_limit(message).alias("limited"))


@Q("SELECT event_id, concat_ws(',', CASE WHEN event_id % 2 = 0 THEN 'Retry-After' END, 'x-ratelimit-left') AS headers FROM events")
def header_filter(spark, d):
    n = F.col("event_id")
    headers = F.map_concat(F.create_map(F.lit("x-ratelimit-left"), n.cast("string"), F.lit("content-type"), F.lit("json")), F.when(n % 2 == 0, F.create_map(F.lit("Retry-After"), F.lit("3"))).otherwise(F.create_map().cast("map<string,string>")))
    return table(spark, d, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(T.quota_headers(headers))), ",").alias("headers"))


@Q("SELECT event_id, concat_ws('|', 'k1', CASE WHEN event_id % 2 = 0 THEN 'k2' END) AS parts FROM events")
def secret_list(spark, d):
    raw = F.concat(F.lit(" k1 ,, "), F.when(F.col("event_id") % 2 == 0, " k2").otherwise(" "))
    return table(spark, d, "events").select("event_id", F.array_join(T.secret_list(raw), "|").alias("parts"))


@Q(f"WITH {_PAGES} SELECT source, count(*) FILTER (WHERE text <> '') AS done, count(*) FILTER (WHERE page_num NOT BETWEEN 1 AND 50) AS beyond, count(*) > 150 AS over_cap FROM pg GROUP BY 1")
def page_caps(spark, d):
    return I.page_caps(_pages(spark, d), 50)


@Q()
def content_store(spark, d):
    """The manifest of a store in which all pages were put, a third updated, some on a stale digest in vain, and some deleted. Writes the store."""
    store = ContentStore(spark, scratch(spark, "store"))
    pages = table(spark, d, "pages").select("page_id", F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("path"), F.col("html").cast("binary").alias("content"))
    store.put("main", pages.select("path", "content", F.lit(None).cast("string").alias("expected")))
    n, changed = F.col("page_id"), F.concat("content", F.lit("!").cast("binary"))
    known = F.when(n % 3 == 0, F.sha2("content", 256)).otherwise(F.lit("stale"))
    store.put("main", pages.where((n % 3 == 0) | (n % 5 == 1)).select("path", changed.alias("content"), known.alias("expected")))
    last = F.when(n % 3 == 0, F.sha2(changed, 256)).otherwise(F.sha2("content", 256))
    store.delete("main", pages.where(n % 7 == 0).select("path", last.alias("expected")))
    return store.manifest("main")


@Q()
def checkpoint_lifecycle(spark, d):
    """Pages saved by a stream in two batches; sources of an even number of pages are done and lose their checkpoints, the others are resumed. Writes the store."""
    folder = scratch(spark, "checkpoints")
    kept = checkpoint_sink.Checkpoints(ContentStore(spark, f"{folder}/store"))
    pages = _pages(spark, d).select(F.col("source").alias("key"), "page_num", "text", "tier", F.col("event_id").cast("long").alias("seq"))
    pages.repartition(2, "page_num").write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    kept.sink(arriving, "pages", f"{folder}/log").awaitTermination()
    counts = pages.groupBy("key").agg(F.count("*").alias("n"))
    kept.finish(counts.select("key", F.when(F.col("n") % 2 == 0, "done").otherwise("paused").alias("state")))
    return kept.resume(counts.select("key")).select("key", "page_num", "text", "tier")
