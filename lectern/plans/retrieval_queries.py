"""Queries of the retrieval operators, over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import encoding, evaluation, scoring, segments
from ..operators import retrieval as R
from .base import CHUNKS_SQL, Queries, chunks, questions, scratch, table

Q = Queries()
SOURCE = "src1"


def _indexed(spark, d):
    return R.indexed_text(chunks(spark, d))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def _query_vectors(spark, d):
    return questions(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_BM25 = f"""{CHUNKS_SQL},
toks AS (SELECT chunk_id, unnest(regexp_extract_all(lower(concat(title, chr(10), chr(10), text)), '[a-z0-9]+')) AS term FROM chunks),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM toks GROUP BY ALL),
dl AS (SELECT chunk_id, len(regexp_extract_all(lower(concat(title, chr(10), chr(10), text)), '[a-z0-9]+')) AS dl FROM chunks),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, corpus GROUP BY term, n),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
lex0 AS (SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
         FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (chunk_id), corpus GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lex0) WHERE rank <= 40 AND score > 0)"""
_DENSE = """
dense0 AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
           FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id, embeddings v),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dense0) WHERE rank <= 40)"""
_CAND = """
cand AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS cand_pos FROM (
  SELECT query_id, chunk_id, min(leg * 1000 + rank) AS place FROM (SELECT query_id, chunk_id, 0 AS leg, rank FROM dense UNION ALL SELECT query_id, chunk_id, 1, rank FROM lex) GROUP BY ALL))"""
_SCORED = """
scored AS (SELECT c.query_id, c.chunk_id, cand_pos, k.source, k.title, k.text, b.text AS question, round(1 / (1 + exp(-(8.0 * len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(k.text), '[a-z0-9]+')))) / greatest(len(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+'))), 1) - 5.0))), 6) AS raw
           FROM cand c JOIN chunks k USING (chunk_id) JOIN benchmark b ON b.item_id = c.query_id)"""
_BOOST = """
lead AS (SELECT *, source = 'src1' AS verified, first_value(source = 'src1' AND raw >= 0.15) OVER (PARTITION BY query_id ORDER BY raw DESC, cand_pos) AS up FROM scored),
boosted AS (SELECT *, CASE WHEN up AND verified THEN least(1.0, raw + 0.1) ELSE raw END AS score FROM lead),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_pos) AS rank,
             first_value(verified AND score >= 0.2) OVER (PARTITION BY query_id ORDER BY score DESC, cand_pos) AS alone FROM boosted),
collapsed AS (SELECT * FROM ranked WHERE rank = 1 OR NOT alone)"""


@Q("SELECT doc_id AS chunk_id, pos, term FROM (SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents))")
def tokenize_documents(spark, d):
    return chunks(spark, d).select("chunk_id", F.posexplode(T.tokens("text")).alias("pos", "term")).select("chunk_id", F.col("pos").cast("long").alias("pos"), "term")


@Q(f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_term_stats(spark, d):
    return R.term_statistics(R.vocabulary(_indexed(spark, d))).select("term", "df", F.round("idf", 6).alias("idf"))


@Q(f"WITH {_BM25} SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM lex")
def bm25_topk(spark, d):
    return R.bm25(questions(spark, d), _indexed(spark, d))


@Q(f"WITH {_DENSE} SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM dense")
def cosine_topk(spark, d):
    return R.cosine(_query_vectors(spark, d), _vectors(spark, d))


def _cand(spark, d):
    return R.candidates(R.cosine(_query_vectors(spark, d), _vectors(spark, d)), R.bm25(questions(spark, d), _indexed(spark, d)))


@Q(f"WITH {_BM25}, {_DENSE}, {_CAND} SELECT query_id, chunk_id, CAST(cand_pos AS INT) AS cand_pos FROM cand")
def candidate_union(spark, d):
    return _cand(spark, d)


def _scored(spark, d):
    pairs = _cand(spark, d).join(questions(spark, d).withColumnRenamed("text", "question"), "query_id").join(chunks(spark, d), "chunk_id")
    return pairs.withColumn("raw", F.round(T.sigmoid(R.overlap_logit("question", "text")), 6))


@Q(f"WITH {_BM25}, {_DENSE}, {_CAND}, {_SCORED} SELECT query_id, chunk_id, raw FROM scored")
def rerank_scores(spark, d):
    return _scored(spark, d).select("query_id", "chunk_id", "raw")


@Q(f"WITH {_BM25}, {_DENSE}, {_CAND}, {_SCORED}, {_BOOST} SELECT query_id, chunk_id, verified, round(score, 6) AS score FROM boosted")
def verified_boost(spark, d):
    return R.boost(_scored(spark, d), F.col("source") == SOURCE).select("query_id", "chunk_id", "verified", F.round("score", 6).alias("score"))


@Q(f"WITH {_BM25}, {_DENSE}, {_CAND}, {_SCORED}, {_BOOST} SELECT query_id, chunk_id, CAST(rank AS INT) AS rank FROM collapsed")
def verified_collapse(spark, d):
    return R.collapse(R.boost(_scored(spark, d), F.col("source") == SOURCE)).select("query_id", "chunk_id", "rank")


@Q(f"WITH {_BM25} SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, score FROM lex WHERE rank <= 3 AND (rank = 1 OR score >= 30)")
def threshold_keep_top1(spark, d):
    return R.threshold(R.bm25(questions(spark, d), _indexed(spark, d)), 3, 30.0).select("query_id", "chunk_id", "rank", "score")


_HYBRID = f"WITH {_BM25}, {_DENSE}, {_CAND}, {_SCORED}, {_BOOST}, final AS (SELECT query_id, rank, chunk_id, title, text, score, question FROM collapsed WHERE rank <= 3 AND (rank = 1 OR score >= 0.2))"


@Q(f"{_HYBRID} SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, title, text, round(score, 6) AS score FROM final")
def hybrid_search(spark, d):
    return R.hybrid_search(_query_vectors(spark, d), chunks(spark, d), _vectors(spark, d), SOURCE)


def _index(spark, d):
    return R.build_index(chunks(spark, d), _vectors(spark, d), scratch(spark, "index"))


@Q(f"WITH {_BM25} SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM lex")
def indexed_bm25_topk(spark, d):
    """bm25_topk over a stored index."""
    return R.bm25(questions(spark, d), _index(spark, d))


@Q(f"{_HYBRID} SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, title, text, round(score, 6) AS score FROM final")
def indexed_hybrid_search(spark, d):
    """hybrid_search over a stored index."""
    return R.hybrid_search(_query_vectors(spark, d), _index(spark, d), None, SOURCE)


@Q(f"WITH {_BM25}, {_DENSE}, {_CAND}, {_SCORED} SELECT query_id, chunk_id, raw FROM scored")
def model_rerank_scores(spark, d):
    """rerank_scores by a model that is called in batches of pairs."""
    pairs = _cand(spark, d).join(questions(spark, d).withColumnRenamed("text", "question"), "query_id").join(chunks(spark, d), "chunk_id")
    logit = scoring.pair_scorer(scoring.overlap_model)("question", "text")
    return pairs.select("query_id", "chunk_id", F.round(T.sigmoid(logit), 6).alias("raw"))


@Q(f"{_HYBRID} SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, title, text, round(score, 6) AS score FROM final")
def model_hybrid_search(spark, d):
    """hybrid_search with such a model as its reranker."""
    return R.hybrid_search(_query_vectors(spark, d), chunks(spark, d), _vectors(spark, d), SOURCE, scorer=scoring.pair_scorer(scoring.overlap_model))


def _grown(spark, d):
    """All documents, as an index that got them in two uploads and lost what does not belong there."""
    every, vectors, n = chunks(spark, d), _vectors(spark, d), F.col("chunk_id")
    index = segments.GrowingIndex(spark, scratch(spark, "grown"))
    extra = every.where(n % 4 == 1).withColumn("chunk_id", -n - 1)
    index.add(every.where(n % 3 != 0).withColumn("text", F.when(n % 5 == 0, F.concat(F.lit("an older version "), "text")).otherwise(F.col("text"))).unionByName(extra), vectors.where(n % 3 != 0))
    index.add(every.where((n % 3 == 0) | (n % 5 == 0)), vectors.where((n % 3 == 0) | (n % 5 == 0)))
    index.delete(extra.select("chunk_id"))
    return index


@Q()
def grown_bm25_topk(spark, d):
    """bm25_topk over an index that grew; the rows are those of bm25_topk. Writes the index."""
    return R.bm25(questions(spark, d), _grown(spark, d).open())


@Q()
def grown_hybrid_search(spark, d):
    """hybrid_search over an index that grew and was merged. Writes the index."""
    index = _grown(spark, d)
    index.merge()
    return R.hybrid_search(_query_vectors(spark, d), index.open(), None, SOURCE)


_ENCODED = """WITH t AS (SELECT {key} AS {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS term FROM {table}),
f AS (SELECT {key}, CAST(CAST(concat('0x', substr(md5(term), 1, 4)) AS BIGINT) % 64 AS INT) AS dim, count(*) AS c FROM t GROUP BY ALL)
SELECT {key}, dim, round(c / sqrt(sum(c * c) OVER (PARTITION BY {key})), 5) AS value FROM f"""


def _dims(encoded, key):
    out = encoded.select(key, F.posexplode("embedding").alias("dim", "value")).where("value <> 0")
    return out.select(key, "dim", F.round(F.col("value").cast("double"), 5).alias("value"))


@Q(_ENCODED.format(key="doc_id", text="text", table="documents"))
def encode_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return _dims(encoding.embed(docs, "doc_id", encoding.hashed_terms(64)), "doc_id")


@Q(_ENCODED.format(key="item_id", text="concat('question: ', text)", table="benchmark"))
def encode_questions(spark, d):
    """The query side, with its prefix."""
    asked = table(spark, d, "benchmark").select("item_id", "text")
    return _dims(encoding.embed(asked, "item_id", encoding.hashed_terms(64), prefix="question: "), "item_id")


@Q(f"""{_HYBRID}, j AS (SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS t FROM final GROUP BY 1)
SELECT item_id AS case_id, coalesce(contains(lower(t), lower(text)), false) AS passed FROM benchmark LEFT JOIN j ON query_id = item_id""")
def eval_must_contain(spark, d):
    cases = questions(spark, d).select(F.col("query_id").alias("case_id"), F.col("text").alias("must_contain"))
    return evaluation.must_contain(hybrid_search(spark, d), cases)


@Q(f"""{_HYBRID}, j AS (SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS t FROM final GROUP BY 1)
SELECT count(*) FILTER (WHERE contains(lower(t), lower(text))) AS n_passed, count(*) AS n_cases FROM benchmark LEFT JOIN j ON query_id = item_id""")
def eval_accuracy(spark, d):
    return evaluation.accuracy(eval_must_contain(spark, d))


@Q(f"{_HYBRID} SELECT query_id, string_agg(concat(title, ' (', printf('%.2f', score), ')'), ', ' ORDER BY rank) AS titles FROM final GROUP BY 1")
def eval_top_titles(spark, d):
    return evaluation.top_titles(hybrid_search(spark, d))


@Q(f"{_HYBRID} SELECT query_id, string_agg(concat('**', title, '** (relevance: ', printf('%.2f', score), ')'), chr(10) ORDER BY rank) AS sources FROM final GROUP BY 1")
def source_listing(spark, d):
    line = F.format_string("**%s** (relevance: %.2f)", "title", "score")
    got = hybrid_search(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("s")))).alias("l"))
    return got.select("query_id", F.array_join(F.transform("l", lambda x: x["s"]), "\n").alias("sources"))


@Q(f"""{_HYBRID} SELECT query_id, concat('Context excerpts:', chr(10), chr(10), string_agg(concat('[Source ', rank, ': ', title, ']', chr(10), text), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank),
  chr(10), chr(10), '---', chr(10), chr(10), 'Question: ', any_value(question), chr(10), chr(10), 'Use these excerpts alone.') AS prompt FROM final GROUP BY query_id""")
def prompt_context(spark, d):
    from ..operators.conversations import prompts

    return prompts(hybrid_search(spark, d).join(questions(spark, d).withColumnRenamed("text", "question"), "query_id"))


@Q("""SELECT doc_id, regexp_replace(substr(text, greatest(instr(lower(text), 'disgusting') - 101, 0) + 1,
  instr(lower(text), 'disgusting') - 1 + 10 + 200 - greatest(instr(lower(text), 'disgusting') - 101, 0)), chr(10), ' ', 'g') AS snippet FROM documents WHERE contains(lower(text), 'disgusting')""")
def kwic_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", T.snippet("text", "disgusting").alias("snippet")).where("snippet is not null")
