"""Queries of chunking, search, fusion and context, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark import base as D
from kbspark.functions import chunks as C
from kbspark.functions import text as T
from kbspark.functions.porter import stemmed
from kbspark.operators import context as X
from kbspark.operators import index as I
from kbspark.operators import search as S
from kbspark.operators.best import by_entities
from kbspark.plans.lineage import cut_lineage
from kbspark.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- chunks and text functions ------------------------------------------------------------------------------------------


@query(f"WITH {D.CHUNKS} SELECT id, buffer, path, line_start, line_end, sha256(text) AS hash FROM chunks")
def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    return D.chunks(spark, d).select("id", "buffer", "path", "line_start", "line_end", T.content_hash(F.col("text")).alias("hash"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query(r"SELECT id, sha256(lower(regexp_replace(goal, '\s+', '', 'g'))) AS hash FROM explorations")
def question_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "explorations").select("id", T.question_hash(F.col("goal")).alias("hash"))


@query(f"""WITH {D.CURRENT_FILES} SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) WHEN path IS NOT NULL THEN '(root)' END AS theme, count(*) AS files FROM current_files GROUP BY 1""")
def theme_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.current_files(spark, d).groupBy(T.theme_of(F.col("path")).alias("theme")).agg(F.count(F.lit(1)).alias("files"))


@query(
    f"""WITH {D.CURRENT_FILES}, l AS (SELECT file_id, {D.LANGUAGE_SQL.format("path")} AS language FROM current_files)
SELECT file_id, language, CASE WHEN language = 'markdown' THEN 'markdown' WHEN language IS NOT NULL THEN 'code' ELSE 'text' END AS kind FROM l"""
)
def language_infer(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return D.current_files(spark, d).select("file_id", T.infer_language(p).alias("language"), T.classify(p).alias("kind"))


@query(r"SELECT doc_id, sha256(regexp_replace(text, '[^\p{L}\p{N}\s]', ' ', 'g')) AS clean FROM documents")
def sanitize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.content_hash(T.sanitize(F.col("text"))).alias("clean"))


_WORDS = r"len(list_filter(string_split(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' '), lambda w: w <> ''))"


@query(
    f"""SELECT doc_id, CAST(ceil({_WORDS.format("text")} * 1.3::DOUBLE) AS BIGINT) AS by_words, CAST(octet_length(encode(text)) // 4 AS BIGINT) AS by_bytes,
CAST(greatest((octet_length(encode(text)) + 3) // 4, 1) AS BIGINT) AS by_bytes_up,
CAST(greatest(ceil((length(text) + length(text) - length(regexp_replace(text, '[!-/:-@\\[-`{{-~]', '', 'g'))) / 4.0), 1) AS BIGINT) AS by_chars FROM documents"""
)
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.tokens_by_words(t).alias("by_words"), T.tokens_by_bytes_floor(t).alias("by_bytes"), T.tokens_by_bytes_ceil(t).alias("by_bytes_up"), T.tokens_by_chars(t).alias("by_chars"))


@query(r"SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')[1:30], ' ') AS head FROM documents")
def truncate_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.truncate_to_tokens(F.col("text"), 40).alias("head"))


@query(
    r"""SELECT id, trim(regexp_replace(regexp_replace(lower(goal), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, substr(regexp_replace(goal, '[^A-Za-z0-9_\-]', '_', 'g'), 1, 64) AS identifier,
'L' || CAST(version AS VARCHAR) || ':' || project || ':' || goal AS job_key FROM explorations"""
)
def name_forms(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("goal")
    return table(spark, d, "explorations").select("id", T.slug(g).alias("slug"), T.identifier(g).alias("identifier"), T.job_key(F.col("version"), F.col("project"), g).alias("job_key"))


@query()
def map_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claim text, contract header and front matter of the maps sent by agents."""
    b = F.col("body_markdown")
    return table(spark, d, "persist_exploration_request").select("request_id", T.claim_text(b).alias("claim"), T.contract_fields(b).alias("contract"), T.front_matter(b).alias("front_matter"), T.strip_thoughts(b).alias("stripped"))


def _chunker(method: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        f = D.current_files(spark, d).withColumn("language", T.infer_language(F.col("path")))
        return C.chunk_texts(f, "file_id", "content", method, 128, 16, "language").drop("text")

    return run


for _m in ("text", "recursive", "code", "bytes", "markdown"):
    QUERIES[f"chunker_{_m}"] = _chunker(_m)


# -- lexical search -----------------------------------------------------------------------------------------------------

_BM25 = D.bm25_sql()


def _ranked(source: str, k: int, by: str = "query_id", name: str = "score") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {name} DESC, id) - 1 AS rank FROM ({source})) WHERE rank < {k}"


@query(f"WITH {D.TEXT_SQL} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM posted GROUP BY term")
def postings_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.term_stats(D.text_index(spark, d).postings())


def _top(spark: SparkSession, d: str, k: int, mode: str = "or", by_buffer: bool = False) -> DataFrame:
    return D.text_index(spark, d).top(D.text_queries(spark, d), k, mode, by_buffer)


def _bm(mode: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _top(spark, d, 10, mode).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))

    return run


QUERIES |= {"bm25_and": _bm("and"), "bm25_or": _bm("or"), "bm25_or_fallback": _bm("fallback")}
for _n, _w in (("bm25_and", "bm WHERE n_hit = n_terms"), ("bm25_or", "bm"), ("bm25_or_fallback", "fb")):
    SQL[_n] = f"WITH {_BM25} " + _ranked(f"SELECT query_id, id, round(score, 6) AS score FROM {_w}", 10)


@query(f"WITH {_BM25} " + _ranked("SELECT query_id, buffer, id, round(score, 6) AS score FROM bm", 3, "query_id, buffer"))
def bm25_per_buffer(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, 3, by_buffer=True).select("query_id", "buffer", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {D.TEXT_SQL}, w AS (SELECT DISTINCT term, stem FROM stems WHERE term IN (SELECT unnest(terms) FROM tok)) SELECT stem, count(*) AS terms FROM w GROUP BY stem")
def stemmed_terms(spark: SparkSession, d: str) -> DataFrame:
    """How many words of the corpus share each stem."""
    words = D.documents(spark, d).select(F.explode_outer(F.array_distinct(T.tokens(F.col("text")))).alias("term")).where("term is not null").distinct()
    return words.select(F.element_at(stemmed(F.array("term")), 1).alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("terms"))


@query("WITH " + D.TEXT_SQL.replace("FROM documents)", "FROM (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN subject ELSE text END AS text, subject FROM documents WHERE doc_id % 11 <> 0))", 1) + " SELECT id, dl, count(*) AS stems, CAST(sum(tf) AS BIGINT) AS words FROM posted GROUP BY id, dl")
def index_extended(spark: SparkSession, d: str) -> DataFrame:
    """An index after an extension: some documents replaced by their subject, some removed."""
    docs = table(spark, d, "documents")
    path = D.stored(spark, d, "extended")
    I.build(D.documents(spark, d), path)
    new = docs.where("doc_id % 7 = 0 and doc_id % 11 <> 0").select(F.col("doc_id").alias("id"), F.col("source").alias("buffer"), F.col("subject").alias("text"))
    I.extend(new, path, docs.where("doc_id % 11 = 0").select(F.col("doc_id").alias("id")))
    return I.Index(spark, path).postings().groupBy("id", "dl").agg(F.count(F.lit(1)).alias("stems"), F.sum("tf").alias("words"))


# -- entities -----------------------------------------------------------------------------------------------------------

_ENT = rf"""{D.CHUNKS}, plain AS (SELECT id, buffer, regexp_replace(text, '[^\x00-\x7F]', ' ', 'g') AS t, regexp_replace(regexp_extract(path, '[^/]*$'), '^(.+)\.[^.]*$', '\1') AS stem FROM chunks),
ent AS (SELECT id, buffer, list_sort(list_distinct(list_transform(list_filter(list_concat(regexp_extract_all(t, '{S.FUNCTION_NAME}', 1),
  list_transform(regexp_extract_all(t, '{S.IMPORTED}', 1), lambda x: regexp_extract(x, '([^:/.]*)$', 1)),
  list_filter(regexp_extract_all(t, '{S.IDENTIFIER}', 1), lambda x: length(x) >= 3), [stem]), lambda x: x <> ''), lambda x: lower(x))))[1:10] AS es FROM plain)"""


@query(f"WITH {_ENT} SELECT id, unnest(es) AS entity FROM ent")
def entity_extract(spark: SparkSession, d: str) -> DataFrame:
    return S.entity_index(D.chunks(spark, d)).select("id", "entity")


_EQ = r"""eq AS (SELECT DISTINCT query_id, trim(regexp_replace(lower(e), '[^\p{L}\p{N}]+', ' ', 'g')) AS wanted FROM (SELECT doc_id AS query_id, unnest(string_split(subject, '/')) AS e FROM documents WHERE doc_id % 50 = 0)), eqs AS (SELECT * FROM eq WHERE wanted <> '')"""


def _entity_hits_sql(source: str) -> str:
    names = rf"SELECT id, buffer, ' ' || trim(regexp_replace(unnest(es), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS name FROM {source}"
    return f"eh AS (SELECT query_id, id, buffer, CAST(count(DISTINCT wanted) AS DOUBLE) AS score FROM ({names}) n JOIN eqs ON contains(name, ' ' || wanted) GROUP BY query_id, id, buffer)"


@query(f"WITH {_ENT}, {_EQ}, {_entity_hits_sql('ent')} " + _ranked("SELECT query_id, id, score FROM eh", 10))
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    hits = S.entity_search(D.entity_queries(spark, d), D.chunk_phrases(spark, d))
    return S.top_k(hits, 10).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


# -- vectors ------------------------------------------------------------------------------------------------------------

_L2 = "list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_DOT = "list_sum(list_transform(list_zip(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])), lambda z: z[1] * z[2]))"
_COS = f"({_DOT.format('a.embedding', 'b.embedding')} / (sqrt({_DOT.format('a.embedding', 'a.embedding')}) * sqrt({_DOT.format('b.embedding', 'b.embedding')})))"
_PAIRS = "FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id"


@query("WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(" + _COS + ", 6) AS score " + _PAIRS + ") " + _ranked("SELECT * FROM s", 10))
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.vector_search(D.vector_queries(spark, d), D.vectors(spark, d), 10, "cosine").select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(1 / (1 + " + _L2 + "), 6) AS score " + _PAIRS + ") " + _ranked("SELECT * FROM s", 10))
def l2_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.vector_search(D.vector_queries(spark, d), D.vectors(spark, d), 10, "l2").select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(1 / (1 + " + _L2 + "), 6) AS score " + _PAIRS + " AND a.label = b.label) " + _ranked("SELECT * FROM s", 4))
def l2_topk_buffer(spark: SparkSession, d: str) -> DataFrame:
    return S.vector_search(D.vector_queries(spark, d), D.vectors(spark, d), 4, "l2", same_buffer=True).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(" + _COS + ", 6) AS similarity " + _PAIRS + ") WHERE similarity >= 0.3")
def knn_radius(spark: SparkSession, d: str) -> DataFrame:
    return S.within_radius(D.vector_queries(spark, d), D.vectors(spark, d), 0.3)


@query("SELECT label AS buffer, CAST(i - 1 AS INTEGER) AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS value FROM embeddings, range(1, 65) t(i) GROUP BY ALL")
def centroid(spark: SparkSession, d: str) -> DataFrame:
    return S.centroids(D.vectors(spark, d))


# -- fusion -------------------------------------------------------------------------------------------------------------


def _bm_list(spark: SparkSession, d: str, k: int) -> DataFrame:
    return _top(spark, d, k, "fallback")


_VL = f"vl AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(1 / (1 + {_L2}), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)"


def _rrf_sql(*lists: str, k: int = 10) -> str:
    parts = " UNION ALL ".join(f"SELECT query_id, id, 1.0::DOUBLE / (60 + rank + 1) AS part FROM ({x})" for x in lists)
    return _ranked(f"SELECT query_id, id, round(sum(part), 9) AS score FROM ({parts}) GROUP BY query_id, id", k)


_FB = _ranked("SELECT * FROM fbr", 30)


@query(f"WITH {_BM25}, {_VL} " + _rrf_sql(_FB, _ranked("SELECT * FROM vl", 60)))
def rrf_two_lists(spark: SparkSession, d: str) -> DataFrame:
    v = S.vector_search(D.vector_queries(spark, d), D.vectors(spark, d), 60, exclude_self=False)
    return S.top_k(S.rrf([_bm_list(spark, d, 30), v]).withColumn("score", F.round("score", 9)), 10).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_BM25} " + _rrf_sql(_ranked("SELECT query_id, buffer, id, round(score, 6) AS score FROM bm", 30, "query_id, buffer")))
def rrf_cross_project(spark: SparkSession, d: str) -> DataFrame:
    return S.across_buffers(_top(spark, d, 30, by_buffer=True)).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


_DENT = "dent AS (SELECT doc_id AS id, source AS buffer, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', ' ', 'g'), '" + S.IDENTIFIER + "', 1), lambda x: length(x) >= 3), lambda x: lower(x))))[1:10] AS es FROM documents)"
_DEH = f"{_DENT}, {_EQ}, {_entity_hits_sql('dent')}"
_ALL = _DEH.replace("[1:10] AS es", " AS es")


def _hybrid(tier: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        lexical = _bm_list(spark, d, 30)
        names = None if tier == "entity" else 10
        entity = by_entities(D.entity_queries(spark, d), D.doc_phrases(spark, d, names), 30) if tier != "fts" else None
        vector = S.vector_search(D.vector_queries(spark, d), D.vectors(spark, d), 60, exclude_self=False) if tier == "vector" else None
        return S.hybrid(lexical, entity, vector).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))

    return run


QUERIES |= {f"hybrid_{t}": _hybrid(t) for t in ("fts", "entity", "vector")}
SQL["hybrid_fts"] = f"WITH {_BM25} " + _rrf_sql(_FB)
SQL["hybrid_entity"] = f"WITH {_BM25}, {_ALL} " + _rrf_sql(_FB, _ranked("SELECT query_id, id, score FROM eh", 30))
SQL["hybrid_vector"] = f"WITH {_BM25}, {_DEH}, {_VL} " + _rrf_sql(_FB, _ranked("SELECT query_id, id, score FROM eh", 30), _ranked("SELECT * FROM vl", 60))


@query(
    f"WITH {_BM25}, t AS ({_FB}) SELECT query_id, id, round(CASE WHEN hi - lo < 1e-9 THEN 1.0 ELSE (score - lo) / (hi - lo) END, 6) AS norm FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM t)"
)
def minmax_normalize(spark: SparkSession, d: str) -> DataFrame:
    return S.normalized(_bm_list(spark, d, 30)).select("query_id", "id", F.round("norm", 6).alias("norm"))


@query(
    f"""WITH {_BM25}, t AS ({_FB}), a AS (SELECT t.query_id, t.id, date_diff('second', captured_at, TIMESTAMPTZ '{D.NOW}+00') / 3600.0::DOUBLE AS h, t.score FROM t JOIN documents ON doc_id = id)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM (SELECT query_id, id, round(CASE WHEN h > 0 THEN score * exp(-0.0005 * h) ELSE score END, 6) AS score FROM a)"""
)
def decay_rerank(spark: SparkSession, d: str) -> DataFrame:
    hours = (F.lit(D.NOW).cast("timestamp").cast("long") - F.col("captured_at").cast("long")) / 3600.0
    ages = table(spark, d, "documents").select(F.col("doc_id").alias("id"), hours.alias("age_hours"))
    r = S.decayed(_bm_list(spark, d, 30).drop("rank"), ages, 0.0005).withColumn("score", F.round("score", 6))
    return S.top_k(r, 30).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


# -- context ------------------------------------------------------------------------------------------------------------


def _with_texts(spark: SparkSession, d: str, rows: DataFrame, most: int) -> DataFrame:
    """Rows with an ``id``, at most so many, and the path and text of each; they are broadcast unless they are many."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")
    return (F.broadcast(rows) if most <= D.BROADCAST_IDS else rows).join(docs, "id")


def _results(spark: SparkSession, d: str, k: int = 30) -> DataFrame:
    """The k best documents of each query with their texts; the lists are made once."""
    lists = cut_lineage(_bm_list(spark, d, k).drop("buffer"))
    return _with_texts(spark, d, lists, lists.count()).select("query_id", "rank", "id", "path", "text", "score")


_RES = f"res AS (SELECT t.query_id, t.rank, t.id, source || '/' || CAST(t.id AS VARCHAR) AS path, text, t.score FROM ({_FB}) t JOIN documents ON doc_id = t.id)"
_W13 = f"CAST(ceil({_WORDS.format('text')} * 1.3::DOUBLE) AS BIGINT)"


@query(
    f"""WITH {_BM25}, {_RES}, b AS (SELECT *, {_W13} AS tokens FROM res), c AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT query_id, id, tokens, before + tokens > 3000 AS was_cut, sha256(CASE WHEN before + tokens <= 3000 THEN text ELSE array_to_string(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')[1:CAST(floor(greatest(3000 - before, 0) / 1.3::DOUBLE) AS INTEGER)], ' ') END) AS kept
FROM c WHERE before + tokens <= 3000 OR (before < 3000 AND 3000 - before > 100)"""
)
def token_budget_truncate(spark: SparkSession, d: str) -> DataFrame:
    """What fits is decided by sizes; the texts that are kept meet their rows by broadcast and are not shuffled."""
    lists = cut_lineage(_bm_list(spark, d, 30).select("query_id", "rank", "id"))
    n = lists.count()
    sizes = cut_lineage(_with_texts(spark, d, lists, n).select("query_id", "rank", "id", X.tokens(F.col("text")).alias("tokens")))
    if sizes.count() > n:  # an id with several texts: each goes on with its own
        r = X.budget_with_cut(_with_texts(spark, d, lists, n), 3000)
    else:
        r = _with_texts(spark, d, X.fitted(sizes, 3000), n).withColumn("kept", X.kept(F.col("text"), F.col("was_cut"), F.col("left")))
    return r.select("query_id", "id", "tokens", "was_cut", T.content_hash(F.col("kept")).alias("kept"))


@query(
    f"""WITH RECURSIVE {_BM25}, {_RES}, x AS (SELECT query_id, rank, id, octet_length(encode(coalesce(text, ''))) // 4 AS tok FROM res),
r AS (SELECT DISTINCT query_id, CAST(-1 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS used, false AS took, CAST(NULL AS BIGINT) AS id FROM x
  UNION ALL SELECT x.query_id, x.rank, CASE WHEN r.used + tok <= 2000 THEN r.used + tok ELSE r.used END, r.used + tok <= 2000, x.id FROM r JOIN x ON x.query_id = r.query_id AND x.rank = r.rank + 1)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS INTEGER) AS pos, id, used FROM (SELECT query_id, rank, id, took, max(used) OVER (PARTITION BY query_id) AS used FROM r) WHERE took"""
)
def token_budget_skip(spark: SparkSession, d: str) -> DataFrame:
    """Results taken in order into a budget, those too large skipped."""
    return X.budget_with_skip(_results(spark, d), 2000)


@query(
    f"""WITH {_BM25}, {_RES} SELECT query_id, sha256(string_agg('[' || CAST(rank + 1 AS VARCHAR) || '] ' || path || ' score ' || printf('%.2f', score) || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS context FROM res WHERE rank < 10 GROUP BY query_id"""
)
def context_render(spark: SparkSession, d: str) -> DataFrame:
    return X.rendered(_results(spark, d, 10)).select("query_id", T.content_hash(F.col("context")).alias("context"))
