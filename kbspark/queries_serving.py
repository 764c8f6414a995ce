"""Queries of what a server answers with, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark import base as D
from kbspark import queries_domain as Q
from kbspark import queries_search as QS
from kbspark.functions import scores
from kbspark.functions import text as T
from kbspark.operators import index as I
from kbspark.operators import maps as P
from kbspark.operators import search as S
from kbspark.operators import serving as V
from kbspark.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_OK = "SELECT * FROM rlm_nodes WHERE deleted_at IS NULL AND review_status = 'approved'"
_NODE_TEXT = f"SELECT id, project AS buffer, concat_ws(chr(10), subject, summary_text) AS text FROM ({_OK})"
_SEM = f"sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM (SELECT q.id AS query_id, n.id, {Q._COS_V.format('q.v', 'u.v')} AS score FROM uv q CROSS JOIN rlm_nodes n JOIN uv u ON u.id = n.id WHERE q.id % 50 = 0 AND q.id <> n.id)) WHERE rank < 10)"
_SUMMARIES = f"""{D.bm25_sql(_NODE_TEXT, "n_")}, {D.USABLE_SQL}, {_SEM}, ok AS ({_OK}),
lists AS ({QS._ranked("SELECT query_id, id, score FROM n_fbr", 10)} UNION ALL {QS._ranked("SELECT query_id, id, score FROM sem WHERE id IN (SELECT id FROM ok)", 10)}),
fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (61 + rank)), 9) AS score FROM lists GROUP BY query_id, id),
su AS (SELECT * FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM fused) WHERE rank < 10),
found AS (SELECT query_id, id, score, CASE WHEN hi - lo < 1e-9 THEN 1.0::DOUBLE ELSE (score - lo) / (hi - lo) END AS norm, rank FROM su)"""


def _summaries(spark: SparkSession, d: str, revisions: DataFrame | None = None) -> DataFrame:
    nodes = table(spark, d, "rlm_nodes")
    ok = V.servable(nodes)
    path = D.stored(spark, d, "nodes")
    index = I.current(ok.select("id", F.col("project").alias("buffer"), F.concat_ws("\n", "subject", "summary_text").alias("text")), path)
    lexical = index.top(D.text_queries(spark, d), 10, "fallback")
    items = D.usable_vectors(spark, d).join(nodes.select("id", F.lit("").alias("buffer")), "id")
    semantic = S.vector_search(D.usable_queries(spark, d), items, 10, "cosine")
    return V.summaries(lexical, semantic, ok, revisions)


@query(f"WITH {_SUMMARIES} SELECT query_id, id, score, round(norm, 6) AS norm, rank FROM found")
def summary_search(spark: SparkSession, d: str) -> DataFrame:
    return _summaries(spark, d).select("query_id", "id", "score", F.round("norm", 6).alias("norm"), F.col("rank").cast("long").alias("rank"))


_REV = f"rev AS (SELECT project, level, subject, id AS served FROM (SELECT *, row_number() OVER (PARTITION BY project, level, subject ORDER BY created_at DESC, id DESC) AS rk FROM rlm_nodes WHERE created_at <= TIMESTAMPTZ '{Q.THEN}+00') WHERE rk = 1 AND (deleted_at IS NULL OR deleted_at > TIMESTAMPTZ '{Q.THEN}+00'))"


@query(f"WITH {_SUMMARIES}, {_REV} SELECT query_id, f.id, coalesce(served, f.id) AS served, rank FROM found f JOIN ok o ON o.id = f.id LEFT JOIN rev r ON r.project = o.project AND r.level = o.level AND r.subject = o.subject")
def summary_search_as_of(spark: SparkSession, d: str) -> DataFrame:
    rev = Q.as_of_nodes(spark, d).withColumnRenamed("id", "served")
    return _summaries(spark, d, rev).select("query_id", "id", "served", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_SUMMARIES} SELECT query_id, f.id, '[summary:' || level || '] ' || subject AS path, score, 0 AS line_start FROM found f JOIN ok o ON o.id = f.id WHERE score >= 0.0155 AND contains('[summary:' || level || '] ' || subject, '/')")
def summary_rows(spark: SparkSession, d: str) -> DataFrame:
    """Summaries as chunks, of a score and with a part of a path."""
    rows = V.as_chunks(_summaries(spark, d), table(spark, d, "rlm_nodes"))
    return V.filtered(rows, 0.0155, "/").select("query_id", "id", "path", "score", "line_start")


_CHUNK_NORM = f"c10 AS ({QS._ranked('SELECT * FROM fbr', 10)}), cn AS (SELECT query_id, id, CASE WHEN hi - lo < 1e-9 THEN 1.0::DOUBLE ELSE (score - lo) / (hi - lo) END AS norm FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM c10))"


@query(
    f"""WITH {D.bm25_sql()}, {_CHUNK_NORM}, {_SUMMARIES}, maps AS ({SQL.get("x", Q.SQL["exploration_search"])}),
s AS (SELECT * FROM (SELECT query_id, id, norm, row_number() OVER (PARTITION BY query_id ORDER BY norm DESC, id) AS rk FROM found WHERE norm >= 0.35) WHERE rk <= 6),
c AS (SELECT c.query_id, c.id, c.norm FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY norm DESC, id) - 1 AS rk FROM cn) c LEFT JOIN (SELECT query_id, count(*) AS n FROM s GROUP BY query_id) t ON t.query_id = c.query_id WHERE rk < 10 - coalesce(n, 0))
SELECT query_id, 'chunk' AS kind, id, round(norm, 6) AS norm FROM c UNION ALL SELECT query_id, 'summary', id, round(norm, 6) FROM s UNION ALL SELECT query_id, 'map', id, round(confidence, 6) FROM maps"""
)
def unified_search(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, summaries and maps for each question."""
    chunks = S.normalized(QS._bm_list(spark, d, 10)).select("query_id", "id", "norm")
    return V.unified(chunks, _summaries(spark, d), Q.exploration_search(spark, d))


@query("SELECT id, project, level FROM rlm_nodes WHERE deleted_at IS NULL AND review_status = 'approved' AND id % 9 <> 0 AND project = 'harbor-core'")
def servable_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of a project that may be served; every ninth is stale."""
    n = table(spark, d, "rlm_nodes").withColumn("stale", F.col("id") % 9 == 0)
    return V.servable(n, "harbor-core").select("id", "project", "level")


@query("SELECT buffer, id, rank FROM (SELECT project AS buffer, id, row_number() OVER (PARTITION BY project ORDER BY id) - 1 AS rank FROM explorations WHERE status = 'pending_review') WHERE rank < 3")
def pending_tasks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "explorations").select("id", F.col("project").alias("buffer"), F.when(F.col("status") == "pending_review", "pending").otherwise("done").alias("status"))
    return V.pending_tasks(t, 3).select("buffer", "id", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT (SELECT count(*) FROM ({Q.SQL['dedup_keep_newest']})) AS duplicate_chunks_removed, (SELECT count(*) FROM ({Q.SQL['low_confidence_filter']})) AS low_confidence_patterns_removed, (SELECT count(*) FROM ({Q.SQL['decay_purge']})) AS decayed_chunks")
def maintenance_report(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the maintenance passes in one report."""
    names = ["duplicate_chunks_removed", "low_confidence_patterns_removed", "decayed_chunks"]
    passes = [Q.dedup_keep_newest(spark, d), Q.low_confidence_filter(spark, d), Q.decay_purge(spark, d)]
    return V.merged_reports([p.agg(*[(F.count(F.lit(1)) if n == names[i] else F.sum(F.lit(0))).cast("long").alias(n) for n in names]) for i, p in enumerate(passes)])


_IDS = "CASE WHEN json_valid(payload) THEN CAST(json_extract_string(payload, '$.chunk_ids[*]') AS VARCHAR[]) END"
_PATHS = "SELECT DISTINCT CAST(chunk_id AS VARCHAR) AS id, file_path AS path FROM search_result WHERE file_path IS NOT NULL"


@query(f"SELECT DISTINCT path FROM ({_PATHS}) WHERE id IN (SELECT trim(unnest({_IDS})) FROM claim_rlm_job_response)")
def result_paths(spark: SparkSession, d: str) -> DataFrame:
    return V.paths_of(_cited(spark, d).select(F.explode("chunk_ids").alias("id")), _chunk_paths(spark, d))


def _cited(spark: SparkSession, d: str) -> DataFrame:
    from kbspark.operators.orphans import _payload_ids

    c = table(spark, d, "claim_rlm_job_response")
    return c.select(F.col("claim_id").alias("id"), F.transform(_payload_ids(F.col("payload"), "chunk_ids"), lambda x: F.trim(x)).alias("chunk_ids"))


def _chunk_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_result").where("file_path is not null").select(F.col("chunk_id").cast("string").alias("id"), F.col("file_path").alias("path"))


@query(
    f"""WITH e AS (SELECT DISTINCT claim_id AS id, trim(unnest({_IDS})) AS c FROM claim_rlm_job_response), p AS ({_PATHS}), f AS (SELECT e.id, array_to_string(list_sort(list(DISTINCT path)), '|') AS paths FROM e JOIN p ON p.id = e.c GROUP BY e.id)
SELECT c.claim_id AS id, coalesce(paths, '') AS paths FROM claim_rlm_job_response c LEFT JOIN f ON f.id = c.claim_id"""
)
def memory_paths(spark: SparkSession, d: str) -> DataFrame:
    """The paths behind the chunks that each payload cites."""
    return V.with_paths(_cited(spark, d), _chunk_paths(spark, d)).select("id", F.array_join("paths", "|").alias("paths"))


@query("SELECT event_id, CAST(used AS BIGINT) AS used, CAST(greatest(5000 - used, 0) AS BIGINT) AS remaining FROM (SELECT event_id, sum(event_id % 97 + event_id % 31) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM events)")
def token_budget_left(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id"), (F.col("event_id") % 97).alias("prompt"), (F.col("event_id") % 31).alias("completion"))
    return V.budget_left(u, 5000).select(F.col("id").alias("event_id"), "used", "remaining")


def _cases(table_: dict[str, str]) -> str:
    ext = "lower(nullif(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1), ''))"
    return f"CASE {ext} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


@query(f"WITH {D.CURRENT_FILES} SELECT file_id, {_cases(T.CHUNK_LANGUAGES)} AS chunked_as, {_cases(T.EDITOR_LANGUAGES)} AS shown_as FROM current_files")
def language_variants(spark: SparkSession, d: str) -> DataFrame:
    """The other two maps of endings to languages."""
    p = F.col("path")
    return D.current_files(spark, d).select("file_id", T.language_by(p, T.CHUNK_LANGUAGES).alias("chunked_as"), T.language_by(p, T.EDITOR_LANGUAGES).alias("shown_as"))


@query(f"WITH {D.CHUNKS} SELECT id, sha256(text) AS hash, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM chunks")
def stored_chunks(spark: SparkSession, d: str) -> DataFrame:
    return V.stored_chunks(D.chunks(spark, d).select("id", "text")).drop("text")


@query(f"WITH {D.CURRENT_FILES}, {Q._ANCHORS} SELECT a.id, array_to_string(list_sort(list(DISTINCT a.path || '@' || coalesce(hash, '?'))), ' ') AS anchors FROM anchors a LEFT JOIN cur ON cur.project = a.project AND cur.path = a.path GROUP BY a.id")
def map_anchors(spark: SparkSession, d: str) -> DataFrame:
    return V.anchor_lines(Q.anchors_resolved(spark, d)).select("id", F.array_join("anchors", " ").alias("anchors"))


@query("SELECT event_id AS query_id, CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'query' ELSE 'store' END AS query_type, ts AS at FROM events WHERE event_type IN ('view', 'click', 'purchase')")
def history_recorded(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumns({"query_id": F.col("event_id"), "text": F.col("event_type")})
    kind = F.when(F.col("event_type") == "view", "search").when(F.col("event_type") == "click", "query").when(F.col("event_type") == "purchase", "store")
    return V.history_rows(e, kind, F.col("ts")).drop("text")


@query("SELECT project, path FROM (SELECT project, path, list_sort(list(DISTINCT hash)) AS now FROM (SELECT project, file_path AS path, sha256(text) AS hash FROM search_result WHERE text IS NOT NULL AND file_path IS NOT NULL) GROUP BY project, path) x LEFT JOIN (SELECT project, file_path AS path, list_sort(list(DISTINCT sha256(text))) AS past FROM search_result WHERE text IS NOT NULL AND epoch <= 30 AND file_path IS NOT NULL GROUP BY project, file_path) y USING (project, path) WHERE now IS DISTINCT FROM past")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files whose chunks are no longer those a summary was made of."""
    from kbspark.operators.graph import file_jobs

    r = table(spark, d, "search_result").where("text is not null and file_path is not null").select("project", F.col("file_path").alias("path"), "epoch", T.content_hash(F.col("text")).alias("hash"))
    return file_jobs(r, r.where("epoch <= 30").groupBy("project", "path").agg(F.collect_set("hash").alias("hashes")))


@query(f"SELECT id, round(least(greatest(0.1::DOUBLE * (CASE WHEN c + x = 0 THEN 0 ELSE (c - x)::DOUBLE / (c + x) END), 0), 1), 6) AS confidence FROM (SELECT id, access_count AS c, coalesce(version, 0) AS x FROM explorations e JOIN (SELECT DISTINCT project FROM explorations) USING (project))")
def map_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Maps asked for by id: confidence without a question, that is with similarity 0."""
    m = Q._all_maps(spark, d)
    c = scores.confidence(F.lit(0.0), P.drift(F.coalesce("epoch", "now_epoch"), F.col("now_epoch")), F.col("age_days"), F.col("confirmed"), F.col("contradicted"))
    return m.select("id", F.round(c, 6).alias("confidence"))


@query(f"WITH {D.USABLE_SQL}, s AS (SELECT q.id AS id, {Q._COS_V.format('q.v', 'u.v')} AS similarity FROM uv q JOIN uv u ON q.id <> u.id WHERE q.id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC) AS rk FROM s) SELECT id, max(similarity) >= 0.25 AS grounded FROM r WHERE rk <= 5 GROUP BY id")
def grounding_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether a claim is near enough to some chunk; vectors of the cache stand for both."""
    near = S.vector_search(D.usable_queries(spark, d), D.usable_vectors(spark, d).withColumn("buffer", F.lit("")), 5, "cosine")
    return P.grounded(near.select(F.col("query_id").alias("id"), F.col("score").alias("similarity")), 0.25)
