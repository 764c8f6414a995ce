"""Queries of revisions, caches, graphs, queues, maps, maintenance and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark import base as D
from kbspark.functions import scores, vectors
from kbspark.functions import text as T
from kbspark.functions.chunks import chunk_lines
from kbspark.operators import cache as Q
from kbspark.operators import evaluation as E
from kbspark.operators import graph as G
from kbspark.operators import maintenance as M
from kbspark.operators import maps as P
from kbspark.operators import revisions as R
from kbspark.operators import search as S
from kbspark.operators.orphans import same_file
from kbspark.queries_search import _COS, _L2, _PAIRS, _ranked
from kbspark.plans.lineage import cut_lineage
from kbspark.plans.spread import spread
from kbspark.session import table
from kbspark.streaming import flows

QUERIES: dict = {}
SQL: dict[str, str] = {}
THEN, LATER = "2024-06-01 00:00:00", "2024-08-15 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def ts(s: str):
    return F.lit(s).cast("timestamp")


_SAME = D._SAME.format("rel_path")
_FILES = f"files AS (SELECT *, {_SAME} AS path, sha256(content) AS hash FROM index_file)"


def _uploads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "index_file").select(F.col("file_id").alias("id"), "project", same_file(F.col("rel_path")).alias("path"), "content", T.content_hash(F.col("content")).alias("hash"), "received_at", "deleted_at")


# -- revisions ----------------------------------------------------------------------------------------------------------


def _snapshot_chunks(spark: SparkSession, d: str, at: str) -> DataFrame:
    s = D.newest_uploads(table(spark, d, "index_file"), at)
    return chunk_lines(s.select("file_id", "project", "path", "content"), "content").select("project", "path", "line_start", "line_end", T.content_hash(F.col("text")).alias("hash"))


def _snapshot_sql(name: str, at: str) -> str:
    return rf"""{name}_f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY received_at DESC, file_id DESC) AS rk FROM files WHERE received_at <= TIMESTAMPTZ '{at}+00')
  WHERE rk = 1 AND (deleted_at IS NULL OR deleted_at > TIMESTAMPTZ '{at}+00')),
{name}_b AS (SELECT *, len(ls) AS n FROM (SELECT *, string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\n\z', ''), chr(10)) AS ls FROM {name}_f WHERE content IS NOT NULL AND content <> '')),
{name} AS (SELECT project, path, CAST(s + 1 AS INTEGER) AS line_start, CAST(least(s + 51, n) AS INTEGER) AS line_end, sha256(array_to_string(ls[s + 1 : s + 51], chr(10))) AS hash
  FROM (SELECT *, unnest(range(0, n, 45)) AS s FROM {name}_b) WHERE s = 0 OR s + 6 < n)"""


@query(
    f"""WITH {_FILES}, {_snapshot_sql("a", THEN)}, {_snapshot_sql("b", LATER)}
SELECT coalesce(a.project, b.project) AS project, coalesce(a.path, b.path) AS path, coalesce(a.line_start, b.line_start) AS line_start, coalesce(a.line_end, b.line_end) AS line_end,
CASE WHEN a.hash IS NULL THEN 'new' WHEN b.hash IS NULL THEN 'orphan' WHEN a.hash = b.hash THEN 'same' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.project = b.project AND a.path = b.path AND a.line_start = b.line_start AND a.line_end = b.line_end"""
)
def supersede_diff(spark: SparkSession, d: str) -> DataFrame:
    return R.difference(_snapshot_chunks(spark, d, THEN), _snapshot_chunks(spark, d, LATER), ["project", "path", "line_start", "line_end"], "hash").drop("old", "new")


@query(f"WITH {_FILES}, {_snapshot_sql('a', THEN)}, {_snapshot_sql('b', LATER)} SELECT project, path, line_start, line_end FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.project = b.project AND a.path = b.path AND a.line_start = b.line_start AND a.line_end = b.line_end)")
def orphan_retire(spark: SparkSession, d: str) -> DataFrame:
    return R.orphans(_snapshot_chunks(spark, d, THEN), _snapshot_chunks(spark, d, LATER), ["project", "path", "line_start", "line_end"]).drop("hash")


@query(f"WITH {_FILES} SELECT file_id, row_number() OVER w AS version, lead(file_id) OVER w AS superseded_by, lead(file_id) OVER w IS NULL AS is_active FROM files WINDOW w AS (PARTITION BY project, path ORDER BY received_at, file_id)")
def version_chain(spark: SparkSession, d: str) -> DataFrame:
    return R.chains(_uploads(spark, d), ["project", "path"], ["received_at"]).select(F.col("id").alias("file_id"), "version", "superseded_by", "is_active")


@query(f"WITH {_FILES} SELECT file_id, CASE WHEN row_number() OVER w = 1 THEN 'new' WHEN lag(hash) OVER w IS NOT DISTINCT FROM hash THEN 'same' ELSE 'changed' END AS change FROM files WINDOW w AS (PARTITION BY project, path ORDER BY received_at, file_id)")
def change_detection(spark: SparkSession, d: str) -> DataFrame:
    return R.changes(_uploads(spark, d), ["project", "path"], ["received_at", "id"], "hash").select(F.col("id").alias("file_id"), "change")


@query("SELECT chunk_id, epoch, version FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY epoch DESC, version DESC NULLS LAST) AS rk FROM search_result WHERE epoch <= 20) WHERE rk = 1")
def as_of_chunks(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "search_result").where("epoch <= 20")
    return R.latest(s, ["chunk_id"], [F.col("epoch").desc(), F.col("version").desc_nulls_last()]).select("chunk_id", "epoch", "version")


@query("SELECT project, goal, id, epoch FROM (SELECT *, row_number() OVER (PARTITION BY project, goal ORDER BY epoch DESC, id DESC) AS rk FROM explorations WHERE epoch <= 20) WHERE rk = 1")
def as_of_maps(spark: SparkSession, d: str) -> DataFrame:
    return R.as_of(table(spark, d, "explorations"), ["project", "goal"], "epoch", 20).select("project", "goal", "id", "epoch")


@query(f"SELECT project, level, subject, id FROM (SELECT *, row_number() OVER (PARTITION BY project, level, subject ORDER BY created_at DESC, id DESC) AS rk FROM rlm_nodes WHERE created_at <= TIMESTAMPTZ '{THEN}+00') WHERE rk = 1 AND (deleted_at IS NULL OR deleted_at > TIMESTAMPTZ '{THEN}+00')")
def as_of_nodes(spark: SparkSession, d: str) -> DataFrame:
    return R.snapshot(table(spark, d, "rlm_nodes"), ["project", "level", "subject"], "created_at", "deleted_at", ts(THEN)).select("project", "level", "subject", "id")


@query(f"SELECT project, subject, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY project, subject ORDER BY captured_at DESC, doc_id DESC) AS rk FROM documents WHERE doc_kind = 'answer' AND captured_at <= TIMESTAMPTZ '{THEN}+00') WHERE rk = 1")
def as_of_answers(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").where("doc_kind = 'answer'")
    return R.as_of(a, ["project", "subject"], "captured_at", ts(THEN), "doc_id").select("project", "subject", "doc_id")


# -- question cache -----------------------------------------------------------------------------------------------------


def _entries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "explorations")
    used = F.unix_millis("updated_at")
    return e.select("id", "project", F.col("goal").alias("question"), F.col("access_count"), used.alias("used_ms"), (F.coalesce("status", F.lit("stale")) != "fresh").alias("stale"))


def _questions(spark: SparkSession, d: str, part: int = 1) -> DataFrame:
    return table(spark, d, "persist_exploration_request").where(F.col("request_id") % part == 0).select(F.col("request_id").alias("query_id"), "project", F.col("goal").alias("question"))


_HASH = r"sha256(lower(regexp_replace({0}, '\s+', '', 'g')))"
_LIVE = f"live AS (SELECT id, project, goal, {_HASH.format('goal')} AS hash FROM explorations WHERE coalesce(status, 'stale') = 'fresh')"
_TOK = D.tokens_sql("{0}")


@query(f"WITH {_LIVE}, h AS (SELECT project, hash, min(id) AS id FROM live GROUP BY ALL) SELECT request_id AS query_id, h.id FROM persist_exploration_request r LEFT JOIN h ON h.project = r.project AND h.hash = {_HASH.format('r.goal')}")
def qa_exact_hit(spark: SparkSession, d: str) -> DataFrame:
    return Q.exact_hits(_questions(spark, d), _entries(spark, d))


_COS_V = "round(greatest(least(list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0}) * list_dot_product({1}, {1})), 1), -1), 6)"
_NEAR = f"""{_LIVE}, {D.USABLE_SQL}, qv AS (SELECT id AS query_id, v FROM uv WHERE id % 50 = 0),
sim AS (SELECT query_id, l.id, {_COS_V.format("qv.v", "uv.v")} AS similarity FROM qv CROSS JOIN live l JOIN uv ON uv.id = l.id WHERE query_id <> l.id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rk FROM sim) WHERE rk = 1)"""


def _near(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d).join(D.usable_vectors(spark, d), "id")
    return Q.nearest(D.usable_queries(spark, d).withColumnRenamed("buffer", "project"), e, same_project=False)


@query(f"WITH {_NEAR} SELECT query_id, id, similarity FROM near")
def qa_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d)


_TIER = "CASE WHEN s >= 0.9 THEN 0 WHEN s >= 0.8 THEN 1 WHEN s >= 0.7 THEN 2 WHEN s >= 0.6 THEN 3 WHEN s >= 0.5 THEN 4 END"
_PLAN = f"SELECT *, (s < 0.4 OR {_TIER} IS NULL OR j < 0.5) AS miss, {_TIER} AS t FROM"
_PLAN_COLS = "CASE WHEN miss THEN -1 ELSE t END AS tier, CASE WHEN miss THEN 20 ELSE [10, 12, 13, 15, 18][t + 1] END AS digest_k, CASE WHEN miss THEN 10 ELSE [5, 6, 7, 8, 10][t + 1] END AS provenance_k"


_CHUNKS_OF = "SELECT a.id AS {0}, b.id AS chunk FROM (SELECT * FROM (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY " + _COS_V.format("a.v", "b.v") + " DESC, b.id) AS rk FROM {1} a JOIN uv b ON a.id <> b.id) WHERE rk <= 10) a JOIN (SELECT id FROM uv) b ON b.id = a.other"


@query(
    f"""WITH {_NEAR}, qq AS (SELECT qv.query_id, e.project, {_HASH.format('e.goal')} AS hash FROM qv LEFT JOIN explorations e ON e.id = qv.query_id), h AS (SELECT project, hash, min(id) AS id FROM live GROUP BY ALL),
intact AS (SELECT id FROM live WHERE id % 5 <> 0), nq AS (SELECT query_id AS id, v FROM qv), ne AS (SELECT DISTINCT near.id, uv.v FROM near JOIN uv USING (id)),
now AS ({_CHUNKS_OF.format("query_id", "nq")}), was AS ({_CHUNKS_OF.format("id", "ne")}),
jac AS (SELECT n.query_id, n.id, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS j FROM near n JOIN (SELECT query_id, list(chunk) AS a FROM now GROUP BY query_id) USING (query_id) JOIN (SELECT id, list(chunk) AS b FROM was GROUP BY id) w ON w.id = n.id),
x AS (SELECT q.query_id, CASE WHEN h.id IN (SELECT id FROM intact) THEN h.id END AS exact_id, n.id AS near_id, coalesce(n.similarity, 0) AS s, coalesce(n.j, 0) AS j FROM qq q LEFT JOIN h ON h.project = q.project AND h.hash = q.hash LEFT JOIN (SELECT near.query_id, near.id, similarity, j FROM near JOIN jac ON jac.query_id = near.query_id WHERE near.id IN (SELECT id FROM intact)) n ON n.query_id = q.query_id),
p AS ({_PLAN} x)
SELECT query_id, CASE WHEN exact_id IS NOT NULL THEN exact_id WHEN NOT miss THEN near_id END AS id, CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN NOT miss THEN 'near' ELSE 'miss' END AS outcome, {_PLAN_COLS} FROM p"""
)
def qa_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Questions by vector: results now and sources then are the ten nearest vectors; entries with an id divisible by 5 have lost a source."""
    entries, vectors = _entries(spark, d), D.usable_vectors(spark, d).withColumn("buffer", F.lit(""))
    q = D.usable_queries(spark, d)
    questions = q.select("query_id").join(table(spark, d, "explorations").select(F.col("id").alias("query_id"), "project", F.col("goal").alias("question")), "query_id", "left")
    near = cut_lineage(_near(spark, d))
    results = S.vector_search(q, vectors, 10, "cosine").select("query_id", F.col("id").alias("chunk"))
    asked = vectors.join(near.select("id").distinct(), "id").select(F.col("id").alias("query_id"), "buffer", "vector")
    sources = S.vector_search(asked, vectors, 10, "cosine").select(F.col("query_id").alias("id"), F.col("id").alias("chunk"))
    jaccards = Q.overlaps(near, results, sources)
    return Q.lookup(questions, entries, entries.where("not stale and id % 5 <> 0"), near, jaccards)


@query(
    f"""WITH old AS (SELECT id, project, {_HASH.format('goal')} AS hash, 1 AS version FROM explorations WHERE goal IS NOT NULL), new AS (SELECT 1000000000 + request_id AS id, project, {_HASH.format('goal')} AS hash FROM persist_exploration_request WHERE goal IS NOT NULL),
base AS (SELECT project, hash, max(version) AS v FROM old GROUP BY ALL)
SELECT o.id, o.project, o.hash, CAST(o.version AS BIGINT) AS version, (SELECT min(n.id) FROM new n WHERE n.project IS NOT DISTINCT FROM o.project AND n.hash = o.hash AND o.project IS NOT NULL) AS superseded_by FROM old o
UNION ALL SELECT n.id, n.project, n.hash, CAST(coalesce(v, 0) + row_number() OVER (PARTITION BY n.project, n.hash ORDER BY n.id) AS BIGINT), lead(n.id) OVER (PARTITION BY n.project, n.hash ORDER BY n.id) FROM new n LEFT JOIN base b ON b.project = n.project AND b.hash = n.hash"""
)
def qa_store(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "explorations").where("goal is not null")
    entries = e.select("id", "project", T.question_hash(F.col("goal")).alias("hash"), F.lit(1).cast("long").alias("version"), F.lit(None).cast("long").alias("superseded_by"), F.lit(0).cast("long").alias("stored_ms"))
    answers = table(spark, d, "persist_exploration_request").select((F.lit(1_000_000_000) + F.col("request_id")).alias("id"), "project", F.col("goal").alias("question"))
    return Q.store_answers(entries, answers, D.NOW_MS).drop("stored_ms")


@query(f"WITH x AS (SELECT event_id, value / 100 AS s, (event_id % 10) / 10.0::DOUBLE AS j FROM events), p AS ({_PLAN} x) SELECT event_id, miss AS is_miss, {_PLAN_COLS} FROM p")
def qa_plan_tiers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", scores.qa_plan(F.col("value") / 100, (F.col("event_id") % 10) / 10).alias("p"))
    return e.select("event_id", "p.is_miss", "p.tier", "p.digest_k", "p.provenance_k")


@query(
    f"""SELECT project, id FROM (SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY round(access_count / (1 + greatest({D.NOW_MS} - epoch_ms(updated_at), 0) / 86400000.0::DOUBLE), 9), id) AS rk, count(*) OVER (PARTITION BY project) AS n FROM explorations) WHERE rk <= n - 5"""
)
def qa_evict(spark: SparkSession, d: str) -> DataFrame:
    return Q.evictions(_entries(spark, d), 5, 86_400_000, D.NOW_MS)


@query("SELECT DISTINCT id FROM (SELECT b.vec_id AS id, round(" + _COS + ", 6) AS similarity " + _PAIRS + ") WHERE similarity >= 0.3")
def qa_radius_invalidate(spark: SparkSession, d: str) -> DataFrame:
    return S.within_radius(D.vector_queries(spark, d), D.vectors(spark, d), 0.3).select("id").distinct()


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rlm_nodes").withColumn("hashes", F.coalesce(F.from_json("source_hashes", "array<string>"), F.array().cast("array<string>")))


_HASHES = "nodes AS (SELECT *, CASE WHEN json_valid(source_hashes) THEN CAST(json_extract_string(source_hashes, '$[*]') AS VARCHAR[]) ELSE [] END AS hashes FROM rlm_nodes)"


@query(f"WITH {_HASHES}, changed AS (SELECT DISTINCT unnest(hashes) AS h FROM nodes WHERE id % 3 = 0) SELECT DISTINCT id FROM (SELECT id, unnest(hashes) AS h FROM nodes WHERE deleted_at IS NULL) WHERE h IN (SELECT h FROM changed)")
def stale_by_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that rest on a hash of which a third of the nodes' sources changed."""
    n = _nodes(spark, d)
    return Q.stale_by_hashes(n.where("deleted_at is null"), n.where("id % 3 = 0").select(F.explode("hashes").alias("hash")))


@query(
    f"""WITH {_HASHES}, cur AS (SELECT DISTINCT unnest(hashes) AS h FROM nodes WHERE review_status = 'approved'), x AS (SELECT DISTINCT id, unnest(hashes) AS h FROM nodes)
SELECT n.id, count(x.h) AS n_hashes, count(x.h) - count(cur.h) AS n_missing, count(x.h) = count(cur.h) AS intact FROM nodes n LEFT JOIN x ON x.id = n.id LEFT JOIN cur ON cur.h = x.h GROUP BY n.id"""
)
def provenance_check(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return Q.provenance(n, n.where("review_status = 'approved'").select(F.explode("hashes").alias("hash")))


# -- graph, queue, trust ------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_HASHES}, u AS (SELECT DISTINCT project, unnest(hashes) AS h FROM nodes WHERE level = 1), k AS (SELECT DISTINCT project, unnest(hashes) AS h FROM nodes WHERE level = 2)
SELECT *, ratio > 0.3 AS enqueue FROM (SELECT u.project, count(*) AS n_union, count(k.h) AS n_kept, round(1 - count(k.h)::DOUBLE / count(*), 6) AS ratio FROM u LEFT JOIN k ON k.project = u.project AND k.h = u.h GROUP BY u.project)"""
)
def cascade_change_ratio(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return G.change_ratio(n.where("level = 1"), n.where("level = 2"), ["project"])


_THEME = "CASE WHEN contains(subject, '/') THEN split_part(subject, '/', 1) WHEN subject IS NOT NULL THEN '(root)' END"


@query(
    f"""WITH {_HASHES}, n AS (SELECT *, {_THEME} AS theme, deleted_at IS NOT NULL AS stale FROM nodes WHERE review_status <> 'rejected'),
have AS (SELECT project, level, subject, max_by(id, id) AS id FROM n WHERE level > 1 GROUP BY ALL), hv AS (SELECT h.project, h.level, h.subject, n.hashes, n.stale FROM have h JOIN n USING (id)),
kids AS (SELECT project, 2 AS level, theme AS subject, hashes FROM n WHERE level = 1 UNION ALL SELECT project, 3, project, hashes FROM n WHERE level = 2),
u AS (SELECT DISTINCT project, level, subject, h FROM (SELECT project, level, subject, unnest(CASE WHEN len(hashes) = 0 THEN [NULL] ELSE hashes END) AS h FROM kids)),
k AS (SELECT DISTINCT project, level, subject, unnest(hashes) AS h FROM hv),
g AS (SELECT u.project, u.level, u.subject, count(u.h) AS n_union, count(k.h) AS n_kept FROM u LEFT JOIN k ON k.project = u.project AND k.level = u.level AND k.subject = u.subject AND k.h = u.h GROUP BY ALL),
r AS (SELECT g.*, round(1 - n_kept::DOUBLE / greatest(n_union, 1), 6) AS ratio, hv.subject IS NULL OR hv.stale AS must FROM g LEFT JOIN hv ON hv.project = g.project AND hv.level = g.level AND hv.subject = g.subject),
due AS (SELECT DISTINCT project FROM r WHERE level = 2 AND (must OR ratio > 0.3))
SELECT project, CAST(level AS INTEGER) AS level, subject, n_union, n_kept, ratio, CASE WHEN level = 2 THEN must OR ratio > 0.3 ELSE must OR ratio > 0.5 OR project IN (SELECT project FROM due WHERE project IS NOT NULL) END AS enqueue FROM r"""
)
def cascade_levels(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d).select("id", "project", "level", "subject", "hashes", (F.col("review_status") == "rejected").alias("rejected"), F.col("deleted_at").isNotNull().alias("stale"))
    return G.cascade(n, T.theme_of(F.col("subject")))


_EDGES = "edges AS (SELECT id AS child, CASE WHEN level = 1 THEN max(CASE WHEN level = 2 THEN id END) OVER w WHEN level = 2 THEN max(CASE WHEN level = 3 THEN id END) OVER w END AS parent FROM rlm_nodes WINDOW w AS (PARTITION BY project ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query(f"WITH RECURSIVE {_EDGES}, a AS (SELECT child AS seed, parent AS ancestor FROM edges JOIN rlm_nodes ON id = child AND level = 1 WHERE parent IS NOT NULL UNION SELECT a.seed, e.parent FROM a JOIN edges e ON e.child = a.ancestor WHERE e.parent IS NOT NULL) SELECT * FROM a")
def dag_ancestors(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "rlm_nodes")
    return G.ancestors(G.parents(n), n.where("level = 1").select("id"))


@query("SELECT project, level, count(*) AS nodes, CAST(count_if(review_status = 'approved' AND deleted_at IS NULL) AS BIGINT) AS servable, CAST(count_if(review_status = 'pending') AS BIGINT) AS pending FROM rlm_nodes GROUP BY ALL")
def node_review(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "rlm_nodes")
    ok = (F.col("review_status") == "approved") & F.col("deleted_at").isNull()
    return n.groupBy("project", "level").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(ok).alias("servable"), F.count_if(F.col("review_status") == "pending").alias("pending"))


@query(
    """WITH RECURSIVE j AS (SELECT o_orderkey AS job_id, o_custkey, row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O'),
a AS (SELECT list(o_custkey ORDER BY n) AS grp, list(job_id ORDER BY n) AS ids FROM j),
w AS (SELECT c_custkey AS worker, row_number() OVER (ORDER BY c_custkey) AS i FROM customer WHERE c_acctbal >= 0),
r AS (SELECT 0::BIGINT AS i, 0::BIGINT AS worker, 1::BIGINT AS p, []::BIGINT[] AS skipped, 0::BIGINT AS pick
  UNION ALL SELECT i, worker, greatest(p, pick + 1), list_filter(list_concat(skipped, range(p, pick)), lambda x: x <> pick), pick FROM (
    SELECT w.i, w.worker, r.p, r.skipped, list_filter(list_concat(r.skipped, range(r.p, least(r.p + 60, len(a.grp) + 1))), lambda x: a.grp[x] <> w.worker)[1] AS pick FROM r JOIN w ON w.i = r.i + 1 CROSS JOIN a))
SELECT worker, ids[pick] AS job_id FROM r CROSS JOIN a WHERE i > 0 AND pick IS NOT NULL"""
)
def job_claim(spark: SparkSession, d: str) -> DataFrame:
    """Every customer, those in debt banned, claims an open order; not one of the group it is excluded from."""
    jobs = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("group"), F.col("o_orderpriority").alias("priority"), F.lit(0).alias("level"), F.col("o_orderdate").alias("created"))
    c = table(spark, d, "customer")
    return G.claims(jobs, c.select(F.col("c_custkey").alias("worker")), excluded=c.select(F.col("c_custkey").alias("worker"), F.col("c_custkey").alias("group")), banned=c.where("c_acctbal < 0").select(F.col("c_custkey").alias("worker")))


_EVENTS = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in (("view", "claim"), ("click", "enqueue"), ("purchase", "complete"), ("error", "fail"))) + " ELSE 'cancel' END"
_MOVE = """CASE WHEN e = 'claim' AND a.s = 'pending' THEN {'g': a.g, 's': 'claimed', 'n': a.n + 1} WHEN e = 'complete' AND a.s = 'claimed' THEN {'g': a.g, 's': 'done', 'n': a.n}
WHEN e = 'fail' AND a.s = 'claimed' THEN {'g': a.g, 's': CASE WHEN a.n >= 3 THEN 'parked' ELSE 'pending' END, 'n': a.n} WHEN e = 'cancel' AND a.s <> 'done' OR e = 'enqueue' AND a.s = 'done' THEN {'g': a.g + 1, 's': 'pending', 'n': 0} ELSE a END"""


@query(
    f"""WITH RECURSIVE ev AS (SELECT user_id, {_EVENTS} AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, 0::BIGINT AS i, {{'g': 0::BIGINT, 's': 'pending', 'n': 0}} AS a FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT r.user_id, ev.i, {_MOVE} FROM r JOIN ev ON ev.user_id = r.user_id AND ev.i = r.i + 1)
SELECT user_id AS job_id, a.g AS generation, a.s AS status, CAST(a.n AS INTEGER) AS attempts FROM (SELECT user_id, max_by(a, i) AS a FROM r GROUP BY user_id)"""
)
def job_states(spark: SparkSession, d: str) -> DataFrame:
    """Jobs after all their events; kinds of events stand for steps of a job."""
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), "event_id", F.expr(_EVENTS).alias("event"))
    return G.finished(e)


@query("SELECT id FROM explorations WHERE status = 'pending_review' ORDER BY coalesce(created_by = 'pell', false) DESC, created_at, id LIMIT 10")
def qa_job_claim(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "explorations").where("status = 'pending_review'").select("id", F.col("created_by").alias("preferred"), F.col("created_at").alias("created"))
    return Q.claim_order(jobs, "pell", 10).select("id")


_JUNE = 1718409600000


@query(f"SELECT level, count(*) AS n FROM claim_rlm_job_response WHERE epoch_ms(claimed_at) + lease_ms < {_JUNE} GROUP BY level")
def lease_expired(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "claim_rlm_job_response").select("level", F.unix_millis("claimed_at").alias("claimed_ms"), "lease_ms")
    return G.expired(c, _JUNE).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH j AS (SELECT job_key, max(generation) AS g, max(CAST(available AS INTEGER)) AS o FROM claim_rlm_job_response GROUP BY job_key), n AS (SELECT DISTINCT 'L' || level || ':' || project || ':' || subject AS job_key FROM rlm_nodes WHERE subject IS NOT NULL)
SELECT n.job_key, CAST(CASE WHEN coalesce(o, 0) = 1 THEN g ELSE coalesce(g + 1, 0) END AS BIGINT) AS generation, coalesce(o, 0) <> 1 AS created FROM n LEFT JOIN j ON j.job_key = n.job_key"""
)
def job_enqueue(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "claim_rlm_job_response").select("job_key", "generation", F.col("available").alias("open"))
    new = table(spark, d, "rlm_nodes").where("subject is not null").select(T.job_key(F.col("level"), F.col("project"), F.col("subject")).alias("job_key"))
    return G.enqueue(jobs, new)


@query("SELECT job_id, count(*) AS attempts, CASE WHEN count(*) >= 2 THEN 'parked' ELSE 'pending' END AS state FROM claim_rlm_job_response WHERE NOT available GROUP BY job_id")
def job_failures(spark: SparkSession, d: str) -> DataFrame:
    return G.failures(table(spark, d, "claim_rlm_job_response").where("not available"), 2)


@query("SELECT project, CAST(count_if(status = 'fresh') AS BIGINT) AS fresh, CAST(count_if(status = 'stale') AS BIGINT) AS stale, CAST(count_if(status = 'retired') AS BIGINT) AS retired, CAST(count_if(status = 'pending_review') AS BIGINT) AS pending_review FROM explorations GROUP BY project")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "explorations")
    return e.groupBy("project").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("fresh", "stale", "retired", "pending_review")])


_STEPS = "list({0} ORDER BY ts, event_id)"


@query(
    f"""SELECT user_id AS user, CAST(list_reduce(list_prepend(10, {_STEPS.format("CASE WHEN event_type = 'purchase' THEN 1 ELSE -2 END")}), lambda a, x: least(greatest(a + x, 0), 10)) AS BIGINT) AS trust,
CAST(list_reduce(list_prepend(0, {_STEPS.format("CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END")}), lambda a, x: greatest(a + x, 0)) AS BIGINT) AS strikes FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id"""
)
def trust_fold(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type in ('purchase', 'error')")
    return G.trust(e.select(F.col("user_id").alias("user"), F.col("ts").alias("at"), F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("accepted")))


_CANDIDATES = f"{D.USABLE_SQL}, cand AS (SELECT a.id, a.id // 6 AS subject, a.v, a.id % 4 AS author FROM uv a)"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return D.usable_vectors(spark, d).select("id", F.expr("id div 6").alias("subject"), "vector", (F.col("id") % 4).alias("author"), (1 - (F.col("id") % 4) * 0.25).alias("trust"))


@query(
    f"""WITH RECURSIVE {_CANDIDATES}, sims AS MATERIALIZED (SELECT x.subject, x.id AS a, y.id AS b, {_COS_V.format("x.v", "y.v")} AS s FROM cand x JOIN cand y ON x.subject = y.subject AND x.id < y.id),
c AS (SELECT subject, count(*) AS n FROM cand GROUP BY subject),
cliques AS (SELECT subject, [id] AS ids, 1.0::DOUBLE AS low FROM cand UNION ALL
  SELECT q.subject, list_append(q.ids, k.id), least(q.low, (SELECT min(s) FROM sims WHERE sims.b = k.id AND list_contains(q.ids, sims.a))) FROM cliques q JOIN cand k ON k.subject = q.subject AND k.id > q.ids[-1]
  WHERE (SELECT count(*) FROM sims WHERE sims.b = k.id AND list_contains(q.ids, sims.a) AND s >= 0.3) = len(q.ids)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY len(ids) DESC, low DESC) AS rk FROM cliques WHERE len(ids) >= 2) WHERE rk = 1)
SELECT c.subject, CASE WHEN n < 3 THEN 'pending' WHEN ids IS NULL OR len(ids) < 2 * ((n - 1) // 3) + 1 THEN 'rejected' ELSE 'accepted' END AS outcome,
  CASE WHEN n >= 3 AND len(ids) >= 2 * ((n - 1) // 3) + 1 THEN len(ids) ELSE 0 END AS supporters FROM c LEFT JOIN best ON best.subject = c.subject"""
)
def quorum_decide(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of the submissions for each subject; vectors of six neighbouring ids stand for the answers to one."""
    return G.quorum(_candidates(spark, d), ["subject"], least=0.3).select("subject", "outcome", F.size("supporters").cast("long").alias("supporters"))


@query()
def quorum_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What became of every submission."""
    c = _candidates(spark, d)
    return G.after_quorum(G.quorum(c, ["subject"], least=0.3), c.drop("vector", "trust"), ["subject"]).groupBy("author", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH t AS ({SQL["trust_fold"]}) SELECT "user", trust, strikes, strikes >= 3 AS banned, row_number() OVER (ORDER BY trust DESC, strikes, "user") - 1 AS rank FROM t ORDER BY trust DESC, strikes, "user" LIMIT 20"""
)
def volunteer_list(spark: SparkSession, d: str) -> DataFrame:
    return G.standing(trust_fold(spark, d), 20).withColumn("rank", F.col("rank").cast("long"))


# -- maps ---------------------------------------------------------------------------------------------------------------


@query(
    """SELECT request_id, list_filter([CASE WHEN length(trim(coalesce(goal, ''))) = 0 THEN 'goal missing' END, CASE WHEN length(goal) > 2000 THEN 'goal too long' END, CASE WHEN length(summary) > 4000 THEN 'summary too long' END,
CASE WHEN octet_length(encode(body_markdown)) > 524288 THEN 'body too large' END, CASE WHEN len(files) > 128 THEN 'too many files' END], lambda x: x IS NOT NULL) AS problems FROM persist_exploration_request"""
)
def map_problems(spark: SparkSession, d: str) -> DataFrame:
    return P.problems(table(spark, d, "persist_exploration_request")).select("request_id", "problems")


_ANCHORS = f"""anchors AS (SELECT DISTINCT request_id AS id, project, {D._SAME.format('f')} AS path FROM (SELECT request_id, project, unnest(files) AS f FROM persist_exploration_request) WHERE trim(regexp_replace(f, '\\s+', ' ', 'g')) <> ''), cur AS (SELECT project, path, min(sha256(content)) AS hash FROM current_files GROUP BY ALL)"""


@query(f"WITH {D.CURRENT_FILES}, {_ANCHORS} SELECT a.id, a.project, a.path, hash FROM anchors a LEFT JOIN cur ON cur.project = a.project AND cur.path = a.path")
def anchors_resolved(spark: SparkSession, d: str) -> DataFrame:
    files = D.current_files(spark, d).select("project", "path", T.content_hash(F.col("content")).alias("hash"))
    return P.resolved(P.anchors(table(spark, d, "persist_exploration_request")), files)


_BROKEN = f"""{_FILES}, {_snapshot_sql("past", THEN)}, past_h AS (SELECT project, path, min(hash) AS hash FROM past_f GROUP BY ALL), now_h AS (SELECT DISTINCT project, path, sha256(content) AS hash FROM current_files),
cited AS (SELECT a.id, a.project, a.path, t.hash FROM anchors a LEFT JOIN past_h t ON t.project = a.project AND t.path = a.path),
broken AS (SELECT id, list_sort(list(path)) AS paths FROM cited c WHERE NOT EXISTS (SELECT 1 FROM now_h n WHERE n.project = c.project AND n.path = c.path AND n.hash = c.hash) GROUP BY id)"""


def _broken(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of requests as the files were at one time, against the files of now."""
    def hashed(files: DataFrame) -> DataFrame:
        return files.select("project", "path", T.content_hash(F.col("content")).alias("hash"))

    cited = P.resolved(P.anchors(table(spark, d, "persist_exploration_request")), hashed(D.newest_uploads(table(spark, d, "index_file"), THEN)))
    return P.broken(cited, hashed(D.current_files(spark, d)))


@query(f"WITH {D.CURRENT_FILES}, {_ANCHORS}, {_BROKEN} SELECT id, array_to_string(paths, '|') AS broken FROM broken")
def broken_anchors(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d).select("id", F.array_join("broken", "|").alias("broken"))


@query(
    f"""WITH {D.CURRENT_FILES}, {_ANCHORS}, {_BROKEN}, m AS (SELECT r.request_id AS id, r.project, CASE WHEN r.request_id % 4 = 0 THEN 'retired' ELSE 'fresh' END AS status, b.paths FROM persist_exploration_request r LEFT JOIN broken b ON b.id = r.request_id)
SELECT id, project, CASE WHEN status = 'fresh' AND paths IS NOT NULL THEN 'stale' ELSE status END AS status, CASE WHEN status = 'fresh' THEN len(paths) END AS reasons FROM m"""
)
def staleness_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Maps after a sweep; a quarter of them was retired before."""
    m = table(spark, d, "persist_exploration_request").select(F.col("request_id").alias("id"), "project", F.when(F.col("request_id") % 4 == 0, "retired").otherwise("fresh").alias("status"))
    return P.mark_stale(m, _broken(spark, d)).select("id", "project", "status", F.size(F.from_json("stale_reason", "array<string>")).cast("long").alias("reasons"))


@query(
    f"""WITH {D.CURRENT_FILES}, {_ANCHORS}, {_BROKEN}, e AS (SELECT project, max(epoch) AS epoch FROM explorations WHERE epoch IS NOT NULL AND project <> 'harbor-core' GROUP BY project), c AS (SELECT DISTINCT project FROM persist_exploration_request WHERE request_id IN (SELECT id FROM broken))
SELECT coalesce(e.project, c.project) AS project, CAST(coalesce(epoch, 0) + CASE WHEN c.project IS NULL THEN 0 ELSE 1 END AS BIGINT) AS epoch FROM e FULL JOIN c ON e.project = c.project"""
)
def epoch_bump(spark: SparkSession, d: str) -> DataFrame:
    """Epochs after a sweep: one more where an anchor broke."""
    e = table(spark, d, "explorations").where("epoch is not null and project <> 'harbor-core'").groupBy("project").agg(F.max("epoch").alias("epoch"))
    r = table(spark, d, "persist_exploration_request").select(F.col("request_id").alias("id"), "project")
    return P.bumped(e, r.join(_broken(spark, d), "id", "left_semi"))


@query(f"WITH {D.USABLE_SQL}, s AS (SELECT {_COS_V.format('q.v', 'u.v')} AS s FROM uv q CROSS JOIN explorations e JOIN uv u ON u.id = e.id WHERE q.id % 50 = 0 AND q.id <> e.id) SELECT CASE WHEN s >= 0.72 THEN 'strong' WHEN s >= 0.55 THEN 'related' ELSE 'none' END AS hit, count(*) AS n FROM s GROUP BY 1")
def hit_class(spark: SparkSession, d: str) -> DataFrame:
    """How near maps are to the questions asked by vector."""
    items = D.usable_vectors(spark, d).join(table(spark, d, "explorations").select("id"), "id")
    s = S.within_radius(D.usable_queries(spark, d), items, -1.0)
    return s.groupBy(scores.hit_class(F.col("similarity")).alias("hit")).agg(F.count(F.lit(1)).alias("n"))


def _all_maps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "explorations")
    now = e.groupBy("project").agg(F.max("epoch").alias("now_epoch"))
    age = F.floor((F.lit(D.NOW_MS) - F.unix_millis("updated_at")) / 86_400_000)
    return e.join(now, "project").select("id", "project", "goal", "status", "epoch", age.alias("age_days"), F.col("access_count").alias("confirmed"), F.coalesce("version", F.lit(0)).alias("contradicted"), "now_epoch")


def _near_maps(spark: SparkSession, d: str) -> DataFrame:
    items = D.usable_vectors(spark, d).join(table(spark, d, "explorations").select("id", F.col("project").alias("buffer")), "id")
    return S.vector_search(D.usable_queries(spark, d), items, 8, "cosine").select("query_id", "id", F.col("score").alias("similarity"), "rank")


_BAD = "SELECT DISTINCT e.id FROM explorations e JOIN persist_exploration_request r ON r.project = e.project AND r.goal = e.goal JOIN broken b ON b.id = r.request_id"


def _bad_maps(spark: SparkSession, d: str) -> DataFrame:
    """Maps of which a request with the same goal has a broken anchor."""
    r = table(spark, d, "persist_exploration_request").select(F.col("request_id").alias("_r"), "project", "goal").join(_broken(spark, d).select(F.col("id").alias("_r")), "_r", "left_semi")
    return table(spark, d, "explorations").select("id", "project", "goal").join(r.select("project", "goal").distinct(), ["project", "goal"], "left_semi").select("id")


def _search_sql(revision: str, gate: str) -> str:
    return f"""WITH {D.CURRENT_FILES}, {_ANCHORS}, {_BROKEN}, bad AS ({_BAD}), {D.USABLE_SQL}, nowe AS (SELECT project, max(epoch) AS now FROM explorations GROUP BY project),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rk FROM (SELECT q.id AS query_id, e.id, e.project, e.goal, {_COS_V.format("q.v", "u.v")} AS s FROM uv q CROSS JOIN explorations e JOIN uv u ON u.id = e.id WHERE q.id % 50 = 0 AND q.id <> e.id)) WHERE rk <= 8),
m AS ({revision}), g AS (SELECT m.*, n.now FROM m JOIN nowe n ON n.project = m.project WHERE coalesce(status, '') NOT IN ('retired', 'pending_review') {gate}),
sc AS (SELECT query_id, id, CASE WHEN s >= 0.72 THEN 'strong' WHEN s >= 0.55 THEN 'related' ELSE 'none' END AS hit, round(least(greatest(least(greatest(s, 0), 1) * greatest(1 - 0.1::DOUBLE * greatest(coalesce(now, 0) - coalesce(epoch, now, 0), 0), 0.25::DOUBLE)
  * greatest(1 - 0.3::DOUBLE * (floor(({D.NOW_MS} - epoch_ms(updated_at)) / 86400000.0::DOUBLE) / 90.0::DOUBLE), 0.4::DOUBLE) + 0.1::DOUBLE * (CASE WHEN access_count + coalesce(version, 0) = 0 THEN 0 ELSE (access_count - coalesce(version, 0))::DOUBLE / (access_count + coalesce(version, 0)) END), 0), 1), 6) AS confidence FROM g)
SELECT query_id, id, hit, confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, id) - 1 AS rank FROM sc WHERE hit <> 'none') WHERE rank < 5"""


_NOW_REV = "SELECT near.query_id, near.s, e.* FROM near JOIN explorations e ON e.id = near.id"


@query(_search_sql(_NOW_REV, "AND status = 'fresh' AND id NOT IN (SELECT id FROM bad)"))
def exploration_search(spark: SparkSession, d: str) -> DataFrame:
    return P.search(_near_maps(spark, d), _all_maps(spark, d), _bad_maps(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query(_search_sql(_NOW_REV, ""))
def exploration_search_stale(spark: SparkSession, d: str) -> DataFrame:
    return P.search(_near_maps(spark, d), _all_maps(spark, d), _bad_maps(spark, d), include_stale=True).withColumn("rank", F.col("rank").cast("long"))


@query(_search_sql("SELECT near.query_id, max(near.s) AS s, any_value(e) AS x, e.id AS rid FROM near JOIN (SELECT *, row_number() OVER (PARTITION BY project, goal ORDER BY epoch DESC, id DESC) AS rv FROM explorations WHERE epoch <= 20) e ON e.rv = 1 AND e.project = near.project AND e.goal = near.goal GROUP BY near.query_id, e.id", "").replace("m AS (SELECT near.query_id, max", "mm AS (SELECT near.query_id, max").replace(", g AS (SELECT m.*", ", m AS (SELECT mm.query_id, mm.s, e.* FROM mm JOIN explorations e ON e.id = mm.rid), g AS (SELECT m.*"))
def exploration_search_as_of(spark: SparkSession, d: str) -> DataFrame:
    return P.search(_near_maps(spark, d), _all_maps(spark, d), _bad_maps(spark, d), include_stale=True, as_of=20).withColumn("rank", F.col("rank").cast("long"))


@query(
    """SELECT user_id AS id, CAST(count_if(event_type = 'purchase') AS BIGINT) AS confirmed, CAST(count_if(event_type = 'error') AS BIGINT) AS contradicted, max(CASE WHEN event_type = 'error' AND rk = 3 THEN ts END) AS retired_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rk FROM events WHERE event_type IN ('purchase', 'error')) GROUP BY user_id"""
)
def feedback_retire(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type in ('purchase', 'error')")
    return P.feedback(e.select(F.col("user_id").alias("id"), F.col("ts").alias("at"), "event_id", (F.col("event_type") == "error").alias("contradicts")))


# -- maintenance --------------------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM (SELECT doc_id, max(doc_id) OVER (PARTITION BY source, sha256(text)) AS newest FROM documents WHERE text IS NOT NULL) WHERE doc_id < newest")
def dedup_keep_newest(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").where("text is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), T.content_hash(F.col("text")).alias("hash"))
    return M.duplicates(r, ["source", "hash"], "doc_id")


@query("SELECT event_type, user_id, round(avg(value) / 100, 6) AS confidence FROM events GROUP BY ALL HAVING round(avg(value) / 100, 6) < 0.3")
def low_confidence_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.round(F.avg("value") / 100, 6).alias("confidence"))
    return p.where("confidence < 0.3")


@query(f"SELECT chunk_id FROM (SELECT chunk_id, ({D.NOW_MS} - epoch_ms(max(returned_at))) / 3600000.0::DOUBLE AS h FROM search_result GROUP BY chunk_id) WHERE exp(-0.001 * greatest(h, 0)) < 0.1")
def decay_purge(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "search_result").groupBy("chunk_id").agg(F.max("returned_at").alias("at"))
    return M.decayed_away(last, (F.lit(D.NOW_MS) - F.unix_millis("at")) / 3_600_000.0, 0.001, 0.1).select("chunk_id")


@query(f"SELECT file_id FROM index_file WHERE deleted_at < TIMESTAMPTZ '{LATER}+00' - INTERVAL 7 DAYS")
def retention_purge(spark: SparkSession, d: str) -> DataFrame:
    return M.outdated(table(spark, d, "index_file"), "deleted_at", LATER, 7).select("file_id")


_REC = f"power(0.5::DOUBLE, least(greatest({D.NOW_MS} - epoch_ms({{0}}), 0), 4294967295) / 2592000000.0::DOUBLE)"


@query(f"SELECT id, round((0.6::DOUBLE * {_REC.format('updated_at')} + 0.3::DOUBLE * (1 - 1 / (1 + access_count::DOUBLE)) + 0.1::DOUBLE * {_REC.format('created_at')}) / 1.0::DOUBLE, 6) AS salience FROM explorations")
def salience(spark: SparkSession, d: str) -> DataFrame:
    s = scores.salience(F.unix_millis("created_at"), F.unix_millis("updated_at"), F.col("access_count"), F.lit(D.NOW_MS))
    return table(spark, d, "explorations").select("id", F.round(s, 6).alias("salience"))


@query(f"WITH {D.CURRENT_FILES} SELECT file_id, path, 999 AS buffer FROM current_files WHERE project = 'harbor-core' AND {D.LANGUAGE_SQL.format('path')} IN ('rust', 'python') ORDER BY file_id LIMIT 1000")
def transfer_capped(spark: SparkSession, d: str) -> DataFrame:
    f = D.current_files(spark, d).where("project = 'harbor-core'").withColumn("language", T.infer_language(F.col("path")))
    return M.transfer(f, 999, ["rust", "python"], 1000, id_col="file_id").select("file_id", "path", "buffer")


@query("SELECT id, subject FROM rlm_nodes WHERE project = 'harbor-core' AND subject IN (SELECT subject FROM rlm_nodes WHERE project <> 'harbor-core')")
def common_names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "rlm_nodes").select("id", "project", F.col("subject").alias("name"))
    return M.common_names(n.where("project = 'harbor-core'"), n.where("project <> 'harbor-core'")).select("id", F.col("name").alias("subject"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk <= 5")
def history_recent(spark: SparkSession, d: str) -> DataFrame:
    return M.newest_per(table(spark, d, "events"), "user_id", "ts", "event_id", 5).select("user_id", "event_id")


@query("SELECT event_id, ts FROM events WHERE event_type = 'error' AND user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 20")
def audit_filter(spark: SparkSession, d: str) -> DataFrame:
    return M.recent(M.where_given(table(spark, d, "events"), event_type="error", user_id=7, value=None), "ts", "event_id", 20).select("event_id", "ts")


@query(
    """SELECT c_mktsegment AS agent, count(DISTINCT o_orderkey) AS runs, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cost_cents, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens, round(avg(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))), 4) AS avg_days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"""
)
def agent_cost_report(spark: SparkSession, d: str) -> DataFrame:
    li, o, c = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    j = li.select("l_orderkey", "l_extendedprice", "l_quantity", "l_shipdate").join(o.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("c_mktsegment").alias("agent")).agg(F.count_distinct("o_orderkey").alias("runs"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cost_cents"), F.sum(F.col("l_quantity").cast("long")).alias("tokens"), F.round(F.avg(days), 4).alias("avg_days"))


@query("SELECT project, count(*) AS files, CAST(count_if(deleted_at IS NOT NULL) AS BIGINT) AS deleted, CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes FROM index_file GROUP BY project")
def project_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "index_file").groupBy("project").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"), F.sum(F.octet_length("content").cast("long")).alias("bytes"))


@query("SELECT event_type, user_id, count(*) AS hits FROM events GROUP BY ALL")
def result_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    old = e.where("event_id % 2 = 0").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("hits"))
    return R.upsert_counter(old, e.where("event_id % 2 = 1"), ["event_type", "user_id"], "hits")


@query("SELECT count(*) AS rows, count(DISTINCT file_id) AS ids, CAST(count_if(file_id IS NULL) AS BIGINT) AS nulls FROM index_file")
def integrity(spark: SparkSession, d: str) -> DataFrame:
    return M.integrity(table(spark, d, "index_file"), "file_id")


# -- evaluation ---------------------------------------------------------------------------------------------------------

_REL = "rel AS (SELECT a.vec_id AS query_id, b.vec_id AS id, 1 + b.vec_id % 2 AS gain FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND a.label = b.label)"


def _metrics_sql(name: str, score: str) -> str:
    ranked = _ranked(f"SELECT a.vec_id AS query_id, b.vec_id AS id, round({score}, 6) AS score {_PAIRS}", 10)
    return f"""{name}_h AS (SELECT r.query_id, r.rank, gain FROM ({ranked}) r JOIN rel USING (query_id, id)),
{name} AS (SELECT t.query_id, round(coalesce(n::DOUBLE / total, 0), 6) AS recall, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(coalesce(1.0::DOUBLE / (first + 1), 0), 6) AS rr FROM (SELECT query_id, count(*) AS total FROM rel GROUP BY query_id) t
  JOIN (SELECT query_id, sum((power(2.0, gain) - 1) / log2(r + 2.0)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, id) - 1 AS r FROM rel) WHERE r < 10 GROUP BY query_id) USING (query_id)
  LEFT JOIN (SELECT query_id, count(*) AS n, sum((power(2.0, gain) - 1) / log2(rank + 2.0)) AS dcg, min(rank) AS first FROM {name}_h GROUP BY query_id) USING (query_id))"""


def _relevant(spark: SparkSession, d: str) -> DataFrame:
    q = D.vector_queries(spark, d).select("query_id", "buffer")
    return D.vectors(spark, d).join(S.small(q), "buffer").where("id <> query_id").select("query_id", "id", (1 + F.col("id") % 2).alias("gain"))


def _metrics(spark: SparkSession, d: str, metric: str) -> DataFrame:
    return E.metrics(S.vector_search(D.vector_queries(spark, d), D.vectors(spark, d), 10, metric), _relevant(spark, d), 10)


@query(f"WITH {_REL}, {_metrics_sql('m', '1 / (1 + ' + _L2 + ')')} SELECT * FROM m")
def recall_ndcg_mrr(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d, "l2")


@query()
def embedder_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The two embedders: recall, gain and reciprocal rank of finding maps of the same goal by the vectors of their summaries."""
    e = table(spark, d, "explorations").where("summary is not null and goal is not null").select("id", "goal", "summary")
    q = e.where("id % 50 = 0")
    relevant = S.small(q.select(F.col("id").alias("query_id"), "goal")).join(e.select("id", "goal"), "goal").where("id <> query_id").select("query_id", "id", F.lit(1).alias("gain"))
    found = {}
    for method in ("hash", "digest"):
        items = cut_lineage(spread(e.select("id", "summary")).select("id", F.lit("").alias("buffer"), vectors.embed(F.col("summary"), 64, method).alias("vector")))
        found[method] = E.metrics(S.vector_search(items.where("id % 50 = 0").withColumnRenamed("id", "query_id"), items, 10, "cosine"), relevant, 10)
    return E.compare(found)


# -- flows in batch form ------------------------------------------------------------------------------------------------


@query(
    """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS s FROM events)) GROUP BY user_id, g"""
)
def session_debounce(spark: SparkSession, d: str) -> DataFrame:
    return flows.sessions(table(spark, d, "events"), "user_id", "ts", "6 hours")


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT event_id, user_id, i, ts AS start, 1 AS n FROM e WHERE i = 1
  UNION ALL SELECT e.event_id, e.user_id, e.i, CASE WHEN e.ts - r.start >= INTERVAL 24 HOURS THEN e.ts ELSE r.start END, CASE WHEN e.ts - r.start >= INTERVAL 24 HOURS THEN 1 ELSE r.n + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT event_id AS id, user_id AS "user", n <= 2 AS allowed FROM r"""
)
def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    """Requests let through or refused by a window that begins with a user's first request."""
    return flows.rate_limited(table(spark, d, "events").select(F.col("user_id").alias("user"), F.col("ts").alias("at"), F.col("event_id").alias("id")), 2, 24 * 3600)
