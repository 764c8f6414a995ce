"""Queries of record and vector keeping, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark import base as D
from kbspark.functions import scores
from kbspark.operators import store as K
from kbspark.session import table
from kbspark.sources import scan

QUERIES: dict = {}
SQL: dict[str, str] = {}
LIMITS = [("osprey", 32000), ("osprey-13b", 64000), ("lark", 200000)]
PRICES = [("osprey-13b", 1.5), ("lark-small-2", 0.25), ("lark-medium-2", 3.0)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT id, sha256(subject || chr(10) || summary_text) AS input FROM rlm_nodes WHERE subject IS NOT NULL AND summary_text IS NOT NULL")
def embed_inputs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "rlm_nodes").where("subject is not null and summary_text is not null")
    return K.embed_inputs(n, "id", "subject", "summary_text").select("id", F.sha2("input", 256).alias("input"))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN 1.0 ELSE round(CAST(embedding[1] AS DOUBLE), 6) END AS first FROM embeddings")
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    v = D.vectors(spark, d).select("id", "vector")
    new = v.where("id % 7 = 0").withColumn("vector", F.array_repeat(F.lit(1.0).cast("float"), 64))
    return K.upsert_vectors(v, new, 64).select("id", F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


@query("SELECT doc_id AS id, 'pending' AS state FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'surplus' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def vector_reconcile(spark: SparkSession, d: str) -> DataFrame:
    r, v = D.documents(spark, d), D.vectors(spark, d)
    return K.pending(r, v).withColumn("state", F.lit("pending")).unionByName(K.surplus(r, v).withColumn("state", F.lit("surplus")))


@query("SELECT CAST(i AS INTEGER) AS pos, doc_id AS id, source AS buffer FROM (SELECT unnest(range(0, 400)) AS i) JOIN documents ON doc_id = 1600 - 4 * i")
def hydrate_in_order(spark: SparkSession, d: str) -> DataFrame:
    return K.in_order([1600 - 4 * i for i in range(400)], D.documents(spark, d)).select("pos", "id", "buffer")


@query(
    """WITH cur AS (SELECT file_id AS id, sha256(content) AS hash FROM index_file), e AS (SELECT project AS key, file_id AS id, CASE WHEN file_id % 40 = 0 THEN 'other' ELSE sha256(content) END AS hash FROM index_file WHERE content IS NOT NULL)
SELECT e.key, bool_and(coalesce(e.hash = cur.hash, false)) AS matches FROM e LEFT JOIN cur USING (id) GROUP BY e.key"""
)
def expected_match(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "index_file").select("file_id", "project", F.sha2("content", 256).alias("hash"), "content")
    e = f.where("content is not null").select(F.col("project").alias("key"), F.col("file_id").alias("id"), F.when(F.col("file_id") % 40 == 0, "other").otherwise(F.col("hash")).alias("hash"))
    return K.all_match(e, f.select(F.col("file_id").alias("id"), "hash"))


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS state, count(*) AS events FROM events GROUP BY user_id")
def last_state(spark: SparkSession, d: str) -> DataFrame:
    return K.last_state(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type")


@query("SELECT o_orderkey AS session FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate > TIMESTAMP '1998-01-01' AND c_acctbal >= 0")
def sessions_valid(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("session"), F.col("o_custkey").alias("token_id"), F.col("o_orderdate").alias("valid_until"))
    never = F.lit(None).cast("timestamp_ntz")
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("token_id"), F.when(F.col("c_acctbal") < 0, F.lit("1990-01-01").cast("timestamp_ntz")).alias("revoked_at"), never.alias("expires_at"))
    return K.valid_sessions(s, t, F.lit("1998-01-01").cast("timestamp_ntz")).select("session")


@query(f"SELECT model, coalesce(max_by(lim, length(name)), 128000::BIGINT) AS \"limit\" FROM (SELECT DISTINCT model FROM explorations) LEFT JOIN {D.values_sql(LIMITS, 'name, lim')} ON contains(lower(model), name) GROUP BY model")
def context_limit(spark: SparkSession, d: str) -> DataFrame:
    return K.context_limits(table(spark, d, "explorations"), spark.createDataFrame(LIMITS, "name string, limit long"))


@query(f"SELECT u.model, round(tokens / 1e6 * coalesce(price, 0.0::DOUBLE), 6) AS usd FROM (SELECT model, sum(length(summary)) AS tokens FROM explorations GROUP BY model) u LEFT JOIN {D.values_sql(PRICES, 'model, price')} ON u.model = v.model")
def cost_usd(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "explorations").select("model", F.length("summary").alias("tokens"))
    return K.costs(u, spark.createDataFrame(PRICES, "model string, price double"))


@query("SELECT cache_id FROM (SELECT cache_id, row_number() OVER (PARTITION BY hash ORDER BY cached_at DESC, cache_id DESC) AS rk FROM embedding_cache) WHERE rk = 1")
def embedding_cache_newest(spark: SparkSession, d: str) -> DataFrame:
    return K.newest_by_hash(table(spark, d, "embedding_cache")).select("cache_id")


@query()
def embed_cached(spark: SparkSession, d: str) -> DataFrame:
    """Documents embedded through the cache: which were known and which are new."""
    texts = D.documents(spark, d).select("id", "text")
    cache = table(spark, d, "embedding_cache").select("hash", F.col("embedding").alias("vector"), "cached_at")
    return K.embed_cached(texts, cache, 64)[0].select("id", "hit", F.size("vector").alias("dims"))


_KEY = b"test key".ljust(64, b"\0")
_PADS = [bytes(b ^ x for b in _KEY).hex() for x in (0x5C, 0x36)]


@query(
    f"""SELECT id, sha256(unhex('{_PADS[0]}') || unhex(sha256(unhex('{_PADS[1]}') || encode(coalesce(project, '') || chr(10) || coalesce(CAST(level AS VARCHAR), '') || chr(10) || coalesce(subject, '') || chr(10) || coalesce(summary_text, ''))))) AS mac FROM rlm_nodes"""
)
def attestations(spark: SparkSession, d: str) -> DataFrame:
    """A code for every node that its content can be checked by."""
    return K.attested(table(spark, d, "rlm_nodes"), ["project", "level", "subject", "summary_text"], b"test key").select("id", "mac")


@query("SELECT event_id, least(100.0 * power(2.0, event_id % 12), 30000.0) AS wait_ms FROM events")
def backoff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", scores.backoff_ms((F.col("event_id") % 12).cast("double"), 100, 30000).alias("wait_ms"))


_LEFT_OUT = "(list_has_any(string_split(path, '/')[1 : len(string_split(path, '/')) - 1], [" + ", ".join(f"'{x}'" for x in scan.IGNORED_DIRS) + "]) OR starts_with(path, 'storage/logs/') OR " + " OR ".join(f"ends_with(lower(path), '{e}')" for e in scan.IGNORED_ENDINGS) + " OR regexp_matches(path, '(^|/)\\.'))"


@query(f"WITH {D.CURRENT_FILES} SELECT file_id, path FROM current_files WHERE NOT {_LEFT_OUT} AND NOT contains(lower(path), 'probe')")
def discover_files(spark: SparkSession, d: str) -> DataFrame:
    f = D.current_files(spark, d).select("file_id", "path", "content")
    return scan.discover(f, ["*probe*"]).select("file_id", "path")
