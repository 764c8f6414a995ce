"""The tables of the test data in the shape the operators take, and the same in SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions.chunks import chunk_lines
from kbspark.functions.porter import porter_sql
from kbspark.functions.text import FOLD_FROM, FOLD_TO, LANGUAGES
from kbspark.operators import index as I
from kbspark.operators import search as S
from kbspark.operators.orphans import same_file
from kbspark.plans.lineage import ensure_checkpoint_dir
from kbspark.sources.files import exists
from kbspark.session import table

#: Where a query needs "now" it is this moment.
NOW = "2024-09-10 00:00:00"
NOW_MS = 1725926400000
#: Outdated uploads up to so many are broadcast, so that contents need no shuffle.
BROADCAST_IDS = 1_000_000


_OPEN: dict[str, I.Index] = {}


def text_queries(spark: SparkSession, d: str) -> DataFrame:
    """The subjects of the documents whose id is divisible by 50, as questions."""
    return table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("subject").alias("text"))


def entity_queries(spark: SparkSession, d: str) -> DataFrame:
    """The parts of the same subjects as names."""
    q = text_queries(spark, d)
    return q.select("query_id", F.explode(F.split("text", "/")).alias("entity"))


def stored(spark: SparkSession, d: str, name: str) -> str:
    """A folder of this application for what is derived from a data directory, in the shared storage."""
    return f"{ensure_checkpoint_dir(spark)}/stored/{hashlib.sha256(d.encode()).hexdigest()[:16]}/{name}"


def text_index(spark: SparkSession, d: str) -> I.Index:
    """The stored index of the documents; built by the first query of an application that needs it."""
    path = stored(spark, d, "documents")
    if path not in _OPEN:
        _OPEN[path] = I.current(documents(spark, d), path)
    return _OPEN[path]


def doc_phrases(spark: SparkSession, d: str, most: int | None = 10) -> DataFrame:
    """The stored names in documents, in a row each; written by the first query that needs them."""
    path = stored(spark, d, "phrases" if most is None else f"phrases_{most}")
    if not exists(spark, f"{path}/_SUCCESS"):
        S.phrase_lists(doc_names(spark, d, most)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def chunk_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The same of the chunks of the current files."""
    path = stored(spark, d, "chunk_phrases")
    if not exists(spark, f"{path}/_SUCCESS"):
        S.entity_phrases(S.entity_index(chunks(spark, d))).repartitionByRange("phrase").sortWithinPartitions("phrase").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def doc_names(spark: SparkSession, d: str, most: int | None = 10) -> DataFrame:
    """``(id, buffer, names)``: the first ``most`` identifiers of every document, all if it is None."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", " ")
    identifier = S.IDENTIFIER.replace("+", "++")  # the same names, without going back within one
    found = F.filter(F.regexp_extract_all(plain, F.lit(identifier), 1), lambda x: F.length(x) >= 3)
    names = F.array_distinct(F.transform(found, F.lower))
    return documents(spark, d).select("id", "buffer", (names if most is None else F.slice(F.sort_array(names), 1, most)).alias("names"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as ``(id, buffer, text)``."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("buffer"), "text")


def newest_uploads(uploads: DataFrame, at: str | None = None) -> DataFrame:
    """The newest upload (until ``at``) of every project and path, if it is not deleted then.

    The newest are found without contents. Contents are shuffled only if the other uploads are too many to broadcast.
    """
    f = uploads.withColumn("path", same_file(F.col("rel_path")))
    light = f.select("file_id", "project", "path", "received_at", "deleted_at")
    gone = F.col("deleted_at").isNotNull()
    if at:
        light = light.where(F.col("received_at") <= F.lit(at).cast("timestamp"))
        f = f.where(F.col("received_at") <= F.lit(at).cast("timestamp"))
        gone = F.col("deleted_at") <= F.lit(at).cast("timestamp")
    last = light.groupBy("project", "path").agg(F.max(F.struct("received_at", "file_id", "deleted_at")).alias("r")).select("r.file_id", "r.deleted_at").where(~F.coalesce(gone, F.lit(False))).select("file_id")
    others = light.select("file_id").join(last, "file_id", "left_anti")
    if others.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return f.join(F.broadcast(others), "file_id", "left_anti")
    return f.join(last, "file_id", "left_semi")


def current_files(spark: SparkSession, d: str) -> DataFrame:
    """The newest upload of every project and path, if it is not deleted."""
    return newest_uploads(table(spark, d, "index_file")).select("file_id", "project", "buffer_id", "path", "content", "received_at")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Line chunks of the current files: ``(id, buffer, project, path, line_start, line_end, text, received_at)``."""
    c = chunk_lines(current_files(spark, d), "content")
    return c.select((F.col("file_id") * 100000 + F.col("chunk_no")).alias("id"), F.col("buffer_id").alias("buffer"), "project", "path", "line_start", "line_end", "text", "received_at")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as ``(id, buffer, vector)``."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("buffer"), F.col("embedding").alias("vector"))


def usable_vectors(spark: SparkSession, d: str) -> DataFrame:
    """``(id, vector)``: vectors of the cache with 384 finite values, not all zero. They stand for the vectors of records of the same id."""
    v = table(spark, d, "embedding_cache").select(F.col("cache_id").alias("id"), F.col("embedding").alias("vector")).where(F.size("vector") == 384)
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return v.where(F.coalesce(good, F.lit(False)))


def usable_queries(spark: SparkSession, d: str) -> DataFrame:
    """Those whose id is divisible by 50, as questions."""
    return usable_vectors(spark, d).where("id % 50 = 0").select(F.col("id").alias("query_id"), F.lit("").alias("buffer"), "vector")


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """The vectors whose id is divisible by 50."""
    return vectors(spark, d).where("id % 50 = 0").select(F.col("id").alias("query_id"), "buffer", "vector")


_SAME = r"regexp_replace(regexp_replace(replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\', '/'), '/+', '/', 'g'), '^(\./)+', '')"
SQL_TOKENS = r"list_filter(string_split(trim(regexp_replace(translate(lower({0}), '" + FOLD_FROM + "', '" + FOLD_TO + r"'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> '')"


def tokens_sql(column: str) -> str:
    return SQL_TOKENS.format(column)


DOCUMENTS_SQL = "SELECT doc_id AS id, source AS buffer, text FROM documents"


def text_sql(source: str = DOCUMENTS_SQL, p: str = "") -> str:
    """Query words by stem ``q``, and the postings of texts ``(id, buffer, text)`` by stem, in tables with a prefix."""
    return f"""{p}tok AS (SELECT id, buffer, {tokens_sql('coalesce(text, chr(32))')} AS terms FROM ({source})),
{p}qtok AS (SELECT doc_id AS query_id, unnest({tokens_sql('subject')}) AS term FROM documents WHERE doc_id % 50 = 0),
{p}voc AS (SELECT unnest(terms) AS term FROM {p}tok UNION SELECT term FROM {p}qtok), {porter_sql(p + "voc", p + "stems")},
{p}q AS (SELECT DISTINCT query_id, stem AS term FROM {p}qtok JOIN {p}stems USING (term)),
{p}posted AS (SELECT id, buffer, dl, stem AS term, count(*) AS tf FROM (SELECT id, buffer, len(terms) AS dl, unnest(terms) AS term FROM {p}tok) JOIN {p}stems USING (term) GROUP BY id, buffer, dl, stem)"""


def bm25_sql(source: str = DOCUMENTS_SQL, p: str = "") -> str:
    """``bm``: scores of all matches; ``fb``: those of documents with all words, or with any where none has all; ``fbr``: the same rounded."""
    return f"""{text_sql(source, p)}, {p}st AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avg_dl FROM {p}tok), {p}df AS (SELECT term, count(*) AS df FROM {p}posted GROUP BY term),
{p}nt AS (SELECT query_id, count(*) AS n_terms FROM {p}q GROUP BY query_id),
{p}bm AS (SELECT q.query_id, p.id, p.buffer, sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_dl)))) AS score, count(*) AS n_hit, any_value(n_terms) AS n_terms
  FROM {p}q q JOIN {p}posted p ON p.term = q.term JOIN {p}df df ON df.term = q.term JOIN {p}nt nt ON nt.query_id = q.query_id CROSS JOIN {p}st GROUP BY q.query_id, p.id, p.buffer),
{p}fb AS (SELECT * FROM {p}bm WHERE n_hit = n_terms OR (n_terms > 1 AND query_id NOT IN (SELECT query_id FROM {p}bm WHERE n_hit = n_terms))),
{p}fbr AS (SELECT query_id, id, round(score, 6) AS score FROM {p}fb)"""


TEXT_SQL = text_sql()

#: Vectors of the cache with 384 finite values, not all zero, as ``(id, v)``.
USABLE_SQL = "uv AS MATERIALIZED (SELECT cache_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embedding_cache WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 384 AND len(embedding) = 384 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"


def values_sql(rows: list[tuple], names: str) -> str:
    """Rows as a SQL table expression."""
    body = ", ".join("(" + ", ".join(f"{x}::BIGINT" if isinstance(x, int) else str(x) if isinstance(x, float) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({names})"


CURRENT_FILES = f"""current_files AS (
  SELECT file_id, project, buffer_id, path, content, received_at FROM (
    SELECT *, {_SAME.format("rel_path")} AS path, row_number() OVER (PARTITION BY project, {_SAME.format("rel_path")} ORDER BY received_at DESC, file_id DESC) AS rk FROM index_file
  ) WHERE rk = 1 AND deleted_at IS NULL
)"""
CHUNKS = (
    CURRENT_FILES
    + r""", chunk_base AS (
  SELECT *, len(ls) AS n FROM (SELECT *, string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\n\z', ''), chr(10)) AS ls FROM current_files WHERE content IS NOT NULL AND content <> '')
), chunks AS (
  SELECT file_id * 100000 + CAST(s / 45 AS BIGINT) AS id, buffer_id AS buffer, project, path, CAST(s + 1 AS INTEGER) AS line_start, CAST(least(s + 51, n) AS INTEGER) AS line_end,
         array_to_string(ls[s + 1 : s + 51], chr(10)) AS text, received_at
  FROM (SELECT *, unnest(range(0, n, 45)) AS s FROM chunk_base) WHERE s = 0 OR s + 6 < n
)"""
)
LANGUAGE_SQL = "CASE lower(nullif(regexp_extract(regexp_extract({0}, '[^/]*$'), '^.+\\.([^.]*)$', 1), '')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items()) + " END"
