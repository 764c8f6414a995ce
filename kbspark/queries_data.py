"""Queries of the general data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators import history as H
from kbspark.operators import orphans as O
from kbspark.session import table


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return O.request_references(table(spark, d, "persist_exploration_request")).unionByName(O.claim_references(table(spark, d, "claim_rlm_job_response"))).unionByName(O.supersede_references(table(spark, d, "explorations")))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return O.targets(*[table(spark, d, t) for t in ("index_file", "search_result", "rlm_nodes", "explorations")])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return O.find_orphans(_refs(spark, d), _targets(spark, d)).drop("at")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_report(_refs(spark, d), _targets(spark, d))


def _history(spark: SparkSession, d: str, attributes: list[str]) -> DataFrame:
    return H.history(table(spark, d, "search_result"), table(spark, d, "explorations"), attributes=attributes)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return H.validity(_history(spark, d, [])).select("source_table", "entity_key", "version", "valid_from", "valid_to")


def p6_history(spark: SparkSession, d: str) -> DataFrame:
    """Validity rows with the attributes of each version."""
    return H.validity(_history(spark, d, H.ATTRIBUTES), H.ATTRIBUTES)


QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p6_found": p6_found, "p6_history": p6_history}

_PATH = r"regexp_replace(regexp_replace(replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\', '/'), '/+', '/', 'g'), '^(\./)+', '')"
_P5 = rf"""
WITH refs AS (
  SELECT DISTINCT 'persist_exploration_request' AS source_table, request_id AS record_id, 'files' AS ref_field, f AS ref_value, project AS scope,
         {_PATH.format("f")} AS key, received_at AS at, 'file' AS kind
  FROM (SELECT request_id, project, received_at, unnest(files) AS f FROM persist_exploration_request) WHERE trim(regexp_replace(f, '\s+', ' ', 'g')) <> ''
  UNION ALL
  SELECT DISTINCT 'claim_rlm_job_response', claim_id, ref_field, v, '', trim(v), claimed_at, kind
  FROM (
    SELECT claim_id, claimed_at, 'chunk_ids' AS ref_field, 'chunk' AS kind, unnest(CASE WHEN json_valid(payload) THEN CAST(json_extract_string(payload, '$.chunk_ids[*]') AS VARCHAR[]) END) AS v FROM claim_rlm_job_response
    UNION ALL
    SELECT claim_id, claimed_at, 'node_ids', 'node', unnest(CASE WHEN json_valid(payload) THEN CAST(json_extract_string(payload, '$.node_ids[*]') AS VARCHAR[]) END) FROM claim_rlm_job_response
  ) WHERE trim(v) <> ''
  UNION ALL
  SELECT 'explorations', id, 'superseded_by', CAST(superseded_by AS VARCHAR), '', CAST(superseded_by AS VARCHAR), updated_at, 'exploration' FROM explorations WHERE superseded_by IS NOT NULL
), targets AS (
  SELECT 'file' AS kind, project AS scope, {_PATH.format("rel_path")} AS key, received_at AS s, deleted_at AS e FROM index_file
  UNION ALL SELECT 'chunk', '', CAST(chunk_id AS VARCHAR), min(returned_at), NULL FROM search_result GROUP BY chunk_id
  UNION ALL SELECT 'node', '', CAST(id AS VARCHAR), created_at, deleted_at FROM rlm_nodes
  UNION ALL SELECT 'exploration', '', CAST(id AS VARCHAR), created_at, NULL FROM explorations
), orphans AS (
  SELECT r.* FROM refs r WHERE NOT EXISTS (SELECT 1 FROM targets t WHERE t.kind = r.kind AND t.scope = r.scope AND t.key = r.key AND t.s <= r.at AND (t.e IS NULL OR t.e > r.at))
)"""
_P6 = """
WITH RECURSIVE links AS (
  SELECT a.id AS x, b.id AS y FROM explorations a JOIN explorations b ON a.superseded_by = b.id
), edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT id AS x, id AS y FROM explorations UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
member AS (SELECT x AS id, min(y) AS entity_key FROM reach GROUP BY x),
seen AS (
  SELECT 'search_result' AS source_table, chunk_id AS entity_key, CAST(version AS BIGINT) AS version, min(epoch) AS valid_from FROM search_result
  WHERE version IS NOT NULL AND epoch IS NOT NULL GROUP BY chunk_id, version
  UNION ALL
  SELECT 'explorations', m.entity_key, CAST(e.version AS BIGINT), min(e.epoch) FROM explorations e JOIN member m ON e.id = m.id
  WHERE version IS NOT NULL AND epoch IS NOT NULL GROUP BY m.entity_key, e.version
)"""
SQL = {
    "p5_found": _P5 + "SELECT source_table, record_id, ref_field, ref_value FROM orphans",
    "p5_report": _P5 + """
SELECT r.source_table, r.ref_field, strftime(r.at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS refs, count(o.record_id) AS orphans
FROM refs r LEFT JOIN orphans o ON o.source_table = r.source_table AND o.record_id = r.record_id AND o.ref_field = r.ref_field AND o.ref_value = r.ref_value
GROUP BY ALL""",
    "p6_history": _P6.replace("seen AS (", "rows AS (", 1).replace("min(epoch) AS valid_from FROM search_result", "epoch, returned_at AS seen_at, text, file_path, CAST(start_line AS VARCHAR) AS start_line, CAST(end_line AS VARCHAR) AS end_line, created_by, model, NULL::VARCHAR AS goal, NULL::VARCHAR AS summary, NULL::VARCHAR AS status FROM search_result").replace("IS NOT NULL GROUP BY chunk_id, version", "IS NOT NULL").replace("CAST(e.version AS BIGINT), min(e.epoch) FROM", "CAST(e.version AS BIGINT), e.epoch, e.created_at, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, e.created_by, e.model, e.goal, e.summary, e.status FROM").replace("IS NOT NULL GROUP BY m.entity_key, e.version", "IS NOT NULL")
    + """, seen AS (SELECT *, epoch AS valid_from FROM (SELECT *, row_number() OVER (PARTITION BY source_table, entity_key, version ORDER BY epoch, seen_at NULLS FIRST, """
    + ", ".join(f"{a} NULLS FIRST" for a in H.ATTRIBUTES)
    + ") AS rk FROM rows) WHERE rk = 1) SELECT source_table, entity_key, version, valid_from, CAST(coalesce(lead(valid_from) OVER (PARTITION BY source_table, entity_key ORDER BY version), -1) AS BIGINT) AS valid_to, " + ", ".join(H.ATTRIBUTES) + " FROM seen",
    "p6_found": _P6 + "SELECT source_table, entity_key, version, valid_from, CAST(coalesce(lead(valid_from) OVER (PARTITION BY source_table, entity_key ORDER BY version), -1) AS BIGINT) AS valid_to FROM seen",
}
