"""What a server answers with: summaries, unified results, tasks, reports.

Nodes are ``(id, project, level, subject, summary_text, review_status, stale, deleted_at, ...)``. Nulls in a gate's column
close it; empty tables give no rows; further columns are kept where rows pass through and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.config import Search
from kbspark.functions import scores
from kbspark.operators import search as S


def servable(nodes: DataFrame, project: str = "") -> DataFrame:
    """Nodes that may be served: active, not stale, approved; of one project, or of all if it is empty."""
    n = nodes.where("deleted_at is null and review_status = 'approved'")
    if "stale" in nodes.columns:
        n = n.where(~F.coalesce("stale", F.lit(False)))
    return n if not project else n.where(F.col("project") == project)


def summaries(lexical: DataFrame, semantic: DataFrame, nodes: DataFrame, revisions: DataFrame | None = None, k: int = Search.top_k) -> DataFrame:
    """``(query_id, id, served, score, norm, rank)``: nodes by fusion of a text and a vector list, scores between the least and the greatest of a list.

    ``lexical`` are scored hits, ``semantic`` vector hits with ranks over all nodes; those of them that may not be served
    (not in ``nodes``) are left out and the others move up. With ``revisions`` (``(project, level, subject, served)``,
    the node that was active at the time asked for) that node is served in place of each hit.
    """
    lists = [S.top_k(lexical, k), S.top_k(semantic.where(F.col("rank") < k).drop("rank").join(nodes.select("id"), "id", "left_semi"), k)]
    fused = S.rrf(lists).withColumn("score", F.round("score", 9))
    ranked = S.normalized(S.top_k(fused, 2 * k)).where(F.col("rank") < k)
    if revisions is None:
        return ranked.withColumn("served", F.col("id")).select("query_id", "id", "served", "score", "norm", "rank")
    keys = ["project", "level", "subject"]
    at = ranked.join(nodes.select("id", *keys), "id").join(revisions.select(*keys, "served"), keys, "left")
    return at.select("query_id", "id", F.coalesce("served", "id").alias("served"), "score", "norm", "rank")


def as_chunks(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Summaries in the shape of chunks ``(query_id, id, path, text, score, line_start, line_end)``; the path tells level and subject."""
    path = F.format_string("[summary:%d] %s", F.col("level"), F.col("subject"))
    n = nodes.select(F.col("id").alias("served"), path.alias("path"), F.col("summary_text").alias("text"))
    return found.join(n, "served").select("query_id", F.col("served").alias("id"), "path", "text", "score", F.lit(0).alias("line_start"), F.lit(0).alias("line_end"))


def filtered(results: DataFrame, min_score: float | None = None, path_part: str | None = None) -> DataFrame:
    """Results of a score and with a part of a path; a filter that is not given keeps all."""
    if min_score is not None:
        results = results.where(F.col("score") >= min_score)
    return results if path_part is None else results.where(F.contains("path", F.lit(path_part)))


def unified(chunks: DataFrame, found: DataFrame, maps: DataFrame, total: int = Search.top_k, ratio: float = Search.summary_ratio, least: float = Search.summary_min_score) -> DataFrame:
    """``(query_id, kind, id, norm)``: chunks, summaries and maps of each question.

    Summaries take their share of the places as far as enough of them are good enough, chunks the rest and one at least;
    maps come in addition. Chunks and summaries are ``(query_id, id, norm)``, maps ``(query_id, id, confidence)``.
    """
    s = S.top_k(found.where(F.col("norm") >= least).select("query_id", "id", "norm"), scores.summary_split(total, ratio, total)[0], score="norm")
    took = s.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    c = S.top_k(chunks.select("query_id", "id", "norm"), total, score="norm").join(took, "query_id", "left").where(F.col("rank") < F.lit(total) - F.coalesce("_n", F.lit(0)))

    def kind(df: DataFrame, name: str, score: str) -> DataFrame:
        return df.select("query_id", F.lit(name).alias("kind"), "id", F.round(score, 6).alias("norm"))

    return kind(c, "chunk", "norm").unionByName(kind(s, "summary", "norm")).unionByName(kind(maps, "map", "confidence"))


def pending_tasks(tasks: DataFrame, k: int) -> DataFrame:
    """The first k pending tasks ``(id, buffer, status)`` of every buffer, by id."""
    w = S.W.partitionBy("buffer").orderBy("id")
    return tasks.where("status = 'pending'").withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def merged_reports(reports: list[DataFrame], by: list[str] | None = None) -> DataFrame:
    """The sums of the counters of several reports with the same columns, in one row or one per ``by``."""
    both = reports[0]
    for r in reports[1:]:
        both = both.unionByName(r)
    by = by or []
    return both.groupBy(*by).agg(*[F.sum(c).cast("long").alias(c) for c in both.columns if c not in by])


def paths_of(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(path)``: the distinct paths of chunks ``(id, path)`` with the ids; unknown ids have none."""
    return chunks.join(ids.select("id").distinct(), "id", "left_semi").select("path").distinct()


def with_paths(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(id, paths)``: cached answers ``(id, chunk_ids)`` with the sorted distinct paths of their chunks ``(id, path)``."""
    e = entries.select("id", F.explode("chunk_ids").alias("_c")).distinct()
    found = e.join(chunks.select(F.col("id").alias("_c"), "path").distinct(), "_c").groupBy("id").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    return entries.select("id").join(found, "id", "left").select("id", F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))


def budget_left(usage: DataFrame, budget: int, by: str = "key") -> DataFrame:
    """Usage ``(key, at, id, prompt, completion)`` with ``used`` so far and ``remaining``, never below 0."""
    w = S.W.partitionBy(by).orderBy("at", "id").rowsBetween(S.W.unboundedPreceding, 0)
    used = F.sum(F.col("prompt") + F.col("completion")).over(w)
    return usage.withColumn("used", used).withColumn("remaining", F.greatest(F.lit(budget) - F.col("used"), F.lit(0)))


def stored_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks ``(id, text, ...)`` as they are stored: with the hash of the text and its size in bytes."""
    return chunks.withColumn("hash", F.sha2("text", 256)).withColumn("size_bytes", F.octet_length("text").cast("long"))


def anchor_lines(anchored: DataFrame) -> DataFrame:
    """``(id, anchors)``: anchors ``(id, project, path, hash)`` as ``path@hash``, ``path@?`` without one, sorted."""
    line = F.concat(F.col("path"), F.lit("@"), F.coalesce("hash", F.lit("?")))
    return anchored.groupBy("id").agg(F.sort_array(F.collect_set(line)).alias("anchors"))


def history_rows(queries: DataFrame, kind: Column, at: Column) -> DataFrame:
    """``(query_id, query_type, text, at)``: what is recorded of questions; the type is search, query or store, others are not recorded."""
    return queries.select("query_id", kind.alias("query_type"), "text", at.alias("at")).where(F.col("query_type").isin("search", "query", "store"))
