"""Exploration maps: validation, anchors, staleness, confidence, feedback.

Null paths are no anchors; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kbspark.config import Confidence
from kbspark.functions import scores
from kbspark.operators.orphans import same_file

# What a request may hold.
GOAL_CHARS, SUMMARY_CHARS, BODY_BYTES, FILES = 2000, 4000, 512 * 1024, 128


def problems(requests: DataFrame) -> DataFrame:
    """Adds ``problems``: what is wrong with a request, empty if it is valid."""
    checks = [
        (F.length(F.trim(F.coalesce("goal", F.lit("")))) == 0, "goal missing"),
        (F.length("goal") > GOAL_CHARS, "goal too long"),
        (F.length("summary") > SUMMARY_CHARS, "summary too long"),
        (F.octet_length("body_markdown") > BODY_BYTES, "body too large"),
        (F.size("files") > FILES, "too many files"),
    ]
    return requests.withColumn("problems", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in checks])))


def anchors(requests: DataFrame) -> DataFrame:
    """``(id, project, path)``: the distinct files a request names."""
    f = requests.select(F.col("request_id").alias("id"), "project", F.explode("files").alias("file")).where(F.trim(F.regexp_replace("file", r"\s+", " ")) != "")
    return f.select("id", "project", same_file(F.col("file")).alias("path")).distinct()


def resolved(anchored: DataFrame, files: DataFrame) -> DataFrame:
    """``(id, project, path, hash)``: the least content hash among the current files of a path; null if there is none."""
    h = files.groupBy("project", "path").agg(F.min("hash").alias("hash"))
    return anchored.join(h, ["project", "path"], "left").select("id", "project", "path", "hash")


def broken(anchored: DataFrame, files: DataFrame) -> DataFrame:
    """``(id, broken)``: sorted paths of a map of which no current file has the hash stored with the anchor; only maps with one.

    Anchors are ``(id, project, path, hash)``, files ``(project, path, hash)``. A path that is gone, one whose content
    changed, and an anchor without a hash are broken.
    """
    gone = anchored.join(files.select("project", "path", F.lower("hash").alias("hash")).distinct(), ["project", "path", "hash"], "left_anti")
    return gone.groupBy("id").agg(F.sort_array(F.collect_set("path")).alias("broken"))


def mark_stale(maps: DataFrame, broken: DataFrame) -> DataFrame:
    """Maps ``(id, project, status)`` after a sweep, with ``stale_reason``: fresh ones with broken anchors become stale, all others stay."""
    m = maps.join(broken.select("id", F.to_json("broken").alias("_why")), "id", "left")
    hit = (F.col("status") == "fresh") & F.col("_why").isNotNull()
    return m.select("id", "project", F.when(hit, "stale").otherwise(F.col("status")).alias("status"), F.when(hit, F.col("_why")).alias("stale_reason"))


def bumped(epochs: DataFrame, changed: DataFrame) -> DataFrame:
    """``(project, epoch)`` after a change in some projects: one more than before, 1 for a project without an epoch."""
    c = changed.select("project").distinct().withColumn("_c", F.lit(1))
    j = epochs.select("project", "epoch").join(c, "project", "full")
    return j.select("project", (F.coalesce("epoch", F.lit(0)) + F.coalesce("_c", F.lit(0))).cast("long").alias("epoch"))


def drift(epoch: Column, current: Column) -> Column:
    return F.greatest(current - epoch, F.lit(0))


def ranked(maps: DataFrame, cfg: Confidence = Confidence(), k: int = 5, by: list[str] = ("query_id",)) -> DataFrame:
    """Maps ``(*by, id, similarity, drift, age_days, confirmed, contradicted)`` with ``hit`` and ``confidence``; hits only, the k most trusted."""
    m = maps.withColumn("hit", scores.hit_class(F.col("similarity"), cfg)).where("hit <> 'none'")
    m = m.withColumn("confidence", F.round(scores.confidence(F.col("similarity"), F.col("drift"), F.col("age_days"), F.col("confirmed"), F.col("contradicted"), cfg), 6))
    w = W.partitionBy(*by).orderBy(F.col("confidence").desc(), "id")
    return m.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def search(near: DataFrame, maps: DataFrame, stale: DataFrame, include_stale: bool = False, project: bool = False, as_of: int | None = None, cfg: Confidence = Confidence(), k: int = 5, margin: int = 3) -> DataFrame:
    """``(query_id, id, hit, confidence, rank)``: maps among the vectors nearest to a question, gated and by confidence.

    ``near`` are ranked vector hits ``(query_id, id, similarity, rank)`` (with ``project`` of the question if hits must
    be of it) of which the first k and a margin count. ``maps`` holds all revisions ``(id, project, goal, status, epoch,
    age_days, confirmed, contradicted, now_epoch)``. As of an epoch, the revision of the map's goal that was active then is judged in
    its place. Retired maps and those in review never surface, stale ones (by status, or with an id in ``stale``) only when asked.
    """
    n = near.where(F.col("rank") < k + margin).select("query_id", "id", "similarity", *(["project"] if project else []))
    keys = ["id", "project"] if project else ["id"]
    if as_of is None:
        j = n.join(maps, keys)
    else:
        goal = maps.select("id", "project", "goal")
        last = maps.where(F.col("epoch") <= as_of).groupBy("project", "goal").agg(F.max_by(F.struct("status", "epoch", "age_days", "confirmed", "contradicted", "now_epoch", F.col("id").alias("revision")), F.struct("epoch", "id")).alias("r"))
        j = n.join(goal, keys).join(last, ["project", "goal"]).select("query_id", "similarity", "project", F.col("r.revision").alias("id"), "r.status", "r.epoch", "r.age_days", "r.confirmed", "r.contradicted", "r.now_epoch")
        j = j.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity"), *[F.first(c).alias(c) for c in ("status", "epoch", "age_days", "confirmed", "contradicted", "now_epoch")])
    j = j.join(stale.select("id", F.lit(True).alias("_broken")).distinct(), "id", "left")
    old = F.col("_broken").isNotNull() | (F.coalesce("status", F.lit("")) != "fresh")
    j = j.where(~F.coalesce("status", F.lit("")).isin("retired", "pending_review"))
    if not include_stale:
        j = j.where(~old)
    now = F.coalesce("now_epoch", F.lit(0))
    return ranked(j.withColumn("drift", drift(F.coalesce("epoch", now), now)), cfg, k).select("query_id", "id", "hit", "confidence", "rank")


def feedback(events: DataFrame, limit: int = 3) -> DataFrame:
    """``(id, confirmed, contradicted, retired_at)`` from ``(id, at, event_id, contradicts)``: retired by the limit-th contradiction."""
    w = W.partitionBy("id", "contradicts").orderBy("at", "event_id")
    nth = F.row_number().over(w)
    e = events.withColumn("_at", F.when(F.col("contradicts") & (nth == limit), F.col("at")))
    return e.groupBy("id").agg(F.count_if(~F.col("contradicts")).alias("confirmed"), F.count_if("contradicts").alias("contradicted"), F.max("_at").alias("retired_at"))


def grounded(similarities: DataFrame, least: float = 0.25, k: int = 5) -> DataFrame:
    """``(id, grounded)``: whether one of the k chunks most similar to the claim of a map is similar enough."""
    w = W.partitionBy("id").orderBy(F.col("similarity").desc())
    top = similarities.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k)
    return top.groupBy("id").agg((F.max("similarity") >= least).alias("grounded"))
