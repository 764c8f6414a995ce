"""The cache of answered questions: lookup, provenance, staleness, eviction.

Entries are ``(id, project, question, hashes, access_count, used_ms, stale)``. Null questions match nothing; empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kbspark.functions import scores
from kbspark.functions import text as T
from kbspark.operators.search import vector_search


def exact_hits(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """``(query_id, id)``: the live entry with the same question in the project, the smallest id of several; null for none."""
    live = entries.where("not stale").groupBy("project", T.question_hash(F.col("question")).alias("hash")).agg(F.min("id").alias("id"))
    q = questions.select("query_id", "project", T.question_hash(F.col("question")).alias("hash"))
    return q.join(live, ["project", "hash"], "left").select("query_id", "id")


def nearest(questions: DataFrame, entries: DataFrame, same_project: bool = True) -> DataFrame:
    """``(query_id, id, similarity)``: the live entry whose question vector is the most similar, for a stated set of questions.

    Questions are ``(query_id, project, vector)``, entries have ``vector``; entries of the question's project count only.
    """
    items = entries.where("not stale").select("id", F.col("project").alias("buffer"), "vector")
    q = questions.select("query_id", F.col("project").alias("buffer"), "vector")
    return vector_search(q, items, 1, "cosine", same_buffer=same_project).select("query_id", "id", F.col("score").alias("similarity"))


def overlaps(pairs: DataFrame, results: DataFrame, sources: DataFrame) -> DataFrame:
    """``(query_id, id, jaccard)``: overlap of what a question finds now (``(query_id, chunk)``) with what an entry was made of (``(id, chunk)``)."""
    a = pairs.join(results.groupBy("query_id").agg(F.collect_set("chunk").alias("_a")), "query_id", "left")
    b = a.join(sources.groupBy("id").agg(F.collect_set("chunk").alias("_b")), "id", "left")
    none = F.array().cast(dict(results.dtypes)["chunk"].join(("array<", ">")))
    return b.select("query_id", "id", F.round(scores.jaccard(F.coalesce("_a", none), F.coalesce("_b", none)), 6).alias("jaccard"))


def lookup(questions: DataFrame, entries: DataFrame, intact: DataFrame, near: DataFrame, jaccards: DataFrame) -> DataFrame:
    """``(query_id, id, outcome, tier, digest_k, provenance_k)``: exact hit, near hit by plan, or miss.

    An exact hit counts only while all its sources are as they were (``intact``: the ids of such entries); otherwise the
    question goes on to its nearest entry, which must be intact too, and by its similarity and the overlap of results
    to a near hit or a miss.
    """
    ok = intact.select("id").distinct().withColumn("_ok", F.lit(True))
    exact = exact_hits(questions, entries).join(ok, "id", "left").select("query_id", F.when(F.col("_ok"), F.col("id")).alias("exact_id"))
    n = near.join(jaccards, ["query_id", "id"], "left").join(ok, "id", "left").where("_ok").select("query_id", F.col("id").alias("near_id"), "similarity", "jaccard")
    j = exact.join(n, "query_id", "left").withColumn("plan", scores.qa_plan(F.coalesce("similarity", F.lit(0.0)), F.coalesce("jaccard", F.lit(0.0))))
    outcome = F.when(F.col("exact_id").isNotNull(), "exact").when(~F.col("plan.is_miss"), "near").otherwise("miss")
    found = F.when(F.col("exact_id").isNotNull(), F.col("exact_id")).when(~F.col("plan.is_miss"), F.col("near_id"))
    return j.select("query_id", found.alias("id"), outcome.alias("outcome"), "plan.tier", "plan.digest_k", "plan.provenance_k")


def store_answers(entries: DataFrame, answers: DataFrame, now_ms: int) -> DataFrame:
    """``(id, project, hash, version, superseded_by, stored_ms)`` of all entries after answers ``(id, project, question)`` were stored.

    An answer supersedes the active entry of the same question in its project and gets the next version; of several
    answers to one question in a batch the greatest id is the last. Entries are ``(id, project, hash, version,
    superseded_by, stored_ms)``; questions without text are not stored.
    """
    new = answers.where("question is not null").select("id", "project", T.question_hash(F.col("question")).alias("hash"))
    key = ["project", "hash"]
    base = entries.groupBy(*key).agg(F.max("version").alias("_v"))
    w = W.partitionBy(*key).orderBy("id")
    added = new.join(base, key, "left").withColumn("version", (F.coalesce("_v", F.lit(0)) + F.row_number().over(w)).cast("long")).withColumn("superseded_by", F.lead("id").over(w))
    first = new.groupBy(*key).agg(F.min("id").alias("_next"))
    old = entries.join(first, key, "left").withColumn("superseded_by", F.coalesce("superseded_by", "_next"))
    cols = ["id", "project", "hash", "version", "superseded_by", "stored_ms"]
    return old.select(*cols).unionByName(added.withColumn("stored_ms", F.lit(now_ms).cast("long")).select(*cols))


def stale_by_hashes(entries: DataFrame, changed: DataFrame) -> DataFrame:
    """``id`` of the entries with a hash among the changed ones."""
    return entries.select("id", F.explode("hashes").alias("hash")).join(changed.select("hash").distinct(), "hash", "left_semi").select("id").distinct()


def provenance(entries: DataFrame, current: DataFrame) -> DataFrame:
    """``(id, n_hashes, n_missing, intact)``: whether all hashes of an entry are still current; none at all is intact."""
    h = entries.select("id", F.explode(F.array_distinct("hashes")).alias("hash"))
    seen = h.join(current.select("hash").distinct().withColumn("_known", F.lit(1)), "hash", "left").groupBy("id").agg(F.count(F.lit(1)).alias("n_hashes"), F.count_if(F.col("_known").isNull()).alias("n_missing"))
    e = entries.select("id").distinct().join(seen, "id", "left")
    return e.select("id", F.coalesce("n_hashes", F.lit(0)).alias("n_hashes"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"), (F.coalesce("n_missing", F.lit(0)) == 0).alias("intact"))


def evictions(entries: DataFrame, most: int, half_ms: float, now_ms: int) -> DataFrame:
    """``(project, id)`` of the entries beyond ``most`` per project, the least used for their age first."""
    weight = F.round(scores.eviction_weight(F.col("access_count"), F.greatest(F.lit(now_ms) - F.col("used_ms"), F.lit(0)), half_ms), 9)
    n = entries.groupBy("project").agg((F.count(F.lit(1)) - most).alias("excess")).where("excess > 0")
    w = W.partitionBy("project").orderBy("weight", "id")
    return entries.join(n, "project").withColumn("weight", weight).withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= F.col("excess")).select("project", "id")


def claim_order(jobs: DataFrame, worker: str, k: int) -> DataFrame:
    """The first k pending jobs for a worker: those that prefer it first, then the oldest."""
    return jobs.orderBy(F.coalesce(F.col("preferred") == worker, F.lit(False)).desc(), "created", "id").limit(k)
