"""Problem 5: references whose target did not exist at the time of the reference.

References and targets are brought to one shape each, so that the check is independent of the tables:

* references ``(source_table, record_id, ref_field, ref_value, kind, scope, key, at)``
* targets ``(kind, scope, key, start, end)``: the target exists from ``start`` until before ``end`` (null: still there)

``find_orphans`` counts references per key and period first (combined before the shuffle), derives from these counts
the keys that hold a large part of all rows, tests those against broadcast targets of a checked size and all others by
a shuffled anti-join, and unites both.

Defined results: a reference without a time, scope or key has no target and is an orphan; a target without a start
never exists; a null array, a null, empty or broken payload and null or blank elements give no reference; elements
repeated in one record are one reference; empty tables give no references or no targets. Further columns of the
inputs, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kbspark.plans.lineage import cut_lineage
from kbspark.plans.skew import HEAVY_PARTS, anti_join_skewed, heavy_keys


def same_file(path: Column) -> Column:
    """Canonical spelling of a path: ``\\`` read as ``/``, repeated ``/`` as one, outer blanks and leading ``./`` dropped."""
    p = F.regexp_replace(F.regexp_replace(path, r"^\s+|\s+$", ""), r"\\", "/")
    return F.regexp_replace(F.regexp_replace(p, "/+", "/"), r"^(\./)+", "")


def _payload_ids(payload: Column, field: str) -> Column:
    whole = F.endswith(F.rtrim(payload), F.lit("}"))
    ids = F.try_variant_get(F.try_parse_json(payload), f"$.{field}", "array<string>")
    return F.when(whole, ids)


def _flat(df: DataFrame, source: str, record: str, field: str, kind: str, at: str, values: Column, scope: Column, key) -> DataFrame:
    one = df.select(
        F.lit(source).alias("source_table"), F.col(record).cast("long").alias("record_id"), F.lit(field).alias("ref_field"),
        F.explode_outer(F.array_distinct(values)).alias("ref_value"), scope.alias("scope"), F.col(at).alias("at"),
    ).where(F.trim(F.regexp_replace("ref_value", r"\s+", " ")) != "")
    return one.withColumns({"kind": F.lit(kind), "key": key(F.col("ref_value"))})


def request_references(requests: DataFrame) -> DataFrame:
    """One row per element of ``files``; the target is an indexed file of the same project."""
    return _flat(requests, "persist_exploration_request", "request_id", "files", "file", "received_at", F.col("files"), F.col("project"), same_file)


def claim_references(claims: DataFrame) -> DataFrame:
    """One row per id in ``chunk_ids`` and ``node_ids`` of a payload that is valid JSON, given as number or string."""
    none = F.lit("")
    parts = [
        _flat(claims, "claim_rlm_job_response", "claim_id", f, k, "claimed_at", _payload_ids(F.col("payload"), f), none, lambda v: F.trim(v))
        for f, k in (("chunk_ids", "chunk"), ("node_ids", "node"))
    ]
    return parts[0].unionByName(parts[1])


def supersede_references(explorations: DataFrame) -> DataFrame:
    """One row per exploration that names the revision superseding it."""
    value = F.array(F.col("superseded_by").cast("string"))
    return _flat(explorations, "explorations", "id", "superseded_by", "exploration", "updated_at", value, F.lit(""), lambda v: v)


def targets(index_file: DataFrame, search_result: DataFrame, rlm_nodes: DataFrame, explorations: DataFrame) -> DataFrame:
    """All records that may be referred to, with the time in which each exists."""

    def of(df: DataFrame, kind: str, scope: Column, key: Column, start: str, end: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), scope.alias("scope"), key.alias("key"), F.col(start).alias("start"), end.cast("timestamp").alias("end"))

    none, never = F.lit(""), F.lit(None)
    return (
        of(index_file, "file", F.col("project"), same_file(F.col("rel_path")), "received_at", F.col("deleted_at"))
        .unionByName(of(search_result, "chunk", none, F.col("chunk_id").cast("string"), "returned_at", never))
        .unionByName(of(rlm_nodes, "node", none, F.col("id").cast("string"), "created_at", F.col("deleted_at")))
        .unionByName(of(explorations, "exploration", none, F.col("id").cast("string"), "created_at", never))
    )


KEYS = ["kind", "scope", "key"]


def coverage(targets: DataFrame) -> DataFrame:
    """Disjoint times of existence ``(kind, scope, key, start, end)``: the fewest intervals that cover the same time.

    Rows that still exist shrink to the earliest of their key before the shuffle. Ended rows are merged twice, within a
    day of their key and then within the key, so that a key with very many rows is not merged in one go.
    """
    t = targets.select(*KEYS, "start", "end").where("start is not null and key is not null and scope is not null")
    still = t.where("end is null").groupBy(*KEYS).agg(F.min("start").alias("start")).withColumn("end", F.lit(None).cast("timestamp"))
    ended = t.where("end > start").groupBy(*KEYS, "start").agg(F.max("end").alias("end"))

    def merged(df: DataFrame, by: list) -> DataFrame:
        w = W.partitionBy(*by).orderBy("start", "end")
        before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
        first = F.when(before >= F.col("start"), 0).otherwise(1)
        return df.withColumn("_first", first).withColumn("_island", F.sum("_first").over(w)).groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))

    ended = merged(ended.withColumn("_day", F.to_date("start")), [*KEYS, "_day"])
    ended = merged(ended.select(*KEYS, "start", "end"), KEYS).select(*KEYS, "start", "end")
    return still.unionByName(ended)


def reference_counts(refs: DataFrame) -> DataFrame:
    """References per source, key and month."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    return refs.groupBy("source_table", "ref_field", *KEYS, month).agg(F.count(F.lit(1)).alias("n"))


def _exists(l, r) -> Column:
    return (r("start") <= l("at")) & (r("end").isNull() | (r("end") > l("at")))


def find_orphans(refs: DataFrame, targets: DataFrame, heavy_parts: int = HEAVY_PARTS) -> DataFrame:
    """``(source_table, record_id, ref_field, ref_value, at)`` of every reference without a target at its time."""
    heavy = heavy_keys(reference_counts(refs), KEYS, heavy_parts, "n")
    out = anti_join_skewed(refs, coverage(targets), KEYS, _exists, heavy)
    return out.select("source_table", "record_id", "ref_field", "ref_value", "at").distinct()


def orphan_report(refs: DataFrame, targets: DataFrame, heavy_parts: int = HEAVY_PARTS) -> DataFrame:
    """``(source_table, ref_field, month, refs, orphans)``; month is null for references without a time.

    References are counted per key and time once; both anti-joins run over these groups and carry their counts, and the
    counts of orphans and of all references are summed in one go.
    """
    r = refs.select("source_table", "record_id", "ref_field", "ref_value", *KEYS, "at").distinct()
    groups = cut_lineage(r.groupBy("source_table", "ref_field", *KEYS, "at").agg(F.count(F.lit(1)).alias("n")))
    bad = anti_join_skewed(groups, coverage(targets), KEYS, _exists, heavy_keys(groups, KEYS, heavy_parts, "n"))
    none = F.lit(0).cast("long")
    both = groups.select("source_table", "ref_field", "at", F.col("n").alias("refs"), none.alias("orphans")).unionByName(bad.select("source_table", "ref_field", "at", none.alias("refs"), F.col("n").alias("orphans")))
    return both.groupBy("source_table", "ref_field", F.date_format("at", "yyyy-MM").alias("month")).agg(F.sum("refs").alias("refs"), F.sum("orphans").alias("orphans"))
