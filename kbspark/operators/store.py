"""Keeping records and vectors in step: upserts, deletes, pending embeddings, event logs, attestations.

Tables are never changed in place; each function gives the new state. Empty inputs leave the state as it is.
"""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kbspark.functions import vectors
from kbspark.functions.text import content_hash
from kbspark.operators.search import small


def embed_inputs(rows: DataFrame, id_col: str, *parts: str) -> DataFrame:
    """``(id, input)``: the text of a record that is embedded, its parts on lines of their own; records without text are left out."""
    return rows.select(F.col(id_col).alias("id"), F.concat_ws("\n", *parts).alias("input")).where(F.length("input") > 0)


def upsert_vectors(table: DataFrame, rows: DataFrame, dims: int) -> DataFrame:
    """The table ``(id, vector)`` with rows added or replaced by id; a vector of other than ``dims`` values is an error."""
    checked = rows.select("id", F.when(F.assert_true(F.size("vector") == dims, "vector of other dimensions").isNull(), F.col("vector")).alias("vector")).dropDuplicates(["id"])
    return table.select("id", "vector").join(checked.select("id"), "id", "left_anti").unionByName(checked)


def delete(table: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows whose id is not among the ids; children go the same way by their parent's id."""
    return table.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_anti")


def pending(records: DataFrame, stored: DataFrame) -> DataFrame:
    """``id`` of the records without a vector: what a retry embeds."""
    return records.select("id").distinct().join(stored.select("id"), "id", "left_anti")


def surplus(records: DataFrame, stored: DataFrame) -> DataFrame:
    """``id`` of the vectors without a record: what a retry deletes."""
    return stored.select("id").distinct().join(records.select("id"), "id", "left_anti")


def in_order(ids: list, table: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows of the given ids with their place ``pos`` in the list; unknown ids are skipped."""
    spark = table.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), f"pos int, {id_col} {dict(table.dtypes)[id_col]}")
    return small(wanted).join(table, id_col).orderBy("pos")


def all_match(expected: DataFrame, current: DataFrame) -> DataFrame:
    """``(key, matches)``: whether every expected ``(key, id, hash)`` is current; a missing one does not match."""
    e, c = expected.alias("e"), current.select("id", "hash").alias("c")
    j = e.join(c, "id", "left")
    return j.groupBy("key").agg(F.bool_and(F.coalesce(F.col("e.hash") == F.col("c.hash"), F.lit(False))).alias("matches"))


def last_state(events: DataFrame, key: str, at: str, id_col: str, state: str) -> DataFrame:
    """``(key, state, events)``: the state of each key after its last event."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(at, id_col)).alias("state"), F.count(F.lit(1)).alias("events"))


def valid_sessions(sessions: DataFrame, tokens: DataFrame, now: Column) -> DataFrame:
    """Sessions that have not run out and whose token is neither revoked nor run out."""
    t = tokens.where(F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))).select("token_id")
    return sessions.where(F.col("valid_until") > now).join(t, "token_id", "left_semi")


def context_limits(models: DataFrame, limits: DataFrame, default: int = 128_000) -> DataFrame:
    """``(model, limit)``: the limit of the longest known name that a model's name contains; limits are a small table."""
    m, n = models.select("model").distinct(), small(limits.select("name", "limit"))
    j = m.join(n, F.contains(F.lower("model"), F.lower("name")), "left")
    best = j.groupBy("model").agg(F.max_by("limit", F.struct(F.length("name"), F.col("name"))).alias("limit"))
    return best.select("model", F.coalesce("limit", F.lit(default)).alias("limit"))


def costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``(model, usd)`` of ``(model, tokens)`` by the price per million; unknown models cost nothing."""
    u = usage.groupBy("model").agg(F.sum("tokens").alias("tokens"))
    return u.join(small(prices), "model", "left").select("model", F.round(F.col("tokens") / 1e6 * F.coalesce("price", F.lit(0.0)), 6).alias("usd"))


def embed_cached(texts: DataFrame, cache: DataFrame, dims: int = 384) -> tuple[DataFrame, DataFrame]:
    """``(id, hash, vector, hit)`` of ``(id, text)`` and the new cache entries; only texts not in the cache are embedded, each once."""
    t = texts.where("text is not null").select("id", "text", content_hash(F.col("text")).alias("hash"))
    known = cache.groupBy("hash").agg(F.max_by("vector", "cached_at").alias("vector"))
    fresh = t.join(known.select("hash"), "hash", "left_anti").select("hash", "text").dropDuplicates(["hash"]).select("hash", vectors.embed(F.col("text"), dims).alias("vector"))
    both = known.withColumn("hit", F.lit(True)).unionByName(fresh.withColumn("hit", F.lit(False)))
    return t.join(both, "hash").select("id", "hash", "vector", "hit"), fresh


def attested(rows: DataFrame, columns: list[str], key: bytes) -> DataFrame:
    """Adds ``mac``: HMAC-SHA256 over the columns joined by line ends."""

    @F.pandas_udf("string")
    def mac(s: pd.Series) -> pd.Series:
        return s.map(lambda t: hmac.new(key, t.encode(), hashlib.sha256).hexdigest())

    return rows.withColumn("mac", mac(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])))


def newest_by_hash(cache: DataFrame) -> DataFrame:
    """The latest row of every hash, of equal times the greatest id."""
    w = W.partitionBy("hash").orderBy(F.col("cached_at").desc(), F.col("cache_id").desc())
    return cache.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk")
