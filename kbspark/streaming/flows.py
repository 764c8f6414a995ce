"""Flows: snapshots that arrive in files, debounced changes, leases and rate limits.

Batch forms take tables; streaming forms take streams of the same columns.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as W

from kbspark.functions.chunks import chunk_lines
from kbspark.functions.text import content_hash
from kbspark.plans.lineage import cut_lineage
from kbspark.sources.files import exists


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str | None = None) -> DataFrame:
    """``(key, start, end, n)``: bursts of events with less than a gap between them; a stream needs ``late``."""
    e = events.withWatermark(at, late) if late else events
    s = e.groupBy(key, F.session_window(at, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def rate_limited(requests: DataFrame, limit: int, window_s: int) -> DataFrame:
    """``(id, user, allowed)`` of ``(user, at, id)``: a window begins with the first request after the last one ended and lets ``limit`` through.

    A pause as long as the window always ends it, so a user's requests are independent between such pauses and are
    decided there one after the other; a user with very many requests is many groups.
    """
    w = W.partitionBy("user").orderBy("at", "id")
    sec = F.unix_micros("at") if dict(requests.dtypes)["at"] == "timestamp" else F.unix_micros(F.col("at").cast("timestamp"))
    r = requests.withColumn("t", sec).withColumn("_new", F.when(F.col("t") - F.lag("t").over(w) < window_s * 1_000_000, 0).otherwise(1))
    r = r.withColumn("burst", F.sum("_new").over(w))
    bursts = r.groupBy("user", "burst").agg(F.sort_array(F.collect_list(F.struct("t", "id"))).alias("xs"))
    zero = F.struct(F.lit(None).cast("long").alias("start"), F.lit(0).alias("n"), F.array().cast("array<boolean>").alias("ok"))

    def step(acc, x):
        fresh = acc["start"].isNull() | (x["t"] - acc["start"] >= window_s * 1_000_000)
        n = F.when(fresh, 1).otherwise(acc["n"] + 1)
        return F.struct(F.when(fresh, x["t"]).otherwise(acc["start"]).alias("start"), n.alias("n"), F.array_append(acc["ok"], n <= limit).alias("ok"))

    done = bursts.select("user", "xs", F.aggregate("xs", zero, step).alias("a"))
    return done.select("user", F.explode(F.arrays_zip(F.col("xs.id").alias("id"), F.col("a.ok").alias("allowed"))).alias("x")).select("x.id", "user", "x.allowed")


def rate_limit_stream(requests: DataFrame, limit: int, window_s: int) -> DataFrame:
    """The same on a stream ``(user, at, id)``: the state of a user is the start of the window and the count."""

    def run(key, batches, state: GroupState):
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        out = []
        for t, i in zip(rows["at"].astype("int64"), rows["id"], strict=True):
            if start is None or t - start >= window_s * 1_000_000_000:
                start, n = t, 0
            n += 1
            out.append((int(i), key[0], n <= limit))
        state.update((start, n))
        yield pd.DataFrame(out, columns=["id", "user", "allowed"])

    user = dict(requests.dtypes)["user"]
    r = requests.withColumn("at", F.col("at").cast("timestamp"))
    return r.groupBy("user").applyInPandasWithState(run, f"id long, user {user}, allowed boolean", "start long, n int", "append", GroupStateTimeout.NoTimeout)


def lease_stream(claims: DataFrame) -> DataFrame:
    """``(job_id, worker, state)`` from ``(job_id, worker, at, lease_s)``: claimed, and expired once the watermark passes the lease."""

    def run(key, batches, state: GroupState):
        if state.hasTimedOut:
            (worker,) = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "worker": [worker], "state": ["expired"]})
            return
        rows = pd.concat(list(batches)).sort_values("at")
        last = rows.iloc[-1]
        state.update((str(last["worker"]),))
        until = int(last["at"].timestamp() * 1000) + int(last["lease_s"]) * 1000
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [key[0]], "worker": [str(last["worker"])], "state": ["claimed"]})

    return claims.withWatermark("at", "0 seconds").groupBy("job_id").applyInPandasWithState(run, "job_id long, worker string, state string", "worker string", "append", GroupStateTimeout.EventTimeTimeout)


_CHUNKS = "project string, path string, line_start int, line_end int, hash string, text string, received_at timestamp, retired boolean, batch long"


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, max_lines: int = 51, overlap: int = 6, files_per_batch: int | None = None) -> StreamingQuery:
    """Files ``(project, path, content, received_at)`` that arrive as parquet in ``source`` become chunk revisions in ``target``.

    Each batch appends the chunks that are new or changed against the table and marks the keys of its files that are
    gone as retired, in one write per batch number: a batch that is run again after a failure replaces its own output.
    The table is laid out by batch and project and only the projects of a batch are read again. Of uploads of one file
    at one time the one with the greater content counts. ``files_per_batch`` bounds what a batch takes in.
    """
    key = ["project", "path", "line_start", "line_end"]

    def one(batch: DataFrame, number: int) -> None:
        newest = F.max_by(F.struct("content", "received_at"), F.struct("received_at", "content")).alias("f")
        files = cut_lineage(batch.groupBy("project", "path").agg(newest).select("project", "path", "f.content", "f.received_at"))
        new = chunk_lines(files, "content", max_lines, overlap).select(*key, content_hash(F.col("text")).alias("hash"), "text", "received_at")
        if exists(spark, target):
            kept = spark.read.schema(_CHUNKS).parquet(target).where(F.col("batch") < number)
            kept = kept.join(F.broadcast(files.select("project").distinct()), "project", "left_semi").join(files.select("project", "path"), ["project", "path"], "left_semi")
        else:
            kept = spark.createDataFrame([], _CHUNKS)
        live = kept.groupBy(*key).agg(F.max_by(F.struct("hash", "retired"), "batch").alias("l")).where("not l.retired").select(*key, F.col("l.hash").alias("_hash"), F.lit(1).alias("_live"))
        j = new.join(live, key, "full")
        out = j.where(F.col("_live").isNull() | F.col("hash").isNull() | (F.col("hash") != F.col("_hash")))
        out = out.withColumn("retired", F.col("hash").isNull()).drop("_hash", "_live")
        out.write.partitionBy("project").mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    return stream.parquet(source).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
