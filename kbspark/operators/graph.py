"""The graph of summaries, its staleness and its work queue; quorum and trust of those who work on it.

Null links are no edges; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kbspark.config import Cascade, Quorum
from kbspark.plans.lineage import cut_lineage


#: Workers that claim at once.
CLAIM_BATCH = 100_000


def parents(nodes: DataFrame, stretch: int = 100_000) -> DataFrame:
    """``(child, parent)``: the node one level up in the same project with the greatest id below, else none.

    Nodes are ``(id, project, level)``. The ordered pass runs over stretches of ids of a project, and the last node of each
    level is carried over from the stretches before, so a project may hold any share of the nodes.
    """
    n = nodes.select("id", "project", "level").withColumn("s", F.floor(F.col("id") / stretch))
    w = W.partitionBy("project", "s").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    tops = n.groupBy("project", "s").agg(*[F.max(F.when(F.col("level") == v, F.col("id"))).alias(f"top{v}") for v in (2, 3)])
    before = W.partitionBy("project").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    carried = tops.select(F.col("project").alias("_p"), F.col("s").alias("_s"), *[F.max(f"top{v}").over(before).alias(f"c{v}") for v in (2, 3)])
    n = n.withColumns({f"up{v}": F.max(F.when(F.col("level") == v, F.col("id"))).over(w) for v in (2, 3)})
    n = n.join(carried, F.col("project").eqNullSafe(F.col("_p")) & (F.col("s") == F.col("_s")))
    parent = F.when(F.col("level") == 1, F.coalesce("up2", "c2")).when(F.col("level") == 2, F.coalesce("up3", "c3"))
    return n.withColumn("parent", parent).where("parent is not null").select(F.col("id").alias("child"), "parent")


def ancestors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(seed, ancestor)`` over any number of steps, a round for each; circles end because pairs are kept once and a seed is not its own ancestor."""
    e = edges.where("child is not null and parent is not null").select("child", "parent").distinct()
    found = frontier = cut_lineage(seeds.select(F.col("id").alias("seed")).join(e, F.col("seed") == F.col("child")).select("seed", F.col("parent").alias("ancestor")).where("seed <> ancestor").distinct())
    while True:
        step = frontier.join(e, F.col("ancestor") == F.col("child")).select("seed", F.col("parent").alias("ancestor")).where("seed <> ancestor").distinct()
        frontier = cut_lineage(step.join(found, ["seed", "ancestor"], "left_anti"))
        if frontier.isEmpty():
            break
        found = cut_lineage(found.unionByName(frontier))
    return found


def change_ratio(children: DataFrame, parents: DataFrame, by: list[str], tolerance: float = Cascade.tolerance_theme) -> DataFrame:
    """``(*by, n_union, n_kept, ratio, enqueue)``: how much of the union of the children's hashes a parent does not know.

    Hashes are exploded and counted, so a group may be of any size.
    """
    union = children.select(*by, F.explode("hashes").alias("hash")).distinct()
    known = parents.select(*by, F.explode("hashes").alias("hash")).distinct().withColumn("_k", F.lit(1))
    g = union.join(known, [*by, "hash"], "left").groupBy(*by).agg(F.count(F.lit(1)).alias("n_union"), F.count("_k").alias("n_kept"))
    ratio = F.round(1 - F.col("n_kept") / F.col("n_union"), 6)
    return g.withColumn("ratio", ratio).withColumn("enqueue", F.col("ratio") > tolerance)


def cascade(nodes: DataFrame, theme: Column, tolerances: tuple[float, float] = (Cascade.tolerance_theme, Cascade.tolerance_project)) -> DataFrame:
    """``(project, level, subject, n_union, n_kept, ratio, enqueue)``: which parents the present children make due.

    Nodes are ``(id, project, level, subject, hashes, rejected, stale)``. Children of level 1 belong to the theme of their
    subject, those of level 2 to the project. A parent is due if there is none, if it is stale, or if more than the
    tolerance of the union of the children's hashes is new to it; a due theme counts as changed for its project too. Of
    several parents the newest id counts; rejected nodes do not count.
    """
    live = nodes.where("not rejected").select("id", "project", "level", "subject", "hashes", "stale", theme.alias("theme"))
    due = None
    out = []
    for child, tolerance in ((1, tolerances[0]), (2, tolerances[1])):
        subject = F.col("theme") if child == 1 else F.col("project")
        kids = live.where(F.col("level") == child).select("project", subject.alias("subject"), "hashes")
        have = live.where(F.col("level") == child + 1).groupBy("project", "subject").agg(F.max_by(F.struct("hashes", "stale"), "id").alias("p")).select("project", "subject", "p.hashes", "p.stale")
        union = kids.select("project", "subject", F.explode_outer("hashes").alias("hash")).distinct()
        known = have.select("project", "subject", F.explode("hashes").alias("hash")).distinct().withColumn("_k", F.lit(1))
        g = union.join(known, ["project", "subject", "hash"], "left").groupBy("project", "subject").agg(F.count("hash").alias("n_union"), F.count("_k").alias("n_kept"))
        g = g.join(have.select("project", "subject", "stale", F.lit(True).alias("_have")), ["project", "subject"], "left")
        ratio = F.round(1 - F.col("n_kept") / F.greatest("n_union", F.lit(1)), 6)
        need = F.col("_have").isNull() | F.coalesce("stale", F.lit(False)) | (ratio > tolerance)
        if due is not None:
            g = g.join(due, "project", "left")
            need = need | F.coalesce("_due", F.lit(False))
        g = g.select("project", F.lit(child + 1).alias("level"), "subject", "n_union", "n_kept", ratio.alias("ratio"), need.alias("enqueue"))
        out.append(g)
        due = g.where("enqueue").select("project", F.lit(True).alias("_due")).distinct()
    return out[0].unionByName(out[1])


def file_jobs(files: DataFrame, known: DataFrame) -> DataFrame:
    """``(project, path)`` of the files whose set of chunk hashes is not the one a summary was made of."""
    a = files.groupBy("project", "path").agg(F.sort_array(F.collect_set("hash")).alias("now"))
    b = known.select("project", "path", F.sort_array(F.array_distinct("hashes")).alias("then"))
    return a.join(b, ["project", "path"], "left").where(~F.col("now").eqNullSafe(F.col("then"))).select("project", "path")


# -- queue --------------------------------------------------------------------------------------------------------------


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """``(job_key, generation, created)``: one open job per key; a key with an open one keeps its generation, others get the next."""
    now = jobs.groupBy("job_key").agg(F.max("generation").alias("g"), F.max(F.col("open").cast("int")).alias("o"))
    n = new.select("job_key").distinct().join(now, "job_key", "left")
    opened = F.coalesce("o", F.lit(0)) == 1
    return n.select("job_key", F.when(opened, F.col("g")).otherwise(F.coalesce(F.col("g") + 1, F.lit(0))).cast("long").alias("generation"), (~opened).alias("created"))


def claims(jobs: DataFrame, workers: DataFrame, held: DataFrame | None = None, excluded: DataFrame | None = None, banned: DataFrame | None = None, max_level: int | None = None) -> DataFrame:
    """``(worker, job_id)``: each worker, one after the other, claims the first pending job it may have.

    Jobs ``(job_id, group, priority, level, created)`` are ordered by priority, level, age and id. A worker may not have
    a job of a group of which it ``held`` a slot (``(worker, group)``) or from which it is ``excluded``; banned workers
    get none. The claims of a batch exclude each other: a worker gets one job, so one group goes to different workers.

    Jobs are read in their order only until all workers are served, and workers come in batches of CLAIM_BATCH, so what
    the driver holds is bounded by a batch and the jobs that its workers may not have.
    """
    spark = jobs.sparkSession
    w = workers.select("worker").distinct()
    if banned is not None:
        w = w.join(banned.select("worker").distinct(), "worker", "left_anti")
    open_ = jobs if max_level is None else jobs.where(F.col("level") <= max_level)
    bars = None
    for b in (held, excluded):
        if b is not None:
            bars = b.select("worker", "group") if bars is None else bars.unionByName(b.select("worker", "group"))
    if bars is not None:  # only groups that are open bar anything
        bars = bars.join(w, "worker", "left_semi").join(open_.select("group").distinct(), "group", "left_semi").distinct()
    queue = open_.orderBy("priority", "level", "created", "job_id").select("job_id", "group").toLocalIterator()
    schema = f"worker {dict(workers.dtypes)['worker']}, job_id {dict(jobs.dtypes)['job_id']}"
    out, left, last, served = spark.createDataFrame([], schema), [], None, True
    while served:
        batch = (w if last is None else w.where(F.col("worker") > F.lit(last))).orderBy("worker").limit(CLAIM_BATCH)
        names = [r[0] for r in batch.collect()]
        if not names:
            return out
        last, served = names[-1], len(names) == CLAIM_BATCH
        barred: dict = {}
        if bars is not None:
            for r in bars.join(batch, "worker", "left_semi").collect():
                barred.setdefault(r["worker"], set()).add(r["group"])
        got = []
        for name in names:
            bar = barred.get(name, ())
            at = next((i for i, j in enumerate(left) if j["group"] not in bar), None)
            if at is not None:
                got.append((name, left.pop(at)["job_id"]))
                continue
            for j in queue:
                if j["group"] not in bar:
                    got.append((name, j["job_id"]))
                    break
                left.append(j)
        out = out.unionByName(spark.createDataFrame(got, schema)) if got else out
    return out


def finished(events: DataFrame, most_attempts: int = 3) -> DataFrame:
    """``(job_id, generation, status, attempts)`` of jobs after their events ``(job_id, at, event_id, event)``.

    Events are enqueue, claim, complete, fail, expire and cancel. A failed or run-out claim makes a job pending again or,
    after so many attempts, parked; a cancel opens the next generation with no attempts; a complete after a cancel
    without another claim belongs to the old generation and does nothing.
    """
    state = "struct<generation:long,status:string,attempts:int>"

    def step(acc, e):
        claimed = acc["status"] == "claimed"
        back = F.when(acc["attempts"] >= most_attempts, "parked").otherwise("pending")
        status = (
            F.when((e == "claim") & (acc["status"] == "pending"), "claimed")
            .when((e == "complete") & claimed, "done").when(e.isin("fail", "expire") & claimed, back)
            .when((e == "cancel") & acc["status"].isin("pending", "claimed", "parked"), "pending").when((e == "enqueue") & (acc["status"] == "done"), "pending")
            .otherwise(acc["status"])
        )
        fresh = (e == "cancel") & acc["status"].isin("pending", "claimed", "parked") | (e == "enqueue") & (acc["status"] == "done")
        return F.struct(
            (acc["generation"] + fresh.cast("long")).alias("generation"), status.alias("status"),
            F.when(fresh, 0).otherwise(acc["attempts"] + ((e == "claim") & (acc["status"] == "pending")).cast("int")).alias("attempts"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("generation"), F.lit("pending").alias("status"), F.lit(0).alias("attempts")).cast(state)
    per = events.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("at", "event_id", "event"))).alias("xs"))
    return per.select("job_id", F.aggregate(F.transform("xs", lambda x: x["event"]), zero, step).alias("s")).select("job_id", "s.generation", "s.status", "s.attempts")


def expired(leases: DataFrame, now_ms: int) -> DataFrame:
    """The leases that have run out."""
    return leases.where(F.col("claimed_ms") + F.col("lease_ms") < now_ms)


def failures(attempts: DataFrame, most: int) -> DataFrame:
    """``(job_id, attempts, state)``: jobs park after so many failed attempts, otherwise they are pending again."""
    return attempts.groupBy("job_id").agg(F.count(F.lit(1)).alias("attempts")).withColumn("state", F.when(F.col("attempts") >= most, "parked").otherwise("pending"))


# -- trust and quorum ---------------------------------------------------------------------------------------------------


def _folded(steps: Column) -> Column:
    """A list of ``(shift, low, high)`` in order as one such step: shift, then hold between low and high."""
    none = F.struct(F.lit(0).cast("long").alias("shift"), F.lit(-(1 << 40)).cast("long").alias("low"), F.lit(1 << 40).cast("long").alias("high"))

    def then(a, b):
        low = F.least(F.greatest(a["low"] + b["shift"], b["low"]), b["high"])
        high = F.least(F.greatest(a["high"] + b["shift"], b["low"]), b["high"])
        return F.struct((a["shift"] + b["shift"]).alias("shift"), low.alias("low"), high.alias("high"))

    return F.aggregate(steps, none, then)


def trust(events: DataFrame, start: int = 10, most: int = 10, strike: int = 2, accept: int = 1) -> DataFrame:
    """``(user, trust, strikes)`` from ``(user, at, id, accepted)``, in tenths of trust.

    A rejected work takes trust (to zero at least) and adds a strike, an accepted one adds trust (to the most) and takes
    a strike. Held sums compose, so the events of an hour are folded to one step first and the hours of a user then;
    one user may have very many events.
    """
    ok = F.col("accepted")

    def one(shift: Column, low: int, high: int) -> Column:
        return F.struct(shift.cast("long").alias("shift"), F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high"))

    e = events.select("user", "at", "id", one(F.when(ok, accept).otherwise(-strike), 0, most).alias("t"), one(F.when(ok, -1).otherwise(1), 0, 1 << 40).alias("s"))
    hours = e.groupBy("user", F.date_trunc("hour", "at").alias("hour")).agg(F.sort_array(F.collect_list(F.struct("at", "id", "t", "s"))).alias("xs"))
    hours = hours.select("user", "hour", _folded(F.transform("xs", lambda x: x["t"])).alias("t"), _folded(F.transform("xs", lambda x: x["s"])).alias("s"))
    users = hours.groupBy("user").agg(F.sort_array(F.collect_list(F.struct("hour", "t", "s"))).alias("xs"))
    users = users.select("user", _folded(F.transform("xs", lambda x: x["t"])).alias("t"), _folded(F.transform("xs", lambda x: x["s"])).alias("s"))

    def at(x: str, v: int) -> Column:
        return F.least(F.greatest(F.lit(v) + F.col(f"{x}.shift"), F.col(f"{x}.low")), F.col(f"{x}.high"))

    return users.select("user", at("t", start).alias("trust"), at("s", 0).alias("strikes"))


def decide(ids: list[int], vectors: np.ndarray, trusts: list[float], slots: int, least: float) -> tuple[str, int | None, list[int]]:
    """The outcome of one quorum ``(outcome, published id, supporting ids)``.

    The largest group of candidates of which every two are similar enough decides, of equal ones the one whose least
    similarity is greatest; it needs 2f+1 members where f is a third of the candidates less one. Published is the member
    closest to the mean of the group, weighted by half and half its author's trust. A single candidate where one is
    enough is accepted.
    """
    n = len(ids)
    if n < slots:
        return "pending", None, []
    need = 2 * ((n - 1) // 3) + 1
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    sim = np.round(unit @ unit.T, 6)
    near = [{j for j in range(n) if j != i and sim[i, j] >= least} for i in range(n)]
    best: list[int] = []
    rank = (0, -2.0)

    def grow(group: list[int], among: set[int], gone: set[int]) -> None:  # maximal groups by pivoting
        nonlocal best, rank
        if not among and not gone:
            low = min((sim[a, b] for a, b in itertools.combinations(group, 2)), default=1.0)
            if (len(group), low) > rank:
                best, rank = sorted(group), (len(group), low)
            return
        if len(group) + len(among) < rank[0]:
            return
        pivot = max(among | gone, key=lambda v: len(near[v] & among))
        for v in sorted(among - near[pivot]):
            grow([*group, v], among & near[v], gone & near[v])
            among, gone = among - {v}, gone | {v}

    if n == 1:
        best = [0]
    else:
        grow([], set(range(n)), set())
        if len(best) < 2:
            best = []
    if not best or len(best) < need:
        return "rejected", None, []
    centre = vectors[best].mean(0)
    length = np.linalg.norm(centre)
    value = [round(float(unit[i] @ centre / length if length else 0.0) * (0.5 + 0.5 * max(trusts[i], 0.0)), 6) for i in best]
    return "accepted", ids[best[int(np.argmax(value))]], [ids[i] for i in best]


def quorum(candidates: DataFrame, by: list[str], slots: int = Quorum.slots, least: float = Quorum.similarity) -> DataFrame:
    """``(*by, outcome, published, supporters)`` from all pending candidates ``(id, *by, vector, trust)`` of a subject.

    Candidates of a subject are as many as workers answered for it, a handful by the slots of its job.
    """
    c = candidates.select("id", *by, "vector", F.coalesce("trust", F.lit(1.0)).alias("trust"))
    fields = [f for f in c.schema if f.name in by]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", outcome string, published long, supporters array<long>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        dims = max(len(v) for v in pdf.vector)
        x = np.array([np.pad(np.asarray(v, np.float64), (0, dims - len(v))) for v in pdf.vector])
        out, pub, sup = decide(pdf.id.tolist(), x, pdf.trust.tolist(), slots, least)
        row = {f.name: [pdf[f.name].iloc[0]] for f in fields}
        return pd.DataFrame(row | {"outcome": [out], "published": pd.array([pub], dtype="Int64"), "supporters": [sup]})

    return c.where("vector is not null").groupBy(*by).applyInPandas(run, schema)


def after_quorum(decided: DataFrame, candidates: DataFrame, by: list[str]) -> DataFrame:
    """``(id, *by, author, verdict)``: what a decision means for each submission ``(id, *by, author)``.

    Supporters are accepted; in an accepted quorum the others are rejected, in a rejected one all are, and their
    authors are excluded from the job that opens again (``verdict`` rejected of an outcome ``rejected``: reassigned).
    """
    j = candidates.join(decided.select(*by, "outcome", "supporters"), by).where("outcome <> 'pending'")
    verdict = F.when(F.array_contains("supporters", F.col("id")), "accepted").when(F.col("outcome") == "rejected", "reassigned").otherwise("rejected")
    return j.select("id", *by, "author", verdict.alias("verdict"))


def standing(trusted: DataFrame, k: int, ban_strikes: int = Quorum.ban_strikes) -> DataFrame:
    """``(user, trust, strikes, banned, rank)``: the k workers of most trust, of equal ones those of fewest strikes."""
    w = W.orderBy(F.col("trust").desc(), "strikes", "user")
    first = trusted.orderBy(F.col("trust").desc(), "strikes", "user").limit(k)
    return first.withColumn("banned", F.col("strikes") >= ban_strikes).withColumn("rank", F.row_number().over(w) - 1)
