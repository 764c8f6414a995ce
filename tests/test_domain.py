from datetime import datetime as D

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kbspark.functions import chunks as C
from kbspark.functions import scores, vectors
from kbspark.functions import text as T
from kbspark.operators import cache as Q
from kbspark.operators import graph as G
from kbspark.operators import maintenance as M
from kbspark.operators import maps as P
from kbspark.operators import revisions as R
from kbspark.operators import serving as V


def test_chunk_lines(spark):
    def cut(text, most, over):
        df = spark.createDataFrame([(1, text, "x")], "id long, content string, text string")
        return [(r.line_start, r.line_end, r.text) for r in C.chunk_lines(df, "content", most, over).orderBy("chunk_no").collect()]

    five = "a\nb\nc\nd\ne"
    assert [(a, b) for a, b, _ in cut(five, 3, 0)] == [(1, 3), (4, 5)]
    assert [(a, b) for a, b, _ in cut(five + "\n", 3, 1)] == [(1, 3), (3, 5)]
    assert cut("a\r\nb\r\n", 5, 0) == [(1, 2, "a\nb")] and cut("", 3, 0) == [] and cut(None, 3, 0) == []
    assert [(a, b) for a, b, _ in cut(five, 0, 9)] == [(i, i) for i in range(1, 6)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("abcdefgh", min_size=1, max_size=9), min_size=1, max_size=31).map(" ".join), min_size=1, max_size=12).map("\n\n".join), st.integers(8, 64), st.integers(0, 7))
def test_text_chunks_lose_no_word(text, limit, overlap):
    spans = C.text_chunks(text, limit, overlap)
    covered = set()
    for a, b in spans:
        assert 0 <= a < b <= len(text)
        piece = text[a:b]
        assert C.words_of(piece) <= limit or len(piece.split()) == 1
        covered.update(range(a, b))
    assert all(c.isspace() or i in covered for i, c in enumerate(text))


@settings(max_examples=40, deadline=None)
@given(st.text("ab .\n#", max_size=300))
def test_other_chunkers_keep_the_text(text):
    for spans in (C.recursive_chunks(text, 5), C.byte_chunks(text, 40, 10), C.markdown_chunks(text)):
        covered = {i for a, b in spans for i in range(a, b)}
        assert all(c.isspace() or i in covered for i, c in enumerate(text))


def test_code_chunks():
    code = "use a;\nfn one() {\n}\n\nfn two() {\n  x\n}\n"
    assert [code[a:b].split("(")[0] for a, b in C.code_chunks(code, "rust", 4)] == ["fn one", "fn two"]
    assert len(C.code_chunks(code, "rust", 100)) == 1 and C.code_chunks("x\ny\n", None, 100) == [(0, 4)]
    assert C.byte_chunks("é" * 10, 5, 2) == [(0, 2), (2, 4), (4, 6), (6, 8), (8, 10)]


def test_revisions(spark):
    u = spark.createDataFrame([(1, "a", "x", 1, None), (2, "a", "y", 3, None), (3, "b", "z", 2, 4), (4, None, "n", 2, None)], "id long, key string, hash string, at long, gone long")
    assert {(r.id, r.version, r.superseded_by, r.is_active) for r in R.chains(u, ["key"], ["at"]).collect()} == {(1, 1, 2, False), (2, 2, None, True), (3, 1, None, True), (4, 1, None, True)}
    a, b = (R.snapshot(u, ["key"], "at", "gone", t) for t in (2, 5))
    assert {(r.key, r.status) for r in R.difference(a, b, ["key"], "hash").collect()} == {("a", "changed"), ("b", "orphan"), (None, "same")}
    assert [r.id for r in R.as_of(u, ["key"], "at", 0).collect()] == []
    t = spark.createDataFrame([("k", 2)], "k string, n long")
    assert {tuple(r) for r in R.upsert_counter(t, spark.createDataFrame([("k",), ("m",), ("m",)], "k string"), ["k"], "n").collect()} == {("k", 3), ("m", 2)}
    assert R.insert_or_ignore(t, spark.createDataFrame([("k", 9), ("z", 1), ("z", 1)], "k string, n long"), ["k"]).count() == 2


def test_plan_table(spark):
    rows = [(0.2, 0.0), (0.92, 0.1), (0.95, 0.8), (0.65, 0.6), (0.45, 0.9)]
    got = spark.createDataFrame(rows, "s double, j double").select(scores.qa_plan(F.col("s"), F.col("j")).alias("p")).collect()
    assert [tuple(r.p) for r in got] == [(True, -1, 20, 10), (True, -1, 20, 10), (False, 0, 10, 5), (False, 3, 15, 8), (True, -1, 20, 10)]


def test_confidence_bounds(spark):
    df = spark.range(400).select((F.rand(1) * 1.4 - 0.2).alias("s"), (F.rand(2) * 20).cast("int").alias("d"), (F.rand(3) * 400).cast("int").alias("a"), (F.rand(4) * 5).cast("int").alias("c"), (F.rand(5) * 5).cast("int").alias("x"))
    v = df.select(scores.confidence(*[F.col(c) for c in "sdacx"]).alias("v"), scores.confidence(F.col("s") + 0.1, *[F.col(c) for c in "dacx"]).alias("more"))
    assert v.where("v < 0 or v > 1 or more < v - 1e-12").count() == 0
    assert [scores.summary_split(*x) for x in ((10, 0.6, 8), (10, 0.6, 2), (10, 0.6, 0), (10, 1, 20), (1, 0.6, 5))] == [(6, 4), (2, 8), (0, 10), (9, 1), (0, 1)]


def test_trust(spark):
    rows = [(1, D(2024, 1, 1, h, m), h * 100 + m, ok) for h, m, ok in ((0, 1, False), (0, 2, False), (1, 0, True), (2, 0, False), (2, 1, False), (2, 2, False), (3, 0, True), (4, 0, True))]
    trust, strikes = 10, 0
    for r in rows:
        trust = min(trust + 1, 10) if r[3] else max(trust - 2, 0)
        strikes = max(strikes - 1, 0) if r[3] else strikes + 1
    df = spark.createDataFrame(rows, "user long, at timestamp, id long, accepted boolean")
    assert [tuple(r) for r in G.trust(df).collect()] == [(1, trust, strikes)]
    assert G.trust(df.limit(0)).count() == 0


def test_quorum():
    same, other, odd, none = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [0.0, 0.0, 0.0]

    def decide(ids, vectors_, trusts, slots):
        return G.decide(ids, np.array(vectors_), trusts, slots, 0.8)

    assert decide([1, 2, 3], [same, same, other], [1, 1, 1], 4)[0] == "pending"
    assert decide([1, 2, 3, 4], [same, same, other, same], [1, 1, 1, 1], 4) == ("accepted", 1, [1, 2, 4])
    assert decide([1, 2, 3, 4], [same, other, odd, none], [1, 1, 1, 1], 4)[0] == "rejected"
    assert decide([1, 2, 3], [same, same, same], [0.1, 1, 0.5], 3)[1] == 2
    assert decide([7], [same], [1], 1) == ("accepted", 7, [7]) and decide([1, 2], [same, other], [1, 1], 2)[0] == "rejected"
    assert decide([1, 2, 3, 4, 5], [same, same, other, other, other], [1] * 5, 3)[2] == [3, 4, 5]


def test_quorum_of_many(spark):
    df = spark.createDataFrame([(i, 1, [1.0, 0.0] if i != 3 else [0.0, 1.0], None, f"u{i}") for i in range(5)] + [(9, 2, None, 1.0, "x")], "id long, subject int, vector array<double>, trust double, author string")
    d = G.quorum(df, ["subject"])
    assert [(r.subject, r.outcome, r.published, r.supporters) for r in d.collect()] == [(1, "accepted", 0, [0, 1, 2, 4])]
    assert {(r.author, r.verdict) for r in G.after_quorum(d, df, ["subject"]).collect()} == {("u0", "accepted"), ("u1", "accepted"), ("u2", "accepted"), ("u4", "accepted"), ("u3", "rejected")}


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 2), (5, None), (1, 2)], "child long, parent long")
    got = {(r.seed, r.ancestor) for r in G.ancestors(e, spark.createDataFrame([(1,), (4,), (5,)], "id long")).collect()}
    assert got == {(1, 2), (1, 3), (4, 2), (4, 3), (4, 1)}
    kids = spark.createDataFrame([("p", ["a", "b"]), ("p", ["b", "c"]), ("q", [])], "project string, hashes array<string>")
    r = G.change_ratio(kids, spark.createDataFrame([("p", ["a"])], "project string, hashes array<string>"), ["project"]).collect()
    assert [(x.project, x.n_union, x.n_kept, x.enqueue) for x in r] == [("p", 3, 1, True)]


def test_claims(spark, monkeypatch):
    jobs = spark.createDataFrame([(i, f"g{i}", i % 2, 0, i) for i in range(6)] + [(10, "g0", 0, 3, 0)], "job_id long, group string, priority int, level int, created int")
    w = spark.createDataFrame([(1,), (2,), (3,)], "worker long")

    def got(*barred, **how):
        return dict(tuple(x) for x in G.claims(jobs, w, excluded=spark.createDataFrame(list(barred), "worker long, group string"), **how).collect())

    assert got() == {1: 0, 2: 2, 3: 4}
    assert got((1, "g0")) == {1: 2, 2: 0, 3: 4}  # an excluded worker gets the next job, the job goes to the next worker
    assert got((1, "g0"), (2, "g0"), (3, "g0")) == {1: 2, 2: 4, 3: 1}
    assert got(banned=w.where("worker = 2")) == {1: 0, 3: 2}
    assert got(held=spark.createDataFrame([(3, "g4")], "worker long, group string"), max_level=0) == {1: 0, 2: 2, 3: 1}
    monkeypatch.setattr(G, "CLAIM_BATCH", 1)
    assert got((1, "g0"), (2, "g2")) == {1: 2, 2: 0, 3: 4}
    few = jobs.where("job_id < 1")
    assert G.claims(few, w).count() == 1 and G.claims(few.limit(0), w).count() == 0 and G.claims(jobs, w.limit(0)).count() == 0


def test_job_states(spark):
    steps = {1: ["claim", "complete"], 2: ["claim", "fail", "claim", "expire", "claim", "fail"], 3: ["claim", "cancel", "complete"], 4: ["complete"], 5: ["claim", "complete", "enqueue", "claim"]}
    e = spark.createDataFrame([(j, i, i, x) for j, xs in steps.items() for i, x in enumerate(xs)], "job_id long, at long, event_id long, event string")
    got = {r.job_id: (r.generation, r.status, r.attempts) for r in G.finished(e).collect()}
    assert got == {1: (0, "done", 1), 2: (0, "parked", 3), 3: (1, "pending", 0), 4: (0, "pending", 0), 5: (1, "claimed", 1)}


def test_cascade(spark):
    rows = [(1, "p", 1, "a/x", ["h1", "h2"]), (2, "p", 1, "a/y", ["h3"]), (3, "p", 2, "a", ["h1", "h2", "h3"]), (4, "p", 3, "p", ["z"]), (5, "q", 1, "b/x", []), (6, "q", 2, "b", None)]
    n = spark.createDataFrame([(*r, False, False) for r in rows], "id long, project string, level int, subject string, hashes array<string>, rejected boolean, stale boolean")
    got = {(r.project, r.level, r.subject): (r.n_union, r.n_kept, r.enqueue) for r in G.cascade(n, T.theme_of(F.col("subject"))).collect()}
    assert got == {("p", 2, "a"): (3, 3, False), ("p", 3, "p"): (3, 0, True), ("q", 2, "b"): (0, 0, True), ("q", 3, "q"): (0, 0, True)}


def test_parents_over_stretches(spark):
    rows = [(i, "p", 1 + (i * 7) % 3) for i in range(60)] + [(100 + i, None, 1 + i % 3) for i in range(5)]
    want, last = set(), {}
    for i, p, v in sorted(rows):
        if v < 3 and (p, v + 1) in last:
            want.add((i, last[p, v + 1]))
        last[p, v] = i
    for stretch in (3, 10, 1000):
        assert {tuple(r) for r in G.parents(spark.createDataFrame(rows, "id long, project string, level int"), stretch).collect()} == want


def test_cache(spark):
    e = spark.createDataFrame([(1, "p", "How to?", ["a"], 3, 0, False), (2, "p", "how TO?", ["b"], 1, 0, False), (3, "p", "old", ["c"], 0, 0, True), (4, "q", None, None, 0, 0, False)], "id long, project string, question string, hashes array<string>, access_count int, used_ms long, stale boolean")
    q = spark.createDataFrame([(1, "p", "howto?"), (2, "p", "old"), (3, "q", None)], "query_id long, project string, question string")
    assert {r.query_id: r.id for r in Q.exact_hits(q, e).collect()} == {1: 1, 2: None, 3: None}
    assert {r.id for r in Q.stale_by_hashes(e, spark.createDataFrame([("b",), ("b",)], "hash string")).collect()} == {2}
    assert {r.id: r.intact for r in Q.provenance(e, spark.createDataFrame([("a",)], "hash string")).collect()} == {1: True, 2: False, 3: False, 4: True}
    assert {r.id for r in Q.evictions(e, 1, 1000.0, 1000).collect()} == {2, 3}
    near = spark.createDataFrame([(2, 2, 0.95), (3, 4, 0.95)], "query_id long, id long, similarity double")
    jac = Q.overlaps(near, spark.createDataFrame([(2, 7), (2, 8)], "query_id long, chunk long"), spark.createDataFrame([(2, 7), (2, 8), (4, 9)], "id long, chunk long"))

    def outcome(intact):
        return {r.query_id: (r.outcome, r.id) for r in Q.lookup(q, e, e.where(intact), near, jac).collect()}

    assert outcome("true") == {1: ("exact", 1), 2: ("near", 2), 3: ("miss", None)}
    assert outcome("id > 2") == {1: ("miss", None), 2: ("miss", None), 3: ("miss", None)}  # a lost source makes a hit a miss
    v = e.withColumn("vector", F.array(F.lit(1.0), F.col("id").cast("double")))
    asked = spark.createDataFrame([(9, "p", [1.0, 2.0]), (8, None, [1.0, 2.0])], "query_id long, project string, vector array<double>")
    assert [(r.query_id, r.id) for r in Q.nearest(asked, v).collect()] == [(9, 2)]


def test_store_answers(spark):
    old = spark.createDataFrame([(1, "p", "h", 1, None, 0)], "id long, project string, hash string, version long, superseded_by long, stored_ms long").withColumn("hash", T.question_hash(F.lit("How to?")))
    new = spark.createDataFrame([(5, "p", "how TO?"), (6, "p", "Howto?"), (7, "q", "x"), (8, "p", None)], "id long, project string, question string")
    got = {r.id: (r.version, r.superseded_by) for r in Q.store_answers(old, new, 9).collect()}
    assert got == {1: (1, 5), 5: (2, 6), 6: (3, None), 7: (1, None)}


def test_maps(spark):
    r = spark.createDataFrame([(1, "p", "", "s", "b", ["a", "./a", None, "gone"], 1), (2, "p", "g", "s" * 4001, "b", None, 1)], "request_id long, project string, goal string, summary string, body_markdown string, files array<string>, path long")
    assert [x.problems for x in P.problems(r).orderBy("request_id").collect()] == [["goal missing"], ["summary too long"]]
    files = spark.createDataFrame([("p", "a", "h2"), ("p", "a", "h1")], "project string, path string, hash string")
    assert {(x.path, x.hash) for x in P.resolved(P.anchors(r), files).collect()} == {("a", "h1"), ("gone", None)}
    assert [tuple(x) for x in P.broken(P.resolved(P.anchors(r), files), files).collect()] == [(1, ["gone"])]
    changed = spark.createDataFrame([("p", "a", "h9")], "project string, path string, hash string")
    broken = P.broken(P.resolved(P.anchors(r), files), changed)
    assert [tuple(x) for x in broken.collect()] == [(1, ["a", "gone"])]  # a changed hash breaks an anchor
    m = spark.createDataFrame([(1, "p", "fresh"), (2, "p", "fresh")], "id long, project string, status string")
    assert {(x.id, x.status, x.stale_reason) for x in P.mark_stale(m, broken).collect()} == {(1, "stale", '["a","gone"]'), (2, "fresh", None)}
    assert {(x.project, x.epoch) for x in P.bumped(spark.createDataFrame([("p", 3), ("z", 1)], "project string, epoch long"), spark.createDataFrame([("p",), ("n",), ("p",)], "project string")).collect()} == {("p", 4), ("z", 1), ("n", 1)}
    ev = spark.createDataFrame([(1, i, i, True) for i in range(5)] + [(1, 9, 9, False)], "id long, at long, event_id long, contradicts boolean")
    assert [tuple(x) for x in P.feedback(ev).collect()] == [(1, 1, 5, 2)]
    s = spark.createDataFrame([(1, 0.2), (1, 0.3), (2, 0.1)], "id long, similarity double")
    assert {x.id: x.grounded for x in P.grounded(s).collect()} == {1: True, 2: False}


def test_map_search_gates(spark):
    states = ["fresh", "retired", "pending_review", "stale", "fresh"]
    maps = spark.createDataFrame([(i, "p", f"g{i}", st, 5, 1, 1, 0, 5) for i, st in enumerate(states)], "id long, project string, goal string, status string, epoch long, age_days int, confirmed int, contradicted int, now_epoch long")
    near = spark.createDataFrame([(1, i, 0.9 - i / 100, i) for i in range(5)], "query_id long, id long, similarity double, rank int")
    bad = spark.createDataFrame([(4,)], "id long")
    assert [r.id for r in P.search(near, maps, bad).collect()] == [0]
    assert {r.id for r in P.search(near, maps, bad, include_stale=True).collect()} == {0, 3, 4}
    assert P.search(near.withColumn("similarity", F.lit(0.4)), maps, bad, include_stale=True).count() == 0
    older = maps.unionByName(spark.createDataFrame([(90, "p", "g0", "fresh", 2, 1, 1, 0, 5)], maps.schema))
    assert [r.id for r in P.search(near, older, bad.limit(0), as_of=3).collect()] == [90]


def test_serving(spark):
    n = spark.createDataFrame([(1, "p", 2, "s", "t", "approved", False, None), (2, "p", 2, "s", "t", "approved", True, None), (3, "q", 1, "s", "t", "pending", False, None), (4, "q", 1, "s", "t", "approved", None, 1)], "id long, project string, level int, subject string, summary_text string, review_status string, stale boolean, deleted_at long")
    assert [r.id for r in V.servable(n).collect()] == [1] and V.servable(n, "q").count() == 0
    lex = spark.createDataFrame([(7, 1, 2.0), (7, 2, 1.0)], "query_id long, id long, score double")
    sem = spark.createDataFrame([(7, 3, 0.9, 0), (7, 1, 0.8, 1)], "query_id long, id long, score double, rank int")
    got = V.summaries(lex, sem, n.where("id < 3"))
    assert [(r.id, round(r.norm, 6)) for r in got.orderBy("rank").collect()] == [(1, 1.0), (2, 0.0)]
    assert [r.path for r in V.as_chunks(got.where("id = 1"), n).collect()] == ["[summary:2] s"]
    chunks = spark.createDataFrame([(7, i, 1 - i / 10) for i in range(10)], "query_id long, id long, norm double")
    maps = spark.createDataFrame([(7, 50, 0.5)], "query_id long, id long, confidence double")
    kinds = [r.kind for r in V.unified(chunks, got, maps).collect()]
    assert (kinds.count("chunk"), kinds.count("summary"), kinds.count("map")) == (9, 1, 1)
    rep = spark.createDataFrame([(1, 2)], "a long, b long")
    assert tuple(V.merged_reports([rep, rep]).first()) == (2, 4)
    use = spark.createDataFrame([("k", 1, 1, 3, 4), ("k", 2, 2, 5, 0)], "key string, at int, id int, prompt int, completion int")
    assert [r.remaining for r in V.budget_left(use, 10).orderBy("id").collect()] == [3, 0]


def test_maintenance(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(30)], "id long, k string")
    assert {r.id for r in M.duplicates(df, ["k"]).collect()} == {i for i in range(30) if i % 3 and i != 29}
    assert M.duplicates(df.limit(0), ["k"]).count() == 0


def test_embedders(spark):
    df = spark.createDataFrame([("a",), (None,), ("",)], "t string").select(vectors.embed(F.col("t"), 8).alias("h"), vectors.embed(F.col("t"), 5, "digest").alias("d")).collect()
    assert len(df[0].h) == 8 and abs(sum(x * x for x in df[0].h) - 1) < 1e-5 and df[1].h is None and len(df[2].d) == 5
    v = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<float>").select(vectors.fit_dims(F.col("v"), 3).alias("f"), vectors.unpack(vectors.pack(F.col("v"))).alias("u")).collect()
    assert v[0].f == [1.0, 2.0, 0.0] and v[0].u == [1.0, 2.0] and v[1].u is None
