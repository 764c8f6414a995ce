import math
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.functions.porter import stem
from kbspark.operators import context as X
from kbspark.operators import index as I
from kbspark.operators import search as S

DOCS = [(1, "b", "alpha bravo bravo"), (2, "b", "alpha charlie"), (3, "c", ""), (4, "c", None), (5, "c", "Ünïcode ALPHA alpha_beta"), (6, "b", "delta " * 3000)]


def docs(spark):
    return spark.createDataFrame([(*d, "x") for d in DOCS], "id long, buffer string, text string, term string")


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, text string")


def fts5(rows, match):
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table f using fts5(x, tokenize='porter unicode61')")
    c.executemany("insert into f(rowid, x) values (?, ?)", [(i, (t or "").replace("_", " ")) for i, t in rows])
    return {i: -s for i, s in c.execute("select rowid, bm25(f) from f where f match ?", (match,))}


def same(got, want):
    return got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-6, abs_tol=1e-9) for k in got)


def test_bm25_equals_fts5(spark):
    got = {r.id: r.score for r in S.bm25(queries(spark, "alpha bravo"), docs(spark)).collect()}
    assert same(got, fts5([(i, t) for i, _, t in DOCS], "alpha OR bravo"))


STEMS = [(1, "The claim handler claims jobs"), (2, "claiming, claimed; handled"), (3, "relational relations relate"), (4, "Ünïted unity"), (5, "a b c"), (6, "nothing here")]


def test_bm25_stems_as_fts5(spark):
    df = spark.createDataFrame([(i, "b", t) for i, t in STEMS], "id long, buffer string, text string")
    for words in ("claims", "handling relation", "united", "jobs nothing"):
        got = {r.id: r.score for r in S.bm25(queries(spark, words), df).collect()}
        assert got and same(got, fts5(STEMS, " OR ".join(words.split())))


def test_stored_index(spark, tmp_path):
    path = str(tmp_path / "ix")
    base = spark.createDataFrame([(i, "b", t) for i, t in STEMS] + [(7, "c", None), (8, "c", "")], "id long, buffer string, text string")
    index = I.current(base, path, buckets=4)
    q = queries(spark, "claims", "handling relation", "zzz")

    def hits(ix, mode="or"):
        return {(r.query_id, r.id, round(r.score, 9)) for r in ix.search(q, mode).collect()}

    def plain(df, mode="or"):
        return {(r.query_id, r.id, round(r.score, 9)) for r in S.bm25(q, df, mode).collect()}

    for mode in ("or", "and", "fallback"):
        assert hits(index, mode) == plain(base, mode)
    new = spark.createDataFrame([(2, "b", "relation of claims"), (9, "b", "handle handle claims")], "id long, buffer string, text string")
    for _ in range(2):  # an extension that is written again changes nothing more
        I.extend(new, path, spark.createDataFrame([(3,), (77,)], "id long"))
        import shutil

        now = base.where("id not in (2, 3)").unionByName(new)
        index = I.Index(spark, path)
        assert hits(index) == plain(now) and index.n_docs == now.count()
        shutil.rmtree(f"{path}/counts/segment=1")
    I.extend(new, path, spark.createDataFrame([(3,), (77,)], "id long"))
    I.compact(spark, path, str(tmp_path / "small"))
    assert hits(I.Index(spark, str(tmp_path / "small"))) == plain(now)
    assert I.current(now, path).n_docs == now.count() and not hits(I.current(base.limit(0), str(tmp_path / "none")))
    scan = index.postings(q.selectExpr("'claim' as term"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [claim])" in scan or "EqualTo(term,claim)" in scan
    assert "bucket" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_many_queries_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_QUERIES", 2)
    q = queries(spark, "alpha", "bravo", "charlie", "alpha charlie", "zzz")
    assert {(r.query_id, r.id) for r in S.bm25(q, docs(spark), "fallback").collect()} == {(1, 1), (1, 2), (1, 5), (2, 1), (3, 2), (4, 2)}
    v = spark.createDataFrame(VEC, "id long, buffer int, vector array<float>")
    every = v.selectExpr("id as query_id", "buffer", "vector")
    got = {(r.query_id, r.id, r.rank) for r in S.vector_search(every, v, 3, "cosine").collect()}
    plan = S.vector_search(every, v, 3)._jdf.queryExecution().executedPlan().toString() + S.entity_search(q.selectExpr("query_id", "text as entity"), S.entity_index(docs(spark).withColumn("path", F.lit("a")))).groupBy().count()._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "SortMergeJoin [size" not in plan
    monkeypatch.setattr(S, "BROADCAST_QUERIES", 100)
    assert got == {(r.query_id, r.id, r.rank) for r in S.vector_search(every, v, 3, "cosine").collect()}
    assert S.within_radius(every, v, 0.7).count() == 8


def test_entity_phrases(spark):
    df = spark.createDataFrame([(1, "b", "parse_snapshot_session"), (2, "b", "snapshot"), (3, "b", "snapshots_x"), (4, "b", "session")], "id long, buffer string, entity string")
    q = spark.createDataFrame([(1, "snapshot_sess"), (2, "Snapshot"), (3, "_"), (4, None), (5, "shot")], "query_id long, entity string")
    assert {(r.query_id, r.id) for r in S.entity_search(q, df).collect()} == {(1, 1), (2, 1), (2, 2), (2, 3)}
    assert S.entity_search(q.limit(0), df).count() == 0 and S.entity_search(q, df.limit(0)).count() == 0


def test_bm25_modes(spark):
    q = queries(spark, "alpha bravo", "alpha nothing", "nothing", "", "ünïcode")
    ids = {m: {(r.query_id, r.id) for r in S.bm25(q, docs(spark), m).collect()} for m in ("and", "or", "fallback")}
    assert ids["and"] == {(1, 1), (5, 5)}
    assert ids["or"] == {(1, 1), (1, 2), (1, 5), (2, 1), (2, 2), (2, 5), (5, 5)}
    assert ids["fallback"] == {(1, 1), (2, 1), (2, 2), (2, 5), (5, 5)}


def test_bm25_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, buffer string, text string")
    assert S.bm25(queries(spark, "alpha"), empty).count() == 0
    assert S.bm25(queries(spark), docs(spark)).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    r = spark.createDataFrame([(1, 9, 1.0), (1, 3, 1.0), (1, 5, 2.0)], "query_id long, id long, score double")
    assert [x.id for x in S.top_k(r, 2).orderBy("rank").collect()] == [5, 3]


def test_entities(spark):
    df = spark.createDataFrame([(1, "b", "src/auth.rs", "pub fn validate_token(x: UserId) {}\nuse crate::auth::session;"), (2, "b", None, None), (3, "b", ".env", "")], "id long, buffer string, path string, text string")
    got = {}
    for r in S.entity_index(df).collect():
        got.setdefault(r.id, []).append(r.entity)
    assert sorted(got[1]) == ["auth", "session", "userid", "validate_token"] and got[3] == [".env"] and 2 not in got
    hits = S.entity_search(spark.createDataFrame([(1, "Validate"), (1, "user"), (2, "zzz")], "query_id long, entity string"), S.entity_index(df)).collect()
    assert [(h.query_id, h.id, h.score) for h in hits] == [(1, 1, 2.0)]


VEC = [(1, 1, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 2, [1.0, 1.0]), (4, 2, [0.0, 0.0]), (5, 2, [1.0]), (6, 1, None), (7, 1, [2.0, 0.0])]


def test_vectors(spark):
    v = spark.createDataFrame(VEC, "id long, buffer int, vector array<float>")
    q = v.where("id = 1").selectExpr("id as query_id", "buffer", "vector")
    assert [r.id for r in S.vector_search(q, v, 3, "cosine").orderBy("rank").collect()] == [7, 3, 2]
    assert [r.id for r in S.vector_search(q, v, 9, "l2", same_buffer=True).orderBy("rank").collect()] == [7, 2]
    assert {r.id for r in S.within_radius(q, v, 0.7).collect()} == {3, 7}
    assert {(r.buffer, r.dim): r.value for r in S.centroids(v.where("id < 4")).collect()} == {(1, 0): 0.5, (1, 1): 0.5, (2, 0): 1.0, (2, 1): 1.0}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.permutations(range(6)), min_size=1, max_size=3))
def test_rrf_is_bounded_and_complete(spark, lists):
    dfs = [spark.createDataFrame([(1, int(i), r) for r, i in enumerate(x)], "query_id long, id long, rank int") for x in lists]
    got = {r.id: r.score for r in S.rrf(dfs).collect()}
    want = {i: sum(1 / (61 + x.index(i)) for x in lists) for i in range(6)}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i]) for i in got)
    assert max(got.values()) <= len(lists) / 61 + 1e-12


def test_budgets(spark):
    rows = [(1, 0, 10, "p", "w " * 100, 1.0), (1, 1, 11, "p", "w " * 400, 0.9), (1, 2, 12, "p", "w", 0.8), (2, 0, 13, "p", None, 0.5)]
    r = spark.createDataFrame(rows, "query_id long, rank int, id long, path string, text string, score double")
    got = {x.id: (x.was_cut, len((x.kept or "").split())) for x in X.budget_with_cut(r, 300).collect()}
    assert got == {10: (False, 100), 11: (True, 130), 13: (False, 0)}
    assert [x.id for x in X.budget_with_skip(r, 60).where("query_id = 1").orderBy("pos").collect()] == [10, 12]
    assert "0.90" in X.rendered(r.where("id = 11")).first().context


def test_text_functions(spark):
    df = spark.createDataFrame([("Über_foo-bar: ½ x²!",), ("",), (None,)], "t string")
    rows = df.select(T.sanitize(F.col("t")).alias("s"), T.tokens(F.col("t")).alias("k"), T.token_count(F.col("t")).alias("n"), T.tokens_by_words(F.col("t")).alias("w"), T.slug(F.col("t")).alias("g")).collect()
    assert rows[0].k == ["uber", "foo", "bar", "½", "x²"] and rows[0].n == 5 and rows[1].k == [] and rows[2].k == [] and rows[2].s is None and rows[1].w == 0
    f = spark.createDataFrame([("---\ngoal: g\nfiles: a, b\n---\n## Mapa\nm\n## Conexões\nc\n## X\n",), ("<think>a</think>b",), ("a<THINK>x",), ("x<think>y</think>z",)], "t string")
    got = f.select(T.contract_fields(F.col("t")).alias("c"), T.claim_text(F.col("t")).alias("m"), T.strip_thoughts(F.col("t")).alias("s"), T.front_matter(F.col("t")).alias("f")).collect()
    assert got[0].c.goal == "g" and got[0].c.files == ["a", "b"] and got[0].c.sections == ["Mapa", "Conexões", "X"] and got[0].m == "c" and got[0].f["goal"] == "g"
    assert [g.s for g in got[1:]] == ["b", "a", "x z"]


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("sky", "sky"), ("generalizations", "gener"), ("übung", "übung"), ("a", "a")])
def test_stems(word, want):
    assert stem(word) == want


def indexed(spark, tmp_path, rows, ids="long"):
    docs = spark.createDataFrame(rows, f"id {ids}, buffer string, text string").repartition(3)
    I.build(docs, str(tmp_path / "ix"), buckets=2)
    return I.Index(spark, str(tmp_path / "ix"))


WORDS = ["claim", "queue", "relation", "unity", "handler"]
MANY = [(i, [None, "b", "c"][i % 3], " ".join(WORDS[j] for j in range(5) if i % (j + 2) == 0) + " word" * (i % 4)) for i in range(1, 181)]
ASKED = ["claims", "claim queue", "queue claim", "relations handled unity", "unity zzz", "zzz", ""]


def listed(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


def best_is_top_of_all(spark, index, mode, by_buffer, k=4):
    q = queries(spark, *ASKED)
    want = S.top_k(index.search(q, mode).withColumn("score", F.round("score", 6)), k, ["query_id", *["buffer"] * by_buffer])
    columns = ("query_id", "buffer", "id", "rank", "score")
    got = listed(index.top(q, k, mode, by_buffer).collect(), *columns)
    assert got and got == listed(want.collect(), *columns)


def small_blocks(monkeypatch):
    from kbspark.operators import best

    monkeypatch.setattr(best, "ROWS", 7)
    monkeypatch.setattr(best, "QUERIES", 3)


def test_best_of_any_word(spark, tmp_path, monkeypatch):
    """the best are chosen within shards, blocks and ties as from the list of all hits, which is not shuffled."""
    small_blocks(monkeypatch)
    index = indexed(spark, tmp_path, MANY)
    best_is_top_of_all(spark, index, "or", False)
    best_is_top_of_all(spark, indexed(spark, tmp_path / "2", MANY + MANY[:9]), "or", False)  # repeated ids add up
    text = [(f"k{i}", b, t) for i, b, t in MANY]
    best_is_top_of_all(spark, indexed(spark, tmp_path / "3", text, "string"), "or", False)
    plan = index.top(queries(spark, *ASKED), 4)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate" not in plan.split("MapInArrow")[0]
    assert not index.top(queries(spark, "zzz"), 4).collect() and not indexed(spark, tmp_path / "4", MANY[:1]).top(queries(spark, ""), 4).collect()


def test_index_stays_in_shards(spark, tmp_path):
    """postings are written without a shuffle and without another copy of the documents."""
    from kbspark.plans.lineage import ensure_checkpoint_dir
    import os

    before = {x for x, _, _ in os.walk(ensure_checkpoint_dir(spark).removeprefix("file:"))}
    index = indexed(spark, tmp_path, MANY)
    assert {x for x, _, _ in os.walk(ensure_checkpoint_dir(spark).removeprefix("file:"))} == before
    assert index.postings().count() == sum(len({stem(w) for w in t.split()}) for _, _, t in MANY)


def lists_no_hits(spark, small_dir, name):
    """The plan of a query holds no scores of single hits and no names met one by one."""
    import re

    from __spark_entry__ import queries as registered

    plan = registered()[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bidf#|count\(distinct wanted|\bphrase#", plan)


def test_hybrid_entity_lists_no_hits(spark, small_dir, monkeypatch):
    """F2"""
    lists_no_hits(spark, small_dir, "hybrid_entity")
    from kbspark.operators.best import by_entities

    small_blocks(monkeypatch)
    names = spark.createDataFrame([(i, "b", [["claim_job", "job_claim_x", "queue"][j] for j in range(3) if i % (j + 2)]) for i in range(1, 40)], "id long, buffer string, names array<string>")
    index = S.phrase_lists(names)
    q = spark.createDataFrame([(1, "Claim"), (1, "job"), (2, "job claim"), (3, "zzz"), (4, "qu"), (4, "claim job")], "query_id long, entity string")
    want = S.top_k(S.entity_search(q, S.entity_phrases(names.select("id", "buffer", F.explode("names").alias("entity")))), 5)
    columns = ("query_id", "id", "rank", "score")
    assert listed(by_entities(q, index, 5).collect(), *columns) == listed(want.collect(), *columns) == listed(S.top_k(S.entity_search(q, index), 5).collect(), *columns)


def test_token_budget_skip_lists_no_hits(spark, small_dir):
    """F3"""
    lists_no_hits(spark, small_dir, "token_budget_skip")


def test_bm25_or_fallback_lists_no_hits(spark, small_dir, tmp_path, monkeypatch):
    """F4"""
    lists_no_hits(spark, small_dir, "bm25_or_fallback")
    small_blocks(monkeypatch)
    best_is_top_of_all(spark, indexed(spark, tmp_path, MANY), "fallback", False)


def test_context_render_lists_no_hits(spark, small_dir):
    """F5"""
    lists_no_hits(spark, small_dir, "context_render")


def test_decay_rerank_lists_no_hits(spark, small_dir):
    """F6"""
    lists_no_hits(spark, small_dir, "decay_rerank")


def test_hybrid_fts_lists_no_hits(spark, small_dir):
    """F7"""
    lists_no_hits(spark, small_dir, "hybrid_fts")


def test_minmax_normalize_lists_no_hits(spark, small_dir):
    """F8"""
    lists_no_hits(spark, small_dir, "minmax_normalize")


def test_rrf_cross_project_lists_no_hits(spark, small_dir, tmp_path, monkeypatch):
    """F9"""
    lists_no_hits(spark, small_dir, "rrf_cross_project")
    small_blocks(monkeypatch)
    best_is_top_of_all(spark, indexed(spark, tmp_path, MANY), "or", True, 30)


def test_token_budget_truncate_lists_no_hits(spark, small_dir):
    """F10"""
    lists_no_hits(spark, small_dir, "token_budget_truncate")


def test_unified_search_lists_no_hits(spark, small_dir):
    """F11"""
    lists_no_hits(spark, small_dir, "unified_search")


def test_bm25_and_lists_no_hits(spark, small_dir, tmp_path, monkeypatch):
    """F12"""
    lists_no_hits(spark, small_dir, "bm25_and")
    small_blocks(monkeypatch)
    best_is_top_of_all(spark, indexed(spark, tmp_path, MANY), "and", False)


def test_bm25_per_buffer_lists_no_hits(spark, small_dir, tmp_path, monkeypatch):
    """F13"""
    lists_no_hits(spark, small_dir, "bm25_per_buffer")
    small_blocks(monkeypatch)
    best_is_top_of_all(spark, indexed(spark, tmp_path, MANY), "or", True, 3)


def test_hybrid_vector_lists_no_hits(spark, small_dir):
    """F14"""
    lists_no_hits(spark, small_dir, "hybrid_vector")


def test_rrf_two_lists_lists_no_hits(spark, small_dir):
    """F15"""
    lists_no_hits(spark, small_dir, "rrf_two_lists")


def stores_no_postings(spark, small_dir, name):
    """Many questions are answered from the documents alone: no postings are sorted and stored for them."""
    from __spark_entry__ import queries as registered

    from kbspark import base as D
    from kbspark.sources.files import exists

    assert registered()[name](spark, small_dir).count()
    path = D.stored(spark, small_dir, "documents")
    assert exists(spark, f"{path}/docs/segment=0/_SUCCESS") and not exists(spark, f"{path}/postings")


def test_bm25_or_fallback_stores_no_postings(spark, small_dir, tmp_path, monkeypatch):
    """documents with a term are counted without postings, in several segments too."""
    stores_no_postings(spark, small_dir, "bm25_or_fallback")
    small_blocks(monkeypatch)
    index = indexed(spark, tmp_path, MANY)
    new = spark.createDataFrame([(i, "d", t + " claim") for i, _, t in MANY[::9]] + [(999, "d", "relation relations unity")], "id long, buffer string, text string")
    I.extend(new, index.path, spark.createDataFrame([(i,) for i in range(5, 180, 7)], "id long"))
    index = I.Index(spark, index.path)
    index.top(queries(spark, *ASKED), 4, "fallback").collect()
    assert not (tmp_path / "ix/postings").exists()
    for mode in ("or", "and", "fallback"):
        best_is_top_of_all(spark, index, mode, False)
    assert {x.name for x in (tmp_path / "ix/postings").iterdir()} == {"segment=0", "segment=1"}


def test_postings_follow_a_rewritten_segment(spark, tmp_path):
    """postings that are written late are those of the documents as they are."""
    index = indexed(spark, tmp_path, MANY)
    assert index.search(queries(spark, "claims")).count() == 90
    I.build(spark.createDataFrame([(1, "b", "claim of claims"), (2, "b", "queue")], "id long, buffer string, text string"), index.path, buckets=2)
    again = I.Index(spark, index.path)
    assert [r.id for r in again.search(queries(spark, "claims")).collect()] == [1]
    assert {(r.id, r.term, r.tf) for r in again.postings().collect()} == {(1, "claim", 2), (1, "of", 1), (2, "queue", 1)}


def test_context_render_stores_no_postings(spark, small_dir):
    """F5"""
    stores_no_postings(spark, small_dir, "context_render")


def test_token_budget_truncate_stores_no_postings(spark, small_dir):
    """F10"""
    stores_no_postings(spark, small_dir, "token_budget_truncate")


def test_bm25_and_stores_no_postings(spark, small_dir):
    """F12"""
    stores_no_postings(spark, small_dir, "bm25_and")


def test_decay_rerank_stores_no_postings(spark, small_dir):
    """F6"""
    stores_no_postings(spark, small_dir, "decay_rerank")


def test_hybrid_fts_stores_no_postings(spark, small_dir):
    """F7"""
    stores_no_postings(spark, small_dir, "hybrid_fts")


def test_minmax_normalize_stores_no_postings(spark, small_dir):
    """F8"""
    stores_no_postings(spark, small_dir, "minmax_normalize")


def test_rrf_two_lists_stores_no_postings(spark, small_dir):
    """F15"""
    stores_no_postings(spark, small_dir, "rrf_two_lists")


def test_hybrid_vector_stores_no_postings(spark, small_dir):
    """F14"""
    stores_no_postings(spark, small_dir, "hybrid_vector")


def hands_on_best(monkeypatch, mode, k):
    """A shard hands on the k best of each question, not the best of each of its blocks."""
    import random

    import numpy as np
    import pyarrow as pa

    from kbspark.operators import best

    monkeypatch.setattr(best, "ROWS", 40)
    monkeypatch.setattr(best, "KEPT", 90, raising=False)
    monkeypatch.setattr(best, "SPREAD", 2, raising=False)
    draw = random.Random(k)
    held = {i: {t: draw.choice([0.25, 0.5, 1.0]) for t in range(6) if draw.random() < 0.1 * (t + 2)} for i in draw.sample(range(1000), 400)}
    sets = [np.array(x) for x in ([0, 3], [5], [2, 4, 5], [0, 1, 2, 3, 4, 5], [1, 6], [6])]
    weights = np.array([1.5, 1.0, 0.5, 0.75, 0.125, 2.0, 1.0])
    items = pa.table({"id": pa.array(list(held), pa.int64()), "buffer": ["b"] * len(held)})

    def read(part):
        got = [(r, t, v) for r, i in enumerate(part["id"].to_pylist()) for t, v in held[i].items()]
        row, term, value = zip(*got, strict=True)
        return np.array(row), np.array(term), np.array(value)

    got = [r for b in best._scorer(sets, weights, read, k, mode, False)(items.to_batches(max_chunksize=20)) for r in b.to_pylist()]
    for q, terms in enumerate(sets):
        hits = {i: [weights[t] * x[t] for t in terms if t in x] for i, x in held.items()}
        whole = {i for i, x in hits.items() if len(x) == len(terms)}
        if mode == "and" or mode == "fallback" and (whole or len(terms) == 1):
            hits = {i: hits[i] for i in whole}
        want = sorted((-round(sum(x), 6), i) for i, x in hits.items() if x)[:k]
        assert sorted((-r["score"], r["id"]) for r in got if r["q"] == q) == want


def test_hybrid_vector_hands_on_best(spark, monkeypatch):
    """in both modes, and names are the same with a pattern that does not go back and with words parted once."""
    import re

    for mode in ("fallback", "or"):
        hands_on_best(monkeypatch, mode, 30)
    for text in ("Ab_c a_b_ x_1 ab_cd_Ef A AB_c a__b Zz9_ a_b9 q_r_s", "x" * 50 + "_" + "y" * 50 + "_Z ab_c-De"):
        assert re.findall(S.IDENTIFIER.replace("+", "++"), text) == re.findall(S.IDENTIFIER, text)
    names = spark.createDataFrame([(1, "b", ["Ab_c d", "", "x", "::é  y"]), (2, "b", None), (3, "b", [])], "id long, buffer string, names array<string>")
    assert [r.phrases for r in S.phrase_lists(names).orderBy("id").collect()] == [["ab c d", "c d", "d", "x", "é y", "y"], None, []]
    splits = S.phrase_lists(names)._jdf.queryExecution().analyzed().toString().count("split(")
    assert splits == 1  # not again for each word


def test_context_render_hands_on_best(monkeypatch):
    """F5"""
    hands_on_best(monkeypatch, "fallback", 10)


def test_bm25_and_hands_on_best(monkeypatch):
    """F12"""
    hands_on_best(monkeypatch, "and", 10)


def test_token_budget_truncate_hands_on_best(monkeypatch):
    """F10"""
    hands_on_best(monkeypatch, "fallback", 30)


def test_decay_rerank_hands_on_best(monkeypatch):
    """F6"""
    hands_on_best(monkeypatch, "fallback", 30)


def test_hybrid_fts_hands_on_best(monkeypatch):
    """F7"""
    hands_on_best(monkeypatch, "fallback", 30)


def test_minmax_normalize_hands_on_best(monkeypatch):
    """F8"""
    hands_on_best(monkeypatch, "fallback", 30)


def test_rrf_two_lists_hands_on_best(monkeypatch):
    """F15"""
    hands_on_best(monkeypatch, "fallback", 30)


def shuffled_columns(df) -> set[str]:
    """The names of the columns that a plan shuffles, before it is adapted."""
    names, nodes = set(), [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        if node.nodeName() == "Exchange":
            names |= {node.output().apply(i).name() for i in range(node.output().size())}
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return names


def test_token_budget_truncate_shuffles_no_texts(spark, small_dir, tmp_path):
    """what fits is decided by sizes; an id with several texts keeps each once."""
    from __spark_entry__ import queries as registered
    from kbspark import queries_search as Q

    q = registered()["token_budget_truncate"]
    columns = shuffled_columns(q(spark, small_dir))
    assert "tokens" in columns and not columns & {"text", "kept"}
    rows = [(50, "a claim", "claim"), (50, "claims of jobs", "claim"), (51, "claim queue", "x"), (52, "no hit", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, subject string").withColumn("source", F.lit("b")).write.parquet(f"{tmp_path}/documents.parquet")
    got = listed(q(spark, str(tmp_path)).collect(), "query_id", "id", "tokens", "was_cut", "kept")
    want = X.budget_with_cut(Q._results(spark, str(tmp_path)), 3000).withColumn("kept", F.sha2("kept", 256))
    assert got == listed(want.collect(), "query_id", "id", "tokens", "was_cut", "kept") and len(got) == 3


def test_hybrid_entity_holds_all_names(spark, tmp_path):
    """names after the tenth of a document are found; the other users of names keep the ten that their SQL states."""
    from __spark_entry__ import oracle_sql
    from __spark_entry__ import queries as registered
    from compare import duck, rows_of_spark, rows_of_sql
    from kbspark import base as D

    many = " ".join(f"{x}a_name" for x in "abcdefghijklmnopqrstuvwxy") + " zebra_stripe"
    rows = [(1, many, "x"), (2, "a zebra_foal", "x"), (3, None, "x"), (4, "", "x"), (5, "zz é", "x"), (50, "none", "zebr/stri"), (100, "none", "zebra/xa name"), (150, None, None), (200, many, "")]
    spark.createDataFrame(rows, "doc_id long, text string, subject string").withColumn("source", F.lit("b")).write.parquet(f"{tmp_path}/documents.parquet")
    q = registered()["hybrid_entity"](spark, str(tmp_path))
    got = rows_of_spark(q)
    assert {(r.query_id, r.id) for r in q.collect()} >= {(50, 1), (50, 2), (50, 200)}  # no word of the texts is asked for here
    assert got == rows_of_sql(duck(str(tmp_path)), oracle_sql()["hybrid_entity"])
    names = {n: {r.id: r.names for r in D.doc_names(spark, str(tmp_path), n).collect()} for n in (10, None)}
    assert len(names[None][1]) == 26 and names[10][1] == sorted(names[None][1])[:10] and names[None][3] == names[None][4] == []
    assert names[10] == {r.id: r.names for r in D.doc_names(spark, str(tmp_path)).collect()}
    assert D.doc_phrases(spark, str(tmp_path)).where("id = 1 and array_contains(phrases, 'zebra stripe')").isEmpty()
