import numpy as np

from kbspark.llm import graph_search as G
from kbspark.llm import neighbours as N

DIM = 16


def test_recall_of_greedy_search(spark):
    rng = np.random.default_rng(4)
    c = rng.normal(size=(15, DIM))
    x = np.float32([c[i % 15] + 0.5 * rng.normal(size=DIM) for i in range(1500)])
    v = spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in enumerate(x)], "id long, vec binary")
    graph, placed, trees = N.neighbour_graph(v, DIM, leaf=80, sample=500)
    asked = np.float32([c[i % 15] + 0.5 * rng.normal(size=DIM) for i in range(40)])
    q = [(i, bytearray(x[i].tobytes())) for i in range(0, 1500, 50)] + [(10_000 + i, bytearray(r.tobytes())) for i, r in enumerate(asked)]
    got = {}
    for r in G.graph_search(spark.createDataFrame(q, "query_id long, vec binary"), graph, placed, trees, dim=DIM).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for i, b in q:
        s = u @ np.frombuffer(bytes(b), np.float32)
        if i < 1500:
            s[i] = -9e9
        hits += len(got[i] & set(np.argsort(-s)[:10].tolist()))
        assert i not in got[i] and len(got[i]) == 10
    assert hits / (10 * len(q)) > 0.93


def test_nothing_asked(spark):
    v = spark.createDataFrame([(i, bytearray(np.float32([i + 1] + [1] * (DIM - 1)).tobytes())) for i in range(5)], "id long, vec binary")
    graph, placed, trees = N.neighbour_graph(v, DIM)
    assert G.graph_search(v.limit(0).withColumnRenamed("id", "query_id"), graph, placed, trees, dim=DIM).count() == 0
    one = v.where("id = 0").withColumnRenamed("id", "query_id")
    assert sorted(r.id for r in G.graph_search(one, graph, placed, trees, dim=DIM).collect()) == [1, 2, 3, 4]


def test_every_row_of_a_direction_asks_and_answers(spark):
    dim, rng = 16, np.random.default_rng(9)
    vec = {i: rng.normal(size=dim).astype(np.float32) for i in range(1, 61)}
    vec |= {100 + i: vec[7] * (1 + i % 2) for i in range(30)} | {150: vec[9]}
    cache = spark.createDataFrame([(i, f"h{i}", v.tolist(), None) for i, v in vec.items()], "cache_id long, hash string, embedding array<float>, cached_at timestamp")
    got = G.search_rows(cache, "id % 50 = 0", dim=dim).collect()
    ids = sorted(vec)
    u = np.array([vec[i] / np.linalg.norm(vec[i].astype(float)) for i in ids])
    for q in (50, 100, 150):
        s = np.round(u @ u[ids.index(q)], 6)
        want = sorted((-s[n], i) for n, i in enumerate(ids) if i != q)[:10]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [i for _, i in want]
    assert {r.query_id for r in got} == {50, 100, 150}


def test_recall_where_neighbourhoods_are_not_linked(spark):
    rng = np.random.default_rng(21)
    dim, n = 32, 3000
    c = rng.normal(size=(200, dim))
    x = np.float32(c[np.arange(n) % 200] + 0.15 * rng.normal(size=(n, dim)))
    v = spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in enumerate(x)], "id long, vec binary")
    graph, placed, trees = N.neighbour_graph(v, dim)
    q = v.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    got = {}
    for r in G.graph_search(q, graph, placed, trees, dim=dim).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for i in range(0, n, 50):
        s = u @ u[i]
        s[i] = -9
        hits += len(got[i] & set(np.argsort(-s)[:10].tolist()))
    assert hits / (10 * n / 50) > 0.9
