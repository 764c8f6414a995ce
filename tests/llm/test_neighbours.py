import hashlib

import numpy as np
import pytest

from kbspark.llm import neighbours as N

DIM = 16
SCHEMA = "cache_id long, hash string, embedding array<float>, model string, cached_at timestamp, vec string, sig string, blk string"


def table(spark, rows):
    return spark.createDataFrame([(i, h, None if v is None else [None if x is None else float(x) for x in v], "m", t, "x", "x", "x") for i, h, v, t in rows], SCHEMA)


def brute(rows, k=10, dim=DIM):
    import datetime

    live = {}
    alone = {}
    for i, h, v, t in rows:
        if i is None or v is None or len(v) != dim or any(x is None for x in v):
            continue
        a = np.array(v, np.float32).astype(float)
        if not np.isfinite(a).all() or not a.any():
            continue
        key = (t or datetime.datetime.min, i)
        if h is None:
            alone[i] = a
        elif h not in live or key > live[h][0]:
            live[h] = (key, a)
    vec = alone | {key[1]: a for key, a in live.values()}
    ids = sorted(vec)
    u = np.array([vec[i] / np.linalg.norm(vec[i]) for i in ids])
    pairs = set()
    if len(ids) > 1:
        s = np.round(u @ u.T, 6)
        for n, i in enumerate(ids):
            order = sorted((m for m in range(len(ids)) if m != n), key=lambda m: (-s[n, m], ids[m]))[:k]
            pairs |= {(min(i, ids[m]), max(i, ids[m])) for m in order}
    return pairs


def found(spark, rows, **how):
    out = [(r.cache_id_a, r.cache_id_b) for r in N.similar_pairs(table(spark, rows), dim=DIM, **how).collect()]
    assert len(out) == len(set(out)) and all(a < b for a, b in out)
    return set(out)


def clustered(n, seed=0, centres=12):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, DIM))
    return [c[i % centres] + 0.4 * rng.normal(size=DIM) for i in range(n)]


def test_recall_with_small_leaves_and_chunks(spark):
    rows = [(i * 3 + 1, hashlib.md5(str(i).encode()).hexdigest(), v, None) for i, v in enumerate(clustered(900))]
    got, want = found(spark, rows, leaf=60, block=20, chunk=40, sample=300), brute(rows)
    assert len(got & want) / len(want) > 0.97


def test_oversized_leaves_are_cut(spark):
    rows = [(i, str(i), v, None) for i, v in enumerate(clustered(700, 1))]
    got, want = found(spark, rows, leaf=50, block=15, leaf_most=1.5, sample=40), brute(rows)
    assert len(got & want) / len(want) > 0.95


def test_dirty_rows_ties_and_a_third_of_copies(spark):
    import datetime

    t = lambda d: datetime.datetime(2024, 1, d)
    vs = clustered(120, 2)
    rows = [(i, f"h{i}", v, t(1)) for i, v in enumerate(vs)]
    rows += [(200 + i, f"c{i}", vs[5], t(1)) for i in range(60)]  # one direction holds a third
    rows += [(300 + i, f"d{i}", np.float32(vs[7]) * 4, t(1)) for i in range(4)]
    rows += [(400, "h3", vs[4], t(2)), (401, "h4", vs[9], None), (402, None, vs[8], t(1)), (403, None, vs[8], t(1))]
    rows += [(500, "z", [0] * DIM, t(1)), (501, "n", None, t(1)), (502, "s", [1.0], t(1)), (503, "f", [float("nan")] * DIM, t(1)), (504, "i", [float("inf")] + [1.0] * (DIM - 1), t(1)), (505, "p", [None] + [1.0] * (DIM - 1), t(1)), (None, "q", vs[1], t(1))]
    rows.append(rows[0])
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 7])
def test_few_rows(spark, n):
    rows = [(i, str(i), v, None) for i, v in enumerate(clustered(n, 3))]
    assert found(spark, rows) == brute(rows)


def near_copies(n, seed=5):
    """Copies of one direction with different factors; their cosines round to one value, their float32 directions differ."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=DIM)
    return [np.float32(base * rng.uniform(0.5, 2) + 1e-6 * rng.normal(size=DIM)) for _ in range(n)]


@pytest.mark.parametrize("how", [{}, {"leaf": 60, "block": 30, "leaf_most": 1.5, "chunk": 80, "sample": 200}])
def test_a_large_group_of_near_copies(spark, how):
    vs = near_copies(400) + clustered(300, 6)
    order = np.random.default_rng(8).permutation(len(vs))
    rows = [(int(i) * 2 + 1, f"h{i}", v, None) for i, v in zip(order, vs, strict=True)]
    got, want = found(spark, rows, **how), brute(rows)
    tied = {r[0] for r in rows[:400]}
    mine = lambda pairs: {p for p in pairs if p[0] in tied and p[1] in tied}
    assert mine(got) == mine(want)
    assert len(got & want) / len(want) > 0.95


def test_leaves_are_bounded(spark):
    rng = np.random.default_rng(3)
    x = np.float32(np.concatenate([rng.normal(size=(3000, DIM)), np.tile(rng.normal(size=DIM), (500, 1))]))  # some cannot be parted
    v = spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in enumerate(x)], "id long, vec binary")
    at = N.leaves(v, N.Trees(N._unit(x[:60]), len(x), 2, 30), DIM, 30, 2)
    sizes = {r["count"] for r in at.groupBy("tree", "leaf").count().collect()}
    assert max(sizes) <= 60 * 1.5 and at.count() == 2 * len(x) and at.select("id", "tree").distinct().count() == 2 * len(x)
    assert at.groupBy("leaf").agg({"tree": "max", "*": "count"}).count() == at.select("tree", "leaf").distinct().count()


def test_recall_where_the_sample_is_small_against_the_rows(spark):
    rng = np.random.default_rng(12)
    dim, n = 32, 6000
    c = rng.normal(size=(60, dim))
    x = np.float32(c[rng.integers(0, 60, n)] + 0.5 * rng.normal(size=(n, dim)))
    v = spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in enumerate(x)], "id long, vec binary")
    graph, _, _ = N.neighbour_graph(v, dim, leaf=100, block=25, sample=100)
    got = {r.id: {y["id"] for y in r.nbr[:10]} for r in graph.where("id % 20 = 0").collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for i, ids in got.items():
        s = u @ u[i]
        s[i] = -9
        hits += len(ids & set(np.argsort(-s)[:10].tolist()))
    assert hits / (10 * len(got)) > 0.95
