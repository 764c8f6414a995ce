from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kbspark.operators import history as H


def brute_components(links):
    ids = {i for i, _ in links}
    near = defaultdict(set)
    for i, j in links:
        if j in ids:
            near[i].add(j)
            near[j].add(i)
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        out[i] = min(seen)
    return out


def members(spark, links):
    df = spark.createDataFrame(links, "id long, superseded_by long")
    rows = H.chain_members(df).collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id: r.entity_key for r in rows}


def test_chains(spark):
    links = [(1, 2), (2, 3), (3, None), (4, 99), (5, 5), (6, 7), (7, 8), (8, 6), (9, 6), (10, 3), (11, None)]
    assert members(spark, links) == brute_components(links)


def test_long_chain_and_star(spark):
    n = 300
    links = [(i, i + 1) for i in range(n)] + [(n, None)] + [(1000 + i, 2000) for i in range(150)] + [(2000, 2001), (2001, None)] + [(3000 + i, 3000 + (i + 1) % 40) for i in range(40)]
    assert members(spark, links) == brute_components(links)


def test_no_links(spark):
    assert members(spark, []) == {}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 14) | st.none(), max_size=14))
def test_any_links(spark, to):
    links = list(enumerate(to))
    assert members(spark, links) == brute_components(links)


SEEN = "source_table string, entity_key long, version long, epoch long, seen_at long, a string, b string, attrs string"


def history(spark, rows, block):
    return H.store(H.versions(spark.createDataFrame(rows, SEEN), ["a", "b"], ["seen_at"]), block)


def test_validity_and_folding(spark):
    rows = [("s", 1, v, 10 * v + 3, 0, f"a{v // 3}", None if v % 4 == 0 else "b", "x") for v in range(0, 40, 2)]
    rows += [("s", 1, 4, 99, 0, "late", "late", "x"), ("s", 1, 4, 43, 0, "a1", None, "x"), ("s", 2, 7, 5, 0, "z", "z", "x"), ("s", 2, 9, 2, 0, "z", None, "x"), ("s", None, 1, 1, 0, "n", "n", "x"), ("s", 3, None, 1, 0, "n", "n", "x"), ("s", 3, 1, None, 0, "n", "n", "x")]
    for block in (1, 4, 16, 1000):
        stored = history(spark, rows, block)
        got = {(r.entity_key, r.version): (r.valid_from, r.valid_to, r.a, r.b) for r in H.validity(stored, ["a", "b"]).collect()}
        want = {(1, v): (10 * v + 3, 10 * (v + 2) + 3 if v < 38 else -1, f"a{v // 3}", None if v % 4 == 0 else "b") for v in range(0, 40, 2)}
        want |= {(2, 7): (5, 2, "z", "z"), (2, 9): (2, -1, "z", None)}
        assert got == want
        assert stored.where("not is_full").count() == (0 if block == 1 else stored.count() - stored.where("is_full").count())


def test_patches_hold_only_changes(spark):
    stored = history(spark, [("s", 1, v, v, 0, "same", str(v), "x") for v in range(5)], 16)
    assert [sorted(r.attrs) for r in stored.orderBy("version").collect()] == [["a", "b"], ["b"], ["b"], ["b"], ["b"]]


def test_empty(spark):
    assert H.validity(history(spark, [], 16), ["a"]).count() == 0
