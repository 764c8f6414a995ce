from datetime import datetime as D

import pytest

from kbspark.operators import orphans as O
from kbspark.plans import skew

TARGET = "kind string, scope string, key string, start timestamp, end timestamp"
REF = "source_table string, record_id long, ref_field string, ref_value string, scope string, at timestamp, kind string, key string"


def t(day, hour=0):
    return D(2024, 3, day, hour)


def ref(i, key, at, scope="p"):
    return ("r", i, "files", key, scope, at, "file", key)


def brute(refs, targets):
    out = set()
    for s, i, f, v, scope, at, kind, key in refs:
        ok = scope is not None and key is not None and at is not None and any(
            k == kind and sc == scope and ky == key and a is not None and a <= at and (e is None or e > at) for k, sc, ky, a, e in targets
        )
        if not ok:
            out.add((s, i, f, v))
    return out


def found(spark, refs, targets, **how):
    r = O.find_orphans(spark.createDataFrame(refs, REF), spark.createDataFrame(targets, TARGET), **how)
    return {tuple(x)[:4] for x in r.collect()}


TARGETS = [("file", "p", "a", t(2), None), ("file", "p", "b", t(2), t(5)), ("file", "p", "b", t(4), t(7)), ("file", "p", "b", t(9), t(10)), ("file", "p", "c", None, None), ("file", None, "a", t(1), None), ("file", "p", None, t(1), None), ("file", "q", "d", t(3), t(3))]
REFS = [ref(1, "a", t(1)), ref(2, "a", t(2)), ref(3, "b", t(4)), ref(4, "b", t(5)), ref(5, "b", t(7)), ref(6, "b", t(9, 5)), ref(7, "c", t(9)), ref(8, "none", t(9)), ref(9, "a", None), ref(10, "a", t(9), None), ref(11, None, t(9)), ref(12, "d", t(3), "q"), ref(2, "a", t(2))]


def test_times_of_targets(spark):
    assert found(spark, REFS, TARGETS) == brute(REFS, TARGETS)


@pytest.mark.parametrize("rows", [100_000, 0])
def test_hot_key(spark, rows, monkeypatch):
    """A third of the references and many targets share one key; with and without room to broadcast."""
    monkeypatch.setattr(skew, "BROADCAST_ROWS", rows)
    refs = [ref(i, "hot" if i % 3 == 0 else f"k{i % 97}", t(1 + i % 20, i % 24)) for i in range(900)]
    targets = [("file", "p", "hot", t(d), t(d, 12)) for d in range(1, 20)] + [("file", "p", f"k{i}", t(5), None) for i in range(60)]
    assert found(spark, refs, targets, heavy_parts=8) == brute(refs, targets)


def test_empty(spark):
    assert found(spark, [], TARGETS) == set()
    assert found(spark, REFS[:3], []) == {x[:4] for x in REFS[:3]}


def test_references(spark):
    requests = spark.createDataFrame(
        [(1, "p", ["./src//a.rs", " src\\a.rs ", None, "", "  ", "src/a.rs", "src/a.rs"], t(1), "x"), (2, "p", None, t(1), "x"), (3, None, [], None, "x")],
        "request_id long, project string, files array<string>, received_at timestamp, ref_value string",
    )
    rows = O.request_references(requests).collect()
    assert sorted(r.ref_value for r in rows) == [" src\\a.rs ", "./src//a.rs", "src/a.rs"] and {r.key for r in rows} == {"src/a.rs"}
    claims = spark.createDataFrame(
        [(1, '{"chunk_ids": [5, "6", null, 5], "node_ids": ["7"]}', t(1)), (2, '{"chunk_ids": [5', t(1)), (3, None, t(1)), (4, "", t(1)), (5, '{"chunk_ids": 5}', t(1)), (6, "[1]", t(1))],
        "claim_id long, payload string, claimed_at timestamp",
    )
    assert sorted((r.record_id, r.ref_field, r.ref_value) for r in O.claim_references(claims).collect()) == [(1, "chunk_ids", "5"), (1, "chunk_ids", "6"), (1, "node_ids", "7")]


def test_report(spark):
    refs, targets = spark.createDataFrame(REFS, REF).distinct(), spark.createDataFrame(TARGETS, TARGET)
    rep = O.orphan_report(refs, targets).collect()
    assert sum(r.refs for r in rep) == 12 and sum(r.orphans for r in rep) == len(brute(REFS, TARGETS))
    assert {r.month for r in rep} == {"2024-03", None}
