import random

import numpy as np
import pytest

from kbspark.llm import leaks as L

VOCAB = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "su", "vo", "ne") for b in ("ka", "den", "fir", "gol", "pas", "rix", "tum", "wem")]


def passage(seed, n=90):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


INSTRUCTION = "Read the passage and answer the question that follows."
ITEMS = [(1, f"{INSTRUCTION}\n\n{passage(1)}"), (2, f"{INSTRUCTION}\n\n{passage(2)}"), (3, passage(3, 24)), (4, f"{INSTRUCTION}\n{passage(1)}"), (5, None), (6, ""), (7, passage(7))]


def noisy(text):
    w = text.split()
    for i in range(5, len(w), 9):
        w[i] = "other"
    w = [x.upper() if i % 4 else f"<b>{x}</b>," for i, x in enumerate(w)]
    return "\n".join(" ".join(w[i : i + 6]) for i in range(0, len(w), 6))


def first(text, n):
    return " ".join(text.split()[:n])


DOCS = [
    (1, "intro words here. " + passage(1) + " and more"), (2, noisy(passage(2))), (3, "x " + first(passage(1), 50) + " y"), (4, "x " + first(passage(1), 30) + " y"), (5, INSTRUCTION + " nothing else"),
    (6, passage(99, 400)), (7, passage(3, 24)), (8, first(passage(3, 24), 8)), (9, None), (10, ""), (11, passage(1)), (12, passage(50, 3000) + " " + passage(7) + " " + passage(51, 3000)), (12, passage(7)),
]
WANT = {(1, 1), (1, 4), (2, 2), (3, 1), (3, 4), (7, 3), (11, 1), (11, 4), (12, 7)}


@pytest.mark.parametrize("block", [400_000, 50])
def test_found(spark, block):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in DOCS], "doc_id long, text string, item_id string, stretch int")
    items = spark.createDataFrame([(i, "s", t) for i, t in ITEMS], "item_id long, suite string, text string")
    assert {(r.doc_id, r.item_id) for r in L.find_leaks(docs, items, block_words=block).collect()} == WANT
    assert L.find_leaks(docs.limit(0), items).count() == 0 and L.find_leaks(docs, items.limit(0)).count() == 0


def test_winnowing_keeps_a_fingerprint_of_every_long_run():
    r = np.random.default_rng(0)
    for _ in range(200):
        g = r.integers(0, 50, r.integers(1, 60)).astype(np.uint64)
        at = set(np.flatnonzero(L.winnow(g)).tolist())
        assert all(at & set(range(i, i + L.WINDOW)) for i in range(len(g) - L.WINDOW + 1)) and at


def test_fingerprints_do_not_depend_on_the_texts_around():
    words, texts = L.Words(), [passage(i, 3 + i * 7) for i in range(8)]
    h, begin = words(texts)
    g, ok = L.text_grams(h, begin)
    for i, t in enumerate(texts):
        h1, b1 = words([t])
        g1, ok1 = L.text_grams(h1, b1)
        mine = set(g1[ok1].tolist())
        assert mine <= set(g[begin[i] : begin[i + 1] - L.K + 1][ok[begin[i] : begin[i + 1] - L.K + 1]].tolist()) or len(g1) < L.WINDOW


def test_alignment_is_the_best_local_one():
    r = random.Random(1)
    for _ in range(60):
        a, b = ([r.randrange(6) for _ in range(r.randrange(1, 14))] for _ in range(2))
        best, v = 0, np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                v[i, j] = max(0, v[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), v[i - 1, j] - 1, v[i, j - 1] - 1)
                best = max(best, v[i, j])
        text = np.array([9, 9, *b, 9], np.uint64)
        long, matched = (int(x[0]) for x in L.align([np.array(a, np.uint64)], [np.arange(len(a)) + 2], 20, text, np.array([2]), np.array([2 + len(b)])))
        assert 2 * matched - best <= max(0, 2 * matched) and matched <= long <= len(a) and (best == 0) == (matched == 0)


@pytest.mark.parametrize("block", [400_000, 2])
def test_items_of_any_length_are_found(spark, block):
    sizes = [1, 2, 3, 4, 5, 6, 8, 11, 12, 17, 60, 4096, 5000, 20000]
    own = {n: " ".join(f"w{n}x{i * i % 7919}y{i}" for i in range(n)) for n in sizes}
    items = spark.createDataFrame([(n, t) for n, t in own.items()], "item_id long, text string")
    docs = [(n, passage(n, 50) + " " + t + " " + passage(n + 1, 40)) for n, t in own.items()]
    docs += [(100_000 + n, " ".join(own[n].split()[n // 4 : n // 4 + n // 2 + 4])) for n in sizes if n >= 12]
    docs += [(200_000 + n, " ".join(own[n].split()[: n // 3])) for n in sizes if n >= 12]
    docs += [(300_000 + n, " ".join("new" if i % 9 == 4 else w for i, w in enumerate(own[n].split()))) for n in sizes if n >= 60]
    got = {(r.doc_id, r.item_id) for r in L.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items, block_words=block).collect()}
    assert got == {(n, n) for n in sizes} | {(100_000 + n, n) for n in sizes if n >= 12} | {(300_000 + n, n) for n in sizes if n >= 60}


def test_shorter_spans_are_reported_on_request(spark):
    item = passage(1, 400)
    docs = spark.createDataFrame([(1, passage(2, 60) + " " + " ".join(item.split()[100:280]) + " " + passage(3, 60)), (2, " ".join(item.split()[30:40])), (3, passage(4, 90))], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert L.find_leaks(docs, items).count() == 0
    got = {(r.doc_id, r.matched) for r in L.find_leaks(docs, items, span=100).collect()}
    assert {d for d, _ in got} == {1} and all(m >= 180 for _, m in got)
    assert {r.doc_id for r in L.find_leaks(docs, items, span=10).collect()} == {1, 2}


def test_every_band_is_tried():
    item = passage(5, 30)
    head = " ".join(item.split()[:9])
    text = " and ".join([head] * 6) + " " + passage(6, 200) + " " + " ".join(item.split()[8:28]) + " " + passage(7, 50)
    index, words = L.ItemIndex([1], [item], set()), L.Words()
    assert [x[:2] for x in index.search(*words([L.plain(text)]))] == [(0, 0)]


def test_words():
    text = "Re-\nturn <i>The</i> “VALUE”&nbsp;of\\n x_y\u00ad! Straße42"
    h, begin = L.Words()([L.plain(text), "", "x"])
    want, _ = L.Words()(["return the value of x y straße42"])
    assert h[:7].tolist() == want.tolist() and begin.tolist() == [0, 7, 7, 8] and h[7] == h[4]


def test_long_texts_are_read_in_parts(monkeypatch):
    text = " ".join(passage(i, 50) + " " + "z" * 40 for i in range(20))
    whole, _ = L.Words()([text])
    monkeypatch.setattr(L, "SLICE_CHARS", 30)
    parts, _ = L.Words()([text])
    assert parts.tolist() == whole.tolist()
