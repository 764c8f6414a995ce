import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kbspark.llm import encode as E

pytestmark = pytest.mark.skipif(not os.path.exists(E.VOCABULARY), reason="no vocabulary")

PIECES = st.lists(st.sampled_from(["a", "ab", "the", "'s", "'", "l", " ", "  ", "\n", "\t", "12", "-", "=", "é", "日本", "😀", "<|endoftext|>", "\x1c", "　"]), max_size=120).map("".join)


def whole(parts, enc):
    out, held = [], []
    for text, raw, glued in parts:
        ids = enc._encode_single_piece(text.encode()) if raw else enc.encode_ordinary(text)
        if not glued and held:
            out.append(E.join_tree(enc, held))
            held = []
        (held if raw else out).append(ids)
    if held:
        out.append(E.join_tree(enc, held))
    return [i for x in out for i in x]


@settings(max_examples=300, deadline=None)
@given(PIECES, st.sampled_from([3, 8, 40]))
def test_leaves_give_the_same_ids(text, leaf):
    enc = E.encoder()
    parts = E.leaves(text, leaf)
    assert "".join(p[0] for p in parts) == text and all(len(p[0]) <= leaf for p in parts)
    assert whole(parts, enc) == enc.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text("abcdeht", min_size=2, max_size=200), st.data())
def test_joins_are_exact(text, data):
    enc, k = E.encoder(), data.draw(st.integers(1, len(text) - 1))
    left, right = (enc._encode_single_piece(x.encode()) for x in (text[:k], text[k:]))
    assert E.join_ids(enc, left, right, 1) == enc._encode_single_piece(text.encode())


def test_table(spark):
    texts = ["", None, "<|endoftext|> plain", "x" * 50_000 + "ab" * 30_000, "word " * 30_000, "日本語 " * 9000, "\n" * 70_000, "same", "same"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "no id"), (4, "another text under id 4")]
    df = spark.createDataFrame([(i, t, [9]) for i, t in rows], "doc_id long, text string, ids array<int>")
    enc = E.encoder()
    got = sorted(((r.doc_id, r.ids) for r in E.encode(df, long=20_000, leaf=1000).collect()), key=repr)
    assert got == sorted(((i, enc.encode_ordinary(t) if t else []) for i, t in rows), key=repr)
    assert E.encode(df.limit(0)).count() == 0 and E.encode(df.limit(0)).columns == ["doc_id", "ids"]
