import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kbspark.llm import split as S

TEXT = st.text(st.sampled_from("ab .\n\r\té日😀;}"), max_size=400)


def tokens(data):
    return -(-len(data) // 4)


@settings(max_examples=250, deadline=None)
@given(TEXT, st.integers(1, 30), st.integers(0, 40))
def test_pieces(text, limit, overlap):
    data = text.encode()
    strength = S.boundaries(data)
    out = S.spans(data, strength, limit, overlap)
    assert out[0][0] == out[0][1] == 0 and out[-1][2] == len(data)
    over = min(overlap, limit - 1)
    for i, (a, m, b) in enumerate(out):
        assert tokens(data[a:b]) <= limit
        data[a:b].decode()
        if i:
            assert m == out[i - 1][2] and out[i - 1][0] <= a <= m
            assert tokens(data[a:m]) <= over
            if m - out[i - 1][0] >= over * 4:
                assert tokens(data[a:m]) == over or data[a - 1 : a + 1] == b"\r\n"
    assert len(out) == 1 or len(data) > limit * 4


def test_natural_boundaries():
    text = "def a():\n    x = 1\n    y = 2\n\n\ndef b():\n    z = 3\n    return z\n"
    data = text.encode()
    cut = [data[m:b].decode() for _, m, b in S.spans(data, S.boundaries(data), 9, 0)]
    assert cut[0] == "def a():\n    x = 1\n    y = 2\n\n\n" and "".join(cut) == text
    crlf = b"one two\r\nthree four\r\nfive six\r\n"
    assert all(not crlf[:b].endswith(b"\r") for _, _, b in S.spans(crlf, S.boundaries(crlf), 3, 0))


def test_hardest_text_is_still_cut():
    data = b"x" * 100_000
    out = S.spans(data, S.boundaries(data), 128, 16)
    assert max(b - a for a, _, b in out) <= 512 and out[-1][2] == len(data)


def test_table(spark):
    files = spark.createDataFrame([(1, "word " * 500, "q"), (2, "short", "q"), (3, "", "q"), (4, None, "q"), (1, "word " * 500, "q"), (None, "word " * 500, "q")], "file_id long, content string, piece string")
    configs = spark.createDataFrame([(1, 128, 16), (2, 900, None), (3, None, 1), (4, 0, 0)], "config_id long, max_tokens int, overlap_tokens int")
    rows = S.split(files, configs).collect()
    assert {r.config_id for r in rows} == {1, 2} and {r.file_id for r in rows} == {1, 2, 3, None}
    one = sorted((r for r in rows if r.file_id is None and r.config_id == 1), key=lambda r: r.piece)
    assert "".join(r.piece_text[r.body_char - r.start_char :] for r in one) == "word " * 500
    assert all(r.tokens <= 128 for r in one)
    assert S.split(files.limit(0), configs).count() == 0 and S.split(files, configs.limit(0)).count() == 0
    assert np.unique([r.piece for r in rows if r.file_id == 2]).tolist() == [0]
