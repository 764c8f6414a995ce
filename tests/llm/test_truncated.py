import html
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kbspark.llm import truncated as T


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab\"'\\<>&\n\r\té😀\x01"), max_size=60))
def test_lengths(t):
    crlf = len(t.replace("\r\n", "\n").replace("\n", "\r\n"))
    assert T.lengths(t) == [len(t), len(t.encode()), len(t.encode("utf-16-le")) // 2, len(html.escape(t).replace("&quot;", "&#034;").replace("&#x27;", "&#x27;")), len(json.dumps(t, ensure_ascii=False)) - 2, len(json.dumps(t)) - 2, crlf]


@pytest.mark.parametrize(
    "text,code,state",
    [
        ("All is well.", False, "closed"), ("All is we", False, "open"), ("Is it?\n", False, "closed"), ("It was cut…", False, "open"), ("It was cut [truncated]", False, "open"), ("a\n```\ncode\n```", False, "closed"), ("a\n```\ncode.", False, "cut"),
        ("| a | b |\n| c | d |", False, "closed"), ("| a | b |\n| c |", False, "cut"), ("| a | b |\n| c", False, "cut"), ("- one\n- two", False, "ask"), ("2024-01-01T00:00:00Z INFO x done", False, "ask"), ("# Title\n\n## Next", False, "cut"),
        ("fn a() {\n}\n", True, "closed"), ("fn a() {\n  b(", True, "cut"), ("def f():\n    return x", True, "word"), ("Status: open", False, "word"), ("it took 7.", False, "ask"), ("see (note", False, "cut"), ("", False, "closed"), ("…", False, "closed"),
    ],
)
def test_endings(text, code, state):
    assert T.ending(text, code)[0] == state


WORDS = "the sweeper renews every lease while a worker holds its job and the queue drains slowly before the review".split()


def sentence(r, n=9):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def corpus():
    r, rows, cut = random.Random(5), [], set()
    for i in range(300):
        text = " ".join(sentence(r) for _ in range(r.randrange(4, 14)))
        text += " It ends." * (len(text) == 200)
        if i % 6 == 0:
            text = " ".join(sentence(r) for _ in range(12))[:200]
            cut.add(i)
        rows.append((i, text, "limited", "answer"))
    for i in range(300, 500):
        text = "\n".join(f"- drain the {r.choice(['lease', 'queue', 'job'])}" for _ in range(6))
        if i % 10 == 0:
            text = text[:-3]
            cut.add(i)
        elif i % 7 == 0:
            text += "\nSee also the handbook"
        rows.append((i, text, None, "list"))
    rows += [(600, None, "limited", "x"), (601, "", "limited", "x"), (602, "  \n", None, None), (603, "Ends whole.", "other", None), (603, "Ends whole.", "other", None), (604, "It is " * 20000 + "cut he", "other", None), (605, "It is " * 20000 + "cut he", "other", None)]
    return rows, cut | {604, 605}


def test_corpus(spark):
    rows, cut = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, doc_kind string, state string, n int")
    got = T.find_truncated(df)
    assert {r.doc_id for r in got.collect()} == cut
    limits = {r.doc_id for r in got.where("reason = 'limit'").collect()}
    assert limits == {i for i in cut if i < 300}
    rates = {r.source: (r.texts, r.truncated) for r in T.truncation_rates(df, got).collect()}
    assert rates == {"limited": (302, 50), None: (201, 20), "other": (4, 2)}
    assert T.find_truncated(df.limit(0)).count() == 0


def test_every_limit_of_a_source_counts(spark):
    import random

    r = random.Random(4)
    rows = []
    for i in range(400):
        text = " ".join(r.choice(["alpha", "bravo", "charlie", "delta", "to", "it", "queue", "of", "then. The"]) for _ in range(r.randrange(60, 500))) + " ends."
        if i < 40:
            text = (text * 9)[:900]
        elif i < 60:
            text = (text * 9)[:1500]
        if i in (0, 40):
            text = text[:-1] + "."
        rows.append((i, text, "s", "answer"))
    got = T.find_truncated(spark.createDataFrame(rows, "doc_id long, text string, source string, doc_kind string"))
    out = [(x.doc_id, x.reason) for x in got.collect()]
    assert len(out) == len({i for i, _ in out})
    assert {i for i, reason in out if reason == "limit"} >= set(range(60))
