"""Very long runs of one kind must cost no more than their length."""

import time

import pytest

from kbspark.llm import credentials as C
from kbspark.llm import encode as E
from kbspark.llm import generated as G
from kbspark.llm import leaks as L
from kbspark.llm import split as S
from kbspark.llm import truncated as T

LONG = {"hex": "a1b2c3d4" * 8000, "words": "password " * 6000, "spaces": "a" + " " * 60_000 + "b", "quotes": '"' * 40_000, "comments": "/* " * 12_000, "names": "key=" * 6000, "ticks": "`" * 40_000, "dots": "a." * 20_000, "tags": "<" * 40_000}


@pytest.mark.parametrize("kind", LONG)
def test_cost(kind):
    t = LONG[kind]
    began = time.time()
    C.mask("x: " + t, C.find("x: " + t, "a.yaml"))
    C.find('# token ' + t + '\npassword = "' + t, "a.py")
    G.content_class("// " + t + "\n" + t, "a.rs", "p")
    T.ending(t, True), T.ending(t, False), T.lengths(t)
    L.Words()([L.plain(t)]), E.leaves(t, 1000), S.spans(t.encode(), S.boundaries(t.encode()), 128, 16)
    assert time.time() - began < 8
