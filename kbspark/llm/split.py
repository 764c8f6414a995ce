"""Problem 2: cutting oversized items at natural boundaries, with overlap.

Tokens are counted as UTF-8 bytes divided by four, rounded up. An item over the limit is bisected: the cut goes to the
strongest boundary in the middle half (blank line, line before an unindented one, line, sentence or statement, white
space, any character; among equals the one nearest the midpoint), and halves over the limit less the overlap are
bisected again. Each piece but the first then begins with the last ``overlap`` tokens of the text before it. Cuts never
fall inside a character or between CR and LF.

The overlap is at most the limit less one. Defined results: a null overlap means none; configurations with a null or
non-positive limit are ignored; null contents give no pieces, contents within the limit one piece (an empty content one
empty piece); repeated rows come out as often as they go in; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.plans.spread import spread

BYTES_PER_TOKEN = 4
#: Configurations are read to the driver; more than so many are an error.
MOST_CONFIGS = 1000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?;}"]] = True
BLANK_LINE, UNINDENTED, LINE, SENTENCE, SPACE, CHARACTER = 6, 5, 4, 3, 2, 1


def boundaries(data: bytes) -> np.ndarray:
    """Strength of a cut before each byte; 0 where a cut is not allowed."""
    b = np.frombuffer(data, np.uint8)
    s = np.where((b & 0xC0) == 0x80, 0, CHARACTER).astype(np.uint8)
    if len(b) < 2:
        return s
    space, before = _SPACE[b], np.empty_like(b)
    before[0], before[1:] = 0, b[:-1]
    after_space = _SPACE[before] & (before != 0)
    word = after_space & ~space
    s[word] = SPACE
    stop2 = np.zeros(len(b), bool)
    stop2[2:] = _STOP[b[:-2]]
    s[word & stop2] = SENTENCE
    line = before == 10
    s[line] = LINE
    s[line & ~space] = UNINDENTED
    starts = np.flatnonzero(line)
    if len(starts):
        # a line start is a blank-line boundary if the line before it holds white space only
        last_ink = np.maximum.accumulate(np.where(space, -1, np.arange(len(b))))
        prev = np.concatenate(([0], starts[:-1]))
        ink = last_ink[starts - 1]
        blank = (ink < prev) & ~space[starts]
        s[starts[blank]] = BLANK_LINE
    s[(before == 13) & (b == 10)] = 0
    s[0] = 0
    return s


def bisect(strength: np.ndarray, size: int, body: int) -> list[int]:
    """Offsets at which an item of ``size`` bytes is cut so that no part is longer than ``body``."""
    cuts, todo = [], [(0, size)]
    while todo:
        a, b = todo.pop()
        n = b - a
        if n <= body:
            continue
        mid, reach = a + n // 2, max(n // 4, 1)
        lo, hi = max(a + 1, mid - reach), min(b, mid + reach + 1)
        w = strength[lo:hi]
        best = w.max()
        if best == 0:  # only inside one character or CR LF
            lo, hi = a + 1, b
            w = strength[lo:hi]
            best = w.max()
            if best == 0:
                continue
        if best == CHARACTER:
            at = w[mid - lo :].argmax() + mid if mid - lo < len(w) and w[mid - lo :].any() else lo + int(np.flatnonzero(w)[-1])
        else:
            p = np.flatnonzero(w == best)
            i = p.searchsorted(mid - lo)
            at = lo + int(p[i] if i < len(p) and (i == 0 or p[i] - (mid - lo) < (mid - lo) - p[i - 1]) else p[i - 1])
        at = int(at)
        cuts.append(at)
        todo += ((a, at), (at, b))
    cuts.sort()
    return cuts


def spans(data: bytes, strength: np.ndarray, max_tokens: int, overlap: int) -> list[tuple[int, int, int]]:
    """``(start, body_start, end)`` byte offsets of the pieces; the text from start to body_start is the overlap."""
    overlap = min(overlap, max_tokens - 1)
    size = len(data)
    if size <= max_tokens * BYTES_PER_TOKEN:
        return [(0, 0, size)]
    at = [0, *bisect(strength, size, (max_tokens - overlap) * BYTES_PER_TOKEN), size]
    out = [(0, 0, at[1])]
    for body, end in zip(at[1:], at[2:], strict=False):
        start = max(body - overlap * BYTES_PER_TOKEN, out[-1][0])
        while start < body and strength[start] == 0 and start:
            start += 1
        out.append((start, body, end))
    return out


def _pieces(configs: list[tuple[int, int, int]], with_text: bool, oversized: bool):
    def run(batches):
        for pdf in batches:
            rows = []
            for key, text in zip(pdf._id, pdf._text, strict=True):
                data = text.encode()
                strength = boundaries(data)
                ascii_ = len(data) == len(text)
                chars = None if ascii_ else np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
                for config, limit, overlap in configs:
                    if oversized and len(data) <= limit * BYTES_PER_TOKEN:
                        continue
                    for i, (a, m, b) in enumerate(spans(data, strength, limit, overlap)):
                        c = (a, m, b) if ascii_ else (int(chars[a]), int(chars[m]), int(chars[b]))
                        rows.append((key, config, i, *c, -(-(b - a) // BYTES_PER_TOKEN), *([text[c[0] : c[2]]] if with_text else [])))
            yield pd.DataFrame(rows, columns=["_id", "_config", "piece", "start_char", "body_char", "end_char", "tokens", *(["piece_text"] if with_text else [])]).astype({"_id": "Int64", "_config": "Int64"})

    return run


def read_configs(configs: DataFrame) -> list[tuple[int, int, int]]:
    """Usable ``(config_id, max_tokens, overlap_tokens)``, smallest id first."""
    rows = configs.select("config_id", "max_tokens", "overlap_tokens").where("max_tokens > 0").distinct().orderBy("config_id", "max_tokens").limit(MOST_CONFIGS + 1).collect()
    if len(rows) > MOST_CONFIGS:
        raise ValueError(f"more than {MOST_CONFIGS} chunker configurations")
    return [(r[0], r[1], max(r[2] or 0, 0)) for r in rows]


def split(items: DataFrame, configs: DataFrame, id_col: str = "file_id", text_col: str = "content", with_text: bool = True, oversized: bool = False) -> DataFrame:
    """``(file_id, config_id, piece, start_char, body_char, end_char, tokens[, piece_text])`` of every item and configuration.

    Offsets count characters; from ``start_char`` to ``body_char`` a piece repeats the one before. ``oversized`` leaves
    out items within the limit of a configuration.
    """
    known = read_configs(configs)
    least = min((limit for _, limit, _ in known), default=0) * BYTES_PER_TOKEN
    rows = spread(items.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where("_text is not null"))
    if not known:
        rows = rows.limit(0)
    if oversized:
        rows = rows.where(F.octet_length("_text") > least)
    schema = "_id long, _config long, piece int, start_char long, body_char long, end_char long, tokens long" + ", piece_text string" * with_text
    out = rows.mapInPandas(_pieces(known, with_text, oversized), schema)
    return out.withColumnsRenamed({"_id": id_col, "_config": "config_id"})
