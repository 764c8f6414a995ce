"""Stemming of English words by the algorithm of M. F. Porter (1980), applied to the vocabulary of a corpus."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix tables of steps 2, 3 and 4.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log", "bli": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(w: str) -> str:
    """c and v for consonants and vowels."""
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _replace(w: str, table: dict[str, str]) -> str:
    for n in range(7, 2, -1):
        suffix = w[-n:]
        if len(w) > n - 1 and suffix in table:
            stem = w[: len(w) - len(suffix)]
            return stem + table[suffix] if _measure(stem) > 0 else w
    return w


def stem(w: str) -> str:
    """The stem of a lower-case word; words of fewer than 3 or more than 64 bytes stay, signs that are no vowels count as consonants."""
    if not 3 <= len(w.encode()) <= 64:
        return w
    if w.endswith("sses") and len(w) > 4 or w.endswith("ies") and len(w) > 3:
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, _STEP2), _STEP3)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if _double(w) and w[-1] == "l" and _measure(w) > 1:
        w = w[:-1]
    return w


@functools.lru_cache(1 << 20)
def _known(w: str) -> str:
    return stem(w)


def _stems(words: pa.Array) -> pa.Array:
    """Stems of an array of words; every distinct word is stemmed once."""
    d = words.dictionary_encode()
    return pa.array([None if w is None else _known(w) for w in d.dictionary.to_pylist()], pa.string()).take(d.indices)


def stemmed(words: Column) -> Column:
    """The stems of a list of words, in its order."""

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        lists = lists.cast(pa.list_(pa.string()))
        return pa.ListArray.from_arrays(lists.offsets, _stems(lists.values)) if not lists.null_count else pa.array([None if x is None else [_known(w) for w in x] for x in lists.to_pylist()], pa.list_(pa.string()))

    return run(words)


def stem_counts(words: Column) -> Column:
    """``array<struct<term, tf>>``: the distinct stems of a list of words and how often each occurs."""

    @F.arrow_udf("array<struct<term:string,tf:long>>")
    def run(lists: pa.Array) -> pa.Array:
        lists = lists.cast(pa.list_(pa.string()))
        first, end = lists.offsets[0].as_py(), lists.offsets[-1].as_py()
        d = _stems(lists.values.slice(first, end - first)).dictionary_encode()
        n = np.asarray(lists.value_lengths().fill_null(0))
        rows = np.repeat(np.arange(len(n), dtype=np.int64), n)
        many = max(len(d.dictionary), 1)
        key, tf = np.unique(rows * many + np.asarray(d.indices, np.int64), return_counts=True)
        offsets = np.searchsorted(key, np.arange(len(n) + 1, dtype=np.int64) * many)
        parts = pa.StructArray.from_arrays([d.dictionary.take(pa.array(key % many)), pa.array(tf, pa.int64())], ["term", "tf"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)

    return run(words)


def porter_sql(words: str, name: str = "stems") -> str:
    """The same algorithm as common table expressions: ``name(term, stem)`` of the distinct ``term`` of a table expression.

    A ``y`` that is a consonant is written ``Y`` while suffixes are cut.
    """
    c, v = "[^aeiouy]", "[aeiouy]"

    def m(x: str, least: int) -> str:
        return f"regexp_matches({x}, '^{c}*" + f"{v}+{c}+" * least + "')"

    def one(x: str) -> str:
        return f"regexp_matches({x}, '^{c}*{v}+{c}+{v}*$')"

    def cut(n: int) -> str:
        return f"w[1 : length(w) - {n}]"

    def ends(x: str) -> str:
        return f"ends_with(w, '{x}')"

    def table(t: dict[str, str]) -> str:
        order = sorted(t, key=len, reverse=True)
        return "CASE " + " ".join(f"WHEN {ends(s)} THEN CASE WHEN {m(cut(len(s)), 1)} THEN {cut(len(s))} || '{t[s]}' ELSE w END" for s in order) + " ELSE w END"

    def has(x: str) -> str:
        return f"regexp_matches({x}, '{v}')"

    cvc = f"regexp_matches({{0}}, '{c}{v}[^aeiouywxY]$')"
    double = "(length(w) > 1 AND w[-1] = w[-2] AND regexp_matches(w[-1], '[^aeiouy]'))"
    steps = [
        f"CASE WHEN {ends('sses')} AND length(w) > 4 OR {ends('ies')} AND length(w) > 3 THEN {cut(2)} WHEN {ends('s')} AND NOT {ends('ss')} THEN {cut(1)} ELSE w END AS w, false AS again",
        f"CASE WHEN {ends('eed')} THEN CASE WHEN {m(cut(3), 1)} THEN {cut(1)} ELSE w END WHEN {ends('ed')} AND {has(cut(2))} THEN {cut(2)} WHEN {ends('ing')} AND {has(cut(3))} THEN {cut(3)} ELSE w END AS w, "
        f"NOT {ends('eed')} AND ({ends('ed')} AND {has(cut(2))} OR {ends('ing')} AND {has(cut(3))}) AS again",
        f"CASE WHEN NOT again THEN w WHEN {ends('at')} OR {ends('bl')} OR {ends('iz')} THEN w || 'e' WHEN {double} THEN CASE WHEN w[-1] IN ('l', 's', 'z') THEN w ELSE {cut(1)} END WHEN {one('w')} AND {cvc.format('w')} THEN w || 'e' ELSE w END AS w, again",
        f"CASE WHEN w[-1] IN ('y', 'Y') AND {has(cut(1))} THEN {cut(1)} || 'i' ELSE w END AS w, again",
        f"{table(_STEP2)} AS w, again",
        f"{table(_STEP3)} AS w, again",
        "CASE " + " ".join(f"WHEN {ends(s)} THEN CASE WHEN {m(cut(len(s)), 2)}" + (" AND w[-4] IN ('s', 't')" if s == "ion" else "") + f" THEN {cut(len(s))} ELSE w END" for s in sorted(_STEP4, key=len, reverse=True)) + " ELSE w END AS w, again",
        f"CASE WHEN {ends('e')} AND ({m(cut(1), 2)} OR {m(cut(1), 1)} AND NOT {cvc.format(cut(1))}) THEN {cut(1)} ELSE w END AS w, again",
        f"CASE WHEN {double} AND w[-1] = 'l' AND {m('w', 2)} THEN {cut(1)} ELSE w END AS w, again",
    ]
    out = [f"{name}0 AS (SELECT DISTINCT term, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g') AS w, false AS again, octet_length(encode(term)) BETWEEN 3 AND 64 AS long FROM {words})"]
    out += [f"{name}{i + 1} AS (SELECT term, long, {s} FROM {name}{i})" for i, s in enumerate(steps)]
    return ", ".join(out) + f", {name} AS (SELECT term, CASE WHEN long THEN lower(w) ELSE term END AS stem FROM {name}{len(steps)})"
