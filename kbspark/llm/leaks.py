"""Problem 8: passages of held-out items inside training texts.

Texts and items are read as words, without case, punctuation, markup, entities, escapes and line-break hyphens. A first
line that several items share is their instruction and is left out. Texts are fingerprinted by winnowing: of every
window of ``WINDOW`` word k-grams the one with the smallest hash is kept, so every shared run of WINDOW + K - 1 words
leaves a common fingerprint. The fingerprints of the texts are joined with those of the items, hits are gathered per
item along diagonals, and every band of diagonals with enough hits is extended by a local alignment of the words, which
allows for changed, lost and added single words. The alignment keeps to a band around the chain of hits, so its cost
grows with the length of the item, not with its square.

Half of an item of fewer than ``2 * (WINDOW + K - 1)`` words is shorter than what winnowing guarantees: such items are
looked up by all k-grams of the texts instead of the winnowed ones, and items of fewer than K words, half of which is no
passage, by their whole sequence of words.

The items' words are counted first. Up to ``BLOCK_WORDS`` words they go to the executors as one index and texts are
never shuffled. Above it the fingerprints of both sides are joined by shuffle, hot ones apart, and only the texts and
items of candidate pairs are brought together.

Defined results: null and empty texts and items hold and give nothing; every row counts, repeated texts under a new id
and items with a shared passage too; an item without an instruction is taken whole; empty tables give no rows; further
columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.plans.skew import join_skewed
from kbspark.plans.spread import spread

K, WINDOW = 4, 3
#: Items below this many words have halves without a guaranteed fingerprint.
SHORT = 2 * (WINDOW + K - 1)
#: Share of an item's own words that must stand in a text as one stretch.
SHARE = 0.5
#: Hits on one band that a pair needs before it is aligned: this share of the item's words, one at least.
SEED_SHARE = 0.06
#: Words from which an item is long enough that changed words within a stretch are counted with it; of a shorter item
#: the words themselves must be found, since a few common phrases would make up half of it.
LONG_ITEM = 60
BLOCK_WORDS = 400_000
#: A shared first line of more words is a passage, not an instruction.
INSTRUCTION_WORDS = 30
#: Columns of the alignment on each side of the chain of hits, beside the greatest jump in it, which counts up to JUMP.
REACH, JUMP = 40, 512
#: Characters of texts worked on at once, hits expanded at once, cells of an alignment row worked on at once.
SLICE_CHARS, SLICE_HITS, SLICE_CELLS = 1_000_000, 4_000_000, 200_000

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,300}>|&(?:[a-z]{2,8}|#\d{1,6}|#x[0-9a-f]{1,5});", re.I)
_ESCAPE = re.compile(r"\\u00[0-9a-fA-F]{2}|\\[nrt\"]")
_HYPHEN = re.compile(r"(?<=[^\W\d_])-\r?\n[ \t>*#|]*(?=[^\W\d_])")
_INVISIBLE = re.compile(r"[\u00ad\u200b\u200c\u200d\u2060\ufeff]")


# -- words and fingerprints -----------------------------------------------------------------------------------------------


def plain(text: str) -> str:
    """The text in lower case without markup, escapes and hyphens at line breaks."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    if "\\" in text:
        text = _ESCAPE.sub(" ", text)
    if "-\n" in text or "-\r" in text:
        text = _HYPHEN.sub("", text)
    return text.lower()


def own_text(text: str, shared_first: set[str]) -> str:
    """The text of an item without its instruction line."""
    head, _, body = text.strip().partition("\n")
    return body if body.strip() and head.strip() in shared_first else text


_BASE = 0x5851F42D4C957F2D  # odd, so its powers can be divided out again
_UNBASE = pow(_BASE, -1, 1 << 64)


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of every character whether it belongs to words, and a number; made once per process."""
    letter = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    value = (np.arange(0x110000, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return letter, value ^ (value >> np.uint64(31))


class Words:
    """Hashes of all words of a few texts at once: prefix sums of the characters, taken at the ends of the words."""

    def __init__(self):
        self.letter, self.value = _characters()
        self.power = self.unpower = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) <= n:
            with np.errstate(over="ignore"):
                for name, base in (("power", _BASE), ("unpower", _UNBASE)):
                    p = np.full(2 * n + 1, base, np.uint64)
                    p[0] = 1
                    setattr(self, name, np.multiply.accumulate(p))

    def _part(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        is_letter = np.concatenate(([False], self.letter[code], [False]))
        edge = np.flatnonzero(is_letter[1:] != is_letter[:-1])
        first, end = edge[::2], edge[1::2]
        self._powers(len(code))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.value[code] * self.power[: len(code)], dtype=np.uint64)))
        h = (sums[end] - sums[first]) * self.unpower[first]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32)), first

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The word hashes of all texts in a row and the place where each text begins (and the last ends)."""
        code = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        hashes, firsts, a = [], [], 0
        while a < len(code):
            b = a + SLICE_CHARS
            if b < len(code):  # never inside a word
                gap = np.flatnonzero(~self.letter[code[a:b]])
                b = a + int(gap[-1]) + 1 if len(gap) else self._word_end(code, b)
            h, first = self._part(code[a:b])
            hashes.append(h)
            firsts.append(first + a)
            a = b
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        first = np.concatenate(firsts) if firsts else np.empty(0, np.int64)
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        return h, np.searchsorted(first, begin)

    def _word_end(self, code: np.ndarray, b: int) -> int:
        while b < len(code):
            gap = np.flatnonzero(~self.letter[code[b : b + SLICE_CHARS]])
            if len(gap):
                return b + int(gap[0]) + 1
            b += SLICE_CHARS
        return len(code)


_MUL = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) | 1 for j in range(K)], np.uint64)


def gram_hashes(h: np.ndarray, k: int = K) -> np.ndarray:
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g += h[j : j + n] * _MUL[j]
    return g ^ (g >> np.uint64(29))


def inside(n_grams: int, begin: np.ndarray, k: int) -> np.ndarray:
    """Whether a gram lies within one of the texts that begin at ``begin``."""
    ok = np.ones(n_grams, bool)
    for j in range(1, k):
        at = begin[1:-1] - j
        ok[at[(at >= 0) & (at < n_grams)]] = False
    return ok


def winnow(g: np.ndarray) -> np.ndarray:
    """Whether each k-gram is the smallest of some window of WINDOW ones (the last of equal ones); windows may cross texts, which adds grams at most."""
    sel = np.zeros(len(g), bool)
    if len(g) < WINDOW:
        sel[len(g) - 1 - int(g[::-1].argmin()) if len(g) else slice(0)] = True
        return sel
    n = len(g) - WINDOW + 1
    low, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, WINDOW):
        less = g[j : j + n] <= low
        low[less] = g[j : j + n][less]
        at[less] = j
    sel[at + np.arange(n)] = True
    return sel


def text_grams(h: np.ndarray, begin: np.ndarray, winnowed: bool = True, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The k-gram hashes of texts and which of them count: those within a text, winnowed or all.

    Grams across two texts have the greatest hash, so that they push no other gram out of its window.
    """
    g = gram_hashes(h, k)
    ok = inside(len(g), begin, k)
    if winnowed:
        ok &= winnow(np.where(ok, g, np.uint64(0xFFFFFFFFFFFFFFFF)))
    return g, ok


# -- alignment ----------------------------------------------------------------------------------------------------------


def chain(pos: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest part of the hits that goes forward in the item and in the text alike."""
    o = np.lexsort((-at, pos))
    p, t = pos[o].tolist(), at[o].tolist()
    ends, tails, back = [], [], [-1] * len(p)
    for i, x in enumerate(t):
        k = bisect.bisect_left(ends, x)
        back[i] = tails[k - 1] if k else -1
        if k == len(ends):
            ends.append(x)
            tails.append(i)
        else:
            ends[k], tails[k] = x, i
    i, keep = tails[-1], []
    while i >= 0:
        keep.append(i)
        i = back[i]
    keep.reverse()
    return np.array([p[i] for i in keep]), np.array([t[i] for i in keep])


def centre_line(pos: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """For every word of an item of n the place in the text where the hits lead one to expect it, and how far to look around."""
    p, t = chain(pos, at)
    i = np.arange(n)
    mid = np.interp(i, p, t).astype(np.int64)
    mid[: p[0]] = t[0] - (p[0] - i[: p[0]])
    mid[p[-1] :] = t[-1] + (i[p[-1] :] - p[-1])
    jump = int(np.abs(np.diff(t) - np.diff(p)).max()) if len(p) > 1 else 0
    return mid, REACH + min(jump, JUMP)


def align(items: list[np.ndarray], mids: list[np.ndarray], reach: int, text: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(words of the item from the first to the last matched, matched words)`` of the best local alignment of each item.

    Item i is aligned with ``text[low[i]:high[i]]`` within ``reach`` places around ``mids[i]``; all items at once, row
    by row. A cell holds score, matched words and the first matched word in one number; a match counts 2, all else -1.
    """
    size, bits = np.array([len(w) for w in items]), 20
    n, m, width = int(size.max()), len(items), 2 * reach + 1
    kind = np.int64
    if n >= 1 << bits:
        bits, kind = n.bit_length(), object
    one, word = 1 << 2 * bits, 1 << bits
    w = np.zeros((m, n), np.uint64)
    base = np.empty((m, n), np.int64)
    for r, (x, c) in enumerate(zip(items, mids, strict=True)):
        w[r, : len(x)] = x
        base[r, : len(x)] = c
        base[r, len(x) :] = c[-1] + np.arange(1, n - len(x) + 1)
    base -= reach
    cols = np.arange(width)
    steps = (cols * one).astype(kind) if kind is np.int64 else np.array([int(c) * one for c in cols], object)
    v = np.zeros((m, width + 2), kind)
    top, last = np.full(m, one - 1, kind), np.zeros(m, np.int64)
    for i in range(n):
        j = base[:, i, None] + cols
        hit = (j >= low[:, None]) & (j < high[:, None]) & (i < size)[:, None]
        hit &= text[np.minimum(np.maximum(j, 0), len(text) - 1)] == w[:, i, None]
        if i:
            at = np.minimum(cols + (base[:, i] - base[:, i - 1])[:, None], width + 1)
            diag, up = np.take_along_axis(v, at, 1), np.take_along_axis(v, np.minimum(at + 1, width + 1), 1)
        else:
            diag = up = v[:, 1:-1]
        best = np.maximum(diag + np.where(hit, 2 * one + word, -one), up - one)
        best = np.maximum.accumulate(best + steps, 1) - steps
        best[best < one] = i + 1  # a path without a score is none; the next begins with the next word
        v[:, 1:-1] = best
        v[:, 0] = v[:, -1] = i + 1
        most = best.max(1)
        better = most // word > top // word
        top[better], last[better] = most[better], i + 1
    found = top >= one
    matched = np.where(found, top % one // word, 0).astype(np.int64)
    return np.where(found, last - (top % word).astype(np.int64), 0), matched


# -- index --------------------------------------------------------------------------------------------------------------


class _Table:
    """Sorted gram hashes with the items and positions at which each occurs; a bitmap tells most strangers at once."""

    def __init__(self, words: list[np.ndarray], numbers: list[int], k: int):
        gs = [gram_hashes(words[i], k) for i in numbers]
        g = np.concatenate(gs) if gs else np.empty(0, np.uint64)
        item = np.repeat(np.array(numbers, np.int64), [len(x) for x in gs])
        pos = np.concatenate([np.arange(len(x)) for x in gs]) if gs else np.empty(0, np.int64)
        o = np.argsort(g, kind="stable")
        self.k, self.item, self.pos = k, item[o], pos[o]
        self.hash, start = np.unique(g[o], return_index=True)
        self.start = np.append(start, len(o))
        self.some = np.zeros(1 << 22, bool)
        self.some[self.hash >> np.uint64(42)] = True

    def lookup(self, g: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(places, rows of hash)`` of the grams that items have."""
        if not len(self.hash):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(ok & self.some[g >> np.uint64(42)])
        row = np.searchsorted(self.hash, g[at])
        row[row == len(self.hash)] = 0
        same = self.hash[row] == g[at]
        return at[same], row[same]

    def hits(self, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(item, position in the item, place in the text)`` of every hit."""
        n = self.start[row + 1] - self.start[row]
        src = np.repeat(self.start[row], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.item[src], self.pos[src], np.repeat(at, n)


class ItemIndex:
    """Fingerprints of a block of items and their words."""

    def __init__(self, ids: list[int], texts: list[str], shared_first: set[str], share: float = SHARE, span: int | None = None):
        h, begin = Words()([plain(own_text(t, shared_first)) for t in texts])
        self.words = [h[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]
        self.ids, self.sizes = np.array(ids, np.int64), np.diff(begin)
        self.share, self.span = share, span
        self.least = least_hits(self.sizes, span)
        self.tables = {}  # (gram length, winnowed) -> table
        for key, low, high in [((k, False), k, k) for k in range(1, K)] + [((K, False), K, SHORT - 1), ((K, True), SHORT, np.inf)]:
            numbers = np.flatnonzero((self.sizes >= low) & (self.sizes <= high)).tolist()
            if numbers:
                self.tables[key] = _Table(self.words, numbers, key[0])

    def search(self, h: np.ndarray, begin: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``(text number, item number, stretch, matched)`` of all texts and items."""
        out = []
        for (k, winnowed), table in self.tables.items():
            at, row = table.lookup(*text_grams(h, begin, winnowed, k))
            text = np.searchsorted(begin, at, side="right") - 1
            cost = np.cumsum(table.start[row + 1] - table.start[row])
            a = 0
            while a < len(at):  # whole texts, as many as give a bounded number of hits
                b = max(int(np.searchsorted(cost, (cost[a - 1] if a else 0) + SLICE_HITS, side="right")), a + 1)
                b = int(np.searchsorted(text, text[b - 1], side="left")) if b < len(at) and text[b - 1] != text[a] else int(np.searchsorted(text, text[b - 1], side="right"))
                item, pos, place = table.hits(at[a:b], row[a:b])
                where = np.searchsorted(begin, place, side="right") - 1
                if k < K:
                    out += [(t, i, k, k) for t, i in set(zip(where.tolist(), item.tolist(), strict=True))]
                else:
                    self._extend(h, begin, where, item, pos, place, out)
                a = b
        return out

    def _extend(self, h, begin, where, item, pos, place, out) -> None:
        """Align every band of diagonals with enough hits, the fullest of each pair first, until the pair is accepted."""
        pair = where * len(self.ids) + item
        while len(pair):
            o = np.argsort(pair, kind="stable")
            pair, where, item, pos, place = pair[o], where[o], item[o], pos[o], place[o]
            start = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            n = np.diff(np.append(start, len(pair)))
            many = np.repeat(n >= self.least[item[start]], n)
            pair, where, item, pos, place = pair[many], where[many], item[many], pos[many], place[many]
            if not len(pair):
                return
            o = np.lexsort((place - pos, pair))
            pair, where, item, pos, place = pair[o], where[o], item[o], pos[o], place[o]
            start = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            rank = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(pair))))
            far = 2 * (len(h) + int(self.sizes.max()) + 8)
            key = rank * far + place - pos + far // 2
            count = np.searchsorted(key, key + np.maximum(4, self.sizes[item] // 2), side="right") - np.arange(len(key))
            top = np.maximum.reduceat(count, start)
            first = np.flatnonzero(count == np.repeat(top, np.diff(np.append(start, len(pair)))))
            first = first[np.unique(rank[first], return_index=True)[1]]
            enough = top >= self.least[item[start]]
            first, top = first[enough], top[enough]
            gone = np.zeros(len(pair) + 1, np.int64)
            np.add.at(gone, first, 1)
            np.add.at(gone, first + top, -1)
            good = self._align(h, begin, [(int(where[a]), int(item[a]), pos[a : a + c], place[a : a + c]) for a, c in zip(first.tolist(), top.tolist(), strict=True)])
            out += good
            done = np.array([t * len(self.ids) + i for t, i, _, _ in good], np.int64)
            left = (np.cumsum(gone[:-1]) == 0) & np.isin(pair, pair[first]) & ~np.isin(pair, done)
            pair, where, item, pos, place = pair[left], where[left], item[left], pos[left], place[left]

    def needed(self, n: int) -> int:
        """The fewest matched words with which an item of n words can be accepted."""
        least = self.share * n / (2 if n >= LONG_ITEM else 1)
        return int(np.ceil(min(least, self.span) if self.span else least))

    def accepted(self, n: int, long: int, matched: int) -> bool:
        if self.span and matched >= self.span and 10 * matched >= 7 * long:
            return True
        if n < SHORT and matched < K:
            return False
        return matched >= self.share * n and 10 * matched >= 7 * long or long >= self.share * n and n >= LONG_ITEM and 2 * matched >= long

    def _align(self, h, begin, bands) -> list[tuple[int, int, int, int]]:
        jobs = []
        for t, i, pos, place in bands:
            w, diag = self.words[i], place - pos
            low, high, near, far = int(begin[t]), int(begin[t + 1]), int(diag.min()), int(diag.max())
            reach = REACH + min(far - near, JUMP)
            around = set(h[max(low, near - reach) : min(high, far + len(w) + reach)].tolist())
            if sum(map(around.__contains__, w.tolist())) >= self.needed(len(w)):
                mid, reach = centre_line(pos, place, len(w))
                jobs.append((reach.bit_length(), len(w), reach, t, i, mid, low, high))
        jobs.sort(key=lambda j: j[:2])
        out, a = [], 0
        while a < len(jobs):
            b, reach = a, 0
            while b < len(jobs) and jobs[b][0] == jobs[a][0] and (b == a or jobs[b][1] <= 2 * jobs[a][1] and (b - a + 1) * (2 * max(reach, jobs[b][2]) + 1) <= SLICE_CELLS):
                reach = max(reach, jobs[b][2])
                b += 1
            part = jobs[a:b]
            long, matched = align([self.words[j[4]] for j in part], [j[5] for j in part], reach, h, np.array([j[6] for j in part]), np.array([j[7] for j in part]))
            for j, x, y in zip(part, long.tolist(), matched.tolist(), strict=True):
                if self.accepted(j[1], x, y):
                    out.append((j[3], j[4], x, y))
            a = b
        return out


def least_hits(sizes: np.ndarray, span: int | None = None) -> np.ndarray:
    """Hits on one band that an item of so many words needs: what its half leaves at least, changed words allowed for."""
    least = np.maximum(1, np.floor(SEED_SHARE * sizes)).astype(np.int64)
    return np.minimum(least, max(1, (span - K + 1) // (2 * WINDOW))) if span else least


def slices(texts: list[str]):
    """``(first, end)`` of runs of texts of bounded length together, a longer text by itself."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > SLICE_CHARS:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


# -- operator -----------------------------------------------------------------------------------------------------------

_FOUND = "_id long, item_id long, stretch int, matched int, item_words int"


def _search(index):
    def run(batches):
        items, words = index.value, Words()
        for pdf in batches:
            rows, keys, texts = [], pdf._id.tolist(), [plain(t) for t in pdf._text]
            for a, b in slices(texts):
                h, begin = words(texts[a:b])
                rows += [(keys[a + t], int(items.ids[i]), long, matched, int(items.sizes[i])) for t, i, long, matched in items.search(h, begin)]
            yield pd.DataFrame(rows, columns=["_id", "item_id", "stretch", "matched", "item_words"]).astype({"_id": "Int64"})

    return run


def _text_marks(lengths: list[tuple[int, bool]]):
    """Fingerprints of texts, by the gram lengths that items need."""

    def run(batches):
        words = Words()
        for pdf in batches:
            keys, texts = pdf._key.to_numpy(), [plain(t) for t in pdf._text]
            for a, b in slices(texts):
                h, begin = words(texts[a:b])
                for k, winnowed in lengths:
                    g, ok = text_grams(h, begin, winnowed, k)
                    at = np.flatnonzero(ok)
                    t = np.searchsorted(begin, at, side="right") - 1
                    yield pd.DataFrame({"kind": 2 * k + winnowed, "gram": g[at].view(np.int64), "_key": keys[a + t], "at": at - begin[t]})

    return run


def _item_marks(shared_first):
    def run(batches):
        words = Words()
        for pdf in batches:
            keys, texts = pdf.item_id.to_numpy(), [plain(own_text(t, shared_first.value)) for t in pdf.text]
            for a, b in slices(texts):
                h, begin = words(texts[a:b])
                for i in range(b - a):
                    w = h[begin[i] : begin[i + 1]]
                    k = min(len(w), K)
                    if k:
                        g = gram_hashes(w, k)
                        yield pd.DataFrame({"kind": 2 * k + (len(w) >= SHORT), "gram": g.view(np.int64), "item_id": keys[a + i], "pos": np.arange(len(g)), "least": int(least_hits(np.array([len(w)]))[0])})

    return run


def _pairs(shared_first, share: float, span: int | None):
    def run(batches):
        words = Words()
        for pdf in batches:
            rows = []
            for key, text, item_id, item in zip(pdf._id, pdf._text, pdf.item_id, pdf.item_text, strict=True):
                index = ItemIndex([item_id], [item], shared_first.value, share, span)
                h, begin = words([plain(text)])
                rows += [(key, item_id, long, matched, int(index.sizes[0])) for _, _, long, matched in index.search(h, begin)]
            yield pd.DataFrame(rows, columns=["_id", "item_id", "stretch", "matched", "item_words"]).astype({"_id": "Int64"})

    return run


def _by_shuffle(d: DataFrame, it: DataFrame, shared_first: set[str], share: float, span: int | None) -> DataFrame:
    """Candidate pairs by a join of fingerprints, then the texts and items of these alone."""
    heads = d.sparkSession.sparkContext.broadcast(shared_first)
    d = d.withColumn("_key", F.xxhash64("_id", "_text"))  # equal rows are one here; each comes back with its text
    items = spread(it).mapInPandas(_item_marks(heads), "kind int, gram long, item_id long, pos long, least long")
    kinds = [(k // 2, bool(k % 2)) for k in sorted(r[0] for r in items.select("kind").distinct().collect())]  # five at most
    texts = d.select("_key", "_text").mapInPandas(_text_marks(kinds), "kind int, gram long, _key long, at long")
    few = items.select("kind", "gram").distinct()
    texts = texts.join(few, ["kind", "gram"], "left_semi")
    hits = join_skewed(texts, items, ["kind", "gram"])
    pairs = hits.groupBy("_key", "item_id").agg(F.count_distinct("at").alias("n"), F.max("least").alias("least"))
    pairs = pairs.where(F.col("n") >= (F.col("least") if span is None else F.lit(1))).select("_key", "item_id")
    both = join_skewed(pairs, it.select("item_id", F.col("text").alias("item_text")), ["item_id"])
    both = join_skewed(both, d, ["_key"])
    return both.select("_id", "_text", "item_id", "item_text").mapInPandas(_pairs(heads, share, span), _FOUND)


def find_leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, span: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, item_id, stretch, matched, item_words)`` of every text and item it holds in large part.

    ``share`` is that part of the item's own words; with ``span`` every shared stretch of so many matched words is
    reported too, however long its item is (WINDOW + K - 1 words or more are sure to be seen).
    """
    spark = documents.sparkSession
    it = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("item_id is not null and text is not null")
    head = F.trim(F.substring_index(F.ltrim("text"), "\n", 1))
    shared = it.where(F.instr(F.trim("text"), "\n") > 0).groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.size(F.split("head", r"\s+")) <= INSTRUCTION_WORDS))
    # an instruction serves several items, so there are fewer than half as many as items; the longest are of one line
    shared_first = {r["head"].strip() for r in shared.toLocalIterator()}
    d = spread(documents.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where("_text is not null and _text <> ''"))
    size = it.agg(F.sum(F.size(F.split("text", r"\s+")) + 1)).first()[0] or 0
    if size > block_words:
        return _by_shuffle(d, it, shared_first, share, span).withColumnRenamed("_id", id_col)
    rows = it.orderBy("item_id").collect()  # no more than block_words words
    if not rows:
        return spark.createDataFrame([], _FOUND).withColumnRenamed("_id", id_col)
    index = spark.sparkContext.broadcast(ItemIndex([r[0] for r in rows], [r[1] for r in rows], shared_first, share, span))
    return d.mapInPandas(_search(index), _FOUND).withColumnRenamed("_id", id_col)
