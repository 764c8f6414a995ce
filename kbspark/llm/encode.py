"""Problem 7: token ids of every text by a public byte-level BPE tokenizer.

Texts up to ``LONG`` characters are encoded whole, in Arrow batches. Longer ones are halved again and again into leaves
that are encoded in parallel on all executors, and put together again:

* Where a leaf ends with a character that is no white space and the next begins with white space, the tokenizer's own
  pattern always splits, whatever surrounds the place; such leaves are simply concatenated.
* A run without such a place is split by the tokenizer's pattern; only a single unsplit stretch longer than a leaf is
  halved inside, as bytes. At these joins the tokens of a growing window around the join are encoded again until the
  window's first and last token agree with those of the two sides. Every two neighbouring tokens then also stand side
  by side in some true encoding, and an encoding all of whose neighbouring pairs are true ones is the encoding.

Defined results: null and empty texts give an empty array; the strings of special tokens are ordinary text; repeated
rows come out as often as they go in; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.plans.spread import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters above which a text is encoded in leaves, and characters of a leaf.
LONG, LEAF = 65_536, 16_384
FIRST_WINDOW = 8

_SAFE, _SAFE_BACK = regex.compile(r"\S(?=\s)"), regex.compile(r"(?r)\S(?=\s)")
_SPLIT = regex.compile(PATTERN)


@lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    """The tokenizer, loaded once per Python worker."""
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def join_ids(enc: tiktoken.Encoding, left: list[int], right: list[int], window: int = FIRST_WINDOW) -> list[int]:
    """The encoding of two halves of one unsplit stretch, given their encodings."""
    if not left or not right:
        return left + right
    while True:
        a, b = left[-window:], right[:window]
        new = enc._encode_single_piece(enc.decode_bytes(a + b))
        whole_left, whole_right = len(a) == len(left), len(b) == len(right)
        if (whole_left or new[0] == a[0]) and (whole_right or new[-1] == b[-1]):
            return left[: len(left) - len(a)] + new + right[len(b) :]
        window *= 2


def join_tree(enc: tiktoken.Encoding, parts: list[list[int]]) -> list[int]:
    """The encoding of an unsplit stretch from those of its consecutive parts, joined pairwise level by level."""
    while len(parts) > 1:
        parts = [join_ids(enc, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def leaves(text: str, leaf: int = LEAF) -> list[tuple[str, bool, bool]]:
    """``(text, raw, glued)`` of the leaves of a text: raw ones are parts of one unsplit stretch, glued ones continue the leaf before."""
    out: list[tuple[str, bool, bool]] = []

    def halves(t: str) -> None:
        if len(t) <= leaf:
            out.append((t, False, False))
            return
        mid, reach = len(t) // 2, len(t) // 4
        m = _SAFE.search(t, mid, mid + reach) or _SAFE_BACK.search(t, 0, mid + 1) or _SAFE.search(t, mid + reach - 2)
        if m:
            halves(t[: m.end()])
            halves(t[m.end() :])
        else:
            pieces(t)

    def pieces(t: str) -> None:
        held: list[str] = []
        size = 0

        def flush() -> None:
            # white space at the end of a leaf would be split otherwise than before ink, so it goes out piece by piece
            n = len(held)
            while n and held[n - 1].isspace():
                n -= 1
            if n:
                out.append(("".join(held[:n]), False, False))
            out.extend((p, True, False) for p in held[n:])
            held.clear()

        for m in _SPLIT.finditer(t):
            p = m[0]
            if held and (size + len(p) > leaf or len(p) > leaf):
                flush()
                size = 0
            if len(p) > leaf:
                n = 1 << (len(p) // leaf).bit_length()
                at = [len(p) * i // n for i in range(n + 1)]
                out.extend((p[a:b], True, i > 0) for i, (a, b) in enumerate(zip(at, at[1:], strict=False)))
            else:
                held.append(p)
                size += len(p)
        flush()

    halves(text)
    return out


def _encode_whole(vocabulary: str):
    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            ids = [np.asarray(enc.encode_ordinary(t), dtype=np.int32) if t else np.empty(0, np.int32) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "ids"])

    return run


def _cut(leaf: int):
    def run(batches):
        for pdf in batches:
            rows = [(k, h, n, i, *x) for k, h, n, t in zip(pdf._id, pdf._hash, pdf._copies, pdf._text, strict=True) for i, x in enumerate(leaves(t, leaf))]
            yield pd.DataFrame(rows, columns=["_id", "_hash", "_copies", "_seq", "_text", "_raw", "_glued"]).astype({"_id": "Int64"})

    return run


def _encode_leaves(vocabulary: str):
    def run(batches):
        enc = encoder(vocabulary)
        for pdf in batches:
            pdf["ids"] = [enc._encode_single_piece(t.encode()) if raw else enc.encode_ordinary(t) for t, raw in zip(pdf._text, pdf._raw, strict=True)]
            yield pdf.drop(columns="_text").astype({"_id": "Int64"})

    return run


def _put_together(vocabulary: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        enc, out, held = encoder(vocabulary), [], []
        for ids, raw, glued in pdf.sort_values("_seq")[["ids", "_raw", "_glued"]].itertuples(index=False):
            if not glued and held:
                out.append(join_tree(enc, held))
                held = []
            (held if raw else out).append(list(ids))
        if held:
            out.append(join_tree(enc, held))
        one = pdf.iloc[:1]
        return pd.DataFrame({"doc_id": one._id.astype("Int64"), "_copies": one._copies, "ids": [[i for x in out for i in x]]})

    return run


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, long: int = LONG, leaf: int = LEAF) -> DataFrame:
    """``(doc_id, ids)`` for every row."""
    d = spread(documents.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")))
    size = F.coalesce(F.length("_text"), F.lit(0))
    short = d.where(size <= long).mapInArrow(_encode_whole(vocabulary), "doc_id long, ids array<int>")
    big = d.where(size > long).groupBy("_id", F.sha2("_text", 256).alias("_hash")).agg(F.first("_text").alias("_text"), F.count(F.lit(1)).alias("_copies"))
    cut = big.mapInPandas(_cut(leaf), "_id long, _hash string, _copies long, _seq long, _text string, _raw boolean, _glued boolean")
    coded = cut.repartition("_id", "_hash", "_seq").mapInPandas(_encode_leaves(vocabulary), "_id long, _hash string, _copies long, _seq long, _raw boolean, _glued boolean, ids array<int>")
    whole = coded.groupBy("_id", "_hash").applyInPandas(_put_together(vocabulary), "doc_id long, _copies long, ids array<int>")
    whole = whole.select("doc_id", "ids", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("doc_id", "ids")
    return short.unionByName(whole)
