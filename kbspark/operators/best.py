"""The best documents of large sets of queries, shard by shard.

The list of all hits grows with queries times documents, so it is never written down: a task adds up the scores of its own
documents for one question after the other and hands on the k best of each. Questions are the distinct sets of terms of
the queries. Ranks are those of ``search.top_k`` over all hits, scores rounded to DIGITS first, equal scores by the
smaller id. Ids are expected once; callers look (``repeated``) and otherwise list all hits. With lists per buffer the
work also grows with the number of buffers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kbspark.operators import search as S

#: Queries that pass over the documents together; documents a task scores at once; digits of a score.
QUERIES, ROWS, DIGITS = 50_000, 20_000, 6
#: Terms whose values a task keeps for all documents of a table; hits a task gathers before it keeps the best of them only.
SPREAD, KEPT = 256, 300_000


def repeated(items: DataFrame) -> bool:
    """Whether an id comes more than once."""
    return not items.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _tables(batches, rows: int):
    """The batches put together to tables of some ``rows`` rows."""
    got, n = [], 0
    for b in batches:
        got.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(got).combine_chunks()
            got, n = [], 0
    if n:
        yield pa.Table.from_batches(got).combine_chunks()


def _column(items: pa.Table, name: str) -> pa.Array:
    c = items[name]
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)


def _scorer(sets: list[np.ndarray], weights: np.ndarray, read: Callable, k: int, mode: str, by_buffer: bool):
    """The k best items of each question in a shard. ``read`` gives row, term and value of what a table of items holds, each row and term once."""
    scale, tiny = 10.0**DIGITS, np.nextafter(0.0, 1.0)

    def best_of(kept: list[pa.RecordBatch], low: np.ndarray, whole: np.ndarray) -> list[pa.RecordBatch]:
        """The k best of each question of what was found so far; ``low`` follows them."""
        got = pa.Table.from_batches(kept)
        q, full = np.asarray(got["q"]), np.asarray(got["full"])
        got = got.filter(pa.array((np.asarray(got["score"]) >= low[q]) & (full | ~whole[q])))
        got = got.take(pc.sort_indices(got, [("q", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start"))
        q = np.asarray(got["q"])
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = np.flatnonzero(rank == k - 1)
        low[q[last]] = np.asarray(got["score"])[last]
        return got.filter(pa.array(rank < k)).combine_chunks().to_batches(max_chunksize=ROWS)

    def run(batches):
        least: dict = {}  # of each buffer, what the k-th of every question has so far
        whole = np.zeros(len(sets), bool)  # questions with an item that has all terms
        kept, least_kept = [], 0  # what was found, and its rows when it was last gone through
        for items in _tables(batches, ROWS):
            bounds, names = np.array([0, items.num_rows]), [None]
            if by_buffer:
                codes = _column(items, "buffer").dictionary_encode(null_encoding="encode")
                order = np.argsort(np.asarray(codes.indices), kind="stable")
                items, names = items.take(pa.array(order)).combine_chunks(), codes.dictionary.to_pylist()
                bounds = np.searchsorted(np.asarray(codes.indices)[order], np.arange(len(names) + 1))
            ids = _column(items, "id")
            place = np.empty(len(ids), np.int64)
            place[np.asarray(pc.sort_indices(ids, null_placement="at_start"))] = np.arange(len(ids))
            row, term, value = read(items)
            order = np.argsort(term, kind="stable")
            row, value = row[order], value[order] * weights[term[order]]
            start = np.searchsorted(term[order], np.arange(len(weights) + 1))
            score, found, held = np.zeros(len(ids)), [], {}

            def values(t: int) -> np.ndarray:
                """What a term has in every row, NaN where it is missing."""
                if (x := held.get(t)) is None:
                    x = np.full(len(ids), np.nan)
                    x[row[start[t] : start[t + 1]]] = value[start[t] : start[t + 1]]
                    if len(held) < SPREAD:
                        held[t] = x
                return x

            for q, terms in enumerate(sets):
                parts = [slice(start[t], start[t + 1]) for t in terms if start[t] < start[t + 1]]
                if not parts:
                    continue
                full = mode != "or" and len(terms) == 1
                if mode != "or" and len(terms) > 1:
                    at, x = np.array([], np.int64), np.array([])
                    if len(parts) == len(terms):
                        at = row[min(parts, key=lambda p: p.stop - p.start)]
                        x = sum(values(t)[at] for t in terms)  # NaN without one of the terms
                        if not whole[q] and not np.isnan(x).all():
                            whole[q] = True
                            for y in least.values():
                                y[q] = 0
                    full = mode == "and" or bool(whole[q])
                lows = [least.setdefault(name, np.zeros(len(sets))) for name in names]
                floor = max(min(y[q] for y in lows) - 1 / scale, tiny)
                if full and len(terms) > 1:
                    most = x >= floor
                    at, x = at[most], x[most]
                else:
                    score.fill(0)
                    for p in parts:
                        score[row[p]] += value[p]
                    at = np.flatnonzero(score >= floor)
                    x = score[at]
                rounded = np.floor(x * scale + 0.5) / scale
                cuts = np.searchsorted(at, bounds)
                for g, low in enumerate(lows):
                    at_, r = at[cuts[g] : cuts[g + 1]], rounded[cuts[g] : cuts[g + 1]]
                    at_, r = at_[r >= low[q]], r[r >= low[q]]
                    if len(at_) >= k:
                        low[q] = np.partition(r, len(r) - k)[len(r) - k]
                        above, tied = np.flatnonzero(r > low[q]), np.flatnonzero(r == low[q])
                        left = k - len(above)
                        tied = tied[np.argpartition(place[at_[tied]], left - 1)[:left]]
                        some = np.concatenate([above, tied])
                        at_, r = at_[some], r[some]
                    if len(at_):
                        found.append((np.full(len(at_), q, np.int32), at_, r, np.full(len(at_), full)))
            if found:
                q, at, r, full = (np.concatenate(x) for x in zip(*found, strict=True))
                part = pa.RecordBatch.from_arrays([pa.array(q), ids.take(pa.array(at)), _column(items, "buffer").take(pa.array(at)), pa.array(r), pa.array(full)], ["q", "id", "buffer", "score", "full"])
                if by_buffer:
                    yield part
                    continue
                kept.append(part)
                if sum(x.num_rows for x in kept) > max(KEPT, 2 * least_kept):
                    kept = best_of(kept, least[None], whole)
                    least_kept = sum(x.num_rows for x in kept)
        if kept:
            yield from best_of(kept, least[None], whole)

    return run


def _lists(terms: DataFrame, items: DataFrame, asked: Callable, k: int, mode: str = "or", by_buffer: bool = False) -> DataFrame:
    """``(query_id, id, buffer, score, rank)`` for ``(query_id, term)``, from one pass over the items per block of queries.

    ``asked`` takes the distinct terms and gives their weights and how items are read.
    """
    spark, types = terms.sparkSession, dict(terms.dtypes) | {f"i_{n}": t for n, t in items.dtypes}
    schema = f"q int, id {types['i_id']}, buffer {types['i_buffer']}, score double, full boolean"
    sets = terms.where("query_id is not null").groupBy("query_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    items = items.coalesce(max(spark.sparkContext.defaultParallelism, 1))  # few shards, so few lists to merge
    by, out = ["q", *["buffer"] * by_buffer], []
    for block in S.query_blocks(sets, QUERIES):
        got = block.toArrow()  # a block is bounded
        numbers: dict[tuple, int] = {}
        at = [numbers.setdefault(tuple(x), len(numbers)) for x in got["terms"].to_pylist()]
        words = {w: i for i, w in enumerate(sorted({w for x in numbers for w in x}))}
        weights, read = asked(list(words))
        of = spark.createDataFrame(pa.table({"query_id": got["query_id"], "q": pa.array(at, pa.int32())}), f"query_id {types['query_id']}, q int")
        hits = items.mapInArrow(_scorer([np.array([words[w] for w in x], np.int64) for x in numbers], weights, read, k, mode, by_buffer), schema)
        if mode == "fallback":
            hits = hits.withColumn("_full", F.max("full").over(W.partitionBy("q"))).where("full = _full")
        out.append(S.top_k(hits, k, by).join(F.broadcast(of), "q").select("query_id", "id", "buffer", "score", "rank"))
    return S._united(out)


def _frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """The number of documents with each of some words; a task counts its own and hands on a row per word."""
    known = pa.array(words, pa.string())

    def run(batches):
        n = np.zeros(len(words), np.int64)
        for b in batches:
            term = pc.index_in(pc.struct_field(pc.list_flatten(b.column(0)), "term").cast(pa.string()), value_set=known).drop_null()
            n += np.bincount(np.asarray(term), minlength=len(words))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], ["term", "df"])

    df = docs.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {words[r["term"]]: r["df"] for r in df.collect()}  # terms of a block are bounded


def by_text(terms: DataFrame, docs: DataFrame, stats: tuple[int, float | None], k: int, mode: str = "or", by_buffer: bool = False) -> DataFrame:
    """The best of ``search.ranked_hits`` for documents ``(id, buffer, dl, terms)``, a term once in each."""
    n_docs, avg_dl = stats

    def asked(words: list[str]):
        df = _frequencies(docs, words)
        idf = np.array([max(np.log((n_docs - df[w] + 0.5) / (df[w] + 0.5)), S.IDF_FLOOR) if w in df else 0.0 for w in words])
        known = pa.array(words, pa.string())

        def read(items: pa.Table):
            lists = _column(items, "terms")
            n, flat = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)), pc.list_flatten(lists)
            term = pc.index_in(pc.struct_field(flat, "term").cast(pa.string()), value_set=known)
            held = np.flatnonzero(np.asarray(term.is_valid()))
            row, tf = np.repeat(np.arange(len(n)), n)[held], np.asarray(pc.struct_field(flat, "tf"), np.float64)[held]
            dl = np.asarray(_column(items, "dl"), np.float64)[row]
            value = tf * (S.K1 + 1) / (tf + S.K1 * (1 - S.B + S.B * dl / avg_dl)) if len(held) else tf
            return row, np.asarray(term.take(pa.array(held)), np.int64), value

        return idf, read

    return _lists(terms, docs, asked, k, mode, by_buffer)


def by_entities(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The best of ``search.entity_search`` for ``(query_id, entity)``; the index holds ``(id, buffer, phrases)``."""
    if repeated(index):
        return S.top_k(S.entity_search(queries, index), k)

    def asked(words: list[str]):
        known, lengths = pa.array(words, pa.string()), sorted({len(w) for w in words})

        def read(items: pa.Table):
            lists = _column(items, "phrases")
            n, flat = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)), pc.list_flatten(lists).dictionary_encode()
            row, code = np.repeat(np.arange(len(n)), n), np.asarray(flat.indices, np.int64)
            keys = [np.array([], np.int64)]
            for size in lengths:
                term = pc.index_in(pc.utf8_slice_codeunits(flat.dictionary.cast(pa.string()), 0, size), value_set=known)
                term = np.asarray(pc.fill_null(term, -1), np.int64)[code] if len(code) else code
                keys.append(row[term >= 0] * len(words) + term[term >= 0])
            key = np.unique(np.concatenate(keys))
            return key // max(len(words), 1), key % max(len(words), 1), np.ones(len(key))

        return np.ones(len(words)), read

    return _lists(S.wanted_phrases(queries).withColumnRenamed("wanted", "term"), index, asked, k)
