"""Lexical, entity and vector search for batches of queries, and the fusion of ranked lists.

Query sets are stated inputs; their size is counted and they are broadcast only below ``BROADCAST_QUERIES`` rows,
otherwise joins shuffle. Ranked lists are ``(query_id, id, score)``; equal scores are ordered by the smaller id. Null
and empty texts have no terms and match nothing but count as documents; empty tables give no rows; further columns of
the inputs are ignored; ids are expected once; rows repeated with one id count as documents each and add up in a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kbspark.config import Chunking, Search
from kbspark.functions import scores
from kbspark.functions import text as T
from kbspark.functions.porter import stem_counts, stemmed
from kbspark.plans.spread import spread

BROADCAST_QUERIES = 10_000
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6

# What names an entity.
FUNCTION_NAME = r"(?i)\b(?:fn|def|function|func|pub\s+fn|async\s+fn)\s+([a-zA-Z_][a-zA-Z0-9_]*)"
IMPORTED = r"(?i)\b(?:use|from|import)\s+([a-zA-Z_][a-zA-Z0-9_:./]*)"
IDENTIFIER = r"\b([A-Z][a-zA-Z0-9]+|[a-z]+(?:_[a-z]+)+)\b"


def few(queries: DataFrame) -> bool:
    """Whether a query set is small enough to broadcast; it is counted up to the bound only."""
    return queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES


def small(queries: DataFrame) -> DataFrame:
    """The queries, marked for broadcast if they are few."""
    return F.broadcast(queries) if few(queries) else queries


def held(queries: DataFrame) -> tuple[DataFrame, bool]:
    """The queries as a local table if they are few, so that they are computed once; and whether they are."""
    got = queries.limit(BROADCAST_QUERIES + 1).toArrow()
    return (F.broadcast(queries.sparkSession.createDataFrame(got, queries.schema)), True) if got.num_rows <= BROADCAST_QUERIES else (queries, False)


def query_blocks(queries: DataFrame, size: int = BROADCAST_QUERIES) -> list[DataFrame]:
    """The queries in blocks of some ``size`` rows at most, each marked for broadcast, by the hash of ``query_id``.

    What compares every query with every item passes over the items once per block.
    """
    n = -(-queries.count() // size) or 1
    if n == 1:
        return [F.broadcast(queries)]
    n = n + n // 8 + 1  # room for uneven blocks
    return [F.broadcast(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)) for i in range(n)]


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term)`` distinct stems, from ``(query_id, text)``."""
    return queries.select("query_id", F.explode_outer(F.array_distinct(stemmed(T.tokens(F.col("text"))))).alias("term")).where("term is not null")


def tokenized(docs: DataFrame) -> DataFrame:
    """``(id, buffer, dl, terms)`` of ``(id, buffer, text)``: the number of words, and the distinct stems with their counts."""
    words = spread(docs.select("id", "buffer", "text")).select("id", "buffer", T.tokens(F.col("text")).alias("words"))
    return words.select("id", "buffer", F.size("words").alias("dl"), stem_counts(F.col("words")).alias("terms"))


def postings(docs: DataFrame) -> DataFrame:
    """``(id, buffer, dl, term, tf)``: the inverted index of ``(id, buffer, text)``, by stems; nothing is shuffled."""
    return posted(tokenized(docs))


def posted(docs: DataFrame) -> DataFrame:
    """The same of documents that are ``tokenized``."""
    t = docs.select("id", "buffer", "dl", F.explode_outer("terms").alias("t"))
    return t.where("t is not null").select("id", "buffer", "dl", F.col("t.term").alias("term"), F.col("t.tf").alias("tf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """``(n_docs, avg_dl)`` in one row."""
    return spread(docs.select("text")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg(T.token_count(F.col("text"))).alias("avg_dl"))


def term_stats(posted: DataFrame) -> DataFrame:
    """``(term, df, cf)``: documents and occurrences of each term."""
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def ranked_hits(terms: DataFrame, posted: DataFrame, stats: tuple[int, float | None], mode: str = "or") -> DataFrame:
    """``(query_id, id, buffer, score, n_hit, n_terms)`` from query terms, postings, and the number of documents and their mean length.

    ``and`` keeps documents with all terms, ``or`` with any, ``fallback`` those with all, or with any where a query of
    several terms has none with all. Only the postings of query terms go on from the scan; statistics cover all
    documents. Few query terms get their weights first, so that the postings are read through once more only.
    """
    terms, bounded = held(terms)
    mark = F.broadcast if bounded else (lambda x: x)  # all that has one row per query term at most
    n_docs, avg_dl = stats
    df = posted.join(mark(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.ln((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    n = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    weights = terms.join(df, "term").join(mark(n), "query_id").select("query_id", "term", idf.alias("idf"), "n_terms")
    if bounded:
        weights, _ = held(weights)
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avg_dl)))
    out = posted.join(weights, "term").groupBy("query_id", "id", "buffer").agg(F.sum(F.col("idf") * tf).alias("score"), F.count(F.lit(1)).alias("n_hit"), F.max("n_terms").alias("n_terms"))
    if mode == "or":
        return out
    full = F.col("n_hit") >= F.col("n_terms")
    if mode == "and":
        return out.where(full)
    # all columns are asked for, so that both sides share one aggregation
    some = out.where(full).groupBy("query_id").agg(F.max("score").alias("_full"))
    return out.join(mark(some), "query_id", "left").where(full | (F.col("_full").isNull() & (F.col("n_terms") > 1))).drop("_full")


def bm25(queries: DataFrame, docs: DataFrame, mode: str = "or") -> DataFrame:
    """``ranked_hits`` of documents without a stored index (``operators.index`` keeps one)."""
    n_docs, avg_dl = corpus_stats(docs).first()
    return ranked_hits(query_terms(queries), postings(docs), (n_docs, avg_dl), mode)


def top_k(ranked: DataFrame, k: int, by: list[str] = ("query_id",), score: str = "score", id_col: str = "id") -> DataFrame:
    """The k best of every list with their 0-based ``rank``; a rank limit is applied before the shuffle."""
    w = W.partitionBy(*by).orderBy(F.col(score).desc(), F.col(id_col))
    return ranked.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


# -- entities -----------------------------------------------------------------------------------------------------------


def entities(text: Column, path: Column, most: int = Chunking.max_entities) -> Column:
    """Names in a text and the stem of its path: lower case, sorted, distinct, the first few.

    Characters outside ASCII separate names.
    """
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x00-\x7F]", " ")

    def all_(rx: str) -> Column:
        return F.regexp_extract_all(plain, F.lit(rx), 1)

    imports = F.transform(all_(IMPORTED), lambda x: F.regexp_extract(x, r"([^:/.]*)$", 1))
    names = F.filter(all_(IDENTIFIER), lambda x: F.length(x) >= 3)
    stem = F.filter(F.array(F.coalesce(T.file_stem(path), F.lit(""))), lambda x: x != "")
    found = F.filter(F.concat(all_(FUNCTION_NAME), imports, names, stem), lambda x: x != "")
    return F.slice(F.sort_array(F.array_distinct(F.transform(found, F.lower))), 1, most)


def entity_index(chunks: DataFrame) -> DataFrame:
    """``(id, buffer, entity)`` of ``(id, buffer, path, text)``."""
    return chunks.select("id", "buffer", F.explode_outer(entities(F.col("text"), F.col("path"))).alias("entity")).where("entity is not null")


def _phrase(name: Column) -> Column:
    """The words of a name as one phrase: letters and digits, lower case, other signs part them."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def _tails(names: Column) -> Column:
    """What stands in each of some names from each of its words on."""
    words = F.transform(names, lambda x: F.split(_phrase(x), " "))  # once per name
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.array_join(F.slice(w, i, F.size(w)), " "))))


def entity_phrases(index: DataFrame) -> DataFrame:
    """``(id, buffer, phrase)``: what stands in a name from each of its words on, so that a phrase within it is a prefix here."""
    return index.select("id", "buffer", F.explode_outer(F.array_distinct(_tails(F.array("entity")))).alias("phrase")).where("phrase <> ''").distinct()


def phrase_lists(named: DataFrame) -> DataFrame:
    """``(id, buffer, phrases)`` of ``(id, buffer, names)``: the same phrases in one row per item; nothing is shuffled."""
    phrases = F.array_distinct(F.filter(_tails(F.col("names")), lambda x: x != ""))
    return named.select("id", "buffer", phrases.alias("phrases"))


def wanted_phrases(queries: DataFrame) -> DataFrame:
    """``(query_id, wanted)``: the distinct phrases of ``(query_id, entity)``."""
    return queries.select("query_id", _phrase(F.col("entity")).alias("wanted")).where("wanted <> ''").distinct()


def entity_search(queries: DataFrame, index: DataFrame) -> DataFrame:
    """``(query_id, id, buffer, score)``: chunks by how many entities of a query they hold, ``(query_id, entity)`` given.

    A query entity is a phrase of words of which the last may go on; it matches anywhere in a name. Each chunk counts
    once per query entity. ``index`` holds ``phrase`` (of ``entity_phrases``), ``phrases`` (of ``phrase_lists``) or ``entity``.
    Phrases meet queries by equality of their beginnings of the lengths that queries have.
    """
    if "phrases" in index.columns:
        index = index.select("id", "buffer", F.explode_outer("phrases").alias("phrase")).where("phrase is not null")
    phrases = index if "phrase" in index.columns else entity_phrases(index)
    q, _ = held(wanted_phrases(queries))
    lengths = sorted(r[0] for r in q.select(F.length("wanted")).distinct().collect())  # one row per length of a name
    if not lengths:
        return phrases.where("false").select(F.lit(None).cast(dict(queries.dtypes)["query_id"]).alias("query_id"), "id", "buffer", F.lit(0.0).alias("score"))
    starts = F.filter(F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.substring("phrase", F.lit(1), n)), lambda x: F.length(x) > 0)
    begun = phrases.select("id", "buffer", F.explode_outer(F.array_distinct(starts)).alias("wanted"))
    return begun.join(q, "wanted").groupBy("query_id", "id", "buffer").agg(F.count_distinct("wanted").cast("double").alias("score"))


# -- vectors ------------------------------------------------------------------------------------------------------------


#: Similarities worked on at once, and what rounding may move one by.
CELLS, CLOSE = 4_000_000, 1e-6


def _compared(asked: pa.Table, metric: str, same_buffer: bool, exclude_self: bool, k: int | None, least: float | None):
    """Scores of a block of queries against batches of items as matrix products; of each batch only what may be in a result goes on."""
    by_length: dict[int, np.ndarray] = {}

    def usable(column: pa.ChunkedArray | pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(np.asarray(pc.fill_null(pc.list_value_length(column), -1)) == n)
        flat = pc.list_flatten(column.take(pa.array(at))).cast(pa.float64())
        x = np.asarray(flat.fill_null(float("nan")), np.float64).reshape(len(at), n)
        good = np.isfinite(x).all(1)
        return at[good], x[good]

    ask = asked.combine_chunks()
    for n in set(pc.list_value_length(ask["vector"]).to_pylist()) - {None, 0}:
        by_length[n] = usable(ask["vector"], n)
    keys = pa.concat_arrays(ask["query_id"].chunks) if ask["query_id"].num_chunks else pa.array([], ask["query_id"].type)
    names, rooms = (np.asarray(ask[c].to_pylist(), object) for c in ("query_id", "buffer"))

    def score(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        g = q @ x.T
        if metric == "l2":
            d = np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * g, 0)
            return 1 / (1 + d)
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)
        return np.clip(np.divide(g, n, out=np.zeros_like(g), where=n > 0), -1, 1)

    def run(batches):
        for batch in batches:
            ids, buffers = (np.asarray(batch.column(i).to_pylist(), object) for i in (0, 1))
            for n, (which, q) in by_length.items():
                at, x = usable(batch.column(2), n)
                step = max(CELLS // max(len(q), 1), 1)
                for i in range(0, len(at), step):
                    rows = at[i : i + step]
                    v = score(q, x[i : i + step])
                    if same_buffer:
                        v[(rooms[which][:, None] != buffers[rows]) | np.equal(rooms[which], None)[:, None]] = -np.inf
                    if exclude_self:
                        v[names[which][:, None] == ids[rows]] = -np.inf
                    floor = np.full(len(v), -2.0 if least is None else least - CLOSE)
                    if k is not None and k < len(rows):
                        floor = np.maximum(floor, np.partition(v, len(rows) - k, axis=1)[:, len(rows) - k] - CLOSE)
                    r, c = np.nonzero(v >= floor[:, None])
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(which[r])), batch.column(0).take(pa.array(rows[c])), batch.column(1).take(pa.array(rows[c])), pa.array(v[r, c], pa.float64())],
                        ["query_id", "id", "buffer", "score"],
                    )

    return run


def _scored(queries: DataFrame, items: DataFrame, metric: str, same_buffer: bool, exclude_self: bool, k: int | None = None, least: float | None = None) -> list[DataFrame]:
    """``(query_id, id, buffer, score)`` of each block of queries, from one pass over the items per block."""
    types = dict(queries.dtypes) | {f"i_{n}": t for n, t in items.dtypes}
    schema = f"query_id {types['query_id']}, id {types['i_id']}, buffer {types['i_buffer']}, score double"
    i = spread(items.select("id", "buffer", "vector").where("id is not null and vector is not null"))
    out = []
    for block in query_blocks(queries.select("query_id", "buffer", "vector").where("query_id is not null and vector is not null")):
        asked = block.toArrow()  # a block is bounded
        out.append(i.mapInArrow(_compared(asked, metric, same_buffer, exclude_self, k, least), schema).withColumn("score", F.round("score", 6)))
    return out


def vector_search(queries: DataFrame, items: DataFrame, k: int, metric: str = "l2", same_buffer: bool = False, exclude_self: bool = True) -> DataFrame:
    """``(query_id, id, buffer, score, rank)``: exact nearest items of a stated set of query vectors.

    ``l2`` scores 1/(1+squared distance), ``cosine`` the cosine. Every item meets every query of the set as a matrix
    product, in one pass over the items per block of queries; lists are cut to k in each batch. Items of another length
    than the query, and vectors with null or infinite values or without any value, are left out.
    """
    return _united([top_k(x, k) for x in _scored(queries, items, metric, same_buffer, exclude_self, k=k)])


def within_radius(queries: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """``(query_id, id, similarity)`` of all items at least so similar, for a stated set of query vectors, block by block."""
    q, i = queries.withColumn("buffer", F.lit("")), items.withColumn("buffer", F.lit(""))
    return _united([x.where(F.col("score") >= least).select("query_id", "id", F.col("score").alias("similarity")) for x in _scored(q, i, "cosine", False, True, least=least)])


def centroids(items: DataFrame) -> DataFrame:
    """``(buffer, dim, value)``: the mean vector of every buffer, 0-based."""
    return items.select("buffer", F.posexplode("vector").alias("dim", "x")).groupBy("buffer", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("value"))


# -- fusion -------------------------------------------------------------------------------------------------------------


def rrf(lists: list[DataFrame], k: int = Search.rrf_k, by: list[str] = ("query_id",)) -> DataFrame:
    """``(*by, id, score)``: reciprocal rank fusion of ranked lists with a 0-based ``rank``."""
    one = [x.select(*by, "id", (1.0 / (k + F.col("rank") + 1)).alias("part")) for x in lists]
    both = one[0]
    for x in one[1:]:
        both = both.unionByName(x)
    return both.groupBy(*by, "id").agg(F.sum("part").alias("score"))


def normalized(ranked: DataFrame, by: list[str] = ("query_id",), score: str = "score") -> DataFrame:
    """Adds ``norm``: the score between the least and the greatest of its list."""
    w = W.partitionBy(*by)
    return ranked.withColumn("norm", scores.min_max(F.col(score), F.min(score).over(w), F.max(score).over(w)))


def decayed(ranked: DataFrame, ages: DataFrame, rate: float = Search.decay_rate, enabled: bool = True) -> DataFrame:
    """The list with scores decayed by the ``age_hours`` of each id; ids without an age keep their score."""
    r = ranked.join(ages.select("id", "age_hours"), "id", "left")
    return r.withColumn("score", scores.decay(F.col("score"), F.coalesce("age_hours", F.lit(0.0)), rate, enabled)).drop("age_hours")


def _cut(hits: DataFrame, k: int, by: list[str] = ("query_id",)) -> DataFrame:
    """The k best of every list, by its ranks if it has them."""
    return hits.where(F.col("rank") < k) if "rank" in hits.columns else top_k(hits, k, by)


def hybrid(lexical: DataFrame, entity: DataFrame | None, vector: DataFrame | None, k: int = Search.top_k) -> DataFrame:
    """``(query_id, id, score, rank)``: the fusion of the ranked lists of the tiers that are there.

    Lists are cut to k times the over-fetch, the vector list to twice that; the fused list is cut to k. Lists may be ranked already.
    """
    most = k * Search.over_fetch
    lists = [_cut(lexical if "rank" in lexical.columns else lexical.withColumn("score", F.round("score", 6)), most)]
    if entity is not None:
        lists.append(_cut(entity, most))
    if vector is not None:
        lists.append(_cut(vector, 2 * most))
    return top_k(rrf(lists).withColumn("score", F.round("score", 9)), k)


def across_buffers(ranked: DataFrame, k: int = Search.top_k) -> DataFrame:
    """Fusion of the lists of several buffers: ranks are taken within each buffer, if they are not given."""
    per = _cut(ranked, k * Search.over_fetch, ["query_id", "buffer"])
    return top_k(rrf([per]).withColumn("score", F.round("score", 9)), k)
