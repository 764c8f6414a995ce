"""Answering new vectors with the neighbour graph: greedy search for a stated set of queries.

Neighbourhoods of a graph of nearest neighbours are often not linked with each other, so every query starts from many
nodes of the leaves it falls into, and links are followed both ways. It keeps a beam of the most similar nodes seen. Each
step expands the best nodes of the beam that were not expanded yet: their neighbours are joined by id, those not seen
before get their vectors and similarities, and the beam is cut again. A query is done when its beam holds nothing to
expand. Vectors of nodes stay where they are; only ids and the vectors of the queries, whose number is counted first,
travel.

Defined results: queries without a usable vector have no answer; a query never finds itself by id; equal similarities
go to the smaller id; an empty graph or query set gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kbspark.llm.neighbours import DIM, K, Trees, _matrix, _unit, live_groups, neighbour_graph, spread_groups
from kbspark.plans.lineage import cut_lineage

BEAM, WIDTH, STARTS = 64, 12, 64
#: Queries that are broadcast; more take a shuffled join.
FEW = 20_000


def _leaves_of(trees: Trees, dim: int):
    def run(batches):
        for pdf in batches:
            leaf = trees.assign(_unit(_matrix(pdf.vec, dim)))
            n = leaf.shape[1]
            yield pd.DataFrame({"id": np.repeat(pdf.id.to_numpy(), n), "leaf": leaf.ravel()})

    return run


def _similarity(dim: int):
    def run(q: pd.Series, v: pd.Series) -> pd.Series:
        a, b = _matrix(q, dim).astype(np.float64), _matrix(v, dim).astype(np.float64)
        a, b = a / np.abs(a).max(1, keepdims=True, initial=0), b / np.abs(b).max(1, keepdims=True, initial=0)
        return pd.Series(np.round(np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b)), 6))

    return run


def graph_search(queries: DataFrame, graph: DataFrame, placed: DataFrame, trees: Trees, k: int = K, dim: int = DIM, beam: int = BEAM, width: int = WIDTH, starts: int = STARTS) -> DataFrame:
    """``(query_id, rank, id, similarity)`` for ``(query_id, vec)``, from a graph ``(id, nbr)`` and its vectors ``(id, vec)``."""
    q = cut_lineage(queries.select("query_id", F.col("vec").alias("qvec")))
    mark = F.broadcast if q.limit(FEW + 1).count() <= FEW else (lambda x: x)
    similarity = F.pandas_udf(_similarity(dim), "double")
    in_leaf = placed.select("id", "vec").mapInPandas(_leaves_of(trees, dim), "id long, leaf long")
    w = W.partitionBy("leaf").orderBy(F.xxhash64("id"))
    entries = in_leaf.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= starts).select("id", "leaf")
    asked = q.select(F.col("query_id").alias("id"), F.col("qvec").alias("vec")).mapInPandas(_leaves_of(trees, dim), "id long, leaf long").select(F.col("id").alias("query_id"), "leaf")
    new = cut_lineage(asked.join(entries, "leaf").select("query_id", "id").where("query_id <> id").distinct())
    out = graph.select("id", F.explode("nbr.id").alias("other"))
    links = cut_lineage(out.unionByName(out.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct())
    seen = new
    state = q.select("query_id").limit(0).selectExpr("query_id", "query_id as id", "0.0D as sim", "true as done")
    best = W.partitionBy("query_id").orderBy(F.col("sim").desc(), "id")
    while True:  # every step expands nodes that were not expanded before, or is the last
        scored = new.join(placed.select("id", "vec"), "id").join(mark(q), "query_id").select("query_id", "id", similarity("qvec", "vec").alias("sim"), F.lit(False).alias("done"))
        top = state.unionByName(scored).withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= beam)
        turn = F.sum((~F.col("done")).cast("int")).over(best.rowsBetween(W.unboundedPreceding, 0))
        top = cut_lineage(top.withColumn("go", ~F.col("done") & (turn <= width)).drop("rk"))
        state = top.select("query_id", "id", "sim", (F.col("done") | F.col("go")).alias("done"))
        reached = top.where("go").select("query_id", "id").join(links, "id").select("query_id", F.col("other").alias("id")).where("query_id <> id").distinct()
        new = cut_lineage(reached.join(seen, ["query_id", "id"], "left_anti"))
        if new.isEmpty() and top.where("go").isEmpty():
            break
        seen = cut_lineage(seen.unionByName(new))
    out = state.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "id", F.col("sim").alias("similarity"))


def search_rows(cache: DataFrame, asked: str, k: int = K, dim: int = DIM, **how) -> DataFrame:
    """``(query_id, rank, id, similarity)`` for every live row for which ``asked`` holds, over all live rows.

    Each direction is searched once; the rows of one direction are joined back into queries and answers.
    """
    live, groups, vectors = live_groups(cache, k, dim)
    graph, placed, trees = neighbour_graph(vectors, dim, **how)
    wanted = live.where(asked)
    reps = groups.join(wanted.select("sig").distinct(), "sig", "left_semi").select(F.col("rep").alias("id"))
    found = graph_search(vectors.join(reps, "id", "left_semi").select(F.col("id").alias("query_id"), "vec"), graph, placed, trees, k, dim)
    near = found.select(F.col("query_id").alias("rep"), (-F.col("similarity")).alias("neg"), F.col("id").alias("other"))
    out = spread_groups(near, wanted, groups, k)
    return out.select(F.col("id").alias("query_id"), "rank", F.col("other").alias("id"), "similarity")
