"""Quality of ranked lists against graded relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """``(query_id, recall, ndcg, rr)`` at k from lists ``(query_id, id, rank)`` (0-based) and ``(query_id, id, gain)``.

    Gains count as 2^gain - 1 over log2(rank + 2). Queries with nothing relevant have 0 everywhere; those without a list too.
    """
    from pyspark.sql.window import Window as W

    rel = relevant.where("gain > 0")
    hits = ranked.where(F.col("rank") < k).join(rel, ["query_id", "id"])

    def dcg(rank):
        return (F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(rank + 2.0)

    got = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(dcg(F.col("rank"))).alias("dcg"), F.min("rank").alias("first"))
    w = W.partitionBy("query_id").orderBy(F.col("gain").desc(), "id")
    ideal = rel.withColumn("r", F.row_number().over(w) - 1).where(F.col("r") < k).groupBy("query_id").agg(F.sum(dcg(F.col("r"))).alias("ideal"))
    total = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    all_ = ranked.select("query_id").union(relevant.select("query_id")).distinct()
    j = all_.join(total, "query_id", "left").join(ideal, "query_id", "left").join(got, "query_id", "left")
    return j.select(
        "query_id",
        F.round(F.coalesce(F.try_divide(F.col("n").cast("double"), "total"), F.lit(0.0)), 6).alias("recall"),
        F.round(F.coalesce(F.try_divide(F.col("dcg"), "ideal"), F.lit(0.0)), 6).alias("ndcg"),
        F.round(F.coalesce(1.0 / (F.col("first") + 1), F.lit(0.0)), 6).alias("rr"),
    )


def compare(per_query: dict[str, DataFrame]) -> DataFrame:
    """Means of the metrics of several systems: ``(system, recall, ndcg, mrr)``."""
    out = None
    for name, m in per_query.items():
        one = m.agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("rr"), 6).alias("mrr")).select(F.lit(name).alias("system"), "*")
        out = one if out is None else out.unionByName(one)
    return out
