"""Revisions of keyed records: snapshots, differences, version chains, reads as of a point.

Nothing is updated in place: records are appended and views are derived. Null keys are equal to each other; rows
repeated with one id are the same revision; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in an order; the limit is applied before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk")


def as_of(df: DataFrame, keys: list[str], at: str, point, id_col: str = "id") -> DataFrame:
    """The revision of every key with the greatest ``at`` not above ``point``, then the greatest id."""
    return latest(df.where(F.col(at) <= point), keys, [F.col(at).desc(), F.col(id_col).desc()])


def snapshot(df: DataFrame, keys: list[str], at: str, gone: str, point, id_col: str = "id") -> DataFrame:
    """The revisions that were current at a point: the latest per key, unless gone by then."""
    return as_of(df, keys, at, point, id_col).where(F.col(gone).isNull() | (F.col(gone) > point))


def difference(old: DataFrame, new: DataFrame, keys: list[str], content: str) -> DataFrame:
    """``(*keys, status, old, new)`` by one full outer join: same, changed, new or orphan."""
    o = old.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col(content).alias("old"), F.lit(1).alias("_o"))
    n = new.select(*keys, F.col(content).alias("new"), F.lit(1).alias("_n"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"o_{k}").eqNullSafe(F.col(k))
    j = n.join(o, on, "full")
    status = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "orphan").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return j.select(*[F.when(F.col("_n").isNull(), F.col(f"o_{k}")).otherwise(F.col(k)).alias(k) for k in keys], status.alias("status"), "old", "new")


def orphans(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti")


def chains(df: DataFrame, keys: list[str], order: list[str], id_col: str = "id") -> DataFrame:
    """Adds ``version, superseded_by, is_active``: every insert closes the revision before it."""
    w = W.partitionBy(*keys).orderBy(*order, id_col)
    nxt = F.lead(id_col).over(w)
    return df.withColumns({"version": F.row_number().over(w).cast("long"), "superseded_by": nxt, "is_active": nxt.isNull()})


def changes(df: DataFrame, keys: list[str], order: list[str], content: str) -> DataFrame:
    """Adds ``change``: new, changed or same against the revision before."""
    before = F.lag(content).over(W.partitionBy(*keys).orderBy(*order))
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1
    return df.withColumn("change", F.when(first, "new").when(before.eqNullSafe(F.col(content)), "same").otherwise("changed"))


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with those rows whose key it does not hold; of several new rows with one key one is taken."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def upsert_counter(table: DataFrame, hits: DataFrame, keys: list[str], counter: str) -> DataFrame:
    """The table with every hit added to the counter of its key; unknown keys begin at the number of hits."""
    both = table.select(*keys, counter).unionByName(hits.groupBy(*keys).agg(F.count(F.lit(1)).alias(counter)))
    return both.groupBy(*keys).agg(F.sum(counter).alias(counter))
