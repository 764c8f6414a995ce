"""Keeping the store: duplicates, decay, retention, transfer, reports. Every "now" is a parameter.

Null times never expire; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def duplicates(rows: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """``id`` of all but the newest (greatest id) row of each key.

    The newest id per key is combined before the shuffle and joined back, so a key may hold a third of all rows.
    """
    newest = rows.groupBy(*keys).agg(F.max(id_col).alias("_newest"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return rows.join(newest, keys).where(F.col(id_col) < F.col("_newest")).select(id_col)


def decayed_away(rows: DataFrame, age_hours: Column, rate: float, floor: float) -> DataFrame:
    """Rows whose last use has decayed below the floor."""
    return rows.where(F.exp(-F.lit(rate) * F.greatest(age_hours, F.lit(0.0))) < floor)


def outdated(rows: DataFrame, at: str, now: str, days: int) -> DataFrame:
    """Rows older than so many days."""
    return rows.where(F.col(at) < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def recent(rows: DataFrame, at: str, id_col: str, k: int, user: str | None = None, user_col: str = "user_id") -> DataFrame:
    """The k newest rows, of one user or of all."""
    r = rows if user is None else rows.where(F.col(user_col) == user)
    return r.orderBy(F.col(at).desc(), F.col(id_col).desc()).limit(k)


def newest_per(rows: DataFrame, key: str, at: str, id_col: str, k: int) -> DataFrame:
    """The k newest rows of every key."""
    w = W.partitionBy(key).orderBy(F.col(at).desc(), F.col(id_col).desc())
    return rows.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k).drop("_rk")


def where_given(rows: DataFrame, **equal) -> DataFrame:
    """Rows equal in every given column; None is not asked for."""
    for c, v in equal.items():
        if v is not None:
            rows = rows.where(F.col(c) == v)
    return rows


def transfer(rows: DataFrame, target, languages: list[str], most: int, buffer_col: str = "buffer", id_col: str = "id") -> DataFrame:
    """The first ``most`` rows of some languages, moved to another buffer."""
    r = rows.where(F.col("language").isin(languages)) if languages else rows
    return r.orderBy(id_col).limit(most).withColumn(buffer_col, F.lit(target))


def common_names(a: DataFrame, b: DataFrame, name: str = "name") -> DataFrame:
    """Rows of a whose name b has too."""
    return a.join(b.select(name).distinct(), name, "left_semi")


def integrity(df: DataFrame, id_col: str) -> DataFrame:
    """``(rows, ids, nulls)``: rows, distinct ids and rows without an id."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(id_col).alias("ids"), F.count_if(F.col(id_col).isNull()).alias("nulls"))
