"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it has more than one of so many parts of all rows; so fewer than this many keys can be heavy.
HEAVY_PARTS = 512
#: Rows of the other side that may be broadcast for the heavy keys; above it they are salted instead.
BROADCAST_ROWS = 100_000
#: Salts per heavy key when its other side is too large to broadcast.
SALTS = 64


def heavy_keys(df: DataFrame, keys: Sequence[str], parts: int = HEAVY_PARTS, weight: str | None = None) -> DataFrame:
    """Keys that hold more than ``1/parts`` of the rows of ``df`` (of the sum of ``weight``): fewer than ``parts`` rows, whatever the input.

    Counts are combined before the shuffle; keys with a null part never match a join and are left out.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.dropna(subset=list(keys)).groupBy(*keys).agg(n.alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    return counts.join(F.broadcast(total), F.col("_n") * parts > F.col("_total")).select(*keys)


def anti_join_skewed(left: DataFrame, right: DataFrame, keys: Sequence[str], condition, heavy: DataFrame) -> DataFrame:
    """Rows of ``left`` without a row of ``right`` equal in ``keys`` for which ``condition(l, r)`` holds.

    ``left`` may hold a third of its rows in one key. Rows of the heavy keys are tested against the broadcast rows of
    ``right`` for these keys (fewer than BROADCAST_ROWS, which is counted first; otherwise both sides are salted, the
    right one replicated per salt). All other rows take a shuffled anti-join, balanced because no key is heavy.
    Null keys never match, so such left rows come out. Column names of both sides but the keys must differ.
    """
    keys = list(keys)
    heavy = heavy.select(*keys)
    few = heavy.sparkSession.createDataFrame(heavy.collect(), heavy.schema)  # fewer than HEAVY_PARTS rows
    hit = [F.col(f"l.{k}") == F.col(f"h.{k}") for k in keys]
    l, h = left.alias("l"), F.broadcast(few.alias("h"))
    rest, hot = l.join(h, hit, "left_anti"), l.join(h, hit, "left_semi")
    right_hot = right.alias("l").join(h, hit, "left_semi")

    def anti(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        x, y = a.alias("a"), b.alias("b")
        test = condition(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"))
        for k in on:
            test = test & (F.col(f"a.{k}") == F.col(f"b.{k}"))
        return x.join(y, test, "left_anti")

    out = anti(rest, right, keys)
    if few.isEmpty():
        return out
    if right_hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return out.unionByName(anti(hot, F.broadcast(right_hot), keys))
    salted = hot.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(SALTS)).cast("int"))
    copies = right_hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return out.unionByName(anti(salted, copies, [*keys, "_salt"]).drop("_salt"))


def join_skewed(left: DataFrame, right: DataFrame, keys: Sequence[str], parts: int = HEAVY_PARTS) -> DataFrame:
    """Inner join of ``left``, which may hold a third of its rows in one key, with ``right``.

    Rows of the heavy keys meet the broadcast rows of ``right`` for them (fewer than BROADCAST_ROWS, counted first) or
    are salted against copies of these; the rest is shuffled. ``left`` is read again for the counts, so it should be
    cheap or cut from its lineage. Column names of both sides but the keys must differ.
    """
    keys = list(keys)
    heavy = heavy_keys(left, keys, parts)
    few = heavy.sparkSession.createDataFrame(heavy.collect(), heavy.schema)  # fewer than HEAVY_PARTS rows
    if few.isEmpty():
        return left.join(right, keys)
    h = F.broadcast(few)
    rest = left.join(h, keys, "left_anti").join(right, keys)
    hot, right_hot = left.join(h, keys, "left_semi"), right.join(h, keys, "left_semi")
    if right_hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rest.unionByName(hot.join(F.broadcast(right_hot), keys))
    salted = hot.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(SALTS)).cast("int"))
    copies = right_hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rest.unionByName(salted.join(copies, [*keys, "_salt"]).drop("_salt"))
