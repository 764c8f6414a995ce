"""Fitting results into token budgets and rendering them.

Results are ``(query_id, rank, id, path, text, score)``. Lists are as long as a search returns them (a top-k), so a
list is one group. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kbspark.functions import text as T

#: A result that does not fit is cut if more than so many tokens are left.
CUT_LEAST = 100


def tokens(text: Column) -> Column:
    """What a text takes of a budget."""
    return T.tokens_by_words(F.coalesce(text, F.lit("")))


def fitted(sizes: DataFrame, most: int) -> DataFrame:
    """Which results fit, by their ``tokens``; texts are not needed. Adds ``was_cut`` and what was ``left`` for each.

    Results are taken while they fit; the first that does not is cut to what is left, if that is worth it; then no more.
    """
    w = W.partitionBy("query_id").orderBy("rank")
    r = sizes.withColumn("before", F.coalesce(F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    fits, left = F.col("before") + F.col("tokens") <= most, F.lit(most) - F.col("before")
    r = r.withColumns({"was_cut": ~fits, "left": left})
    return r.where(fits | ((F.col("before") < most) & (left > CUT_LEAST))).drop("before")


def kept(text: Column, was_cut: Column, left: Column) -> Column:
    """What is kept of the text of a result that is ``fitted``."""
    words = F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda x: x != "")
    return F.when(~was_cut, text).otherwise(F.array_join(F.slice(words, 1, F.floor(F.greatest(left, F.lit(0)) / 1.3).cast("int")), " "))


def budget_with_cut(results: DataFrame, most: int) -> DataFrame:
    """Results that are ``fitted``, with what is ``kept`` of each."""
    r = fitted(results.withColumn("tokens", tokens(F.col("text"))), most)
    return r.withColumn("kept", kept(F.col("text"), F.col("was_cut"), F.col("left"))).drop("left")


def budget_with_skip(results: DataFrame, most: int) -> DataFrame:
    """Results in order, each that does not fit left out while later smaller ones may still be taken; bytes over four."""
    r = results.withColumn("tokens", T.tokens_by_bytes_floor(F.coalesce("text", F.lit(""))))
    one = F.struct("rank", "id", "tokens")
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))

    def step(acc, x):
        fits = acc["used"] + x["tokens"] <= most
        return F.struct(F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.array_append(acc["ids"], x["id"].cast("long"))).otherwise(acc["ids"]).alias("ids"))

    lists = r.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("xs"))
    return lists.select("query_id", F.aggregate("xs", zero, step).alias("a")).select("query_id", F.posexplode("a.ids").alias("pos", "id"), F.col("a.used").alias("used"))


def rendered(results: DataFrame, form: str = "prompt") -> DataFrame:
    """``(query_id, context)``: the results of a query as prompt, markdown or JSON text."""
    score = F.format_string("%.2f", F.col("score"))
    body = F.coalesce("text", F.lit(""))
    if form == "json":
        item = F.to_json(F.struct("id", "path", score.alias("score"), body.alias("text")))
    elif form == "markdown":
        item = F.concat(F.lit("### "), F.col("path"), F.lit(" ("), score, F.lit(")\n\n```\n"), body, F.lit("\n```"))
    else:
        item = F.concat(F.lit("["), (F.col("rank") + 1).cast("string"), F.lit("] "), F.col("path"), F.lit(" score "), score, F.lit("\n"), body)
    parts = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", item.alias("item")))).alias("xs"))
    text = F.array_join(F.transform("xs", lambda x: x["item"]), "," if form == "json" else "\n\n")
    return parts.select("query_id", (F.concat(F.lit("["), text, F.lit("]")) if form == "json" else text).alias("context"))


def as_of(results: DataFrame, revisions: DataFrame, epoch: int) -> DataFrame:
    """Results with the text each had at an epoch, by key; the score of the live one stays, results without one then are left out."""
    w = W.partitionBy("key").orderBy(F.col("epoch").desc(), F.col("id").desc())
    then = revisions.where(F.col("epoch") <= epoch).withColumn("_rk", F.row_number().over(w)).where("_rk = 1").select("key", F.col("text").alias("text"))
    return results.drop("text").join(then, "key")
