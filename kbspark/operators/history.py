"""Problem 6: the history of changing entities as checkpoints and deltas.

``versions`` reduces sightings to one row per entity and version (combined before the shuffle), ``store`` writes a full
copy of the attributes for the first version in every block of version numbers and, for all others, only the attributes
that changed and the distance in epochs, and ``validity`` folds the patches forward from the nearest full copy. Blocks
keep the work of one entity with very many versions in many groups.

Defined results: sightings without entity, version or epoch give no version; a version seen several times is valid from
its smallest epoch, with the attributes seen then (of several, the least in the order given); equal rows are one;
``valid_to`` is the start of the next higher version seen even if that start is earlier, and -1 where there is none; an
empty input gives an empty history. Further columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kbspark.plans.lineage import cut_lineage

#: Version numbers per block; each block begins with a full copy.
BLOCK = 16


def versions(sightings: DataFrame, attributes: list[str], order: list[str] = ()) -> DataFrame:
    """``(source_table, entity_key, version, valid_from, attrs)`` from rows with those keys, ``epoch`` and the attributes."""
    keys = ["source_table", "entity_key", "version"]
    rows = sightings.where("entity_key is not null and version is not null and epoch is not null")
    first = F.min(F.struct(F.col("epoch"), *[F.col(c) for c in order], *[F.col(a).cast("string").alias(f"a_{i}") for i, a in enumerate(attributes)])).alias("f")
    names = F.array(*[F.lit(a) for a in attributes]).cast("array<string>")
    values = F.array(*[F.col(f"f.a_{i}") for i in range(len(attributes))]).cast("array<string>")
    return rows.groupBy(*keys).agg(first).select(*keys, F.col("f.epoch").alias("valid_from"), F.map_from_arrays(names, values).alias("attrs"))


def store(versions: DataFrame, block: int = BLOCK) -> DataFrame:
    """The stored form ``(source_table, entity_key, block, version, is_full, epoch, attrs)``, written to shared storage.

    ``epoch`` is the start itself in a full row and the distance to the version before otherwise; ``attrs`` holds all
    attributes or only the changed ones (a null value: the attribute became null).
    """
    v = versions.withColumn("block", F.floor(F.col("version") / F.lit(block)).cast("long"))
    w = W.partitionBy("source_table", "entity_key", "block").orderBy("version")
    v = v.withColumns({"_from": F.lag("valid_from").over(w), "_attrs": F.lag("attrs").over(w)})
    changed = F.map_filter("attrs", lambda k, x: ~x.eqNullSafe(F.col("_attrs")[k]))
    full = F.col("_from").isNull()
    return cut_lineage(
        v.select(
            "source_table", "entity_key", "block", "version", full.alias("is_full"),
            F.when(full, F.col("valid_from")).otherwise(F.col("valid_from") - F.col("_from")).alias("epoch"),
            F.when(full, F.col("attrs")).otherwise(changed).alias("attrs"),
        )
    )


def validity(stored: DataFrame, attributes: list[str] = ()) -> DataFrame:
    """``(source_table, entity_key, version, valid_from, valid_to, *attributes)`` by folding patches forward.

    The start of the next block is looked up among the full rows only, of which there is one per block.
    """
    by = ["source_table", "entity_key", "block"]
    w = W.partitionBy(*by).orderBy("version")
    run = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    fold = {f"_a_{i}": F.last(F.when(F.map_contains_key("attrs", F.lit(a)), F.struct(F.col("attrs")[a].alias("v"))), ignorenulls=True).over(run) for i, a in enumerate(attributes)}
    rows = stored.withColumns({"valid_from": F.sum("epoch").over(run), **fold})
    rows = rows.withColumn("_next", F.lead("valid_from").over(w))
    fulls = stored.where("is_full").select(*by, F.lead("epoch").over(W.partitionBy(*by[:2]).orderBy("block")).alias("_next_block")).where("_next_block is not null")
    out = rows.join(fulls, by, "left")
    return out.select(
        *by[:2], "version", "valid_from", F.coalesce("_next", "_next_block", F.lit(-1)).cast("long").alias("valid_to"), *[F.col(f"_a_{i}.v").alias(a) for i, a in enumerate(attributes)]
    )


def chain_members(links: DataFrame) -> DataFrame:
    """``(id, entity_key)``: the smallest id of all rows joined, directly or not, by ``superseded_by`` to rows that exist.

    Every row has one link at most, so following the links by doubling their length reaches the end of each chain in
    as many rounds as the logarithm of the longest one; chains that end in a circle are named by its smallest member.
    A row that many others point to is a skewed join key, which adaptive execution splits. Rows with a null id are left
    out; if an id is repeated its smallest valid link counts.
    """
    rows = links.select("id", F.col("superseded_by").alias("to")).where("id is not null")
    ids, pairs = rows.select("id").distinct(), rows.where("to <> id").distinct()
    real = pairs.join(ids.select(F.col("id").alias("to")), "to", "left_semi")
    real = cut_lineage(real.groupBy("id").agg(F.min("to").alias("to"), F.count(F.lit(1)).alias("n")).select("id", "to"))
    ends = real.select(F.col("to").alias("id")).distinct().join(real, "id", "left_anti")
    state = real.select("id", "to", F.least("id", "to").alias("low"), F.lit(False).alias("done"))
    state = cut_lineage(state.unionByName(ends.select("id", F.col("id").alias("to"), F.col("id").alias("low"), F.lit(True).alias("done"))))
    open_ = state.where(~F.col("done")).count()
    length = 1
    while open_:
        nxt = state.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"), F.col("done").alias("_done"))
        moved = state.where(~F.col("done")).join(nxt, "to")
        moved = moved.select("id", F.col("_to").alias("to"), F.least("low", "_low").alias("low"), F.col("_done").alias("done"))
        state = cut_lineage(state.where("done").unionByName(moved))
        left, length = state.where(~F.col("done")).count(), length * 2
        if left == open_ and length >= left:
            break  # only circles are left, and each walk has gone round its circle
        open_ = left
    circle = state.where(~F.col("done"))
    at = circle.join(circle.select(F.col("id").alias("to"), F.col("low").alias("_root")), "to").select("id", "low", F.col("_root").alias("root"))
    named = state.where("done").select("id", "low", F.col("to").alias("root")).unionByName(at)
    low = named.groupBy("root").agg(F.min("low").alias("entity_key"))
    linked = named.join(low, "root").select("id", "entity_key")
    alone = ids.join(linked, "id", "left_anti").select("id", F.col("id").alias("entity_key"))
    return linked.unionByName(alone)


CHUNK_ATTRIBUTES = ["text", "file_path", "start_line", "end_line", "created_by", "model"]
EXPLORATION_ATTRIBUTES = ["goal", "summary", "status", "created_by", "model"]
ATTRIBUTES = [*CHUNK_ATTRIBUTES, "goal", "summary", "status"]


def _of(df: DataFrame, attributes: list[str]) -> list[str]:
    return [a for a in attributes if a in df.columns]


def chunk_sightings(search_result: DataFrame, attributes: list[str] = CHUNK_ATTRIBUTES) -> DataFrame:
    """Rows of search_result as sightings of their chunk."""
    return search_result.select(F.lit("search_result").alias("source_table"), F.col("chunk_id").cast("long").alias("entity_key"), F.col("version").cast("long"), F.col("epoch").cast("long"), F.col("returned_at").alias("seen_at"), *_of(search_result, attributes))


def exploration_sightings(explorations: DataFrame, attributes: list[str] = EXPLORATION_ATTRIBUTES) -> DataFrame:
    """Rows of explorations as sightings of the chain of revisions they belong to."""
    kept = _of(explorations, attributes)
    e = explorations.select("id", "superseded_by", F.col("version").cast("long"), F.col("epoch").cast("long"), F.col("created_at").alias("seen_at"), *kept)
    members = chain_members(e)
    return e.join(members, "id").select(F.lit("explorations").alias("source_table"), "entity_key", "version", "epoch", "seen_at", *kept)


def history(search_result: DataFrame, explorations: DataFrame, block: int = BLOCK, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """The stored history of chunks and explorations with the attributes asked for."""
    parts = [chunk_sightings(search_result, [a for a in attributes if a in CHUNK_ATTRIBUTES]), exploration_sightings(explorations, [a for a in attributes if a in EXPLORATION_ATTRIBUTES])]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return store(versions(both, attributes, ["seen_at"] if attributes else []), block)
