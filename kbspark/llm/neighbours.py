"""Problem 1: the most similar vectors of every vector, by NN-descent.

A neighbour graph starts from the leaves of a few random-projection trees and is improved round by round. In a round the
nearest neighbours of every node, and the nodes that have it among their nearest, are joined by id and compared with each
other. The nodes of one small leaf of another tree do this together: their neighbourhoods overlap, so a vector comes to
few places, and what meets there is compared as one matrix product. Only new, better neighbours leave such a block.
After the first round only nodes with a new entry, or in one, bring their neighbours together. Rounds go on until few
lists change. New vectors are answered by greedy search in the finished graph (``graph_search``).

Scale: a vector meets some 1,500 others a round whatever the number of rows, and moves to some seven blocks; no step
compares all with all. Nodes that very many others point to would make a block large, so the pointing nodes are dealt
into chunks of bounded size, each of which meets the whole core of the block. Exact copies of a direction (a third of
all rows, say) are one node; their members are spread out again at the end, eleven per group, which is all that any
list of ten can hold. The trees are built from a bounded sample; leaves that are still too large are cut again and
again, each tree along projections of its own, and at last by a hash where projections cannot part them, so leaves are
bounded whatever the number of rows.

Defined results: a row is usable if its embedding has exactly ``dim`` values, all finite, not all zero; of the usable
rows with one hash the latest ``cached_at`` is live (null counts as earliest; equal times: the larger id), rows with a
null hash are live each by itself; rows with a null id are left out, and rows repeated with one id count once.
Similarity is the cosine in double precision, rounded to six decimals; among equal ones the smaller id comes first.
Fewer than k other rows give shorter lists; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kbspark.plans.lineage import cut_lineage
from kbspark.plans.skew import join_skewed

DIM, K = 384, 10
#: List length while the graph is built; the reserve helps the search, ties are cut by id.
LIST = 14
#: Single-precision cosines closer than this may be equal once rounded.
CLOSE = np.float32(1e-5)
TREES, LEAF, SAMPLE = 3, 500, 20_000
#: Leaves in which the rounds take place.
BLOCK = 40
#: Neighbours of a node, and of those that name it, that meet in a round.
NEAREST = 8
#: A leaf above this many times its intended size is cut again; nodes of a block beyond its core come in chunks of this size.
LEAF_MOST, CHUNK = 2, 250
STOP_SHARE = 0.002
#: Projections of each tree for further cuts, and the parts each makes of a leaf at most.
CUTS, PARTS = 16, 4
#: Leaves to be cut that are broadcast.
BIG_LEAVES = 100_000
_ROWS, _TILE = 512, 1024
#: Where a list of neighbours is not full.
NO_ID = -(1 << 63)


# -- vectors ------------------------------------------------------------------------------------------------------------


def _usable(dim: int):
    def run(batches):
        for b in batches:
            col = b.column(3).cast(pa.list_(pa.float32()))
            n = np.asarray(col.value_lengths().fill_null(-1))
            keep = np.flatnonzero(n == dim)
            flat = col.take(pa.array(keep)).flatten()
            holes = np.asarray(flat.is_null()).reshape(-1, dim).any(1) if flat.null_count else np.zeros(len(keep), bool)
            x = np.asarray(flat.fill_null(0) if flat.null_count else flat, dtype=np.float32).reshape(-1, dim)
            good = np.isfinite(x).all(1) & (x != 0).any(1) & ~holes
            keep, x = keep[good], x[good]
            x64 = x.astype(np.float64)
            with np.errstate(all="ignore"):
                unit = x64 / np.abs(x64).max(1, keepdims=True, initial=0)
                unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32) + np.float32(0)
            sig = [xxhash.xxh128_hexdigest(u.tobytes()) for u in unit]
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(sig, pa.string()), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "hash", "cached_at", "sig", "vec"])

    return run


def usable_vectors(cache: DataFrame, dim: int = DIM) -> DataFrame:
    """``(id, hash, cached_at, sig, vec)`` of the usable rows; ``sig`` is equal for equal directions, ``vec`` holds float32 bytes."""
    rows = cache.select(F.col("cache_id").cast("long").alias("id"), "hash", F.col("cached_at").cast("timestamp"), "embedding").where("id is not null and embedding is not null").where(F.size("embedding") == dim)
    return rows.mapInArrow(_usable(dim), "id long, hash string, cached_at timestamp, sig string, vec binary")


def live_ids(usable: DataFrame) -> DataFrame:
    """``(id, sig)`` of the latest usable row of each hash; combined before the shuffle, so that one hash may hold very many rows."""
    light = usable.select("id", "hash", "cached_at", "sig")
    named = light.where("hash is not null").groupBy("hash").agg(F.max(F.struct(F.col("cached_at"), F.col("id"), F.col("sig"))).alias("r")).select("r.id", "r.sig")
    return named.unionByName(light.where("hash is null").select("id", "sig")).groupBy("id").agg(F.min("sig").alias("sig"))


def _matrix(values, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float32).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True, initial=0)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _exact(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the pairs of rows (a, b) in double precision, rounded."""
    out = np.empty(len(a))
    scale = np.abs(x).max(1, initial=0).astype(np.float64)
    for i in range(0, len(a), 8192):
        p, q = a[i : i + 8192], b[i : i + 8192]
        u, v = x[p] / scale[p, None], x[q] / scale[q, None]
        out[i : i + 8192] = np.einsum("ij,ij->i", u, v) / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", v, v))
    return np.round(out, 6)


# -- trees --------------------------------------------------------------------------------------------------------------


class Trees:
    """Random-projection trees with median splits of a sample: ``plane[node]``, ``cut[node]``, children (negative: leaf)."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, seed: int = 7):
        self.roots, self.plane, self.cut, self.child, self.leaves = [], [], [], [], 0
        rng = np.random.default_rng(seed)
        least = max(leaf * len(sample) / max(rows, 1), 8)
        for _ in range(trees):
            self.roots.append(self._grow(sample, np.arange(len(sample)), least, rng))
        dim = sample.shape[1]
        self.plane = np.array(self.plane, np.float32).reshape(-1, dim)
        self.cut, self.child = np.array(self.cut, np.float32), np.array(self.child, np.int64).reshape(-1, 2)
        self.further = rng.normal(size=(dim, trees * CUTS)).astype(np.float32)  # projections for further cuts

    def _grow(self, u, ids, least, rng) -> int:
        if len(ids) > least:
            for _ in range(3):
                a, b = u[rng.choice(ids, 2, replace=False)]
                w = a - b
                p = u[ids] @ w
                t = np.median(p)
                left = p < t
                if left.any() and not left.all():
                    node = len(self.plane)
                    self.plane.append(w)
                    self.cut.append(t)
                    self.child.append([0, 0])
                    self.child[node] = [self._grow(u, ids[left], least, rng), self._grow(u, ids[~left], least, rng)]
                    return node
        self.leaves += 1
        return -self.leaves

    def assign(self, u: np.ndarray) -> np.ndarray:
        """The leaf number of every vector in every tree."""
        out = np.empty((len(u), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(u), root, np.int64)
            while len(m := np.flatnonzero(at >= 0)):
                node = at[m]
                at[m] = self.child[node, (np.einsum("ij,ij->i", u[m], self.plane[node]) >= self.cut[node]).astype(np.int64)]
            out[:, t] = -at
        return out


def _assign(trees: Trees, dim: int):
    def run(batches):
        for pdf in batches:
            u = _unit(_matrix(pdf.vec, dim))
            leaf = trees.assign(u)
            n = leaf.shape[1]
            p = (u @ trees.further).reshape(len(u) * n, CUTS)
            yield pd.DataFrame({"id": np.repeat(pdf.id.to_numpy(), n), "tree": np.tile(np.arange(n), len(pdf)), "leaf": leaf.ravel(), "proj": list(p)})

    return run


def leaves(vectors: DataFrame, trees: Trees, dim: int = DIM, leaf: int = LEAF, most: float = LEAF_MOST) -> DataFrame:
    """``(id, tree, leaf)``, no leaf larger than ``most * leaf``.

    Larger ones are cut at the quantiles of one projection of their tree after the other, all at once, and at last by a
    hash of the id.
    """
    at = cut_lineage(vectors.select("id", "vec").mapInPandas(_assign(trees, dim), "id long, tree int, leaf long, proj array<float>"))
    for depth in range(CUTS + 1):
        big = at.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most * leaf)
        big = cut_lineage(big)
        if big.isEmpty():
            break
        mark = F.broadcast if big.limit(BIG_LEAVES + 1).count() <= BIG_LEAVES else (lambda x: x)
        if depth == CUTS:
            part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / leaf))
            at = at.join(mark(big), "leaf", "left").select("id", "tree", F.when(F.col("n").isNull(), F.col("leaf")).otherwise(F.xxhash64("leaf", part)).alias("leaf"), "proj")
            break
        p = F.col("proj")[depth]
        parts = F.least(F.ceil(F.col("n") / leaf), F.lit(PARTS))
        halves = [i / (2 * PARTS * 3) for i in range(1, 2 * PARTS * 3)]  # quantiles for two, three and four parts
        cuts = at.join(mark(big), "leaf").groupBy("leaf").agg(F.first("n").alias("n"), F.percentile_approx(p, F.array(*[F.lit(h) for h in halves]), 1000).alias("q"))
        cuts = cuts.select("leaf", F.transform(F.sequence(F.lit(1), parts.cast("int") - 1), lambda i: F.element_at("q", (i * len(halves) / parts).cast("int") + 1)).alias("q"))
        sub = F.size(F.filter("q", lambda c: c <= F.col("proj")[depth]))
        at = at.join(mark(cuts), "leaf", "left")
        at = cut_lineage(at.select("id", "tree", F.when(F.col("q").isNull(), F.col("leaf")).otherwise(F.xxhash64("leaf", F.lit(depth), sub)).alias("leaf"), "proj"))
    return at.select("id", "tree", "leaf")


# -- graph --------------------------------------------------------------------------------------------------------------

def _unit64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True, initial=0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _first(a: np.ndarray, sim: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """The places, sorted by ``a``, of the k best of each a: most similar first, of equal ones the smaller ``other``."""
    o = np.lexsort((other, -sim, a))
    r = a[o]
    start = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.empty(0, int)
    return o[np.arange(len(r)) - np.repeat(start, np.diff(np.append(start, len(r)))) < k]


def _near_first(a: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """The places of all that may be among the k best of each a once their cosines are rounded."""
    o = np.lexsort((-sim, a))
    r, v = a[o], sim[o]
    start = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.empty(0, int)
    n = np.diff(np.append(start, len(r)))
    last = v[start + np.minimum(n, k) - 1]
    return o[v >= np.repeat(last, n) - CLOSE]


def _best(x: np.ndarray, ids: np.ndarray, k: int):
    """Row numbers, column numbers and rounded cosines, by row, of the k most similar others in a block; ties by id."""
    n, u, u64 = len(x), _unit(x), None
    k = min(k, n - 1)
    for i in range(0, n, _ROWS):
        g = u[i : i + _ROWS] @ u.T
        at = np.arange(len(g))
        g[at, at + i] = -3
        r, c = np.nonzero(g >= np.maximum(np.partition(g, n - k, axis=1)[:, n - k] - CLOSE, -2)[:, None])
        if len(r) > 4 * k * len(g):  # many ties
            u64 = _unit64(x) if u64 is None else u64
            top = _first(r, np.round((u64[i : i + _ROWS] @ u64.T)[r, c], 6), ids[c], k)
            r, c = r[top], c[top]
        sim = _exact(x, r + i, c)
        top = _first(r, sim, ids[c], k)
        yield r[top] + i, c[top], sim[top]


def _better(x: np.ndarray, worst: np.ndarray, worst_id: np.ndarray, k: int, ids: np.ndarray, known: np.ndarray):
    """Row numbers, column numbers and rounded cosines, by row, of the k most similar others of each row that beat its worst
    neighbour and are not known; ties by id.

    The product is symmetric, so each tile of it serves the rows of both sides.
    """
    u, u64 = _unit(x), None
    n, least = len(u), (worst - 1e-5).astype(np.float32)
    rows, cols, sims = [], [], []

    def beats(r, c, sim):
        return (sim > worst[r]) | ((sim == worst[r]) & (ids[c] < worst_id[r]))

    def keep(r, c, v):
        nonlocal u64
        new = (r != c) & ~(ids[c][:, None] == known[r]).any(1)
        r, c, v = r[new], c[new], v[new]
        if len(r) > 4 * k * _TILE:
            near = _near_first(r, v, k)
            r, c, v = r[near], c[near], v[near]
        if len(r) > 4 * k * _TILE:  # many ties
            u64 = _unit64(x) if u64 is None else u64
            i, j = int(r.min()), int(c.min())
            sim = np.round((u64[i : r.max() + 1] @ u64[j : c.max() + 1].T)[r - i, c - j], 6)
            good = np.flatnonzero(beats(r, c, sim))
            good = good[_first(r[good], sim[good], ids[c[good]], k)]
            r, c, v = r[good], c[good], v[good]
        rows.append(r)
        cols.append(c)
        sims.append(v)

    def floor(g, least):  # of rows whose list is not full yet, the best of the tile are enough
        short = least < -2
        if short.any():
            m = g[short]
            at = max(m.shape[1] - 1 - k - known.shape[1], 0)
            least = least.copy()
            least[short] = np.partition(m, at, axis=1)[:, at] - CLOSE
        return least[:, None]

    for i in range(0, n, _TILE):
        for j in range(i, n, _TILE):
            g = u[i : i + _TILE] @ u[j : j + _TILE].T
            r, c = np.nonzero(g > floor(g, least[i : i + _TILE]))
            keep(r + i, c + j, g[r, c])
            if j > i:
                g = g.T
                r, c = np.nonzero(g > floor(g, least[j : j + _TILE]))
                keep(r + j, c + i, g[r, c])
    r, c, v = np.concatenate(rows), np.concatenate(cols), np.concatenate(sims)
    near = _near_first(r, v, k)
    r, c = r[near], c[near]
    sim = _exact(x, r, c)
    good = np.flatnonzero(beats(r, c, sim))
    good = good[_first(r[good], sim[good], ids[c[good]], k)]
    return r[good], c[good], sim[good]


_FLAT = "id long, blk long, neg double, other long, other_blk long"


def _rows(ids, blk, a, b, sim) -> pa.Table:
    """One row per entry, node a with its neighbour b, from parallel arrays; flat columns cross to the JVM at little cost."""
    return pa.table({"id": ids[a], "blk": blk[a], "neg": -sim, "other": ids[b], "other_blk": blk[b]})


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _vectors_of(t: pa.Table, dim: int) -> np.ndarray:
    return _matrix(t.column("vec").to_pylist(), dim)


_NONE = np.empty(0, int), np.empty(0, int), np.empty(0)


def _leaf_lists(dim: int, k: int):
    def run(t: pa.Table) -> pa.Table:
        ids, blk = _column(t, "id"), _column(t, "blk")
        if len(ids) < 2:
            return _rows(ids, blk, *_NONE)
        return _rows(ids, blk, *(np.concatenate(v) for v in zip(*_best(_vectors_of(t, dim), ids, k), strict=True)))

    return run


def _block_lists(dim: int, k: int):
    def run(t: pa.Table) -> pa.Table:
        ids, blk = _column(t, "id"), _column(t, "blk")
        if len(ids) < 2:
            return _rows(ids, blk, *_NONE)
        known = np.stack([_column(t, f"known{i}") for i in range(k)], 1)
        full = known[:, -1] != NO_ID
        worst = np.where(full, _column(t, "worst"), -3.0)
        worst_id = np.where(full, known[:, -1], NO_ID)
        return _rows(ids, blk, *_better(_vectors_of(t, dim), worst, worst_id, k, ids, known))

    return run


def _as_lists(flat: DataFrame) -> DataFrame:
    return flat.select("id", "blk", F.array(F.struct("neg", F.col("other").alias("id"), F.col("other_blk").alias("blk"))).alias("nbr"))


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """The k best of all lists of a node; of one neighbour named in several lists one stays."""
    return lists.groupBy("id").agg(F.min("blk").alias("blk"), F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("nbr")))), 1, k).alias("nbr"))


def start_graph(vectors: DataFrame, trees: Trees, blocks: Trees, dim: int = DIM, k: int = LIST, leaf: int = LEAF, block: int = BLOCK, leaf_most: float = LEAF_MOST) -> tuple[DataFrame, DataFrame]:
    """``(id, blk, nbr)`` from the leaves of all trees, and ``(id, blk, vec)``; blk is the leaf in the tree of the blocks."""
    at = leaves(vectors, trees, dim, leaf, leaf_most)
    own = leaves(vectors, blocks, dim, block, 1.5 * leaf_most).select("id", F.col("leaf").alias("blk"))
    placed = cut_lineage(vectors.join(own, "id").select("id", "blk", "vec"))
    grouped = at.join(placed, "id").select("id", "blk", "leaf", "vec").groupBy("leaf")
    return cut_lineage(_merged(_as_lists(grouped.applyInArrow(_leaf_lists(dim, k), _FLAT)), k)), placed


def improve(graph: DataFrame, placed: DataFrame, dim: int = DIM, k: int = LIST, chunk: int = CHUNK, active: DataFrame | None = None, nearest: int = NEAREST) -> tuple[DataFrame, int, DataFrame | None]:
    """One round: the graph after comparing neighbours of neighbours, how many new list entries came up, and who is active next.

    After the first round only nodes with a new entry, or in one, bring their neighbours together again.
    """
    e = graph.select("id", "blk", F.explode(F.slice("nbr", 1, nearest)).alias("n")).select("id", "blk", F.col("n.id").alias("to"), F.col("n.blk").alias("to_blk"))
    centres, ahead, behind = graph.select("id", "blk"), e, e
    if active is not None:
        centres, ahead = centres.join(active, "id", "left_semi"), e.join(active, "id", "left_semi")
        behind = e.join(active.select(F.col("id").alias("to")), "to", "left_semi")
    members = (
        centres.select(F.col("blk").alias("b"), "id", F.lit(True).alias("core"))
        .unionByName(ahead.select(F.col("blk").alias("b"), F.col("to").alias("id"), F.lit(True).alias("core")))
        .unionByName(behind.select(F.col("to_blk").alias("b"), "id", F.lit(False).alias("core")))
        .groupBy("b", "id").agg(F.max("core").alias("core"))
    )
    sizes = members.where("not core").groupBy("b").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks")).where("chunks > 1")
    members = members.join(sizes, "b", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunks = F.when(F.col("core"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")))
    members = members.select("b", "id", F.explode(chunks).alias("chunk"))
    known = [F.coalesce(F.get("nbr", F.lit(i))["id"], F.lit(NO_ID)).alias(f"known{i}") for i in range(k)]
    state = graph.select("id", *known, F.coalesce(-F.element_at("nbr", -1)["neg"], F.lit(-3.0)).alias("worst"))
    rows = members.join(state, "id").join(placed, "id")
    new = rows.select("b", "chunk", "id", "blk", "vec", "worst", *[f"known{i}" for i in range(k)]).groupBy("b", "chunk").applyInArrow(_block_lists(dim, k), _FLAT)
    new = cut_lineage(new)
    changed = new.count()
    if not changed:
        return graph, 0, None
    active = cut_lineage(new.select("id").unionByName(new.select(F.col("other").alias("id"))).distinct())
    return cut_lineage(_merged(graph.select("id", "blk", "nbr").unionByName(_as_lists(new)), k)), changed, active


def neighbour_graph(vectors: DataFrame, dim: int = DIM, k: int = LIST, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, sample: int = SAMPLE, stop: float = STOP_SHARE, leaf_most: float = LEAF_MOST, chunk: int = CHUNK, nearest: int = NEAREST) -> tuple[DataFrame, DataFrame, Trees]:
    """The finished graph ``(id, blk, nbr)`` of ``(id, vec)``, the placed vectors and the trees.

    ``sample`` vectors at most are read to the driver for the trees; everything else covers all rows. Lists only get
    better, so the rounds end by themselves: when no more than the share ``stop`` of all entries is new.
    """
    n = vectors.count()
    part = vectors.select("vec") if n <= sample else vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * sample / n)).select("vec")
    got = part.limit(2 * sample).toPandas()
    some = _unit(_matrix(got.vec, dim)) if len(got) else np.empty((0, dim), np.float32)
    planes = Trees(some, n, trees, leaf)
    graph, placed = start_graph(vectors, planes, Trees(some, n, 1, block, seed=11), dim, k, leaf, block, leaf_most)
    active, changed = None, n * k
    while changed > stop * n * k:
        graph, changed, active = improve(graph, placed, dim, k, chunk, active, nearest)
    return graph, placed, planes


def live_groups(cache: DataFrame, k: int = K, dim: int = DIM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Live rows ``(id, sig)``, groups of one direction ``(sig, rep, n, ids)`` and the vectors ``(id, vec)`` of their smallest ids."""
    usable = cut_lineage(usable_vectors(cache, dim))
    live = cut_lineage(live_ids(usable))
    groups = live.groupBy("sig").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    first = live.withColumn("rk", F.row_number().over(W.partitionBy("sig").orderBy("id"))).where(F.col("rk") <= k + 1)
    first = first.groupBy("sig").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    groups = cut_lineage(groups.join(first, "sig"))
    vectors = cut_lineage(usable.groupBy("id").agg(F.min("vec").alias("vec")).join(groups.select(F.col("rep").alias("id")), "id"))
    return live, groups, vectors


def spread_groups(near: DataFrame, live: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """``(id, rank, other, similarity)`` of the live rows asked for, from lists ``(rep, neg, other)`` of one row per direction."""
    spread = groups.where("n > 1").select(F.col("rep").alias("other"), F.slice("ids", 1, k).alias("ids"))
    near = near.join(spread, "other", "left").select("rep", "neg", F.explode(F.coalesce("ids", F.array("other"))).alias("id"))
    own = groups.where("n > 1").select("rep", F.lit(-1.0).alias("neg"), F.explode("ids").alias("id"))
    lists = near.unionByName(own).groupBy("rep").agg(F.slice(F.sort_array(F.collect_list(F.struct("neg", "id"))), 1, k + 1).alias("nbr"))
    # members of one group may be a third of all rows; its list is one row
    members = join_skewed(live.select("id", "sig"), groups.select("sig", "rep").join(lists, "rep").select("sig", "nbr"), ["sig"])
    kept = members.select("id", F.posexplode(F.slice(F.filter("nbr", lambda x: x["id"] != F.col("id")), 1, k)).alias("p", "x"))
    return kept.select("id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias("other"), (-F.col("x.neg")).alias("similarity"))


def most_similar(cache: DataFrame, k: int = K, dim: int = DIM, **how) -> DataFrame:
    """``(id, rank, other, similarity)``: for every live row its k most similar other live rows."""
    live, groups, vectors = live_groups(cache, k, dim)
    graph, _, _ = neighbour_graph(vectors, dim, max(LIST, k + 4), **how)
    near = graph.select(F.col("id").alias("rep"), F.explode("nbr").alias("n")).select("rep", F.col("n.neg").alias("neg"), F.col("n.id").alias("other"))
    return spread_groups(near, live, groups, k)


def similar_pairs(cache: DataFrame, k: int = K, dim: int = DIM, **how) -> DataFrame:
    """``(cache_id_a, cache_id_b)``, a < b, where one is among the k most similar of the other."""
    m = most_similar(cache, k, dim, **how)
    return m.select(F.least("id", "other").alias("cache_id_a"), F.greatest("id", "other").alias("cache_id_b")).distinct()
