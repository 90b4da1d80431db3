"""Connected components by distributed union-find, and exact verification of set links inside candidate clusters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, release, written

#: Most members that one tile of a cluster holds.
TILE = 1000
#: Mean number of set elements for each of them; tiles of larger sets hold fewer members.
TILE_ITEMS = 1000
#: Members of a tile from which bitmaps pay; of fewer, each pair that sizes allow is intersected at once.
BITMAPS_FROM = 5


#: Edges that one task may hold; more are contracted by distributed rounds.
LOCAL_EDGES = 1 << 21


def _forest(batches):
    """Union-find over the edges of one partition: an edge from each node to its root, the smallest node."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    nodes, at = np.unique(np.concatenate([t.column("a").to_numpy(), t.column("b").to_numpy()]), return_inverse=True)
    a, b, root = at[: t.num_rows], at[t.num_rows :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        old = root.copy()
        np.minimum.at(root, old[a], low)
        np.minimum.at(root, old[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == old).all():
            break
    own = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["a", "b"])


def connected(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Components of edges(a long, b long): (node, component), component being the smallest node that it reaches.

    Each partition first contracts its own edges by union-find to one edge for each node. What is left meets in one task
    if it is at most LOCAL_EDGES edges, a fixed amount of memory. Else rounds tie every larger neighbour of a node to the
    node's smallest neighbour, then every smaller neighbour and the node itself, until nothing changes; a hub's edges
    only meet in joins that Spark may split, and minima are taken before the shuffle. Self loops, repeated edges and null
    ends change nothing; no edges: no rows.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    now, seen = written(pairs.mapInArrow(_forest, "a long, b long"), tag), None
    if now.count() <= LOCAL_EDGES:
        all_of, now = now, written(now.coalesce(1).mapInArrow(_forest, "a long, b long"), tag)
        free(all_of)
        return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == seen:
            break
        seen = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = now.join(low, now["b"] == low["u"]).select("a", F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").where("x > m").unionAll(low.select(F.col("a").alias("x"), "m"))
        before, now = now, written(small.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), tag)
        free(before)
    member = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return member.unionAll(roots.join(member, "node", "left_anti"))


def _bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros(len(sets) * bits, bool)
    h = (np.concatenate(sets).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits.bit_length() + 1)
    out[np.repeat(np.arange(len(sets)) * bits, [len(s) for s in sets]) + h.astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64).reshape(len(sets), bits // 64)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |A and B| >= percent * |A or B|, of sorted distinct arrays that aren't empty."""
    at = b.searchsorted(a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) * (100 + percent) >= percent * (len(a) + len(b))


def _few(ids: list[int], sets: list[np.ndarray], labels: list[int], percent: int, sides: list[int] | None) -> list[tuple[int, int]]:
    """link_tile of few members, sorted by size."""
    links = []
    for i, a in enumerate(sets):
        for k in range(i + 1, len(sets)):
            if len(sets[k]) * percent > len(a) * 100:
                break
            if labels[k] != labels[i] and (sides is None or sides[k] != sides[i]) and _linked(a, sets[k], percent):
                links.append((ids[i], ids[k]))
                old = labels[k]
                labels = [labels[i] if x == old else x for x in labels]
    return links


def link_tile(ids: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, percent: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the labels of one tile, found exactly: 100 * |A and B| >= percent * |A or B|.

    Members are scanned by size; only sizes that can link are compared. A bit of one bitmap that the other lacks proves
    an element outside the intersection, so bit counts bound the overlap from above; what the bound leaves is
    intersected as sorted arrays. Pairs that already have the same label are connected and skipped.
    With sides, only pairs of different sides are compared.
    """
    n = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(n, kind="stable")
    ids, labels, n, sets = ids[order], labels[order].copy(), n[order], [sets[i] for i in order]
    if sides is not None:
        sides = sides[order]
    if len(ids) < 2 or (labels == labels[0]).all():
        return []
    if len(ids) < BITMAPS_FROM:
        return _few(ids.tolist(), sets, labels.tolist(), percent, None if sides is None else sides.tolist())
    bits = 1 << int(np.clip(int(np.median(n)) * 2, 256, 4096) - 1).bit_length()
    maps, links = _bitmaps(sets, bits), []
    for i in range(len(ids) - 1):
        j = i + 1 + int(np.searchsorted(n[i + 1 :] * percent, n[i] * 100, side="right"))
        near = np.flatnonzero(labels[i + 1 : j] != labels[i]) + i + 1
        if sides is not None:
            near = near[sides[near] != sides[i]]
        if not len(near):
            continue
        mine, other = np.bitwise_count(maps[i] & ~maps[near]).sum(1), np.bitwise_count(maps[near] & ~maps[i]).sum(1)
        most = np.minimum(n[i] - mine.astype(np.int64), n[near] - other.astype(np.int64))
        near = near[most * (100 + percent) >= percent * (n[i] + n[near])]
        for k in near:
            if labels[k] == labels[i]:
                continue
            if _linked(sets[i], sets[k], percent):
                links.append((int(ids[i]), int(ids[k])))
                labels[labels == labels[k]] = labels[i]
    return links


def _solve(tiles: DataFrame, by: list[str], percent: int, make: Callable) -> DataFrame:
    """Links (a, b) of each tile of tiles(*by, id, label, side, items), a tile being the rows that agree in by.

    Tiles are dealt out by hash and sorted; a task reads its tiles one after another and holds a batch and a tile.
    """

    def solved(t: pa.Table, cuts: np.ndarray):
        ids, number = t.column("id").to_numpy(), np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        order = np.lexsort((ids, number))
        new = np.ones(len(ids), bool)  # an id counts once in its tile
        new[1:] = (ids[order[1:]] != ids[order[:-1]]) | (number[order[1:]] != number[order[:-1]])
        order = order[new]
        several = np.bincount(number[order], minlength=len(cuts) - 1) > 1
        order = order[several[number[order]]]
        if not len(order):
            return
        t = t.take(pa.array(order))
        ids, label, items = t.column("id").to_numpy(), t.column("label").to_numpy(), make(t.column("items").to_pylist())
        sides = t.column("side").to_numpy() if t.column("side").null_count == 0 else None
        cuts = np.flatnonzero(np.diff(number[order], prepend=-1, append=-1)).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield from link_tile(ids[lo:hi], items[lo:hi], label[lo:hi], percent, None if sides is None else sides[lo:hi])

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            keys = [t.column(c).to_numpy() for c in by]
            last = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            rest = t.slice(int(last[-1])) if len(last) else t
            if len(last):
                yield links_of(t.slice(0, int(last[-1])), np.concatenate([[0], last]))
        if rest is not None:
            yield links_of(rest, np.array([0, rest.num_rows]))
        release()

    def links_of(t: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        got = np.array(list(solved(t, cuts)), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

    return tiles.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long")


def _arrays(items: list) -> list[np.ndarray]:
    return [np.asarray(x, np.int64) for x in items]


def verified_components(members: DataFrame, candidates: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, tag: str, tile: int = TILE, make: Callable = _arrays) -> DataFrame:
    """Components of the exact links among candidates(a, b).

    members(id, n, w) has the size n of each id's set (1 for all, where it isn't known: then there is one band) and about
    how many elements w it takes in memory; sets_of(keys) returns keys(id, ...) with items, from a list of which make
    gives the sets, sorted distinct int64 arrays, when their tile is solved. Sets in different
    candidate clusters can't link. Returns (id, component) for ids that link with another; component is the smallest id.

    A cluster of up to about `tile` members is one tile. A larger one is cut into size bands (ratio 100/percent, so that
    links only join the same or neighbouring bands) and salted blocks of about `tile` members. First each block is
    solved alone, then the components' representatives meet, and only clusters that still have several components get
    the remaining pairs of blocks, in which pairs of equal label are skipped. No pair that might link between different
    components is left out. Until a tile is formed only ids and sizes move; its sets are made when it is.
    """
    # bands may only be wider than the widest allowed ratio, or links would be lost
    band = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.lit(float(np.log(100 / percent)) * 1.0000001)).cast("long")
    own = connected(candidates, tag).select(F.col("node").alias("id"), F.col("component").alias("cluster")).join(members, "id").withColumn("band", band)
    own = written(own, tag)
    load = F.greatest(F.count("*") / F.lit(tile), F.sum("w") / F.lit(tile * TILE_ITEMS))
    cells = own.groupBy("cluster", "band").agg(load.alias("load")).withColumn("parts", F.ceil("load").cast("long"))
    cells = written(cells, tag)
    own = own.join(cells.groupBy("cluster").agg((F.sum("load") > 1).alias("big")), "cluster").join(cells.select("cluster", "band", "parts"), ["cluster", "band"])
    own = own.withColumn("part", F.when(F.col("big"), F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(0)).withColumn("band", F.when(F.col("big"), F.col("band")).otherwise(0))
    own = written(own.select("cluster", "big", "band", "part", "id"), tag)
    no_side = F.lit(None).cast("long").alias("side")
    alone = sets_of(own.select("id", "cluster", "band", "part", F.col("id").alias("label"), no_side))
    links = written(_solve(alone, ["cluster", "band", "part"], percent, make), tag)
    big = own.where("big")
    if big.limit(1).count() == 0:
        return connected(links, tag).select(F.col("node").alias("id"), "component")

    def labelled(links: DataFrame) -> DataFrame:
        c = connected(links, tag)
        return written(big.join(c.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component"), tag)

    now = labelled(links)
    pick = now.groupBy("cluster", "band", "label").agg(F.min("id").alias("id"))
    width = pick.groupBy("cluster", "band").agg(F.ceil(F.count("*") / F.lit(tile // 2)).cast("long").alias("w"))
    reps = pick.join(width, ["cluster", "band"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.col("w")))
    reps = reps.withColumn("at", F.explode(F.array("band", F.col("band") + 1))).select("id", "cluster", F.col("at").alias("band"), "part", "label", no_side)
    tiles = reps.groupBy("cluster", "band", "part").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("cluster", "band", "part")
    more = sets_of(reps.join(tiles, ["cluster", "band", "part"], "left_semi"))
    links = written(links.unionAll(_solve(more, ["cluster", "band", "part"], percent, make)), tag)
    now = labelled(links)
    blocks = written(now.groupBy("cluster", "band", "part").agg(F.min("label").alias("lo"), F.max("label").alias("hi")), tag)
    left = blocks.select("cluster", F.col("band").alias("b1"), F.col("part").alias("p1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    right = blocks.select("cluster", F.col("band").alias("b2"), F.col("part").alias("p2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    right = right.withColumn("b1", F.explode(F.array("b2", F.col("b2") - 1)))
    tiles = left.join(right, ["cluster", "b1"]).where("(b1 < b2 or p1 < p2) and not (lo1 = hi1 and lo2 = hi2 and lo1 = lo2)")
    tiles = tiles.select("cluster", F.xxhash64("b1", "p1", "b2", "p2").alias("t"), F.explode(F.array(F.struct(F.col("b1").alias("band"), F.col("p1").alias("part"), F.lit(0).cast("long").alias("side")), F.struct(F.col("b2").alias("band"), F.col("p2").alias("part"), F.lit(1).cast("long").alias("side")))).alias("x"))
    tiles = written(tiles.select("cluster", "t", "x.band", "x.part", "x.side"), tag)
    if tiles.limit(1).count():
        rest = sets_of(tiles.join(now, ["cluster", "band", "part"]).select("id", "cluster", "t", "label", "side"))
        links = links.unionAll(written(_solve(rest, ["cluster", "t"], percent, make), tag))
    return connected(links, tag).select(F.col("node").alias("id"), "component")
