"""Exact top-k search by inner product: score-at-a-time over impact-ordered posting segments, exact rescoring."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, written

#: Queries of one query block, vectors of one index block, and the share of their pairs that are rescored rather than
#: narrowed down by another segment.
QUERIES, BLOCK, FEW = 1024, 4096, 0.01


def quantised(c: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x, as double; null for vectors null, or with null or non-finite components.

    A component beyond a long's range becomes the nearest long.
    """
    ok = c.isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    floor = lambda x: F.floor(F.greatest(F.lit(-9.2e18), F.least(F.lit(9.2e18), x.cast("double") * scale))).cast("long")
    return F.when(ok, F.transform(c, floor))


def segments_of(v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Posting segments of integer vectors by descending impact: (dimension, vector, value) of each, by dimension.

    The segment of impact b holds the postings whose |value| has b bits.
    """
    row, dim = np.nonzero(v)
    value = v[row, dim]
    bits = np.frexp(np.abs(value.astype(float)))[1]
    order = np.lexsort((row, dim, -bits))
    row, dim, value, bits = row[order], dim[order], value[order], bits[order]
    cuts = np.flatnonzero(np.diff(bits, prepend=bits[0] + 1, append=bits[-1] - 1)) if len(bits) else np.zeros(0, np.int64)
    return [(dim[a:b].astype(np.int32), row[a:b].astype(np.int32), value[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def top_of_block(queries: np.ndarray, q_ids: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray, segments: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) rows that hold every top-k member of the block; floor: scores that k others already reach.

    Segments are added by descending impact, the postings of one as one product. What the rest may change is bounded by
    the lengths of the query and of the vector's remaining postings, so a vector whose best case stays below k others'
    worst case is out, for good. Adding stops when that leaves few of the pairs: the proof that no other is among the
    top k; all of those are rescored exactly in integers.
    """
    q = queries.astype(float)
    length, own = np.sqrt((q**2).sum(1)), q_ids[:, None] == ids[None, :]
    sums, possible, left = np.zeros((len(q), len(v))), ~own, (v.astype(float) ** 2).sum(1)
    few, postings = max(4 * k * len(queries), FEW * possible.size), np.zeros((v.shape[1], len(v)))
    for dim, row, value in segments_of(v) if segments is None else segments:
        postings[dim, row] = value
        sums += q @ postings
        postings[dim, row] = 0
        left = np.maximum(left - np.bincount(row, value.astype(float) ** 2, len(v)), 0)
        slack = length[:, None] * (np.sqrt(left) * (1 + 1e-9) + 1e-9 * np.sqrt((v.astype(float) ** 2).sum(1)))[None, :] + 1e-6
        low = np.where(own, -np.inf, sums - slack)
        bar = np.maximum(np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(low), -np.inf), floor)
        possible = ~own & (sums + slack >= bar[:, None])
        if np.count_nonzero(possible) <= few:
            break
    at, i = np.nonzero(possible)
    scores = np.concatenate([np.einsum("ij,ij->i", queries[at[a : a + 65536]], v[i[a : a + 65536]]) for a in range(0, len(at), 65536)]) if len(at) else np.zeros(0, np.int64)
    return at, ids[i], scores


def _blocks(most: int, index: bool):
    """Rows (vec_id, v) -> packed blocks of vectors of one length; an index block also holds its posting segments."""
    shape = pa.schema([("block", pa.int64()), ("d", pa.int32()), ("ids", pa.binary()), ("v", pa.binary()), ("seg", pa.list_(pa.binary()))])

    def packed(ids: np.ndarray, v: np.ndarray) -> dict:
        seg = [np.concatenate([dim, row]).tobytes() + value.tobytes() for dim, row, value in segments_of(v)] if index else None
        return {"block": uuid.uuid4().int >> 65, "d": v.shape[1], "ids": ids.tobytes(), "v": v.tobytes(), "seg": seg}

    def run(batches):
        open_: dict[int, list] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = open_.setdefault(len(x), [])
                rows.append((i, x))
                if len(rows) == most:
                    yield pa.RecordBatch.from_pylist([packed(np.array([i for i, _ in rows], np.int64), np.array([x for _, x in rows], np.int64).reshape(most, -1))], shape)
                    open_[len(x)] = []
        for d, rows in open_.items():
            if rows:
                yield pa.RecordBatch.from_pylist([packed(np.array([i for i, _ in rows], np.int64), np.array([x for _, x in rows], np.int64).reshape(len(rows), d))], shape)

    return run


def _searched(k: int):
    """Pairs of a query block and an index block, those of one query block together -> its k best of this task."""

    def matrix(ids: bytes, v: bytes, d: int) -> tuple[np.ndarray, np.ndarray]:
        i = np.frombuffer(ids, np.int64)
        return i, np.frombuffer(v, np.int64).reshape(len(i), d)

    def done(best: list) -> pa.RecordBatch:
        q_ids, (qi, ids, scores) = best[1], best[3]
        return pa.RecordBatch.from_arrays([pa.array(q_ids[qi]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

    def run(batches):
        best: list | None = None  # block, ids and matrix of the queries, and what is best so far
        for batch in batches:
            for r in batch.to_pylist():
                if best is None or best[0] != r["q"]:
                    if best:
                        yield done(best)
                    best = [r["q"], *matrix(r["q_ids"], r["q_v"], r["d"]), (np.zeros(0, np.int64),) * 3]
                _, q_ids, queries, old = best
                ids, v = matrix(r["ids"], r["v"], r["d"])
                floor, n = np.full(len(q_ids), -np.inf), np.bincount(old[0], minlength=len(q_ids))
                if (n >= k).any():
                    least = np.full(len(q_ids), np.inf)
                    np.minimum.at(least, old[0], old[2].astype(float))
                    floor = np.where(n >= k, least, floor)
                segments = []
                for s in r["seg"]:
                    n_post = len(s) // 16
                    ends = np.frombuffer(s[: 8 * n_post], np.int32)
                    segments.append((ends[:n_post], ends[n_post:], np.frombuffer(s[8 * n_post :], np.int64)))
                new = [np.concatenate(x) for x in zip(old, top_of_block(queries, q_ids, v, ids, k, floor, segments), strict=True)]
                order = np.lexsort((new[1], -new[2], new[0]))
                new = [x[order] for x in new]
                rank = np.arange(len(order)) - np.searchsorted(new[0], new[0])
                best[3] = tuple(x[rank < k] for x in new)
        if best:
            yield done(best)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, queries: int = QUERIES, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each query row with all other rows, exactly.

    Components become floor(scale * x); scores are integers (and must fit into a long). Ties go to the smaller id. Rows
    of one id are the same candidate and not each other's: a row never finds its own id. Rows whose id or vector is null,
    or whose vector holds null or non-finite components, take no part. Vectors meet vectors of their own length only; of
    repeated rows each counts as a candidate, and a repeated query id counts once (its rows taken as one, the smallest
    vector). Fewer candidates give fewer rows; an empty table none. Other columns are ignored.

    The index is built once: blocks of `block` vectors with their posting segments, written as a table. Blocks of
    `queries` queries are another table; a join deals out all pairs of blocks as rows of one plan, nothing goes to the
    driver. Each task keeps k rows for each of its queries, so what is shuffled last is k rows a query and task.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("vec_id is not null and v is not null")
    shape = "block long, d int, ids binary, v binary, seg array<binary>"
    index = written(rows.select("vec_id", "v").mapInArrow(_blocks(block, True), shape), "index")
    asked = rows.where("q").groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(_blocks(queries, False), shape)
    asked = written(asked.select(F.col("block").alias("q"), "d", F.col("ids").alias("q_ids"), F.col("v").alias("q_v")), "queries")
    pairs = written(asked.select("q", "d").join(index.select("block", "d"), "d"), "pairs")  # ids of blocks only
    met = pairs.join(asked.drop("d"), "q").join(index, ["block", "d"])
    width = max(1, min(pairs.count(), 1 << 15))
    met = met.repartition(width, "q", F.pmod("block", F.lit(16))).sortWithinPartitions("q")
    out = written(met.mapInArrow(_searched(k), "query_id long, vec_id long, score long"), "found")
    free(pairs, asked, index)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
