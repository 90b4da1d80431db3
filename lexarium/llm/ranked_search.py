"""Ranked lexical search: document-sharded CSR postings with precomputed integer impacts, scored term at a time.

An index is a table of shards. A shard holds the postings of some 8 MB of text as compressed sparse rows: terms, where
each term's postings begin, and for every posting the document's place in the shard and its impact. Impacts depend on
the corpus (documents and terms in all), so that these two figures are counted before the shards are made. A search adds
each term's weighted impacts into one dense numpy array a shard and query, selects the shard's best by argpartition with
ties settled by document id, and merges the shards' best in two steps. Scores are 64-bit integers, so no order of
additions matters and results equal a full sort.

Terms are maximal runs of letters, digits and everything beyond ASCII, only A-Z lower-cased; they are compared as bytes,
never as hashes.

Defined results: a null or termless text takes no part; a null or termless query has no rows; a query row that is given
twice is answered twice; documents of equal ids stay apart, and equal scores go by ascending id, null ids last; an empty
table gives no rows; columns other than id and text are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ALNUM, release, small_batches, word_bounds, written
from .common import schema as _schema

#: Bytes of text of one shard (a longer text is a shard of its own), and of the queries that are asked in one pass.
SHARD, BLOCK = 8 << 20, 8 << 20
#: Groups in which the shards' best are merged first.
BUCKETS = 64
_SHARD = _schema("terms binary, term_ends binary, starts binary, docs binary, impacts binary")


@dataclass(frozen=True)
class Index:
    shards: DataFrame
    n_docs: int
    n_terms: int


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order as one binary array, and the number of terms of each text."""
    data, starts, ends, counts = word_bounds(texts, ALNUM)
    upto = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=upto[1:])
    return _binary(upto, data[data != 0]), counts


def _binary(upto: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(upto) - 1, [None, pa.py_buffer(np.ascontiguousarray(upto)), pa.py_buffer(np.ascontiguousarray(data))])


def sizes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with a term, and all their terms."""

    def run(batches):
        n = total = 0
        for batch in batches:
            for part in small_batches(batch, text):
                counts = word_bounds(part.column(0), ALNUM)[3]
                n, total = n + int((counts > 0).sum()), total + int(counts.sum())
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "l": pa.array([total], pa.int64())})

    r = docs.select(text).mapInArrow(run, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return r["n"] or 0, r["l"] or 0


def norms(counts: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of each document of so many terms; in Python's integers where 64 bits don't hold the product."""
    if 50 * int(counts.max(initial=0)) * n_docs >= 1 << 63:
        return np.array([50 + 50 * int(n) * n_docs // n_terms for n in counts], np.int64)
    return 50 + (50 * counts.astype(np.int64) * n_docs) // n_terms


def shard(ids: pa.Array, texts: pa.Array, n_docs: int, n_terms: int) -> dict | None:
    """One shard's columns; its documents are in the order of their ids. None if no text has a term."""
    order = pc.sort_indices(ids, null_placement="at_end")
    ids, texts = ids.take(order), texts.take(order)
    words, counts = terms_of(texts)
    if not len(words):
        return None
    coded = words.dictionary_encode()
    vocabulary, n = coded.dictionary, len(ids)
    posted, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), counts), return_counts=True)
    docs, tf = posted % n, tf.astype(np.int64)
    impacts = (1_000_000_000 * tf) // (1000 * tf + 20 * norms(counts, n_docs, n_terms)[docs])
    starts = np.searchsorted(posted, np.arange(len(vocabulary) + 1, dtype=np.int64) * n)
    ends = np.frombuffer(vocabulary.buffers()[1], np.int64)[: len(vocabulary) + 1]
    return {
        "ids": ids, "terms": np.frombuffer(vocabulary.buffers()[2], np.uint8)[: ends[-1]].tobytes(), "term_ends": ends.tobytes(), "starts": starts.astype(np.int64).tobytes(),
        "docs": docs.astype(np.uint16 if n <= 1 << 16 else np.uint32).tobytes(), "impacts": impacts.astype(np.uint32).tobytes(),
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARD) -> Index:
    """Index whole texts: one pass counts, one makes the shards, which are written to the shared folder."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n_docs, n_terms = sizes(d)
    schema = T.StructType([T.StructField("ids", T.ArrayType(d.schema["id"].dataType)), *_SHARD.fields])
    shape = to_arrow_schema(schema)

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def cut():
            t = pa.Table.from_batches(held).combine_chunks()
            got = shard(*(pa.concat_arrays(t.column(c).chunks) for c in ("id", "text")), n_docs, n_terms)
            held.clear()
            if got:
                ids = got.pop("ids")
                columns = {"ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)} | {k: pa.array([v], pa.binary()) for k, v in got.items()}
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in shape], schema=shape)

        for batch in batches:
            for part in small_batches(batch, "text", share):
                held.append(part)
                size += part.column(1).nbytes
                if size >= share:
                    yield from cut()
                    size = 0
        if held:
            yield from cut()
        release()

    return Index(written(d.mapInArrow(run, schema), "shards"), n_docs, n_terms)


def _shards(batches, *names: str) -> Iterator[tuple]:
    """The columns of one shard at a time; the vocabulary as an array, the others as they are."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(batch.schema.get_field_index(c))[i] for c in names}
            raw = {c: v.as_buffer() for c, v in row.items() if c != "ids"}
            vocabulary = _binary(np.frombuffer(raw["term_ends"], np.int64), np.frombuffer(raw["terms"], np.uint8))
            yield row.get("ids"), vocabulary, np.frombuffer(raw["starts"], np.int64), raw


def document_frequencies(index: Index, terms: pa.Array) -> np.ndarray:
    """In how many documents each term stands: the shards' counts, summed before they move."""
    if not len(terms):
        return np.zeros(0, np.int64)

    def run(batches):
        total = np.zeros(len(terms), np.int64)
        for _, vocabulary, starts, _ in _shards(batches, "terms", "term_ends", "starts"):
            at = pc.index_in(terms, value_set=vocabulary).fill_null(-1).to_numpy()
            total[at >= 0] += (starts[at + 1] - starts[at])[at >= 0]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"t": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    out = np.zeros(len(terms), np.int64)
    for r in index.shards.select("terms", "term_ends", "starts").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
        out[r["t"]] = r["n"]
    return out


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, equal ones by place."""
    if len(scores) > k:
        least = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k :]].min()
        above = np.flatnonzero(scores > max(least, 0))
        return above if least <= 0 else np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
    return np.flatnonzero(scores > 0)


def _blocks(queries: DataFrame, most: int) -> Iterator[list]:
    """The query rows, some `most` bytes of text at a time."""
    block, size = [], 0
    for r in queries.toLocalIterator():
        if r["text"]:
            block.append((r["item"], r["text"]))
            size += len(r["text"].encode())
            if size >= most:
                yield block
                block, size = [], 0
    if block:
        yield block


def _searched(index: Index, block: list, k: int, schema: T.StructType) -> DataFrame:
    """(query, item, id, score): each shard's best for each query of a block, merged by groups of shards and then in all."""
    words, counts = terms_of(pa.array([text for _, text in block], pa.large_string()))
    coded = words.dictionary_encode()
    terms, codes = coded.dictionary, coded.indices.to_numpy()
    ends = np.cumsum(counts)
    asked = [np.unique(codes[a:b]) for a, b in zip(ends - counts, ends, strict=True)]
    weights = [weight(int(n), index.n_docs) for n in document_frequencies(index, terms)]
    items, shape = [item for item, _ in block], to_arrow_schema(schema)

    def run(batches):
        for ids, vocabulary, starts, raw in _shards(batches, "ids", "terms", "term_ends", "starts", "docs", "impacts"):
            ids = ids.values
            at = pc.index_in(terms, value_set=vocabulary).fill_null(-1).to_numpy()
            impacts = np.frombuffer(raw["impacts"], np.uint32)
            docs = np.frombuffer(raw["docs"], np.uint16 if 2 * len(impacts) == raw["docs"].size else np.uint32)
            scores = np.zeros(len(ids), np.int64)
            queries, places, found = [], [], []
            for q, own in enumerate(asked):
                own = own[at[own] >= 0]
                if not len(own):
                    continue
                scores[:] = 0
                for t in own:
                    a, b = starts[at[t]], starts[at[t] + 1]
                    scores[docs[a:b]] += weights[t] * impacts[a:b].astype(np.int64)
                top = best(scores, k)
                queries.append(np.full(len(top), q))
                places.append(top)
                found.append(scores[top])
            if queries:
                q = np.concatenate(queries)
                columns = [pa.array(q, pa.int32()), pa.array([items[i] for i in q], shape.field("item").type), ids.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(found), pa.int64())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)
        release()

    order = [F.desc("score"), F.asc_nulls_last("id")]
    top = lambda d, *by: d.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    found = index.shards.mapInArrow(run, schema).withColumn("bucket", F.pmod(F.spark_partition_id(), F.lit(BUCKETS)))
    return top(top(found, "query", "bucket"), "query")


def search(index: Index, queries: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = 50, most: int = BLOCK) -> DataFrame:
    """(item, rank, id, score): each query row's k best documents with a score above 0.

    Queries come in blocks of some 8 MB of text; each block is one pass over the shards for the frequencies of its terms
    and one for the scores.
    """
    q = queries.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item", q.schema["item"].dataType), T.StructField("id", index.shards.schema["ids"].dataType.elementType), T.StructField("score", T.LongType())])
    out = None
    for block in _blocks(q, most) if index.n_docs else []:
        one = _searched(index, block, k, schema).select("item", "rank", "id", "score")
        out = one if out is None else out.unionAll(one)
    if out is None:
        out = queries.sparkSession.createDataFrame([], schema).select("item", F.lit(0).alias("rank"), "id", "score")
    return out
