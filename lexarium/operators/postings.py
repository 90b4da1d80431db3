"""Words of documents counted where the documents are: postings leave a task combined, so that only they are moved."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words that are counted at once, or those of one document or window.
WORDS = 1 << 21


def _counted(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Lists of words as (distinct words, code, row, times), by code, then row."""
    coded = pc.list_flatten(words).dictionary_encode()
    code, row = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_parent_indices(words).to_numpy(zero_copy_only=False).astype(np.int64)
    key, times = np.unique(code * max(len(words), 1) + row, return_counts=True)
    return coded.dictionary, key // max(len(words), 1), key % max(len(words), 1), times


def _cut(batch: pa.RecordBatch, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The batch cut at some of these ends of rows, after about WORDS words each."""
    column = batch.column(batch.schema.get_field_index("words"))
    total, at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]), 0
    while at < ends[-1]:
        to = ends[max(int(np.searchsorted(total[ends], total[at] + WORDS, side="right")) - 1, int(np.searchsorted(ends, at, side="right")))]
        yield batch.slice(at, int(to) - at)
        at = int(to)


def term_counts(docs: DataFrame) -> DataFrame:
    """(token, doc, tf) of docs(doc, words), in the documents' own partitions; a row of docs is counted by itself."""
    shape = T.StructType([T.StructField("token", T.StringType()), T.StructField("doc", docs.schema["doc"].dataType), T.StructField("tf", T.LongType())])
    arrow = to_arrow_schema(shape)

    def run(batches):
        for batch in batches:
            for part in _cut(batch, np.arange(1, batch.num_rows + 1)) if batch.num_rows else ():
                token, code, row, tf = _counted(part.column(1))
                yield pa.RecordBatch.from_arrays([token.take(pa.array(code)).cast(pa.string()), part.column(0).take(pa.array(row)), pa.array(tf)], schema=arrow)

    return docs.select("doc", "words").mapInArrow(run, shape)


def window_blocks(docs: DataFrame) -> DataFrame:
    """(token, window, n, most, least, postings) of docs(window, doc, len, words), whose windows' rows stand together: a row for
    each token of a window. A window that two tasks read parts of has a row from each."""
    posting = T.StructType([T.StructField("doc", docs.schema["doc"].dataType), T.StructField("tf", T.IntegerType()), T.StructField("len", T.IntegerType())])
    shape = T.StructType([T.StructField("token", T.StringType()), T.StructField("window", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in ("n", "most", "least")), T.StructField("postings", T.ArrayType(posting))])
    arrow = to_arrow_schema(shape)

    def blocks(part: pa.RecordBatch) -> pa.RecordBatch:
        window, length = part.column(0).to_numpy(), part.column(2).to_numpy()
        token, code, row, tf = _counted(part.column(3))
        if not len(code):
            return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in arrow], schema=arrow)
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (window[row[1:]] != window[row[:-1]])]))
        held = pa.StructArray.from_arrays([part.column(1).take(pa.array(row)), pa.array(tf.astype(np.int32)), pa.array(length[row].astype(np.int32))], fields=list(arrow.field("postings").type.value_type))
        ends = np.append(first, len(code)).astype(np.int32)
        columns = [token.take(pa.array(code[first])).cast(pa.string()), pa.array(window[row[first]])]
        columns += [pa.array(x.astype(np.int32)) for x in (np.diff(ends), np.maximum.reduceat(tf, first), np.minimum.reduceat(length[row], first))]
        columns.append(pa.ListArray.from_arrays(pa.array(ends), held).cast(arrow.field("postings").type))
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if rest is None else pa.concat_batches([rest, batch])
            window = batch.column(0).to_numpy()
            ends = np.flatnonzero(window[1:] != window[:-1]) + 1
            rest = batch.slice(int(ends[-1])) if len(ends) else batch  # the last window may go on in the next batch
            for part in _cut(batch, ends) if len(ends) else ():
                yield blocks(part)
        if rest is not None:
            yield blocks(rest)

    return docs.select("window", "doc", "len", "words").mapInArrow(run, shape)
