"""Benchmark decontamination: spaced seeds find shared passages, diagonals around the hits are verified with substitutions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import ALNUM, mix64, rows_of, small_batches

#: Seeds: "1" positions must agree, "0" positions are ignored. One of them hits any passage of 13 words or more in which
#: 80% agree (all patterns of 13 to 25 words were tried; of a longer passage one half is such a passage). Fixed values.
SEEDS = ("1111011", "11010001011", "1100011011", "1111101")
#: A passage counts if it has so many words (or is the whole item) and at least this share of them agree.
WORDS, AGREE = 13, 0.8
#: What a differing word takes from the sum of a passage, agreeing words adding 1 each.
MISMATCH = 3.0
#: What an agreeing word adds and a differing one takes so that the sum of a passage is not negative where AGREE holds.
ALLOWED = (1, 4)
#: Items of fewer words are no evidence of contamination.
LEAST = 5
#: Characters of benchmark text that are indexed, and broadcast, at a time; a larger benchmark is taken in blocks.
BLOCK = 16 << 20
#: Seed hits that are made at a time, and bits of a diagonal (a block has less than 2^23 items, a text less than 2^39 words).
HITS, SHIFT_BITS = 1 << 20, 40


def seed_hashes(words: np.ndarray, seed: str) -> np.ndarray:
    """Hash of the positions that the seed reads, for each place where it fits."""
    n = len(words) - len(seed) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(len(seed)), np.uint64)
    with np.errstate(over="ignore"):
        for i, c in enumerate(seed):
            if c == "1":
                total = (total ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                total ^= total >> np.uint64(32)
        return mix64(total)


def short_seed(n: int) -> str:
    """The run of words that an item of 5 to 12 words keeps, however its differing words lie."""
    agree = math.ceil(AGREE * n - 1e-9)
    return "1" * -(-agree // (n - agree + 1))


def build_index(items: list[tuple[object, str]]) -> dict:
    """Seed hash -> (item, place); items of less than 13 words have a seed of their own, by their length."""
    words = list(rows_of(pa.array([t for _, t in items], pa.string()), ALNUM))
    h, item, place = [], [], []
    short = sorted({short_seed(len(w)) for w in words if LEAST <= len(w) < WORDS})
    for i, w in enumerate(words):
        if len(w) < LEAST:
            continue
        for s in [short_seed(len(w))] if len(w) < WORDS else SEEDS:
            got = seed_hashes(w, s)
            h.append(got)
            item.append(np.full(len(got), i, np.int64))
            place.append(np.arange(len(got)))
    h, item, place = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((h, np.uint64), (item, np.int64), (place, np.int64)))
    order = np.argsort(h, kind="stable")
    sieve = np.zeros(1 << 21, bool)
    sieve[(h >> np.uint64(43)).astype(np.int64)] = True
    return {"ids": [i for i, _ in items], "words": words, "h": h[order], "item": item[order], "place": place[order], "sieve": sieve, "seeds": (*SEEDS, *short)}


def best_passage(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(start in doc, words, agreeing words) of a passage on one diagonal, if any counts: the one that pays best, or if
    that doesn't count the longest that does, rid of differing words at its ends as far as the least length allows."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    same = doc[lo + shift : hi + shift] == item[lo:hi]
    least = min(WORDS, len(item))
    if np.count_nonzero(same) < AGREE * least - 1e-9:
        return None
    total = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -MISMATCH))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    begin = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    if end - begin < least or int(same[begin:end].sum()) < AGREE * (end - begin):
        share = np.concatenate([[0], np.cumsum(np.where(same, ALLOWED[0], -ALLOWED[1]))])  # no less at the end than at the start: enough agree
        first = np.searchsorted(-np.minimum.accumulate(share), -share)
        end = int(np.argmax(np.arange(len(share)) - first))
        begin = int(first[end])
        if end - begin < least:
            return None
        while end - begin > least and not same[begin]:
            begin += 1
        while end - begin > least and not same[end - 1]:
            end -= 1
    return lo + shift + begin, end - begin, int(same[begin:end].sum())


def diagonals(words: np.ndarray, index: dict) -> np.ndarray:
    """(item, shift) of every seed hit, each once, in order. Repeated words hit one diagonal many times: hits are made a
    bounded number at a time and told apart at once."""
    found = [np.zeros(0, np.int64)]
    for seed in index["seeds"]:
        h = seed_hashes(words, seed)
        at = np.flatnonzero(index["sieve"][(h >> np.uint64(43)).astype(np.int64)])
        left, right = np.searchsorted(index["h"], h[at], "left"), np.searchsorted(index["h"], h[at], "right")
        hit = np.flatnonzero(right > left)
        n, left, at = (right - left)[hit], left[hit], at[hit]
        ends = np.cumsum(n)
        a = 0
        while a < len(n):
            b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + HITS, "right")), a + 1)
            own = n[a:b]
            place = np.repeat(left[a:b] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            shift = np.repeat(at[a:b], own) - index["place"][place]
            found.append(np.unique((index["item"][place] << np.int64(SHIFT_BITS)) + shift + (1 << (SHIFT_BITS - 1))))
            a = b
    key = np.unique(np.concatenate(found))
    return np.stack([key >> np.int64(SHIFT_BITS), (key & ((1 << SHIFT_BITS) - 1)) - (1 << (SHIFT_BITS - 1))], 1)


def overlaps(words: np.ndarray, index: dict) -> dict[int, tuple[int, int, int]]:
    """The best counting passage of each item in one document."""
    out: dict[int, tuple[int, int, int]] = {}
    for item, shift in diagonals(words, index).tolist():
        got = best_passage(words, index["words"][item], shift)
        if got and (item not in out or got[2] > out[item][2]):
            out[item] = got
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block: int):
    """Indexes of the benchmark, each of about `block` characters at most."""
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-size // block)
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()
        yield build_index(sorted(((r["i"], r["t"]) for r in part), key=str))


def _matches(shared, id_name: str, item_type: pa.DataType):
    def run(batches):
        index = shared.value
        for batch in batches:
            for part in small_batches(batch, "text"):
                ids = part.column(part.schema.get_field_index(id_name))
                row, item, got = [], [], []
                for r, w in enumerate(rows_of(part.column(part.schema.get_field_index("text")), ALNUM)):
                    for i, x in overlaps(w, index).items():
                        row.append(r)
                        item.append(index["ids"][i])
                        got.append(x)
                if row:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(item, item_type), *(pa.array([x[k] for x in got], pa.int64()) for k in range(3))], ["id", "item", "start", "words", "agree"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, item, start, words, agree): each row of docs and benchmark item that share a passage, with the best passage.

    Words are alphanumeric runs, A-Z lower-cased. A passage is a run on one diagonal of at least 13 words, or the whole
    item if it has 5 to 12, in which 80% agree. All are found: the seeds hit each such passage, however its differing
    words lie. Of the passage reported, a differing word costs as much as three agreeing ones, so it ends where it stops
    paying, unless it would not count then. start counts words from 0.

    Null texts and ids: a null text matches nothing; null ids are reported as null. Items of fewer than 5 words match
    nothing. Repeated rows are reported each. Empty tables give no rows. No shuffle: the benchmark, taken in blocks of a
    bounded number of characters, is broadcast, one pass over docs for each block.
    """
    sc = docs.sparkSession.sparkContext
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, item {benchmark.schema[item_col].dataType.simpleString()}, start long, words long, agree long"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in _blocks(benchmark, item_col, item_text, block):
        out = out.unionAll(base.mapInArrow(_matches(sc.broadcast(index), "id", to_arrow_type(benchmark.schema[item_col].dataType)), schema))
    return out


def _clean(shared, text_col: str):
    def run(batches):
        index = shared.value
        for batch in batches:
            for part in small_batches(batch, text_col):
                keep = [not overlaps(w, index) for w in rows_of(part.column(part.schema.get_field_index(text_col)), ALNUM)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """docs without the rows that share a passage with a benchmark item; columns as they are, null texts stay."""
    schema = T.StructType(docs.schema.fields)
    for index in _blocks(benchmark, item_col, item_text, block):
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(index), text_col), schema)
    return docs
