"""N-gram Jaccard join: candidates from rare shingles, size-banded tiles, bitmap bounds, exact intersections."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, SHARE, SPACED, by_run, exchanged, free, part_bits, release, rows_of, shingle_hashes, small_batches, written
from .components import verified_components

#: Bytes of text whose shingles travel as one block.
BLOCK = 4 << 20


def class_of(items: np.ndarray) -> int:
    """A 64-bit id of a set of shingles."""
    return int.from_bytes(hashlib.blake2b(items.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_shared(n: np.ndarray | int, percent: int):
    """Shingles that a set of n must share with another set that it links with."""
    return -(-percent * n // 100)


def by_part(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Part and next 32 bits of each hash: two shingles that agree in both count as one when frequencies are counted."""
    return (h >> np.uint64(64 - bits)).astype(np.int32), (h >> np.uint64(32 - bits)).astype(np.uint32)


def _new_block() -> int:
    return uuid.uuid4().int >> 65


_ASKED = "block long, part int, counts binary, hashes binary, id array<{kind}>, th array<long>, n array<long>, cls array<long>, first array<boolean>"


def _asked(k: int, lut: np.ndarray, bits: int, shape: pa.Schema):
    """Blocks of texts -> one row with what they are (part -1) and one row for each part, with the hashes to count there.

    A shingle of several texts of the block is sent once, last, and counts as shared; the others are sent in the order
    of the texts. Texts of a class that this task has sent before are sent no more.
    """

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for t in small_batches(batch, "text", BLOCK):
                sets = [np.unique(shingle_hashes(w, k)) for w in rows_of(t.column(t.schema.get_field_index("text")), lut)]
                cls = [class_of(u) if len(u) else None for u in sets]
                first = []
                for c in cls:
                    first.append(c is not None and c not in seen)
                    seen.add(c)
                block, own = _new_block(), [u for u, f in zip(sets, first, strict=True) if f]
                flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
                text = np.repeat(np.arange(len(own)), [len(u) for u in own])
                order = np.argsort(flat, kind="stable")
                same = flat[order[1:]] == flat[order[:-1]] if len(flat) else np.zeros(0, bool)
                often = np.zeros(len(flat), bool)
                often[order[1:][same]] = often[order[:-1][same]] = True
                known = np.bincount(text[often], minlength=len(own)).astype(np.int32)
                part, low = by_part(flat[~often], bits)
                more_part, more_low = by_part(np.unique(flat[often]), bits)
                text = text[~often]
                out = {c: [] for c in shape.names}
                out["block"].append(block)
                out["part"].append(-1)
                out["counts"].append(known.tobytes())
                out["hashes"].append(None)
                out["id"].append(t.column(t.schema.get_field_index("id")).to_pylist())
                out["th"].append(t.column(t.schema.get_field_index("th")).to_pylist())
                out["n"].append([len(u) for u in sets])
                out["cls"].append(cls)
                out["first"].append(first)
                order = np.argsort(part, kind="stable")
                there = np.unique(np.concatenate([part, more_part]))
                cuts = [np.searchsorted(x, there, side=side) for x in (part[order], more_part) for side in ("left", "right")]
                for p, a, b, c, d in zip(there.tolist(), *cuts, strict=True):
                    at, extra = order[a:b], more_low[c:d]
                    out["block"].append(block)
                    out["part"].append(p)
                    out["counts"].append(np.bincount(text[at], minlength=len(own)).astype(np.int32).tobytes())
                    # what several texts share goes twice, so that it counts as shared everywhere
                    out["hashes"].append(np.concatenate([low[at], extra, extra]).tobytes())
                    for c in ("id", "th", "n", "cls", "first"):
                        out[c].append(None)
                yield pa.RecordBatch.from_pydict(out, shape)
        release()

    return run


def _joined(batches, *columns: str):
    """Rows of all batches, as (values of a column, ...)."""
    out: list[list] = [[] for _ in columns]
    for b in batches:
        for got, c in zip(out, columns, strict=True):
            got += b.column(b.schema.get_field_index(c)).to_pylist()
    return out


def _shared_counts(batches):
    """Of each block's hashes of one part: how many of each text's are also sent by another text."""
    block, part, counts, hashes = _joined(batches, "block", "part", "counts", "hashes")
    if not block:
        return
    low = [np.frombuffer(x, np.uint32) for x in hashes]
    sizes = [len(x) for x in low]
    key = np.concatenate(low).astype(np.uint64) | (np.repeat(np.array(part, np.uint64), sizes) << np.uint64(32))
    del hashes
    order = np.argsort(key, kind="stable")
    shared = np.zeros(len(key), bool)
    same = key[order[1:]] == key[order[:-1]]
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    out, at = [], 0
    for c, size in zip(counts, sizes, strict=True):
        n = np.frombuffer(c, np.int32)
        total = np.concatenate([[0], np.cumsum(shared[at : at + int(n.sum())])])
        ends = np.cumsum(n)
        out.append((total[ends] - total[ends - n]).astype(np.int32).tobytes())
        at += size
    yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(out, pa.binary())], ["block", "counts"])
    del low, key, order, shared, out
    release()


def _eligible(percent: int):
    """The classes of each block that share enough shingles with others to link with any."""

    def run(batches):
        block, counts, n, cls, first = _joined(batches, "block", "counts", "n", "cls", "first")
        total: dict[int, np.ndarray] = {}
        for b, c in zip(block, counts, strict=True):
            got = np.frombuffer(c, np.int32)
            total[b] = total[b] + got if b in total else got
        out: list[int] = []
        for b, sizes, own, sent in zip(block, n, cls, first, strict=True):
            if sizes is not None:
                keep = np.array(sent, bool)
                size = np.array(sizes, np.int64)[keep]
                out += [c for c, ok in zip((c for c, f in zip(own, sent, strict=True) if f), total[b] >= least_shared(size, percent), strict=True) if ok]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["cls"])

    return run


def _sets_sent(k: int, lut: np.ndarray, bits: int, shape: pa.Schema):
    """Blocks of classes -> their sets (part -1) and, for each part, the block's distinct hashes and how many sets have each."""

    def run(batches):
        for batch in batches:
            for t in small_batches(batch, "text", BLOCK):
                sets = [np.unique(shingle_hashes(w, k)) for w in rows_of(t.column(t.schema.get_field_index("text")), lut)]
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                u, c = np.unique(flat, return_counts=True)
                part, low = by_part(u, bits)
                has, at = np.unique(part, return_index=True)
                cuts, block, has = dict(zip(has.tolist(), np.append(at, len(part))[1:].tolist(), strict=True)), _new_block(), has.tolist()
                at = dict(zip(has, at.tolist(), strict=True))
                rows = {"block": [block] * (len(has) + 1), "part": [-1, *has]}
                rows["counts"] = [np.array([len(s) for s in sets], np.int32).tobytes(), *(c[at[p] : cuts[p]].astype(np.int32).tobytes() for p in has)]
                rows["hashes"] = [flat.tobytes(), *(low[at[p] : cuts[p]].tobytes() for p in has)]
                rows["cls"] = [t.column(t.schema.get_field_index("cls")).to_pylist(), *(None for _ in has)]
                yield pa.RecordBatch.from_pydict(rows, shape)

    return run


def frequency_code(c: np.ndarray) -> np.ndarray:
    """0 for one set, and a code that grows with the number of sets."""
    return np.where(c < 2, 0, np.minimum(1 + np.round(8 * np.log2(np.maximum(c, 1))), 255)).astype(np.uint8)


def _frequencies(batches):
    """Of each block's hashes of one part: the code of how many sets of all blocks have it."""
    block, part, counts, hashes = _joined(batches, "block", "part", "counts", "hashes")
    if not block:
        return
    low = [np.frombuffer(x, np.uint32) for x in hashes]
    sizes = [len(x) for x in low]
    key = np.concatenate(low).astype(np.uint64) | (np.repeat(np.array(part, np.uint64), sizes) << np.uint64(32))
    u, at = np.unique(key, return_inverse=True)
    code = frequency_code(np.bincount(at, np.concatenate([np.frombuffer(c, np.int32) for c in counts]), len(u)))[at]
    ends = np.cumsum(sizes)
    out = [code[e - s : e].tobytes() for e, s in zip(ends, sizes, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(part, pa.int32()), pa.array(out, pa.binary())], ["block", "part", "counts"])


def prefix_of(items: np.ndarray, percent: int, code: np.ndarray) -> np.ndarray:
    """Where the n - ceil(percent/100 * n) + 1 rarest shingles of a sorted set stand, by one order that all sets share.

    Sets that link have an overlap of at least percent/100 of either size, so that their prefixes meet.
    """
    n = len(items)
    return np.argsort(code, kind="stable")[: n - least_shared(n, percent) + 1 if n else 0]


def _prefixes(percent: int):
    """Per block: its sets and the codes from all parts -> the shared shingles of each class's prefix."""

    def run(batches):
        block, part, counts, hashes, cls = _joined(batches, "block", "part", "counts", "hashes", "cls")
        codes: dict[int, list] = {}
        for b, p, c in zip(block, part, counts, strict=True):
            if p >= 0:
                codes.setdefault(b, []).append((p, c))
        for b, p, c, h, own in zip(block, part, counts, hashes, cls, strict=True):
            if p >= 0:
                continue
            flat, n = np.frombuffer(h, np.uint64), np.frombuffer(c, np.int32)
            u = np.unique(flat)
            code = np.frombuffer(b"".join(x for _, x in sorted(codes.get(b, []))), np.uint8)[np.searchsorted(u, flat)]
            out, ids, size, at = [], [], [], 0
            for m, i in zip(n.tolist(), own, strict=True):
                k, f = code[at : at + m], flat[at : at + m]
                if np.count_nonzero(k) >= least_shared(m, percent):
                    first = prefix_of(f, percent, k)
                    out.append(f[first[k[first] > 0]].view(np.int64))
                    ids.append(i)
                    size.append(m)
                at += m
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))], ["id", "n", "keys"])

    return run


def candidate_edges(keys: DataFrame, percent: int, tag: str) -> DataFrame:
    """Edges that connect all sets of one key whose sizes may link, from keys(id long, n long, key long).

    Sizes fall into bands of ratio 100/percent, so sets that link lie in the same band or the next. Each set is tied to
    the smallest of its key and band, and this one to that of the next band: no more edges than rows. Minima are taken
    before the shuffle, and a hot key meets its minimum in a join that Spark may split.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)) * 1.0000001)).cast("int")
    own = keys.select("id", "key", band.alias("band"))
    low = written(own.groupBy("key", "band").agg(F.min("id").alias("low"), F.max("id").alias("high")), tag)
    inside = own.join(low.where("low < high"), ["key", "band"]).select(F.col("id").alias("a"), F.col("low").alias("b"))
    up = low.select("key", (F.col("band") - 1).alias("band"), F.col("low").alias("a"))
    edges = written(inside.unionAll(up.join(low, ["key", "band"]).select("a", F.col("low").alias("b"))).where("a <> b").distinct(), tag)
    free(low)
    return edges


def _sets(k: int, lut: np.ndarray):
    """Texts, as bytes -> their sorted sets of shingles."""

    def make(texts: list[bytes]) -> list[np.ndarray]:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_binary()).view(pa.large_string())], ["text"])
        return [np.unique(shingle_hashes(w, k).view(np.int64)) for part in small_batches(batch, "text") for w in rows_of(part.column(0), lut)]

    return make


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, words: str = "spaced", share: int = SHARE, tile: int | None = None, tasks: int | None = None) -> DataFrame:
    """Near-duplicate components of documents under the exact Jaccard similarity of k-word shingle sets.

    Returns one row for each row of docs: id, th (hash of the text), n_shingles, cls (id of the set of shingles) and
    component (smallest id that the row reaches by links, its own included). words: "spaced" (runs of anything but
    ASCII white space) or "alnum" (punctuation apart); A-Z are lower-cased.

    Method. Equal sets collapse to one class. All shingles of the corpus are counted in an exchange of packed hashes,
    and a class stays only if it shares as many shingles with others as a link needs; most classes end here, without
    any pair. The shingles of those that stay are counted again, and a class is indexed under the rarest of its shingles
    (prefix filter, exact frequencies). Classes of one key whose sizes may link form candidate clusters, which are cut
    into size-banded tiles, in which bitmaps bound each overlap from above and sorted arrays are intersected exactly
    (components.link_tile). No link is lost. Texts move once, those of the classes that stay.

    Nulls and edges: a null text counts as empty; an empty set links with nothing, its component is the row's own id.
    A null id is never the smallest: such a row gets the smallest id of its component, or null. Repeated rows are equal
    sets and thus linked; rows of one id but different texts are told apart. An empty table gives no rows. Further
    columns of docs, whatever their names, are ignored. Texts of any length are processed whole, a few MB at a time.
    Shingles and sets of shingles are told apart by 64-bit hashes.
    """
    lut = {"spaced": SPACED, "alnum": ALNUM}[words]
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    bits = part_bits(base, share)
    asked = _ASKED.format(kind=docs.schema[id_col].dataType.simpleString())
    asked = written(base.mapInArrow(_asked(k, lut, bits, _arrow(docs, asked)), asked), "asked")
    rows = asked.where("part = -1").select(F.explode(F.arrays_zip("id", "th", "n", "cls")).alias("r")).select("r.*")
    rows = written(rows, "rows")
    answers = exchanged(asked.where("part >= 0").select("block", "part", "counts", "hashes"), bits, _shared_counts, "block long, counts binary", tasks)
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("n", "array<long>"), ("cls", "array<long>"), ("first", "array<boolean>"))]
    told = asked.where("part = -1").select("block", "counts", "n", "cls", "first").unionAll(answers.select("block", "counts", *blank))
    stay = written(told.repartition("block").sortWithinPartitions("block").mapInArrow(by_run(_eligible(percent), "block"), "cls long").distinct(), "stay")
    free(asked)
    stand = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th"))  # one document of each class stands for it
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("low"), stand.alias("s"))
    classes = written(classes.select("cls", "low", F.col("s.id").alias("did"), F.col("s.th").alias("dth")), "classes")
    text = base.join(classes.join(stay, "cls").select("cls", "did", "dth"), F.col("id").eqNullSafe(F.col("did")) & (F.col("th") == F.col("dth")))
    text = written(text.groupBy("cls").agg(F.first("text").alias("text")), "texts")  # rows may repeat
    free(stay)
    bits, sent = part_bits(text, share), "block long, part int, counts binary, hashes binary, cls array<long>"
    sent = written(text.mapInArrow(_sets_sent(k, lut, bits, _arrow(docs, sent)), sent), "sets")
    codes = exchanged(sent.where("part >= 0"), bits, _frequencies, "block long, part int, counts binary", tasks)
    told = sent.where("part = -1").unionAll(codes.select("block", "part", "counts", F.lit(None).cast("binary").alias("hashes"), F.lit(None).cast("array<long>").alias("cls")))
    keys = written(told.repartition("block").sortWithinPartitions("block").mapInArrow(by_run(_prefixes(percent), "block"), "id long, n long, keys array<long>"), "prefixes")
    free(sent)
    edges = candidate_edges(keys.select("id", "n", F.explode("keys").alias("key")), percent, "edges")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return wanted.join(text.select(F.col("cls").alias("id"), F.col("text").cast("binary").alias("items")), "id")  # texts take less room than their sets

    sized = {} if tile is None else {"tile": tile}
    found = written(verified_components(keys.select("id", "n", F.col("n").alias("w")), edges, sets_of, percent, "tiles", make=_sets(k, lut), **sized), "found")
    free(text, keys, edges)
    found = classes.select("cls", "low").join(found.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = found.groupBy("component").agg(F.min("low").alias("least"))
    found = written(found.join(least, "component").select("cls", F.col("least").alias("component")), "labels")
    free(classes)
    return rows.select("id", "th", F.col("n").alias("n_shingles"), "cls").join(found, "cls", "left").select("id", "th", "n_shingles", "cls", F.coalesce("component", "id").alias("component"))


def _arrow(docs: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each near-duplicate component: that of the smallest id, then of the smallest text hash.

    Rows without words, and rows of null id that link with no other id, all stay. Of rows that agree in id and text, all
    stay or none.
    """
    found = ngram_jaccard_join(docs, id_col, text_col, k, percent)
    grouped = found.where("component is not null and cls is not null")
    first = grouped.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "th")).alias("f"))
    lost = grouped.join(first, "component").where(~(F.col("id").eqNullSafe(F.col("f.id")) & (F.col("th") == F.col("f.th")))).select(F.col("id").alias("_lx_id"), F.col("th").alias("_lx_th")).distinct()
    return docs.join(lost, docs[id_col].eqNullSafe(lost["_lx_id"]) & (F.xxhash64(docs[text_col]) == lost["_lx_th"]), "left_anti")
