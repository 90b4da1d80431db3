"""Fuzzy line dedup: MinHash over character shingles, high-recall banding, exact Jaccard, distributed union-find."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SHARE, exchanged, free, fresh, mix64, part_bits, release, small_batches, span_hashes, without, written
from .components import verified_components

#: Characters of a shingle, rows of a band and bands: at similarity 0.8 all bands miss with chance (1 - 0.8^6)^16 = 0.8%. Unlike
#: lines of similarity s meet in a band with chance s^6; with fewer rows bands of unlike lines grow with the input.
CHARS, ROWS, BANDS = 5, 6, 16
#: Lines of one batch, and of all batches, from which a band key counts as hot: its lines are tied to the smallest of them
#: at once, and the exact check decides about all of them.
HOT_BATCH, HOT = 64, 20_000
#: Bins of the signature that bands are made of.
SLOTS = 128
#: Bins of the gate, each with a two-bit code (0: empty), and how many codes two lines of one band must share. A bin
#: whose codes differ holds a shingle that the lines don't share, so no more bins differ than `unlike` allows; of lines with
#: so many shingles that this is above 18, at similarity 0.8 more than 18 bins differ with chance 0.1% at most.
BINS, CODES = 64, 46
#: Pairs of codes that are compared at once.
PAIRS = 1 << 20
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _whole(batches) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got) if got else None


def fold_line(line: str) -> str:
    """Lines are compared lower-cased (A-Z) and with each run of ASCII white space as one space, none at the ends."""
    return b" ".join(line.encode("utf-8", "replace").lower().split()).decode("utf-8", "replace")


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 11, 12, 13]] = 32
#: Other values of bytes, for the second half of a line's key.
_OTHER = (mix64(np.arange(1, 257, dtype=np.uint64)) & np.uint64(255)).astype(np.uint8)


def folded_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All lines of all texts that aren't blank, folded as by fold_line: text and number of each, bytes, starts and ends."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data = _FOLD[np.insert(data, offsets[1:], 10)]  # each text ends a line
    ends_text = np.cumsum(data == 10)[offsets[1:] + np.arange(len(texts))]
    lines = np.diff(ends_text, prepend=0)
    text, number = np.repeat(np.arange(len(texts)), lines), np.arange(lines.sum()) - np.repeat(ends_text - lines, lines)
    space = data == 32
    data = data[~(space & np.concatenate([[True], (space | (data == 10))[:-1]]))]
    data = data[~((data == 32) & np.concatenate([data[1:] == 10, [True]]))] if len(data) else data
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    some = ends > starts
    return text[some], number[some], data, starts[some], ends[some]


def char_hashes(lines: list[str], k: int = CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-character shingles (the whole line if shorter) of all lines, and the line of each."""
    return code_hashes(np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(x) for x in lines], np.int64), k)


def code_hashes(code: np.ndarray, lens: np.ndarray, k: int = CHARS) -> tuple[np.ndarray, np.ndarray]:
    """char_hashes of lines of so many code points that stand one after another."""
    code = code.astype(np.uint64) + np.uint64(1)
    n = np.maximum(lens - k + 1, (lens > 0).astype(np.int64))
    line, first = np.repeat(np.arange(len(lens)), n), np.cumsum(lens) - lens
    starts = np.ones(len(code), bool)  # where a shingle starts
    starts[((first + lens)[lens >= k, None] - np.arange(1, k)).ravel()] = False
    with np.errstate(over="ignore"):
        whole = np.full(len(code), np.uint64(k), np.uint64)
        full = whole[: max(len(code) - k + 1, 0)]
        for j in range(k):
            full *= np.uint64(0x100000001B3)
            full += code[j : len(full) + j]
        for i in np.flatnonzero((lens > 0) & (lens < k)):
            short = np.uint64(lens[i])
            for c in code[first[i] : first[i] + lens[i]]:
                short = short * np.uint64(0x100000001B3) + c
            whole[first[i]] = short
            starts[first[i] + 1 : first[i] + lens[i]] = False
        return mix64(whole[starts]), line


def least(h: np.ndarray, line: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """One-permutation MinHash: the least value in each of the bins, NONE in empty ones."""
    out = np.full(n * bins, NONE, np.uint64)
    np.minimum.at(out, line * bins + (h & np.uint64(bins - 1)).astype(np.int64), h >> np.uint64(bins.bit_length() - 1))
    return out.reshape(n, bins)


def halved(own: np.ndarray) -> np.ndarray:
    """The least values in half as many bins."""
    half = own.shape[1] // 2
    low, high = own[:, :half], own[:, half:]
    return np.minimum(np.where(low == NONE, NONE, low << np.uint64(1)), np.where(high == NONE, NONE, (high << np.uint64(1)) | np.uint64(1)))


def signatures(own: np.ndarray) -> np.ndarray:
    """The least values of the bins that bands are made of; an empty one takes that of the first bin of its row of DONORS
    that isn't empty, so that bins of one band seldom take the same value."""
    out = own[:, : ROWS * BANDS].copy()
    row, col = np.nonzero(out == NONE)
    for donors in DONORS:
        got = own[row, donors[col]]
        out[row, col] = got
        row, col = row[got == NONE], col[got == NONE]
        if not len(row):
            return out
    out[row, col] = own[row].min(1)
    return out


#: Bins from which each empty bin takes its value, one after another.
DONORS = (mix64(np.arange(1, 64 * SLOTS + 1, dtype=np.uint64)) % np.uint64(SLOTS)).astype(np.int64).reshape(64, SLOTS)


def band_keys(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), 1))
        for r in range(ROWS):
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) ^ sig[:, r : ROWS * BANDS : ROWS])
    return keys.view(np.int64)


def codes(own: np.ndarray) -> np.ndarray:
    """Two bits of each bin's own value, 0 only where it is empty, in two longs for each line."""
    two = np.where(own == NONE, np.uint64(0), mix64(own) % np.uint64(3) + np.uint64(1)).reshape(len(own), 2, BINS // 2)
    return np.bitwise_or.reduce(two << (2 * np.arange(BINS // 2, dtype=np.uint64)), axis=2)


def agreeing(code: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Number of bins whose codes agree."""
    x = code ^ others
    return BINS - np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(-1, dtype=np.int64)


def unlike(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """In how many bins lines of so many shingles may differ if at least percent of all their shingles are shared."""
    return np.minimum((a + b) * (100 - percent) // (100 + percent), BINS - CODES)


def across(code: np.ndarray, n: np.ndarray, group: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A pair of rows whose codes agree enough for each two groups that have one and aren't joined by earlier pairs."""
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
    groups = sorted((order[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)), key=len)
    up, out = list(range(len(groups))), []

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    where = np.empty(len(group), np.int64)
    for g, rows in enumerate(groups):
        where[rows] = g
    for g, rows in enumerate(groups[:-1]):
        rest = np.concatenate([r for k, r in enumerate(groups[g + 1 :], g + 1) if root(k) != root(g)] or [rows[:0]])
        step = max(1, PAIRS // max(len(rest), 1))
        for lo in range(0, len(rows), step):
            own = rows[lo : lo + step, None]
            near = BINS - agreeing(code[own], code[rest]) <= unlike(n[own], n[rest], percent)
            for x in np.flatnonzero(near.any(0)):
                k = int(where[rest[x]])
                if root(k) != root(g):
                    up[root(k)] = root(g)
                    out.append((int(own[np.argmax(near[:, x]), 0]), int(rest[x])))
            if out:
                rest = rest[[root(int(k)) != root(g) for k in where[rest]]]
    return out


def _hot(key: np.ndarray, i: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Which entries of (key, i), sorted by key, are of a key with more than `most`, and the least i of each key."""
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(cuts, len(key)))
    return np.repeat(size > most, size), np.repeat(np.minimum.reduceat(i, cuts) if len(cuts) else i, size)


def _dealt(key: np.ndarray, i: np.ndarray, bits: int) -> dict[int, bytes]:
    """Lines' band keys as packed entries of each part: the 32 bits of the key after those of the part, then the line; part -1
    has edges of keys that are hot here."""
    key = key.view(np.uint64) >> np.uint64(32 - bits)
    order = np.argsort(key)
    key, i = key[order], i[order]
    hot, first = _hot(key, i, HOT_BATCH)
    star = hot & (i != first)
    out = {-1: np.stack([i[star], first[star]]).tobytes()}
    key, i = key[~star], i[~star]
    there, first = np.unique((key >> np.uint64(32)).astype(np.int64), return_index=True)
    for p, a, b in zip(there.tolist(), first.tolist(), np.append(first, len(key))[1:].tolist(), strict=True):
        out[p] = key[a:b].astype(np.uint32).tobytes() + i[a:b].tobytes()
    return out


def _edges_of(batches):
    for batch in batches:
        for data in batch.column(0).to_pylist():
            a, b = np.frombuffer(data, np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _met(batches):
    """(band, id, to): the entries of band keys that several lines have; those of hot keys with the line they are tied to."""
    keys, lines = [], []
    for b in batches:
        for p, x in zip(b.column(b.schema.get_field_index("part")).to_pylist(), b.column(b.schema.get_field_index("data")).to_pylist(), strict=True):
            n = len(x) // 12
            keys.append(np.frombuffer(x, np.uint32, n).astype(np.int64) | (p << 32))
            lines.append(np.frombuffer(x, np.int64, n, 4 * n))
    if not keys:
        return
    key, i = np.concatenate(keys), np.concatenate(lines)
    del keys, lines
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]  # most keys have one entry
    order = order[np.lexsort((i[order], key[order]))]
    key, i = key[order], i[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1])]) if len(key) else np.zeros(0, bool)
    key, i = key[new], i[new]
    several, first = _hot(key, i, 1)
    hot, _ = _hot(key, i, HOT)
    key, i, to, hot = key[several], i[several], first[several], hot[several]
    for lo in range(0, len(key), 1 << 16):
        own = slice(lo, lo + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(i[own]), pa.array(to[own], mask=~hot[own])], ["band", "id", "to"])
    del key, i, to, hot
    release()


def band_edges(batches, percent: int = 80):
    """(band, id, code, n) of whole bands -> edges that connect lines of one band wherever the codes of two agree enough.

    Within a band each leader is compared with all lines, and lines that a leader reaches don't lead, so that a group of
    like lines costs one comparison for each line. Then led lines are compared with those of the band's other groups.
    """
    if (t := _whole(batches)) is None:
        return
    band, i = t.column("band").to_numpy(), t.column("id").to_numpy()
    order = np.argsort(band)
    same = band[order[1:]] == band[order[:-1]]
    order = np.sort(order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]) if len(band) else order
    order = order[np.lexsort((i[order], band[order]))]  # without the bands that hold one line
    band, i = band[order], i[order]
    code, n = np.stack([t.column(c).to_numpy().view(np.uint64)[order] for c in ("code", "code2")], 1), t.column("n").to_numpy().astype(np.int64)[order]
    cuts = np.concatenate([[0], np.flatnonzero(band[1:] != band[:-1]) + 1, [len(band)]]) if len(band) else np.zeros(1, np.int64)
    lo, hi, led, a, b = cuts[:-1], cuts[1:], np.zeros(len(band), bool), [i[:0]], [i[:0]]
    leader, group, links, bands = lo, np.full(len(band), -1), [], np.stack([lo, hi], 1)
    while len(lo):  # the next leader of every band that has one
        size = hi - lo
        begin = np.cumsum(size) - size
        row = np.arange(size.sum()) + np.repeat(lo - begin, size)
        own = np.repeat(leader, size)
        near = (BINS - agreeing(code[own], code[row]) <= unlike(n[own], n[row], percent)) & (row != own)
        led[row[near]] = True
        again = near & (group[row] >= 0)
        links.append(np.stack([group[row[again]], own[again]], 1))  # a line that two leaders reach joins their groups
        group[row[near & ~again]] = own[near & ~again]
        a.append(i[row[near]])
        b.append(i[own[near]])
        leader = np.minimum.reduceat(np.where(~led[row] & (row > own), row, len(led)), begin)
        more = leader < hi - 1
        lo, hi, leader = lo[more], hi[more], leader[more]
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    for x, y in np.unique(np.concatenate(links), axis=0).tolist() if links else []:
        if (x := root(x)) != (y := root(y)):
            up[max(x, y)] = min(x, y)
    if len(bands):  # those whose led lines are of several groups
        bands = bands[np.minimum.reduceat(np.where(led, group, len(led)), bands[:, 0]) < np.maximum.reduceat(np.where(led, group, -1), bands[:, 0])]
    for lo, hi in bands.tolist():
        rows = lo + np.flatnonzero(led[lo:hi])
        of = np.array([root(x) for x in group[rows].tolist()])
        if (of != of[0]).any() and (more := across(code[rows], n[rows], of, percent)):
            a.append(i[rows[[x for x, _ in more]]])
            b.append(i[rows[[y for _, y in more]]])
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
    del t, band, i, order, code, n
    release()



def _lines(bits: int, shape: pa.Schema):
    """Texts -> a row for each line that isn't blank, with its two hashes; once for equal ones of a batch, with its number
    of shingles and its codes, and in packed band entries."""

    def run(batches):
        for batch in batches:
            for part in small_batches(batch, "text", 1 << 20):
                where, number, data, starts, ends = folded_lines(part.column(part.schema.get_field_index("text")))
                if not len(where):
                    continue
                one, two = span_hashes(data, starts, ends).view(np.int64), span_hashes(_OTHER[data], starts, ends).view(np.int64)
                lids, at = np.unique(one, return_index=True)
                chars = np.cumsum((data & 0xC0) != 0x80) - ((data & 0xC0) != 0x80)  # code points before each byte
                chars = np.append(chars, chars[-1] + 1)
                keep = np.zeros(len(one), bool)
                keep[at] = True
                inside = np.zeros(len(data) + 1, np.int8)
                np.add.at(inside, starts[keep], 1)
                np.add.at(inside, ends[keep], -1)
                body = data[np.cumsum(inside[:-1], dtype=np.int8) > 0].tobytes().decode()
                h, line = code_hashes(np.frombuffer(body.encode("utf-32-le"), np.uint32), (chars[ends] - chars[starts])[keep])
                own = least(h, line, int(keep.sum()), SLOTS)
                dealt = _dealt(band_keys(signatures(own)).ravel(), np.repeat(one[keep], BANDS), bits)
                own = halved(own)
                row = part.select(["id", "th"]).take(pa.array(where))
                blank = len(dealt)
                code, n = np.zeros((len(one), 2), np.int64), np.zeros(len(one), np.int64)
                code[keep], n[keep] = codes(own).view(np.int64), np.bincount(line, minlength=len(own))
                columns = [row.column(row.schema.get_field_index("id")), row.column(row.schema.get_field_index("th")), pa.array(number.astype(np.int32)), pa.array(one), pa.array(two)]
                columns += [pa.array(x, mask=~keep) for x in (n, code[:, 0], code[:, 1])]
                columns = [pa.concat_arrays([x.cast(shape.field(n).type), pa.nulls(blank, shape.field(n).type)]) for n, x in enumerate(columns)]
                columns.append(pa.concat_arrays([pa.nulls(len(where), pa.int32()), pa.array(list(dealt), pa.int32())]))
                columns.append(pa.concat_arrays([pa.nulls(len(where), pa.binary()), pa.array(list(dealt.values()), pa.binary())]))
                yield pa.RecordBatch.from_arrays(columns, schema=shape)
        release()

    return run


def line_sets(folded: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingles of each folded line."""
    h, line = char_hashes(folded)
    h = h.view(np.int64)
    cuts = np.searchsorted(line, np.arange(len(folded) + 1)).tolist()
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        h[lo:hi].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    h, cuts = h[new], np.searchsorted(line[new], np.arange(len(folded) + 1)).tolist()
    return [h[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def _wanted(batches):
    """Texts with the wanted lines -> (id, items): the folded lines."""
    for batch in batches:
        for part in small_batches(batch, "text", 1 << 20):
            ids, items = [], []
            for text, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                lines = text.split("\n")
                for w in wanted:
                    ids.append(w["lid"])
                    items.append(fold_line(lines[w["line"]]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.string())], ["id", "items"])


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, share: int = SHARE, tasks: int | None = None) -> DataFrame:
    """Lines to drop: (id, th, line), th being the hash of the row's text and line its number from 0.

    Lines (split at \\n) are compared by the sets of their 5-character shingles after fold_line; blank lines take no
    part. Equal lines (by a hash of 128 bits) are one. MinHash bands, dealt out as packed entries, and a gate of bin
    codes propose clusters, in which every pair is decided exactly (Jaccard of percent/100 or more) or already
    connected; of each connected component the line of the smallest (id, text hash, number) stays, null ids last.
    """
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    bits = part_bits(base, share)
    shape = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string("th long, line int, lid long, more long, n long, code long, code2 long, part int, data binary").fields])
    both = written(base.where("text is not null").mapInArrow(_lines(bits, to_arrow_schema(shape)), shape), "lines")
    lines, coded, dealt = both.where("part is null").select("id", "th", "line", "lid", "more"), both.where("n is not null").select(F.col("lid").alias("id"), "n", "code", "code2"), both.where("part is not null").select("part", "data")
    met = exchanged(dealt.where("part >= 0"), bits, _met, "band long, id long, to long", tasks)
    met = written(met, "met")
    ties = dealt.where("part < 0").select("data").mapInArrow(_edges_of, "a long, b long").unionAll(met.where("to is not null and id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")))
    coded = written(coded.groupBy("id").agg(F.first("n").alias("n"), F.first("code").alias("code"), F.first("code2").alias("code2")), "codes")
    like = met.where("to is null").select("band", "id").join(coded, "id")
    edges = written(like.repartition("band").mapInArrow(partial(band_edges, percent=percent), "a long, b long").unionAll(ties).distinct(), "edges")
    free(met)
    some = edges.select(F.explode(F.array("a", "b")).alias("_lid")).distinct()
    place = F.struct(F.col("id").isNull().alias("none"), "id", "th", "line")
    one = lines.join(some, F.col("lid") == F.col("_lid")).groupBy("lid").agg(F.min(place).alias("p"))
    one = one.groupBy(F.col("p.id").alias("_id"), F.col("p.th").alias("_th")).agg(F.collect_list(F.struct("lid", F.col("p.line").alias("line"))).alias("wanted"))
    text = base.join(written(one, "wanted"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("text", "wanted")
    items = written(text.mapInArrow(_wanted, "id long, items string").dropDuplicates(["id"]), "items")  # rows may repeat

    def sets_of(wanted: DataFrame) -> DataFrame:
        return wanted.join(items, "id")

    linked = written(verified_components(coded.select("id", F.lit(1).cast("long").alias("n"), F.col("n").alias("w")), edges, sets_of, percent, "linetiles", make=line_sets), "linked")
    free(items, edges, coded)
    again = lines.groupBy("lid").agg(F.count("*").alias("times")).where("times > 1").select("lid")
    groups = again.join(linked.withColumnRenamed("id", "lid"), "lid", "full")
    mine = lines.join(written(groups, "groups"), "lid")
    mine = mine.select("id", "th", "line", F.coalesce("component", "lid").alias("g"), F.when(F.col("component").isNull(), F.col("more")).otherwise(0).alias("h"))
    mine = written(mine, "mine")
    kept = written(mine.groupBy("g", "h").agg(F.min(place).alias("kept")), "heads")  # read back, the join's hot groups can be split
    free(both)
    out = mine.join(kept, ["g", "h"])
    return out.where(~(F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("th") == F.col("kept.th")) & (F.col("line") == F.col("kept.line")))).select("id", "th", "line")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """docs with text_col rid of duplicate lines, plus _lx_lines and _lx_dropped (numbers of lines before and dropped).

    Every row stays, also if all its lines were duplicates (its text is then empty). A null text stays null and has no
    lines; an empty text has one blank line, which stays. Rows that agree in id and text count as one row: each keeps
    what that row keeps. Rows of null id take part. Other columns are passed on; columns of docs named
    _lx_lines or _lx_dropped give way to these.
    """
    docs, gone, drop_id, drop_th = without(docs, "_lx_lines", "_lx_dropped"), fresh("gone"), fresh("id"), fresh("th")
    drop = duplicate_lines(docs, id_col, text_col, percent).distinct().groupBy("id", "th").agg(F.array_sort(F.collect_list("line")).alias(gone)).withColumnsRenamed({"id": drop_id, "th": drop_th})
    drop = written(drop, "drop")
    out = docs.join(drop, docs[id_col].eqNullSafe(drop[drop_id]) & (F.xxhash64(docs[text_col]) == drop[drop_th]), "left")
    parts, d = F.split(F.col(text_col), "\n", -1), F.col(gone)

    def between(lines: Column, i: Column) -> Column:
        """The lines from after the dropped line before place i up to the one at it."""
        before = F.coalesce(F.get(d, i - 1), F.lit(-1))
        return F.slice(lines, before + 2, F.coalesce(F.get(d, i), F.size(lines)) - before - 1)

    # bound to a name, the lines are split once
    rest = F.element_at(F.transform(F.array(parts), lambda p: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(d)), lambda i: between(p, i))), "\n")), 1)
    out = out.withColumn("_lx_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).cast("long")).withColumn("_lx_dropped", F.when(d.isNull(), 0).otherwise(F.size(d)).cast("long"))
    return out.withColumn(text_col, F.when(d.isNull(), F.col(text_col)).otherwise(rest)).drop(gone, drop_id, drop_th)
