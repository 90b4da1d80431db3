"""LM scoring: a hashed maximum-entropy model with a class-factored softmax in two levels, over exact counts of the whole corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, free, mix64, most_frequent, release, small_batches, span_hashes, word_bounds, written

#: Classes of words (by their last two bytes; the last class is the end of a text) and parts of a class (by a hash of the
#: word); feature templates; bits of a hashed context of each template; tokens that are scored at once.
CLASSES, PARTS, TEMPLATES, BITS, STEP = 32, 32, 3, 15, 4096
#: Synchronous gradient steps over all learnt tokens: until the loss of texts kept apart (one in APART) falls by less than
#: LEAST in log10 a token, ROUNDS at most.
ROUNDS, LEAST, APART = 8, 0.01, 16
#: The share of the step that counts alone call for which each template takes at the start, the pull of each weight towards
#: the start without context, and the largest weight.
SHARE, PULL, LARGEST = 0.5, 4.0, 12.0
#: Learnt tokens of one task of a gradient step, so that the number of sums (of fixed size) follows the input and no task
#: grows with it; sums that are added in one task at most.
TASK_TOKENS, ADDED = 1 << 23, 32
#: Bits of a unit of expectation, and bytes of text whose features are made at once.
UNITS, AT_ONCE = 10, 2 << 20
#: Rows of weights that are summed as one block.
ROWS = 128
#: How many of the most frequent words have their counts sent to every task at most; all other words' counts are joined.
HEAD = 1 << 18
#: Hash of the end of a text.
END = np.uint64(0x5851F42D4C957F2D)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, class and part of every token of all texts, ends included, and the number of tokens of each text."""
    data, starts, ends, counts = word_bounds(texts, SPACED)
    h = span_hashes(data, starts, ends)
    last = data[ends - 1].astype(np.int64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    cls = ((last * 256 + before) * 2654435761 >> 7) % (CLASSES - 1)
    part = (mix64(h ^ np.uint64(0x1234567)) >> np.uint64(20)).astype(np.int64) % PARTS
    stops = np.cumsum(counts)
    return np.insert(h, stops, END), np.insert(cls, stops, CLASSES - 1), np.insert(part, stops, 0), counts + 1


def contexts(h: np.ndarray, cls: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two weight matrices that each token switches on: by the previous word, the previous two and the one before
    (skip); for parts each together with the token's class. One array of TEMPLATES rows a matrix."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    one, two = np.roll(h, 1), np.roll(h, 2)
    one[place < 1] = 1
    two[place < 2] = 2
    with np.errstate(over="ignore"):
        feats = (mix64(one), mix64(one * np.uint64(31) ^ mix64(two)), mix64(two + np.uint64(77)))
        of = (cls.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        rows = lambda f, i: (f >> np.uint64(64 - BITS)).astype(np.int64) + (i << BITS)
        return np.stack([rows(f, i) for i, f in enumerate(feats)]), np.stack([rows(mix64(f + of), i) for i, f in enumerate(feats)])


def _exponents(w: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Sums of the weights that each token's features switch on; at most TEMPLATES * LARGEST, so that none overflows."""
    s, more = np.empty((2, f.shape[1], w.shape[1]), np.float32)
    np.take(w, f[0], axis=0, out=s, mode="clip")
    for i in range(1, len(f)):
        np.take(w, f[i], axis=0, out=more, mode="clip")
        s += more
    return s


def choice_logs(w: np.ndarray, f: np.ndarray) -> np.ndarray:
    """log P(choice | context) of every choice, a row a token, from sparse active features (templates x tokens)."""
    s = _exponents(w, f)
    return s - np.log(np.exp(s).sum(1, keepdims=True))


def chosen_logs(w: np.ndarray, f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log P of each token's own choice."""
    out = np.empty(len(y))
    for a in range(0, len(y), STEP):
        own = y[a : a + STEP]
        s = _exponents(w, f[:, a : a + STEP])
        out[a : a + STEP] = s[np.arange(len(own)), own]
        out[a : a + STEP] -= np.log(np.exp(s, out=s).sum(1))
    return out


def word_logs(w: np.ndarray, h: np.ndarray, cls: np.ndarray, part: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log P(class | context) + log P(part | class, context) of every token; an end has no parts."""
    by_class, by_part = contexts(h, cls, n)
    out = chosen_logs(w[0], by_class, cls)
    words = np.flatnonzero(cls < CLASSES - 1)
    out[words] += chosen_logs(w[1], by_part[:, words], part[words])
    return out


def seen_sums(out: np.ndarray, f: np.ndarray, y: np.ndarray) -> None:
    """Add how often each choice follows each context."""
    size = 1 << BITS
    for i in range(TEMPLATES):
        out[i << BITS : (i + 1) << BITS] += np.bincount((f[i] - (i << BITS)) * out.shape[1] + y, minlength=size * out.shape[1]).reshape(size, -1)


def expected_sums(out: np.ndarray, f: np.ndarray, w: np.ndarray) -> None:
    """Add how often the model expects each choice after each context (out is choices x rows), in units of 2^-UNITS.

    Expectations are rounded to these units for each token, so that sums are whole numbers and don't depend on their order.
    Two choices are summed at once, one in the lower and one in the upper half of a double's 53 bits.
    """
    size, half, field = 1 << BITS, w.shape[1] // 2, float(1 << 26)
    many = 1 << (26 - UNITS)
    for a in range(0, f.shape[1], many):
        own = f[:, a : a + many]
        p = np.empty((half, own.shape[1]))
        for b in range(0, own.shape[1], STEP):
            s = _exponents(w, own[:, b : b + STEP])
            np.exp(s, out=s)
            s *= np.float32(1 << UNITS) / s.sum(1, keepdims=True)
            np.rint(s, out=s)
            np.multiply(s[:, half:].T, field, out=p[:, b : b + STEP], dtype=np.float64)
            p[:, b : b + STEP] += s[:, :half].T
        for i in range(TEMPLATES):
            at, rows = own[i] - (i << BITS), slice(i << BITS, (i + 1) << BITS)
            for j in range(half):
                both = np.bincount(at, weights=p[j], minlength=size)
                high = np.floor(both / field)
                out[half + j, rows] += high
                out[j, rows] += both - high * field


def start_weights(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights from counts (contexts x choices): each context's shrunken log odds against all tokens, a share of them; and the
    weights without any context."""
    total = seen.sum(0) / TEMPLATES
    prior = (total + 0.5) / (total + 0.5).sum()
    n = seen.sum(1, keepdims=True)
    rest = np.log(prior) / TEMPLATES  # one feature of each template is on
    w = SHARE * (np.log((seen + 8 * prior) / (n + 8)) - np.log(prior)) + rest
    return np.clip(w, -LARGEST, LARGEST).astype(np.float32), rest


def stepped(w: np.ndarray, seen: np.ndarray, expected: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """One gradient step on all weights, each scaled by the curvature that the expectations give."""
    n = seen.sum(1, keepdims=True)
    p = expected / np.maximum(n, 1)
    step = (seen - expected - PULL * (w - rest)) / (TEMPLATES * n * p * (1 - p) + PULL + 1)
    return np.clip(w + np.clip(step, -1, 1), -LARGEST, LARGEST).astype(np.float32)


def _counts(batches):
    for batch in batches:
        for part in small_batches(batch, "text", 8 << 20):
            h, cls, own, _ = tokens(part.column(0))
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            leaf = cls[first] * PARTS + own[first]
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(leaf.astype(np.int32)), pa.array(n.astype(np.int64))], ["h", "leaf", "c"])


def _sums(shared):
    """Sums over one task's texts for both matrices, as blocks of ROWS rows that aren't all 0: of what is seen (without
    weights), or of what the model expects."""

    def run(batches):
        w, rows = None if shared is None else shared.value.astype(np.float32), TEMPLATES << BITS
        if w is None:
            total = [np.zeros((rows, k), np.int64) for k in (CLASSES, PARTS)]
        else:
            total = [np.zeros((k, rows)) for k in (CLASSES, PARTS)]
        some = False
        for batch in batches:
            for part in small_batches(batch, "text", AT_ONCE):
                h, cls, own, n = tokens(part.column(0))
                by_class, by_part = contexts(h, cls, n)
                words = np.flatnonzero(cls < CLASSES - 1)
                some = some or len(h) > 0
                for i, (f, y) in enumerate(((by_class, cls), (by_part[:, words], own[words]))):
                    seen_sums(total[i], f, y) if w is None else expected_sums(total[i], f, w[i])
        if some:
            for i, t in enumerate(total):
                for a in range(0, rows, 64 * ROWS):
                    cut = [(i * rows + b, (t[b : b + ROWS] if w is None else t[:, b : b + ROWS].T).astype(np.int64)) for b in range(a, min(a + 64 * ROWS, rows), ROWS)]
                    cut = [(b, d.tobytes()) for b, d in cut if d.any()]
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in cut], pa.int32()), pa.array([d for _, d in cut], pa.binary())], ["block", "d"])
        release()

    return run


def _added(batches):
    """One sum for each block of the partition."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = np.frombuffer(d, np.int64)
            total[b] = total[b] + got if b in total else got
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "d"])


def _lost(shared):
    """(n, loss): tokens of one task's texts and their summed -log10 P."""

    def run(batches):
        n, loss, w = 0, 0.0, shared.value.astype(np.float32)
        for batch in batches:
            for part in small_batches(batch, "text", 1 << 20):
                h, cls, own, counts = tokens(part.column(0))
                n, loss = n + len(h), loss - word_logs(w, h, cls, own, counts).sum() / np.log(10)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "loss": pa.array([round(float(loss) * 1000)], pa.int64())})

    return run


def train(texts: DataFrame, n_tokens: int) -> np.ndarray:
    """Weights of both softmaxes, from every row of texts(text).

    The start comes from the counts of choices after contexts; each step then follows the gradient (what was seen less what
    the model expects, less the pull), summed over all tokens at the same weights. One text in APART, by its hash, is kept
    out of the sums: steps go on until its loss falls by less than LEAST. Sums are of whole numbers, so neither the order
    of rows nor the number of partitions changes the result. Weights and sums have a fixed size (25 and 50 MB); tasks get the weights as
    16-bit numbers, and one set of them at a time.
    """
    sc, rows = texts.sparkSession.sparkContext, TEMPLATES << BITS
    apart = F.pmod(F.xxhash64("text"), F.lit(APART)) == 0
    learn, held = texts.where(~apart), written(texts.where(apart), "apart")
    tasks = max(1, n_tokens // TASK_TOKENS)

    def gathered(shared) -> list[np.ndarray]:
        got = learn.coalesce(tasks).mapInArrow(_sums(shared), "block int, d binary")
        if tasks > ADDED:
            got = got.repartition(64, "block", F.spark_partition_id() % (tasks // ADDED + 1)).mapInArrow(_added, "block int, d binary")
        sums = written(got.repartition(16, "block").mapInArrow(_added, "block int, d binary"), "sums")
        out = np.zeros((2 * rows, CLASSES))
        for r in sums.toLocalIterator():  # 2 * rows / ROWS blocks
            out[r["block"] : r["block"] + ROWS] += np.frombuffer(r["d"], np.int64).reshape(-1, CLASSES)
        free(sums)
        return [out[:rows], out[rows:]]

    def loss(shared) -> float:
        r = held.mapInArrow(_lost(shared), "n long, loss long").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss")).first()
        return (r["loss"] or 0) / 1000 / max(r["n"] or 0, 1)

    seen = gathered(None)
    starts = [start_weights(x) for x in seen]
    w, rests = np.stack([x for x, _ in starts]), [r for _, r in starts]
    shared = sc.broadcast(w.astype(np.float16))  # what tasks read of the weights, 12 MB
    before = loss(shared)
    for _ in range(ROUNDS):
        new = np.stack([stepped(w[i], seen[i], x / (1 << UNITS), rests[i]) for i, x in enumerate(gathered(shared))])
        shared.destroy()
        shared = sc.broadcast(new.astype(np.float16))
        after = loss(shared)
        if after > before:
            break
        w, fell, before = new, before - after, after
        if fell < LEAST:
            break
    shared.destroy()
    free(held)
    return w


def _score(shared):
    def run(batches):
        w, head, count, norm = shared.value
        w = w.astype(np.float32)
        for batch in batches:
            for part in small_batches(batch, "text", 1 << 20):
                h, cls, own, n = tokens(part.column(part.schema.get_field_index("text")))
                at = np.minimum(np.searchsorted(head, h), max(len(head) - 1, 0))
                known = head[at] == h if len(head) else np.zeros(len(h), bool)
                logs = np.where(known, np.log10(count[at] + 1.0), 0.0) if len(head) else np.zeros(len(h))
                model = word_logs(w, h, cls, own, n) / np.log(10) - norm[cls * PARTS + own]
                first = np.cumsum(n) - n
                rare = np.flatnonzero(~known)
                bounds = np.searchsorted(rare, np.append(first, len(h))).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(bounds), pa.array(h[rare].view(np.int64)))
                rest = [part.column(i) for i, name in enumerate(part.schema.names) if name != "text"]
                sums = [pa.array(np.add.reduceat(x, first)) for x in (known.astype(np.int64), logs, model)] if len(n) else [pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.float64())]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(n.astype(np.int64)), *sums, tail], [*(x for x in part.schema.names if x != "text"), "n_tokens", "head_known", "head_logs", "model", "tail"])

    return run


def lm_scores(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log10 probabilities of every whole text under a unigram base and the maximum-entropy model.

    learn: Column, true for the rows that counts and weights are learnt from (null counts as false). Returns one row for
    each row of docs: id, learnt, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are runs of anything but ASCII white space, A-Z lower-cased, and one end for each text. base_score adds
    log10((c + 1) / (N + V + 1)). The model factors P(token | context) = P(class | context) * P(part | class, context) *
    P(token | part): the first two are softmaxes over hashed n-gram and skip features, those of the second together with
    the class, trained by synchronous gradient steps over the learnt tokens (see train); the last is (c + 1) / (N_part +
    V_part + 1) from exact counts, so that all tokens of a part and its unseen one sum to 1. An end is a class of its own.

    Counts cover every learnt token. The most frequent ones, HEAD at most, go to the scoring tasks (4 MB at any input size); all
    other tokens of a text, each rarer than any of those and so never hot, meet their counts in a join.

    A null text counts as empty and has the end only. Without learnt rows c = N = V = 0. Ids may repeat or be null, rows
    are told apart; other columns are ignored; an empty table gives no rows. Tokens are told apart by 64-bit hashes.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learnt"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = base.where("learnt").select("text")
    counts = written(texts.mapInArrow(_counts, "h long, leaf int, c long").groupBy("h").agg(F.first("leaf").alias("leaf"), F.sum("c").alias("c")), "counts")
    total = {r["leaf"]: r for r in counts.groupBy("leaf").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}  # CLASSES * PARTS at most
    n, v = sum(r["n"] for r in total.values()), sum(r["v"] for r in total.values())
    norm = np.array([np.log10((total[k]["n"] + total[k]["v"] if k in total else 0) + 1.0) for k in range(CLASSES * PARTS)])
    top = most_frequent(counts, HEAD).select("h", "c").toPandas()  # at most HEAD pairs
    head = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(head)
    shared = docs.sparkSession.sparkContext.broadcast((train(texts, n).astype(np.float16), head[order], top["c"].to_numpy(np.int64)[order], norm))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = base.mapInArrow(_score(shared), f"id {kind}, learnt boolean, n_tokens long, head_known long, head_logs double, model double, tail array<long>")
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "scores")
    tail = rows.select("rid", F.explode("tail").alias("h")).join(counts.select("h", "c"), "h").groupBy("rid").agg(F.count("*").alias("known"), F.sum(F.log10(F.col("c") + 1.0)).alias("logs"))
    out = rows.drop("tail").join(tail, "rid", "left")
    logs = F.col("head_logs") + F.coalesce("logs", F.lit(0.0))
    return out.select(
        "id", "learnt", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(n + v + 1.0))).alias("base_score"), (logs + F.col("model")).alias("score"),
    )
