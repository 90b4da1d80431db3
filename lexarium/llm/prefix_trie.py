"""Prefix trie of conversations: turn arrays sorted globally, adjacent LCPs, a stack sweep, open stacks stitched.

Each conversation is one path: a fixed-width hash (128 bits of SHA-256 over role and text) a turn. Paths are range-sorted
over all partitions with the conversation's id, so that neither a hot first turn nor a large group of equal conversations
gathers anywhere. Each task sweeps its rows with a stack of open nodes: the longest common prefix with the row before
closes deeper nodes, whose figures go to their parent. Nodes on the path of a task's first or last row may go on in the
neighbouring task; of these the task writes what it saw. One further sweep, over at most two paths a task, stitches them
in task order, and a join on (task, node) tells the children that closed under them their parent's id.

Ids of conversations that end at such a node are written in pieces of text and hashed in order as a stream.

Defined results: rows with a null conversation id take no part; null role or text is empty; turns are ordered by turn
(null first), equal turns by role and then by the text's hash, so that repeated rows are repeated turns; an empty table
has no nodes; columns other than the four named are never read.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import release, written
from .common import schema as _schema

#: Characters of a turn's hash; bytes of paths that one task sorts; ids of one written piece.
UNIT, SHARE, PIECE = 22, 32 << 20, 50_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
_SWEPT = _schema("kind string, task int, side int, depth int, conv long, parent long, own long, n long, kids long, leaves long, saved long, words long, ends string, path string, seq int, ids string")
_STITCHED = _schema("kind string, task int, side int, depth int, conv long, parent long, n long, kids long, leaves long, saved long, ends string")


def common_turns(a: str, b: str) -> int:
    """Turns that two paths share from their start."""
    if a == b:
        return len(a) // UNIT
    low, high = 0, min(len(a), len(b)) // UNIT
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * UNIT : mid * UNIT] == b[low * UNIT : mid * UNIT]:
            low = mid
        else:
            high = mid - 1
    return low


class Node:
    """An open node: conversations that end at it, and the sums of its closed children."""

    __slots__ = ("children", "depth", "ends", "kids", "leaves", "least", "left", "n", "own", "pieces", "refs", "saved", "words")

    def __init__(self, depth: int, words: int, left: bool = False):
        self.depth, self.words, self.left = depth, words, left
        self.own = self.n = self.kids = self.leaves = self.saved = 0
        self.least = self.ends = None
        self.children: list[tuple] = []
        self.refs: list[tuple[int, int]] = []
        self.pieces = False

    def see(self, conv: int | None) -> None:
        if conv is not None and (self.least is None or conv < self.least):
            self.least = conv

    def closed(self) -> tuple:
        """(conv, depth, n, kids, leaves, saved, ends) once nothing below is open."""
        n = self.own + self.n
        return self.least, self.depth, n, self.kids, self.leaves or 1, self.saved + (n - 1) * self.words, self.ends

    def take(self, child: tuple) -> None:
        conv, _, n, _, leaves, saved, _ = child
        self.see(conv)
        self.kids += 1
        self.n += n
        self.leaves += leaves
        self.saved += saved


class _Rows:
    """Output rows, given as record batches of a schema."""

    def __init__(self, schema: T.StructType, most: int = 20_000):
        self.shape, self.most, self.rows = to_arrow_schema(schema), most, []

    def add(self, **row) -> None:
        self.rows.append(row)

    def full(self, at_end: bool = False):
        if self.rows and (at_end or len(self.rows) >= self.most):
            yield pa.RecordBatch.from_pylist(self.rows, self.shape)
            self.rows = []


def _node(out: _Rows, child: tuple, **more) -> None:
    conv, depth, n, kids, leaves, saved, ends = child
    out.add(conv=conv, depth=depth, n=n, kids=kids, leaves=leaves, saved=saved, ends=ends, **more)


def sweep(rows, task: int, out: _Rows):
    """Sweep (path, conv, words) in order. Kinds of rows: node; child (of an open node, named by side and depth - 1); open
    (what was seen of a node on the first or last row's path, side 0 or 1); ids (a piece of those that end there)."""
    stack: list[Node] = []
    before, first, ids = "", None, []

    def close() -> None:
        x = stack.pop()
        if x.left:
            out.add(kind="open", task=task, side=0, depth=x.depth, conv=x.least, own=x.own, n=x.n, kids=x.kids, leaves=x.leaves, saved=x.saved, words=x.words, ends=x.ends, path=first if x.depth * UNIT == len(first) else None)
            return
        done = x.closed()
        for child in x.children:
            _node(out, child, kind="node", parent=x.least)
        above = stack[-1]
        above.take(done)
        if above.left:
            _node(out, done, kind="child", task=task, side=0)
        else:
            above.children.append(done)

    def ended(last: bool) -> None:
        """The ids at the top of the stack are complete, unless they touch the task's first or last row."""
        nonlocal ids
        if last or stack[-1].left:
            for i in range(0, len(ids), PIECE):
                out.add(kind="ids", task=task, side=0 if stack[-1].left else 1, depth=stack[-1].depth, seq=pieces + i // PIECE, ids=",".join(map(str, ids[i : i + PIECE])))
        else:
            stack[-1].ends = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        ids = []

    pieces = 0
    for path, conv, words in rows:
        if first is None:
            first = path
            stack = [Node(0, 0, True), *(Node(i + 1, w, True) for i, w in enumerate(words))]
        elif path != before:
            ended(False)
            shared = common_turns(before, path)
            while len(stack) > shared + 1:
                close()
            stack += [Node(i + 1, words[i]) for i in range(shared, len(words))]
        elif stack[-1].left and len(ids) >= PIECE:  # many equal conversations: written as they come
            ended(False)
            pieces += 1
        top = stack[-1]
        top.own += 1
        top.see(conv)
        ids.append(conv)
        before = path
        yield from out.full()
    if first is None:
        return
    ended(True)
    while stack:
        if stack[-1].left:
            close()
            continue
        x = stack.pop()
        for child in x.children:
            _node(out, child, kind="child", task=task, side=1)
        out.add(kind="open", task=task, side=1, depth=x.depth, conv=x.least, own=x.own, n=x.n, kids=x.kids, leaves=x.leaves, saved=x.saved, words=x.words, ends=x.ends, path=before if x.depth * UNIT == len(before) else None)
        yield from out.full()


def stitch(rows, out: _Rows):
    """Sweep open nodes (dicts in the order of task, side, depth). Kinds of rows: node, and ref (the conv of an open node)."""
    stack: list[Node] = []
    before = None

    def close() -> None:
        x = stack.pop()
        done = x.closed()
        for child in x.children:
            _node(out, child, kind="node", parent=x.least)
        for task, side in x.refs:
            out.add(kind="ref", task=task, side=side, depth=x.depth, conv=x.least)
        if stack:
            stack[-1].take(done)
            stack[-1].children.append(done)
        else:
            _node(out, done, kind="node")

    def merge(x: Node, r: dict) -> None:
        x.own, x.n, x.kids, x.leaves, x.saved = (a + r[c] for a, c in ((x.own, "own"), (x.n, "n"), (x.kids, "kids"), (x.leaves, "leaves"), (x.saved, "saved")))
        x.see(r["conv"])
        x.refs.append((r["task"], r["side"]))
        x.ends = x.ends or r["ends"]

    for (_, side), some in groupby(rows, lambda r: (r["task"], r["side"])):
        some = list(some)
        path = some[-1]["path"]
        shared = some[0]["depth"] - 1 if side else -1 if before is None else common_turns(before, path)
        while len(stack) > shared + 1:
            close()
        for r in some:
            if r["depth"] > shared:
                stack.append(Node(r["depth"], r["words"]))
            merge(stack[r["depth"]], r)
        before = path
        yield from out.full()
    while stack:
        close()


def turn_paths(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, keys, words): each conversation's turns in order; hashes only, collected in part before they move."""
    said, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    key = F.substring(F.base64(F.unhex(F.substring(F.sha2(F.concat(F.length(said).cast("string"), F.lit(":"), said, what).cast("binary"), 256), 1, 32))), 1, UNIT)
    one = F.struct(F.col(turn).isNotNull().alias("dated"), F.col(turn).alias("turn"), said.alias("role"), F.sha2(what.cast("binary"), 256).alias("hash"), key.alias("key"), F.regexp_count(what, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    t = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), one.alias("t"))
    own = t.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return own.select("conv", F.col("t.key").alias("keys"), F.col("t.words").alias("words"))


def rebuilt(paths: DataFrame, head: Column, base: Column, most: int) -> DataFrame:
    """paths(conv, keys, words) whose first `head` turns (at most `most`) are those of conversation `base`, both columns over
    conv; all of the base's if it has fewer, none if there is no base."""
    p = paths.withColumn("_h", head).withColumn("_b", base)
    b = paths.select(F.col("conv").alias("_b"), F.slice("keys", 1, most).alias("_k"), F.slice("words", 1, most).alias("_w"))
    own = lambda c: F.slice(c, F.col("_h") + 1, F.greatest(F.size(c) - F.col("_h"), F.lit(0)))
    first = lambda c, kind: F.coalesce(F.slice(c, F.lit(1), F.col("_h")), F.array().cast(kind))
    return p.join(b, "_b", "left").select("conv", F.concat(first("_k", "array<string>"), own("keys")).alias("keys"), F.concat(first("_w", "array<int>"), own("words")).alias("words"))


def _hashed(batches):
    """SHA-256 of each node's pieces(conv, depth, ids) in order, as a stream."""
    out = _Rows(_HASHED)
    now, hasher = None, None
    for batch in batches:
        for conv, depth, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (conv, depth) != now:
                if now:
                    out.add(conv=now[0], depth=now[1], hashed=hasher.hexdigest())
                now, hasher = (conv, depth), hashlib.sha256(ids.encode())
            else:
                hasher.update(b"," + ids.encode())
            yield from out.full()
    if now:
        out.add(conv=now[0], depth=now[1], hashed=hasher.hexdigest())
    yield from out.full(True)


_HASHED = _schema("conv long, depth int, hashed string")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """paths(conv, keys, words) -> nodes(conv, depth, parent, n, kids, leaves, saved, ends)."""
    spark = paths.sparkSession
    p = written(paths.select(F.array_join("keys", "").alias("path"), "conv", "words"), "paths")
    size = p.agg(F.sum(F.length("path"))).first()[0]
    if size is None:
        return spark.createDataFrame([], _STITCHED).select("conv", "depth", "parent", "n", "kids", "leaves", "saved", "ends")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARE + 1)

    def run(batches):
        out = _Rows(_SWEPT)
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        yield from sweep(rows, TaskContext.get().partitionId(), out)
        yield from out.full(True)
        release()

    swept = written(p.repartitionByRange(parts, "path", "conv").sortWithinPartitions("path", "conv").mapInArrow(run, _SWEPT), "swept")

    def stitched(batches):
        out = _Rows(_STITCHED)
        yield from stitch((r for b in batches for r in b.to_pylist()), out)
        yield from out.full(True)

    # at most two paths for each of the tasks above, in order
    open_ = swept.where("kind = 'open'").drop("kind", "parent", "seq", "ids").repartition(1).sortWithinPartitions("task", "side", "depth")
    joined = written(open_.mapInArrow(stitched, _STITCHED), "stitched")
    refs = joined.where("kind = 'ref'").select("task", "side", "depth", F.col("conv").alias("_c"))
    pieces = swept.where("kind = 'ids'").select("task", "side", "depth", "seq", "ids").join(refs, ["task", "side", "depth"]).select(F.col("_c").alias("conv"), "depth", "ids", "task", "side", "seq")
    ends = pieces.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "task", "side", "seq").select("conv", "depth", "ids").mapInArrow(_hashed, _HASHED)
    cols = ["conv", "depth", "parent", "n", "kids", "leaves", "saved", "ends"]
    inner = swept.where("kind = 'node'").select(*cols)
    above = refs.select("task", "side", (F.col("depth") + 1).alias("depth"), "_c")
    under = swept.where("kind = 'child'").join(above, ["task", "side", "depth"]).withColumn("parent", F.col("_c")).select(*cols)
    over = joined.where("kind = 'node'").join(ends, ["conv", "depth"], "left").withColumn("ends", F.coalesce("hashed", "ends")).select(*cols)
    return inner.unionAll(under).unionAll(over).withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS)))
