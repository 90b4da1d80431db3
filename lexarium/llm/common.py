"""What the operators of this package share: a shared work folder, written tables, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset, in local mode only) a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN_DIR:
            _OWN_DIR.append(tempfile.mkdtemp(prefix="lexarium-"))
            spark.sparkContext.setCheckpointDir(_OWN_DIR[0])
        base = _OWN_DIR[0]
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended; the files then stay in the shared folder
        pass


#: Spark deletes a query's shuffle files as soon as it ends, where this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and return the reread table.

    This cuts the lineage: a lost executor costs the tasks in flight, never a recomputation from the start, and
    values such as monotonically_increasing_id() are fixed once written. The write's shuffle files go once it ends, as
    the table replaces them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexarium-{uuid.uuid4().hex}-{tag}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lx_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete written tables that no later query reads."""
    for t in tables:
        _delete(t.sparkSession, t._lx_path)


#: Bytes of text whose hashes are compared at once, the most parts that hashes are dealt over, and the most tasks of the
#: exchange: a task that gets several parts takes one after the other.
SHARE, MOST_PARTS, MOST_TASKS = 16 << 20, 1 << 20, 1 << 15


def part_bits(docs: DataFrame, share: int = SHARE) -> int:
    """Bits of a hash that tell its part of an exchange, so that a part gets the hashes of about `share` bytes of docs(text)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(3, min(int(size // share), MOST_PARTS - 1).bit_length())


def runs(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[list[pa.RecordBatch]]:
    """Batches sorted by a column, cut into runs of one value; only one run is held."""
    held, now = [], None
    for batch in batches:
        v = batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and v[a] != now:
                yield held
                held = []
            now = v[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def by_run(solve: Callable, column: str) -> Callable:
    """A function of batches that solves each run of a column by itself."""

    def run(batches):
        for own in runs(batches, column):
            yield from solve(own)

    return run


def exchanged(rows: DataFrame, bits: int, solve: Callable, schema: str, tasks: int | None = None) -> DataFrame:
    """solve over the rows of each part (a column): one part a task, or (of more parts than tasks) sorted, part after part."""
    tasks = tasks or MOST_TASKS
    if 1 << bits <= tasks:
        return rows.repartition(1 << bits, "part").mapInArrow(solve, schema)
    return rows.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(by_run(solve, "part"), schema)


#: Steps of a doubling in which most_frequent tells counts apart.
COUNT_STEPS = 64


def most_frequent(counts: DataFrame, most: int, column: str = "c") -> DataFrame:
    """The rows of counts whose count passes the least threshold (in steps of about 1%) that at most `most` rows pass.

    Counts are at least 1. The threshold comes from a histogram of at most 64 * COUNT_STEPS steps, so that no task or
    driver gathers more than `most` rows, however many partitions there are.
    """
    step = F.floor(F.log2(F.col(column).cast("double")) * COUNT_STEPS).cast("int")
    left, least = most, 1 << 30
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect(), reverse=True):
        left -= r["n"]
        if left < 0:
            break
        least = r["s"]
    return counts.where(step >= least)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that outputs of these names replace; case doesn't tell names apart."""
    return df.drop(*(c for c in df.columns if c.lower() in {n.lower() for n in names}))


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex}"


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "binary": T.BinaryType(), "double": T.DoubleType()}


def schema(said: str) -> T.StructType:
    """`a string, b long` as a schema, which needs no session, so that modules say it where workers import them too."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in said.split(","))])


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ------------------------------------------------------------------ vectorised hashing of words and shingles

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _lut(separators: set[int]) -> np.ndarray:
    """Byte -> folded byte; 0 stands for a separator."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    for b in separators:
        t[b] = 0
    return t


#: Words are runs of anything but ASCII white space.
SPACED = _lut({0x20, *range(0x09, 0x0E)})
#: Words are runs of ASCII letters and digits and of anything beyond ASCII.
ALNUM = _lut({b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)})


def mix64(x: np.ndarray) -> np.ndarray:
    """A full-avalanche 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        n = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            step, back = np.full(n, _ODD, np.uint64), np.full(n, np.uint64(pow(int(_ODD), -1, 1 << 64)), np.uint64)
            step[0] = back[0] = 1
            _POWERS.update(up=np.multiply.accumulate(step), down=np.multiply.accumulate(back))
    return _POWERS["up"], _POWERS["down"]


def word_bounds(texts: pa.Array, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, word starts, word ends and number of words of each text; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data = lut[data]
    word = data != 0
    begins = np.zeros(len(data), bool)
    begins[1:] = word[1:] & ~word[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = word[first]
    starts = np.flatnonzero(begins)
    ends_mask = np.zeros(len(data), bool)
    ends_mask[:-1] = word[:-1] & ~word[1:]
    last = first_last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends_mask[last] = word[first_last]
    ends = np.flatnonzero(ends_mask) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return data, starts, ends, counts


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = 1 << 19) -> np.ndarray:
    """64-bit hash of each data[start:end], by differences of one running polynomial sum for each chunk of bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(int(np.searchsorted(ends, a + chunk, side="right")), i + 1)
        b = ends[j - 1]
        up, down = _powers(int(b - a) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=total[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def word_hashes(texts: pa.Array, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    data, starts, ends, counts = word_bounds(texts, lut)
    return span_hashes(data, starts, ends), counts


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of the whole sequence if it has 1 to k-1 words."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, k)
    with np.errstate(over="ignore"):
        total = np.full(n - width + 1, np.uint64(width), np.uint64)
        for j in range(width):
            total = (total ^ words[j : n - width + 1 + j]) * _ODD
            total ^= total >> np.uint64(29)
        return mix64(total)


def rows_of(texts: pa.Array, lut: np.ndarray):
    """The word hashes of each text, one array at a time."""
    words, counts = word_hashes(texts, lut)
    at = 0
    for n in counts:
        yield words[at : at + n]
        at += n


def release() -> None:
    """Give memory that a finished task no longer uses back to the system, as Python workers live on for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def small_batches(batch: pa.RecordBatch, text: str, most: int = 4 << 20):
    """Cut a batch so that each part holds about `most` bytes of text, or one row."""
    col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
    if len(col) == 0:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    at = 0
    while at < len(col):
        to = max(int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1, at + 1)
        yield batch.slice(at, to - at)
        at = to
