"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import inspect
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir, or in local mode a temporary folder where that is unset."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="larderflow-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before
        pass


def give_back() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table of the shared folder and read it again: cuts the lineage and survives lost executors. Shuffle files of the
    write itself aren't needed any more then and are removed with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
        give_back()
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._larder_path = path
    if _scratches:
        _scratches[-1].append(out)
    return out


_scratches: list[list[DataFrame]] = []


@contextmanager
def scratch(keep: list[DataFrame]):
    """Remove all tables that are written inside, but for those put into `keep`, when it is left. What was computed inside must have been written."""
    _scratches.append([])
    try:
        yield
    finally:
        own = _scratches.pop()
        left = [t for t in own if any(t is k for k in keep)]
        discard(*[t for t in own if not any(t is k for k in left)])
        if _scratches:
            _scratches[-1].extend(left)
        gc.collect()  # broadcasts of what was computed inside
        give_back()


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_larder_path", None):
            _remove(t.sparkSession, path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has no more rows than may be broadcast, else df as it is (the join then shuffles)."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def seeded(seed: int, *cols: str | Column) -> Column:
    """A hexadecimal hash of the columns' text, also computable in other SQL dialects."""
    text = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *text))


def with_rank(df: DataFrame, group: str, h: str, ties: list[str], bucket_digits: int = 3) -> DataFrame:
    """Add `_rank` (from 0, by h then ties) and `_n` within each group, with no group sorted by one task.

    Rows are split by the first hexadecimal digits of h; ranks inside a bucket are shifted by the counts of the buckets before it.
    Nulls in `group` are a group of their own; rows that are alike in h and ties are ranked in any order.
    """
    b = df.withColumn("_b", F.substring(h, 1, bucket_digits))
    w = Window.partitionBy("_g").orderBy("_bb")
    counts = b.groupBy(F.col(group).alias("_g"), F.col("_b").alias("_bb")).agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.withColumn("_before", F.sum("_c").over(w) - F.col("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy("_g"))).drop("_c")
    own = Window.partitionBy(group, "_b").orderBy(h, *ties)
    ranked = b.withColumn("_r", F.row_number().over(own) - 1)
    offsets = small(written(offsets, "offsets"))
    on = ranked[group].eqNullSafe(offsets["_g"]) & (ranked["_b"] == offsets["_bb"])
    return ranked.join(offsets, on).withColumn("_rank", F.col("_before") + F.col("_r")).drop("_g", "_bb", "_b", "_r", "_before")


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root) with root the component's smallest node. Alternates large and small star steps."""
    e = written(edges.select("a", "b").where("a <> b").distinct(), name)
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    old = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(m, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: link the lower neighbours (and the node) to the lowest
        lower = large.where("a <> b").distinct()
        lm = lower.groupBy("a").agg(F.min("b").alias("m"))
        star = lower.join(lm, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        last, e = e, written(star.where("a <> b").distinct(), name)
        discard(last)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if old == now:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        old = now


def trimmed(run):
    """A function for mapInArrow or applyInArrow that gives freed memory back to the system after each batch or group, so that idle Python workers hold little."""

    def each(batches):
        try:
            for b in run(batches):
                yield b
                give_back()
        finally:
            give_back()

    def whole(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    return each if inspect.isgeneratorfunction(run) else whole


# --- text as bytes -----------------------------------------------------------------------------------------------

_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_pow: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    a = _pow.get(name)
    if a is None or len(a) < n:
        size = max(n, 1 << 21)
        a = np.empty(size, dtype=np.uint64)
        a[0] = 1
        a[1:] = base
        np.multiply.accumulate(a, out=a)
        _pow[name] = a
    return a[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(offsets):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 2_000_000):
    """Ranges of values that hold about `most` bytes; a longer value is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True


def word_spans(b: np.ndarray, offsets: np.ndarray, word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and value index of each run of word bytes; runs end where a value ends."""
    m = word[b]
    prev = np.empty(len(m), dtype=bool)
    prev[:1] = False
    prev[1:] = m[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(b)]
    prev[inner] = False
    start = np.flatnonzero(m & ~prev)
    stop = np.empty(len(m), dtype=bool)
    stop[-1:] = True
    stop[:-1] = ~m[1:]
    cut = inner[inner > 0] - 1
    stop[cut] = True
    end = np.flatnonzero(m & stop) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, wherever it stands."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    c = np.empty(len(b) + 1, dtype=np.uint64)
    c[0] = 0
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers("p", _P, len(b)), out=c[1:])
    return mix((c[end] - c[start]) * _powers("i", _PINV, len(b) + 1)[start] + (end - start).astype(np.uint64))


def packed(*arrays: np.ndarray) -> bytes:
    """Compress arrays of whole numbers, their bytes in planes."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize))], dtype=np.int64).tobytes()
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw[:8], dtype=np.int64)[0])
    head = np.frombuffer(raw[8 : 8 + 16 * n], dtype=np.int64).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for (count, width), kind in zip(head.tolist(), kinds):
        a = np.frombuffer(raw, dtype=np.uint8, count=count * width, offset=at).reshape(width, count).T
        out.append(np.ascontiguousarray(a).reshape(-1).view(kind))
        at += count * width
    return out
