"""Shared pieces of the corpus operators: tables, scratch tables, and vectorised word hashing.

Words everywhere are ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes. Texts are processed whole, in slices of
rows so that the working set of a Python worker is bounded by ``SLICE`` bytes or by one text.
"""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE = 1 << 20
U64 = np.uint64


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each application, so that their Python can import the operators."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="corpus_package_")) / "ledgerlight_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- scratch tables

_own_folder: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. One of our own only where it is unset and driver
    and tasks are one process, as in tests: on a cluster, tasks would each write to their own disk."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="corpus_scratch_"))
    return _own_folder[0]


_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back. Survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    _written[back] = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in tables:
        path = _written.pop(df, None)
        if path:
            _drop(df.sparkSession, path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended already; the folder is the cluster's to clean
        pass


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# ---------------------------------------------------------------- memory of Python workers


def pieces(batch: pa.RecordBatch, place: int, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Successive rows of a batch that hold about ``limit`` bytes in the string column at ``place``, or one row."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(total):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def trim() -> None:
    """Give freed memory back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def bounded(run):
    """A function over a partition's batches that trims the worker's memory when it ends."""

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return trimmed


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values: the finaliser over a counter."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1 << 32)) * U64(0x9E3779B97F4A7C15))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_FIRST_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], U64)  # masks of 0 to 8 bytes
_LANES = stream(1, 4)
_LEFT, _RIGHT = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
LONG_WORD = 1024


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and byte after the last of each word of consecutive texts, and for each text the index of its first
    word (one more at the end)."""
    word = ~SPACE[buf]
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], after[-1] = False, False
        before[1:], after[:-1] = word[:-1], word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of spans of bytes, taken eight bytes at a time with a non-linear step between: spans of the same
    length up to eight bytes never collide, others as random values do. Lanes are independent of each other."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eights = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix((eights[starts] & _FIRST_BYTES[np.minimum(size, 8)]) + size.astype(U64) * _RIGHT + _LANES[lane])
    live, at = np.flatnonzero(size > 8), 8
    while len(live) and at < LONG_WORD:
        left = size[live] - at
        out[live] = mix(out[live] * _LEFT + (eights[starts[live] + at] & _FIRST_BYTES[np.minimum(left, 8)]) * _RIGHT)
        live, at = live[left > 8], at + 8
    for i in live.tolist():  # the rest of a very long word at once
        rest = hashlib.blake2b(buf[starts[i] + at : ends[i]].tobytes(), digest_size=8, person=bytes([lane])).digest()
        out[i] = mix(out[i : i + 1] * _LEFT + np.frombuffer(rest, "<u8") * _RIGHT)[0]
    return out


def word_hashes(buf: np.ndarray, offsets: np.ndarray, lower: bool = False, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive texts, and for each text the index of its first word (one more at the end)."""
    if lower:
        buf = LOWER[buf]
    starts, ends, firsts = word_spans(buf, offsets)
    return span_hashes(buf, starts, ends, lane), firsts


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, put together from runs of powers of two; those that cross a text's end are for the
    caller to leave out. Every step is non-linear, so no order of few words makes runs collide."""
    n = len(words)
    if n < k or k < 1:
        return np.empty(0, U64)
    out, have, run, length = None, 0, words, 1
    while True:
        if k & length:
            out = run[: n - k + 1] if out is None else mix(out[: n - k + 1] * _LEFT + run[have : have + n - k + 1] * _RIGHT + U64(have))
            have += length
        if have == k:
            return mix(out + U64(k))
        run = mix(run[:-length] * _LEFT + run[length:] * _RIGHT)
        length *= 2


# ---------------------------------------------------------------- Arrow columns


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A string column's bytes, its offsets and which rows are null (their bytes are none)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    column = column.cast(pa.large_string()).fill_null("")
    n, at = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], np.int64)[at : at + n + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets, nulls


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0, nulls) of successive rows holding about ``limit`` bytes."""
    buf, offsets, nulls = as_bytes(column)
    n, lo = len(nulls), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], nulls[lo:hi]
        lo = hi


def crc_mod5_is_0(doc_id) -> "F.Column":
    """Whether a row is held out of training: crc32(doc_id as text) mod 5 = 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def lowest_hash(rows: DataFrame, by: str, id_col: str, most: int) -> DataFrame:
    """At most ``most`` rows of each value of ``by``: those of the lowest hash of the id. Rows whose hash is too high to be
    among them, going by the value's count, are left out before the ranking, so that a common value is no hot key there."""
    value = (F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string")), 1) / float(1 << 63)).alias("_hash")
    counts = written(rows.groupBy(by).agg(F.count(F.lit(1)).alias("_count")), "counts")
    counts = F.broadcast(counts) if counts.count() <= 10_000 else counts  # no shuffle by the few values before the cut
    low = rows.withColumn("_hash", value).join(counts, by).where(F.col("_hash") * F.col("_count") <= most + 10 * most**0.5 + 20)
    rank = Window.partitionBy(by).orderBy("_hash", id_col)
    return low.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= most).drop("_hash", "_count", "_rank")
