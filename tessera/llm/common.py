"""Helpers shared by the training-data operators: shared storage, text normalisation, hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Stands for a null identifier, so that a null never owns a line, span or group unless nothing else does.
NO_ID = 2**63 - 1
MASK = 0xFFFFFFFFFFFFFFFF
#: Bytes of a batch that Python reads at once.
BATCH = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where the session names none and all runs in one process (tests), a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches for Python hold BATCH bytes, not 10,000 rows of any size, so that neither side keeps large buffers. A session's own bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.unset(name)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the query that wrote them ends, not when the driver happens to collect its garbage. A session's own choice stays."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name)


def stash(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. Survives the loss of any executor. free: the write's shuffle files go at its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    with small_batches(spark), freed_shuffles(spark) if free else nullcontext():
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def drop_stash(*frames: DataFrame) -> None:
    """Delete what `stash` wrote for frames that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_stashed_at", None):
            delete_path(df.sparkSession, path)


def _file(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete_path(spark: SparkSession, path: str) -> None:
    system, target = _file(spark, path)
    system.delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and then moved there."""
    system, target = _file(spark, path)
    _, beside = _file(spark, path + ".new")
    out = system.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    system.delete(target, False)
    system.rename(beside, target)


def read_text(spark: SparkSession, path: str) -> str:
    system, target = _file(spark, path)
    size = system.getFileStatus(target).getLen()
    stream = system.open(target)
    try:
        return bytes(stream.readNBytes(size)).decode()
    finally:
        stream.close()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def strip_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def hash128(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of the same columns."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x9E3779B9), *cols, F.lit(1))]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of uint64 values (multiply, xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def utf8(text) -> bytes:
    """UTF-8 bytes; null is empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def release_memory() -> None:
    """Give freed memory back to the machine: a worker lives on after its task, beside the executor."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def release_driver(spark: SparkSession) -> bool:
    """Give back what ended queries held in the driver's JVM, for operators of many queries.

    Spark frees plans and broadcasts only when garbage is collected, and the C library keeps what Spark's many threads freed. True if that went too.
    """
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        args = new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = new_array(jvm.java.lang.Object, 0), new_array(jvm.java.lang.String, 0)
        call.invoke(server, args)
    except Py4JError:  # a JVM or C library without it
        return False
    return True


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None


def blocks_of_texts(texts: pa.Array, most: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, texts) of consecutive UTF-8 texts that come to about `most` bytes; null is empty."""
    for a, b in groups_of(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), most):
        yield a, b, [t or b"" for t in texts.slice(a, b - a).to_pylist()]


def groups_of(sizes, most: int):
    """(from, to) ranges of consecutive items whose sizes sum to about `most`; one item may exceed it alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


#: Bytes that separate words: [\x20\x09-\x0D].
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Byte to byte, A-Z to a-z.
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of several texts: 64-bit hash, start and end byte and text number of each, in order.

    Texts are joined by a blank, so no word crosses texts. Hashes are of lower-cased (A-Z) bytes.
    """

    def __init__(self, texts: list[bytes], lower: bool = True):
        joined = b" ".join(texts) + b" "
        raw = np.frombuffer(joined, np.uint8)
        self.raw = TO_LOWER[raw] if lower else raw
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.base = np.concatenate([[0], np.cumsum(lengths + 1)])
        blank = IS_BLANK[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = span_hashes(self.raw, self.start, self.end)
        self.first = np.searchsorted(self.start, self.base)  # word range of text i: first[i]..first[i+1]
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: sums of mixed (byte, place in the span), then mixed with the length.

    Each (byte, place) adds an independent 64-bit value from a table or the mixer, so that equal sums mean equal spans.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    if end[-1] - start[0] > SPANS:  # blocks of spans, so that what stands beside each byte stays small
        cut = np.append(np.searchsorted(start, np.arange(start[0], end[-1], SPANS)), len(start))
        return np.concatenate([_span_hashes(raw, start[a:b], end[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True) if a < b])
    return _span_hashes(raw, start, end)


def _span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    length = end - start
    own = np.repeat(start, length)
    at = np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length)
    place = np.minimum(at, _PLACES - 1)
    value = _TABLE[raw[own + at].astype(np.int64) + 256 * place]
    if length.max() > _PLACES:
        far = at >= _PLACES
        value[far] = mix64(raw[(own + at)[far]].astype(np.uint64) + at[far].astype(np.uint64) * np.uint64(1009) + _BASE)
    sums = np.add.reduceat(value, np.cumsum(length) - length)
    return mix64(sums + length.astype(np.uint64) * _BASE)


#: Bytes of spans hashed at once.
SPANS = 1 << 17
_PLACES = 24
_TABLE = mix64(np.arange(256 * _PLACES, dtype=np.uint64) * _BASE + np.uint64(12345))


def shingle_hashes(word_hash: np.ndarray, first: np.ndarray, size: int = 5):
    """(hashes, text numbers) of every run of `size` words; a text with 1..size-1 words gives its whole sequence once."""
    n = len(word_hash)
    count = np.diff(first)
    texts = np.arange(len(count))
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, n - size + 1), np.uint64)
        for k in range(size):
            full = (full + np.uint64(k + 1)) * np.uint64(0xD6E8FEB86659FD93)
            full ^= full >> np.uint64(32)
            full += word_hash[k : k + len(full)]
        full = mix64(full + np.uint64(size))
    many = np.maximum(0, count - size + 1)
    begin = np.repeat(first[:-1], many)
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    hashes, owner = full[begin + offset], np.repeat(texts, many)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = []
        for t in short:
            x = np.uint64(count[t])
            with np.errstate(over="ignore"):
                for w in word_hash[first[t] : first[t + 1]]:
                    x = mix64(np.array([x * np.uint64(31) + w]))[0]
            extra.append(x)
        hashes, owner = np.concatenate([hashes, np.array(extra, np.uint64)]), np.concatenate([owner, short])
    return hashes, owner
