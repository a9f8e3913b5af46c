"""Helpers shared by the operators: shared-folder tables and vectorised word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import weakref
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

WHITESPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(WHITESPACE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG_WORD = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a local one where it is unset (tests)."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # the session is already gone at interpreter exit; nothing is left to clean with
        return


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Remove stashed tables now: for those from which everything needed has been written."""
    for df in tables:
        _remove(df.sparkSession, _PATHS.pop(df))


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files behind it are let go once it is written; its own files are removed when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # Spark deletes shuffle files when their plans are collected
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def give_back() -> None:
    """Return freed memory to the system: a Python worker serves many stages, and what the largest left behind counts in all of them."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def giving_back(run):
    """``run``, a function of batches, followed by ``give_back`` once its own arrays are gone."""

    @wraps(run)
    def each(batches):
        yield from run(batches)
        give_back()

    return each


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` has such a column (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), in place on a copy."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of a batch of texts: byte spans in one buffer and the first word of each text."""

    __slots__ = ("buf", "starts", "ends", "first")

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n" + b"\0" * 8
        buf = np.frombuffer(joined, dtype=np.uint8)
        self.buf = _LOWER[buf] if lower else buf
        n = len(joined) - 8
        space = _IS_SPACE[self.buf[:n]]
        edge = np.empty(n, dtype=bool)
        edge[0] = not space[0]
        np.not_equal(space[1:], space[:-1], out=edge[1:])
        edges = np.flatnonzero(edge)  # a text ends in a separator, so edges come in pairs
        self.starts, self.ends = edges[0::2], edges[1::2]
        offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of every word, eight bytes at a time; words of up to eight bytes can't collide before mixing."""
        load = np.ndarray(shape=(len(self.buf) - 7,), dtype="<u8", buffer=np.ascontiguousarray(self.buf), strides=(1,))
        length = self.ends - self.starts
        left = np.minimum(length, 8).astype(np.uint64)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left)
        h = _mix((load[self.starts] & mask) ^ (length.astype(np.uint64) << np.uint64(56)) ^ np.uint64(seed * 0x9E3779B1 & 0xFFFFFFFFFFFFFFFF))
        at, todo = 8, np.flatnonzero((length > 8) & (length <= _LONG_WORD))
        while len(todo):
            left = np.minimum(length[todo] - at, 8).astype(np.uint64)
            mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left)
            h[todo] = _mix(h[todo] ^ _mix(load[self.starts[todo] + at] & mask))
            at += 8
            todo = todo[length[todo] > at]
        for i in np.flatnonzero(length > _LONG_WORD):
            h[i] = xxhash.xxh3_64_intdigest(self.buf[self.starts[i] : self.ends[i]].tobytes(), seed)
        return h


def powers(base: int, upto: int) -> list[np.uint64]:
    out, x = [], 1
    for _ in range(upto + 1):
        out.append(np.uint64(x))
        x = x * base & 0xFFFFFFFFFFFFFFFF
    return out


def window_hashes(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words, built by doubling: P[2k](i) = P[k](i) + base^k P[k](i+k)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    pw = powers(base, width)
    out, have, part, size = None, 0, words, 1
    todo = width
    while todo:
        if todo & 1:
            piece = part[have : have + n]
            out = piece.copy() if out is None else out + pw[have] * piece
            have += size
        todo >>= 1
        if todo:
            part = part[: len(part) - size] + pw[size] * part[size:]
            size *= 2
    return _mix(out)
