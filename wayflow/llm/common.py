"""Shared helpers: shared storage, Arrow text buffers, slicing, text hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20


def tidied(run: Callable) -> Callable:
    """The same Arrow function, which gives unused memory back at the end: a worker outlives its task, beside the JVM of its executor."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return tidy


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares.  Where none is set, a local one, but only if all runs on this machine."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="wayflow-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.  The files stay."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are stored for a while: all of them go when the block ends, so nothing lazy may leave it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*list(self.paths))

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """Store under ``name``; an older table of that name stays until :meth:`drop`."""
        path = shared_path(self.spark, name)
        self.paths.setdefault(name, []).append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str, keep: int = 0) -> None:
        """Delete the tables of these names, but for the last ``keep`` of each."""
        jvm = self.spark._jvm
        for name in names:
            paths = self.paths.get(name, [])
            gone = paths[: len(paths) - keep]
            for path in gone:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
            self.paths[name] = paths[len(gone) :]
        self.clean()

    def clean(self) -> None:
        """Let Spark's cleaner see that the shuffles of finished jobs are garbage; it deletes their files."""
        gc.collect()
        self.spark._jvm.System.gc()


def id_text(docs: DataFrame, hashed: bool = False) -> DataFrame:
    """Only the two columns an operator reads, so that further columns can't clash; a null text is empty.  ``hashed`` adds ``text_hash``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *([F.xxhash64(text).alias("text_hash")] if hashed else []))


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and n + 1 offsets (int64) into them.  Nulls are empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = pc.fill_null(text, "")
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    _, off, data = text.buffers()
    off = np.frombuffer(off, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches by rows so that each slice has about ``most`` bytes of text; one longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def segment_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i+1]]; empty segments give 0."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind in "iuf" else np.int64), np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[off[1:]] - total[off[:-1]]


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _POWERS[base] = got = np.multiply.accumulate(out)
    return got[:n]


def word_hashes(data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of words, which are runs of bytes other than [\\x20\\x09-\\x0D]; A-Z are lower-cased.

    Callers put a space after each text, so that no word spans two texts.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = _WORD[data]
    edge = np.flatnonzero(np.diff(word, prepend=np.uint8(0), append=np.uint8(0)))
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[data].astype(np.uint64) * _powers(_BASE, n), out=total[1:])
    return start, end, mix((total[end] - total[start]) * _powers(_INVERSE, n)[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD = (~_SPACE).astype(np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def spaced(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with a space after each."""
    n = len(off) - 1
    out = np.full(len(data) + n, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(off))] = data
    return out, off + np.arange(n + 1)


def added(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sum int64 arrays, stored as bytes in ``counts``, by ``keys`` in two levels over the task number ``part``.

    One group holds 512 arrays at most at the first level, and a 512th of the tasks' number at the second.
    """
    kinds = ", ".join(f"{k} {t}" for k, t in df.dtypes if k in keys)

    def add(_: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in rows["counts"])
        return pa.table({k: rows[k].slice(0, 1) for k in keys} | {"counts": pa.array([total.tobytes()], pa.binary())})

    first = df.withColumn("salt", F.floor(F.col("part") / 512)).groupBy("salt", *keys).applyInArrow(add, f"{kinds}, counts binary")
    return first.groupBy(*keys).applyInArrow(add, f"{kinds}, counts binary")


def task() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0
