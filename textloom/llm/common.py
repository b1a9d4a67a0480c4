"""Helpers shared by the operators: row-wise Arrow passes, tables, word splitting, hashing, winnowing."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space that ends a word.
SPACE = b" \t\n\x0b\x0c\r"
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words of letters and digits: every other ASCII byte parts words, every byte beyond ASCII belongs to one.
ALNUM_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
U64 = np.uint64
MASK64 = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15
STEP_INVERSE = pow(STEP, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; a folder of our own only where that is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            base = own.get()
        elif spark.sparkContext.master.partition("[")[0] == "local":
            base = os.path.join("/tmp", "textloom-checkpoints")
        else:  # executors don't share a local folder
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/textloom-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: no lineage, and safe against lost executors.

    Spark deletes the shuffles and broadcasts of what was written when the driver collects garbage, so that is asked for.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/textloom-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return freed memory to the system, as a JVM beside this worker may need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker, that waits for its next task, gives back what it freed."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def pieces(batch: pa.RecordBatch, lengths: list[int], most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows holding about `most` units of text, so that working memory stays small."""
    begin = held = 0
    for k, n in enumerate(lengths):
        held += 64 + n
        if held >= most or k == len(lengths) - 1:
            yield batch.slice(begin, k + 1 - begin)
            begin, held = k + 1, 0


def add_columns(
    df: DataFrame,
    text: str,
    added: T.StructType,
    make: Callable[[], Callable[[list], list[pa.Array]]],
    *,
    binary: bool = False,
    most: int = 1 << 20,
) -> DataFrame:
    """df with the columns of `added`, computed from column `text` run by run in Python workers.

    make() is called once a task and returns a function from texts to arrays. An input column whose name
    is among those of `added` is replaced, so clashing names never meet.
    """
    held = [c for c in df.columns if c not in added.names or c == text]
    kept = [c for c in held if c not in added.names]
    if df.schema[text].dataType.simpleString() == "void":
        df = df.withColumn(text, F.col(f"`{text}`").cast("string"))
    df = df.select(*(F.col(f"`{c}`") for c in held))
    out = T.StructType([*(df.schema[c] for c in kept), *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            at = batch.schema.get_field_index(text)
            lengths = (pc.binary_length if binary else pc.utf8_length)(batch.column(at)).fill_null(0).to_pylist()
            for part in pieces(batch, lengths, most):
                column = part.column(at)  # only this run's texts become Python's
                arrays = [part.column(part.schema.get_field_index(c)) for c in kept] + work((column.cast(pa.binary()) if binary else column).to_pylist())
                yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return df.mapInArrow(tidy(run), out)


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash, remembered up to a bound."""

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


class Powers:
    """Powers of an odd step and of its inverse modulo 2^64, grown as longer texts come."""

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)
            for name, step in (("up", STEP), ("down", STEP_INVERSE)):
                steps = np.full(n, step, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose results look random (xor-shift and multiply)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Windows:
    """Hashes of runs of words at any length, from one pass of prefix sums."""

    def __init__(self, words: np.ndarray, powers: Powers):
        n = len(words)
        powers.need(n + 1)
        self.n, self.powers = n, powers
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(words * powers.up[:n], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        """The hash of each window of `length` words."""
        if self.n < length:
            return np.zeros(0, U64)
        raw = self.sums[length:] - self.sums[: self.n + 1 - length]
        return mix(raw * self.powers.down[: len(raw)] + U64(length))

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        raw = self.sums[starts + length] - self.sums[starts]
        return mix(raw * self.powers.down[starts] + U64(length))


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of the smallest hash in each run of `width`, leftmost in a tie.

    The choice depends on a run's content alone, so equal runs choose the same offset.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64)
    if n > 1 << 24:  # positions take 24 bits
        step = (1 << 24) - width + 1
        return np.unique(np.concatenate([winnow(hashes[i : i + (1 << 24)], width) + i for i in range(0, n - width + 1, step)]))
    low = (hashes & U64(MASK64 ^ 0xFFFFFF)) | np.arange(n, dtype=U64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: n - width + 1], low[width - span : width - span + n - width + 1])
    chosen = (low & U64(0xFFFFFF)).astype(np.int64)
    return chosen[np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))]
