"""Shared plumbing: session settings, shared folders and Arrow text blocks."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_SCRATCH: list[str] = []  # paths that this process has handed out


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches, so that a Python worker holds a few MB of text at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "pulseloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no earlier run has used; `release` deletes it."""
    path = f"{shared_dir(spark)}/pulseloom/{what}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def release(spark: SparkSession, since: int = 0, keep: str = "") -> None:
    """Delete the scratch tables from number `since` on, but for those under `keep`. For callers that have written or read what rests on them."""
    for path in _SCRATCH[since:]:
        if not keep or not path.startswith(keep):
            drop_path(spark, path)
            _SCRATCH.remove(path)


def scratch_count() -> int:
    return len(_SCRATCH)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def strings(col: pa.Array) -> pa.Array:
    """A column as plain UTF-8 strings; null becomes the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type != pa.string():
        col = col.cast(pa.string())
    return pc.fill_null(col, "") if col.null_count else col


def utf8_blocks(col: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of a string column in blocks of about `limit` bytes: first row, bytes, offsets from 0.

    One longer text is a block of its own; null is empty.
    """
    col = strings(col)
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype="<i4", count=n + 1, offset=4 * col.offset).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker hands freed memory back; Spark keeps idle workers, whose memory adds up over a pipeline's stages."""

    def trim() -> None:
        pa.default_memory_pool().release_unused()
        give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if give_back:
            give_back(0)

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return wrapped


def append_columns(df: DataFrame, make: Callable[[pa.RecordBatch], list], fields: list[T.StructField], needs: list[str] | None = None) -> DataFrame:
    """df with columns that `make` computes from each Arrow batch; every row and column passes through."""
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                new = make(batch)
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(f.name for f in fields)])

    return df.mapInArrow(trimmed(run), schema)


def sieve(keys: DataFrame, col: str, most_words: int = 1 << 19) -> Callable[[Column], Column]:
    """A test that holds for all values of the long column `col` of keys, and for about one in a hundred others.

    A Bloom filter of 16 bits a key in blocks of one 64-bit word, `most_words` words at most; beyond
    that (two million keys) it lets more through, so an exact join has to follow. It keeps
    rows that a join needs not from being shuffled for it.
    """
    spark = keys.sparkSession
    words = 1 << max(0, (min(4 * most_words, keys.count()) // 4).bit_length())
    words = min(words, most_words)

    def place(x: Column) -> Column:
        return F.pmod(F.shiftrightunsigned(F.xxhash64(x, F.lit(13)), 18), F.lit(words)).cast("int")

    def mask(x: Column) -> Column:
        h = F.xxhash64(x, F.lit(13))
        bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, s).bitwiseAND(F.lit(63)).cast("int")) for s in (0, 6, 12)]
        return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])

    held = keys.select(place(F.col(col)).alias("at"), mask(F.col(col)).alias("m")).groupBy("at").agg(F.bit_or("m").alias("m")).toArrow()
    full = np.zeros(words, np.int64)
    full[held.column("at").to_numpy()] = held.column("m").to_numpy()
    table = spark.createDataFrame(pa.table({"words": pa.array([full], pa.list_(pa.int64()))})).scalar()

    def holds(x: Column) -> Column:
        return F.get(table, place(x)).bitwiseAND(mask(x)) == mask(x)

    return holds


def crc_remainder(col: str, mod: int):
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(mod)
