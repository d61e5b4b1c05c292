"""Pieces shared by the operators: scratch tables, Arrow text buffers, vectorised hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside an Arrow task; bounds the memory of a Python worker.
SLICE_BYTES = 1 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where the session names none, a
    folder in its warehouse, which a cluster shares too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, so a lost
    executor costs a re-read and never a recomputation of the whole chain."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_at = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete what :func:`staged` wrote, once nothing will read it again."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(df.staged_at)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name, with more underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of plans that are no longer referenced.

    The JVM learns of frames that Python has dropped with the next call, so one goes ahead of
    the collection.
    """
    import gc

    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.nanoTime()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts may be megabytes long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """Only the two columns the operators read, so clashing extra columns never matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and n + 1 offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` text bytes; a row is never cut."""
    if not batch.num_rows:
        return
    _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


#: A key is hot if its group holds more than 1 / HOT_SHARE of all rows; so at most HOT_SHARE
#: keys are hot, which bounds the only table that :func:`attach` broadcasts.
HOT_SHARE = 4096


def attach(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, name: str, row: tuple[str, ...]) -> DataFrame:
    """Left-join ``right`` (one row per ``key``) as a struct column ``name``, by sort-merge.

    ``right[weight]`` is the number of left rows of the key, ``total`` the sum of all. Rows of
    hot keys meet their match by broadcast; in the sort-merge join they carry a key made from
    the columns ``row``, which matches nothing and spreads them over all tasks.
    """
    fields = [c for c in right.columns if c != key]
    kind = right.schema[key].dataType
    hot = right.where(F.col(weight) * HOT_SHARE > total).select(F.col(key).alias("__hot"), F.struct(*fields).alias("__h"))
    got = left.join(F.broadcast(hot), left[key] == F.col("__hot"), "left")
    spread = F.xxhash64(*row)
    spread = F.unhex(F.hex(spread)) if kind.simpleString() == "binary" else spread
    got = got.withColumn("__key", F.when(F.col("__h").isNotNull(), spread).otherwise(F.col(key)))
    cold = right.select(F.col(key).alias("__cold"), F.struct(*fields).alias("__c")).hint("merge")
    got = got.join(cold, got["__key"] == F.col("__cold"), "left")
    return got.withColumn(name, F.coalesce("__h", "__c")).drop("__hot", "__h", "__key", "__cold", "__c")


# -- hashing ------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        step = np.full(size, base, np.uint64)
        step[0] = 1
        have = _powers[base] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RangeHash:
    """64-bit hashes of any byte ranges of a buffer, each in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(_BASE, n), out=self.sums[1:])
        self.back = _power(_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        raw = (self.sums[stop] - self.sums[start]) * self.back[start]
        return mix(raw + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and row of every word; ``outside`` marks the bytes that no word holds, white
    space ``[\\x20\\x09-\\x0D]`` if not given. Words never cross rows."""
    inside = ~outside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, stop, np.searchsorted(offsets, start, "right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The hash of every word; long texts are hashed in runs of about ``SLICE_BYTES``."""
    out = np.zeros(len(start), np.uint64)
    first = 0
    while first < len(start):
        low = start[first]
        last = max(first + 1, int(np.searchsorted(stop, low + SLICE_BYTES, "right")))
        out[first:last] = RangeHash(data[low : stop[last - 1]])(start[first:last] - low, stop[first:last] - low)
        first = last
    return out


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for ``length[0]`` numbers, then the same for the next range."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))
