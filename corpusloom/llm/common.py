"""What the operators of this subpackage share: shared-folder tables, run identifiers, vectorised tokens."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rule `[^\x20\x09-\x0D]+`, as Java regex and as byte table.
SPACE_CLASS = "[ \\t-\\r]"
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32

#: Random odd multiplier and byte codes of the polynomial hash modulo 2**64, drawn from a fixed seed.
_RNG = np.random.default_rng(20240229)
HASH_BASE = int(_RNG.integers(1 << 62, 1 << 63)) * 2 + 1 & (1 << 64) - 1
HASH_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often the body refers to it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share. Where it is unset, a local master gets a
    temporary one; on a cluster that is an error, since executors would not see each other's files."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back, so that nothing before it is computed again.

    What a session has written goes when its JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def share(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast of a model of bounded size, as bytes for pickle.loads; classes of this package travel by value."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def in_worker(name: str, make: Callable[[], object]):
    """What `make` makes, once in each Python worker: later tasks of the worker get the same object."""
    kept = sys.modules.setdefault("_corpusloom_worker", types.ModuleType("_corpusloom_worker"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)


#: Rows of an Arrow batch between the JVM and a worker, at most.
BATCH_ROWS = 2_000


def release() -> None:
    """Gives memory that is free back to the system: a worker that waits for its next task, of whatever stage, holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow, after which each task gives its free memory back.

    Texts may be long, so the session's Arrow batches are brought down to BATCH_ROWS rows, if they have more.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(rows, "0")) <= BATCH_ROWS:
        df.sparkSession.conf.set(rows, str(BATCH_ROWS))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(tidy, schema)


def forget(name: str) -> None:
    """Lets go of what in_worker keeps under a name."""
    kept = sys.modules.get("_corpusloom_worker")
    if kept is not None and hasattr(kept, name):
        delattr(kept, name)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than there are cores, dealt out to all of them; a scan of a large table stays as it is.

    A file of one row group is one task however many splits are planned. df: a scan, with no shuffle in it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


# ---- vectorised tokens -------------------------------------------------------------------------------------------


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, n + 1 offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if large else np.int32)[at : at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def power_table(n: int, base: int = HASH_BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


HASHED_BYTES = 1 << 20
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """power_table, kept for sizes up to a megabyte."""
    if n > HASHED_BYTES + 1:
        return power_table(n, base)
    if base not in _POWERS:
        _POWERS[base] = power_table(HASHED_BYTES + 1, base)
    return _POWERS[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


INVERSE_BASE = pow(HASH_BASE, -1, 1 << 64)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word of all texts, words per text, starts, ends): lower-cased A-Z, the word rule above."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SPACE_BYTES[raw]
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    before[first] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(solid & ~after) + 1
    hashes, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):  # a megabyte at a time, cut between words
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + HASHED_BYTES, side="right")))
        base, part = starts[at], raw[starts[at] : ends[to - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(HASH_CODES[LOWER_BYTES[part]] * powers(len(part), HASH_BASE), out=sums[1:])
        hashes[at:to] = (sums[ends[at:to] - base] - sums[starts[at:to] - base]) * powers(len(part) + 1, INVERSE_BASE)[starts[at:to] - base]
        at = to
    hashes = mix(hashes ^ (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return hashes, counts, starts, ends


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces whose texts have about `most` bytes at a time, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
