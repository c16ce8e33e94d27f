"""Shared helpers: checkpoints in the cluster's shared folder, flat views of Arrow text."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python worker turns into arrays at a time (a single longer text goes alone).
BLOCK_BYTES = 1 << 20
#: ASCII white space: [\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, set from spark.checkpoint.dir.

    Only a local session without that setting (tests) gets a folder of its own;
    on a cluster the driver's disk would be out of the executors' reach.
    """
    context = spark.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if folder.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandline-"))
        folder = context._jsc.sc().getCheckpointDir()
    return folder.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder named by spark.checkpoint.dir and cut its lineage.

    A lost executor costs nothing that was written.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go now of the tables, shuffles and broadcasts that no frame holds any more.

    They go when the driver's collectors find them unheld.  Steps that repeat
    call this every time: else the driver's heap grows to its limit before
    anything is looked for, and the files of all rounds so far stay on disk.
    """
    gc.collect()  # frames that only Python's cycles still hold
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """`df` written as a compressed table in the shared folder, and read back: for rows with texts.

    The table goes when the application ends: results that are read later may need it until then.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values in one array, and the n + 1 offsets of the values; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that `column` holds about `limit` bytes at a time; no value is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes.astype(np.int64)), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of white-space separated words in flat text, and the number in each value.

    Words never cross from one value into the next.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    base = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix(base) | np.uint64(1)


_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_TABLES: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i for i < n; tables of up to 4 million are kept."""
    held = _TABLES.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), np.uint64(base))
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        if n <= 1 << 22:
            _TABLES[base] = held
    return held[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial modulo 2**64 over scrambled bytes, then mixed.

    Prefix sums make it one pass over the bytes whatever the number of spans.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    up, down = _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:n], out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
