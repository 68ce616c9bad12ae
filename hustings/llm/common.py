"""What the operators of this package share: table reading, checkpoints and word hashing on Arrow buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and has one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="hustings-checkpoint-"))
    return sc.getCheckpointDir()


#: Spark's setting that removes a query's shuffle files at its end.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, path: str | None = None, release: bool = False) -> DataFrame:
    """Write to the shared folder and read back, so that a lost executor costs a reread and no recomputation.

    With `release` the shuffle files of this write go as soon as it ends; nothing else reads them."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    if not release:
        df.write.parquet(path)
    else:
        before = spark.conf.get(CLEAN_SHUFFLES, None)
        spark.conf.set(CLEAN_SHUFFLES, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                spark.conf.unset(CLEAN_SHUFFLES)
            else:
                spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later step reads."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Up to so many rows of a few numbers each a list is broadcast, after it was counted; a longer one is shuffled.
BROADCAST_ROWS = 500_000


def lean(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written list, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: The six ASCII white-space bytes that end a word.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SEGMENT = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Tables:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.size = 0
        with np.errstate(over="ignore"):
            self.byte = mix(np.arange(1, 257, dtype=np.uint64) * _BASE) | np.uint64(1)
        self.byte[65:91] = self.byte[97:123]

    def grow(self, n: int) -> None:
        if n <= self.size:
            return
        base, inverse = int(_BASE), pow(int(_BASE), -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]), dtype=np.uint64)
        self.size = n


_TABLES = _Tables()


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without decoding; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the index of its first word (one more at the end)."""
    solid = ~white[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, with A-Z lower-cased: differences of a polynomial prefix sum, then mixed."""
    n = len(raw)
    if not len(starts):
        return np.zeros(0, np.uint64)
    _TABLES.grow(n)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLES.byte[raw] * _TABLES.up[:n], dtype=np.uint64, out=sums[1:])
        own = (sums[ends] - sums[starts]) * _TABLES.down[starts]
        return mix(own + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of slices of about SEGMENT bytes; a longer text is a slice of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SEGMENT, "right")) - 1)
        yield row, end
        row = end


def hashed_texts(batch: pa.RecordBatch, text: str, white: np.ndarray = WHITE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, first word of each row) for slices of about SEGMENT bytes.

    A longer text is a slice of its own; its words are hashed in parts, so that the working memory follows SEGMENT.
    """
    raw, offsets = texts_of(batch.column(text))
    for row, end in slices(offsets):
        part, at = raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        starts, ends, firsts = word_spans(part, at, white)
        if len(part) <= 2 * SEGMENT:
            hashes = word_hashes(part, starts, ends)
        else:
            hashes = np.empty(len(starts), np.uint64)
            k = 0
            while k < len(starts):
                to = max(k + 1, int(np.searchsorted(ends, starts[k] + SEGMENT, "right")))
                low = starts[k]
                hashes[k:to] = word_hashes(part[low : ends[to - 1]], starts[k:to] - low, ends[k:to] - low)
                k = to
        yield row, end, hashes, firsts
