"""Vectorised text kernels and session helpers used by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy kernels hold at a time; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20
#: The same for kernels that make many arrays of words: they take some 60 times a chunk's bytes at their peak.
SMALL_CHUNK = 1 << 18
#: What operators keep in a worker from task to task, by operator.
HELD: dict[str, dict] = {}
#: Bytes of a span beyond which it is hashed on its own.
LONG = 128

#: The six ASCII white space characters, and everything else.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """Consecutive documents as one byte array; document i is data[bounds[i]:bounds[i+1]]."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds, self.n = data, bounds, len(bounds) - 1
        self._eights: np.ndarray | None = None

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes that are inside; no run crosses documents."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.empty(len(inside), bool)
        first[0], first[1:] = True, ~inside[:-1]
        at = self.bounds[:-1]
        first[at[at < len(inside)]] = True
        last = np.empty(len(inside), bool)
        last[-1], last[:-1] = True, ~inside[1:]
        to = self.bounds[1:]
        last[to[to > 0] - 1] = True
        return np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(NOT_SPACE[self.data])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of spans; equal spans have equal hashes wherever they stand.

        Short spans are mixed eight bytes at a time, all spans at once; long ones are hashed one by one.
        """
        if self._eights is None:
            padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
            self._eights = np.ndarray((len(self.data) + 1,), "<u8", padded.data, strides=(1,))
        length = ends - starts
        out = mix(length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
        at = np.flatnonzero((length > 0) & (length <= LONG))
        step = 0
        while len(at):
            left = length[at] - step
            word = self._eights[starts[at] + step]
            short = left < 8
            word[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
            out[at] = mix(out[at] * np.uint64(0x9E3779B97F4A7C15) ^ word)
            at, step = at[left > 8], step + 8
        for k in np.flatnonzero(length > LONG).tolist():
            out[k] = xxhash.xxh64_intdigest(self.data[starts[k] : ends[k]].data)
        return out

    def document(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, starts, side="right") - 1

    def total(self, per_byte: np.ndarray) -> np.ndarray:
        """For each document the sum over its bytes."""
        sums = np.zeros(len(per_byte) + 1, np.int64)
        np.cumsum(per_byte, out=sums[1:])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts) of consecutive rows of a string column; null reads as empty."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    all_bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(at, at[row] + most, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, Texts(all_bytes[at[row] : at[end]], at[row : end + 1] - at[row])
        row = end


def release() -> None:
    """Hands memory that is no longer used back to the machine; allocators keep it otherwise, and a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def hand_back(but: str = "") -> None:
    """Empties what operators keep in this worker, but for one of them: a worker serves one stage after another."""
    for name, kept_there in HELD.items():
        if name != but:
            kept_there.clear()


def lean(batches: Iterator[pa.RecordBatch], of: str = "") -> Iterator[pa.RecordBatch]:
    """The batches; what earlier ones took is released before the next, and before the first what operators other than `of` keep."""
    hand_back(of)
    for b in batches:
        yield b
        del b
        release()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset."""
    own = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    set_to = own or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_to = tempfile.mkdtemp(prefix="rasterloom-")
    if not own:
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path; for loops, as what is read again keeps nothing of the old plan."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a saved table that no later step reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, so that others can't clash with its own."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as df's columns leave."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(doc_id):
    """crc32 of the id written as text, mod 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5
