"""What the operators of this subpackage share: session helpers and vectorised text hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of the contracts: runs of anything but space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
_M64 = (1 << 64) - 1
#: Text bytes hashed at once; keeps the 64-bit work arrays inside the cache of a core.
CHUNK_BYTES = 1 << 20
#: Spark's bound on the bytes of an Arrow batch, and what `bounded_batches` sets: the JVM and the Python worker hold some copies of a batch each.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one that spark.checkpoint.dir names.

    Only a local session, whose executors are this machine, takes a temporary folder where that
    setting is absent; on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="loomsift-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder wherever Spark's file systems have it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's batches to Python have about BATCH_BYTES, however long the texts of their 10,000 rows are.

    A bound that the session has set itself stays. Rows are cut into batches alone; none is left out.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


_FOLDERS: ContextVar[list[str] | None] = ContextVar("folders", default=None)


def written(df: DataFrame) -> DataFrame:
    """`df` written as Parquet in the shared folder, and read from there: what its rows hold is fixed from then on."""
    folder = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    if (folders := _FOLDERS.get()) is not None:
        folders.append(folder)
    return df.sparkSession.read.parquet(folder)


@contextmanager
def folders_removed(spark: SparkSession):
    """What `written` writes inside goes at the end."""
    token = _FOLDERS.set([])
    try:
        yield
    finally:
        for folder in _FOLDERS.get():
            remove(spark, folder)
        _FOLDERS.reset(token)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or with underscores behind it as long as a column of `df` has it; case doesn't count."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_splits(df: DataFrame) -> int:
    """Input splits of a frame: a size measure that needs no job and follows the data."""
    return max(1, df.rdd.getNumPartitions())


def train_filter(key: str, folds: int, held: int):
    """True for rows whose crc32(key as text) mod folds is not the held-out remainder."""
    return F.crc32(F.col(key).cast("string")) % folds != held


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche; wraps modulo 2**64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that no letter holds: ASCII but A-Z and a-z.
NO_LETTER = np.arange(256) < 128
NO_LETTER[65:91] = NO_LETTER[97:123] = False
#: A 64-bit value per (lower-cased) byte.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))[_LOWER]
#: Multipliers that place a word in a shingle; the last marks the number of words.
_PLACE = mix64(np.arange(1001, 1065, dtype=np.uint64) * np.uint64(0xF1DE83E19937733D)) | np.uint64(1)
#: Multipliers of the first places of a word; those of later places are computed when needed.
_FIRST = 1 << 12


def places(first: int, last: int) -> np.ndarray:
    """Odd multipliers, without a rule that a text could follow, of the places first to last - 1."""
    return mix64(mix64(np.arange(first + 1, last + 1, dtype=np.uint64) * np.uint64(_ODD)) + np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)


_AT = places(0, _FIRST)


def lowered_texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte ranges, each of whole characters, as texts with A-Z lower-cased."""
    sizes = (ends - starts).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, sizes)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_LOWER[data[at]])).cast(pa.string())


def range_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per range the sum of its values, each times the multiplier of its place; equal ranges give equal sums anywhere.

    Ranges are in order, apart and not empty.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    most = int((ends - starts).max())
    factor = _AT if most <= _FIRST else np.concatenate([_AT, places(_FIRST, most)])
    own, low = starts.astype(np.int32), int(starts[0])
    place = np.arange(low, len(values), dtype=np.int32) - np.repeat(own, np.diff(own, append=np.int32(len(values))))
    total = np.zeros(len(values) + 1, np.uint64)
    # What lies between ranges cancels out.
    np.cumsum(values[low:] * np.take(factor, place, mode="clip"), out=total[low + 1 :])
    return total[ends] - total[starts]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (rows + 1) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES):
    """Ranges of rows of about `size` bytes each, at least one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of each row, and the row's first word (rows + 1); `apart` marks bytes between words."""
    held = ~apart[data]
    before = np.empty_like(held)
    before[1:], before[:1] = held[:-1], False
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False
    starts = np.flatnonzero(held & ~before)
    after = np.empty_like(held)
    after[:-1], after[-1:] = held[1:], False
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(held & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges (in order, apart) with A-Z lower-cased; equal bytes give equal hashes anywhere."""
    return mix64(range_sums(_BYTE[data], starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and each row's first word (rows + 1)."""
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of `width` words; a row with fewer words has its whole sequence as one.

    Also gives each row's first shingle (rows + 1). A row without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], count) + np.repeat(first[:-1], count)
    left = np.repeat(first[1:], count) - at
    total = _PLACE[32 + np.minimum(left, width)] if len(at) else np.empty(0, np.uint64)
    for j in range(width):
        inside = left > j
        if inside.all():
            total = total + words[at + j] * _PLACE[j]
        else:
            total[inside] += words[at[inside] + j] * _PLACE[j]
    return mix64(total), begin
