"""Helpers shared by the operators: tables, words as numpy arrays, packed messages.

Words are the maximal runs of bytes other than space and 0x09-0x0D; in UTF-8 these
six bytes never occur inside a character, so words are found on bytes. Words and
shingles are named by 64-bit hashes.
"""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import pickle
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES = 4 << 20
BATCH_BYTES = 4 << 20
SLICE_ROWS = 1 << 17

_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(id_column: Column, folds: int) -> Column:
    """True for rows whose crc32 of the id as text is divisible by ``folds``; null ids are not."""
    return F.coalesce(F.crc32(id_column.cast("string")) % folds == 0, F.lit(False))


def partitions_of(spark: SparkSession) -> int:
    """Number of key buckets: as many as the cluster's shuffles have partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, so that long texts don't fill a Python worker; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def tidy(run):
    """The same task function, which gives freed memory back at its end: a worker outlives its tasks."""

    def release() -> None:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library can
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    def stream(batches):
        yield from run(batches)
        release()

    def group(rows: pa.Table) -> pa.Table:
        out = run(rows)
        release()
        return out

    return stream if inspect.isgeneratorfunction(run) else group


def worker_state(name: str) -> dict:
    """A dict that outlives the task in a Python worker.

    Functions travel by value, so each task has its own module globals; the module
    table is the worker's.
    """
    holder = sys.modules.setdefault("weft_worker_state", types.ModuleType("weft_worker_state"))
    return holder.__dict__.setdefault(name, {})


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; null rows are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, cut so that each part holds at most ``most`` bytes or one row."""
    _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
        end = min(end, start + SLICE_ROWS)
        yield batch.slice(start, end - start)
        start = end


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words before each row (rows + 1 long)."""
    if len(raw) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~_IS_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a step."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    length = ends - starts
    out = mix64(length.astype(np.uint64) + _ODD[0])
    active, done = np.arange(len(starts)), 0
    while len(active):
        left = length[active] - done
        active, left = active[left > 0], left[left > 0]
        if not len(active):
            break
        chunk = eight[starts[active] + done] & _KEEP[np.minimum(left, 8)]
        out[active] = mix64((out[active] ^ chunk) * _ODD[1])
        done += 8
    return out


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and the first word of each row (rows + 1 long)."""
    raw, at = text_bytes(texts)
    starts, ends, row = word_spans(raw, at)
    return hash_spans(_LOWERED[raw], starts, ends), row


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its ``width``-word shingles.

    Fewer words make one shingle of the whole sequence; a row without words has none.
    """
    words, row = hashed_words(texts)
    weights = _ODD[np.arange(width) % 5] + np.arange(width, dtype=np.uint64) * np.uint64(2)
    if len(words) >= width:
        windows = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            windows += words[k : len(words) - width + 1 + k] * weights[k]
        windows = mix64(windows)
    for start, end in zip(row[:-1].tolist(), row[1:].tolist()):
        n = end - start
        if n >= width:
            yield np.unique(windows[start : end - width + 1])
        elif n:
            short = (words[start:end] * weights[:n]).sum(dtype=np.uint64)
            yield mix64(np.array([short], np.uint64) + np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of equal rank lie together."""
    plain = pickle.dumps(
        [
            (a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes())
            for a in arrays
        ]
    )
    return len(plain).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(plain, asbytes=True)


def unpack(value: bytes) -> list[np.ndarray]:
    size = int.from_bytes(value[:8], "little")
    plain = pa.Codec("zstd").decompress(value[8:], size, asbytes=True)
    out = []
    for kind, planes in pickle.loads(plain):
        dtype = np.dtype(kind)
        a = np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, -1)
        out.append(np.ascontiguousarray(a.T).reshape(-1).view(dtype))
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of start .. start + count - 1."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(begin - starts, counts)


def batches_of(names_types: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=t) for c, (_, t) in zip(columns, names_types)],
        names=[n for n, _ in names_types],
    )
