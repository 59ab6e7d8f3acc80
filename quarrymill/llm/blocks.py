"""Vectorised text blocks: UTF-8 texts of many rows as one byte array plus offsets.

The Arrow operators work on slices of a few megabytes (`slices`), so a worker's memory follows
the slice and the longest single text, never the partition.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import discard, files_for, fresh_path, stored  # noqa: F401  used by the operators of this folder

SLICE_BYTES = 2 << 20
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20
PART_BYTES = 64 << 20
_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_powers: dict[int, np.ndarray] = {}


def arrow_rows(spark: SparkSession) -> None:
    """Arrow batches of at most 512 rows and about 4 MB in this session: texts are long, workers are small. One value for all operators; a smaller one of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not re.fullmatch(r"[1-9]\d*b?", held := spark.conf.get(key)) or int(held.rstrip("b")) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, which gives its memory back to the system at its end.

    Workers live on beside the JVM after their task; what their allocators keep would stand against its stages too. Long tables of powers go as well."""

    @functools.wraps(run)
    def with_release(batches):
        try:
            yield from run(batches)
        finally:
            for base in [b for b, table in _powers.items() if len(table) > 1 << 18]:
                del _powers[base]
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other libraries don't
            if trim is not None:
                trim(0)

    return with_release


def parts_for(docs: DataFrame, text: str = "text", part_bytes: int = PART_BYTES) -> int:
    """Number of partitions for shuffles of what is derived from texts: the session's, or more where a part would stand for over `part_bytes` of text."""
    return parts_and_files(docs, text, part_bytes)[0]


def parts_and_files(docs: DataFrame, text: str = "text", part_bytes: int = PART_BYTES) -> tuple[int, int]:
    """parts_for, and the number of files for tables of what is derived."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    least = -(-size // part_bytes)
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), least), files_for(spark, least)


def slices(batches: Iterator[pa.RecordBatch], text: int | str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice have about `limit` bytes at most (a longer text is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def longs(column: pa.Array) -> pa.Array:
    return column.cast(pa.int64())


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _LOWER[data]


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true for the bytes that end a word."""
    table = np.zeros(256, bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


SPACE = separators((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def words(data: np.ndarray, offsets: np.ndarray, ends_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the byte array, and the index of each text's first word (one more entry than texts)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~ends_word[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept, with room to grow."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base & (2**64 - 1), np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def prefix_hash(data: np.ndarray, code: np.ndarray = _BYTE_CODE) -> np.ndarray:
    """Running sums that give the hash of any span in constant time."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * powers(len(data)), out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Cheap 64-bit hashes of spans, for choosing places; what decides whether texts are equal uses word_hash."""
    top = int(starts.max()) + 1 if len(starts) else 1
    return mix((prefix[ends] - prefix[starts]) * powers(top, _BASE_INV)[starts] + (ends - starts).astype(np.uint64))


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, long: int = 64) -> np.ndarray:
    """64-bit hashes of spans: eight bytes a round, every round mixed into the next; spans over `long` bytes by BLAKE2b.

    Unlike span_hash it is no sum over positions, so strings of regular structure (Thue-Morse strings, say) don't collide."""
    size = (ends - starts).astype(np.int64)
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    live, done = np.flatnonzero((size > 0) & (size <= long)), 0
    while len(live):
        left = size[live] - done
        block = eight[starts[live] + done] & _LOW_BYTES[np.minimum(left, 8)]
        out[live] = mix(out[live] ^ (block * np.uint64(0xD6E8FEB86659FD93)))
        done += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > long).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def window_hash(items: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of `width` consecutive items (already 64-bit hashes)."""
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += items[k : k + n]
    return mix(out)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of the ranges start, start + 1, .. of the given lengths."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts.astype(np.int64) - before, lengths) + np.arange(total)


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags of the positions that lie in any of the spans."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def string_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column from bytes and offsets."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())
