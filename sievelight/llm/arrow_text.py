"""Vectorised tokenisation of Arrow string columns.

All functions work on the UTF-8 bytes of a whole Arrow batch at once, so a word costs a few array
operations instead of a Python object.  Words are represented by 64-bit hashes.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

#: Rows of a batch that are worked on at once; rows that Spark hands over at once.
ARROW_ROWS, BATCH_ROWS = 512, 1000
#: Parts in which the driver reads a table of bounded size.
DRIVER_PARTS = 8
#: Bytes tokenised at once; keeps the working arrays of a task at about 60 MB.
CHUNK_BYTES = 1 << 20

_RNG = np.random.default_rng(20240229)
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
ALNUM = np.ones(256, dtype=bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x41] = ALNUM[0x5B:0x61] = ALNUM[0x7B:0x80] = False


def bounded_batches(df):
    """df, whose session hands at most BATCH_ROWS rows at once to Python functions from now on: a larger batch stands several
    times in an executor's memory.  Spark reads the bound when it plans a query, so it cannot be one query's own; a smaller one
    is left as it is."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def to_driver(df):
    """Rows of a table of bounded size, a part at a time.  Spark runs a job for each part, and the driver keeps the account of every job:
    one for each of some hundred shuffle partitions, most of them empty, would cost it more than the rows do."""
    return df.coalesce(DRIVER_PARTS).toLocalIterator()


def pieces(batches, rows: int = ARROW_ROWS):
    """Record batches cut to at most `rows` rows, without a copy; Spark bounds the bytes of a batch (64 MiB unless set
    otherwise), so a long document makes its batch short.  What a worker does not need any more goes back at the end."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges [i, j) of documents of about `limit` bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Hashes and byte spans of the words of documents, and each document's first word number.

    A-Z count as a-z.  Returns (hash uint64, start, end, first) where first has one entry more than
    there are documents."""
    n = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(n + 1, np.int64)
    inside = is_word[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge] = False
    after[edge - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), start, end, first
    length = end - start
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(start, np.diff(np.append(start, len(data))) if start[0] == 0 else np.diff(np.append(np.append(0, start[1:]), len(data))))
    value = _BYTE_VALUE[LOWER[data]]
    if int(length.max()) > len(_PLACE):
        far = np.maximum(place, 0) >> 12
        value = value * (mix(far.astype(np.uint64) + _STEP) | np.uint64(1))
    value *= _PLACE[place & 4095]
    value[~inside] = 0
    hashed = np.add.reduceat(value, start)
    return mix(hashed + length.astype(np.uint64) * _STEP), start, end, first


def sequence_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` consecutive words, by the number of its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(width), np.uint64)
    for i in range(width):
        out = mix(out * _STEP + hashes[i : i + n])
    return out
