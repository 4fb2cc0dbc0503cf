"""Helpers shared by the training-data operators: scratch tables in the shared folder,
text buffers of Arrow batches, and vectorised word and shingle hashes.

A word is a maximal run of bytes other than space and 0x09-0x0D of the UTF-8 text.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import checkpoint_dir

# Word pattern of the contracts, for Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
# Largest table of short rows (a few numbers or one digest) that is broadcast: below 32 MB.
BROADCAST = 200_000
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
# Documents are handled in slices of about this many bytes inside a task.
SLICE_BYTES = 1 << 19


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back: later actions reuse the
    rows, and a lost executor costs a re-read, not a recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def need(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast to the given types; extra columns never clash later."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()])


def small(df: DataFrame, rows: int = BROADCAST) -> DataFrame:
    """``df``, a written table of short rows, marked for broadcast if it has at most ``rows``
    rows; else it stays as it is and its joins shuffle both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def limit_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes from now on in this session:
    with rows of whole texts, Spark's usual 10,000 take tens of MB in the JVM and again in each worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(task: Callable) -> Callable:
    """A task's function that gives freed memory back to the system when it ends: workers
    are kept from task to task, and a heap that only grew would be held by idle ones."""
    def run(data):
        out = task(data)
        if not isinstance(out, Iterator):
            release()
            return out
        return _released(out)

    return run


def _released(out: Iterator) -> Iterator:
    try:
        yield from out
    finally:
        release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


# ---------------------------------------------------------------------------- buffers

def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 row bounds; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, bounds, data = col.buffers()
    bounds = np.frombuffer(bounds, np.int64, len(col) + 1, col.offset * 8) if bounds else np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``most`` bytes; a longer row has a range of its own."""
    a, rows = 0, len(bounds) - 1
    while a < rows:
        b = int(np.searchsorted(bounds, bounds[a] + most, "right")) - 1
        b = min(max(b, a + 1), rows)
        yield a, b
        a = b


# ---------------------------------------------------------------------------- hashing

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_BYTE_LOWER = _BYTE[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)          # odd, so it has an inverse modulo 2**64
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_STEP = _rng.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(max(n, SLICE_BYTES + 4096), base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_bounds(data: np.ndarray, bounds: np.ndarray, cut_before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (n + 1).
    With ``cut_before``, a mask of bytes, words are also cut between an ASCII letter and such a byte."""
    full = np.empty(len(data) + 2, bool)
    full[0] = full[-1] = False
    np.logical_not(_BLANK[data], out=full[1:-1])
    change = full[1:] != full[:-1]
    start = change & full[1:]
    end = change & full[:-1]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    cut = inner[full[inner] & full[inner + 1]]   # two rows' words that touch
    start[cut] = True
    end[cut] = True
    if cut_before is not None and len(data) > 1:
        more = np.flatnonzero(_LETTER[data[:-1]] & cut_before[data[1:]]) + 1
        start[more] = True
        end[more] = True
    start, end = np.flatnonzero(start), np.flatnonzero(end)
    return start, end, np.searchsorted(start, bounds)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word: differences of prefix sums of a polynomial in the base."""
    p, q = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * p[:len(data)], out=total[1:])
    h = (total[end] - total[start]) * q[start]
    return mix(h + (end - start).astype(np.uint64))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in text order and, for each row, the index of its first
    one (n + 1).  A row of 1 to k - 1 words has its whole sequence as one shingle; a row
    without words has none."""
    words = np.diff(first)
    count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    at = np.zeros(len(first), np.int64)
    np.cumsum(count, out=at[1:])
    row = np.repeat(np.arange(len(words)), count)
    pos = first[:-1][row] + (np.arange(at[-1]) - at[:-1][row])
    size = np.minimum(words, k)[row]
    out = np.full(at[-1], 0, np.uint64)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    for j in range(k):
        term = padded[pos + j] * _STEP[j]
        if j:
            term[size <= j] = 0
        out += term
        out ^= out >> np.uint64(29)
    return mix(out + size.astype(np.uint64)), at


def sets_of(col: pa.Array, k: int, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices [a, b) of the rows: the sorted distinct shingle hashes of every row, one
    after the other, and the n + 1 row bounds in that array."""
    data, bounds = text_buffer(col)
    for a, b in slices(bounds):
        part, cut = data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a]
        start, end, first = word_bounds(part, cut)
        h, at = shingles(word_hashes(part, start, end, lower), first, k)
        out = [np.unique(h[at[i]:at[i + 1]]) for i in range(b - a)]
        edge = np.zeros(b - a + 1, np.int64)
        np.cumsum([len(x) for x in out], out=edge[1:])
        yield a, b, (np.concatenate(out) if out else np.zeros(0, np.uint64)), edge
