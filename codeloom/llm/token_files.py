"""Token ids in binary files with Elias-Fano document boundaries.

Every text is encoded, an end id is appended, and the ids of consecutive documents (by
doc_id) stand one after the other in a segment.  A segment holds, in this order:

    magic "TKEF", then little-endian: u32 part, u32 segment, u64 documents, u64 ids,
    u8 id width (2 or 4 bytes), u8 low bits l, u16 zero, u64 bytes of the high part
    doc ids      u64 null ids (they come first), i64 smallest id, u8 low bits, u64 bytes of the high
                 part, then low part, high part and select samples of the others less the smallest
    low part     the l low bits of each boundary, packed
    high part    the upper bits in unary (bit (b >> l) + i is set for boundary i)
    select       u32 position of every 256th set bit of the high part
    ids          the concatenated ids

A boundary is where a document ends, so there are as many as documents, and they take
about 2 + log2(ids / documents) bits each.  ``bounds_at`` finds single boundaries through
the select samples without decoding the rest; no 64-bit table of offsets or ids exists anywhere:
the ids ascend too, and take about 2 + log2(their range / documents) bits each.

Segments are rows of a text writer with one-byte separators, so they are written to and
read from whatever file system Spark uses; a file holds a bounded number of segments.

Cases: null and empty texts have the end id alone; a document longer than a segment makes a
segment of its own; rows with equal doc_id follow each other and stay separate; null
doc_ids come first; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.session import table

from .common import limit_batches, need, scratch, slices, text_buffer, tidy, word_bounds, word_hashes

MAGIC = b"TKEF"
HEAD = struct.Struct("<4sIIQQBBHQ")
ID_HEAD = struct.Struct("<QqBQ")
SEGMENT_IDS = 1 << 20     # ids of a segment, unless one document has more
FILE_SEGMENTS = 4         # segments of a file
SAMPLE = 256              # one select sample for so many boundaries
CACHE_PIECES = 1_000_000  # encoded pieces that a worker keeps, about 30 bytes each


# ------------------------------------------------------------------------- Elias-Fano

def ef_encode(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """(low bits, low part, high part, select samples) of a non-decreasing sequence from 0 to 2^64 - 1."""
    n = len(values)
    if not n:
        return 0, b"", b"", b""
    values = values.astype(np.uint64)
    low = max(0, (int(values[-1]) // n).bit_length() - 1)
    bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if low else np.zeros((n, 0), np.uint8)
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1, np.uint8)
    high[ones] = 1
    return (low, np.packbits(bits.ravel(), bitorder="little").tobytes(),
            np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())


def ef_decode(n: int, low: int, low_part: bytes, high_part: bytes) -> np.ndarray:
    """The whole sequence, unsigned."""
    if not n:
        return np.zeros(0, np.uint64)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(high_part, np.uint8), bitorder="little"))[:n]
    out = (ones - np.arange(n)).astype(np.uint64) << np.uint64(low)
    if low:
        bits = np.unpackbits(np.frombuffer(low_part, np.uint8), bitorder="little")[:n * low].reshape(n, low)
        out = out + (bits.astype(np.uint64) << np.arange(low, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return out


def ef_get(i: int, low: int, low_part: bytes, high_part: bytes, select: bytes) -> int:
    """Element i alone: from the sample before it, over at most SAMPLE set bits."""
    at = struct.unpack_from("<I", select, 4 * (i // SAMPLE))[0]
    left = i % SAMPLE
    byte = at >> 3
    word = high_part[byte] & (0xFF << (at & 7))
    while (ones := word.bit_count()) <= left:
        left -= ones
        byte += 1
        word = high_part[byte]
    for _ in range(left):
        word &= word - 1
    one = byte * 8 + (word & -word).bit_length() - 1
    rest = 0
    for j in range(low):
        bit = i * low + j
        rest |= (low_part[bit >> 3] >> (bit & 7) & 1) << j
    return (one - i << low) | rest


# --------------------------------------------------------------------------- segments

def pack_ids(doc_ids: list) -> bytes:
    """Ascending ids, null ones first."""
    absent = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[absent:], np.int64)
    base = int(known[0]) if len(known) else 0
    # Differences of two int64 may pass int64; as unsigned numbers they are right.
    low, low_part, high_part, select = ef_encode(known.view(np.uint64) - np.uint64(base % 2**64))
    return b"".join((ID_HEAD.pack(absent, base, low, len(high_part)), low_part, high_part, select))


def pack_segment(part: int, number: int, doc_ids: list, ends: np.ndarray, ids: np.ndarray) -> bytes:
    n = len(doc_ids)
    low, low_part, high_part, select = ef_encode(ends)
    head = HEAD.pack(MAGIC, part, number, n, len(ids), ids.dtype.itemsize, low, 0, len(high_part))
    return b"".join((head, pack_ids(doc_ids), low_part, high_part, select, ids.tobytes()))


class Segment:
    """One segment of a file's bytes, beginning at ``at``; ``end`` is where it stops."""

    def __init__(self, data: memoryview, at: int):
        magic, self.part, self.number, n, size, width, self.low, _, high = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        self.n = n
        at += HEAD.size
        self.absent, self.base, self.id_low, id_high = ID_HEAD.unpack_from(data, at)
        at += ID_HEAD.size

        def sequence(count: int, low: int, high: int) -> tuple[bytes, bytes, bytes]:
            nonlocal at
            out = []
            for width in (-(-count * low // 8), high, 4 * -(-count // SAMPLE)):
                out.append(bytes(data[at:at + width]))
                at += width
            return tuple(out)

        self.id_parts = sequence(n - self.absent, self.id_low, id_high)
        self.low_part, self.high_part, self.select = sequence(n, self.low, high)
        self.ids = np.frombuffer(data, f"<u{width}", size, at)
        self.end = at + size * width

    def doc_ids(self) -> pa.Array:
        known = ef_decode(self.n - self.absent, self.id_low, *self.id_parts[:2]) + np.uint64(self.base % 2**64)
        return pa.concat_arrays([pa.nulls(self.absent, pa.int64()), pa.array(known.view(np.int64))])

    def doc_id_at(self, i: int) -> int | None:
        """The id of document i of the segment."""
        return None if i < self.absent else self.base + ef_get(i - self.absent, self.id_low, *self.id_parts)

    def ends(self) -> np.ndarray:
        return ef_decode(self.n, self.low, self.low_part, self.high_part).astype(np.int64)

    def bounds_at(self, i: int) -> tuple[int, int]:
        """Where document i of the segment begins and ends in its ids."""
        get = lambda k: ef_get(k, self.low, self.low_part, self.high_part, self.select)
        return (get(i - 1) if i else 0), get(i)


def segments(content) -> Iterator[Segment]:
    data, at = memoryview(content), 0
    while at < len(data):
        one = Segment(data, at)
        yield one
        at = one.end + 1  # the writer's separator


# --------------------------------------------------------------------------- encoding

# Between an ASCII letter and one of these, every pre-token ends.  Without the characters of
# special tokens, which must stay whole, and the apostrophe.
_CUT = np.zeros(256, bool)
_CUT[[c for c in b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = True


class PieceEncoder:
    """Encodes texts piece by piece.  Pre-tokens of the tokenizer never span blanks nor the
    cuts above, and it lowers case, so the ids of a text are those of its lowered pieces; each
    distinct piece is encoded once while the cache, sorted arrays of piece hashes, holds it."""

    def __init__(self, tokenizer_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.main, self.recent = none, none     # (sorted hashes, their numbers)
        self.at, self.ids = np.zeros(1, np.int32), np.zeros(0, self.dtype)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash in the cache, -1 if it isn't there."""
        out = np.full(len(hashes), -1, np.int64)
        for keys, number in (self.main, self.recent):
            if len(keys):
                i = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                np.copyto(out, number[i], where=keys[i] == hashes)
        return out

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        got = []
        for i in range(0, len(texts), 1000):
            got += [x.ids for x in self.tokenizer.encode_batch_fast(texts[i:i + 1000], add_special_tokens=False)]
        first = len(self.at) - 1
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x in got], dtype=np.int32)])
        self.ids = np.concatenate([self.ids, np.array([i for x in got for i in x], self.dtype)])
        add = hashes, np.arange(first, first + len(texts), dtype=np.int32)
        joined = [np.concatenate(x) for x in zip(self.recent, add, strict=True)]
        if len(joined[0]) > 1 << 16:
            joined = [np.concatenate(x) for x in zip(self.main, joined, strict=True)]
        order = np.argsort(joined[0], kind="stable")
        both = joined[0][order], joined[1][order]
        if len(both[0]) > 1 << 16:
            self.main, self.recent = both, (both[0][:0], both[1][:0])
        else:
            self.recent = both

    def encode(self, data: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and the position after each text."""
        raw = data.tobytes()
        if b"<|" in raw:  # may hold special tokens, for which case counts
            got = [self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids + [end_id]
                   for a, b in zip(bounds, bounds[1:], strict=False)]
            return np.array([i for x in got for i in x], self.dtype), np.cumsum([len(x) for x in got], dtype=np.int64)
        start, end, first = word_bounds(data, bounds, _CUT)
        seen, at, back = np.unique(word_hashes(data, start, end, lower=True), return_index=True, return_inverse=True)
        number = self.numbers(seen)
        if (number < 0).any():
            if len(self.at) + len(seen) > CACHE_PIECES:
                self.clear()
                number[:] = -1
            new = np.flatnonzero(number < 0)
            self.learn(seen[new], [raw[start[i]:end[i]].decode() for i in at[new]])
            number = self.numbers(seen)
        number = number[back]
        from_ids = self.at[number].astype(np.int64)
        n_ids = self.at[number + 1] - from_ids
        before = np.zeros(len(number) + 1, np.int64)
        np.cumsum(n_ids, out=before[1:])
        rows = len(bounds) - 1
        ends = before[first[1:]] + np.arange(1, rows + 1)
        out = np.full(before[-1] + rows, end_id, self.dtype)
        keep = np.ones(len(out), bool)
        keep[ends - 1] = False
        out[keep] = self.ids[np.repeat(from_ids - before[:-1], n_ids) + np.arange(before[-1])]
        return out, ends


_encoders: dict[str, PieceEncoder] = {}


def encoder_for(tokenizer_file: str) -> PieceEncoder:
    """The worker process's encoder, kept from task to task."""
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = PieceEncoder(tokenizer_file)
    return _encoders[tokenizer_file]


def _segment_rows(tokenizer_file: str, end_id: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        encoder = encoder_for(tokenizer_file)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, number
            docs = [d for x in held for d in x[0]]
            shift = np.cumsum([0, *(len(x[2]) for x in held)])
            ends = np.concatenate([x[1] + s for x, s in zip(held, shift, strict=False)])
            row = pack_segment(part, number, docs, ends, np.concatenate([x[2] for x in held]))
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()), pa.array([row], pa.binary())],
                ["part", "segment", "ids", "content"])
            held, size, number = [], 0, number + 1
            return out

        for batch in batches:
            data, bounds = text_buffer(batch.column("text"))
            for a, b in slices(bounds):
                docs = batch.column("doc_id").slice(a, b - a).to_pylist()
                ids, ends = encoder.encode(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a], end_id)
                if held and size + len(ids) > segment_ids:
                    yield flush()
                held.append((docs, ends, ids))
                size += len(ids)
        if held:
            yield flush()

    return run


def write_token_files(documents: DataFrame, path: str, tokenizer_file: str, end_id: int,
                      segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``documents(doc_id, text)`` in ascending doc_id order into files under ``path``.

    The texts are dealt out by ranges of doc_id (rows of one doc_id also by their text) and
    sorted within a range; a task encodes its range segment by segment."""
    spark = documents.sparkSession
    limit_batches(spark)
    docs = need(documents, doc_id="bigint", text="string").withColumn("h", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (docs.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")
            .select("doc_id", "text")
            .mapInArrow(tidy(_segment_rows(tokenizer_file, end_id, segment_ids)), "part int, segment int, ids bigint, content binary"))
    rows.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def _read_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            for s in segments(content.as_buffer()):
                ends = s.ends()
                starts = np.concatenate([[0], ends[:-1]])
                raw = s.ids.astype("<u4")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s.part] * s.n, pa.int32()), pa.array([s.number] * s.n, pa.int32()),
                     s.doc_ids(), pa.array(starts), pa.array(ends - starts),
                     pa.array(crc, pa.int64())],
                    ["part", "segment", "doc_id", "local", "n_tokens", "ids_crc32"])


def _read_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [(s.part, s.number, len(s.ids)) for c in batch.column("content") for s in segments(c.as_buffer())]
        yield pa.RecordBatch.from_pydict(dict(zip(("part", "segment", "n"), map(list, zip(*got, strict=True)), strict=True)) if got
                                         else {"part": [], "segment": [], "n": []},
                                         pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n", pa.int64())]))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(tidy(_read_segments), "part int, segment int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    sizes = files.mapInArrow(_read_heads, "part int, segment int, n bigint")
    # Ids before a segment: those of earlier parts, then of earlier segments of its part.
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    inside = sizes.select("part", "segment", (F.sum("n").over(W.partitionBy("part").orderBy("segment")) - F.col("n")).alias("inside"))
    first = inside.join(before, "part").select("part", "segment", (F.col("before") + F.col("inside")).alias("first"))
    return rows.join(first, ["part", "segment"]).select(
        "doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_files(spark: SparkSession, documents: DataFrame, tokenizer_file: str, end_id: int = 1,
                path: str | None = None) -> DataFrame:
    """Write the files of ``documents`` and return what they hold, per document."""
    path = path or scratch(spark, "token-files")
    write_token_files(documents, path, tokenizer_file, end_id)
    return read_token_files(spark, path)


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, table(spark, sf_dir, "documents"), word_bpe())
