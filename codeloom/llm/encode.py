"""Global dictionary encoding of words without a broadcast dictionary.

A shard is a slice of rows of bounded size.  Its distinct words get local numbers in the order
of their hashes, so the words of any hash range are one run.  Each shard sends one compact row
per range; a task per range (about RANGE_WORDS words, whatever the size of the corpus) numbers
its words and answers each shard with one array.  A word, however frequent, comes at most once
from a shard, so no key is hot; offsets of the ranges make the numbers dense.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import scratch, small, text_buffer, tidy, word_hashes

SHARD_BYTES = 4 << 20
RANGE_WORDS = 1 << 20
VOCABULARY = "words binary, sizes binary, times binary"   # of a shard: UTF-8 bytes, int32 lengths, int32 counts, all zipped
_DEALT = "range int, shard bigint, start int, " + VOCABULARY
_NUMBERED = "range int, shard bigint, start int, ids binary, " + VOCABULARY


def shard_numbers() -> Iterator[int]:
    """Numbers that no other task of the same stage gives; the table that holds them is written
    once and read from there."""
    n = TaskContext.get().partitionId() << 32
    while True:
        yield n
        n += 1


def zipped(a: np.ndarray, level: int = 1) -> bytes:
    """The array's bytes, compressed, behind their number: shuffles of packed arrays stay small.
    Lower bytes come before higher ones, which are nearly all equal."""
    a = np.ascontiguousarray(a).reshape(-1)
    raw = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "big") + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def unzipped(b: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "big"), codec="zstd", asbytes=True), np.uint8)
    return raw.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).reshape(-1)


def zstd(df: DataFrame, name: str) -> DataFrame:
    """``written`` with the compression that suits packed arrays."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data))


def _hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, bounds = text_buffer(words)
    return word_hashes(data, bounds[:-1], bounds[1:], False), data, np.diff(bounds)


def local_words(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, tuple[bytes, bytes, bytes]]:
    """The local number of every word (``data`` holds their bytes one after the other), and the
    shard's vocabulary in that order."""
    coded = _strings(data, sizes).dictionary_encode()
    order = np.argsort(_hashes(coded.dictionary)[0], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    local = place[coded.indices.to_numpy(zero_copy_only=False)]
    blob, bounds = text_buffer(coded.dictionary.take(pa.array(order)))
    times = np.bincount(local, minlength=len(order))
    return local, (zipped(blob), zipped(np.diff(bounds).astype("<i4")), zipped(times.astype("<i4")))


def _deal(ranges: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "shard", "start", "words", "sizes", "times"]
        for batch in batches:
            for shard, words, sizes, times in zip(*[batch.column(c).to_pylist() for c in ("shard", "words", "sizes", "times")]):
                size, words, times = unzipped(sizes, "<i4"), unzipped(words, "u1"), unzipped(times, "<i4")
                bounds = np.zeros(len(size) + 1, np.int64)
                np.cumsum(size, out=bounds[1:])
                h = word_hashes(words, bounds[:-1], bounds[1:], False)
                cut = np.searchsorted((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
                rows = [(r, shard, int(a), zipped(words[bounds[a]:bounds[b]]), zipped(size[a:b]), zipped(times[a:b]))
                        for r, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if a < b]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                        pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names)
    return run


def _number(least: int):
    @tidy
    def run(table: pa.Table) -> pa.Table:
        size = [unzipped(x, "<i4") for x in table["sizes"].to_pylist()]
        coded = _strings(np.concatenate([unzipped(x, "u1") for x in table["words"].to_pylist()]), np.concatenate(size)).dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        times = np.concatenate([unzipped(x, "<i4") for x in table["times"].to_pylist()])
        total = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, at, times)
        keep = np.flatnonzero(total >= least)
        number = np.full(len(total), -1, np.int64)
        number[keep] = np.arange(len(keep))
        ids = np.split(number[at].astype("<i4"), np.cumsum([len(s) for s in size])[:-1])
        blob, bounds = text_buffer(coded.dictionary.take(pa.array(keep)))
        part, none = table["range"][0].as_py(), [None] * len(ids)
        cols = ([part] * (len(ids) + 1), table["shard"].to_pylist() + [None], table["start"].to_pylist() + [None],
                [zipped(x) for x in ids] + [None], none + [zipped(blob)], none + [zipped(np.diff(bounds).astype("<i4"))],
                none + [zipped(total[keep].astype("<i8"))])
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4))],
                        ["range", "shard", "start", "ids", "words", "sizes", "times"])
    return run


def _length(col: str) -> Column:
    """Bytes of a zipped column before compression."""
    return F.conv(F.hex(F.substring(col, 1, 8)), 16, 10).cast("bigint")


def number_words(shards: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(dictionary, numbers) of ``shards(shard, words, sizes, times)``, a written table.  The
    dictionary has a row per hash range: ``start``, the number of its first word, and the packed
    words that occur at least ``least`` times (their ``times`` int64); ``word_rows`` unpacks it.
    ``numbers(shard, map)`` goes to ``global_numbers``."""
    words = shards.agg(F.sum(_length("sizes") / 4)).first()[0] or 0
    ranges = int(words // RANGE_WORDS) + 1
    dealt = shards.select("shard", "words", "sizes", "times").mapInArrow(_deal(ranges), _DEALT)
    rows = zstd(dealt.groupBy("range").applyInArrow(_number(least), _NUMBERED), "numbered")
    kept = (_length("sizes") / 4).cast("bigint")
    # The window has one row per hash range.
    starts = rows.where("shard IS NULL").select("range", kept.alias("n")).select(
        "range", (F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("first"))
    starts = small(zstd(starts, "ranges"))
    dictionary = rows.where("shard IS NULL").select("range", "words", "sizes", "times").join(starts, "range").select(
        F.col("first").alias("start"), "words", "sizes", "times")
    numbers = rows.where("shard IS NOT NULL").select("range", "shard", "start", "ids").join(starts, "range").groupBy(
        "shard").agg(F.collect_list(F.struct("start", "first", "ids")).alias("map"))
    return dictionary, numbers


def global_numbers(entry: list[dict] | None) -> np.ndarray:
    """The global number of every local one from a row's ``map``; -1 for words not kept."""
    parts = sorted(entry or [], key=lambda e: e["start"])
    out = [unzipped(e["ids"], "<i4").astype(np.int64) for e in parts]
    return np.concatenate([np.where(x < 0, -1, x + e["first"]) for x, e in zip(out, parts)]) if out else np.zeros(0, np.int64)


@tidy
def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, words, sizes, times in zip(*[batch.column(c).to_pylist() for c in ("start", "words", "sizes", "times")]):
            size = unzipped(sizes, "<i4")
            yield pa.RecordBatch.from_arrays([
                pa.array(start + np.arange(len(size))), _strings(unzipped(words, "u1"), size).cast(pa.string()),
                pa.array(unzipped(times, "<i8"))], ["id", "word", "times"])


def word_rows(dictionary: DataFrame) -> DataFrame:
    """(id, word, times) of every word of a dictionary."""
    return dictionary.mapInArrow(_unpack, "id bigint, word string, times bigint")
