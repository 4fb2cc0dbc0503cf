"""Suffix-array dedup: bytes covered by a string of SPAN bytes that also starts anywhere else.

The order of suffixes and their common prefixes are built column by column for many texts at
once: a round inserts one symbol of each text in front of what it has, which is a stable sort
of the round before by the new symbols (the column's Burrows-Wheeler transform), and common
prefixes follow from the least ones between the two places that become neighbours.  Two equal
strings of SPAN bytes choose the same anchor, the least hash of GRAM bytes inside them, at the
same distance; so the collection is dealt by anchors, texts are aligned at them, and a round
needs one column of the suffixes of one anchor only, not all suffixes so far.

1. Shards.  Texts (UTF-8 bytes; null: empty) are packed, about SHARD bytes a row.
2. Anchors.  Neighbouring starts with one anchor make a segment: from the first start to the
   end of the last string.  Equal segments, known by a 128-bit digest, are one from here on, and a
   shard names each once; so copies, however many, cost one row a shard.
3. Members.  Segments are counted per anchor.  An anchor that occurs once repeats nothing.  A segment
   that occurs twice is repeated whole.  Only anchors with several different segments need bytes:
   one copy of each is fetched from a shard.
4. Columns.  Buckets of about BUCKET segments, whole anchors, run the rounds from the last column to
   the first.  A start is repeated if its suffix has SPAN symbols in common with a neighbour.  An
   anchor with more than CROWD different segments would make a task grow with the corpus: its strings
   are counted by (anchor, column, 128-bit digest) in a plain aggregate instead.
5. Removal.  Repeated starts go back to their shards, whose texts lose the bytes they cover.

Cases: null, empty and short texts keep all; copies of a text of SPAN bytes or more lose all;
a text may repeat itself, overlaps included; strings never reach into another text; null and
repeated doc_ids are rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import table

from .common import _BYTE, _power, limit_batches, mix, need, slices, text_buffer, tidy
from .encode import shard_numbers, unzipped, zipped, zstd

SPAN = 400
SHARD = 1 << 20
BUCKET = 10_000        # segments of a task's columns
CROWD = 2_000          # different segments of one anchor that columns take
CHUNK = 1 << 21        # starts whose anchors are found at once
_PLACE = np.uint64((1 << 22) - 1)   # lower bits of a key hold a place in the chunk

SHARDS = "shard bigint, doc_id array<bigint>, bounds binary, data binary"
ANCHORS = "anchor bigint, digest binary, shard bigint, lead int, size int, places array<bigint>"
SEGMENTS = "anchor bigint, digest binary, members bigint, lead int, bytes binary"
STARTS = "anchor bigint, digest binary, first array<int>, last array<int>"
WINDOWS = "anchor bigint, digest binary, start int, column int, print binary"
KEPT = "doc_id bigint, n_bytes bigint, spans array<struct<start bigint, end bigint>>, kept binary"


def gram_of(span: int) -> int:
    return max(span // 6, 1)


@tidy
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = shard_numbers()
    for batch in batches:
        ids = batch.column("doc_id")
        data, bounds = text_buffer(batch.column("text"))
        for a, b in slices(bounds, SHARD):
            yield pa.RecordBatch.from_arrays([
                pa.array([next(number)]), pa.array([ids[a:b].to_pylist()], pa.list_(pa.int64())),
                pa.array([(bounds[a:b + 1] - bounds[a]).astype("<i8").tobytes()]),
                pa.array([zipped(data[bounds[a]:bounds[b]])], pa.binary())], ["shard", "doc_id", "bounds", "data"])


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place."""
    n = len(data) - gram + 1
    p, q = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[:len(data)], out=total[1:])
    return mix((total[gram:] - total[:n]) * q[:n])


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each place the place of the least hash among the next ``width``, the first of equal ones."""
    n = len(h)
    size = -(-n // width) * width
    key = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    key[:n] = (h & ~_PLACE) | np.arange(n, dtype=np.uint64)
    rows = key.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[:n - width + 1], ahead[width - 1:n]) & _PLACE).astype(np.int64)


def segments(data: np.ndarray, bounds: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, place, first start, last start) of the segments of texts one after the other,
    in chunks of starts."""
    gram = gram_of(span)
    end = np.repeat(bounds[1:], np.diff(bounds))
    for c in range(0, len(data) - span + 1, CHUNK):
        part = data[c:c + CHUNK + span - 1]
        h = gram_hashes(part, gram)
        place = least_places(h, span - gram + 1)
        start = np.arange(len(place))
        sound = start + c + span <= end[c:c + len(place)]
        change = np.ones(len(place), bool)
        change[1:] = (place[1:] != place[:-1]) | ~sound[:-1]
        first = np.flatnonzero(sound & change)
        stop = np.ones(len(place), bool)
        stop[:-1] = change[1:] | ~sound[1:]
        last = np.flatnonzero(sound & stop)
        yield h[place[first]].view(np.int64), place[first] + c, first + c, last + c


def _anchors(span: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, bounds, data in zip(*[batch.column(c).to_pylist() for c in ("shard", "bounds", "data")]):
                data, found = unzipped(data, "u1"), {}
                view = memoryview(data)
                for anchor, place, first, last in segments(data, np.frombuffer(bounds, "<i8"), span):
                    for a, p, i, j in zip(anchor.tolist(), place.tolist(), first.tolist(), last.tolist()):
                        digest = hashlib.blake2b(view[i:j + span], digest_size=16).digest()
                        if (seen := found.get(digest)) is None:
                            found[digest] = (a, p - i, j + span - i, [i])
                        else:
                            seen[3].append(i)
                if found:
                    a, lead, size, places = zip(*found.values())
                    yield pa.RecordBatch.from_arrays([
                        pa.array(a), pa.array(list(found), pa.binary()), pa.array([shard] * len(a)), pa.array(lead, pa.int32()),
                        pa.array(size, pa.int32()), pa.array(places, pa.list_(pa.int64()))],
                        ["anchor", "digest", "shard", "lead", "size", "places"])
    return run


@tidy
def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, wanted in zip(batch.column("data").to_pylist(), batch.column("wanted").to_pylist()):
            data = unzipped(data, "u1")
            yield pa.RecordBatch.from_arrays([
                pa.array([w["anchor"] for w in wanted]), pa.array([w["digest"] for w in wanted], pa.binary()),
                pa.array([w["members"] for w in wanted]), pa.array([w["lead"] for w in wanted], pa.int32()),
                pa.array([data[w["place"]:w["place"] + w["size"]].tobytes() for w in wanted], pa.binary())],
                ["anchor", "digest", "members", "lead", "bytes"])


def least_between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of values[a + 1 .. b] for each pair of places a < b."""
    length = b - a
    out = values[b].copy()
    wide = np.flatnonzero(length > 1)
    if len(wide):
        level = np.frexp(length[wide].astype(float))[1] - 1
        rows = [values]
        for j in range(int(level.max())):
            row = rows[-1].copy()
            row[:len(row) - (1 << j)] = np.minimum(row[:len(row) - (1 << j)], row[1 << j:])
            rows.append(row)
        rows = np.stack(rows)
        out[wide] = np.minimum(rows[level, a[wide] + 1], rows[level, b[wide] - (1 << level) + 1])
    return out


def repeated_starts(data: np.ndarray, bounds: np.ndarray, lead: np.ndarray, group: np.ndarray, span: int) -> np.ndarray:
    """For segments data[bounds[i]:bounds[i + 1]] whose anchors stand at ``lead``: which starts (a row of
    booleans each) have a string of ``span`` bytes that another segment of its group has at the same
    distance from the anchor.  Rounds go over the columns from the last to the first."""
    n, size = len(lead), np.diff(bounds)
    out = np.zeros((n, int((size - span).max()) + 1), bool)
    order = np.argsort(group, kind="stable")
    common = np.zeros(n + 1, np.int32)      # common prefix of the suffixes order[j - 1] and order[j]
    for column in range(int((size - lead).max()) - 1, -int(lead.max()) - 1, -1):
        at = lead + column
        inside = (at >= 0) & (at < size)
        symbol = np.where(inside, data[bounds[:-1] + np.clip(at, 0, size - 1)].astype(np.int64) + 1, 0)
        key = (group * 257 + symbol)[order]
        moved = np.argsort(key, kind="stable")
        key = key[moved]
        same = (key[1:] == key[:-1]) & (key[1:] % 257 > 0)
        grown = np.zeros(n + 1, np.int32)
        j = np.flatnonzero(same) + 1
        grown[j] = np.minimum(1 + least_between(common, moved[j - 1], moved[j]), span)
        order, common = order[moved], grown
        if column <= 0:
            hit = order[(common[:-1] >= span) | (common[1:] >= span)]
            out[hit, at[hit]] = True
    return out


def runs(marks: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.diff(np.concatenate([[0], marks.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()


def _columns(span: int):
    @tidy
    def run(group: pa.Table) -> pa.Table:
        texts = group["bytes"].to_pylist()
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        anchor = np.unique(group["anchor"].to_numpy(), return_inverse=True)[1]
        marks = repeated_starts(np.frombuffer(b"".join(texts), np.uint8), bounds, group["lead"].to_numpy().astype(np.int64), anchor, span)
        hit = np.flatnonzero(marks.any(axis=1))
        found = [runs(marks[i]) for i in hit]
        hit = pa.array(hit)
        return pa.table([group["anchor"].take(hit), group["digest"].take(hit), pa.array([f for f, _ in found], pa.list_(pa.int32())),
                         pa.array([t for _, t in found], pa.list_(pa.int32()))], ["anchor", "digest", "first", "last"])
    return run


def _windows(span: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, lead = batch.column("bytes")[i].as_py(), batch.column("lead")[i].as_py()
                starts = np.arange(len(text) - span + 1)
                prints = [hashlib.blake2b(text[s:s + span], digest_size=16).digest() for s in starts.tolist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column("anchor")[i].as_py()] * len(starts)), pa.array([batch.column("digest")[i].as_py()] * len(starts), pa.binary()),
                    pa.array(starts, pa.int32()), pa.array(starts - lead, pa.int32()), pa.array(prints, pa.binary())],
                    ["anchor", "digest", "start", "column", "print"])
    return run


def _remove(span: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for ids, bounds, data, starts in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "bounds", "data", "starts")]):
                data, bounds = unzipped(data, "u1"), np.frombuffer(bounds, "<i8")
                edge = np.zeros(len(data) + 1, np.int64)
                for s in starts or []:
                    place = np.array(s["places"], np.int64)[:, None]
                    np.add.at(edge, (place + np.array(s["first"], np.int64)).ravel(), 1)
                    np.add.at(edge, (place + np.array(s["last"], np.int64) + span).ravel(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans, kept = [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    first, last = runs(gone[a:b])
                    spans.append([{"start": i, "end": j + 1} for i, j in zip(first, last)])
                    kept.append(data[a:b][~gone[a:b]].tobytes())
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(np.diff(bounds)), pa.array(spans, kinds), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "spans", "kept"])
    return run


def remove_repeats(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row of ``documents(doc_id, text)``: the removed byte
    ranges [start, end) and the remaining bytes, which may cut a code point."""
    limit_batches(documents.sparkSession)
    shards = zstd(need(documents, doc_id="bigint", text="string").mapInArrow(_pack, SHARDS), "repeat-shards")
    anchors = zstd(shards.mapInArrow(_anchors(span), ANCHORS), "repeat-anchors")
    kinds = zstd(anchors.groupBy("anchor", "digest").agg(
        F.sum(F.size("places")).alias("n"), F.min(F.struct("shard", F.element_at("places", 1).alias("place"), "lead", "size")).alias("one")), "repeat-segments")
    shared = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("all")).where("all > 1").drop("all")
    members = zstd(kinds.join(shared, "anchor").select("anchor", "digest", "n", "members", "one.*"), "repeat-members")
    wanted = members.where("members > 1").groupBy("shard").agg(
        F.collect_list(F.struct("anchor", "digest", "members", "lead", "place", "size")).alias("wanted"))
    fetched = zstd(shards.select("shard", "data").join(wanted, "shard").mapInArrow(_fetch, SEGMENTS), "repeat-bytes")
    buckets = int((fetched.count()) // BUCKET) + 1
    usual = fetched.where(F.col("members") <= CROWD).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    by_column = usual.groupBy("bucket").applyInArrow(_columns(span), STARTS)
    windows = zstd(fetched.where(F.col("members") > CROWD).mapInArrow(_windows(span), WINDOWS), "repeat-windows")
    again = windows.groupBy("anchor", "column", "print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    by_print = windows.join(again, ["anchor", "column", "print"]).groupBy("anchor", "digest").agg(
        F.collect_list("start").alias("first")).select("anchor", "digest", "first", F.col("first").alias("last"))
    single = members.where("n = 1").select("anchor", "digest")
    several = members.where("n > 1").select("anchor", "digest", F.array(F.lit(0)).alias("first"), F.array(F.col("size") - span).alias("last"))
    starts = zstd(several.unionByName(by_column.unionByName(by_print).join(single, ["anchor", "digest"], "left_semi")), "repeat-starts")
    back = anchors.select("anchor", "digest", "shard", "places").join(starts, ["anchor", "digest"]).groupBy("shard").agg(
        F.collect_list(F.struct("places", "first", "last")).alias("starts"))
    return shards.join(back, "shard", "left").mapInArrow(_remove(span), KEPT)


def op13_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
