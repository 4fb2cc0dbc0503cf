"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds the hashes of its distinct k-word shingles (A-Z lowered; all words as
one shingle if it has fewer).  Two sets link when 100 * intersection >= percent * union.
Equal sets are one class, known by a 64-bit key; all that follows is between classes.

1. Keys.  One scan writes (doc_id, text hash, key, set size) of every row, and from each batch
   the shingles in more than 1/1024 of its classes.  Their sums give the hot shingles, those of
   at least 1/1024 of all rows: at most 1024 times the mean set size, which bounds their
   broadcast.  They come last in the order, and no list of another shingle is longer than 1/512
   of the rows.
2. Frequencies.  A second scan sends, per batch and range of shingle fingerprints (40 bits),
   one compact row: sorted fingerprints, the classes that have them, and their sizes.  A task
   per range counts the classes of each fingerprint and sends those of two or more classes on
   to the classes' own tasks.  The order of shingles is: frequency class, then fingerprint.
3. Prefixes.  A class's shingles that nobody shares come first and only take up places.  Of
   its n shingles, the first n - ceil(percent n / 100) + 1 are the prefix; its shared ones
   become postings (fingerprint, class, size, place).  Classes whose prefix is all their own
   make none.  Hot shingles' postings come from a scan of their own, which is made only if
   there are any.
4. Pairs.  First each posting list is joined with one of its classes only, so a group of copies
   makes as many pairs as it has members.  Verified links are contracted to components; lists
   that lie in one component can add nothing and are dropped.  After STARS such rounds, in the
   other lists all pairs across components are taken, by a join on the fingerprint in which a long list is spread over many
   keys.  Length, positional and suffix filters hold inside the join.  The suffix filter bounds
   the sets' symmetric difference from below: shingles fall into 64 * SIGN parts by hash, and
   every part whose counts differ in parity holds at least one.
5. Verification.  Each candidate pair is checked once, on the full 64-bit sets.
6. Links.  The rounds above settle the components, not every link inside them.  ``counted`` joins
   the classes of each component by blocks (``links.py``): all links are verified, and each row
   gets their number, copies included.

Fingerprints only choose candidates: shingles that collide are ordered together, so no pair is
lost, and no false one passes verification.

Cases: null and empty texts, and texts of blanks, have the empty set, link with nothing and are
their own component; rows equal in all are one class; rows of one doc_id with different texts
are different documents with that doc_id; null doc_ids count only where a component has no
other; an empty table gives no rows; other columns are ignored, and kept by ``distinct_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import table

from .common import limit_batches, mix, need, sets_of, small, tidy, written
from .components import components
from .links import link_counts, placed, prefix_length

HOT_SHARE = 1024       # a shingle is hot from 1 / HOT_SHARE of the rows on
RANGE_ENTRIES = 2 << 20
BLOB_BYTES = 8 << 20  # text bytes behind one round of compact rows
YIELD_BYTES = 1 << 20  # of compact rows handed on at once
STEP = 1 << 16         # numbers whose temporaries are made at once
SIGN = 4               # 64-bit words of a set's signature in the suffix filter
SIGNS = [f"s{j}" for j in range(SIGN)]
STARS = 2              # rounds of pairs with one class of each list
LIST_BLOCK = 1024      # postings of a list that a join key holds in the last join
FP = np.uint64(24)     # a fingerprint is the upper 40 bits of a hash
CLS = np.uint64((1 << 24) - 1)         # the other bits hold a class of a portion; a portion has fewer


# ------------------------------------------------------------------------ compact rows

def planes(x: np.ndarray) -> bytes:
    """The bytes of the numbers, first all lowest ones and so on; upper zeros compress away."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplaned(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(dtype).ravel()


def set_keys(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A 64-bit key of each sorted set; 0 only for empty ones."""
    total = np.zeros(len(h) + 1, np.uint64)
    for a in range(0, len(h), STEP):
        total[a + 1:a + STEP + 1] = mix(h[a:a + STEP] + np.uint64(0x5851F42D4C957F2D))
    np.cumsum(total, out=total)
    n = np.diff(edge).astype(np.uint64)
    key = mix((total[edge[1:]] - total[edge[:-1]]) ^ mix(n)) | np.uint64(1)
    return np.where(n > 0, key, np.uint64(0))


def signatures(h: np.ndarray, edge: np.ndarray) -> list[np.ndarray]:
    """SIGN words of bits for each set: bit i is the parity of its shingles in part i."""
    full = np.flatnonzero(np.diff(edge))
    out = [np.zeros(len(edge) - 1, np.uint64) for _ in range(SIGN)]
    if len(full):
        part = mix(h ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)
        bit = np.uint64(1) << (part & np.uint64(63))
        word = (part >> np.uint64(6)) % np.uint64(SIGN)
        for j in range(SIGN):
            out[j][full] = np.bitwise_xor.reduceat(np.where(word == j, bit, np.uint64(0)), edge[full])
    return [x.view(np.int64) for x in out]


class Gathered:
    """Sets of several slices, handed on in portions of about BLOB_BYTES text bytes."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, h: np.ndarray, edge: np.ndarray) -> bool:
        """Takes a slice; true if a portion is full."""
        self.held.append((h, edge))
        self.size += len(h)
        return self.size * 6 > BLOB_BYTES

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        shift = np.cumsum([0, *(len(x[0]) for x in self.held)])
        h = np.concatenate([x[0] for x in self.held])
        edge = np.concatenate([[0], *(x[1][1:] + s for x, s in zip(self.held, shift, strict=False))])
        self.held, self.size = [], 0
        return h, edge


def portions(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of all rows, in portions."""
    held = Gathered()
    for batch in batches:
        for _, _, h, edge in sets_of(batch.column("text"), k):
            if held.add(h, edge):
                yield held.take()
    if held.held:
        yield held.take()


def classes_of(h: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the non-empty different sets in a slice: their rows, keys, and (hash, class) of their shingles, in arrays of their own."""
    key = set_keys(h, edge)
    _, rows = np.unique(key, return_index=True)
    rows = np.sort(rows[key[rows] != 0])
    n = np.diff(edge)
    first = np.zeros(len(n), bool)
    first[rows] = True
    return rows, key[rows], h[np.repeat(first, n)], np.repeat(np.arange(len(rows), dtype=np.uint32), n[rows])


def _blobs(names: list[str], row: Iterator[tuple], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of a number and binaries, in batches of about ``most`` bytes."""
    types, held, size = [pa.int32(), *[pa.binary()] * (len(names) - 1)], [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names)
    for x in row:
        held.append(x)
        size += sum(map(len, x[1:]))
        if size >= most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


# ------------------------------------------------------------------------------- scans

def _scan_keys(k: int):
    """kind 0: (doc_id, text hash, key, size) of a row; kind 1: (fingerprint, classes) common in a batch."""
    names = ["kind", "a", "b", "c", "d", *SIGNS]

    def common(h: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        _, found, every, _ = classes_of(h, edge)
        every >>= FP
        every.sort()
        many = max(2, 4 + len(found) // HOT_SHARE)
        fp = np.unique(every[:max(len(every) - many + 1, 0)][every[:max(len(every) - many + 1, 0)] == every[many - 1:]])
        n = np.searchsorted(every, fp, "right") - np.searchsorted(every, fp)
        fp = fp.astype(np.int64)
        none = pa.nulls(len(fp), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(fp), np.int32)), pa.array(fp), pa.array(n), *[none] * (2 + SIGN)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered()
        for batch in batches:
            doc, th = batch.column("doc_id"), batch.column("th")
            for a, b, h, edge in sets_of(batch.column("text"), k):
                rows = b - a
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(rows, np.int32)), doc.slice(a, rows), th.slice(a, rows), pa.array(set_keys(h, edge).view(np.int64)),
                     pa.array(np.diff(edge)), *map(pa.array, signatures(h, edge))], names)
                if held.add(h, edge):
                    yield common(*held.take())
        if held.held:
            yield common(*held.take())

    return run


def _scan_entries(k: int, ranges: int, hot):
    """Compact rows (r, keys, sizes, hot, cls, fps): entries of one range of fingerprints."""
    def compact(h: np.ndarray, edge: np.ndarray, hot_fp: np.ndarray, lows: np.ndarray) -> Iterator[tuple]:
        rows, keys, entries, cls = classes_of(h, edge)
        n = np.diff(edge)[rows].astype(np.uint32)
        assert len(rows) <= int(CLS)
        warm = _among(hot_fp, entries, FP)
        n_hot = np.bincount(cls[warm], minlength=len(rows)).astype(np.uint32)
        entries &= ~CLS
        entries |= cls
        del cls
        if warm.any():
            entries = entries[~warm]
        entries.sort()                      # by fingerprint, then class
        cut = np.append(np.searchsorted(entries, lows[:-1] << FP), len(entries))
        for r in np.flatnonzero(np.diff(cut)):
            f = entries[cut[r]:cut[r + 1]]
            used, at = np.unique(f & CLS, return_inverse=True)
            step = np.diff(f >> FP, prepend=lows[r]).astype(np.uint32 if ranges > 256 else np.uint64)
            used = used.astype(np.int64)
            yield int(r), planes(keys[used]), planes(n[used]), planes(n_hot[used]), planes(at.astype(np.uint32)), planes(step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = np.array([(r << 40) // ranges for r in range(ranges + 1)], np.uint64)
        for portion in portions(batches, k):
            yield from _blobs(["r", "keys", "sizes", "hot", "cls", "fps"], compact(*portion, hot.value, lows), YIELD_BYTES)

    return run


def _among(known: np.ndarray, x: np.ndarray, shift: np.uint64) -> np.ndarray:
    """Which of x, shifted to the right, are known."""
    out = np.zeros(len(x), bool)
    for a in range(0, len(x) if len(known) else 0, STEP):
        f = x[a:a + STEP] >> shift
        out[a:a + STEP] = known[np.minimum(np.searchsorted(known, f), len(known) - 1)] == f
    return out


def _parts(group: pa.Table) -> Iterator[dict]:
    """The rows of a group, their binaries as buffers of its own."""
    for batch in group.to_batches():
        for i in range(batch.num_rows):
            yield {c: x.as_buffer() if pa.types.is_binary(x.type) else x.as_py() for c in batch.schema.names for x in [batch.column(c)[i]]}


def _shared(ranges: int, buckets: int):
    """Of one range: entries whose fingerprint two or more classes have, dealt to class buckets."""
    def run(group: pa.Table) -> pa.Table:
        # An entry is one number: its fingerprint's place in the range, its class and whether it is a
        # shingle that collides with another of its class, which is an entry of its own.
        low = (group.column("r")[0].as_py() << 40) // ranges
        keys, first, at = np.unique(_joint(group, "keys", np.uint64), return_index=True, return_inverse=True)
        n, n_hot = _joint(group, "sizes", np.uint32)[first], _joint(group, "hot", np.uint32)[first]
        shift = max(1, len(keys).bit_length())
        assert shift < 28
        shift, bit = np.uint64(shift), np.uint64(1)
        at, done = at.astype(np.uint64), 0
        entries, end = np.empty(sum(row["cls"].size for row in _parts(group)) // 4, np.uint64), 0
        for row in _parts(group):
            c = at[done:done + row["keys"].size // 8][unplaned(row["cls"], np.uint32)]
            f = np.cumsum(unplaned(row["fps"], np.uint32 if ranges > 256 else np.uint64), dtype=np.uint64)
            f = (f << shift | c) << bit
            f[1:] |= f[1:] == f[:-1]
            entries[end:end + len(f)] = f
            done, end = done + row["keys"].size // 8, end + len(f)
        del at
        entries.sort()
        # The same class from two batches is one.
        entries = entries[np.append(True, entries[1:] != entries[:-1])]
        near = (entries[1:] ^ entries[:-1]) < bit << (shift + bit)      # neighbours of one fingerprint
        entries = entries[np.append(False, near) | np.append(near, False)]
        start = np.flatnonzero(np.append(True, (entries[1:] ^ entries[:-1]) >= bit << (shift + bit))[:len(entries)])
        df = np.add.reduceat((entries & bit == 0).astype(np.int64), start)
        many = np.diff(np.append(start, len(entries)))
        keep = np.repeat(df > 1, many)
        rank = np.repeat(np.minimum(255, 8 * np.log2(df)).astype(np.uint8), many)[keep]
        entries = entries[keep] >> bit
        del keep, many, start, near
        # By bucket and key; fingerprints stay in order.
        bucket = keys % np.uint64(buckets)
        by = np.lexsort((keys, bucket))
        place = np.empty(len(by), np.uint32)
        place[by] = np.arange(len(by), dtype=np.uint32)
        own = place[(entries & ((bit << shift) - bit)).astype(np.int64)]
        order = np.argsort(own, kind="stable")
        times = np.bincount(own, minlength=len(by)).astype(np.uint32)
        del own
        cut, ends = np.searchsorted(bucket[by], np.arange(buckets + 1, dtype=np.uint64)), np.append(0, np.cumsum(times, dtype=np.int64))

        def dealt() -> Iterator[tuple]:
            for b in np.flatnonzero(np.diff(ends[cut])):
                some = np.arange(cut[b], cut[b + 1])[times[cut[b]:cut[b + 1]] > 0]
                i, c = order[ends[cut[b]]:ends[cut[b + 1]]], by[some]
                fp = (entries[i] >> shift) + np.uint64(low)
                yield int(b), planes(keys[c]), planes(n[c]), planes(n_hot[c]), planes(times[some]), planes(fp)[:5 * len(i)], rank[i].tobytes()

        names = ["b", "keys", "sizes", "hot", "times", "fps", "ranks"]
        return pa.Table.from_batches(_blobs(names, dealt(), YIELD_BYTES), pa.schema(list(zip(names, [pa.int32(), *[pa.binary()] * 6], strict=True))))

    return run


def _joint(group: pa.Table, name: str, dtype) -> np.ndarray:
    return np.concatenate([unplaned(row[name], dtype) for row in _parts(group.select([name]))])


POSTING = "fp bigint, key bigint, n int, place int"
COLUMNS = ["fp", "key", "n", "place", *SIGNS]


def _prefixes(percent: int):
    """Of one bucket of classes: their postings."""
    def run(group: pa.Table) -> pa.Table:
        keys, first, at = np.unique(_joint(group, "keys", np.uint64), return_index=True, return_inverse=True)
        sizes, hots = (_joint(group, c, np.uint32)[first].astype(np.int64) for c in ("sizes", "hot"))
        cls = np.repeat(at.astype(np.uint32), _joint(group, "times", np.uint32))
        entries, end = np.empty(len(cls), np.uint64), 0     # frequency class, then fingerprint
        for row in _parts(group):
            f = unplaned(row["fps"].to_pybytes() + bytes(3 * row["ranks"].size), np.uint64)
            entries[end:end + len(f)] = np.frombuffer(row["ranks"], np.uint8).astype(np.uint64) << np.uint64(40) | f
            end += len(f)
        order = np.lexsort((entries, cls))
        entries, cls = entries[order], cls[order]
        del order
        many = np.bincount(cls, minlength=len(keys))
        # Places before: shingles that no other class has.
        place = np.arange(len(cls)) + np.repeat(sizes - hots - many - (np.cumsum(many) - many), many)
        keep = np.flatnonzero(place < np.repeat(prefix_length(sizes, percent), many))
        fp, cls, place = entries[keep] & np.uint64((1 << 40) - 1), cls[keep], place[keep]
        return pa.Table.from_arrays(
            [pa.array(fp.astype(np.int64)), pa.array(keys[cls].view(np.int64)), pa.array(sizes[cls].astype(np.int32)),
             pa.array(place.astype(np.int32))], ["fp", "key", "n", "place"])

    return run


def _hot_postings(k: int, percent: int, hot):
    """Postings of hot shingles, of classes whose prefix reaches them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, edge in portions(batches, k):
            rows, keys, entries, cls = classes_of(h, edge)
            n = np.diff(edge)[rows]
            warm = np.flatnonzero(_among(hot.value, entries, FP))
            cold = n - np.bincount(cls[warm], minlength=len(rows))
            c = cls[warm]                       # sets are sorted, so fingerprints are too
            start = np.searchsorted(c, c)
            place = cold[c] + np.arange(len(c)) - start
            keep = place < prefix_length(n, percent)[c]
            c, f, place = c[keep], entries[warm][keep] >> FP, place[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(f.astype(np.int64)), pa.array(keys[c].view(np.int64)), pa.array(n[c].astype(np.int32)),
                 pa.array(place.astype(np.int32))], ["fp", "key", "n", "place"])

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, edge in sets_of(batch.column("text"), k):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(set_keys(h, edge).view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(h.view(np.int64)))], ["key", "shingles"])

    return run


# -------------------------------------------------------------------------------- join

def _passes(percent: int):
    """Length, positional and suffix filter of two postings of a list, x and y."""
    nx, ny, px, py = F.col("x.n"), F.col("y.n"), F.col("x.place"), F.col("y.place")
    least = F.ceil(percent * (nx + ny) / F.lit(100 + percent))
    apart = sum((F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))) for s in SIGNS), F.lit(0))
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (F.least(nx - px, ny - py) >= least) & (apart <= nx + ny - 2 * least)


def _pairs(joined: DataFrame, percent: int) -> DataFrame:
    """Distinct candidate pairs (a, b) of a join of postings x and y."""
    return joined.where(_passes(percent)).select(
        F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).dropDuplicates()


def _verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their full sets."""
    needed = written(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).dropDuplicates(), "needed")
    one = written(rows.join(small(needed), "key", "left_semi").groupBy("key").agg(F.min(F.struct("doc_id", "th")).alias("r"))
                  .select(F.col("r.doc_id").alias("_d"), F.col("r.th").alias("_t")), "one")
    sets = (docs.join(small(one), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left_semi")
            .select("text").mapInArrow(tidy(_full_sets(k)), "key bigint, shingles array<bigint>").dropDuplicates(["key"]))
    x, y = sets.withColumnRenamed("key", "a"), sets.select(F.col("key").alias("b"), F.col("shingles").alias("others"))
    size = F.size(F.array_intersect("shingles", "others"))
    return (pairs.join(x, "a").join(y, "b")
            .select("a", "b", size.alias("i"), (F.size("shingles") + F.size("others")).alias("s"))
            .where((100 + percent) * F.col("i") >= percent * F.col("s")).select("a", "b"))


def _postings(docs: DataFrame, k: int, percent: int, n_rows: int, entries: int, common: DataFrame, rows: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select("text")
    hot_rows = common.groupBy("fp").agg(F.sum("n").alias("n")).where(F.col("n") >= F.lit(max(32, n_rows // HOT_SHARE)))
    hot = np.sort(hot_rows.select("fp").toArrow().column("fp").to_numpy().astype(np.uint64))
    shared_hot = spark.sparkContext.broadcast(hot)
    ranges = max(32, -(-entries // RANGE_ENTRIES))
    compact = "keys binary, sizes binary, hot binary, "
    found = (texts.mapInArrow(tidy(_scan_entries(k, ranges, shared_hot)), f"r int, {compact}cls binary, fps binary")
             .groupBy("r").applyInArrow(tidy(_shared(ranges, ranges)), f"b int, {compact}times binary, fps binary, ranks binary")
             .groupBy("b").applyInArrow(tidy(_prefixes(percent)), POSTING))
    if len(hot):
        of_hot = texts.mapInArrow(tidy(_hot_postings(k, percent, shared_hot)), POSTING)
        found = found.unionByName(of_hot.groupBy("fp", "key").agg(*[F.first(c).alias(c) for c in ("n", "place")]))
    signs = rows.groupBy("key").agg(*[F.first(c).alias(c) for c in SIGNS])
    return written(found.join(signs, "key").select(*COLUMNS), "postings")


def _joined(documents: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, key, n, component) of each row, and the postings."""
    limit_batches(documents.sparkSession)
    docs = need(documents, doc_id="bigint", text="string").withColumn("th", F.xxhash64("text"))
    scan = written(docs.mapInArrow(tidy(_scan_keys(k)), "kind int, a bigint, b bigint, c bigint, d bigint" + "".join(f", {c} bigint" for c in SIGNS)), "keys")
    rows = scan.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("th"), F.col("c").alias("key"), F.col("d").alias("n"), *SIGNS)
    n_rows, entries = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    common = scan.where("kind = 1").select(F.col("a").alias("fp"), F.col("b").alias("n"))
    postings = _postings(docs, k, percent, n_rows, entries, common, rows)

    # Every list with one of its classes, its pivot: the one with the fewest rarer shingles, so
    # the least changed of a group of copies.  Then mixed lists again, with a pivot of another
    # component than the first one's.
    side = F.struct(*COLUMNS, "component")
    best = F.min_by(side, F.struct("place", "key"))
    known, seen, links, of = postings.withColumn("component", F.col("key")), None, None, None
    for _ in range(STARS):
        lists = known.groupBy("fp").agg(best.alias("y"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").drop("lo", "hi")
        if seen is not None:
            others = known.join(lists.select("fp", F.col("y.component").alias("first")), "fp").where("component <> first")
            lists = others.groupBy("fp").agg(best.alias("y"))
        star = known.select("fp", side.alias("x")).join(lists, "fp").where("x.component <> y.component")
        pairs = _pairs(star, percent)
        pairs = written(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
        seen = pairs if seen is None else seen.unionByName(pairs)
        found = written(_verified(pairs, docs, rows, k, percent), "links")
        links = found if links is None else links.unionByName(found)
        of = components(links).select(F.col("node").alias("key"), "component")
        known = postings.join(of, "key", "left").withColumn("component", F.coalesce("component", "key"))

    # Lists that still lie in several components, in all pairs across them.
    mixed = known.groupBy("fp").agg(F.count(F.lit(1)).alias("long"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    left = known.join(mixed.select("fp", F.ceil(F.col("long") / LIST_BLOCK).cast("int").alias("spread")), "fp")
    x = left.select("fp", F.pmod(F.xxhash64("key"), F.col("spread")).cast("int").alias("s"), side.alias("x"))
    y = left.select("fp", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("s"), side.alias("y"))
    across = x.join(y, ["fp", "s"]).where(F.col("x.component") < F.col("y.component"))
    more = written(_pairs(across, percent).join(seen, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        extra = written(_verified(more, docs, rows, k, percent), "links")
        of = components(links.unionByName(extra)).select(F.col("node").alias("key"), "component")
    return rows.join(of, "key", "left").select(
        "doc_id", "th", "key", "n", F.when(F.col("n") > 0, F.coalesce("component", "key")).alias("component")), postings


def linked(documents: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, th, n, component) of each row of ``documents(doc_id, text)``: th is the hash of
    the text, n the size of its set, and equal components are linked; null for empty sets."""
    return _joined(documents, k, percent)[0].select("doc_id", "th", "n", "component")


def _placed_sets(k: int):
    """(block, key, copies, shingles) of rows (block, copies, text); once a slice where rows repeat."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, copies = batch.column("block"), batch.column("copies")
            for a, _, h, edge in sets_of(batch.column("text"), k):
                rows, keys, hashes, _ = classes_of(h, edge)
                at, bound = pa.array(rows + a), np.append(0, np.cumsum(np.diff(edge)[rows]))
                yield pa.RecordBatch.from_arrays(
                    [block.take(at), pa.array(keys.view(np.int64)), copies.take(at),
                     pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(hashes.view(np.int64)))], ["block", "key", "copies", "shingles"])

    return run


def counted(documents: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, th, n, component, n_links) of each row: ``linked`` and the number of other rows
    that the row links with, copies included; 0 for empty sets."""
    rows, postings = _joined(documents, k, percent)
    rows = written(rows, "joined")
    classes = written(rows.where("n > 0").groupBy("key").agg(
        F.first("n").alias("n"), F.first("component").alias("component"), F.count(F.lit(1)).alias("copies"),
        F.min(F.struct("doc_id", "th")).alias("r")).select("key", "n", "component", "copies", F.col("r.doc_id").alias("_d"), F.col("r.th").alias("_t")), "classes")
    members = written(placed(classes, percent), "members")
    docs = need(documents, doc_id="bigint", text="string").withColumn("th", F.xxhash64("text"))
    sets = (docs.join(small(members.select("_d", "_t", "block", "copies")), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")))
            .select("block", "copies", "text").mapInArrow(tidy(_placed_sets(k)), "block bigint, key bigint, copies bigint, shingles array<bigint>"))
    links = written(link_counts(members, sets, postings, percent), "counts")
    # Classes without links or copies of their own need no row; what is left meets by key.
    some = written(classes.where("copies > 1").select("key", (F.col("copies") - 1).alias("links")).unionByName(links)
                   .groupBy("key").agg(F.sum("links").alias("n_links")), "some")
    return rows.join(small(some), "key", "left").select("doc_id", "th", "n", "component", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def distinct_rows(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` without near duplicates: of each group of linked ones the row of
    the smallest doc_id (then text hash) stays, once; rows of empty sets all stay."""
    rows = written(linked(documents, k, percent).where("n > 0"), "linked")
    kept = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("r"), F.count(F.lit(1)).alias("many"))
    kept = written(kept.where("many > 1").select("component", F.col("r.doc_id").alias("keep_id"), F.col("r.th").alias("keep_th")), "kept")
    grouped = rows.join(kept, "component").select("doc_id", "th", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("th") == F.col("keep_th"))).alias("stays"))
    gone = written(grouped.groupBy("doc_id", "th", "stays").agg(F.count(F.lit(1)).alias("copies")), "gone")
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row")
    docs = documents.select(row, F.col("doc_id").cast("bigint").alias("_d"), F.xxhash64(F.col("text").cast("string")).alias("_t"))
    same = lambda t: F.col("_d").eqNullSafe(t["doc_id"]) & (F.col("_t") == t["th"])
    drop = small(gone.where("not stays or copies > 1").select("doc_id", "th"))
    once = small(gone.where("stays and copies > 1").select("doc_id", "th"))
    out = docs.join(drop, same(drop), "left_anti").select("_row")
    repeated = docs.join(once, same(once), "left_semi").dropDuplicates(["_d", "_t"]).select("_row")
    return out.unionByName(repeated).select(*[F.col(f"_row.`{c}`").alias(c) for c in documents.columns])


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = counted(table(spark, sf_dir, "documents"), 3, 90)
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "n_links")


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]
                                     WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' ' || len(w)] ELSE [] END)) AS h FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS i FROM s x JOIN s y ON x.h = y.h AND x.r < y.r
      JOIN n nx ON nx.r = x.r JOIN n ny ON ny.r = y.r WHERE 100 * least(nx.n, ny.n) >= 90 * greatest(nx.n, ny.n) GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n nx ON nx.r = a JOIN n ny ON ny.r = b WHERE 190 * i >= 90 * (nx.n + ny.n)),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
l AS (SELECT a AS r, count(*) AS n_links FROM e2 GROUP BY a),
c AS (SELECT r, r AS t FROM d UNION SELECT c.r, e2.b FROM c JOIN e2 ON e2.a = c.t)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id, coalesce(l.n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN n USING (r) LEFT JOIN l USING (r) JOIN c USING (r) JOIN d o ON o.r = c.t GROUP BY d.r, d.doc_id, n.n, l.n_links
"""
