"""Filter interaction audit over a sparse document-term matrix.

Five failure conditions of a document (text null: empty; words: runs of anything but space and
0x09-0x0D, case-sensitive): A under 200 words; B 100 * distinct words < 50 * words; C 100 *
``[A-Z]`` > 2 * code points; D holds one of ``#$%&*|``; E a smaller doc_id has the same text.

1. Shards.  One scan packs slices of documents into CSR shards with local word numbers, counts
   per document and word, and the marks that need the characters (C, D, SHA-256 of the text).
2. Dictionary.  The shards' distinct words get dense global numbers by hash ranges (``encode``).
3. Matrix.  Each shard meets the numbers of its own words and is written again as CSR over
   global columns.  Row sums are the word counts, nonzero counts the distinct words: A and B.
4. Audit.  Documents shrink to five bits, are counted per part and combination of bits (at most
   32 a part, combined before the shuffle), and all 120 orders are read off those counts.  In an order
   a document is removed by the first filter that it fails; so filter f removes a document
   with m failures in 120 / m of the orders, which is the Shapley sum.

Cases: null doc_ids come after all others for E, and their rows have no labels; rows of the
same doc_id are documents of their own, none the other's smaller copy; labels of a doc_id that
appears repeatedly count if any says 1; null and empty sources are one part, the empty string;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import table

from .common import limit_batches, need, slices, small, text_buffer, tidy, word_bounds, written
from .encode import SHARD_BYTES, VOCABULARY, global_numbers, local_words, number_words, shard_numbers, unzipped, zipped, zstd

FILTERS = "ABCDE"
FEWEST_WORDS = 200
LEAST_DISTINCT = 50    # per 100 words
MOST_CAPITALS = 2      # per 100 code points
MARKS = "#$%&*|"
SALTS = 16             # of copied texts, where these are too many to broadcast
_DOCS = "shard bigint, doc_id array<bigint>, part array<string>, digest array<binary>, marks array<int>"
_CSR = ", indptr binary, cols binary, counts binary"
SHARDS = f"{_DOCS}{_CSR}, {VOCABULARY}"
MATRIX = _DOCS + _CSR
ROWS = "doc_id bigint, part string, digest binary, words bigint, distinct_words bigint, marks int"

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_CAPITAL = np.zeros(256, np.int64)
_CAPITAL[65:91] = 1
_POINT = np.ones(256, np.int64)
_POINT[128:192] = 0     # bytes that continue a code point
_MARK = np.zeros(256, np.int64)
_MARK[list(MARKS.encode())] = 1


def _sums(value: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(value[data], out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


@tidy
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = shard_numbers()
    schema = pa.schema([("shard", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("part", pa.list_(pa.string())),
                        ("digest", pa.list_(pa.binary())), ("marks", pa.list_(pa.int32())),
                        *[(c, pa.binary()) for c in ("indptr", "cols", "counts", "words", "sizes", "times")]])
    for batch in batches:
        ids, parts = batch.column("doc_id").to_pylist(), batch.column("part").to_pylist()
        data, bounds = text_buffer(batch.column("text"))
        for a, b in slices(bounds, SHARD_BYTES):
            part, cut = data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a]
            start, end, first = word_bounds(part, cut)
            local, vocabulary = local_words(part[_WORD[part]], end - start)
            size = int(local.max(initial=0)) + 1
            cells, counts = np.unique(np.repeat(np.arange(b - a) * size, np.diff(first)) + local, return_counts=True)
            indptr = np.searchsorted(cells, np.arange(b - a + 1) * size)
            capital = 100 * _sums(_CAPITAL, part, cut) > MOST_CAPITALS * _sums(_POINT, part, cut)
            marks = capital * 4 + (_sums(_MARK, part, cut) > 0) * 8
            digest = [hashlib.sha256(part[cut[i]:cut[i + 1]]).digest() for i in range(b - a)]
            row = [next(number), ids[a:b], parts[a:b], digest, marks.tolist(), indptr.astype("<i8").tobytes(),
                   zipped((cells % size).astype("<i4")), zipped(counts.astype("<i4")), *vocabulary]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types)], schema=schema)


@tidy
def _globalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in MATRIX.split(", ")]
    for batch in batches:
        cols, counts = [], []
        for local, count, indptr, entry in zip(*[batch.column(c).to_pylist() for c in ("cols", "counts", "indptr", "map")]):
            ids = global_numbers(entry)[unzipped(local, "<i4")]
            rows = np.diff(np.frombuffer(indptr, "<i8"))
            # Rows stay in place; inside each the global columns ascend.
            order = np.lexsort((ids, np.repeat(np.arange(len(rows)), rows)))
            cols.append(zipped(ids[order].astype("<i8")))
            counts.append(zipped(unzipped(count, "<i4")[order]))
        new = {"cols": pa.array(cols, pa.binary()), "counts": pa.array(counts, pa.binary())}
        yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names)


@tidy
def _row_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            indptr = np.frombuffer(batch.column("indptr")[i].as_py(), "<i8")
            counts = unzipped(batch.column("counts")[i].as_py(), "<i4")
            total = np.zeros(len(counts) + 1, np.int64)
            np.cumsum(counts, out=total[1:])
            doc, part, digest, marks = (batch.column(c)[i].values for c in ("doc_id", "part", "digest", "marks"))
            yield pa.RecordBatch.from_arrays(
                [doc, part, digest, pa.array(total[indptr[1:]] - total[indptr[:-1]]), pa.array(np.diff(indptr)), marks],
                [f.split()[0] for f in ROWS.split(", ")])


def term_matrix(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dictionary, matrix) of ``documents(doc_id, part, text)``: the numbered words (see
    ``encode.number_words``), and written CSR shards over those numbers (indptr and zipped
    cols little-endian int64, zipped counts int32)."""
    limit_batches(documents.sparkSession)
    shards = zstd(documents.mapInArrow(_pack, SHARDS), "csr-local")
    words, numbers = number_words(shards)
    local = shards.drop("words", "sizes", "times")
    return words, zstd(local.join(numbers, "shard", "left").mapInArrow(_globalise, MATRIX), "csr")


def failures(documents: DataFrame) -> DataFrame:
    """(doc_id, part, words, distinct_words, failed) per row of ``documents(doc_id, text, source)``;
    bit i of ``failed`` is filter i of FILTERS."""
    docs = need(documents, doc_id="bigint", text="string", source="string").select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), "text")
    rows = written(term_matrix(docs)[1].mapInArrow(_row_sums, ROWS), "audit-rows")
    copied = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
                     .where("n > 1 AND first IS NOT NULL").drop("n"), "audit-copied")
    few = small(copied)
    if few is copied:   # many copied texts: a frequent one is spread over SALTS keys
        salt = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), "words"), F.lit(SALTS))
        met = rows.withColumn("_salt", salt).join(
            copied.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), ["digest", "_salt"], "left")
    else:
        met = rows.join(few, "digest", "left")
    copy = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("first") < F.col("doc_id")))
    bit = lambda test, n: F.when(test, n).otherwise(0)
    return met.select("doc_id", "part", "words", "distinct_words", (
        bit(F.col("words") < FEWEST_WORDS, 1) + bit(100 * F.col("distinct_words") < LEAST_DISTINCT * F.col("words"), 2)
        + F.col("marks") + bit(copy, 16)).alias("failed"))


def _steps() -> Column:
    """The 600 pairs of an order and a step, with the filters before the step and its own."""
    return F.array(*[
        F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(step + 1).alias("step"),
                 F.lit(sum(1 << FILTERS.index(f) for f in order[:step])).alias("before"),
                 F.lit(1 << FILTERS.index(order[step])).alias("own"))
        for order in permutations(FILTERS) for step in range(len(FILTERS))])


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts per part, order of the filters and step; see the module's docstring."""
    rows = failures(documents)
    marked = need(labels, doc_id="bigint", quality="int", toxic="int").where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")).where("good + toxic > 0")
    known = rows.where("doc_id IS NOT NULL").join(marked, "doc_id", "left").select("part", "failed", "good", "toxic")
    lone = rows.where("doc_id IS NULL").select("part", "failed", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    seen = known.unionByName(lone).groupBy("part", "failed").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    parts = seen.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("seen"))
    steps = parts.select("part", "seen", F.explode(_steps()).alias("s")).select("part", "seen", "s.*")

    def total(value, test):
        return F.aggregate("seen", F.lit(0).cast("bigint"), lambda acc, c: acc + F.when(test(c["failed"]), value(c)).otherwise(0))

    own, before = F.col("own"), F.col("before")
    n = lambda c: c["n"]
    fails = lambda x: x.bitwiseAND(own) != 0
    gone = lambda x: x.bitwiseAND(before) != 0
    removed = lambda x: fails(x) & ~gone(x)
    orders = F.lit(len(list(permutations(FILTERS))))
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total(n, lambda x: ~fails(x) & ~gone(x)).alias("kept"),
        total(n, removed).alias("removed"),
        total(n, lambda x: fails(x) & gone(x)).alias("redundant"),
        total(n, lambda x: x == own).alias("unique_fails"),
        total(lambda c: c["good"], removed).alias("good_lost"),
        total(lambda c: c["toxic"], removed).alias("toxic_lost"),
        total(lambda c: c["n"] * (orders / F.bit_count(c["failed"])).cast("bigint"), fails).alias("shapley"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CAST(coalesce(quality, 0) = 1 AS INT)) AS good, max(CAST(coalesce(toxic, 0) = 1 AS INT)) AS bad
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
         [len(w) < 200,
          100 * list_unique(w) < 50 * len(w),
          100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t),
          regexp_matches(t, '[#$%&*|]'),
          coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), min(doc_id) OVER (PARTITION BY t) IS NOT NULL)] AS fails
  FROM d LEFT JOIN l USING (doc_id)),
h AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
o AS (
  SELECT '' AS filter_order, 0 AS len
  UNION ALL
  SELECT filter_order || x, len + 1 FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o WHERE len = 5),
m AS (SELECT part, filter_order, step, n, good, bad, fails, substr(filter_order, step, 1) AS own,
             fails[ascii(substr(filter_order, step, 1)) - 64] AS now,
             len(list_filter(range(1, step), lambda i: fails[ascii(substr(filter_order, i::INT, 1)) - 64])) > 0 AS gone
      FROM h, s),
r AS (
  SELECT part, filter_order, step, any_value(own) AS own,
         sum(n) FILTER (NOT now AND NOT gone) AS kept, sum(n) FILTER (now AND NOT gone) AS removed,
         sum(n) FILTER (now AND gone) AS redundant,
         sum(n) FILTER (now AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
         sum(good) FILTER (now AND NOT gone) AS good_lost, sum(bad) FILTER (now AND NOT gone) AS toxic_lost
  FROM m GROUP BY part, filter_order, step)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
FROM r
"""
