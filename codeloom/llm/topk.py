"""Exact top-k inner-product search over a pivot-distance index.

Inner products become distances: with the largest norm M, x gets one more component
sqrt(M^2 - |x|^2) and a query gets 0, so |q - x|^2 = |q|^2 + M^2 - 2 <q, x>, and the highest
products are the nearest points.

Index.  Every vector is keyed by its nearest pivot and its distance from it.  Rows are dealt
out by ranges of (pivot, distance, vec_id), which no frequent vector can unbalance, and packed
into blocks of at most ``BLOCK`` rows: each block is an annulus of one pivot, known by its
smallest and largest distance.  Pivots come from a sample of at most ``SAMPLE`` vectors by
farthest-first choice; they affect speed alone.

Search.  By the triangle inequality, no point of an annulus is nearer to q than the gap
between d(q, pivot) and the annulus, which bounds its products from above.  A pivot's annuli are
sorted by distance and kept in pages of at most ``PAGE``, each the owner of a stretch of the
distance axis.  A first round opens, for a query's ``FIRST`` nearest pivots, and for as many more as
it takes to hold over k rows, the two nearest annuli of the page that owns its distance, which
yields its k-th score so far.  That score is a
radius: an annulus whose gap is larger can be skipped, and as the annuli are sorted, the others
are one run around the query's distance.  The second round opens the pages, and of them the
annuli, that the run reaches; what it does not reach never becomes a row.  Queries go to a block
in groups of at most about ``GROUP``, a task multiplies one block by one group, and only
products that reach the query's score so far leave it, k for each query at most.  Scores are
exact integers: products are taken in doubles if all of them fit 53 bits, else in Python ints
(they must fit a long).  The pages are broadcast only while they hold at most ``ANNULI`` annuli
of 32 bytes; else both sides are shuffled by (pivot, salt), with a copy of the pages for each of
``SALTS`` salts.

Cases: vectors that are null, or hold null or non-finite components, take no part; a shorter
vector counts as padded with zeros; rows equal in vec_id and vector are one row; a query's own
rows are those of its vec_id; rows of null vec_id take no part; ties go to the smaller vec_id;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.session import table

from .common import written

SCALE = 1024
PIVOTS = 32
SAMPLE = 2000
BLOCK = 2048
FIRST = 2
GROUP = 512
PAGE = 1024
ANNULI = 200_000
SALTS = 8
NONE = -(2**63)


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, without the vectors that take no part:
    null ids and vectors, null or non-finite components, and squared lengths of 2^62 or more, as
    shorter vectors' products all fit a long."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return (rows.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), v.alias("x"))
            .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & sound)
            .where(F.aggregate("x", F.lit(0.0), lambda n, x: n + F.pow(F.floor(x * F.lit(scale)).cast("double"), F.lit(2.0))) < F.lit(2.0 ** 62))
            .select("vec_id", F.transform("x", lambda x: F.floor(x * F.lit(scale)).cast("bigint")).alias("v"))
            .dropDuplicates())


def farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    chosen = [0]
    near = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(points)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def matrix(column: pa.Array, dims: int, dtype=np.float64) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(dtype)
    if len(flat) == len(column) * dims and (size == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims), dtype)
    out[np.repeat(np.arange(len(column)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, top - (x * x).sum(1)))
    return np.concatenate([x, rest[:, None]], 1)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T))


def _keyed(pivots: np.ndarray, dims: int, top: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = distances(lifted(matrix(b.column("v"), dims), top), pivots)
            p = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(p)), p])],
                                             ["vec_id", "v", "pivot", "dist"])

    return run


def _packed(size: int):
    """Consecutive rows of one pivot as blocks of at most ``size`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def blocks(rows: pa.Table, last: bool):
            p, a = rows.column("pivot").to_numpy(), 0
            while a < len(p):
                same = int(np.searchsorted(p, p[a], "right"))
                b = min(same, a + size)
                if not last and b == len(p) and b - a < size:
                    break
                part = rows.slice(a, b - a)
                d = part.column("dist").to_numpy()
                yield a, pa.RecordBatch.from_arrays(
                    [pa.array([int(p[a])], pa.int32()), pa.array([float(d.min())]), pa.array([float(d.max())]),
                     pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                     pa.array([part.column("v").to_pylist()], pa.list_(pa.list_(pa.int64())))],
                    ["pivot", "low", "high", "ids", "vs"])
                a = b
            yield a, None

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows < size:
                continue
            for a, out in blocks(held, False):
                if out is None:
                    held = held.slice(a).combine_chunks()
                else:
                    yield out
        if held is not None:
            yield from (out for _, out in blocks(held, True) if out is not None)

    return run


def _scored(dims: int, k: int, exact: bool):
    """The best k products of each query of the group in the block, if they reach its floor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                ids = one.column("ids").flatten().to_numpy()
                group = one.column("group").flatten()
                qid, floor = group.field("query_id").to_numpy(), group.field("floor").to_numpy(zero_copy_only=False)
                x, q = matrix(one.column("vs").flatten(), dims, np.int64), matrix(group.field("q"), dims, np.int64)
                s = (q.astype(float) @ x.T.astype(float)).astype(np.int64) if exact else q.astype(object) @ x.T.astype(object)
                ok = (s >= floor[:, None]) & (qid[:, None] != ids)
                out = []
                for r in np.flatnonzero(ok.any(1)):
                    c = np.flatnonzero(ok[r])
                    c = c[np.lexsort((ids[c], -s[r, c].astype(np.int64)))[:k]]
                    out.append((np.full(len(c), qid[r]), ids[c], s[r, c].astype(np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return run


def build_index(vectors: DataFrame, n_pivots: int = PIVOTS, block: int = BLOCK) -> tuple[DataFrame, dict]:
    """Blocks (block, pivot, low, high, ids, vs) of ``vectors(vec_id, v)`` and the facts that a
    search needs."""
    spark = vectors.sparkSession
    vectors = written(vectors, "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    top, dims = vectors.agg(F.max(square), F.max(F.size("v"))).first()
    if top is None:
        top, dims = 0.0, 0
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v")
    points = lifted(matrix(sample, dims), top) if len(sample) else np.zeros((1, dims + 1))
    pivots = farthest_first(points, n_pivots)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = (vectors.mapInArrow(_keyed(pivots, dims, top), "vec_id bigint, v array<bigint>, pivot int, dist double")
              .repartitionByRange(parts, "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
              .mapInArrow(_packed(block), "pivot int, low double, high double, ids array<bigint>, vs array<array<bigint>>")
              .withColumn("block", F.monotonically_increasing_id()))
    return written(blocks, "blocks"), {"pivots": pivots, "dims": dims, "top": top}


def _bounds(pivots: np.ndarray, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b.column("q"), dims)
            d = distances(np.concatenate([q, np.zeros((len(q), 1))], 1), pivots)
            n = len(pivots)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(b.column("query_id").to_numpy(), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(q))),
                 pa.array(d.ravel()), pa.array(np.repeat((q * q).sum(1), n))], ["query_id", "pivot", "dist", "qq"])

    return run


def paged(blocks: DataFrame, page: int = PAGE) -> DataFrame:
    """(pivot, since, until, annuli): a pivot's annuli by distance in pages of at most ``page``.
    A page owns the distances from its first annulus to the next page's, the first and the last
    page all that lie beyond.  Blocks are numbered in the order of (pivot, distance)."""
    number = F.row_number().over(W.partitionBy("pivot", "part").orderBy("block")) - 1
    # A partition of the ranges holds consecutive blocks: its number is in the upper bits of theirs.
    pages = (blocks.select("block", "pivot", "low", "high", F.size("ids").alias("rows"), F.shiftright("block", 33).alias("part"))
             .withColumn("page", F.floor(number / page))
             .groupBy("pivot", "part", "page").agg(F.sort_array(F.collect_list(F.struct("low", "high", "block", "rows"))).alias("annuli")))
    after = W.partitionBy("pivot").orderBy("part", "page")
    low = F.col("annuli")[0]["low"]
    pages = pages.select(
        "pivot", F.when(F.lag("page").over(after).isNotNull(), low).otherwise(F.lit(float("-inf"))).alias("since"),
        F.coalesce(F.lead(low).over(after), F.lit(float("inf"))).alias("until"), "annuli")
    return written(pages, "pages")


def opening(blocks: DataFrame, facts: dict, queries: DataFrame, k: int):
    """The two rounds' choices for ``queries(query_id, q)``: a table (query_id, block) of the first
    round, and a function from floors(query_id, floor) to the rest, (query_id, block, floor)."""
    top = facts["top"]
    pages = paged(blocks)
    at = queries.mapInArrow(_bounds(facts["pivots"], facts["dims"]), "query_id bigint, pivot int, dist double, qq double")
    at = written(at, "query-pivots")
    few = blocks.count() <= ANNULI

    def with_pages(rows: DataFrame) -> DataFrame:
        if few:
            return rows.join(F.broadcast(pages), "pivot")
        salt = F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int")
        copies = pages.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("salt", salt).join(copies, ["pivot", "salt"])

    gap = lambda x: F.greatest(F.lit(0.0), F.col("dist") - x["high"], x["low"] - F.col("dist"))

    nearest = F.slice(F.array_sort(F.transform("annuli", lambda x: F.struct(gap(x).alias("gap"), x["block"].alias("block"), x["rows"].alias("rows")))), 1, 2)
    own = (with_pages(at).where((F.col("since") <= F.col("dist")) & (F.col("dist") < F.col("until")))
           .select("query_id", "dist", "pivot", nearest.alias("nearest")))
    near = W.partitionBy("query_id").orderBy("dist", "pivot")
    before = F.sum(F.aggregate("nearest", F.lit(0), lambda s, x: s + x["rows"])).over(near.rowsBetween(W.unboundedPreceding, -1))
    first = (own.withColumn("n", F.row_number().over(near)).withColumn("before", before)
             .where((F.col("n") <= FIRST) | (F.col("before") <= k))
             .select("query_id", F.explode("nearest").alias("x")).select("query_id", "x.block"))
    first = written(first, "first")

    def rest(floors: DataFrame) -> DataFrame:
        # A product reaches the floor only within this distance; without a floor all annuli are opened.
        slack = F.lit(1e-9) * (F.col("qq") + top) + 1.0
        radius = F.sqrt(F.greatest(F.lit(0.0), (F.col("qq") + top - 2 * (F.col("floor") - slack)) * (1 + 1e-9)))
        done = first.groupBy("query_id").agg(F.collect_set("block").alias("done"))
        near = (at.join(done, "query_id", "left").join(floors, "query_id", "left")
                .withColumn("radius", F.when(F.col("floor").isNull(), F.lit(float("inf"))).otherwise(radius)))
        end = F.element_at("annuli", -1)["high"]
        reached = (F.col("since") <= F.col("dist") + F.col("radius")) & (end >= F.col("dist") - F.col("radius"))
        inside = F.filter("annuli", lambda x: (gap(x) <= F.col("radius")) & ~F.array_contains("done", x["block"]))
        return (with_pages(near).where(reached)
                .select("query_id", "floor", F.explode(inside).alias("x"))
                .select("query_id", F.col("x.block").alias("block"), F.coalesce("floor", F.lit(NONE).cast("bigint")).alias("floor")))

    return first, rest


def search(blocks: DataFrame, facts: dict, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries(query_id, q)``, exact."""
    first, rest = opening(blocks, facts, queries, k)
    n_groups = max(1, -(-queries.count() // GROUP))

    def run(pairs: DataFrame) -> DataFrame:
        groups = (pairs.join(queries, "query_id")
                  .groupBy("block", F.pmod(F.xxhash64("query_id"), F.lit(n_groups)).alias("g"))
                  .agg(F.collect_list(F.struct("query_id", "q", "floor")).alias("group")).drop("g"))
        return blocks.select("block", "ids", "vs").join(groups, "block").mapInArrow(
            _scored(facts["dims"], k, facts["top"] * 2 < 2**53), "query_id bigint, vec_id bigint, score bigint")

    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = run(first.withColumn("floor", F.lit(NONE).cast("bigint")))
    found = written(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k), "found")
    floors = found.where(F.col("n") == k).select("query_id", F.col("score").alias("floor"))
    both = found.drop("n").unionByName(run(rest(floors)))
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    blocks, facts = build_index(vectors)
    queries = vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return search(blocks, facts, written(queries, "queries"), 10)


OP6_SQL = """
WITH e AS (SELECT DISTINCT vec_id, [try_cast(floor(1024 * x::DOUBLE) AS BIGINT) for x in embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
             AND coalesce(list_sum([floor(1024 * x::DOUBLE) * floor(1024 * x::DOUBLE) for x in embedding]), 0) < 4611686018427387904::DOUBLE),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 10
"""
