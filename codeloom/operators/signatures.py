"""Approximate dense search by sign signatures with exact re-ranking (D3).

Build: every unit vector is projected on ``bits`` random hyperplanes through the origin (drawn
from a seed; bits x dimensions numbers, whatever the table's size); the signs are packed into
64-bit words.  Two vectors at angle a differ in a share a / pi of the bits, so the Hamming distance
of signatures ranks by angle at an eighth of a float vector's bytes or less.

Search: signatures of a repository in one Arrow batch are a block; blocks meet groups of queries
(broadcast after a size check, else dealt by repository and salt) twice: first a task counts, per query and
block, the signatures at each distance, then it gives those within the distance that holds the query's ``keep``
nearest.  ``keep`` nearest per query remain after a ``WindowGroupLimit``; only these meet their vectors and are scored exactly.  With ``keep`` as large as
the repository the result is exact.

Of more than MOST_PAIRS nearest in all none becomes a row: the vectors are laid out by id in blocks, ties at the last distance are
counted per block, which says where a query's ``keep``-th lies, and a task scores a block's share of them in numpy and keeps the
``k`` best.  What is written then grows with the vectors and the queries, not with their product.  Query ids that come
several times share their ``keep`` rows, and go by rows.

Cases: null vectors take no part; ties in distance go to the smaller id, as do ties in score;
queries of repositories without vectors have no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.vectors import dot, l2_normalise
from codeloom.operators.ranking import best_of_task, best_products, dense_rank, top_k
from codeloom.session import checked_broadcast, limit_batches, materialize, spread_join

BITS = 256
SEED = 7
GROUP = 512
EMIT = 100_000    # rows of a batch that a task gives back
MOST_PAIRS = 1 << 20    # nearest of all queries that may become rows
BLOCK = 2000      # vectors of a block, more if they have one id
SALTS = 8         # tasks that share a repository where the groups are too large to broadcast


@dataclass
class SignatureIndex:
    rows: DataFrame     # (repo_id, id, unit, sign array<bigint>)
    bits: int
    seed: int


def _signs(bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = batch.column("unit")
            v = unit.flatten().to_numpy().reshape(batch.num_rows, -1)
            if planes is None:
                planes = np.random.Generator(np.random.PCG64(seed)).normal(size=(v.shape[1], bits))
            words = np.packbits(v @ planes > 0, axis=1).view(">u8").astype(np.uint64).view(np.int64)
            sign = pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, words.shape[1], dtype=np.int32)), pa.array(words.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, sign], [*batch.schema.names, "sign"])

    return run


def _signed(units: DataFrame, bits: int, seed: int) -> DataFrame:
    return units.mapInArrow(_signs(bits, seed), units.withColumn("sign", F.array().cast("array<bigint>")).schema)


def signature_index(vectors: DataFrame, id_col: str = "id", vec_col: str = "embedding", repo_col: str | None = None,
                    bits: int = BITS, seed: int = SEED) -> SignatureIndex:
    """Index of ``vectors`` (one length); without ``repo_col`` all are of one repository, ``""``.  ``bits`` is
    a multiple of 64."""
    repo = F.lit("") if repo_col is None else F.col(repo_col).cast("string")
    units = vectors.select(repo.alias("repo_id"), F.col(id_col).cast("string").alias("id"), l2_normalise(vec_col).alias("unit")).where("unit IS NOT NULL")
    return SignatureIndex(materialize(_signed(units, bits, seed), "signatures"), bits, seed)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        repo = batch.column("repo_id").dictionary_encode()
        code = repo.indices.to_numpy(zero_copy_only=False)
        for c, name in enumerate(repo.dictionary.to_pylist()):
            rows = batch.take(pa.array(np.flatnonzero(code == c)))
            ends = pa.array([0, rows.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.ListArray.from_arrays(ends, rows.column(x)) for x in ("id", "sign"))],
                                             ["repo_id", "ids", "signs"])


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.StructArray, np.ndarray]]:
    """Each block and group that meet: the row, the group's queries, and the Hamming distances, a row per query."""
    words = lambda lists, n: lists.flatten().to_numpy().view(np.uint64).reshape(n, -1)
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            group = row.column("group").flatten()
            q, s = words(group.field("sign"), len(group)), words(row.column("signs").flatten(), len(row.column("ids")[0]))
            yield row, group, sum(np.bitwise_count(q[:, j, None] ^ s[None, :, j]).astype(np.int32) for j in range(s.shape[1]))


def _counts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group, apart in _distances(batches):
            n = np.bincount((apart + np.arange(len(apart))[:, None] * (bits + 1)).ravel(), minlength=len(apart) * (bits + 1))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([group.field("query_id").take(pa.array(at // (bits + 1))), pa.array((at % (bits + 1)).astype(np.int32)), pa.array(n[at])],
                                             ["query_id", "apart", "n"])

    return run


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, group, apart in _distances(batches):
        ids, edge = row.column("ids").flatten(), group.field("edge").to_numpy()
        r, c = np.nonzero(apart <= edge[:, None])
        for a in range(0, len(r), EMIT):
            x, y = r[a:a + EMIT], c[a:a + EMIT]
            repo = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(x), np.int32)), row.column("repo_id")).cast(pa.string())
            yield pa.RecordBatch.from_arrays([group.field("query_id").take(pa.array(x)), repo, ids.take(pa.array(y)), pa.array(apart[x, y])],
                                             ["query_id", "repo_id", "id", "apart"])


def _groups(q: DataFrame, columns: list[str], n_groups: int, max_bytes: int | None) -> tuple[DataFrame, bool]:
    dealt = q.groupBy("repo_id", F.pmod(F.xxhash64("query_id"), F.lit(n_groups)).alias("g"))
    return checked_broadcast(materialize(dealt.agg(F.collect_list(F.struct(*columns)).alias("group")).drop("g"), "query-groups"), max_bytes)


def signature_topk(index: SignatureIndex, queries: DataFrame, k: int, keep: int, qvec_col: str = "qvec",
                   repo_col: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """``(query_id, id, score, rank, scored)``: approximate top ``k`` by cosine in the query's repository, ``rank``
    0-based; ``scored`` of its vectors were compared with the query exactly, at most ``keep``."""
    repo = F.lit("") if repo_col is None else F.col(repo_col).cast("string")
    units = queries.select(F.col("query_id").cast("long").alias("query_id"), repo.alias("repo_id"), l2_normalise(qvec_col).alias("unit")).where("unit IS NOT NULL")
    q = materialize(_signed(units, index.bits, index.seed), "query-signatures")
    n = q.count()
    if n * keep <= MOST_PAIRS:
        return _by_rows(index, q, n, k, keep, max_bytes)
    several = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("query_id")
    once = q.where("query_id IS NOT NULL").join(several, "query_id", "left_anti")
    found = _in_blocks(index, once, n, k, keep, max_bytes)
    if several.isEmpty():
        return found
    return found.unionByName(_by_rows(index, q.join(several, "query_id", "left_semi"), n, k, keep, max_bytes))


def _by_rows(index: SignatureIndex, q: DataFrame, n: int, k: int, keep: int, max_bytes: int | None) -> DataFrame:
    n_groups = max(1, -(-n // GROUP))
    blocks = index.rows.select("repo_id", "id", "sign").mapInArrow(_pack, "repo_id string, ids array<string>, signs array<array<bigint>>")
    met = lambda rows, columns: spread_join(blocks, *_groups(rows, columns, n_groups, max_bytes), ["repo_id"], F.element_at("ids", 1)).select(
        "repo_id", "ids", "signs", "group")
    # How many vectors lie at each distance of a query says within which distance its first ``keep`` are; only those become rows.
    counts = met(q, ["query_id", "sign"]).mapInArrow(_counts(index.bits), "query_id bigint, apart int, n bigint").groupBy("query_id", "apart").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("query_id").orderBy("apart"))
    edges = counts.withColumn("upto", upto).where(F.col("upto") >= keep).groupBy("query_id").agg(F.min("apart").alias("edge"))
    edged = q.select("query_id", "repo_id", "sign").join(edges, "query_id", "left").withColumn("edge", F.coalesce("edge", F.lit(index.bits)))
    near = met(edged, ["query_id", "sign", "edge"]).mapInArrow(_nearest, "query_id bigint, repo_id string, id string, apart int")
    chosen = materialize(top_k(near, keep, F.col("apart"), F.col("id")).select("query_id", "repo_id", "id"), "near")
    sizes = chosen.groupBy("query_id").agg(F.count(F.lit(1)).alias("scored"))
    # The pairs meet the vectors first: what is shuffled for that holds no vector of a pair, and the queries are few.
    asking, _ = checked_broadcast(q.select("query_id", F.col("unit").alias("q")), max_bytes)
    pairs = chosen.join(index.rows.select("repo_id", "id", "unit"), ["repo_id", "id"]).join(asking, "query_id")
    scored = pairs.select("query_id", "id", F.round(dot("q", "unit"), 6).alias("score"))
    return top_k(scored, k, F.col("score").desc(), F.col("id")).join(sizes, "query_id")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come by (repo_id, id) as blocks of about BLOCK, cut where the id changes; blocks are numbered in order."""
    number, held = TaskContext.get().partitionId() << 32, None

    def block(rows: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal number
        number += 1
        flat = lambda name: np.ascontiguousarray(rows.column(name).flatten().to_numpy()).tobytes()
        ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column("id"))
        return pa.RecordBatch.from_arrays([rows.column("repo_id").slice(0, 1), pa.array([number], pa.int64()), ids,
                                           pa.array([flat("sign")], pa.binary()), pa.array([flat("unit")], pa.binary())], ["repo_id", "block", "ids", "signs", "units"])

    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        repo, ids = dense_rank(batch.column("repo_id")), dense_rank(batch.column("id"))
        new_repo = np.r_[False, np.diff(repo) != 0]
        start = 0
        for at in np.flatnonzero(new_repo | np.r_[False, np.diff(ids) != 0]):
            if new_repo[at] or at - start >= BLOCK:
                yield block(batch.slice(start, at - start))
                start = at
        held = batch.slice(start)
    if held is not None and held.num_rows:
        yield block(held)


def _block_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.StructArray, np.ndarray]]:
    """Each block and part of a group that meet: the row, the part's queries, and the Hamming distances, a row per query."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            whole = row.column("group").flatten()
            for a in range(0, len(whole), GROUP):
                group = whole.slice(a, GROUP)
                q = group.field("sign").flatten().to_numpy().view(np.uint64).reshape(len(group), -1)
                s = np.frombuffer(row.column("signs")[0].as_buffer(), np.uint64).reshape(-1, q.shape[1])
                apart = np.zeros((len(q), len(s)), np.int16)
                for j in range(q.shape[1]):
                    apart += np.bitwise_count(q[:, j, None] ^ s[None, :, j])
                yield row, group, apart


def _count_distances(bits: int):
    """How many vectors of a task lie at each distance of a query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group, apart in _block_distances(batches):
            n = np.bincount((apart + np.arange(len(apart))[:, None] * (bits + 1)).ravel(), minlength=len(apart) * (bits + 1))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([group.field("query_id").take(pa.array(at // (bits + 1))), pa.array((at % (bits + 1)).astype(np.int32)), pa.array(n[at])],
                                             ["query_id", "apart", "n"])

    return run


def _count_ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, group, apart in _block_distances(batches):
        n = (apart == group.field("edge").to_numpy()[:, None]).sum(1)
        at = np.flatnonzero(n)
        block = pa.array(np.full(len(at), row.column("block")[0].as_py(), np.int64))
        yield pa.RecordBatch.from_arrays([group.field("query_id").take(pa.array(at)), block, pa.array(n[at])], ["query_id", "block", "n"])


def _score_chosen(k: int):
    """The ``k`` best of a block's chosen: all below the edge, and at it those of blocks before the cut and the first ``room`` of the cut's.
    A chosen id stands for all vectors of that id, as a join on it would."""
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, group, apart in _block_distances(batches):
            ids, block = row.column("ids").flatten(), row.column("block")[0].as_py()
            edge, last, room = (group.field(x).to_numpy()[:, None] for x in ("edge", "last", "room"))
            tie = apart == edge
            chosen = (apart < edge) | tie & ((block < last) | (block == last) & (np.cumsum(tie, axis=1) <= room))
            place = dense_rank(ids)
            runs = np.flatnonzero(np.r_[True, np.diff(place) != 0])
            times = chosen.astype(np.int64)
            if len(runs) < len(place):
                times = np.repeat(np.add.reduceat(times, runs, axis=1), np.diff(np.r_[runs, len(place)]), axis=1)
            times[:, ids.is_null().to_numpy(zero_copy_only=False)] = 0
            v = np.frombuffer(row.column("units")[0].as_buffer(), np.float64).reshape(len(ids), -1)
            q = group.field("unit").flatten().to_numpy().reshape(len(group), -1)
            r, c, score = best_products(q, v, place, k, times)
            yield pa.RecordBatch.from_arrays([group.field("query_id").take(pa.array(r)), ids.take(pa.array(c)), pa.array(score)], ["query_id", "id", "score"])

    return lambda batches: best_of_task(met(batches), k, "id")


def _in_blocks(index: SignatureIndex, q: DataFrame, n: int, k: int, keep: int, max_bytes: int | None) -> DataFrame:
    limit_batches(q.sparkSession)
    n_groups = max(1, -(-n // GROUP))
    order = index.rows.where("repo_id IS NOT NULL").repartitionByRange("repo_id", "id").sortWithinPartitions("repo_id", "id")
    blocks = materialize(order.mapInArrow(_blocks, "repo_id string, block bigint, ids array<string>, signs binary, units binary"), "signature-blocks")

    def met(rows: DataFrame, columns: list[str], of_block: list[str]) -> DataFrame:
        few = _groups(rows, columns, n_groups, max_bytes)
        return spread_join(blocks.select("repo_id", "block", *of_block), *few, ["repo_id"], F.col("block"), SALTS).select("block", *of_block, "group")

    counted = met(q, ["query_id", "sign"], ["signs"]).mapInArrow(_count_distances(index.bits), "query_id bigint, apart int, n bigint")
    counts = materialize(counted.groupBy("query_id", "apart").agg(F.sum("n").alias("n")), "distance-counts")
    upto = F.sum("n").over(Window.partitionBy("query_id").orderBy("apart"))
    reached = counts.withColumn("upto", upto).where(F.col("upto") >= keep).groupBy("query_id").agg(F.min(F.struct("apart", "n", "upto")).alias("e"))
    # ``need`` of the ``e.n`` at the edge are chosen; where that is all of them, they lie below an edge one further.
    need = F.lit(keep) - F.col("e.upto") + F.col("e.n")
    whole = F.col("e").isNull() | (need == F.col("e.n"))
    edged = q.join(reached, "query_id", "left").select(*q.columns, F.when(whole, F.coalesce(F.col("e.apart"), F.lit(index.bits)) + 1).otherwise(F.col("e.apart")).alias("edge"),
                                                       F.when(~whole, need).otherwise(0).cast("long").alias("need"))
    edged = materialize(edged, "query-edges")
    ties = met(edged.where("need > 0"), ["query_id", "sign", "edge"], ["signs"]).mapInArrow(_count_ties, "query_id bigint, block bigint, n bigint")
    ties = ties.withColumn("upto", F.sum("n").over(Window.partitionBy("query_id").orderBy("block"))).join(edged.select("query_id", "need"), "query_id")
    cut = ties.where("upto >= need").groupBy("query_id").agg(F.min(F.struct("block", (F.col("need") - F.col("upto") + F.col("n")).alias("room"))).alias("c"))
    asking = edged.join(cut, "query_id", "left").select("query_id", "repo_id", "sign", "unit", "edge", F.coalesce("c.block", F.lit(-1)).cast("long").alias("last"),
                                                        F.coalesce("c.room", F.lit(0)).cast("long").alias("room"))
    scored = met(asking, ["query_id", "sign", "unit", "edge", "last", "room"], ["ids", "signs", "units"]).mapInArrow(
        _score_chosen(k), "query_id bigint, id string, score double").withColumn("score", F.round("score", 6))
    sizes = counts.groupBy("query_id").agg(F.least(F.sum("n"), F.lit(keep).cast("long")).alias("scored"))
    return top_k(scored, k, F.col("score").desc(), F.col("id")).join(sizes, "query_id")


def recall(found: DataFrame, exact: DataFrame, n_vectors: int) -> DataFrame:
    """One row ``(n_queries, recall, scored_share)``: the share of ``exact(query_id, id)`` in ``found``, and the mean share of
    the vectors that was scored."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    share = found.groupBy("query_id").agg(F.max("scored").alias("scored")).agg((F.avg("scored") / n_vectors).alias("scored_share"))
    whole = hits.agg(F.count_distinct("query_id").alias("n_queries"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
    one = F.lit(1).alias("one")      # both have one row
    return whole.select("*", one).join(F.broadcast(share.select("*", one)), "one").drop("one")
