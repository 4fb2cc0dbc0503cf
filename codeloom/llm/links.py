"""Numbers of links of the Jaccard join, by a prefix join inside blocks of a component.

All links of a class lie in its component, so once components are known, every other link is one
between two of their classes.  Classes of one component are dealt into blocks of about
BLOCK_ENTRIES shingles and BLOCK_CLASSES classes; small components share blocks.  Classes of a
large component are banded by size first, so that only equal or neighbouring bands can link, and
two of its blocks meet only if some prefix shingle of the join's postings is in both.  A task
joins two blocks (or one with itself) on the prefix shingles of their own rare-first order,
drops pairs by length, and verifies each other pair once, on the full sets.  It returns sums by
class, so that links are never rows of their own: a group of m different near copies costs
m^2 / 2 verifications spread over tasks of a bounded size, and m rows a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import checked_broadcast, spread_join

from .common import tidy, written

BLOCK_ENTRIES = 1 << 18
BLOCK_CLASSES = 1024
MEETINGS = 16          # meetings of two blocks in a task

PACKED = "block bigint, keys binary, copies binary, sizes binary, hashes binary"
COUNTS = "key bigint, links bigint"


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def placed(classes: DataFrame, percent: int) -> DataFrame:
    """Classes (key, n, component, ...) of components of two or more, with ``band``, ``block`` and
    ``large``: whether their component has several blocks."""
    width = max(0.01, math.log(100 / percent) * 1.0001)
    banded = classes.withColumn("band", F.floor(F.log("n") / F.lit(width)))
    bands = written(banded.groupBy("component", "band").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("entries")), "bands")
    blocks = F.ceil(F.greatest(F.col("entries") / BLOCK_ENTRIES, F.col("many") / BLOCK_CLASSES))
    whole = bands.groupBy("component").agg(F.sum("many").alias("many"), F.sum("entries").alias("entries")).where("many > 1") \
        .select("component", (blocks > 1).alias("large"), "many", "entries")
    whole = written(whole, "whole")
    rest = whole.where("not large").agg(F.sum("many").alias("many"), F.sum("entries").alias("entries")).select(blocks).first()[0]
    plan = written(bands.join(whole.select("component", "large"), "component")
                   .select("component", "band", "large", blocks.alias("spread")), "plan")
    plan, hinted = checked_broadcast(plan)
    block = F.when(F.col("large"), F.xxhash64("component", "band", F.pmod(F.xxhash64("key"), F.col("spread")))) \
        .otherwise(F.pmod(F.xxhash64("component"), F.lit(int(rest or 1))))
    return spread_join(banded, plan, hinted, ["component", "band"], F.col("key")).withColumn("block", block).drop("spread")


def pack(group: pa.Table) -> pa.Table:
    """One row of a block's classes; a class that came several times is there once."""
    _, first = np.unique(group.column("key").to_numpy(), return_index=True)
    group = group.take(pa.array(first)).combine_chunks()
    sets = group.column("shingles").combine_chunks()
    columns = (group.column("key"), group.column("copies"), pc.list_value_length(sets).cast(pa.int64()), sets.flatten())
    packed = [pa.array([c.to_numpy().tobytes()], pa.binary()) for c in columns]
    return pa.Table.from_arrays([group.column("block").slice(0, 1), *packed], ["block", "keys", "copies", "sizes", "hashes"])


def _unpacked(row: dict, mark: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(row[f"{mark}{c}"], t) for c, t in (("keys", np.int64), ("copies", np.int64), ("sizes", np.int64), ("hashes", np.uint64)))


def linked_in(sizes: np.ndarray, hashes: np.ndarray, left: int | None, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, rows j that link with it) of the sets, one after the other in ``hashes``: i of the first
    ``left`` rows and j of the others, or i < j of all rows if ``left`` is None."""
    rows = len(sizes)
    _, col, often = np.unique(hashes, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(rows), sizes)
    order = np.lexsort((col, often[col], row))
    col, row = col[order], row[order]                # rare first; rows stay together
    place = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
    shared = often[col] > 1
    in_prefix = shared & (place < prefix_length(sizes, percent)[row])
    col, row, in_prefix = col[shared], row[shared], in_prefix[shared]
    edge = np.searchsorted(row, np.arange(rows + 1))

    # The join on prefix shingles: lists of rows by shingle.
    of, pr = col[in_prefix], row[in_prefix]
    order = np.lexsort((pr, of))
    of, pr = of[order], pr[order]
    cut = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of)) if len(of) else np.zeros(1, np.int64)
    a, b = (rows, rows) if left is None else (left, rows - left)
    shift = 0 if left is None else left
    candidate = np.zeros((a, b), bool)
    for x, y in zip(cut[:-1], cut[1:], strict=True):
        if y - x > 1:
            xs = ys = pr[x:y]
            if left is not None:
                m = int(np.searchsorted(xs, left))
                xs, ys = xs[:m], ys[m:] - left
            if len(xs) and len(ys):
                candidate[xs[:, None], ys] = True

    mark = np.zeros(len(often), bool)
    for i in range(a):
        js = np.flatnonzero(candidate[i]) + shift
        js = js[js > i]
        n = sizes[js]
        js = js[100 * np.minimum(n, sizes[i]) >= percent * np.maximum(n, sizes[i])]
        if not len(js):
            continue
        mine = col[edge[i]:edge[i + 1]]
        mark[mine] = True
        many = edge[js + 1] - edge[js]
        at = np.cumsum(many) - many
        entries = np.arange(many.sum()) + np.repeat(edge[js] - at, many)
        common = np.add.reduceat(mark[col[entries]].astype(np.int64), at)   # candidates share a shingle, so no set is empty
        mark[mine] = False
        js = js[(100 + percent) * common >= percent * (sizes[js] + sizes[i])]
        if len(js):
            yield i, js


def _counts(keys: np.ndarray, copies: np.ndarray, found: Iterator[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    links = np.zeros(len(keys), np.int64)
    for i, js in found:
        links[i] += copies[js].sum()
        links[js] += copies[i]
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(links[some])], ["key", "links"])


def _inside(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, copies, sizes, hashes = _unpacked(row, "")
                yield _counts(keys, copies, linked_in(sizes, hashes, None, percent))

    return run


def _between(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, y = _unpacked(row, ""), _unpacked(row, "y_")
                keys, copies, sizes, hashes = (np.concatenate(c) for c in zip(x, y, strict=True))
                yield _counts(keys, copies, linked_in(sizes, hashes, len(x[0]), percent))

    return run


def link_counts(members: DataFrame, sets: DataFrame, postings: DataFrame, percent: int) -> DataFrame:
    """(key, links) of classes with links to others: the copies of all classes that they link with.
    ``members(key, n, component, band, block, large)`` are ``placed`` classes, written; ``sets(block,
    key, copies, shingles)`` holds each of them once or more, shingles sorted or not but distinct;
    ``postings(fp, key)`` those of the prefix join."""
    packed = written(sets.groupBy("block").applyInArrow(tidy(pack), PACKED), "blocks")
    found = packed.mapInArrow(tidy(_inside(percent)), COUNTS)
    large = members.where("large").select("key", "component", "band", "block")
    if not large.isEmpty():
        lists = postings.select("fp", "key").join(large, "key").select("fp", "component", "band", "block").dropDuplicates()
        lists = written(lists, "lists")
        x, y = lists.alias("x"), lists.alias("y")
        meet = (x.join(y, (F.col("x.fp") == F.col("y.fp")) & (F.col("x.component") == F.col("y.component"))
                       & (F.col("x.block") < F.col("y.block")) & (F.abs(F.col("x.band") - F.col("y.band")) <= 1))
                .select(F.col("x.block").alias("block"), F.col("y.block").alias("y_block")).dropDuplicates())
        meet = written(meet, "meet")
        others = packed.select(*[F.col(c).alias(f"y_{c}") for c in packed.columns])
        # A number of tasks of its own: the sizes of these rows say little of the work behind them.
        parts = max(packed.sparkSession.sparkContext.defaultParallelism, meet.count() // MEETINGS)
        both = meet.join(packed, "block").join(others, "y_block").repartition(parts, "block", "y_block")
        found = found.unionByName(both.mapInArrow(tidy(_between(percent)), COUNTS))
    return found.groupBy("key").agg(F.sum("links").alias("links"))
