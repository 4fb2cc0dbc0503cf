"""Per-query top-k."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(scored: DataFrame, k: int, *order: Column, key: str = "query_id") -> DataFrame:
    """The first ``k`` rows of every ``key`` by ``order``, with their 0-based ``rank``.

    The filter compares ``row_number()`` itself with ``k``: only then does Spark plan a
    ``WindowGroupLimit``, which keeps k rows per key and task before the shuffle."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return scored.withColumn("_n", n).filter(F.col("_n") <= k).withColumn("rank", F.col("_n") - 1).drop("_n")


BUFFER = 200_000      # rows of best products that a task holds before it drops those beyond k


def half_up(x: np.ndarray) -> np.ndarray:
    """``x`` at 6 decimals as ``F.round`` gives it: halves of the shortest decimal form go away from zero."""
    scaled = x * 1e6
    out = np.rint(scaled) / 1e6
    unsure = np.isfinite(x) & (np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5) < 1e-4)
    if unsure.any():
        values, at = np.unique(x[unsure], return_inverse=True)
        out[unsure] = np.array([float(Decimal(repr(v)).quantize(Decimal("1e-6"), ROUND_HALF_UP)) for v in values.tolist()])[at]
    return out


def dense_rank(values: pa.Array) -> np.ndarray:
    """The place of each value in Spark's ascending order, nulls first; equal values share one."""
    return pc.rank(values, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()


def first_k(key: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first rows of every ``key`` by descending score (NaN first, as in Spark) and id."""
    order = np.lexsort((ids, -np.where(np.isnan(score), np.inf, score), key))
    sorted_key = key[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_key, sorted_key) < k]


def best_products(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row of q, row of v, product)`` of the ``k`` first products of every row of ``q`` by the rounded product and the
    place of the id.  Products are summed from the first component to the last, as ``vectors.dot`` does; a
    matrix product, which sums in another order, only finds the candidates.  ``times``: how often each pair counts."""
    found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    if not (len(q) and len(v) and k > 0):
        return tuple(found)
    about = q @ v.T
    about[np.isnan(about)] = np.inf
    if times is not None:
        about[times == 0] = -np.inf
    cut = min(k, v.shape[0])
    least = np.partition(about, -cut, axis=1)[:, -cut] - 1.1e-6     # those that round to the same are within 1e-6
    held = about >= least[:, None]
    if times is not None:
        held &= times > 0
    r, c = np.nonzero(held)
    exact = np.zeros(len(r))
    for a, b in zip(np.ascontiguousarray(q.T), np.ascontiguousarray(v.T)):
        exact += a[r] * b[c]
    rounded = half_up(exact)
    if times is not None and (times > 1).any():
        again = np.repeat(np.arange(len(r)), np.minimum(times[r, c], k))
        r, c, exact, rounded = r[again], c[again], exact[again], rounded[again]
    at = first_k(r, rounded, ids[c], k)
    return r[at], c[at], exact[at]


def best_of_task(batches: Iterator[pa.RecordBatch], k: int, id_col: str) -> Iterator[pa.RecordBatch]:
    """Of the rows ``(query_id, id_col, score, ...)`` of a task the ``k`` first of every query, in pieces of at most about
    BUFFER rows, so that a block's best do not all become rows."""
    held, n = [], 0

    def cut() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        score = half_up(rows.column("score").to_numpy(zero_copy_only=False))
        return rows.take(pa.array(first_k(dense_rank(rows.column("query_id")), score, dense_rank(rows.column(id_col)), k)))

    for batch in batches:
        if not batch.num_rows:
            continue
        held, n = [*held, batch], n + batch.num_rows
        if n >= BUFFER:
            held = [cut()]
            if (n := held[0].num_rows) > BUFFER // 2:
                yield from held
                held, n = [], 0
    if held:
        yield cut()
