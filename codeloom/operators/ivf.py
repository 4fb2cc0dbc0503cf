"""Approximate dense search per repository with an inverted-file index (D3).

Build: ``pyspark.ml`` KMeans over the unit vectors gives ``n_cells`` centroids, kept as a
small table ``(cell, centroid)``; every vector is assigned to its nearest cell
(``model.transform``, a narrow job).  The members ``(repo_id, cell, id, unit)`` are written
once, partitioned by cell, so a probe reads its cells only.

Query: each query picks its ``nprobe`` best cells; the queries that probe a cell, in groups, meet
the members of their repository, in blocks, in an equi-join on ``(repo_id, cell)``.  The groups are broadcast
if their size allows; beyond that both sides are salted, so a hot cell is spread over several
tasks.  Only probed cells are scored, a block with a group at once in numpy: the pairs never become rows, only
the k best of a task, and the per-query top-k is a ``WindowGroupLimit`` before the final shuffle.  With ``nprobe == n_cells`` the result is
exact within the repository.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StringType, StructField, StructType

from codeloom.functions.vectors import l2_normalise
from codeloom.operators.ranking import best_of_task, best_products, dense_rank, top_k
from codeloom.session import checked_broadcast, limit_batches, materialize, spread_join

GROUP = 512      # queries that meet a block at once
SALTS = 8        # tasks that share a cell where the groups are too large to broadcast


@dataclass
class IvfIndex:
    centroids: DataFrame        # (cell, centroid), n_cells rows
    members: DataFrame          # (repo_id, cell, id, unit)


def ivf_build(vectors: DataFrame, n_cells: int, id_col: str = "id", vec_col: str = "embedding",
              repo_col: str | None = None, seed: int = 42, max_iter: int = 20) -> IvfIndex:
    """Index of ``vectors``; without ``repo_col`` all vectors are of one repository, ``""``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    repo = F.lit("") if repo_col is None else F.col(repo_col).cast("string")
    unit = vectors.select(repo.alias("repo_id"), F.col(id_col).alias("id"), l2_normalise(vec_col).alias("unit"))
    feats = unit.withColumn("features", array_to_vector("unit"))
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cell").fit(feats)
    cells = [(i, list(map(float, c))) for i, c in enumerate(model.clusterCenters())]   # n_cells, a build parameter
    centroids = vectors.sparkSession.createDataFrame(cells, "cell int, centroid array<double>")
    members = materialize(model.transform(feats).select("repo_id", "cell", "id", "unit"), "ivf-members", ["cell"])
    return IvfIndex(centroids, members)


def _probe(cells: np.ndarray, centroids: np.ndarray, nprobe: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = batch.column("q").flatten().to_numpy().reshape(batch.num_rows, -1)
            best = np.argsort(-(q @ centroids.T), axis=1, kind="stable")[:, :nprobe]
            at = pa.array(np.repeat(np.arange(batch.num_rows), best.shape[1]))
            rows = batch.take(at)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cells[best.ravel()], pa.int32())], [*batch.schema.names, "cell"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (repo_id, cell, ids, vs) for each cell of a repository of a batch; vs: the vectors' doubles."""
    for batch in batches:
        repo = batch.column("repo_id").dictionary_encode()
        key = repo.indices.fill_null(-1).to_numpy().astype(np.int64) * (1 << 31) + batch.column("cell").to_numpy()
        for one in np.unique(key):
            rows = batch.take(pa.array(np.flatnonzero(key == one)))
            ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column("id"))
            vs = np.ascontiguousarray(rows.column("unit").flatten().to_numpy(), np.float64).tobytes()
            yield pa.RecordBatch.from_arrays([rows.column("repo_id").slice(0, 1), rows.column("cell").slice(0, 1), ids, pa.array([vs], pa.binary())],
                                             ["repo_id", "cell", "ids", "vs"])


def _score(k: int):
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids, group = row.column("ids").flatten(), row.column("group").flatten()
                v, place = np.frombuffer(row.column("vs")[0].as_buffer(), np.float64).reshape(len(ids), -1), dense_rank(ids)
                for a in range(0, len(group), GROUP):
                    some = group.slice(a, GROUP)
                    q = some.field("q").flatten().to_numpy().reshape(len(some), -1)
                    r, c, score = best_products(q, v, place, k)
                    yield pa.RecordBatch.from_arrays([some.field("query_id").take(pa.array(r)), ids.take(pa.array(c)), pa.array(score)], ["query_id", "id", "score"])

    return lambda batches: best_of_task(met(batches), k, "id")


def ivf_topk(index: IvfIndex, queries: DataFrame, k: int, nprobe: int, qvec_col: str = "qvec",
             repo_col: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """``(query_id, id, score, rank)``: approximate top ``k`` by cosine in the query's
    repository, ``rank`` 0-based."""
    repo = F.lit("") if repo_col is None else F.col(repo_col).cast("string")
    limit_batches(queries.sparkSession)
    rows = index.centroids.orderBy("cell").collect()
    cells, centroids = np.array([r.cell for r in rows]), np.array([r.centroid for r in rows])
    q = queries.select("query_id", repo.alias("repo_id"), l2_normalise(qvec_col).alias("q")).filter(F.col("q").isNotNull())
    probes = q.mapInArrow(_probe(cells, centroids, nprobe), q.withColumn("cell", F.lit(0)).schema)
    n_groups = max(1, -(-queries.count() // GROUP))
    dealt = probes.groupBy("repo_id", "cell", F.pmod(F.xxhash64("query_id"), F.lit(n_groups)).alias("g"))
    groups = materialize(dealt.agg(F.collect_list(F.struct("query_id", "q")).alias("group")).drop("g"), "ivf-groups")
    id_type, query_type = index.members.schema["id"].dataType, q.schema["query_id"].dataType
    blocks = index.members.select("repo_id", "cell", "id", "unit").mapInArrow(_pack, StructType([StructField("repo_id", StringType()), StructField("cell", IntegerType()),
                                                  StructField("ids", ArrayType(id_type)), StructField("vs", BinaryType())]))
    met = spread_join(blocks, *checked_broadcast(groups, max_bytes), ["repo_id", "cell"], F.element_at("ids", 1), SALTS)
    scored = met.select("ids", "vs", "group").mapInArrow(
        _score(k), StructType([StructField("query_id", query_type), StructField("id", id_type), StructField("score", DoubleType())]))
    return top_k(scored.withColumn("score", F.round("score", 6)), k, F.col("score").desc(), F.col("id"))
