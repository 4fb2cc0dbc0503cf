"""Scored pairs of queries and vectors never become rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.functions.vectors import dot, l2_normalise
from codeloom.operators import ivf, ranking, signatures
from codeloom.operators.ranking import top_k


@pytest.fixture(scope="module")
def vectors(spark):
    """600 vectors of two repositories: equal ones, such as differ in the last digits, repeated and null ids."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(600, 8))
    base[100:160] = base[100]
    base[160:200] = base[100] + rng.normal(size=(40, 8)) * 1e-7
    rows = [(None if i == 7 else i - i % 2 if 200 <= i < 240 else i, "ab"[i // 10 % 2], [float(x) for x in base[i]]) for i in range(600)]
    return spark.createDataFrame(rows, "id bigint, repo string, embedding array<double>").repartition(3).cache()


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.where("id % 30 = 10 OR id BETWEEN 110 AND 130").selectExpr("id AS query_id", "repo", "embedding AS qvec").cache()


def all_pairs(vectors, queries, k):
    v = vectors.select("repo", "id", l2_normalise("embedding").alias("unit"))
    q = queries.select("query_id", "repo", l2_normalise("qvec").alias("q"))
    scored = v.join(q, "repo").select("query_id", "id", F.round(dot("q", "unit"), 6).alias("score"))
    return rows_of(top_k(scored, k, F.col("score").desc(), F.col("id")))


def rows_of(df):
    return sorted((str(r.query_id), r["rank"], str(r.id), r.score) for r in df.collect())


@pytest.mark.parametrize("most", [None, 0])
def test_probed_pairs_stay_in_their_tasks(spark, monkeypatch, vectors, queries, most):
    """Round 4, F1: of the pairs of a probe only the k best of a task become rows."""
    seen, top = [], ivf.top_k
    monkeypatch.setattr(ivf, "top_k", lambda df, *a, **kw: (seen.append(df), top(df, *a, **kw))[1])
    index = ivf.ivf_build(vectors, 4, repo_col="repo")
    found = ivf.ivf_topk(index, queries, 5, 4, repo_col="repo", max_bytes=most)
    assert rows_of(found) == all_pairs(vectors, queries, 5)
    assert seen[0].count() <= 5 * queries.count() * seen[0].rdd.getNumPartitions() < queries.count() * 250


def test_products_are_cut_in_pieces(spark, monkeypatch, vectors, queries):
    monkeypatch.setattr(ranking, "BUFFER", 8)
    batches = [r for r in vectors.select(F.lit(1).alias("query_id"), "id", F.lit(0.25).alias("score")).toArrow().to_batches(max_chunksize=7)]
    ids = [x for b in ranking.best_of_task(iter(batches), 3, "id") for x in b.column("id").to_pylist()]
    assert set(ids) >= {None, 0, 1} and len(ids) < 300


def test_halves_are_rounded_as_spark_does(spark):
    x = [0.0000005, -0.0000005, 0.1234565, 1.0000015, -0.9999995, 0.3, 0.0]
    want = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6).alias("y")).collect()]
    assert ranking.half_up(np.array(x)).tolist() == want


@pytest.mark.parametrize("most", [None, 0])
@pytest.mark.parametrize("keep", [1, 33, 1000])
def test_nearest_signatures_stay_in_their_tasks(spark, monkeypatch, vectors, queries, most, keep):
    """Round 4, F2: above MOST_PAIRS neither the nearest nor their pairs are written; the rows are those of the small form, with ties
    at the last distance, repeated and null ids, and query ids that come twice."""
    asked = queries.union(queries.where("query_id = 10")) if keep == 33 else queries
    wide = signatures.signature_index(vectors.withColumn("id", F.col("id").cast("string")), repo_col="repo", bits=64)

    def found(pairs):
        monkeypatch.setattr(signatures, "MOST_PAIRS", pairs, raising=False)
        df = signatures.signature_topk(wide, asked, 5, keep, repo_col="repo", max_bytes=most)
        return sorted((r.query_id, r["rank"], r.id, r.score, r.scored) for r in df.collect())

    monkeypatch.setattr(signatures, "BLOCK", 50, raising=False)
    small, written, put = found(1 << 40), [], signatures.materialize
    monkeypatch.setattr(signatures, "materialize", lambda df, name, *a: (written.append((name, put(df, name, *a))), written[-1][1])[1])
    assert found(0) == small and len(small) > 20
    assert keep == 33 or all(df.count() <= 600 for name, df in written if name != "distance-counts")
