"""Fusion tie order, BM25 idf floor, evaluation metrics, progress and upserts."""

import math

from pyspark.sql import functions as F

from codeloom.operators.bm25 import build_bm25, bm25_topk
from codeloom.operators.evaluate import evaluate
from codeloom.operators.fuse import rrf_fuse
from codeloom.operators.jobs import job_progress
from codeloom.sources.store import upsert_chunks


def test_rrf_ties_dense_first(spark):
    dense = spark.createDataFrame([(1, "r", "a", 0), (1, "r", "b", 1)], "query_id int, repo_id string, chunk_id string, rank int")
    bm = spark.createDataFrame([(1, "r", "c", 0), (1, "r", "d", 1)], "query_id int, repo_id string, chunk_id string, rank int")
    got = [(r.chunk_id, r.rank, r.retrieval_method) for r in rrf_fuse(dense, bm, 4).orderBy("rank").collect()]
    # equal scores 1/60: dense hit first, then the BM25-only one
    assert got == [("a", 0, "dense"), ("c", 1, "bm25"), ("b", 2, "dense"), ("d", 3, "bm25")]


def test_bm25_negative_idf_floor(spark):
    chunks = spark.createDataFrame([("r", "c1", "x y"), ("r", "c2", "x z"), ("r", "c3", "x")],
                                   "repo_id string, chunk_id string, embed_text string")
    idx = build_bm25(chunks)
    idf = {r.tok: r.idf for r in idx.idf.collect()}
    raw = {"x": math.log(0.5) - math.log(3.5), "y": math.log(2.5) - math.log(1.5), "z": math.log(2.5) - math.log(1.5)}
    mean = sum(raw.values()) / 3
    assert abs(idf["x"] - 0.25 * mean) < 1e-9
    q = spark.createDataFrame([(1, "r", "y y")], "query_id int, repo_id string, text string")
    top = bm25_topk(idx, q, 5).collect()
    assert [r.chunk_id for r in top] == ["c1"]          # repeated query word counts twice


def test_metrics(spark):
    src = spark.createDataFrame([(1, 0, "a/route.py", "x"), (1, 1, "b.py", "login"), (2, 0, "c.py", "y"),
                                 (3, 5, "d.py", "auth")], "query_id int, pos int, file string, name string")
    golden = spark.createDataFrame([(1, ["Route"]), (2, ["nothing"]), (3, ["auth"]), (4, ["x"])],
                                   "query_id int, expected_symbols array<string>")
    per_q, m = evaluate(src, golden)
    assert {r.query_id: r.hit_rank for r in per_q.collect()} == {1: 1, 2: None, 3: None, 4: None}
    row = m.collect()[0]
    assert (row.n, row.hits_at_1, row.hit_at_1, row.mrr_at_5) == (4, 1, 0.25, 0.25)


def test_job_progress_buckets(spark):
    b = spark.createDataFrame([(7, i, 8) for i in range(10)], "job_id int, batch_id int, n_chunks int")
    got = [(r.indexed, r.progress) for r in job_progress(b, bucket=3).orderBy("batch_id").collect()]
    assert got[0] == (8, 45 + int(54 * 8 / 80)) and got[-1] == (80, 99)


def test_upsert_new_wins(spark):
    old = spark.createDataFrame([("r", "a", "1"), ("r", "b", "1")], "repo_id string, chunk_id string, content string")
    new = spark.createDataFrame([("r", "a", "2")], "repo_id string, chunk_id string, content string")
    got = {r.chunk_id: r.content for r in upsert_chunks(old, new).collect()}
    assert got == {"a": "2", "b": "1"}
