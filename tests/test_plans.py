"""Plans: per-query limits before the shuffle, one execution of the search, and equal rows
when nothing may be broadcast."""

import pytest
from pyspark.sql import functions as F

import codeloom.session as S
from codeloom.operators.bm25 import build_bm25, bm25_topk
from codeloom.operators.dense import cosine_topk
from codeloom.operators.evaluate import hit_ranks
from codeloom.operators.expand import expand_queries
from codeloom.operators.fuse import lookup, rrf_fuse
from codeloom.operators.ivf import ivf_build, ivf_topk
from codeloom.sources.fixtures import relevance_pairs, synonyms_df

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def vectors(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    return e.select(F.concat(F.lit("r"), F.col("vec_id") % 3).alias("repo_id"), F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "vec_id")


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), "repo_id", F.col("embedding").alias("qvec"))


@pytest.fixture(scope="module")
def bm25(spark):
    rows = [("r", f"c{i}", " ".join(f"w{i % k}" for k in range(2, 12))) for i in range(60)]
    return build_bm25(spark.createDataFrame(rows, "repo_id string, chunk_id string, embed_text string"))


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, "r", "w1 w2 w3"), (2, "r", "w7 w7")], "query_id long, repo_id string, text string")


def forms(vectors, queries, bm25, questions):
    index = ivf_build(vectors, 4, id_col="vec_id", repo_col="repo_id")
    dense = cosine_topk(vectors, queries, 5)
    return {
        "native": cosine_topk(vectors, queries, 5, method="native"), "blocked": dense,
        "bm25": bm25_topk(bm25, questions, 5),
        "ivf": ivf_topk(index, queries, 5, 2, repo_col="repo_id"),
        "fuse": rrf_fuse(dense, bm25_topk(bm25, questions, 5), 3)}


def test_limits_come_before_the_shuffle(vectors, queries, bm25, questions):
    for name, df in forms(vectors, queries, bm25, questions).items():
        assert "WindowGroupLimit" in plan(df), name


def test_same_rows_without_broadcast(spark, monkeypatch, vectors, queries, bm25, questions):
    def everything():
        sources = spark.createDataFrame([(1, 0, "a/route.py", "x"), (1, 1, "b.py", "login")], "query_id int, pos int, file string, name string")
        golden = spark.createDataFrame([(1, ["login", "zz"]), (2, ["x"])], "query_id int, expected_symbols array<string>")
        asked = spark.createDataFrame([(1, "Where is the Author login?"), (2, "nothing"), (3, "")], "query_id int, question string")
        chunks = spark.createDataFrame([("r", f"c{i}", " text ", "d") for i in range(9)], "repo_id string, chunk_id string, content string, docstring string")
        out = forms(vectors, queries, bm25, questions) | {
            "hits": hit_ranks(sources, golden), "expand": expand_queries(asked, synonyms_df(spark)),
            "lookup": lookup(chunks, spark.createDataFrame([("r", "c1", 1), ("r", "c7", 2)], "repo_id string, chunk_id string, rank int")),
            "relevance": relevance_pairs(spark, SF)}
        return {k: sorted(map(str, df.collect())) for k, df in out.items()}

    small = everything()
    monkeypatch.setattr(S, "DEFAULT_BROADCAST_BYTES", 0)
    assert everything() == small


def test_dense_forms_agree(vectors, queries):
    a, b = (sorted(map(tuple, cosine_topk(vectors, queries, 6, method=m).select("query_id", "repo_id", "chunk_id", "score", "rank").collect())) for m in ("native", "blocked"))
    assert a == b and len(a) == 6 * queries.count()


def test_vectors_of_other_lengths_raise(spark):
    v = spark.createDataFrame([("r", "a", [1.0, 2.0]), ("r", "b", [1.0])], "repo_id string, chunk_id string, embedding array<double>")
    q = spark.createDataFrame([(1, "r", [1.0, 0.0])], "query_id long, repo_id string, qvec array<double>")
    with pytest.raises(Exception, match="differ in length"):
        cosine_topk(v.coalesce(1), q, 2).collect()


def test_ivf_recall_and_repositories(vectors, queries):
    index = ivf_build(vectors, 8, id_col="vec_id", repo_col="repo_id")
    exact = {(r.query_id, int(r.chunk_id)) for r in cosine_topk(vectors, queries, 5).collect()}
    full = {(r.query_id, r.id) for r in ivf_topk(index, queries, 5, 8, repo_col="repo_id").collect()}
    assert full == exact
    some = {(r.query_id, r.id) for r in ivf_topk(index, queries, 5, 4, repo_col="repo_id").collect()}
    assert len(some & exact) / len(exact) >= 0.6


def test_registered_probes_reach_the_recall(spark):
    import codeloom.plans.catalog as C
    sf = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    index = ivf_build(e, C.IVF_CELLS, id_col="vec_id")
    by_id = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    asked = C._bench_qvecs(spark, sf)
    exact = cosine_topk(e.select(F.lit("r").alias("repo_id"), F.col("vec_id").cast("string").alias("chunk_id"), "embedding"), by_id.withColumn("repo_id", F.lit("r")), 10)
    exact = {(r.query_id, int(r.chunk_id)) for r in exact.collect()}
    found = {(r.query_id, r.id) for r in ivf_topk(index, by_id, 10, C.IVF_PROBES).collect()}
    assert C.ivf_found(index, by_id).first().recall == pytest.approx(len(found & exact) / len(exact)) and len(found & exact) >= 0.9 * len(exact)
    assert C.ivf_found(index, asked).first().recall >= 0.9
    probed = {(r.query_id, r.vec_id) for r in C.q_ivf_topk_12_of_16(spark, sf).collect()}
    full = {(r.query_id, r.id) for r in ivf_topk(index, asked, 10, C.IVF_CELLS).collect()}
    assert len(probed & full) >= 0.9 * len(full)


def test_checkpoint_folder_must_be_shared(monkeypatch, spark):
    class Other:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda *_: None)}), Other

    with pytest.raises(ValueError, match="checkpoint"):
        S.checkpoint_dir(Session)


def test_vocabulary_is_not_shuffled_by_repository(bm25):
    idf = plan(bm25.idf)
    assert "hashpartitioning(repo_id" not in idf and "BroadcastHashJoin" in idf


def test_one_repository_is_spread_without_broadcast(spark, monkeypatch):
    """All rows are of one repository and nothing may be broadcast: no task has over twice the median."""
    monkeypatch.setattr(S, "DEFAULT_BROADCAST_BYTES", 0)
    large = spark.range(20_000).select(F.lit("r").alias("repo_id"), F.concat(F.lit("c"), "id").alias("chunk_id"))
    few = spark.createDataFrame([("r", 1)], "repo_id string, n int")
    few, hinted = S.checked_broadcast(few)
    assert not hinted
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = S.spread_join(large, few.hint("merge"), hinted, ["repo_id"], F.col("chunk_id"), salts=64)
        sizes = sorted(r.n for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20_000 and len(sizes) == 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_model_is_built_once_a_worker_and_fed_batches(spark, tmp_path):
    from codeloom.operators.embed import embed
    log = str(tmp_path)

    def model():
        import os
        import uuid

        import numpy as np
        open(f"{log}/built-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def predict(texts):
            open(f"{log}/batch-{len(texts)}-{uuid.uuid4().hex}", "w").close()
            return np.array([[0.0 if t is None else len(t), 1.0] for t in texts])
        return predict

    rows = spark.range(0, 1000, 1, 10).select("id", F.when(F.col("id") % 9 > 0, F.repeat(F.lit("x"), (F.col("id") % 7).cast("int"))).alias("t"))
    got = embed(rows, "t", make_model=model, batch_size=32, single=True)
    assert dict(got.dtypes)["embedding"] == "array<float>"
    assert all(r.embedding == [0.0 if r.t is None else float(len(r.t)), 1.0] for r in got.collect())
    import os
    names = os.listdir(log)
    built = [n.split("-")[1] for n in names if n.startswith("built")]
    assert len(built) == len(set(built)) < 10       # ten tasks, fewer workers
    assert max(int(n.split("-")[1]) for n in names if n.startswith("batch")) == 32


@pytest.mark.parametrize("most", [None, 0])
def test_signatures(vectors, queries, most):
    from codeloom.operators.signatures import signature_index, signature_topk
    index = signature_index(vectors, id_col="vec_id", repo_col="repo_id")
    exact = {(r.query_id, int(r.chunk_id), r.score, r.rank) for r in cosine_topk(vectors, queries, 5).collect()}
    full = signature_topk(index, queries, 5, 10_000, repo_col="repo_id", max_bytes=most)
    assert {(r.query_id, int(r.id), r.score, r.rank) for r in full.collect()} == exact
    some = signature_topk(index, queries, 5, 40, repo_col="repo_id", max_bytes=most).collect()
    assert len({(r.query_id, int(r.id)) for r in some} & {x[:2] for x in exact}) >= 0.9 * len(exact) and {r.scored for r in some} == {40}


def test_signatures_reach_the_recall_with_few_scored(spark):
    import codeloom.plans.catalog as C
    row = C.q_signature_recall(spark, "/root/testdata/sf0.01").first()
    assert row.n_queries == 25 and row.recall >= 0.9 and row.scored_share <= 0.2
