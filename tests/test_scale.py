"""What a step holds or moves does not follow the size of files, the length of texts or the number of postings."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.functions.text import WS_CHARS, embed_text, tokens
from codeloom.operators import embed as embed_module
from codeloom.operators.embed import embed, hashed_model
from codeloom.plans.hybrid import load_index, save_index
from codeloom.session import checked_broadcast, materialize, scratch


def test_refused_broadcast_is_not_made_by_the_size_of_its_files(spark):
    """a million bytes of equal rows are a file of a few kB."""
    side = materialize(spark.range(20_000).select((F.col("id") % 2).alias("k"), F.lit("x" * 60).alias("v")), "flat")
    kept, hinted = checked_broadcast(side, 1000)
    plan = spark.range(10).withColumnRenamed("id", "k").join(kept, "k")._jdf.queryExecution().executedPlan().toString()
    assert not hinted and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("r%d" % (i % 3), f"f{i}::b::1", f"f{i}", "block", "b", 1, 3, "text", None, None, f"alpha beta{i % 7} gamma\nalpha {i}") for i in range(60)]
    return spark.createDataFrame(rows, "repo_id string, chunk_id string, file_path string, chunk_type string, name string, start_line int, end_line int, "
                                       "language string, parent_name string, docstring string, content string")


def test_saved_index_keeps_no_derived_text_and_deals_chunks_only(spark, chunks, monkeypatch):
    """rows of postings, term counts and lengths are written where the chunks were read."""
    import codeloom.plans.hybrid as hybrid
    plans, put = {}, hybrid.put_table

    def noted(df, path, *sort, dealt=False):
        plans[path.rsplit("/", 1)[1]] = (dealt, df._jdf.queryExecution().optimizedPlan().toString())
        return put(df, path, *sort, dealt=dealt)

    monkeypatch.setattr(hybrid, "put_table", noted)
    path = scratch(spark, "thin")
    save_index(chunks, path)
    for name in ("postings", "term_counts", "doc_len", "vectors"):
        assert plans[name][0] and "RepartitionByExpression" not in plans[name][1]
    assert "embed_text" not in spark.read.parquet(f"{path}/chunks").columns
    back = load_index(spark, path)
    assert back.chunks.where(F.col("embed_text").eqNullSafe(embed_text())).count() == 60
    assert back.bm25.postings.groupBy("chunk_id").agg(F.sum("tf").alias("n")).join(back.bm25.doc_len, "chunk_id").where("n <> dl").count() == 0
    own = scratch(spark, "own")
    save_index(chunks.withColumn("embed_text", F.lit("only this")), own)
    assert [r.embed_text for r in load_index(spark, own).chunks.select("embed_text").distinct().collect()] == ["only this"]


def test_default_model_keeps_a_bounded_cache_and_works_in_slices(spark, monkeypatch):
    """F7, F8, F12"""
    texts = [None, "", "a b a", "x " * 500, "y z", "w" * 300]
    whole = hashed_model()()(texts)
    monkeypatch.setattr(embed_module, "SLICE_CHARS", 100)
    monkeypatch.setattr(embed_module, "CACHE_TOKENS", 2)
    predict = hashed_model()()
    assert np.array_equal(predict(texts), whole) and np.array_equal(predict(texts), whole)
    cells = [c.cell_contents for f in [predict, *[c.cell_contents for c in predict.__closure__ if callable(c.cell_contents)]] for c in f.__closure__]
    caches = [c for f in cells if callable(f) and f.__closure__ for c in (x.cell_contents for x in f.__closure__) if isinstance(c, dict)]
    assert caches and all(len(c) <= 2 for c in caches)
    embed(spark.createDataFrame([("a",)], "t string"), "t")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000


def test_tokens_split_at_every_blank(spark):
    """ranges of the class hold all that Python counts as blank, and nothing else is lost."""
    text = "A" + "".join(f"{c}w{i}​" for i, c in enumerate(WS_CHARS)) + " "
    row = spark.createDataFrame([(text,), (None,), ("  ",)], "t string").select(tokens("t").alias("t")).collect()
    assert [r.t for r in row] == [text.lower().split(), None, []]


def test_only_signatures_within_the_reach_become_rows(spark, monkeypatch):
    """before the cut by rank there are the ``keep`` nearest and ties with the last, not all pairs."""
    import codeloom.operators.signatures as S
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    v = spark.createDataFrame(rows, "id bigint, repo string, embedding array<double>")
    seen, top = [], S.top_k
    monkeypatch.setattr(S, "top_k", lambda df, *a, **k: (seen.append(df), top(df, *a, **k))[1])
    q = v.where("id < 10").selectExpr("id AS query_id", "repo", "embedding AS qvec")
    for most in (None, 0):
        seen.clear()
        found = S.signature_topk(S.signature_index(v, repo_col="repo"), q, 5, 20, repo_col="repo", max_bytes=most).collect()
        near = {r.query_id: r.n for r in seen[0].groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert len(found) == 50 and all(r.scored == 20 for r in found)
        assert len(near) == 10 and all(20 <= n <= 40 for n in near.values())
