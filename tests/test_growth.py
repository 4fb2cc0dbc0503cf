"""Work that follows the input: what is written or shuffled once, and what is left out before it is sorted."""
import os

import pytest
from pyspark.sql import functions as F

import codeloom.operators.context as C
import codeloom.plans.catalog as Q
import codeloom.plans.hybrid as H
import codeloom.session as S
import codeloom.sources.fixtures as X
import codeloom.streaming.living as L
from codeloom.functions.text import tokens
from codeloom.operators.bm25 import term_freq, with_term_counts
from codeloom.plans.hybrid import build_index
from codeloom.session import materialize, passing, scratch, table
from codeloom.sources.store import upsert_chunks

COLUMNS = ("repo_id string, chunk_id string, file_path string, chunk_type string, name string, start_line int, end_line int, "
           "language string, parent_name string, docstring string, calls array<string>, imports array<string>, content string")


def chunk_rows(spark, texts, repo="r"):
    return spark.createDataFrame([(repo, f"f{i}::b::1", f"f{i}", "block", "b", 1, 3, "text", None, None, [], [], t) for i, t in enumerate(texts)], COLUMNS)


def rows(df):
    return sorted(map(str, df.collect()))


def test_term_counts_of_odd_texts(spark):
    """Counted by Arrow batches, equal to the tokens of the column helper."""
    texts = [None, "", " \t\n", "a A b a　\u001cB Éé", "\U0001f600 x \U0001f600", "z " * 5000]
    df = spark.createDataFrame([("r", str(i), t) for i, t in enumerate(texts)], "repo_id string, chunk_id string, embed_text string").repartition(2)
    want = df.select("repo_id", "chunk_id", F.explode(tokens("embed_text")).alias("tok")).groupBy("repo_id", "chunk_id", "tok").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    assert rows(term_freq(df).select("repo_id", "chunk_id", "tok", "tf")) == rows(want)
    got = {int(r.chunk_id): r for r in with_term_counts(df).collect()}
    assert [got[i].dl for i in range(6)] == [None, 0, 0, 6, 3, 5000]
    assert got[0].tfs == [] and [t.tok for t in got[3].tfs] == sorted((t.tok for t in got[3].tfs), key=str.encode)


def test_session_index_writes_no_postings(spark, monkeypatch):
    """Postings and idf of one batch of questions are read once, so they are not written."""
    folder = scratch(spark, "session-index")
    monkeypatch.setattr(H, "scratch", lambda *_: folder)
    index = build_index(chunk_rows(spark, ["alpha beta", "beta"]), materialize_tables=True)
    assert set(os.listdir(folder)) == {"chunks", "vectors", "term_counts"}
    assert index.bm25.postings.where("tok = 'beta'").count() == 2


@pytest.fixture()
def tables(spark, tmp_path):
    docs = [(1, "x one two three four five y", "a"), (2, "one two three four", "a"), (3, None, "b"), (4, "zz tiny zz", "b"),
            (5, "one two three four five six", None), (5, "one two three four five six", None), (6, "xone two three four fivey", "b")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(0, "one two three four five"), (1, "tiny"), (2, "not in any document at all"), (0, "one two three four five"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_relevance_pairs_inside_rows_and_by_joins(spark, tables, monkeypatch):
    """Few keys are looked for inside the documents' rows; the joins give the same pairs."""
    inside = rows(X.relevance_pairs(spark, tables))
    d, b = table(spark, tables, "documents"), table(spark, tables, "benchmark").withColumnRenamed("text", "btext")
    want = d.join(b, F.col("text").contains(F.col("btext"))).select(F.col("item_id").alias("query_id"), F.format_string("/doc_%d.txt", "doc_id").alias("symbol"))
    assert inside == rows(want) and len(inside) == 9
    monkeypatch.setattr(X, "MOST_KEYS", 1)
    assert rows(X.relevance_pairs(spark, tables)) == inside


def test_evaluation_finds_relevance_pairs_once(spark, monkeypatch):
    """F14, F16, F21"""
    calls, pairs = [], X.relevance_pairs
    for module in (X, Q):
        monkeypatch.setattr(module, "relevance_pairs", lambda *a: calls.append(a) or pairs(*a))
    Q.q_eval_hits(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_only_asked_conversations_are_sorted(spark, monkeypatch):
    """turns of conversations that no question continues never reach the window."""
    seen, last = [], C.last_turns
    monkeypatch.setattr(C, "last_turns", lambda h, *a: seen.append(h.count()) or last(h, *a))
    q = spark.createDataFrame([(1, "r", "what")], "query_id long, repo_id string, question string")
    hist = spark.createDataFrame([(i % 10, i, "user", f"t{i}") for i in range(100)], "query_id long, turn int, role string, content string")
    messages = C.build_prompts(q, spark.createDataFrame([(1, "c")], "query_id long, context string"), hist).first().messages
    assert seen == [10] and [m.content for m in messages[1:-1]] == ["t61", "t71", "t81", "t91"]


def test_upsert_deals_whole_rows_once_and_leaves_no_intermediates(spark, monkeypatch):
    """F4"""
    old, new = chunk_rows(spark, ["a", "b", "c"]), chunk_rows(spark, ["a", "B"])
    dealt = upsert_chunks(old, new, part=F.pmod(F.xxhash64("chunk_id"), F.lit(8)))
    assert rows(dealt) == rows(upsert_chunks(old, new))
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(repo_id" in plan and not any("hashpartitioning(repo_id" in x and "_part" not in x and "chunk_id" in x for x in plan.split("\n"))
    path = scratch(spark, "small-living")
    L.replace_in(old, path)
    made = []
    monkeypatch.setattr(S, "scratch", lambda *a: made.append(scratch(*a)) or made[-1])
    L.upsert_into(new.union(new), path)
    assert len(made) >= 4 and not any(map(os.path.exists, made)) and not [n for n in os.listdir(f"{path}/term_counts") if n.startswith("gen=")]
    index = L.open_index(spark, path)
    assert sorted(r.content for r in index.chunks.collect()) == ["B", "a", "c"] and index.vectors.count() == 3


def test_passing_deletes_what_was_written_inside(spark):
    """F4"""
    with passing(spark):
        kept = materialize(spark.range(3), "passing")
        folder = os.path.dirname(kept.inputFiles()[0].removeprefix("file://").removeprefix("file:"))
        assert kept.count() == 3
    assert not os.path.exists(folder)
