"""Retrieval evaluation (Q7, J6, W3, A7): first hit rank per question and Hit@k / MRR.

A source is a hit when any expected symbol (lower-cased) is a substring of the
source's lower-cased name or file.  Only the first ``depth`` sources count.  Questions
without any hit, and questions whose call failed (no sources), stay in the
denominator.  Both steps are aggregations keyed by question: the per-question input
is the question's top sources (bounded by k), and the metrics are one global
partial/final aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import checked_broadcast, materialize

DEPTH = 5
SALTS = 32


def hit_ranks(sources: DataFrame, golden: DataFrame, depth: int = DEPTH,
              questions: DataFrame | None = None) -> DataFrame:
    """``(query_id, hit_rank)``, ``hit_rank`` 1-based or null.

    ``sources(query_id, pos, file, name)`` with 0-based ``pos``.  ``golden`` is either
    the reference's form ``(query_id, expected_symbols array)`` or relevance pairs
    ``(query_id, symbol)`` with the question list in ``questions(query_id)``.

    The expectation side is exploded to pairs and streamed; the top ``depth`` sources
    per question (bounded by the number of questions) are broadcast after a size check,
    so a question with very many expected symbols never lands in one hot partition."""
    if "expected_symbols" in golden.columns:
        pairs = golden.select("query_id", F.explode("expected_symbols").alias("symbol"))
        questions = golden.select("query_id")
    elif questions is None:
        raise ValueError("questions(query_id) is required with relevance pairs")
    else:
        pairs = golden.select("query_id", "symbol")
    pairs = pairs.select("query_id", F.lower("symbol").alias("sym"))
    top = (sources.filter(F.col("pos") < depth)
           .select(F.col("query_id").alias("_q"), "pos",
                   F.lower(F.coalesce(F.col("name"), F.lit(""))).alias("_n"),
                   F.lower(F.coalesce(F.col("file"), F.lit(""))).alias("_f")))
    # Written once: the size check and the join would each run the whole search.
    top_b, small = checked_broadcast(materialize(top, "top-sources"))
    cond = (F.col("query_id") == F.col("_q")) & (F.col("_n").contains(F.col("sym")) | F.col("_f").contains(F.col("sym")))
    if not small:  # a question with very many symbols is spread over SALTS tasks
        pairs = pairs.withColumn("_s", F.pmod(F.xxhash64("sym"), F.lit(SALTS)))
        top_b = top_b.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        cond = cond & (F.col("_s") == F.col("_t"))
    hits = pairs.join(top_b, cond).groupBy("query_id").agg((F.min("pos") + 1).cast("int").alias("hit_rank"))
    return questions.join(hits, "query_id", "left")


def metrics(per_question: DataFrame) -> DataFrame:
    """One row: ``n, hits_at_1, hits_at_3, hits_at_5, hit_at_1, hit_at_3, hit_at_5, mrr_at_5``."""
    r = F.col("hit_rank")
    agg = per_question.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(r == 1, 1).otherwise(0)).alias("hits_at_1"),
        F.sum(F.when(r <= 3, 1).otherwise(0)).alias("hits_at_3"),
        F.sum(F.when(r <= 5, 1).otherwise(0)).alias("hits_at_5"),
        F.sum(F.when(r.isNotNull(), 1.0 / r).otherwise(0.0)).alias("_rr"))
    n = F.col("n")
    return agg.select(
        "n", F.col("hits_at_1").cast("long").alias("hits_at_1"), F.col("hits_at_3").cast("long").alias("hits_at_3"),
        F.col("hits_at_5").cast("long").alias("hits_at_5"),
        F.round(F.col("hits_at_1") / n, 6).alias("hit_at_1"), F.round(F.col("hits_at_3") / n, 6).alias("hit_at_3"),
        F.round(F.col("hits_at_5") / n, 6).alias("hit_at_5"), F.round(F.col("_rr") / n, 6).alias("mrr_at_5"))


def evaluate(sources: DataFrame, golden: DataFrame, depth: int = DEPTH,
             questions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    per_q = hit_ranks(sources, golden, depth, questions)
    return per_q, metrics(per_q)


def report(per_question: DataFrame, summary: DataFrame, questions: DataFrame, sources: DataFrame,
           repo_url: str, repo_id: str, total_chunks: int, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """The report's one-row summary and its row for each question with its top sources.

    ``questions(query_id, question)``, ``sources(query_id, pos, file, name)``."""
    top = (sources.filter(F.col("pos") < depth).groupBy("query_id")
           .agg(F.array_sort(F.collect_list(F.struct("pos", "file", "name"))).alias("_s")))
    results = (questions.select("query_id", "question").join(per_question, "query_id").join(top, "query_id", "left")
               .select("query_id", "question", "hit_rank", F.coalesce(
                   F.transform("_s", lambda s: F.struct(s["file"].alias("file"), s["name"].alias("name"))),
                   F.array().cast("array<struct<file:string,name:string>>")).alias("sources")))
    head = summary.select(F.lit(repo_url).alias("repo_url"), F.lit(repo_id).alias("repo_id"),
                          F.lit(total_chunks).cast("long").alias("total_chunks"), "*")
    return head, results


def write_report(head: DataFrame, results: DataFrame, path: str) -> None:
    """Write the report as JSON files (summary and per-question rows)."""
    head.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/metrics")
    results.write.mode("overwrite").json(f"{path.rstrip('/')}/results")
