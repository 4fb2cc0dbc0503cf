"""BM25 (Okapi form with an idf floor) as Spark aggregations and joins.

Index build (per repository, one pass over the chunk texts):

* ``postings(repo_id, tok, chunk_id, tf, w)`` where ``w`` is the query-independent
  term weight ``tf*(k1+1) / (tf + k1*(1-b+b*dl/avgdl))``;
* ``doc_len(repo_id, chunk_id, dl)``, ``stats(repo_id, n, avgdl)``;
* ``idf(repo_id, tok, df, idf)``: ``ln(n-df+0.5) - ln(df+0.5)``; negative values are
  replaced by ``eps * mean(idf)`` over the repository's vocabulary.

The term counts are written once, so the text is tokenised once whatever is asked.  The
per-repository statistics and mean idf (one row per repository) are written, then broadcast if
their size allows; with very many repositories both sides of their joins are salted.

Query time: query terms (small) join idf, then postings; contributions are summed per
(query, chunk) and ranked with a per-query window whose top-k limit Spark applies
before the shuffle (``WindowGroupLimit``).

Scale notes: all document-side aggregates are partial+final hash aggregates, so hot
tokens and hot repositories are combined map-side.  The posting join broadcasts the
query terms when they are small; otherwise both sides are salted so a hot (repo, token)
key is spread over ``salts`` tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import tokens
from codeloom.operators.ranking import top_k
from codeloom.session import SALTS, checked_broadcast, limit_batches, materialize, spread_join

K1, B, EPS = 1.5, 0.75, 0.25


@dataclass
class Bm25Index:
    postings: DataFrame
    doc_len: DataFrame
    stats: DataFrame
    idf: DataFrame


def with_term_counts(chunks: DataFrame, text_col: str = "embed_text") -> DataFrame:
    """``(repo_id, chunk_id, dl, tfs array<struct<tok, tf>>)`` counted inside each row, ``tfs`` by token.

    All tokens (``functions.text.tokens``) of a chunk are in its row, so term counts need no shuffle: the texts
    of an Arrow batch are counted together, by the codes of their tokens."""
    limit_batches(chunks.sparkSession)
    texts = chunks.select(F.col("repo_id").cast("string").alias("repo_id"), F.col("chunk_id").cast("string").alias("chunk_id"), F.lower(text_col).alias("text"))
    return texts.mapInArrow(_count, "repo_id string, chunk_id string, dl int, tfs array<struct<tok: string, tf: int>>")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [None if t is None else t.split() for t in batch.column("text").to_pylist()]
        dl = pa.array([None if w is None else len(w) for w in words], pa.int32())
        coded = pa.array([tok for w in words if w for tok in w], pa.string()).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        row = np.repeat(np.arange(len(words)), dl.fill_null(0).to_numpy())
        key, tf = np.unique(row * len(order) + place[coded.indices.to_numpy()], return_counts=True)
        row, tok = np.divmod(key, max(1, len(order)))
        ends = np.searchsorted(row, np.arange(len(words) + 1)).astype(np.int32)
        terms = pa.StructArray.from_arrays([coded.dictionary.take(order).take(pa.array(tok)), pa.array(tf.astype(np.int32))], ["tok", "tf"])
        yield pa.RecordBatch.from_arrays(
            [batch.column("repo_id"), batch.column("chunk_id"), dl, pa.ListArray.from_arrays(pa.array(ends), terms)], ["repo_id", "chunk_id", "dl", "tfs"])


def term_freq(chunks: DataFrame, text_col: str = "embed_text") -> DataFrame:
    """``(repo_id, chunk_id, dl, tok, tf)``: term counts of ``lower().split()``."""
    return exploded_counts(with_term_counts(chunks, text_col))


def exploded_counts(counted: DataFrame) -> DataFrame:
    # inline_outer: plain inline lets the optimizer infer size(tfs) > 0 and push it
    # below the projections, re-inlining the sort into the per-element lambdas.
    return (counted.select("repo_id", "chunk_id", "dl", F.inline_outer("tfs"))
            .filter(F.col("tok").isNotNull()))


def build_bm25(chunks: DataFrame, text_col: str = "embed_text", k1: float = K1, b: float = B,
               eps: float = EPS, counted: DataFrame | None = None) -> Bm25Index:
    """BM25 tables for ``chunks``; ``counted`` (from ``with_term_counts``, e.g. written
    once to storage) replaces the tokenisation pass when given."""
    counted = counted if counted is not None else materialize(with_term_counts(chunks, text_col), "term-counts")
    tf = exploded_counts(counted)
    doc_len = counted.select("repo_id", "chunk_id", "dl")
    stats = materialize(doc_len.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")), "repo-stats")
    stats, hinted = checked_broadcast(stats)
    df = tf.groupBy("repo_id", "tok").agg(F.count(F.lit(1)).alias("df"))
    raw = materialize(spread_join(df, stats, hinted, ["repo_id"], F.col("tok"))
                      .select("repo_id", "tok", "df",
                              (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw_idf")), "raw-idf")
    # Partial sums of a salt of the vocabulary, then one row per repository: the vocabulary is not shuffled by it.
    part = raw.groupBy("repo_id", F.pmod(F.xxhash64("tok"), F.lit(SALTS)).alias("s")).agg(
        F.sum("raw_idf").alias("total"), F.count(F.lit(1)).alias("terms"))
    mean = materialize(part.groupBy("repo_id").agg((F.sum("total") / F.sum("terms")).alias("mean_idf")), "mean-idf")
    idf = (spread_join(raw, *checked_broadcast(mean), ["repo_id"], F.col("tok"))
           .select("repo_id", "tok", "df",
                   F.when(F.col("raw_idf") < 0, F.lit(eps) * F.col("mean_idf"))
                    .otherwise(F.col("raw_idf")).alias("idf")))
    postings = (spread_join(tf, stats.select("repo_id", "avgdl"), hinted, ["repo_id"], F.col("chunk_id"))
                .select("repo_id", "tok", "chunk_id", "tf",
                        (F.col("tf") * (k1 + 1) /
                         (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).alias("w")))
    return Bm25Index(postings, doc_len, stats, idf)


def query_terms(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """``(query_id, repo_id, tok, qtf)``; repeated query words count ``qtf`` times."""
    return (queries.select("query_id", "repo_id", F.explode(tokens(text_col)).alias("tok"))
            .groupBy("query_id", "repo_id", "tok").agg(F.count(F.lit(1)).alias("qtf")))


def bm25_scores(index: Bm25Index, queries: DataFrame, text_col: str = "text",
                salts: int = SALTS) -> DataFrame:
    """``(query_id, repo_id, chunk_id, score)`` for every chunk sharing a query term."""
    qt = query_terms(queries, text_col)
    # qw has at most one row per query term, so the bound checked on qt holds for it.
    qt_b, small = checked_broadcast(qt)
    qw = (index.idf.join(qt_b, ["repo_id", "tok"])
          .select("query_id", "repo_id", "tok", (F.col("qtf") * F.col("idf")).alias("qw")))
    joined = spread_join(index.postings, F.broadcast(qw) if small else qw, small, ["repo_id", "tok"], F.col("chunk_id"), salts)
    return (joined.groupBy("query_id", "repo_id", "chunk_id")
            .agg(F.sum(F.col("qw") * F.col("w")).alias("score")))


def bm25_topk(index: Bm25Index, queries: DataFrame, k: int, text_col: str = "text") -> DataFrame:
    """Top ``k`` chunks per query with score > 0, ``rank`` 0-based.

    Scores are rounded to 6 decimals before ranking and ties go to the smaller
    ``chunk_id`` (the reference keeps insertion order), so results do not depend on
    summation order."""
    s = bm25_scores(index, queries, text_col).filter(F.col("score") > 0) \
        .withColumn("score", F.round("score", 6))
    return top_k(s, k, F.col("score").desc(), F.col("chunk_id"))
