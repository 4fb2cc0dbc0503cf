"""BM25 top-k over blocks of postings with their largest weights (block-max pruning).

The chunks of a repository are dealt by hash into blocks of about ``size``; the postings of a
term in one block are one row (repo_id, tok, block, n, top, low, entries), where ``top`` and
``low`` are the largest and smallest term weight.  A search looks at the heads of its terms'
blocks only: the sum of qw * top bounds the score of every chunk in a block (a negative idf is bounded
by ``low``, and no term has to occur, so no summand is below 0).  It then

1. scores, per query, the ``first`` blocks with the greatest bounds: their k-th score is a floor;
2. scores the other blocks whose bound reaches the floor.

Blocks below the floor cannot hold one of the first k chunks, so their entries are never read
into the join: the rows equal those of ``bm25_topk``.  A hot (repository, term) is as many rows
as it has blocks, and the blocks of one are spread by their number.

Small blocks bound more tightly but have more heads: for repositories of 430 chunks (sf0.1, k = 18) blocks
of 4 chunks leave 0.69 of the postings to be scored, of 2 chunks 0.46, of 16 nearly all; a large
repository prunes with larger blocks.

Cases: queries without a known term have no rows; fewer than k scoring chunks open all blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.bm25 import Bm25Index, query_terms
from codeloom.operators.ranking import top_k
from codeloom.session import checked_broadcast, materialize, spread_join

BLOCK = 16
LEAD = 4         # times k chunks are scored for the floor
SLACK = 1e-5     # above the rounding of scores


def block_postings(index: Bm25Index, size: int = BLOCK) -> DataFrame:
    """The postings of ``index`` in blocks of about ``size`` chunks of their repository, written."""
    counted, hinted = checked_broadcast(index.stats.select("repo_id", F.greatest(F.lit(1), F.ceil(F.col("n") / size)).alias("blocks")))
    placed = spread_join(index.postings, counted, hinted, ["repo_id"], F.col("chunk_id")).withColumn(
        "block", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")))
    return materialize(placed.groupBy("repo_id", "tok", "block").agg(
        F.count(F.lit(1)).alias("n"), F.max("w").alias("top"), F.min("w").alias("low"),
        F.collect_list(F.struct("chunk_id", "w")).alias("entries")), "posting-blocks")


def blockmax_topk(index: Bm25Index, blocks: DataFrame, queries: DataFrame, k: int, text_col: str = "text",
                  first: int | None = None, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(hits, cost)``: the rows of ``bm25_topk``, and per query how many postings its terms have
    (``postings_all``) and how many were scored (``postings_read``).  ``first`` blocks make the floor, by
    default as many as hold LEAD * k chunks if blocks hold ``size``."""
    first = first or -(-LEAD * k // size)
    qt, _ = checked_broadcast(materialize(query_terms(queries, text_col), "query-terms"))
    qw = materialize(index.idf.join(qt, ["repo_id", "tok"]).select("query_id", "repo_id", "tok", (F.col("qtf") * F.col("idf")).alias("qw")), "query-weights")
    few, hinted = checked_broadcast(qw)
    terms, _ = checked_broadcast(qw.select("repo_id", "tok").distinct())
    heads = materialize(spread_join(blocks.select("repo_id", "tok", "block", "n", "top", "low"), few, hinted, ["repo_id", "tok"], F.col("block"))
                        .groupBy("query_id", "repo_id", "block").agg(
                            F.sum(F.greatest(F.col("qw") * F.col("top"), F.col("qw") * F.col("low"), F.lit(0.0))).alias("bound"),
                            F.sum("n").alias("n")), "block-bounds")

    def score(pairs: DataFrame) -> DataFrame:
        asked, _ = checked_broadcast(materialize(pairs.select("query_id", "repo_id", "block").join(few, ["query_id", "repo_id"]), "opened"))
        # Blocks of other terms are not shuffled.  A key has one row of blocks, so a shuffle join needs no salt.
        held = blocks.select("repo_id", "tok", "block", "entries").join(terms, ["repo_id", "tok"], "left_semi")
        met = held.join(asked, ["repo_id", "tok", "block"])
        summed = met.select("query_id", "repo_id", "qw", F.explode("entries").alias("e")).groupBy("query_id", "repo_id", "e.chunk_id").agg(
            F.round(F.sum(F.col("qw") * F.col("e.w")), 6).alias("score"))
        return top_k(summed.where("score > 0"), k, F.col("score").desc(), F.col("chunk_id"))

    lead = materialize(top_k(heads, first, F.col("bound").desc(), F.col("block")).select("query_id", "repo_id", "block", "n"), "lead-blocks")
    found = materialize(score(lead), "lead-hits")
    floor = found.where(F.col("rank") == k - 1).select("query_id", F.col("score").alias("floor"))
    rest = materialize(heads.join(lead.select("query_id", "block"), ["query_id", "block"], "left_anti").join(floor, "query_id", "left")
                       .where(F.col("floor").isNull() | (F.col("bound") + SLACK >= F.col("floor")))
                       .select("query_id", "repo_id", "block", "n"), "rest-blocks")
    both = found.drop("rank").unionByName(score(rest).drop("rank"))
    opened = lead.unionByName(rest).groupBy("query_id").agg(F.sum("n").alias("postings_read"))
    cost = heads.groupBy("query_id").agg(F.sum("n").alias("postings_all")).join(opened, "query_id")
    return top_k(both, k, F.col("score").desc(), F.col("chunk_id")), cost
