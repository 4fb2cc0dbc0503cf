"""Block-max search against the plain one, and what it reads."""

import random

import pytest

import codeloom.session as S
from codeloom.operators.blockmax import block_postings, blockmax_topk
from codeloom.operators.bm25 import bm25_topk, build_bm25


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(4)
    common = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(900):
        words = [rng.choice(common) for _ in range(rng.randrange(4, 40))] + ["always"]
        words += [f"rare{i % 97}"] * rng.randrange(3)
        rows.append(("big" if i % 10 else f"small{i % 3}", f"f{i}::x::{i}", " ".join(words)))
    return build_bm25(spark.createDataFrame(rows, "repo_id string, chunk_id string, embed_text string"))


@pytest.fixture(scope="module")
def queries(spark):
    asked = ["rare5 w1 w2", "always", "rare11 rare12 always", "w3 w4 w5 w6 w7", "unknown", "", "rare5 rare5 unknown"]
    return spark.createDataFrame([(10 * j + i, r, t) for j, r in enumerate(("big", "small0", "none")) for i, t in enumerate(asked)],
                                 "query_id long, repo_id string, text string")


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "repo_id", "chunk_id", "score", "rank").collect())


@pytest.mark.parametrize("k, size, first", [(5, 16, 4), (18, 4, 1), (500, 32, 2), (1, 1, 1)])
def test_same_rows(index, queries, k, size, first):
    hits, cost = blockmax_topk(index, block_postings(index, size), queries, k, first=first)
    assert rows(hits) == rows(bm25_topk(index, queries, k))
    assert all(0 < r.postings_read <= r.postings_all for r in cost.collect())


def test_rare_words_read_few_postings(index, queries):
    cost = {r.query_id: r for r in blockmax_topk(index, block_postings(index, 4), queries, 3, size=4)[1].collect()}
    assert cost[0].postings_read < cost[0].postings_all / 2 and cost[2].postings_read < cost[2].postings_all / 2
    assert sum(r.postings_read for r in cost.values()) < sum(r.postings_all for r in cost.values())


def test_same_rows_without_broadcast(index, queries, monkeypatch):
    want = rows(bm25_topk(index, queries, 5))
    monkeypatch.setattr(S, "DEFAULT_BROADCAST_BYTES", 0)
    assert rows(blockmax_topk(index, block_postings(index), queries, 5)[0]) == want
