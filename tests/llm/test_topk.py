import numpy as np
import pytest

from codeloom.llm import topk as K


def brute(rows, every, k):
    vectors = {(i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v)) for i, v in rows
               if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
               and sum(int(np.floor(1024 * float(np.float32(x)))) ** 2 for x in v) < 2**62}
    out = []
    for q, a in vectors:
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in vectors if i != q)
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])]
    return sorted(out)


def found(spark, rows, every=10, k=5, block=64, pivots=8):
    df = spark.createDataFrame([(i, None if v is None else list(v), 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, v int, pivot int")
    v = K.integer_vectors(df, "vec_id", "embedding")
    blocks, facts = K.build_index(v, pivots, block)
    q = v.where(K.F.col("vec_id") % every == 0).selectExpr("vec_id as query_id", "v as q")
    return sorted(tuple(r) for r in K.search(blocks, facts, q, k).select("query_id", "rank", "vec_id", "score").collect()), blocks


@pytest.mark.parametrize("scale", [0.1, 1.0, 300.0])
def test_random_vectors_and_one_very_common(spark, scale):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, scale, (6, 12))
    rows = [(i, (centres[i % 6] + rng.normal(0, scale / 5, 12)).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[10][1]) for i in range(400)]
    got, blocks = found(spark, rows)
    assert got == brute(rows, 10, 5)
    sizes = [len(r.ids) for r in blocks.collect()]
    assert sum(sizes) == 1100 and max(sizes) <= 64


def test_vectors_that_take_no_part_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [nan, 1.0]), (2, [inf, 0.0]), (3, None), (4, [None, 1.0]), (None, [1.0, 1.0]),
            (5, [0.5]), (6, []), (10, [1.0, 2.0]), (10, [1.0, 2.0]), (11, [-1.0, -2.0]), (20, [0.0, 0.0])]
    assert found(spark, rows)[0] == brute(rows, 10, 5)
    assert found(spark, rows[:1])[0] == [] and found(spark, rows[:1] * 0 + [(3, None)])[0] == []


def test_large_integers_are_exact(spark):
    rows = [(i, [float(np.float32(1.5e6 + i * 0.125)), float(np.float32(5e5 * (i % 3)))]) for i in range(30)]
    assert found(spark, rows)[0] == brute(rows, 10, 5)


def test_components_too_large_for_a_long(spark):
    rows = [(0, [1e20, 1.0]), (1, [-1e38, 0.0]), (10, [1.0, 2.0]), (20, [2e6, 0.0]), (30, [2.05e6, 0.5]), (31, [-2.5e6, 0.0]), (40, [9e14, 0.0])]
    got = found(spark, rows)[0]
    assert got == brute(rows, 10, 5) and {q for q, *_ in got} == {10, 20, 30}


def test_far_clusters_are_never_opened(spark, monkeypatch):
    """Tight clusters far apart: a query opens annuli of its own cluster alone."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (8, 16))
    centres *= 40 / np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, (centres[i % 8] + rng.normal(0, 0.05, 16)).astype(np.float32).tolist()) for i in range(1600)]
    opened = []
    plain_opening = K.opening

    def watched(blocks, facts, queries, k):
        first, rest = plain_opening(blocks, facts, queries, k)

        def kept(floors):
            out = rest(floors)
            opened.append((first.count() + out.count(), blocks.count() * queries.count()))
            return out

        return first, kept

    monkeypatch.setattr(K, "opening", watched)
    monkeypatch.setattr(K, "FIRST", 1)
    got, blocks = found(spark, rows, every=15, pivots=8, block=20)
    assert got == brute(rows, 15, 5)
    (n, every), = opened
    assert n < 0.2 * every, opened


@pytest.mark.parametrize("annuli", [K.ANNULI, 0])
def test_pages(spark, monkeypatch, annuli):
    """Many pages a pivot, and with no broadcast: every annulus in one page, the distances' owners without gaps."""
    monkeypatch.setattr(K, "paged", lambda blocks, plain=K.paged: plain(blocks, 3))
    monkeypatch.setattr(K, "ANNULI", annuli)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 6).astype(np.float32).tolist()) for i in range(900)]
    got, blocks = found(spark, rows, pivots=4, block=16)
    assert got == brute(rows, 10, 5)
    pages = K.paged(blocks).collect()
    assert sorted(x.block for p in pages for x in p.annuli) == sorted(r.block for r in blocks.collect())
    for pivot in {p.pivot for p in pages}:
        own = sorted((p.since, p.until) for p in pages if p.pivot == pivot)
        assert own[0][0] == -np.inf and own[-1][1] == np.inf and all(a[1] == b[0] for a, b in zip(own, own[1:]))


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in K.op6_pivot_topk(spark, "/root/testdata/sf0.01").select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, 100, 10)
