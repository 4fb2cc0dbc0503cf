import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from codeloom.llm import decontaminate as D


def shingles(words):
    return Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter({tuple(words): 1} if words else {})


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())


def plain(docs, items):
    """The best of the windows at every start, clipped at both ends, of each leaked item."""
    out = {}
    for d, t in docs:
        w = words(t)
        for i, it in items:
            v, size = shingles(words(it)), len(words(it))
            if not size or (size < 5 and len(w) != size):
                continue
            for s in range(1 - size, len(w)):
                a, b = max(0, s), min(len(w), s + size)
                x = shingles(w[a:b]) if b - a >= 5 or len(w) < 5 else Counter()
                shared = sum((x & v).values())
                if x and shared / (sum(x.values()) + sum(v.values()) - shared) >= 0.8:
                    sim = shared / (sum(x.values()) + sum(v.values()) - shared)
                    key = (d, i)
                    if key not in out or (sim, -a) > (out[key][0], -out[key][1]):
                        out[key] = (sim, a)
    return {(d, i): (round(s, 9), a) for (d, i), (s, a) in out.items()}


def got(spark, docs, items):
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in docs], "doc_id bigint, text string, n int, size int, item_id string")
    bench = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id bigint, text string, doc_id int")
    return {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in D.leaks(df, bench).collect()}


def test_against_every_window(spark):
    rng = np.random.default_rng(1)
    text = lambda n, v=300: " ".join(f"w{i}" for i in rng.integers(0, v, n))
    items = [(i, text(int(n))) for i, n in enumerate(rng.integers(12, 60, 12))]
    items += [(20, items[0][1]), (21, "one two three"), (22, ""), (23, None), (24, "a a a a a a a a a a")]
    docs = []
    for d in range(60):
        t = text(int(rng.integers(0, 200)))
        if d % 2:
            w = items[d % 12][1].split()
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(0, len(w)))] = "changed"
            if d % 3 == 0:
                del w[len(w) // 2]
            at = int(rng.integers(0, len(t.split()) + 1))
            t = " ".join(t.split()[:at] + w + t.split()[at:])
        docs.append((d, t.upper() if d % 5 == 0 else t))
    docs += [(70, None), (71, ""), (72, "One  two\nthree"), (73, "one two three four"), (74, "b " + "a " * 30), (75, items[3][1] * 1), (76, items[3][1][:-8])]
    assert got(spark, docs, items) == plain(docs, items)


def test_reordered_items(spark):
    """Windows that hold an item's parts in another order, also cut off at the text's edges."""
    rng = np.random.default_rng(3)
    text = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    items = [text(n) for n in (59, 45, 80, 59)]
    docs = []
    for d in range(48):
        w = items[d % 4]
        cut = sorted(rng.integers(5, len(w) - 5, 1 + d % 2).tolist())
        parts = [w[a:b] for a, b in zip([0, *cut], [*cut, len(w)], strict=True)][::-1]
        w = sum(parts, [])
        before, after = text(int(rng.integers(0, 60)) * (d % 3 > 0)), text(int(rng.integers(0, 60)) * (d % 5 > 0))
        docs.append((d, " ".join(before + w[(d % 3 == 0) * (d % 4):len(w) - (d % 5 == 0) * (d % 4)] + after)))
    docs.append((100, " ".join(text(20) + items[0][30:] + items[0][:30] + text(20))))
    items = [(i, " ".join(w)) for i, w in enumerate(items)]
    out = got(spark, docs, items)
    assert (100, 0) in out and len(out) > 20 and out == plain(docs, items)
    assert twin(docs, items) == {(d, i, a, s) for (d, i), (s, a) in out.items()}


def twin(docs, items):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    return {(d, i, a, round(s, 9)) for d, i, a, _, s in con.execute(D.OP7_SQL).fetchall()}


def test_candidates_are_few(spark, monkeypatch):
    """Every window and item of a size that reach the threshold are candidates, and under a hundredth of the others."""
    seen, plain_candidates = {}, D.candidates

    def watched(windows, marks):
        out = plain_candidates(windows, marks)
        shared = D.common_shingles(D.F.col("sh"), D.F.col("item_sh"))
        pairs = windows.join(marks, "size").select(*out.columns, (shared / (D.F.size("sh") + D.F.size("item_sh") - shared)).alias("similarity"))
        alike = pairs.where(D.F.col("similarity") >= D.SIMILARITY).select(*out.columns)
        seen.update(pairs=pairs.count(), alike=alike.count(), found=out.count(), lost=alike.exceptAll(out).count())
        return out

    monkeypatch.setattr(D, "candidates", watched)
    folder = "/root/testdata/sf0.1"
    D.leaks(*[spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark")]).count()
    assert seen["alike"] > 1000 and not seen["lost"], seen
    assert seen["found"] - seen["alike"] < 0.01 * (seen["pairs"] - seen["alike"]), seen


def test_leaky_long_text_repeated_rows_and_empty_tables(spark):
    item = "the quick brown fox jumps over the lazy dog by the old stone bridge at noon"
    docs = [(1, "filler " * 50_000 + item), (2, item), (2, item), (None, item), (3, "clean text of no interest whatsoever to us")]
    out = got(spark, docs, [(7, item)])
    assert out == {(1, 7): (1.0, 50_000), (2, 7): (1.0, 0), (None, 7): (1.0, 0)}
    df = spark.createDataFrame([(d, t, "k") for d, t in docs], "doc_id bigint, text string, _row string")
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    kept = D.clean_rows(df, bench)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [3]
    assert D.leaks(df.limit(0), bench).count() == 0 and D.leaks(df, bench.limit(0)).count() == 0
    assert D.clean_rows(df, bench.limit(0)).count() == 5


def test_simhash_and_blocks(spark):
    rng = np.random.default_rng(2)
    sets = [rng.integers(-(2**63), 2**63, int(n)).tolist() for n in (1, 2, 7, 50)]
    rows = spark.createDataFrame([(s,) for s in sets], "sh array<bigint>").select("sh", D.simhash(D.F.col("sh")).alias("p"))
    for r in rows.select("sh", "p", D.blocks(D.F.col("p")).alias("b")).collect():
        want = sum(1 << b for b in range(64) if sum(1 if h >> b & 1 else -1 for h in r.sh) > 0)
        assert r.p % 2**64 == want
        assert len(r.b) == D.RADIUS + 1
        joined, at = 0, 0
        for x in r.b:
            width = (x.block + 1) * 64 // (D.RADIUS + 1) - at
            joined |= x.value << at
            at += width
        assert joined == want and at == 64


def test_no_python_in_the_plan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = D.leaks(df, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)


@pytest.mark.parametrize("n", [0, 100])
def test_clean_documents_stay(spark, n):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(n)
    leaking = {k[0] for k in got(spark, [tuple(r) for r in df.select("doc_id", "text").collect()], [tuple(r) for r in bench.collect()])}
    kept = {r.doc_id for r in D.clean_rows(df, bench).collect()}
    assert kept == {r.doc_id for r in df.collect()} - leaking
