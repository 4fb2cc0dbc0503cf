import re
import tracemalloc
import types
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm import jaccard as J
from codeloom.llm import links as L
from codeloom.llm.components import components


def plain_sets(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
        out.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def plain_components(ids, texts, k, percent):
    sets, parent = plain_sets(texts, k), list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(texts)):
        groups[root(i)].append(ids[i])
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return [(d, len(s), least[root(i)]) for i, (d, s) in enumerate(zip(ids, sets, strict=True))]


def got_components(df, k, percent):
    rows = J.linked(df, k, percent)
    least = rows.where("component is not null").groupBy("component").agg(J.F.min("doc_id").alias("least"))
    out = rows.join(least, "component", "left").select("doc_id", "n", J.F.coalesce("least", "doc_id")).collect()
    return sorted(map(tuple, out), key=str)


def plain_links(ids, texts, k, percent):
    sets = plain_sets(texts, k)
    many = [sum(1 for j, t in enumerate(sets) if i != j and s and t and 100 * len(s & t) >= percent * len(s | t)) for i, s in enumerate(sets)]
    return sorted(zip(ids, map(len, sets), many, strict=True), key=str)


def got_links(df, k, percent):
    return sorted(((r.doc_id, r.n, r.n_links) for r in J.counted(df, k, percent).collect()), key=str)


def near_copies(rng, groups, copies, words=120, vocabulary=400):
    texts = []
    for _ in range(groups):
        base = [f"w{i}" for i in rng.integers(0, vocabulary, words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                at = int(rng.integers(0, len(w)))
                kind = rng.integers(0, 3)
                w[at:at + (kind != 1)] = [f"W{rng.integers(0, vocabulary)}"] if kind else []
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_against_all_pairs(spark, k, percent):
    rng = np.random.default_rng(k)
    texts = near_copies(rng, 12, 15) + near_copies(rng, 60, 1) + [None, "", " \n", "one", "One", "two words", "a b a b a b", "A b a  b"]
    ids = [int(x) for x in rng.permutation(len(texts))]
    ids[3] = None
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, n int, component int")
    assert got_components(df, k, percent) == sorted(plain_components(ids, texts, k, percent), key=str)


def test_hot_shingles_and_chains(spark, monkeypatch):
    """Passages in every document (hot shingles), and chains whose ends don't link themselves."""
    monkeypatch.setattr(J, "HOT_SHARE", 4)
    monkeypatch.setattr(J, "LIST_BLOCK", 3)
    rng = np.random.default_rng(9)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{passage} " + " ".join(f"u{rng.integers(0, 10**6)}" for _ in range(int(n))) for n in rng.integers(0, 12, 150)]
    base = [f"c{i}" for i in range(100)]
    chain = [" ".join(["x"] * 0 + [f"z{i}" if i < s * 2 else w for i, w in enumerate(base)]) for s in range(12)]
    texts += chain
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for k, percent in ((3, 90), (5, 80)):
        assert got_components(df, k, percent) == sorted(plain_components(range(len(texts)), texts, k, percent), key=str)


def test_repeated_rows_long_texts_and_empty_table(spark):
    long = " ".join(f"v{i % 7001}" for i in range(120_000))
    texts = ["a b c d e f"] * 50 + [long, long + " v7"]
    df = spark.createDataFrame([(7, t) for t in texts[:50]] + [(8, texts[50]), (9, texts[51])], "doc_id bigint, text string")
    assert got_components(df, 3, 90) == sorted([(7, 4, 7)] * 50 + [(8, 7001, 8), (9, 7002, 8)], key=str)
    assert J.linked(df.limit(0)).count() == 0


def test_distinct_rows(spark):
    rng = np.random.default_rng(5)
    texts = near_copies(rng, 6, 8) + near_copies(rng, 20, 1) + [None, "", ""]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[-1], (None, texts[0], "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _row string")
    kept = J.distinct_rows(df, 5, 80)
    assert kept.columns == df.columns
    ids, all_texts = [r[0] for r in rows], [r[1] for r in rows]
    want = {c for d, n, c in plain_components(ids, all_texts, 5, 80) if n}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(d for d in got if texts[d]) == sorted(want)
    assert sum(1 for d in got if not texts[d]) == 4


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(1900, 1990)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    assert got == {x: root(x) for x in parent}


def test_every_link_inside_a_group_counts(spark):
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(w if i != at else f"new{at}" for i, w in enumerate(base)) for at in rng.choice(300, 12, replace=False)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sum(n for *_, n in got_links(df, 3, 90)) == 2 * 66


@pytest.mark.parametrize("blocks", [(1 << 18, 1024), (900, 7), (1, 1)])
def test_links_against_all_pairs(spark, monkeypatch, blocks):
    """Small components that share blocks; components over many blocks; a block for each class."""
    monkeypatch.setattr(L, "BLOCK_ENTRIES", blocks[0])
    monkeypatch.setattr(L, "BLOCK_CLASSES", blocks[1])
    rng = np.random.default_rng(blocks[1])
    base = [f"c{i}" for i in range(100)]
    chain = [" ".join(f"z{i}" if i < s * 2 else w for i, w in enumerate(base)) for s in range(12)]
    growing = [" ".join(f"g{i}" for i in range(n)) for n in (60, 63, 66, 70, 74, 80)]
    texts = near_copies(rng, 5, 12) + near_copies(rng, 10, 1) + chain + growing + ["a b c d"] * 3 + [None, "", " ", "one", "One"]
    ids = [int(x) for x in rng.permutation(len(texts))]
    ids[2] = None
    rows = list(zip(ids, texts, strict=True))
    rows += [rows[0], rows[0], rows[2]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, block string")
    for k, percent in ((3, 90), (5, 80), (1, 100)):
        assert got_links(df, k, percent) == plain_links(*zip(*rows, strict=True), k, percent)
    assert J.counted(df.limit(0)).count() == 0


def _peak(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_tasks_hold_few_bytes_an_entry():
    """two tasks of an executor share its memory with a full JVM heap, so arrays of several times the entries don't fit."""
    words = np.random.default_rng(3).integers(0, 400, (3000, 400))
    batch = pa.RecordBatch.from_pydict({"doc_id": np.arange(3000), "th": np.arange(3000), "text": [" ".join(map(str, x)) for x in words]})
    ranges, hot = 4, types.SimpleNamespace(value=np.zeros(0, np.uint64))
    entries = sum(len(h) for _, _, h, _ in J.sets_of(batch.column("text"), 3))
    assert entries > 1_000_000
    assert _peak(lambda: [None for _ in J._scan_keys(3)(iter([batch]))]) < 48 * entries
    assert _peak(lambda: [None for _ in J._hot_postings(3, 90, hot)(iter([batch]))]) < 48 * entries
    assert _peak(lambda: [None for _ in J._scan_entries(3, ranges, hot)(iter([batch]))]) < 48 * entries
    found = list(J._scan_entries(3, 32, hot)(iter([batch])))
    assert len(found) > 1 and max(b.nbytes for b in found) < 3 * J.YIELD_BYTES
    rows = pa.Table.from_batches(J._scan_entries(3, ranges, hot)(iter([batch])))
    group = rows.filter(pa.array([r == 1 for r in rows.column("r").to_pylist()]))
    assert _peak(lambda: J._shared(ranges, 8)(group)) < 60 * entries // ranges


def test_colliding_shingles_keep_their_entries(monkeypatch):
    """Shingles of one fingerprint in one class are entries of their own, once each however many batches have the class."""
    sets = J.sets_of

    def few(col, k, lower=True):
        for a, b, h, _ in sets(col, k, lower):
            h = np.arange(4, dtype=np.uint64) // np.uint64(2) << J.FP | np.arange(4, dtype=np.uint64)   # fingerprints 0, 0, 1, 1
            each = [np.sort(h + (np.uint64(r) << np.uint64(40))) if r else h for r in range(b - a)]
            each = [np.sort(np.append(x, h)) if r else x for r, x in enumerate(each)]
            yield a, b, np.concatenate(each), np.append(0, np.cumsum([len(x) for x in each]))

    monkeypatch.setattr(J, "sets_of", few)
    monkeypatch.setattr(J, "BLOB_BYTES", 1)
    hot = types.SimpleNamespace(value=np.zeros(0, np.uint64))
    batch = pa.RecordBatch.from_pydict({"text": ["x", "y"]})
    rows = pa.Table.from_batches(J._scan_entries(3, 32, hot)(iter([batch, batch])))
    assert rows.num_rows == 2                    # both classes in both batches
    out = J._shared(32, 1)(rows).to_pylist()
    assert len(out) == 1
    # Each class keeps both shingles of fingerprints 0 and 1, the only ones shared.
    assert J.unplaned(out[0]["times"], np.uint32).tolist() == [4, 4]
    fps = J.unplaned(out[0]["fps"] + bytes(3 * 8), np.uint64).tolist()
    assert fps == [0, 0, 1, 1] * 2
