"""Removed bytes against a count of every string of the span's length."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from codeloom.llm import repeats
from codeloom.llm.repeats import least_between, op13_remove_repeats, remove_repeats, repeated_starts

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, shard string, places int"


def plain(rows, span):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for s in range(len(t) - span + 1):
            if seen[t[s:s + span]] > 1:
                gone[s:s + span] = b"\1" * span
        spans = sum(b and not (j and gone[j - 1]) for j, b in enumerate(gone))
        kept = bytes(c for c, b in zip(t, gone) if not b)
        out.append((i if i is not None else -1, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans),
                   hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect())


def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(30) for _ in range(4)]
    out = [(1, None), (2, ""), (3, "a" * 39), (4, "a" * 41), (5, "b" * 900), (6, "xyz" * 200), (7, text(60)), (7, text(60))]
    out += [(8, out[6][1]), (None, shared[0]), (None, shared[0] + "é"), (9, "日本語" * 40 + shared[1])]
    for i in range(10, 90):
        parts = [text(rng.randrange(30)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts.insert(rng.randrange(4), s[a:a + rng.randrange(30, 150)])
        out.append((i, "".join(parts)))
    base = text(100).split(" ")
    for i in range(90, 120):       # near copies
        w = list(base)
        w[rng.randrange(100)] = word() * 2
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("crowd", [2000, 3])
def test_random_texts(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "BUCKET", 50)
    monkeypatch.setattr(repeats, "SHARD", 1500)
    monkeypatch.setattr(repeats, "CHUNK", 300)
    r = rows()
    docs = spark.createDataFrame([x + ("c", 1) for x in r], SCHEMA).repartition(3)
    want = plain(r, 40)
    assert sum(w[2] > 0 for w in want) > 40 and any(0 < w[2] < w[1] for w in want)
    assert found(remove_repeats(docs, 40)) == want


def test_given_documents(spark, documents):
    want = plain([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()], repeats.SPAN)
    assert sorted(tuple(r) for r in op13_remove_repeats(spark, SF).collect()) == want
    assert sum(w[2] > 0 for w in want) > 3


def test_long_text_of_one_letter(spark):
    docs = spark.createDataFrame([(1, "a" * 200_000 + "b", "", 0), (2, "c" * 399, "", 0), (3, "d" * 400, "", 0)], SCHEMA)
    got = {r.doc_id: (r.spans, bytes(r.kept)) for r in remove_repeats(docs).collect()}
    assert [tuple(s) for s in got[1][0]] == [(0, 200_000)] and got[1][1] == b"b"
    assert got[2] == ([], b"c" * 399) and got[3] == ([], b"d" * 400)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_columns_against_comparison():
    rng = np.random.default_rng(1)
    size = rng.integers(6, 12, 200)
    bounds = np.concatenate([[0], np.cumsum(size)])
    data = rng.integers(97, 99, bounds[-1]).astype(np.uint8)
    lead, group = rng.integers(0, 4, 200), rng.integers(0, 5, 200)
    marks = repeated_starts(data, bounds, lead, group, 6)
    text = [data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
    seen = Counter((group[i], s - lead[i], text[i][s:s + 6]) for i in range(200) for s in range(size[i] - 5))
    for i in range(200):
        for s in range(min(size[i] - 5, lead[i] + 1)):
            assert marks[i, s] == (seen[group[i], s - lead[i], text[i][s:s + 6]] > 1)


def test_least_between():
    rng = np.random.default_rng(2)
    v = rng.integers(0, 50, 100).astype(np.int32)
    a, b = np.array([(i, j) for i in range(100) for j in range(i + 1, 100)]).T
    assert least_between(v, a, b).tolist() == [v[i + 1:j + 1].min() for i, j in zip(a, b)]
