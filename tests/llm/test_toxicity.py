import zlib

import numpy as np
import pytest

from codeloom.llm import toxicity as T

CLEAN = "the morning was bright and every child walked along the quiet river until lunch with bread cheese honey water".split()
BAD = ("grumblor", "snivelwit", "mudface")


def text(rng, bad=None, words=60):
    w = [CLEAN[i] for i in rng.integers(0, len(CLEAN), words)]
    for i in range(9, words, 10):
        w[i] += "."
    if bad:
        w.insert(int(rng.integers(0, words)), bad)
    return " ".join(w)


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    rows = [(text(rng, BAD[i % 3] if i % 2 else None), i % 2) for i in range(300)]
    return T.fit(*zip(*rows, strict=True))


def probabilities(spark, model, texts):
    df = spark.createDataFrame([(i, t, 7, 8) for i, t in enumerate(texts)], "doc_id bigint, text string, score int, row int")
    return [r.score for r in T.score(df, model).orderBy("row.doc_id").collect()]


def test_finds_insults_also_gapped_and_with_inserted_characters(spark, model):
    rng = np.random.default_rng(4)
    bad = ["grumblor", "SNIVELWIT!", "mud-face", "g.r.u.m.b.l.o.r", "s n i v e l w i t", "grumbxlor", "mudfacee", "snivlwit"]
    got = probabilities(spark, model, [text(rng, b, 3000 if i == 0 else 60) for i, b in enumerate(bad)])
    assert min(got) >= 0.5, got
    assert max(probabilities(spark, model, [text(rng) for _ in range(50)])) < 0.5


def test_odd_texts(spark, model):
    got = probabilities(spark, model, [None, "", " \n\t ", "12 34 !!", "x", "日本語 текст", "bread " * 60_000])
    assert all(0 <= x < 0.5 for x in got) and len({*got[:4]}) == 1
    df = spark.createDataFrame([(1, "a mudface b")] * 2, "doc_id bigint, text string")
    assert len({r.score for r in T.score(df, model).collect()}) == 1
    assert T.score(df.limit(0), model).count() == 0


def test_kernel_equals_definition():
    words = [bytes([1, 2, 3, 4, 5]), bytes([2, 3, 3, 9]), bytes([1])]

    def features(w):
        w, out = bytes([T.START]) + w, {}
        for i in range(len(w)):
            for a, b in T.OFFSETS:
                if i + b < len(w):
                    u = (w[i], w[i + a], w[i + b])
                    out[u] = out.get(u, 0) + T.DECAY ** (b - 2)
        return out, T.norms(np.array([len(w) - 1]))[0]

    k = T.kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            (fa, na), (fb, nb) = features(a), features(b)
            assert k[i, j] == pytest.approx(sum(v * fb.get(u, 0) for u, v in fa.items()) / na / nb)


def test_folded_weights_equal_landmark_sums(model):
    weights = model[0]
    words = [bytes([7, 18, 21, 13]), bytes([3, 8, 5, 5, 19, 5])]
    row, code, w = T.feature_rows(words)
    expected = np.bincount(row, weights[code] * w)
    assert np.allclose(T.word_scores(*T.word_arrays(words), weights), expected, atol=1e-4)


def test_training_rows_exclude_held_out(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(40)] + [(None, "x")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, 0)], "doc_id bigint, toxic int")
    texts, y = T.training_rows(docs, labels, 1000)
    want = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 and i != 3]
    assert texts == [f"t{i}" for i in want] and y == [i % 2 for i in want]
    assert len(T.training_rows(docs, labels, 4)[0]) == 8
    assert T.fit([], [])[3] < 0 and T.fit(["a"], [1])[3] < 0


def test_held_out_accuracy_on_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = T.op5_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = rows.join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    assert sum(r.toxic == r.predicted for r in got) / len(got) >= 0.95
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
