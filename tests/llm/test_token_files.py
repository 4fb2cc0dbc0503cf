import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codeloom.llm import token_files as T


@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano_round_trip(steps):
    ends = np.cumsum(steps, dtype=np.int64) if steps else np.zeros(0, np.int64)
    low, low_part, high, select = T.ef_encode(ends)
    assert T.ef_decode(len(ends), low, low_part, high).tolist() == ends.tolist()
    for i in range(0, len(ends), 37):
        assert T.ef_get(i, low, low_part, high, select) == ends[i]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 5000))
    low, *parts = T.ef_encode(ends)
    assert sum(map(len, parts)) < 2 * 5000


@given(st.lists(st.one_of(st.integers(-2**63, 2**63 - 1), st.integers(0, 900), st.none()), max_size=600))
def test_doc_ids_round_trip(ids):
    ids = sorted(ids, key=lambda d: (d is not None, d or 0))
    s = T.Segment(memoryview(T.pack_segment(1, 2, ids, np.arange(1, len(ids) + 1), np.ones(len(ids), "<u2"))), 0)
    assert s.doc_ids().to_pylist() == ids and s.ends().tolist() == list(range(1, len(ids) + 1))
    assert [s.doc_id_at(i) for i in range(0, len(ids), 17)] == ids[::17]


def test_doc_ids_are_small():
    assert len(T.pack_ids([None] * 5000 + list(range(10**12, 10**12 + 5000)))) < 2000


def expected(rows, tokenizer):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table_against_tokenizer(spark, documents):
    tok = Tokenizer.from_file(T.word_bpe())
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = T.token_files(spark, documents, T.word_bpe()).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(rows, tok)


def test_odd_texts(spark):
    tok = Tokenizer.from_file(T.word_bpe())
    texts = [None, "", " \t\n", "Don't we'll Á \x1c x\x85y z <|endoftext|> it's", "日本語 😀 1234", "word " * 90_000, "Σas ς"]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "no id")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id bigint, text string, part int, start int")
    got = T.token_files(spark, df, T.word_bpe()).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(rows, tok)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(5, "a b")] * 3 + [(4, "c")], "doc_id bigint, text string")
    got = T.token_files(spark, df, T.word_bpe()).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(4, 0, 2), (5, 2, 3), (5, 5, 3), (5, 8, 3)]
    assert T.token_files(spark, df.limit(0), T.word_bpe()).count() == 0


@pytest.mark.parametrize("segment", [1, 40, 10_000])
def test_segments_and_select(spark, tmp_path, segment):
    df = spark.createDataFrame([(i, "word and more " * (i % 7)) for i in range(60)], "doc_id bigint, text string")
    path = str(tmp_path / "out")
    T.write_token_files(df, path, T.word_bpe(), 1, segment)
    assert T.read_token_files(spark, path).count() == 60
    for row in spark.read.format("binaryFile").load(path).collect():
        for s in T.segments(bytes(row.content)):
            ends = s.ends().tolist()
            assert [s.bounds_at(i) for i in range(s.n)] == list(zip([0, *ends], ends, strict=False))
            assert all(s.ids[e - 1] == 1 for e in ends)
