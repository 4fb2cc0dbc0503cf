"""The audit against a loop over documents, orders and steps; the matrix against word counts."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np

from codeloom.llm import encode, filter_audit
from codeloom.llm.encode import unzipped, word_rows
from codeloom.llm.filter_audit import audit, failures, term_matrix

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, words int, failed string"
LONG = " ".join(f"word{i}" for i in range(250))
ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG + " $", "b"), (4, None, None), (5, "", ""), (6, " \t\n ", "b"),
    (7, "same " * 300, "a"), (8, "SHOUT " * 250, "a"), (9, "ÄÖÜ é 日本 " * 100, None), (9, "other text", "b"),
    (None, LONG, "a"), (None, "nobody has this", "b"), (10, "x " * 120_000 + "A", "a"), (10, "x " * 120_000 + "A", "a"),
    (11, "nobody has this", "c"), (12, "a b\x00c | d", "c"),
]
LABELS = [(1, 1, 0), (2, 1, None), (3, 0, 1), (5, 1, 1), (5, 0, 0), (7, None, 1), (None, 1, 1), (99, 1, 1), (11, 1, 0)]


def fails(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, s in rows:
        t = t or ""
        w = WORDS.findall(t)
        low = first.get(t)
        yield i, s or "", "".join(f for f, bad in zip("ABCDE", [
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            any(c in "#$%&*|" for c in t), low is not None and (i is None or low < i)]) if bad)


def plain(rows, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[n] == 1} for n in (0, 1))
    out, shapley = {}, defaultdict(int)
    seen = list(fails(rows))
    for part in {p for _, p, _ in seen}:
        for order in map("".join, permutations("ABCDE")):
            left = [(i, f) for i, p, f in seen if p == part]
            every = list(left)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[part, f] += len(gone)
                out[part, order, step] = (
                    len(left), len(gone), sum(f in x[1] for x in every) - len(gone), sum(x[1] == f for x in every),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
    return {k: v + (shapley[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def test_audit_equals_loop(spark, monkeypatch):
    docs = spark.createDataFrame([r + (0, "clash") for r in ROWS], SCHEMA).repartition(3)
    labels = spark.createDataFrame([r + ("x",) for r in LABELS], "doc_id bigint, quality int, toxic int, part string")
    want = plain(ROWS, LABELS)

    def found():
        return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit(docs, labels).collect()}

    assert found() == want
    monkeypatch.setattr(filter_audit, "small", lambda df: df)   # copied texts by a salted join
    assert found() == want


def test_failures_of_given_documents(spark, documents):
    rows = [(r.doc_id, r.text, r.source) for r in documents.select("doc_id", "text", "source").collect()]
    got = sorted((r.doc_id, r.part, r.failed) for r in failures(documents).collect())
    assert got == sorted((i, p, sum(1 << "ABCDE".index(x) for x in f)) for i, p, f in fails(rows))
    assert len({f for _, _, f in got}) > 5


def test_matrix_holds_every_word(spark, documents, monkeypatch):
    docs = documents.selectExpr("doc_id", "source as part", "text")
    monkeypatch.setattr(encode, "RANGE_WORDS", 3000)   # several hash ranges
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 1 << 16)
    words, matrix = term_matrix(docs)
    rows = word_rows(words).collect()
    name = {r.id: r.word for r in rows}
    times = Counter(w for r in docs.collect() for w in WORDS.findall(r.text or ""))
    assert {r.word: r.times for r in rows} == times and len(rows) == len(times)
    assert sorted(name) == list(range(len(name)))
    got = {}
    for r in matrix.collect():
        ptr, cols, counts = np.frombuffer(r.indptr, "<i8"), unzipped(r.cols, "<i8"), unzipped(r.counts, "<i4")
        for i, doc in enumerate(r.doc_id):
            row = cols[ptr[i]:ptr[i + 1]]
            assert (np.diff(row) > 0).all()
            got[doc] = {name[c]: n for c, n in zip(row.tolist(), counts[ptr[i]:ptr[i + 1]].tolist())}
    assert got == {r.doc_id: dict(Counter(WORDS.findall(r.text or ""))) for r in docs.collect()}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit(docs, labels).collect() == []
    one = audit(spark.createDataFrame([ROWS[0] + (0, "")], SCHEMA), labels).collect()
    assert len(one) == 600 and {r.kept for r in one} == {1}
