"""Stripes against plain counting of every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from codeloom.llm import encode, phrases
from codeloom.llm.phrases import collocations, merged_stripes, pieces, top_phrases

CUT, WORD = re.compile(r"[.,;:!?\x0a-\x0d]"), re.compile(r"[^\x20\x09]+")
SCHEMA = "text string, lang string, phrase string, n int"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plain(rows, least, percent=100):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in CUT.split(lower(text or "")):
            w = WORD.findall(piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    above = Counter()
    for (lang, p), a in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                above[lang, p[i:i + k]] = max(above[lang, p[i:i + k]], a)
    out = {}
    for (lang, p), a in cand.items():
        if above[lang, p] and 100 * above[lang, p] >= percent * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang, " ".join(p)] = (a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score)
    return out


def frame(spark, rows):
    return spark.createDataFrame([r + ("x", 0) for r in rows], SCHEMA)


def found(df):
    return {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def texts():
    rng = random.Random(5)
    fixed = ["new york city", "New  York\tCity", "in the end", "the end of the day", "日本 語 x", "a a a a a a a"]
    for _ in range(400):
        parts = [rng.choice(fixed) if rng.random() < .4 else rng.choice("abcdefgh") for _ in range(rng.randrange(12))]
        yield rng.choice([" ", "  ", " \t"]).join(p + rng.choice(["", "", "", ",", ".", "\n", "!?"]) for p in parts), rng.choice(["en", "en", None, "", "fr"])


@pytest.mark.parametrize("percent", [100, 60])
def test_random_texts(spark, monkeypatch, percent):
    monkeypatch.setattr(encode, "RANGE_WORDS", 5)
    monkeypatch.setattr(phrases, "RANGE_ENTRIES", 300)
    monkeypatch.setattr(phrases, "SHARD_BYTES", 700)
    monkeypatch.setattr(phrases, "GATHER_BYTES", 4000)
    rows = [*texts(), (None, "en"), ("", None), ("...", "xx"), ("one two " * 5000, "long"), ("one two " * 5000, "long")]
    want = plain(rows, 6, percent)
    assert len(want) > 20 and {len(p.split()) for _, p in want} == {2, 3, 4, 5}
    assert found(collocations(frame(spark, rows).repartition(3), 6, percent)) == want


def test_no_broadcast(spark, monkeypatch):
    rows = list(texts())
    for module in (phrases, encode):
        monkeypatch.setattr(module, "small", lambda df: df)
    assert found(collocations(frame(spark, rows), 9)) == plain(rows, 9)


def test_stripe_totals_are_counts_of_their_prefix(spark):
    rows = list(texts())
    entries, _, words = merged_stripes(frame(spark, rows), 5)
    name = {r.id: r.word for r in words.collect()}
    f = Counter()
    for text, lang in rows:
        for piece in CUT.split(lower(text)):
            w = WORD.findall(piece)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang, tuple(w[i:i + k])] += 1
    got = {}
    for r in entries.collect():
        p = r.phrase[:-1] if r.phrase[-1] == -1 else r.phrase
        got.setdefault((r.lang, tuple(name[i] for i in p)), set()).add(r.a)
    assert got == {p: {a} for p, a in f.items() if a >= 5}


def test_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    a, n, l, r = 3 * 10**12, 10**15 - 7, 3 * 10**12 + 1, 5 * 10**12 + 3
    score = "CAST(1000 AS DECIMAL(4,0)) * (CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(16,0))) div (CAST(l AS DECIMAL(16,0)) * CAST(r AS DECIMAL(16,0)))"
    row = spark.createDataFrame([(a, n, l, r)], "a bigint, n bigint, l bigint, r bigint").select(F.expr(score)).first()
    assert row[0] == 1000 * a * n // (l * r)


def test_ties_and_top(spark):
    found_rows = spark.createDataFrame(
        [("en", p, a, 1, 1, 1, s) for p, a, s in [("b x", 5, 9), ("a é", 5, 9), ("a z", 5, 9), ("q q", 7, 9), ("r r", 1, 10)]],
        "lang string, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")
    got = {r.rank: r.phrase for r in top_phrases(found_rows, 4).collect()}
    assert got == {1: "r r", 2: "q q", 3: "a z", 4: "a é"}


def test_given_documents(spark, documents):
    rows = [(r.text, r.lang) for r in documents.select("text", "lang").collect()]
    assert found(collocations(documents, 20)) == plain(rows, 20)


def test_empty(spark):
    assert found(collocations(frame(spark, []))) == {}
    assert found(collocations(frame(spark, [(None, "en"), ("", None), (" \n ", None), ("word", None)]))) == {}


def test_pieces():
    data = np.frombuffer(b"a b.c\nd;;e fgh", np.uint8)
    sizes, begins = pieces(data, np.array([0, 0, 10, 14, 14]))
    assert sizes.tolist() == [1, 1, 1, 1, 1, 3] and begins.tolist() == [True, False, True, True, True, True]
    sizes, begins = pieces(np.frombuffer(b"abcd", np.uint8), np.array([0, 2, 4]))
    assert sizes.tolist() == [2, 2] and begins.tolist() == [True, True]
