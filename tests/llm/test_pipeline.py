import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from codeloom.llm import mixing, token_files, toxicity
from codeloom.llm.common import written

from .conftest import SF
from .test_decontaminate import plain
from .test_jaccard import plain_components
from .test_token_files import expected


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for n, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, SF)
        if n < len(P.STAGES) - 1:
            docs = written(docs, "test-stage")
        out.append(docs)
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near duplicates", "decontamination", "mixing", "token files"]
    assert all(d.schema == stages[0].schema for d in stages[:-1])


def test_toxicity(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(*toxicity.training_rows(stages[0], labels))
    want = {r.doc_id for r in toxicity.score(stages[0], model).where("score < 0.5").select("row.doc_id").collect()}
    kept = {d for d, _ in rows(stages[1])}
    assert kept == want
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert len(kept & toxic) <= 0.1 * len(toxic) and len(kept) >= 0.97 * (stages[0].count() - len(toxic & want) - len(toxic - kept) - 5)


def test_near_duplicates(stages):
    before = rows(stages[1])
    want = {c for _, n, c in plain_components([d for d, _ in before], [t for _, t in before], 5, 80)}
    assert sorted(d for d, _ in rows(stages[2])) == sorted(want)


def test_decontamination(spark, stages):
    before = rows(stages[2])
    leaking = {d for d, _ in plain(before, [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])}
    assert leaking and sorted(d for d, _ in rows(stages[3])) == sorted(d for d, _ in before if d not in leaking)


def test_mixing_and_token_files(spark, stages):
    copies = {r.doc_id: r.copies for r in mixing.draw(stages[3]).selectExpr("_row.doc_id", "copies").collect()}
    mixed = rows(stages[4])
    assert sorted(d for d, _ in mixed) == sorted(d for d, c in copies.items() for _ in range(c))
    tok = Tokenizer.from_file(token_files.word_bpe())
    assert [tuple(r) for r in stages[5].orderBy("start").collect()] == expected(mixed, tok)


def test_run(spark, stages):
    got = sorted(map(tuple, P.run(spark, SF).collect()))
    assert got == sorted(map(tuple, stages[5].collect()))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for n, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, SF)
        if n < len(P.STAGES) - 1:
            docs = written(docs, "empty-stage")
    assert docs.count() == 0
