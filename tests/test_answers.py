"""Answer clean-up and stream reassembly on hand-worked rows."""

from codeloom.operators.answers import normalise_answers
from codeloom.operators.context import parse_sources, reassemble


def fmt(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r.formatted for r in normalise_answers(df).orderBy("id").collect()]


def test_normalise(spark):
    got = fmt(spark, [
        "Routing is done in `app.py`. • File: `app.py` [app.py:1-9] • Function: `route` registers handlers",
        "The db connects here.\n\n1. First it opens [db.py:3-11]\n2) then it retries\n## Notes\n"
        "on error: it logs and exits\nthis is a continuation line that is rather long",
        "   ",
        "Just one line.",
        "Summary.\nfoo-bar: baz value\n`code`: not a label here\nthing — explained well",
    ])
    assert got[0] == ("Routing is done in `app.py`.\n\n- **File:** `app.py` [app.py:1-9]\n"
                      "- **Function:** `route` registers handlers")
    assert got[1] == ("The db connects here.\n\n- **First It Opens [Db.Py:** 3-11]\n- then it retries\n"
                      "- **Notes**\n- **On Error:** it logs and exits this is a continuation line that is rather long")
    assert got[2] == "   "
    assert got[3] == "Just one line."
    assert got[4] == "Summary.\n\n- **Foo-Bar:** baz value `code`: not a label here thing — explained well"


def test_at_most_six_bullets(spark):
    text = "Top.\n" + "\n".join(f"- item number {i}" for i in range(9))
    assert fmt(spark, [text])[0].count("\n- ") == 6


def test_reassemble(spark):
    frags = spark.createDataFrame([
        (1, 0, "Hello "), (1, 1, "world\\nnext "), (1, 2, "[ERROR]boom[/ERROR]"),
        (1, 3, '[SOURCES][{"file": "a.py", "start": 1, "end": 2, "name": "f", "type": "function", '
               '"method": "bm25"}][/SOURCES]'),
    ], "msg_id int, seq int, data string")
    r = reassemble(frags).collect()[0]
    assert r.text == "Hello world\nnext \n⚠️ boom".strip()
    assert '"a.py"' in r.sources_json


def test_parse_sources_malformed(spark):
    a = spark.createDataFrame([
        (1, 'x [SOURCES][{"file": "a.py", "start": 1, "end": 3, "name": "f", "type": "function", '
            '"method": "dense"}][/SOURCES]'),
        (2, "y [SOURCES][{\"file\": broken[/SOURCES]"),
        (3, "no payload"),
    ], "query_id int, text string")
    got = [(r.query_id, r.pos, r.file, r.start, r.method) for r in parse_sources(a).collect()]
    assert got == [(1, 0, "a.py", 1, "dense")]


def test_sql_twin_on_composed_answers(spark):
    """Random rows of everything the rules look at: marks, labels, numbers, blanks of all kinds, long lines."""
    import duckdb
    import numpy as np
    import pyarrow as pa

    from codeloom.plans.oracle import ANSWERS, ORACLE

    pieces = ["• ", "·", "* ", "+ ", " - ", "- ", "\n", "\n\n", "\r\n", " \t", " ", " ", ". ", "! ", "1. ", "2) ", "٣. ", "# ", "### ", "#### ", "**", "**Bold** ",
              "Entry point: ", "on error: ", "a: b", "Élan: vital ", "1st x: y", " — ", "`code`", "[a.py:1-2]", "word ", "Word ", "ok", "it's: so ",
              "a very long line of plain words that goes on and on ", "x" * 60, "", ":", "Label:\t"]
    rng = np.random.default_rng(4)
    texts = ["".join(pieces[i] for i in rng.integers(0, len(pieces), int(rng.integers(0, 30)))) for _ in range(600)]
    texts += [None, "", " \n ", "\n\nA.\n", "- ", "- a\n- ", "Sum.\n- \n- : x\n- a: b — c\n- `a`: b\n- [a]: b — c"]
    given = pa.table({"msg_id": list(range(len(texts))), "text": pa.array(texts, pa.string())})  # noqa: F841
    want = dict(duckdb.sql(ORACLE["normalise_answers"].replace(ANSWERS, "\na AS (SELECT * FROM given)")).fetchall())
    got = fmt(spark, texts)
    assert got == [want[i] for i in range(len(texts))]
