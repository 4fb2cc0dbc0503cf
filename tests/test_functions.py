"""Column helpers against values computed from their definitions."""

import hashlib

from pyspark.sql import functions as F

from codeloom.functions.markup import citations, code_blocks
from codeloom.functions.text import language_of, lines_of
from codeloom.functions.urls import clone_url, job_id, repo_id, repo_name, valid_repo_url


def one(spark, col, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(col(F.col("x")).alias("y")).collect()[0].y


def test_urls(spark):
    u = "https://github.com/pallets/flask/"
    assert one(spark, repo_id, u) == hashlib.md5(b"github.com/pallets/flask").hexdigest()[:16]
    assert one(spark, job_id, u) == hashlib.md5(u.encode()).hexdigest()[:12]
    assert one(spark, clone_url, "  " + u + " ") == "https://github.com/pallets/flask.git"
    assert one(spark, clone_url, "https://gitlab.com/a/b/") == "https://gitlab.com/a/b"
    assert one(spark, valid_repo_url, "example.com/x") is False
    assert one(spark, valid_repo_url, " bitbucket.org/a ") is True
    assert one(spark, repo_name, "https://github.com/pallets/flask.git") == "pallets/flask"
    assert one(spark, repo_name, "flask") == "flask"


def test_language_of(spark):
    cases = {"a/b.PY": "python", "x.tsx": "typescript", ".py": None, "a/.py": None, "Makefile": None,
             "a.b.js": "javascript", "x.tar.gz": None, "a.": None}
    for path, lang in cases.items():
        assert one(spark, language_of, path) == lang, path


def test_lines_of(spark):
    assert one(spark, lines_of, "a\r\nb\n\nc\n") == ["a", "b", "", "c"]
    assert one(spark, lines_of, "") == []
    assert one(spark, lines_of, "a\x0bb c") == ["a", "b", "c"]


def test_markup(spark):
    t = "See [app.py:3-9] and [x] and\n```py\n  code()\n```"
    assert one(spark, citations, t) == ["app.py:3-9"]
    got = one(spark, code_blocks, t)
    assert [(b.lang, b.code) for b in got] == [("py", "code()")]
