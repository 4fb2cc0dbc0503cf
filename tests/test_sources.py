"""File scan, per-repository overwrite, report sink, flat metadata round trip, and
query expansion with a dictionary table."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.operators.evaluate import report, write_report
from codeloom.operators.expand import expand_queries
from codeloom.operators.metadata import flat_metadata, from_flat
from codeloom.sources import files
from codeloom.sources.files import scan_sources
from codeloom.sources.fixtures import synonyms_df
from codeloom.sources.store import replace_repo


def test_scan_sources(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "pkg").mkdir(parents=True)
    (root / "node_modules" / "x").mkdir(parents=True)
    (root / "pkg" / "a.py").write_bytes(b"def f():\n    return 1\n")
    (root / "pkg" / "bad.js").write_bytes(b"const s = '\xff\xfeok';\n")          # invalid UTF-8 dropped
    (root / "node_modules" / "x" / "m.js").write_text("function g() {}\n")       # skipped directory
    (root / "pkg" / "big.py").write_bytes(b"#" * 500_001)                        # over the size limit
    (root / "pkg" / "ok.py").write_bytes(b"#" * 500_000)                         # exactly at the limit
    (root / "pkg" / "notes.txt").write_text("text\n")                            # unknown language
    (root / "pkg" / "pages").mkdir()
    (root / "pkg" / "pages" / "[id].tsx").write_text("x")
    (root / "pkg" / "__init__.Py").write_text("")
    (root / "pkg" / "a b*?{c,d}.jS").write_text("y")
    got = {r.path: (r.language, r.source) for r in scan_sources(spark, str(root), repo_id="r").collect()}
    assert set(got) == {"pkg/a.py", "pkg/bad.js", "pkg/ok.py", "pkg/pages/[id].tsx", "pkg/__init__.Py", "pkg/a b*?{c,d}.jS"}
    assert got == {r.path: (r.language, r.source) for r in scan_sources(spark, f"file:{root}").collect()}
    assert got["pkg/bad.js"] == ("javascript", "const s = 'ok';\n")


@pytest.mark.parametrize("task", [files._list, files._read])
def test_only_missing_and_forbidden_files_are_skipped(monkeypatch, task):
    class Store:
        def __init__(self, error):
            self.error = error

        def get_file_info(self, _):
            raise self.error

        open_input_stream = get_file_info

    rows = pa.RecordBatch.from_pydict({"path": ["a"]})
    for error in (FileNotFoundError("a"), PermissionError("a")):
        monkeypatch.setattr(files, "file_system", lambda _, e=error: (Store(e), "/r"))
        assert list(task("/r")(iter([rows]))) == []
    monkeypatch.setattr(files, "file_system", lambda _: (Store(OSError("timed out")), "/r"))
    with pytest.raises(OSError, match="timed out"):
        list(task("/r")(iter([rows])))


def test_replace_repo_only_touches_its_partitions(spark, tmp_path):
    path = str(tmp_path / "index")
    mk = lambda rows: spark.createDataFrame(rows, "repo_id string, chunk_id string, content string")
    replace_repo(mk([("a", "1", "old"), ("b", "1", "keep")]), path)
    replace_repo(mk([("a", "2", "new")]), path)
    got = sorted((r.repo_id, r.chunk_id, r.content) for r in spark.read.parquet(path).collect())
    assert got == [("a", "2", "new"), ("b", "1", "keep")]


def test_write_report(spark, tmp_path):
    per_q = spark.createDataFrame([(1, 1), (2, None)], "query_id int, hit_rank int")
    m = spark.createDataFrame([(2, 0.5)], "n long, hit_at_1 double")
    asked = spark.createDataFrame([(1, "a?"), (2, "b?")], "query_id int, question string")
    src = spark.createDataFrame([(1, 1, "g", "n"), (1, 0, "f", "m"), (1, 9, "h", "o")], "query_id int, pos int, file string, name string")
    write_report(*report(per_q, m, asked, src, "https://h/o/r", "id1", 7), str(tmp_path / "report"))
    head = spark.read.json(str(tmp_path / "report" / "metrics")).collect()[0]
    assert (head.hit_at_1, head.repo_url, head.repo_id, head.total_chunks) == (0.5, "https://h/o/r", "id1", 7)
    rows = {r.query_id: r for r in spark.read.json(str(tmp_path / "report" / "results")).collect()}
    assert [s.file for s in rows[1].sources] == ["f", "g"] and rows[1].question == "a?" and rows[2].sources == []


def test_flat_round_trip(spark):
    ch = spark.createDataFrame(
        [("r", "a.py::f::1", "a.py", "method", "f", 1, 3, "python", "C", "d" * 600, ["x", "y"], [], "    def f():\n        x()")],
        "repo_id string, chunk_id string, file_path string, chunk_type string, name string, start_line int, "
        "end_line int, language string, parent_name string, docstring string, calls array<string>, "
        "imports array<string>, content string")
    flat = flat_metadata(ch)
    row = flat.collect()[0]
    assert (row.parent_name, len(row.docstring), row.calls) == ("C", 500, "x,y")
    doc = "# python method: f (in class C)\n# File: a.py lines 1-3\n\n    def f():\n        x()"
    back = from_flat(flat.withColumn("document", F.lit(doc))).collect()[0]
    assert back.content == "def f():\n        x()" and back.calls == ["x", "y"]


def test_expand_with_dictionary_table(spark):
    q = spark.createDataFrame([(1, "Where is the Author login?"), (2, "nothing here")], "query_id int, question string")
    a = {r.query_id: r.search_text for r in expand_queries(q, synonyms_df(spark)).collect()}
    b = {r.query_id: r.search_text for r in expand_queries(q).collect()}
    assert a == b
    assert a[2] == "nothing here"
    assert a[1].startswith("Where is the Author login? ") and "jwt" in a[1] and "permission" in a[1]
