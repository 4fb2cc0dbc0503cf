"""Fixed values, written out by hand: a wrong one in the library would else also be in the
DuckDB twins that take it from there."""

from codeloom.functions.text import LANGUAGE_BY_EXTENSION, SKIP_DIRS
from codeloom.operators import context as C
from codeloom.sources.fixtures import GOLDEN_QA, SYNONYMS


def test_languages_and_skipped_names():
    assert LANGUAGE_BY_EXTENSION == {
        ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust",
        ".java": "java", ".rb": "ruby", ".cpp": "cpp", ".c": "c", ".cs": "csharp", ".php": "php"}
    assert set(SKIP_DIRS) == {
        "node_modules", ".git", "__pycache__", ".venv", "venv", "env", "dist", "build", ".next", "target", "vendor", "coverage",
        ".pytest_cache", ".mypy_cache", "eggs", ".eggs"}


def test_synonyms_and_golden_questions():
    synonyms = dict(SYNONYMS)
    assert list(synonyms) == ["login", "auth", "database", "error", "route", "middleware", "config", "test", "websocket", "cache", "password", "upload"]
    assert synonyms["login"] == ["authenticate", "auth", "token", "session", "jwt"] and synonyms["upload"][-2:] == ["s3", "blob"]
    assert synonyms["database"] == ["db", "sql", "query", "model", "schema", "orm", "connect"]
    assert len(GOLDEN_QA) == 8 and GOLDEN_QA[3][1] == ["connect", "engine", "session", "database", "db"]


def test_prompt_and_replies(spark):
    assert C.NOT_INDEXED == "Repository not indexed yet — please wait for ingestion to finish."
    assert C.NOTHING_FOUND == "No relevant code found. Try asking about a specific function or file name."
    assert C.SYSTEM_PROMPT.startswith("You are ASSISTANT_NAME. Answer questions about a codebase using the provided code chunks.\n\nSTRICT OUTPUT FORMAT")
    q = spark.createDataFrame([(1, "r", "what?"), (2, "empty", "x"), (3, "r", " ")], "query_id int, repo_id string, question string")
    context = spark.createDataFrame([(1, "CTX")], "query_id int, context string")
    sizes = spark.createDataFrame([("r", 3)], "repo_id string, n_chunks int")
    rows = {r.query_id: r for r in C.build_prompts(q, context, None, sizes, assistant="Helper").collect()}
    assert (rows[1].reply, rows[2].reply, rows[3].reply) == (None, C.NOT_INDEXED, C.NOTHING_FOUND)
    system, user = rows[1].messages
    assert system.content.startswith("You are Helper. ") and "ASSISTANT_NAME" not in system.content
    assert user.content == "CODEBASE CONTEXT:\n\nCTX\n\n" + "=" * 60 + "\n\nQUESTION: what?"
    single = C.build_prompts(q, context, None, sizes, provider="gemini").where("query_id = 1").first().messages
    assert len(single) == 1 and single[0].content.endswith("Backticks around all code: `functionName`, `file.js`\n\n\n" + user.content)


def test_reassembly_of_odd_payloads(spark):
    good, bad = '[SOURCES][{"file": "a.py"}][/SOURCES]', "[SOURCES]{broken[/SOURCES]"
    rows = [(1, 0, "Hi "), (1, 1, good), (1, 2, "there"), (1, 3, bad), (2, 0, "x [SOURCES]1[/SOURCES] y [SOURCES]2[/SOURCES] z"), (3, 0, bad)]
    got = {r.msg_id: r for r in C.reassemble(spark.createDataFrame(rows, "msg_id int, seq int, data string")).collect()}
    assert (got[1].text, got[1].sources_json) == ("Hithere", '[{"file": "a.py"}]')
    assert got[3].sources_json is None


def test_client_history(spark):
    rows = [(1, t, "assistant" if t % 2 == 0 else "user") for t in range(12)] + [(2, 0, "assistant"), (2, 1, "user")]
    conv = spark.createDataFrame(rows, "conv_id int, turn int, role string")
    got = C.client_history(conv, C.F.col("turn") == 0).collect()
    assert sorted((r.conv_id, r.turn) for r in got) == [(1, t) for t in range(6, 12)] + [(2, 1)]
