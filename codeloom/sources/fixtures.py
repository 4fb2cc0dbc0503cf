"""Small fixed tables and inputs derived from the driver tables.

Fixed tables (golden questions, synonym dictionary) are tiny by definition and are
created with ``createDataFrame``.  Derived inputs are DataFrame expressions over the
given tables, so their size grows with the tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.session import checked_broadcast, materialize, spread, table

# Fixed values that must equal the reference: golden questions and expected symbols.
GOLDEN_QA = [
    ("How does the application handle HTTP request routing?",
     ["route", "add_url_rule", "dispatch_request", "Router"]),
    ("Where is authentication or login handled?",
     ["login", "authenticate", "auth", "token", "session"]),
    ("How are errors and exceptions handled globally?",
     ["errorhandler", "handle_exception", "error_handler", "HTTPException"]),
    ("How does the application connect to the database?",
     ["connect", "engine", "session", "database", "db"]),
    ("Where is middleware or request preprocessing done?",
     ["middleware", "before_request", "after_request", "dispatch"]),
    ("How is configuration loaded and managed?",
     ["config", "Config", "from_object", "settings", "load_config"]),
    ("How does the app handle static files and templates?",
     ["render_template", "send_file", "static", "template"]),
    ("How are background tasks or async jobs handled?",
     ["async", "task", "background", "worker", "celery", "queue"]),
]

# Fixed values that must equal the reference: query-expansion keywords and synonyms,
# in the reference's order.
SYNONYMS = [
    ("login", ["authenticate", "auth", "token", "session", "jwt"]),
    ("auth", ["authenticate", "token", "jwt", "session", "login", "permission"]),
    ("database", ["db", "sql", "query", "model", "schema", "orm", "connect"]),
    ("error", ["exception", "handler", "try", "catch", "raise"]),
    ("route", ["endpoint", "url", "path", "controller", "handler", "router"]),
    ("middleware", ["before_request", "after_request", "interceptor", "hook"]),
    ("config", ["settings", "env", "environment", "configuration"]),
    ("test", ["spec", "assert", "mock", "fixture", "pytest", "unittest"]),
    ("websocket", ["socket", "ws", "realtime", "emit", "broadcast"]),
    ("cache", ["redis", "ttl", "store", "invalidate"]),
    ("password", ["hash", "bcrypt", "salt", "encrypt", "secret"]),
    ("upload", ["file", "multipart", "storage", "s3", "blob"]),
]


def golden_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, repo_id, question, expected_symbols)``: every golden question asked in
    every repository of the derived Python files."""
    golden = F.array(*[F.struct(F.lit(i + 1).alias("g"), F.lit(q).alias("question"), F.array(*[F.lit(s) for s in syms]).alias("expected_symbols"))
                       for i, (q, syms) in enumerate(GOLDEN_QA)])
    regions = table(spark, sf_dir, "nation").select("n_regionkey").distinct()
    return regions.select("n_regionkey", F.inline(golden)).select(
        (F.col("g") * 1000 + F.col("n_regionkey")).cast("long").alias("query_id"),
        F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("repo_id"), "question", "expected_symbols")


def synonyms_df(spark: SparkSession) -> DataFrame:
    rows = [(i, kw, syns) for i, (kw, syns) in enumerate(SYNONYMS)]
    return spark.createDataFrame(rows, "kw_pos int, kw string, syns array<string>")


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a file table: ``source`` is the repository, one text file per
    document, language ``text`` (generic chunker)."""
    d = table(spark, sf_dir, "documents")
    return spread(d.select(
        F.col("source").alias("repo_id"),
        F.concat(F.lit("docs/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"),
                 F.lit(".txt")).alias("path"),
        F.octet_length("text").cast("bigint").alias("length"),
        F.col("text").alias("source"),
        F.lit("text").alias("language"),
    ))


# File names that a scan must take, or skip, as they stand; # is the doc_id.
SCAN_NAMES = ("src/main_#.py", "src/pages/[id]_#.tsx", "src/a b/#.js", "src/Upper_#.Py", "src/__init__#.py", "src/.hidden/#.JSX",
              "src/{a,b}*?_#.ts", "src/node_modules/x/#.js", "build/#.go", "notes_#.txt", "src/no_suffix_#", "src/x.y/z_#.c")


def documents_as_named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, source)``: every document under one of SCAN_NAMES, by doc_id."""
    name = F.get(F.array(*[F.lit(n) for n in SCAN_NAMES]), F.pmod(F.col("doc_id"), F.lit(len(SCAN_NAMES))).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.replace(name, F.lit("#"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("source"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``queries(query_id, repo_id, question)`` from the ``benchmark`` table: item i asks the
    i-th repository (modulo their number), in order of name.  Every third question ends in
    a keyword of the synonym dictionary, each keyword in turn."""
    repos = materialize(table(spark, sf_dir, "documents").select(F.col("source").alias("repo_id")).where("source is not null").distinct(), "repos")
    repos = repos.withColumn("_i", F.row_number().over(Window.orderBy("repo_id")) - 1)
    b = table(spark, sf_dir, "benchmark").withColumn("_i", F.pmod(F.col("item_id"), F.lit(max(1, repos.count()))).cast("int")).join(repos, "_i")
    keyword = F.get(F.array(*[F.lit(kw) for kw, _ in SYNONYMS]), F.pmod(F.floor(F.col("item_id") / 3), F.lit(len(SYNONYMS))).cast("int"))
    return b.select(
        F.col("item_id").alias("query_id"),
        "repo_id",
        F.when(F.pmod("item_id", F.lit(3)) == 0, F.concat("text", F.lit(" "), keyword)).otherwise(F.col("text")).alias("question"),
    )


def answerable_queries(spark: SparkSession, sf_dir: str, pairs: DataFrame | None = None) -> DataFrame:
    """``benchmark_queries`` with three in four questions asked in a repository (the first by
    name) of a document that contains the item, where there is one.  ``pairs``: written ``relevance_pairs``."""
    few, _ = checked_broadcast(pairs if pairs is not None else materialize(relevance_pairs(spark, sf_dir), "relevance"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("symbol"), "source")
    truth = materialize(docs.join(few, "symbol").groupBy("query_id").agg(F.min("source").alias("truth")), "truth")
    asked = F.when(F.pmod("query_id", F.lit(4)) != 3, F.col("truth"))
    return benchmark_queries(spark, sf_dir).join(truth, "query_id", "left").select(
        "query_id", F.coalesce(asked, "repo_id").alias("repo_id"), "question")


# Derived code files.  Suppliers are grouped into files by nation and by blocks of
# SUPPLIERS_PER_FILE consecutive keys, so a file holds at most that many functions
# (bounded row size, bounded collect_list) however large the tables grow.
SUPPLIERS_PER_FILE = 100


def _s(c) -> F.Column:
    return F.col(c).cast("string")


def _supplier_files(spark: SparkSession, sf_dir: str, piece) -> DataFrame:
    """``(k, blk, body)``: per nation and key block, the supplier pieces joined in key
    order.  The group is bounded by SUPPLIERS_PER_FILE rows."""
    s = table(spark, sf_dir, "supplier")
    blk = (F.col("s_suppkey") / SUPPLIERS_PER_FILE).cast("long")
    parts = s.select(F.col("s_nationkey").alias("k"), blk.alias("blk"), "s_suppkey", piece.alias("piece"))
    return parts.groupBy("k", "blk").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("s_suppkey", "piece"))), lambda x: x["piece"]), "").alias("body"))


def py_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python files ``(repo_id, path, length, source, language)``: per nation and key
    block a module with an optional module docstring, imports, a class with a one-line
    or multi-line docstring and methods (one too short to keep, one async with a nested
    def), and one top-level function per supplier whose length varies from 3 to 92
    lines (some are cut at 80)."""
    fn = F.concat(
        F.lit("def supplier_"), _s("s_suppkey"), F.lit("(x):\n"),
        F.lit('    """Supplier '), F.col("s_name"), F.lit('."""\n'),
        F.lit("    total = price_"), (F.col("s_suppkey") % 7).cast("string"), F.lit("(x)\n"),
        F.repeat(F.lit("    total = step(total)\n"), (F.col("s_suppkey") % 90).cast("int")),
        F.lit("    return total\n\n"))
    files = _supplier_files(spark, sf_dir, fn)
    n = table(spark, sf_dir, "nation")
    k = F.col("k")
    src = F.concat(
        F.when(k % 3 == 0, F.concat(F.lit('"""Sources of '), F.col("n_name"), F.lit('."""\n'))).otherwise(F.lit("")),
        F.lit("import os\n# tools\n\nfrom region_"), _s("n_regionkey"), F.lit(" import tools\n\n"),
        F.lit("class Nation"), _s("k"), F.lit("(Base):\n"),
        F.when(k % 2 == 0, F.concat(F.lit('    """'), F.col("n_name"), F.lit(' records."""\n')))
         .otherwise(F.concat(F.lit("    '''Records of\n    "), F.col("n_name"), F.lit(".\n    '''\n"))),
        F.lit("\n    def __init__(self, key):\n        self.key = key\n        setup(key, "), _s("n_regionkey"),
        F.lit(")\n\n    def name(self): return '"), F.col("n_name"), F.lit("'\n\n"),
        F.lit("    async def refresh(self):\n        await load_"), _s("k"),
        F.lit("(self.key)\n        def inner():\n            return helper()\n        return inner\n\n"),
        F.lit("@cached\n@app.route('/x')\nasync def fetch_"), _s("k"), F.lit("(a,\n             b=1):\n\t\"Tabs.\"\n\treturn tool_"), _s("k"), F.lit("(a)\n\n"),
        F.lit("def one_liner(): return 1\n\nif __name__ == '__main__':\n    run()\n\n"),
        F.col("body"))
    out = files.join(n, files.k == n.n_nationkey).select(
        F.concat(F.lit("region_"), _s("n_regionkey")).alias("repo_id"),
        F.concat(F.lit("src/nation_"), _s("k"), F.lit("/block_"), _s("blk"), F.lit(".py")).alias("path"),
        src.alias("source"))
    return out.select("repo_id", "path", F.octet_length("source").cast("bigint").alias("length"), "source",
                      F.lit("python").alias("language"))


def js_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JavaScript / TypeScript files: imports and ``require``, a one-line function that
    runs on into the next declaration, a class, ``export default function`` and
    ``export class`` (not matched), a declaration over two lines whose braces close within
    the 100 lines of the scan or just beyond, braces in strings and comments, an indented
    function, a typed arrow function, and one arrow function per supplier."""
    fn = F.concat(
        F.lit("export const supplier_"), _s("s_suppkey"), F.lit(" = async (x) => {\n  return fetch_"),
        _s("s_suppkey"), F.lit("(x);\n};\n"))
    files = _supplier_files(spark, sf_dir, fn)
    n = table(spark, sf_dir, "nation")
    k = F.col("k")
    src = F.concat(
        F.lit("import tools from 'region_"), _s("n_regionkey"), F.lit("';\nconst util = require('util');\n"),
        F.lit("function nation"), _s("k"), F.lit("() { return "), _s("k"), F.lit("; }\n"),
        F.lit("class Nation"), _s("k"), F.lit(" extends Base {\n  constructor() {\n    super();\n  }\n}\n"),
        F.lit("export default function main() {\n  run();\n}\nexport class Skip {\n  m() {}\n}\n"),
        F.lit("async function wide"), _s("k"), F.lit("(a,\n  b) {\n"), F.repeat(F.lit("  step(a);\n"), (k % 6 + 94).cast("int")), F.lit("}\n"),
        F.lit("let text"), _s("k"), F.lit(" = (s) => {\n  return '}' + s;\n  // }\n};\n\tfunction inner() {\n\t\tx();\n\t}\n"),
        F.lit("export const typed"), _s("k"), F.lit(" = async (a: Map<string, {n: number}>): Promise<void> => {\n  await $(a);\n};\n"),
        F.col("body"))
    ext = F.when(k % 4 == 1, F.lit(".ts")).otherwise(F.lit(".js"))
    out = files.join(n, files.k == n.n_nationkey).select(
        F.concat(F.lit("region_"), _s("n_regionkey")).alias("repo_id"),
        F.concat(F.lit("web/nation_"), _s("k"), F.lit("/block_"), _s("blk"), ext).alias("path"),
        src.alias("source"),
        F.when(ext == ".ts", "typescript").otherwise("javascript").alias("language"))
    return out.select("repo_id", "path", F.octet_length("source").cast("bigint").alias("length"), "source",
                      "language")


# Path shapes for the scan filters: 13 known extensions, upper case, no extension, a
# bare ".py", unknown extensions, and every skipped directory name.
PATH_EXTS = [".py", ".js", ".jsx", ".ts", ".tsx", ".go", ".rs", ".java", ".rb", ".cpp", ".c", ".cs", ".php",
             ".PY", "", "/.py", ".txt", ".b.JS", "/Makefile", ".tar.gz"]
PATH_DIRS = ["node_modules", ".git", "__pycache__", ".venv", "venv", "env", "dist", "build", ".next",
             "target", "vendor", "coverage", ".pytest_cache", ".mypy_cache", "eggs", ".eggs",
             "src", "lib", "app"]


def part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(p_partkey, path, length)`` from ``part``; sizes reach 1,000,000 bytes."""
    p = table(spark, sf_dir, "part")
    ext = F.element_at(F.array(*[F.lit(e) for e in PATH_EXTS]), (F.col("p_partkey") % len(PATH_EXTS) + 1).cast("int"))
    d = F.element_at(F.array(*[F.lit(x) for x in PATH_DIRS]), (F.col("p_partkey") % len(PATH_DIRS) + 1).cast("int"))
    name = F.regexp_replace("p_name", " ", "_")
    return p.select("p_partkey", F.concat(F.lit("repo/"), d, F.lit("/"), name, ext).alias("path"),
                    (F.col("p_size") * 20000).cast("bigint").alias("length"))


def repo_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, url)``: every page's URL and a repository URL variant (GitHub with and
    without ``.git``, trailing slashes, http, GitLab without scheme and padded,
    Bitbucket)."""
    pg = table(spark, sf_dir, "pages")
    owner = F.regexp_extract("url", r"://([^/.]+)", 1)
    repo = F.concat(owner, F.lit("/repo"), F.col("page_id").cast("string"))
    v = F.col("page_id") % 6
    url = (F.when(v == 0, F.lit(None).cast("string"))
           .when(v == 1, F.concat(F.lit("https://github.com/"), repo))
           .when(v == 2, F.concat(F.lit("https://github.com/"), repo, F.lit(".git")))
           .when(v == 3, F.concat(F.lit("http://github.com/"), repo, F.lit("/")))
           .when(v == 4, F.concat(F.lit("  gitlab.com/"), repo, F.lit(" ")))
           .otherwise(F.concat(F.lit("https://bitbucket.org/"), repo, F.lit("//"))))
    return pg.select("page_id", F.explode(F.array_compact(F.array("url", url))).alias("url"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(msg_id, text)``: assistant turns wrapped as model answers with bullets, labels,
    numbered items, headers, fences, citations, and a valid, malformed or no
    ``[SOURCES]`` payload."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    f = F.concat(F.lit("src/mod_"), F.col("conv_id").cast("string"), F.lit(".py"))
    cite = F.concat(F.lit("["), f, F.lit(":"), (F.col("turn") + 1).cast("string"), F.lit("-"),
                    (F.col("turn") + 10).cast("string"), F.lit("]"))
    v = F.col("turn") % 4
    body = (F.when(v == 0, F.concat(F.lit("• File: `"), f, F.lit("` "), cite, F.lit("\n* Calls "), F.col("text")))
            .when(v == 1, F.concat(F.lit("It works. 1. First point "), cite, F.lit(". 2) Second point. "),
                                   F.col("text")))
            .when(v == 2, F.concat(F.lit("## Details\nEntry point: "), F.col("text"), F.lit(" — see "), cite))
            .otherwise(F.concat(F.col("text"), F.lit("\n```python\ndef f():\n    return 1\n```\nNote: done "),
                                cite)))
    payload = F.concat(F.lit('{"file": "'), f, F.lit('", "start": '), (F.col("turn") + 1).cast("string"),
                       F.lit(', "end": '), (F.col("turn") + 10).cast("string"),
                       F.lit(', "name": "fn_'), F.col("turn").cast("string"),
                       F.lit('", "type": "function", "method": "hybrid"}'))
    s = F.col("conv_id") % 3
    tail = (F.when(s == 0, F.concat(F.lit("\n\n[SOURCES]["), payload, F.lit(", "), payload, F.lit("][/SOURCES]")))
            .when(s == 1, F.lit("\n\n[SOURCES][{\"file\": broken[/SOURCES]"))
            .otherwise(F.lit("")))
    text = F.concat(F.lit("The answer is in `"), f, F.lit("`. "), body, tail)
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), text.alias("text"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(msg_id, seq, data)``: assistant turns streamed word by word with newlines
    escaped as ``\\n``, an ``[ERROR]`` fragment for every fourth conversation and a
    sources fragment for every third."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    mid = (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id")
    words = c.select(mid, "conv_id", F.posexplode(F.split("text", " ")).alias("seq", "w"),
                     F.size(F.split("text", " ")).alias("nw"))
    data = F.replace(F.when(F.col("seq") < F.col("nw") - 1, F.concat("w", F.lit(" "))).otherwise(F.col("w")),
                     F.lit("\n"), F.lit("\\n"))
    toks = words.select("msg_id", F.col("seq").cast("int").alias("seq"), data.alias("data"))
    err = (c.filter(F.col("conv_id") % 4 == 0)
           .select(mid, F.lit(100000).alias("seq"), F.lit("[ERROR]quota exceeded (429)[/ERROR]").alias("data")))
    src = (c.filter(F.col("conv_id") % 3 == 0)
           .select(mid, F.lit(100001).alias("seq"),
                   F.concat(F.lit('[SOURCES][{"file": "src/mod_'), F.col("conv_id").cast("string"),
                            F.lit('.py", "start": 1, "end": 9, "name": "f", "type": "function", '
                                  '"method": "dense"}][/SOURCES]')).alias("data")))
    return toks.unionByName(err).unionByName(src)


# Keys of items that are looked for inside the documents' rows; more are left to joins.
MOST_KEYS = 1000


def relevance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, symbol)``: benchmark item -> ``/doc_<id>.txt`` of every document that
    contains the item's text.

    Exact and linear in the documents instead of a documents x items nested loop: for a
    passage of at least 5 space-separated words, its words 2-4 are whole words of any
    document containing it, so the document must have that word trigram.  Up to MOST_KEYS
    trigrams are looked for at the places of their first words inside a document's row, which
    verifies its candidates with ``contains`` at once.  Of more items, document trigrams are equi-joined
    to the item keys, and the candidate pairs are verified.  Shorter passages are found so by their first
    three characters.  Each small side is broadcast if its size allows, else both are shuffled."""
    b = materialize(table(spark, sf_dir, "benchmark").select(
        "item_id", F.col("text").alias("btext"), F.split("text", " ").alias("bt")), "items")
    long_b = b.filter(F.size("bt") >= 5).select("item_id", "btext", F.array_join(F.slice("bt", 2, 3), " ").alias("key"))
    short_b = b.filter(F.size("bt") < 5).select("item_id", "btext", F.substring("btext", 1, 3).alias("key"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.size("_w")
    starts = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))
    trigram = lambda i: F.array_join(F.slice(F.col("_w"), i + 1, 3), " ")
    split = d.select("doc_id", "text", F.split("text", " ").alias("_w"))
    keys = [r.key for r in long_b.select("key").distinct().limit(MOST_KEYS + 1).collect()]
    inside, short = 0 < len(keys) <= MOST_KEYS, not short_b.isEmpty()
    found, cand = [], []
    if inside:
        first = sorted({k.split(" ")[0] for k in keys})
        held = F.filter(F.transform(F.filter(starts, lambda i: F.get(F.col("_w"), i).isin(first)), trigram), lambda t: t.isin(keys))
        with_key = split.select("doc_id", "text", F.array_distinct(held).alias("_k")).select("doc_id", "text", F.explode_outer("_k").alias("key"))
        found.append(with_key.join(checked_broadcast(long_b)[0], "key").filter(F.col("text").contains(F.col("btext"))).select("doc_id", "item_id"))
    elif keys:
        words = split.select("doc_id", F.explode(F.array_distinct(F.transform(starts, trigram))).alias("key"))
        cand.append(words.join(checked_broadcast(long_b.select("item_id", "key"))[0], "key").select("doc_id", "item_id"))
    chars = d.select("doc_id", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1))), lambda i: F.substring(F.col("text"), i, F.lit(3))))).alias("key"))
    if short or not keys:
        cand.append(chars.join(checked_broadcast(short_b.select("item_id", "key"))[0], "key").select("doc_id", "item_id"))
    if cand:
        # Written once: the size check and the join would each run the pass over all documents.
        some, _ = checked_broadcast(materialize(reduce(DataFrame.unionByName, cand).distinct(), "relevance-candidates"))
        texts, _ = checked_broadcast((short_b if inside else b).select("item_id", "btext"))
        found.append(d.join(some, "doc_id").join(texts, "item_id")
                     .filter(F.col("text").contains(F.col("btext"))).select("doc_id", "item_id"))
    return (reduce(DataFrame.unionByName, found)
            .select(F.col("item_id").alias("query_id"),
                    F.concat(F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("symbol")))
