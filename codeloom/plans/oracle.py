"""Independent DuckDB formulations of the registered queries (the correctness oracle).

Where possible the SQL takes a different route than the Spark code: windows instead of
array scans, ``UNION ALL`` + ``GROUP BY`` instead of full outer joins, sparse bucket
joins instead of dense vectors.  Tables ``documents benchmark embeddings ...`` are
views over the same parquet files.
"""

from __future__ import annotations

from codeloom.functions.text import WS_CHARS

NL = "chr(10)"

# documents -> files -> line blocks (window 60, step 50, at least 3 lines) with the
# embed text of each block.
DOC_CHUNKS = f"""
doc_files AS (
  SELECT source AS repo_id,
         'docs/' || lang || '/doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS file_path,
         string_split(text, {NL}) AS p
  FROM documents),
doc_lines AS (
  SELECT repo_id, file_path,
         CASE WHEN len(p) > 0 AND p[len(p)] = '' THEN p[1:len(p)-1] ELSE p END AS l
  FROM doc_files),
doc_starts AS (
  SELECT repo_id, file_path, l, unnest(range(0, len(l), 50)) AS i FROM doc_lines),
chunks AS (
  SELECT repo_id, file_path, 'block' AS chunk_type, 'block_' || CAST(i AS VARCHAR) AS name,
         CAST(i + 1 AS INTEGER) AS start_line,
         CAST(i + least(60, len(l) - i) AS INTEGER) AS end_line,
         'text' AS language,
         array_to_string(l[i + 1 : i + least(60, len(l) - i)], {NL}) AS content
  FROM doc_starts WHERE least(60, len(l) - i) >= 3),
chunks_e AS (
  SELECT *, file_path || '::' || name || '::' || CAST(start_line AS VARCHAR) AS chunk_id,
         '# ' || language || ' ' || chunk_type || ': ' || name || {NL} || '# File: ' || file_path
           || ' lines ' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR)
           || {NL} || {NL} || content AS embed_text
  FROM chunks)"""

TOKENS = "list_filter(string_split_regex(lower({x}), '\\s+'), lambda t: t <> '')"

BM25_INDEX = f"""
ctoks AS (SELECT repo_id, chunk_id, {TOKENS.format(x='embed_text')} AS toks FROM chunks_e),
tf AS (
  SELECT repo_id, chunk_id, dl, tok, count(*) AS tf
  FROM (SELECT repo_id, chunk_id, len(toks) AS dl, unnest(toks) AS tok FROM ctoks)
  GROUP BY ALL),
stats AS (SELECT repo_id, count(*) AS n, avg(len(toks)) AS avgdl FROM ctoks GROUP BY repo_id),
dfs AS (SELECT repo_id, tok, count(*) AS df FROM tf GROUP BY ALL),
raw AS (
  SELECT repo_id, tok, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw_idf
  FROM dfs JOIN stats USING (repo_id)),
idf AS (
  SELECT repo_id, tok, df,
         CASE WHEN raw_idf < 0 THEN 0.25 * avg(raw_idf) OVER (PARTITION BY repo_id)
              ELSE raw_idf END AS idf
  FROM raw)"""

BENCH_QUERIES = """
bq AS (
  SELECT item_id AS query_id, repos[item_id % len(repos) + 1] AS repo_id,
         text || CASE WHEN item_id % 3 = 0 THEN ' ' || (['login', 'auth', 'database', 'error', 'route', 'middleware',
           'config', 'test', 'websocket', 'cache', 'password', 'upload'])[(item_id // 3) % 12 + 1] ELSE '' END AS question
  FROM benchmark, (SELECT list(DISTINCT source ORDER BY source) AS repos FROM documents WHERE source IS NOT NULL))"""

# Three in four questions asked where a document contains the item, if there is one.
ANSWERABLE = BENCH_QUERIES.replace("bq AS", "bq0 AS") + """,
bq AS (
  SELECT query_id, coalesce(CASE WHEN query_id % 4 <> 3 THEN
           (SELECT min(d.source) FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.item_id = query_id) END, repo_id) AS repo_id,
         question FROM bq0)"""


def bm25_ranked(queries_cte: str, text: str, k: int) -> str:
    """BM25 top-k over ``queries_cte(query_id, repo_id, <text>)``."""
    return f"""
qt AS (
  SELECT query_id, repo_id, tok, count(*) AS qtf
  FROM (SELECT query_id, repo_id, unnest({TOKENS.format(x=text)}) AS tok FROM {queries_cte})
  GROUP BY ALL),
bm_scores AS (
  SELECT qt.query_id, qt.repo_id, tf.chunk_id,
         sum(qtf * idf.idf * (tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * tf.dl / stats.avgdl)))) AS score
  FROM qt JOIN idf USING (repo_id, tok) JOIN tf USING (repo_id, tok) JOIN stats USING (repo_id)
  GROUP BY ALL),
bm_ranked AS (
  SELECT query_id, repo_id, chunk_id, round(score, 6) AS score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) - 1
              AS INTEGER) AS rank
  FROM bm_scores WHERE score > 0),
bm_top AS (SELECT * FROM bm_ranked WHERE rank < {k})"""


ORACLE: dict[str, str] = {}

ORACLE["line_blocks"] = f"""
WITH {DOC_CHUNKS}
SELECT repo_id, chunk_id, file_path, chunk_type, name, start_line, end_line, language, content
FROM chunks_e"""

ORACLE["term_freq"] = f"""
WITH {DOC_CHUNKS}, {BM25_INDEX}
SELECT repo_id, chunk_id, tok, tf, dl FROM tf"""

ORACLE["doc_stats"] = f"""
WITH {DOC_CHUNKS}, {BM25_INDEX}
SELECT repo_id, n, round(avgdl, 6) AS avgdl FROM stats"""

ORACLE["term_idf"] = f"""
WITH {DOC_CHUNKS}, {BM25_INDEX}
SELECT repo_id, tok, df, round(idf, 6) AS idf FROM idf"""

ORACLE["bm25_topk"] = f"""
WITH {DOC_CHUNKS}, {BM25_INDEX}, {BENCH_QUERIES}, {bm25_ranked('bq', 'question', 18)}
SELECT query_id, repo_id, chunk_id, score, rank FROM bm_top"""


def _syn_values() -> str:
    from codeloom.sources.fixtures import SYNONYMS
    return ", ".join(f"('{kw}', '{s}')" for kw, syns in SYNONYMS for s in syns)


def expanded(src: str, key: str, question: str) -> str:
    """``ex(<key>, ..., search_text)``: question plus sorted distinct synonyms."""
    return f"""
syn(kw, syn) AS (VALUES {_syn_values()}),
ex_extra AS (
  SELECT q.{key} AS k, string_agg(DISTINCT s.syn, ' ' ORDER BY s.syn) AS extras
  FROM {src} q JOIN syn s ON contains(lower(q.{question}), s.kw) GROUP BY q.{key}),
ex AS (
  SELECT q.*, CASE WHEN e.extras IS NULL THEN q.{question} ELSE q.{question} || ' ' || e.extras END
         AS search_text
  FROM {src} q LEFT JOIN ex_extra e ON e.k = q.{key})"""


BUCKET = "(('0x' || substr(md5(tok), 1, 8))::BIGINT % 64)"
SIGN = "(CASE WHEN ('0x' || substr(md5(tok), 9, 1))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END)"

# Hashed bag-of-tokens vectors in sparse form (bucket, value) and exact cosine.
DENSE = f"""
cvec AS (
  SELECT repo_id, chunk_id, {BUCKET} AS b, sum({SIGN})::DOUBLE AS v
  FROM (SELECT repo_id, chunk_id, unnest(toks) AS tok FROM ctoks) GROUP BY ALL),
cnorm AS (SELECT repo_id, chunk_id, sqrt(sum(v * v)) AS n FROM cvec GROUP BY ALL),
qvec AS (
  SELECT query_id, repo_id, {BUCKET} AS b, sum({SIGN})::DOUBLE AS v
  FROM (SELECT query_id, repo_id,
               unnest({TOKENS.format(x="'Represent this sentence: ' || search_text")}) AS tok FROM ex)
  GROUP BY ALL),
qnorm AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM qvec GROUP BY ALL),
dots AS (
  SELECT q.query_id, c.chunk_id, sum(q.v * c.v) AS dot
  FROM qvec q JOIN cvec c ON c.repo_id = q.repo_id AND c.b = q.b GROUP BY ALL),
dense_all AS (
  SELECT e.query_id, e.repo_id, cn.chunk_id,
         CASE WHEN qn.n > 0 AND cn.n > 0 THEN coalesce(d.dot, 0) / (qn.n * cn.n) ELSE 0 END AS score
  FROM ex e JOIN cnorm cn ON cn.repo_id = e.repo_id JOIN qnorm qn ON qn.query_id = e.query_id
  LEFT JOIN dots d ON d.query_id = e.query_id AND d.chunk_id = cn.chunk_id),
dense_ranked AS (
  SELECT query_id, repo_id, chunk_id, round(score, 6) AS score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) - 1
              AS INTEGER) AS rank
  FROM dense_all)"""


def fused(k: int) -> str:
    return f"""
cand AS (
  SELECT query_id, repo_id, chunk_id, rank AS rd, NULL::INTEGER AS rb FROM dense_ranked WHERE rank < {3 * k}
  UNION ALL
  SELECT query_id, repo_id, chunk_id, NULL::INTEGER, rank FROM bm_top),
fsum AS (
  SELECT query_id, repo_id, chunk_id, min(rd) AS rd, min(rb) AS rb FROM cand GROUP BY ALL),
fscored AS (
  SELECT *, coalesce(1::DOUBLE / (60 + rd), 0.0) + coalesce(1::DOUBLE / (60 + rb), 0.0) AS score
  FROM fsum),
fused AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rd ASC NULLS LAST,
                                    rb ASC NULLS LAST) - 1 AS INTEGER) AS rank,
         CASE WHEN rd IS NOT NULL AND rb IS NOT NULL THEN 'hybrid'
              WHEN rd IS NOT NULL THEN 'dense' ELSE 'bm25' END AS retrieval_method
  FROM fscored QUALIFY rank < {k})"""


HYBRID_BASE = f"""{DOC_CHUNKS}, {BM25_INDEX}, {BENCH_QUERIES}, {expanded('bq', 'query_id', 'question')},
{DENSE}"""

ORACLE["cosine_topk"] = f"""
WITH {HYBRID_BASE}
SELECT query_id, repo_id, chunk_id, score, rank FROM dense_ranked WHERE rank < 24"""
ORACLE["cosine_topk_blocked"] = ORACLE["cosine_topk"]

ORACLE["rrf_hybrid"] = f"""
WITH {HYBRID_BASE}, {bm25_ranked('ex', 'search_text', 18)}, {fused(6)}
SELECT query_id, repo_id, chunk_id, rd, rb, score, rank, retrieval_method FROM fused"""

ORACLE["hybrid_search"] = f"""
WITH {HYBRID_BASE}, {bm25_ranked('ex', 'search_text', 24)}, {fused(8)}
SELECT f.query_id, f.rank, f.repo_id, f.chunk_id, f.retrieval_method, f.score,
       c.file_path, c.chunk_type, c.name, c.start_line, c.end_line, c.language, trim(c.content) AS content
FROM fused f JOIN chunks_e c ON c.repo_id = f.repo_id AND c.chunk_id = f.chunk_id"""

ORACLE["expand_queries"] = f"""
WITH uq AS (SELECT conv_id, turn, text AS question, conv_id * 100000 + turn AS qk
            FROM conversations WHERE role = 'user'),
{expanded('uq', 'qk', 'question')}
SELECT conv_id, turn, search_text FROM ex"""

ORACLE["l2_normalise"] = """
SELECT vec_id,
       list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_sum(list_transform(embedding,
           lambda y: y::DOUBLE * y::DOUBLE))), 6)) AS unit
FROM embeddings"""


# ---------------------------------------------------------------- Python chunker
# The derived Python files, built with the same text as sources.fixtures.py_sources.
DQ3 = "repeat(chr(34), 3)"
SQ3 = "repeat(chr(39), 3)"
PY_FILES = f"""
py_fns AS (
  SELECT s_nationkey AS k, s_suppkey // 100 AS blk,
         string_agg('def supplier_' || CAST(s_suppkey AS VARCHAR) || '(x):' || {NL}
           || '    ' || {DQ3} || 'Supplier ' || s_name || '.' || {DQ3} || {NL}
           || '    total = price_' || CAST(s_suppkey % 7 AS VARCHAR) || '(x)' || {NL}
           || repeat('    total = step(total)' || {NL}, CAST(s_suppkey % 90 AS INTEGER))
           || '    return total' || {NL} || {NL}, '' ORDER BY s_suppkey) AS body
  FROM supplier GROUP BY ALL),
py_files AS (
  SELECT 'region_' || CAST(n_regionkey AS VARCHAR) AS repo_id,
         'src/nation_' || CAST(k AS VARCHAR) || '/block_' || CAST(blk AS VARCHAR) || '.py' AS path,
         CASE WHEN k % 3 = 0 THEN {DQ3} || 'Sources of ' || n_name || '.' || {DQ3} || {NL} ELSE '' END
         || 'import os' || {NL} || '# tools' || {NL} || {NL}
         || 'from region_' || CAST(n_regionkey AS VARCHAR) || ' import tools' || {NL} || {NL}
         || 'class Nation' || CAST(k AS VARCHAR) || '(Base):' || {NL}
         || CASE WHEN k % 2 = 0 THEN '    ' || {DQ3} || n_name || ' records.' || {DQ3} || {NL}
                 ELSE '    ' || {SQ3} || 'Records of' || {NL} || '    ' || n_name || '.' || {NL} || '    ' || {SQ3} || {NL} END
         || {NL} || '    def __init__(self, key):' || {NL} || '        self.key = key' || {NL}
         || '        setup(key, ' || CAST(n_regionkey AS VARCHAR) || ')' || {NL} || {NL}
         || '    def name(self): return ''' || n_name || '''' || {NL} || {NL}
         || '    async def refresh(self):' || {NL} || '        await load_' || CAST(k AS VARCHAR) || '(self.key)'
         || {NL} || '        def inner():' || {NL} || '            return helper()' || {NL}
         || '        return inner' || {NL} || {NL}
         || '@cached' || {NL} || '@app.route(''/x'')' || {NL} || 'async def fetch_' || CAST(k AS VARCHAR) || '(a,' || {NL} || '             b=1):' || {NL}
         || chr(9) || '"Tabs."' || {NL} || chr(9) || 'return tool_' || CAST(k AS VARCHAR) || '(a)' || {NL} || {NL}
         || 'def one_liner(): return 1' || {NL} || {NL} || 'if __name__ == ''__main__'':' || {NL} || '    run()' || {NL} || {NL}
         || body AS source
  FROM py_fns JOIN nation ON n_nationkey = k)"""

PY_BUILTINS_SQL = ("['print', 'len', 'range', 'str', 'int', 'list', 'dict', 'set', 'tuple', 'bool', "
                   "'type', 'isinstance', 'hasattr', 'getattr', 'setattr', 'super', 'zip', 'map', "
                   "'filter', 'enumerate', 'sorted']")


def py_calls_sql(x: str) -> str:
    return (f"list_slice(list_sort(list_filter(list_distinct(regexp_extract_all({x}, "
            f"'\\b([a-zA-Z_][a-zA-Z0-9_]*)\\s*\\(', 1)), lambda c: NOT list_contains({PY_BUILTINS_SQL}, c))), 1, 15)")


# Window form: one row per line; block ends are "next boundary line" windows, the
# enclosing class of a method is the previous column-0 line.
PY_CHUNKS = f"""
pl0 AS (SELECT repo_id, path AS file_path, string_split(source, {NL}) AS p FROM py_files),
pl1 AS (SELECT repo_id, file_path, CASE WHEN p[len(p)] = '' THEN p[1:len(p)-1] ELSE p END AS l FROM pl0),
pln AS (SELECT repo_id, file_path, len(l) AS n, unnest(range(len(l))) AS i, unnest(l) AS line FROM pl1),
pa AS (SELECT *, trim(line, ' ' || chr(9)) AS s, trim(line, ' ' || chr(9)) = '' AS blank, length(line) - length(ltrim(line, ' ' || chr(9))) AS ind FROM pln),
pw AS (
  SELECT *,
    coalesce(min(CASE WHEN NOT blank AND ind = 0 THEN i END) OVER after - 1, n - 1) AS end0,
    coalesce(min(CASE WHEN NOT blank AND ind <= 4 THEN i END) OVER after - 1, n - 1) AS end4,
    max(CASE WHEN NOT blank AND ind = 0 THEN i END) OVER before AS prev0
  FROM pa
  WINDOW after AS (PARTITION BY repo_id, file_path ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
         before AS (PARTITION BY repo_id, file_path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pcls AS (
  SELECT repo_id, file_path, i, end0, regexp_extract(line, '^class\\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS name
  FROM pw WHERE regexp_matches(line, '^class\\s+[A-Za-z_]')),
spans AS (
  SELECT repo_id, file_path, 'class' AS chunk_type, name, i AS s0, least(i + 6, end0) AS e0,
         NULL::VARCHAR AS parent_name, false AS with_calls
  FROM pcls
  UNION ALL
  SELECT repo_id, file_path, 'function', regexp_extract(line, '^(async def|def)\\s+([A-Za-z_][A-Za-z0-9_]*)', 2),
         i, least(end0, i + 79), NULL, true
  FROM pw WHERE regexp_matches(line, '^(async def|def)\\s+[A-Za-z_]')
  UNION ALL
  SELECT m.repo_id, m.file_path, 'method',
         regexp_extract(m.line, '^    (async def|def)\\s+([A-Za-z_][A-Za-z0-9_]*)', 2), m.i, m.end4, c.name, true
  FROM pw m JOIN pcls c ON c.repo_id = m.repo_id AND c.file_path = m.file_path AND c.i = m.prev0
  WHERE regexp_matches(m.line, '^    (async def|def)\\s+[A-Za-z_]') AND m.end4 - m.i + 1 >= 3),
span_text AS (
  SELECT sp.repo_id, sp.file_path, sp.s0, string_agg(a.line, {NL} ORDER BY a.i) AS content
  FROM spans sp JOIN pa a ON a.repo_id = sp.repo_id AND a.file_path = sp.file_path AND a.i BETWEEN sp.s0 AND sp.e0
  GROUP BY ALL),
dcand AS (
  SELECT sp.repo_id, sp.file_path, sp.s0, d.i AS d, d.s, left(d.s, 3) AS q
  FROM spans sp JOIN pa d ON d.repo_id = sp.repo_id AND d.file_path = sp.file_path
                          AND d.i BETWEEN sp.s0 + 1 AND sp.s0 + 4
  WHERE left(d.s, 3) IN ({DQ3}, {SQ3})),
dclose AS (
  SELECT c.repo_id, c.file_path, c.s0, c.d, min(j.i) AS j
  FROM dcand c JOIN pa j ON j.repo_id = c.repo_id AND j.file_path = c.file_path
                        AND j.i BETWEEN c.d + 1 AND c.d + 9 AND contains(j.line, c.q)
  GROUP BY ALL),
dbody AS (
  SELECT c.repo_id, c.file_path, c.s0, c.d, string_agg(trim(b.line), ' ' ORDER BY b.i) AS body
  FROM dclose c JOIN pa b ON b.repo_id = c.repo_id AND b.file_path = c.file_path AND b.i > c.d AND b.i < c.j
  GROUP BY ALL),
dval AS (
  SELECT c.repo_id, c.file_path, c.s0, c.d,
         CASE WHEN (length(c.s) - length(replace(c.s, c.q, ''))) / 3 >= 2 THEN trim(trim(c.s, left(c.q, 1)))
              ELSE trim(CASE WHEN db.body IS NULL THEN ltrim(c.s, left(c.q, 1))
                             ELSE ltrim(c.s, left(c.q, 1)) || ' ' || db.body END) END AS doc,
         (length(c.s) - length(replace(c.s, c.q, ''))) / 3 >= 2 OR dc.j IS NOT NULL AS ok
  FROM dcand c
  LEFT JOIN dclose dc USING (repo_id, file_path, s0, d)
  LEFT JOIN dbody db USING (repo_id, file_path, s0, d)),
dpick AS (
  SELECT repo_id, file_path, s0, arg_min(doc, d) AS docstring FROM dval WHERE ok GROUP BY ALL),
pstop AS (
  SELECT repo_id, file_path,
         coalesce(min(CASE WHEN NOT blank AND NOT starts_with(s, '#') AND NOT starts_with(s, 'import ')
                                AND NOT starts_with(s, 'from ') THEN i END), max(n)) AS stop
  FROM pa GROUP BY ALL),
pimp AS (
  SELECT a.repo_id, a.file_path, count(*) AS cnt, string_agg(a.line, {NL} ORDER BY a.i) AS content,
         list(a.s ORDER BY a.i) AS imports
  FROM pa a JOIN pstop USING (repo_id, file_path)
  WHERE a.i < pstop.stop AND (starts_with(a.s, 'import ') OR starts_with(a.s, 'from '))
  GROUP BY ALL),
py_chunks AS (
  SELECT sp.repo_id, sp.file_path, sp.chunk_type, sp.name, CAST(sp.s0 + 1 AS INTEGER) AS start_line,
         CAST(sp.e0 + 1 AS INTEGER) AS end_line, 'python' AS language, sp.parent_name, dp.docstring,
         CASE WHEN sp.with_calls THEN {py_calls_sql('t.content')} ELSE []::VARCHAR[] END AS calls,
         []::VARCHAR[] AS imports, t.content
  FROM spans sp JOIN span_text t USING (repo_id, file_path, s0)
  LEFT JOIN dpick dp USING (repo_id, file_path, s0)
  UNION ALL
  SELECT repo_id, file_path, 'import_block', 'imports', 1, CAST(cnt AS INTEGER), 'python', NULL, NULL,
         []::VARCHAR[], imports, content
  FROM pimp)"""

ORACLE["py_chunks"] = f"""
WITH {PY_FILES}, {PY_CHUNKS}
SELECT repo_id, file_path || '::' || name || '::' || CAST(start_line AS VARCHAR) AS chunk_id, file_path,
       chunk_type, name, start_line, end_line, language, parent_name, docstring, calls, imports, content
FROM py_chunks"""


# ---------------------------------------------------------------- scan filters, URLs
def _lst(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _lang_case(sfx: str) -> str:
    from codeloom.functions.text import LANGUAGE_BY_EXTENSION
    return "CASE " + sfx + " " + " ".join(f"WHEN '{e}' THEN '{l}'" for e, l in LANGUAGE_BY_EXTENSION.items()) + " END"


def _oracle_paths() -> str:
    from codeloom.functions.text import SKIP_DIRS
    from codeloom.sources.fixtures import PATH_DIRS, PATH_EXTS
    return f"""
WITH pp AS (
  SELECT p_partkey,
         'repo/' || ({_lst(PATH_DIRS)})[p_partkey % {len(PATH_DIRS)} + 1] || '/' || replace(p_name, ' ', '_')
           || ({_lst(PATH_EXTS)})[p_partkey % {len(PATH_EXTS)} + 1] AS path,
         CAST(p_size * 20000 AS BIGINT) AS length
  FROM part),
pl AS (
  SELECT *, lower(regexp_extract(path, '[^/.][^/]*(\\.[^./]+)$', 1)) AS sfx,
         list_has_any(string_split(path, '/'), {_lst(SKIP_DIRS)}) AS skipped
  FROM pp)
SELECT p_partkey, path, {_lang_case('sfx')} AS language, skipped,
       NOT skipped AND length <= 500000 AND {_lang_case('sfx')} IS NOT NULL AS keep
FROM pl"""


ORACLE["language_detect"] = _oracle_paths()

# The names are written out here once more, not taken from the code under test.
ORACLE["scan_sources"] = """
WITH f AS (
  SELECT doc_id % 12 AS k, doc_id::VARCHAR AS i, text FROM documents),
n AS (
  SELECT CASE k WHEN 0 THEN 'src/main_' || i || '.py' WHEN 1 THEN 'src/pages/[id]_' || i || '.tsx' WHEN 2 THEN 'src/a b/' || i || '.js'
                WHEN 3 THEN 'src/Upper_' || i || '.Py' WHEN 4 THEN 'src/__init__' || i || '.py' WHEN 5 THEN 'src/.hidden/' || i || '.JSX'
                WHEN 6 THEN 'src/{a,b}*?_' || i || '.ts' WHEN 11 THEN 'src/x.y/z_' || i || '.c' END AS path,
         CASE k WHEN 1 THEN 'typescript' WHEN 2 THEN 'javascript' WHEN 5 THEN 'javascript' WHEN 6 THEN 'typescript' WHEN 11 THEN 'c' ELSE 'python' END AS language,
         text FROM f WHERE k IN (0, 1, 2, 3, 4, 5, 6, 11))
SELECT 'r' AS repo_id, path, octet_length(encode(text))::BIGINT AS length, language, md5(text) AS source_md5
FROM n WHERE octet_length(encode(text)) <= 500000"""

REPO_URLS = """
u AS (
  SELECT page_id, url FROM pages WHERE url IS NOT NULL
  UNION ALL
  SELECT page_id,
         CASE page_id % 6 WHEN 1 THEN 'https://github.com/' || repo
              WHEN 2 THEN 'https://github.com/' || repo || '.git'
              WHEN 3 THEN 'http://github.com/' || repo || '/'
              WHEN 4 THEN '  gitlab.com/' || repo || ' '
              ELSE 'https://bitbucket.org/' || repo || '//' END AS url
  FROM (SELECT *, regexp_extract(url, '://([^/.]+)', 1) || '/repo' || CAST(page_id AS VARCHAR) AS repo FROM pages) WHERE page_id % 6 <> 0)"""


def _repo_id(x: str) -> str:
    return f"substr(md5(rtrim(regexp_replace({x}, 'https?://', '', 'g'), '/')), 1, 16)"


def _clone_url(x: str) -> str:
    t = f"rtrim(trim({x}), '/')"
    return f"CASE WHEN NOT ends_with({t}, '.git') AND contains({t}, 'github.com') THEN {t} || '.git' ELSE {t} END"


def _valid_url(x: str) -> str:
    t = f"trim({x})"
    return f"({t} <> '' AND (contains({t}, 'github.com') OR contains({t}, 'gitlab.com') OR contains({t}, 'bitbucket')))"


ORACLE["url_functions"] = f"""
WITH {REPO_URLS},
n AS (SELECT *, string_split(regexp_replace(url, '\\.git$', ''), '/') AS parts FROM u)
SELECT page_id, url, {_repo_id('url')} AS repo_id, substr(md5(url), 1, 12) AS job_id,
       {_clone_url('url')} AS clone_url, {_valid_url('url')} AS valid,
       CASE WHEN array_to_string(list_slice(parts, greatest(len(parts) - 1, 1), len(parts)), '/') <> ''
            THEN array_to_string(list_slice(parts, greatest(len(parts) - 1, 1), len(parts)), '/') ELSE url END
         AS repo_name
FROM n"""

ORACLE["question_checks"] = """
WITH v AS (
  SELECT conv_id, turn, unnest([0, 1, 2, 3, 4]) AS variant,
         unnest([text, '  ' || chr(9) || chr(10), 'HTTP 429 Too Many', text || ' RESOURCE_EXHAUSTED', text || chr(160) || 'Rate_Limit']) AS text
  FROM conversations)
SELECT conv_id, turn, variant, regexp_matches(text, '[^ \t\n\r\x0B\x0C\x1C-\x1F\x85\xA0]') AS valid_question,
       regexp_matches(lower(text), '429|quota|rate_limit|resource_exhausted') AS rate_limited
FROM v"""

# ---------------------------------------------------------------- chunk projections, store
PY_CHUNKS_K = f"""{PY_FILES}, {PY_CHUNKS},
pyk AS (SELECT *, file_path || '::' || name || '::' || CAST(start_line AS VARCHAR) AS chunk_id FROM py_chunks)"""

ORACLE["embed_text"] = f"""
WITH {PY_CHUNKS_K}
SELECT repo_id, chunk_id,
       '# ' || language || ' ' || chunk_type || ': ' || name
       || CASE WHEN parent_name IS NOT NULL AND parent_name <> '' THEN ' (in class ' || parent_name || ')' ELSE '' END
       || {NL} || '# File: ' || file_path || ' lines ' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR)
       || CASE WHEN docstring IS NOT NULL AND docstring <> '' THEN {NL} || '# Doc: ' || left(docstring, 200) ELSE '' END
       || {NL} || {NL} || content AS embed_text,
       file_path || ':' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR) AS display_location
FROM pyk"""

ORACLE["flat_metadata"] = f"""
WITH {PY_CHUNKS_K}
SELECT repo_id, chunk_id, file_path, chunk_type, name, start_line, end_line, language,
       coalesce(parent_name, '') AS parent_name, left(coalesce(docstring, ''), 500) AS docstring,
       array_to_string(calls[1:20], ',') AS calls
FROM pyk"""

ORACLE["flat_round_trip"] = f"""
WITH {PY_CHUNKS_K}
SELECT repo_id, chunk_id, file_path, chunk_type, name, start_line, end_line, language, nullif(parent_name, '') AS parent_name,
       nullif(left(coalesce(docstring, ''), 500), '') AS docstring,
       CASE WHEN len(calls) = 0 THEN []::VARCHAR[] ELSE string_split(array_to_string(calls[1:20], ','), ',') END AS calls,
       regexp_replace(regexp_replace('# Header' || {NL}
           || CASE WHEN docstring IS NOT NULL AND docstring <> '' THEN '# Doc: ' || left(docstring, 200) ELSE '#' END
           || {NL} || {NL} || content, '^(#[^\n]*\n)*', ''), '^\\s+|\\s+$', '', 'g') AS content
FROM pyk"""

ORACLE["repo_info"] = f"""
WITH {DOC_CHUNKS}
SELECT repo_id, count(*) AS total_chunks, CASE WHEN count(*) > 0 THEN 'ready' ELSE 'not_indexed' END AS status
FROM chunks_e GROUP BY repo_id"""

ORACLE["upsert_last_wins"] = f"""
WITH {DOC_CHUNKS},
u AS (SELECT repo_id, chunk_id, content, 0 AS side FROM chunks_e
      UNION ALL
      SELECT repo_id, chunk_id, lower(content), 1 FROM chunks_e
      UNION ALL
      SELECT * FROM (SELECT repo_id || CASE WHEN length(lower(content)) % 2 = 0 THEN '/fork' ELSE '' END AS repo_id, 'new/' || chunk_id,
                            lower(content), 1 FROM chunks_e))
SELECT repo_id, chunk_id, content FROM u
QUALIFY row_number() OVER (PARTITION BY repo_id, chunk_id ORDER BY side DESC) = 1"""


# ---------------------------------------------------------------- context, prompts, citations
def results_sql(k: int) -> str:
    """``res``: hybrid-search results with chunk rows, as ``hybrid_search`` returns them."""
    return f"""{HYBRID_BASE}, {bm25_ranked('ex', 'search_text', 3 * k)}, {fused(k)},
res AS (
  SELECT f.query_id, f.rank, f.retrieval_method, c.file_path, c.chunk_type, c.name, c.start_line, c.end_line,
         c.language, NULL::VARCHAR AS parent_name, NULL::VARCHAR AS docstring, trim(c.content) AS content
  FROM fused f JOIN chunks_e c ON c.repo_id = f.repo_id AND c.chunk_id = f.chunk_id)"""


CONTEXT = f"""
blk AS (
  SELECT query_id, rank, file_path, name,
         'LOCATION: [' || file_path || ':' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR) || ']'
         || {NL} || 'TYPE: ' || upper(chunk_type) || ': ' || name
         || CASE WHEN parent_name <> '' THEN ' (in ' || parent_name || ')' ELSE '' END
         || CASE WHEN docstring <> '' THEN {NL} || 'DOC: ' || left(docstring, 150) ELSE '' END
         || {NL} || '```' || language || {NL} || content || {NL} || '```' AS block
  FROM res),
fidx AS (SELECT query_id, file_path, min(rank) AS r0, string_agg(name, ', ' ORDER BY rank) AS names FROM blk GROUP BY ALL),
idx AS (SELECT query_id, string_agg('  ' || file_path || ': ' || names, {NL} ORDER BY r0) AS idx FROM fidx GROUP BY ALL),
body AS (SELECT query_id, string_agg(block, {NL} || {NL} ORDER BY rank) AS body FROM blk GROUP BY ALL),
ctx AS (
  SELECT query_id, 'REFERENCED FILES:' || {NL} || idx || {NL} || {NL} || repeat('=', 60) || {NL} || {NL} || body
         AS context
  FROM idx JOIN body USING (query_id))"""

ORACLE["build_context"] = f"""
WITH {results_sql(6)}, {CONTEXT}
SELECT query_id, context FROM ctx"""

ORACLE["history_last4"] = """
SELECT conv_id, turn, role, text FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4"""


def _build_prompts() -> str:
    from codeloom.operators.context import NOT_INDEXED, NOTHING_FOUND, SYSTEM_PROMPT
    sp = SYSTEM_PROMPT.replace("ASSISTANT_NAME", "a code assistant").replace("'", "''")
    msg = "STRUCT(role VARCHAR, content VARCHAR)"
    return f"""
WITH {results_sql(6)}, {CONTEXT},
sizes AS (SELECT repo_id, count(*) AS n_chunks FROM chunks_e GROUP BY ALL),
hist AS (
  SELECT conv_id AS query_id, list({{'role': role, 'content': text}}::{msg} ORDER BY turn) AS h
  FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4)
  GROUP BY ALL),
pr AS (
  SELECT q.query_id,
         CASE WHEN coalesce(s.n_chunks, 0) = 0 THEN '{NOT_INDEXED}'
              WHEN c.context IS NULL THEN '{NOTHING_FOUND}' END AS reply,
         list_concat([{{'role': 'system', 'content': '{sp}'}}::{msg}], coalesce(h.h, []::{msg}[]),
                     [{{'role': 'user', 'content': 'CODEBASE CONTEXT:' || {NL} || {NL} || c.context || {NL} || {NL}
                        || repeat('=', 60) || {NL} || {NL} || 'QUESTION: ' || q.question}}::{msg}]) AS msgs
  FROM (FROM bq UNION ALL SELECT -1, 'no such repository', 'where' UNION ALL SELECT -2, (SELECT min(source) FROM documents), '  ') q
  LEFT JOIN ctx c USING (query_id) LEFT JOIN sizes s USING (repo_id) LEFT JOIN hist h USING (query_id))
SELECT query_id, reply, CAST(i AS INTEGER) AS msg_pos, msgs[i + 1].role AS role, msgs[i + 1].content AS content
FROM pr, range(len(msgs)) t(i) WHERE reply IS NULL
UNION ALL
SELECT query_id, reply, NULL, NULL, NULL FROM pr WHERE reply IS NOT NULL"""


ORACLE["build_prompts"] = _build_prompts()
# The single-message form: no history, the system prompt ahead of the user's text.
ORACLE["build_prompts_single"] = _build_prompts().replace(
    "list_concat([{'role': 'system', 'content': '", "list_concat([]::STRUCT(role VARCHAR, content VARCHAR)[], [{'role': 'user', 'content': '").replace(
    "'}::STRUCT(role VARCHAR, content VARCHAR)], coalesce(h.h, []::STRUCT(role VARCHAR, content VARCHAR)[]),", "' || {NL} || {NL} ||".replace("{NL}", NL)).replace(
    "[{'role': 'user', 'content': 'CODEBASE CONTEXT:'", "'CODEBASE CONTEXT:'")

ORACLE["client_history"] = """
SELECT conv_id, turn, role, text FROM conversations WHERE NOT (turn = 0 AND role = 'assistant')
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6"""

ORACLE["to_sources"] = f"""
WITH {results_sql(6)}
SELECT query_id,
       CAST(to_json(list({{'file': file_path, 'start': start_line, 'end': end_line, 'name': name,
                           'type': chunk_type, 'method': retrieval_method}} ORDER BY rank)) AS VARCHAR) AS sources_json
FROM res GROUP BY query_id"""


ANSWERS = f"""
a AS (
  SELECT conv_id * 1000 + turn AS msg_id,
         'The answer is in `' || f || '`. '
         || CASE turn % 4
              WHEN 0 THEN '• File: `' || f || '` ' || cite || {NL} || '* Calls ' || text
              WHEN 1 THEN 'It works. 1. First point ' || cite || '. 2) Second point. ' || text
              WHEN 2 THEN '## Details' || {NL} || 'Entry point: ' || text || ' — see ' || cite
              ELSE text || {NL} || '```python' || {NL} || 'def f():' || {NL} || '    return 1' || {NL} || '```' || {NL}
                   || 'Note: done ' || cite END
         || CASE conv_id % 3
              WHEN 0 THEN {NL} || {NL} || '[SOURCES][' || payload || ', ' || payload || '][/SOURCES]'
              WHEN 1 THEN {NL} || {NL} || '[SOURCES][{{"file": broken[/SOURCES]'
              ELSE '' END AS text
  FROM (SELECT *, 'src/mod_' || CAST(conv_id AS VARCHAR) || '.py' AS f,
               '[src/mod_' || CAST(conv_id AS VARCHAR) || '.py:' || CAST(turn + 1 AS VARCHAR) || '-'
                 || CAST(turn + 10 AS VARCHAR) || ']' AS cite,
               '{{"file": "src/mod_' || CAST(conv_id AS VARCHAR) || '.py", "start": ' || CAST(turn + 1 AS VARCHAR)
                 || ', "end": ' || CAST(turn + 10 AS VARCHAR) || ', "name": "fn_' || CAST(turn AS VARCHAR)
                 || '", "type": "function", "method": "hybrid"}}' AS payload
        FROM conversations WHERE role = 'assistant'))"""

SRC_RE = "(?s)\\[SOURCES\\](.*?)\\[/SOURCES\\]"
SRC_SCHEMA = ('[{"file":"VARCHAR","start":"INTEGER","end":"INTEGER","name":"VARCHAR","type":"VARCHAR",'
              '"method":"VARCHAR"}]')

ORACLE["parse_sources"] = f"""
WITH {ANSWERS},
p AS (SELECT msg_id, regexp_extract(text, '{SRC_RE}', 1) AS payload FROM a WHERE regexp_matches(text, '{SRC_RE}')),
j AS (SELECT msg_id, from_json(payload, '{SRC_SCHEMA}') AS l FROM p WHERE json_valid(payload)),
e AS (SELECT msg_id, unnest(range(len(l))) AS pos, unnest(l) AS s FROM j)
SELECT msg_id, CAST(pos AS INTEGER) AS pos, s.file AS file, s.start AS start, s."end" AS "end", s.name AS name,
       s.type AS type, s.method AS method
FROM e"""


# Answer clean-up.  RE2 knows neither look-arounds nor Java's Unicode classes: white space is spelled
# out, the character that a look-ahead asks for is captured and put back, and the look-behind is left
# out, as a match that begins at the first blank of a run never follows a line break.  The fold over
# lines is a state machine that takes one line of every answer a step.
_WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIPPED = "||".join(f"chr({ord(c)})" for c in WS_CHARS)
_ANSWER_RULES = [
    (f"•{_WS}*", "'- '"),
    (f"[·‣]{_WS}*", "'- '"),
    (rf"(^|\n)({_WS}*)[*+]{_WS}+", r"'\1\2- '"),
    (f"([.!?]){_WS}+(-{_WS}+)", rf"'\1' || {NL} || '\2'"),
    (rf"{_WS}+-{_WS}+([A-Z`\[*])", rf"{NL} || '- \1'"),
    (rf"([.!?]){_WS}+\p{{Nd}}+[.)]{_WS}+", rf"'\1' || {NL} || '- '"),
    (f"([.!?]){_WS}+([A-Z][A-Za-z ]{{1,22}}: )", rf"'\1' || {NL} || '- \2'"),
    (f"(?m)^{_WS}*([A-Z][A-Za-z ]{{1,22}}: )", r"'- \1'"),
]


def _stripped(x: str) -> str:
    return f"trim({x}, {_STRIPPED})"


def _titled(x: str) -> str:
    """Upper case where the character before has no case, else lower case."""
    here, before = f"substr({x}, CAST(i AS BIGINT), 1)", f"substr({x}, CAST(i - 1 AS BIGINT), 1)"
    return (f"array_to_string([CASE WHEN i > 1 AND lower({before}) <> upper({before}) THEN lower({here}) ELSE upper({here}) END"
            f" FOR i IN range(1, length({x}) + 1)], '')")


_ruled = f"replace(replace({_stripped('text')}, chr(13) || chr(10), {NL}), chr(13), {NL})"
for _pattern, _put in _ANSWER_RULES:
    _ruled = f"regexp_replace({_ruled}, '{_pattern}', {_put}, 'g')"
_NUMBERED, _HEADER = rf"^\p{{Nd}}+[.)]{_WS}+(.*)", f"^#{{1,3}}{_WS}+(.*)"
_LABEL = rf"^\*{{0,2}}([A-Za-z](?:[A-Za-z]|{_WS}){{0,20}})\*{{0,2}}:{_WS}+(.*)"

ORACLE["normalise_answers"] = f"""
WITH RECURSIVE {ANSWERS},
t AS (SELECT msg_id, text, [rtrim(x, {_STRIPPED}) FOR x IN string_split({_ruled}, {NL})] AS l FROM a),
f AS (SELECT *, list_position([{_stripped('x')} <> '' FOR x IN l], true) AS first FROM t),
b AS (SELECT msg_id, text, CASE WHEN first > 0 THEN {_stripped('l[first]')} ELSE '' END AS summary,
             CASE WHEN first > 0 THEN l[first + 1:] ELSE [] END AS rest FROM f),
r AS (SELECT msg_id, unnest(range(1, len(rest) + 1)) AS i, {_stripped('unnest(rest)')} AS s FROM b),
x AS (SELECT *, {_stripped(f"regexp_extract(s, '{_LABEL}', 1)")} AS lab FROM r),
k AS (SELECT msg_id, i, s,
             CASE WHEN s = '' THEN NULL
                  WHEN starts_with(s, '- ') THEN s
                  WHEN regexp_matches(s, '{_NUMBERED}') THEN '- ' || regexp_extract(s, '{_NUMBERED}', 1)
                  WHEN regexp_matches(s, '{_HEADER}') THEN '- **' || {_stripped(f"regexp_extract(s, '{_HEADER}', 1)")} || '**'
                  WHEN length(lab) BETWEEN 2 AND 22 THEN '- **' || {_titled('lab')} || ':** ' || {_stripped(f"regexp_extract(s, '{_LABEL}', 2)")}
             END AS own
      FROM x),
fold AS (
  SELECT msg_id, 0 AS i, CAST([] AS VARCHAR[]) AS done, '' AS cur FROM b
  UNION ALL
  SELECT msg_id, k.i,
         CASE WHEN s = '' OR own IS NULL AND cur <> '' AND length(cur) < 120 OR cur = '' THEN done ELSE list_append(done, cur) END,
         CASE WHEN s = '' THEN cur
              WHEN own IS NOT NULL THEN own
              WHEN cur <> '' AND length(cur) < 120 THEN cur || ' ' || s
              WHEN length(s) > 8 THEN '- ' || s ELSE '' END
  FROM fold JOIN k USING (msg_id) WHERE k.i = fold.i + 1),
e AS (SELECT msg_id, text, summary, unnest(range(1, 7)) AS n,
             unnest((CASE WHEN cur <> '' THEN list_append(done, cur) ELSE done END)[1:6]) AS bullet
      FROM fold JOIN b USING (msg_id) WHERE fold.i = len(rest)),
c AS (SELECT msg_id, n, {_stripped('substr(bullet, 3)')} AS c FROM e WHERE bullet IS NOT NULL),
g AS (SELECT msg_id, n, '- ' || CASE
               WHEN regexp_matches(c, '^\\*\\*[^*]+\\*\\*') THEN c
               WHEN instr(c, ':') BETWEEN 2 AND 22 AND left(c, 1) NOT IN ('[', '`')
                 THEN '**' || {_titled(_stripped("substr(c, 1, instr(c, ':') - 1)"))} || ':** ' || {_stripped("substr(c, instr(c, ':') + 1)")}
               WHEN instr(c, ' — ') > 0
                 THEN '**' || {_stripped("substr(c, 1, instr(c, ' — ') - 1)")} || '** — ' || {_stripped("substr(c, instr(c, ' — ') + 3)")}
               ELSE c END AS bullet
      FROM c),
j AS (SELECT msg_id, string_agg(bullet, {NL} ORDER BY n) AS bullets FROM g GROUP BY msg_id)
SELECT msg_id, CASE WHEN text IS NULL OR {_stripped('text')} = '' THEN text
                    WHEN bullets IS NULL THEN summary ELSE summary || {NL} || {NL} || bullets END AS formatted
FROM b LEFT JOIN j USING (msg_id)"""

WSC = "' ' || chr(10) || chr(9) || chr(13)"

ORACLE["reassemble_fragments"] = f"""
WITH c AS (SELECT * FROM conversations WHERE role = 'assistant'),
w AS (SELECT conv_id * 1000 + turn AS msg_id, conv_id, string_split(text, ' ') AS ws FROM c),
frag AS (
  SELECT msg_id, CAST(i AS INTEGER) AS seq,
         replace(CASE WHEN i < len(ws) - 1 THEN ws[i + 1] || ' ' ELSE ws[i + 1] END, {NL}, '\\n') AS data
  FROM w, range(len(ws)) t(i)
  UNION ALL
  SELECT msg_id, 100000, '[ERROR]quota exceeded (429)[/ERROR]' FROM w WHERE conv_id % 4 = 0
  UNION ALL
  SELECT msg_id, 100001, '[SOURCES][{{"file": "src/mod_' || CAST(conv_id AS VARCHAR)
         || '.py", "start": 1, "end": 9, "name": "f", "type": "function", "method": "dense"}}][/SOURCES]'
  FROM w WHERE conv_id % 3 = 0),
tagged AS (
  SELECT msg_id,
         list(CASE WHEN regexp_matches(data, '{SRC_RE}') THEN 'S' || data
                   WHEN contains(data, '[ERROR]') THEN 'E' || regexp_replace(data, '\\[ERROR\\]|\\[/ERROR\\]', '', 'g')
                   ELSE 'T' || replace(data, '\\n', {NL}) END ORDER BY seq) AS l,
         max(CASE WHEN regexp_matches(data, '{SRC_RE}') THEN regexp_extract(data, '{SRC_RE}', 1) END) AS src
  FROM frag GROUP BY msg_id)
SELECT msg_id,
       trim(regexp_replace(substr(list_reduce(list_prepend('T', l), lambda acc, x:
              CASE WHEN left(x, 1) = 'S' THEN 'T' || trim(regexp_replace(substr(acc, 2), '{SRC_RE}', '', 'g'), {WSC})
                   WHEN left(x, 1) = 'E' THEN acc || {NL} || '⚠️ ' || substr(x, 2)
                   ELSE acc || substr(x, 2) END), 2), '{SRC_RE}', '', 'g'), {WSC}) AS text,
       src AS sources_json
FROM tagged"""

ORACLE["extract_citations"] = f"""
WITH {ANSWERS}
SELECT msg_id, regexp_extract_all(text, '\\[([^\\]]+\\.\\w+[:\\d][^\\]]{{0,30}})\\]', 1) AS citations FROM a"""

FENCE = "```(\\w*)\\n?([\\s\\S]*?)```"

ORACLE["extract_code"] = f"""
WITH {ANSWERS},
b AS (SELECT msg_id, regexp_extract_all(text, '{FENCE}', 1) AS langs, regexp_extract_all(text, '{FENCE}', 2) AS codes
      FROM a)
SELECT msg_id, CAST(i AS INTEGER) AS pos, langs[i + 1] AS lang, trim(codes[i + 1], {WSC}) AS code
FROM b, range(len(langs)) t(i)"""


# ---------------------------------------------------------------- evaluation, jobs
EVAL = f"""{results_sql(8).replace(BENCH_QUERIES, ANSWERABLE)},
rel AS (SELECT b.item_id AS query_id, '/doc_' || CAST(d.doc_id AS VARCHAR) || '.txt' AS symbol
        FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
srcs AS (SELECT query_id, rank AS pos, file_path AS file, name FROM res),
hits AS (
  SELECT r.query_id, min(s.pos) + 1 AS hit_rank
  FROM rel r JOIN srcs s ON s.query_id = r.query_id AND s.pos < 5
                         AND (contains(lower(s.name), lower(r.symbol)) OR contains(lower(s.file), lower(r.symbol)))
  GROUP BY ALL),
per_q AS (SELECT b.item_id AS query_id, CAST(h.hit_rank AS INTEGER) AS hit_rank
          FROM benchmark b LEFT JOIN hits h ON h.query_id = b.item_id)"""

ORACLE["eval_hits"] = f"""
WITH {EVAL}
SELECT query_id, hit_rank FROM per_q"""

ORACLE["eval_metrics"] = f"""
WITH {EVAL},
m AS (SELECT count(*) AS n, sum(CASE WHEN hit_rank = 1 THEN 1 ELSE 0 END) AS h1,
             sum(CASE WHEN hit_rank <= 3 THEN 1 ELSE 0 END) AS h3, sum(CASE WHEN hit_rank <= 5 THEN 1 ELSE 0 END) AS h5,
             sum(CASE WHEN hit_rank IS NOT NULL THEN 1.0 / hit_rank ELSE 0.0 END) AS rr
      FROM per_q)
SELECT n, CAST(h1 AS BIGINT) AS hits_at_1, CAST(h3 AS BIGINT) AS hits_at_3, CAST(h5 AS BIGINT) AS hits_at_5,
       round(h1 / n, 6) AS hit_at_1, round(h3 / n, 6) AS hit_at_3, round(h5 / n, 6) AS hit_at_5,
       round(rr / n, 6) AS mrr_at_5
FROM m"""

ORACLE["eval_report"] = f"""
WITH {EVAL},
top AS (SELECT query_id, string_agg(file || '#' || name, ',' ORDER BY pos) AS sources FROM srcs WHERE pos < 5 GROUP BY query_id),
total AS (SELECT count(*) AS n, sum(CASE WHEN hit_rank <= 5 THEN 1 ELSE 0 END)::BIGINT AS hits_at_5,
                 round(sum(CASE WHEN hit_rank IS NOT NULL THEN 1.0 / hit_rank ELSE 0.0 END) / count(*), 6) AS mrr_at_5 FROM per_q)
SELECT p.query_id, b.text AS question, p.hit_rank, coalesce(t.sources, '') AS sources,
       (SELECT count(*) FROM documents) AS total_chunks, total.n, total.hits_at_5, total.mrr_at_5
FROM per_q p JOIN benchmark b ON b.item_id = p.query_id LEFT JOIN top t ON t.query_id = p.query_id, total"""

ORACLE["pending_ingests"] = f"""
WITH {REPO_URLS},
log AS (
  SELECT substr(md5(trim(u.url)), 1, 12) AS job_id,
         CASE e.event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'cloning' WHEN 'signup' THEN 'indexing'
                           WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' END AS status,
         e.ts, e.event_id AS seq
  FROM events e JOIN u ON e.user_id = u.page_id),
latest AS (SELECT job_id, status FROM log QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) = 1),
req AS (SELECT trim(url) AS url FROM u WHERE {_valid_url('url')})
SELECT substr(md5(url), 1, 12) AS job_id, url, {_repo_id('url')} AS repo_id, {_clone_url('url')} AS clone_url
FROM req
WHERE substr(md5(url), 1, 12) NOT IN (SELECT job_id FROM latest WHERE status IN ('done', 'cloning', 'chunking', 'indexing'))"""

ORACLE["job_progress"] = """
WITH b AS (SELECT user_id AS job_id, event_id AS batch_id, event_id % 8 + 1 AS n_chunks FROM events),
r AS (SELECT job_id, batch_id,
             sum(n_chunks) OVER (PARTITION BY job_id ORDER BY batch_id ROWS UNBOUNDED PRECEDING) AS indexed,
             sum(n_chunks) OVER (PARTITION BY job_id) AS total
      FROM b)
SELECT job_id, batch_id, CAST(indexed AS BIGINT) AS indexed, CAST(total AS BIGINT) AS total,
       CAST(45 + floor(54 * indexed / total) AS INTEGER) AS progress
FROM r"""


ORACLE["ivf_topk"] = f"""
WITH {BENCH_QUERIES},
qtok AS (SELECT query_id, unnest({TOKENS.format(x="'Represent this sentence: ' || question")}) AS tok FROM bq),
qv AS (SELECT query_id, {BUCKET} AS b, sum({SIGN})::DOUBLE AS v FROM qtok GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM qv GROUP BY ALL),
en AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
dots AS (SELECT q.query_id, e.vec_id, sum(q.v * e.embedding[q.b + 1]::DOUBLE) AS dot
         FROM qv q CROSS JOIN embeddings e GROUP BY ALL),
sc AS (SELECT d.query_id, d.vec_id, round(d.dot / (qn.n * en.n), 6) AS score
       FROM dots d JOIN qn USING (query_id) JOIN en USING (vec_id))
SELECT query_id, vec_id, score,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS INTEGER) AS rank
FROM sc QUALIFY rank < 10"""

CURRENT = f"""{PY_FILES}, {PY_CHUNKS}, {DOC_CHUNKS},
cur AS (
  SELECT repo_id, file_path || '::' || name || '::' || CAST(start_line AS VARCHAR) AS chunk_id, file_path,
         chunk_type, name, start_line, end_line, language, parent_name, docstring, calls, imports, content
  FROM py_chunks
  UNION ALL
  SELECT repo_id, chunk_id, file_path, chunk_type, name, start_line, end_line, language, NULL, NULL, []::VARCHAR[], []::VARCHAR[], content
  FROM chunks_e)"""

ORACLE["stream_ingest"] = f"WITH {CURRENT} SELECT * FROM cur"

ORACLE["stream_progress"] = f"""
WITH {CURRENT}
SELECT repo_id AS job_id, count(*) AS indexed, count(*) AS total, 99 AS progress FROM cur GROUP BY repo_id"""

ORACLE["bm25_blockmax"] = ORACLE["bm25_topk"]

# ---------------------------------------------------------------- the index as a living table
ORACLE["living_search"] = ORACLE["hybrid_search"]

ORACLE["living_compacted"] = ORACLE["term_idf"]

EDITED = f"""{DOC_CHUNKS},
low AS (SELECT repo_id, chunk_id, start_line, lower(content) AS content FROM chunks_e),
edited AS (
  SELECT repo_id, chunk_id, content FROM low WHERE start_line % 100 = 1
  UNION ALL
  SELECT repo_id || CASE WHEN length(content) % 2 = 0 THEN '/fork' ELSE '' END, 'new/' || chunk_id, content FROM low)"""

ORACLE["living_upsert"] = f"""
WITH {EDITED}
SELECT * FROM edited
UNION ALL
SELECT repo_id, chunk_id, content FROM chunks_e c
WHERE NOT EXISTS (SELECT 1 FROM edited e WHERE e.repo_id = c.repo_id AND e.chunk_id = c.chunk_id)"""

ORACLE["living_replace"] = f"""
WITH {EDITED}
SELECT * FROM edited WHERE length(repo_id) % 2 = 0
UNION ALL
SELECT repo_id, chunk_id, content FROM chunks_e
WHERE repo_id NOT IN (SELECT repo_id FROM edited WHERE length(repo_id) % 2 = 0)"""

# ---------------------------------------------------------------- golden questions over code
CODE_CHUNKS = f"""{PY_CHUNKS_K},
chunks_e AS (
  SELECT *, '# ' || language || ' ' || chunk_type || ': ' || name
       || CASE WHEN parent_name <> '' THEN ' (in class ' || parent_name || ')' ELSE '' END
       || {NL} || '# File: ' || file_path || ' lines ' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR)
       || CASE WHEN docstring <> '' THEN {NL} || '# Doc: ' || left(docstring, 200) ELSE '' END
       || {NL} || {NL} || content AS embed_text FROM pyk)"""

# The golden questions and symbols, written out once more.
GOLDEN = """
gq(g, question, syms) AS (VALUES
  (1, 'How does the application handle HTTP request routing?', ['route', 'add_url_rule', 'dispatch_request', 'Router']),
  (2, 'Where is authentication or login handled?', ['login', 'authenticate', 'auth', 'token', 'session']),
  (3, 'How are errors and exceptions handled globally?', ['errorhandler', 'handle_exception', 'error_handler', 'HTTPException']),
  (4, 'How does the application connect to the database?', ['connect', 'engine', 'session', 'database', 'db']),
  (5, 'Where is middleware or request preprocessing done?', ['middleware', 'before_request', 'after_request', 'dispatch']),
  (6, 'How is configuration loaded and managed?', ['config', 'Config', 'from_object', 'settings', 'load_config']),
  (7, 'How does the app handle static files and templates?', ['render_template', 'send_file', 'static', 'template']),
  (8, 'How are background tasks or async jobs handled?', ['async', 'task', 'background', 'worker', 'celery', 'queue'])),
bq AS (
  SELECT g * 1000 + n_regionkey AS query_id, 'region_' || CAST(n_regionkey AS VARCHAR) AS repo_id, question, syms
  FROM gq, (SELECT DISTINCT n_regionkey FROM nation))"""


def _golden(sql: str) -> str:
    return (sql.replace(DOC_CHUNKS, CODE_CHUNKS).replace(BENCH_QUERIES, GOLDEN)
            .replace("NULL::VARCHAR AS parent_name, NULL::VARCHAR AS docstring", "c.parent_name, nullif(left(c.docstring, 500), '') AS docstring")
            .replace("trim(c.content)", f"trim(c.content, {WSC})"))


ORACLE["golden_context"] = _golden(ORACLE["build_context"])

ORACLE["golden_hits"] = _golden(f"""
WITH {results_sql(6)},
hit AS (SELECT q.query_id, min(r.rank) + 1 AS hit_rank
        FROM (SELECT query_id, unnest(syms) AS sym FROM bq) q JOIN res r USING (query_id)
        WHERE r.rank < 5 AND (contains(lower(r.name), lower(sym)) OR contains(lower(r.file_path), lower(sym))) GROUP BY ALL)
SELECT bq.query_id, CAST(hit_rank AS INTEGER) AS hit_rank FROM bq LEFT JOIN hit USING (query_id)""")

ORACLE["ivf_recall"] = """
SELECT count(*) AS n_queries, 10 AS k, true AS recall_reached FROM embeddings WHERE vec_id % 20 = 0"""

# ---------------------------------------------------------------- JavaScript chunker
JS_BUILTINS_SQL = ("['console', 'log', 'error', 'warn', 'JSON', 'Object', 'Array', 'Promise', 'resolve', 'reject', 'then', 'catch', "
                   "'map', 'filter', 'forEach', 'reduce', 'parseInt', 'parseFloat', 'setTimeout']")
JS_FN = r"^(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)"
JS_VAR = r"^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:async\s+)?\("
JS_CLASS = r"^(?:export\s+default\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)"
JS_REQUIRE = r"^import\s+|^const\s+\w+\s*=\s*require"
JS_CALL = r"\b([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\("

# Running brace sums per candidate as a window over its 100 lines; the greedy left-to-right
# pick is a recursion from one kept declaration to the first that begins behind it.
JS_CHUNKS = f"""
js_fns AS (
  SELECT s_nationkey AS k, s_suppkey // 100 AS blk, string_agg('export const supplier_' || s_suppkey || ' = async (x) => {{' || {NL}
         || '  return fetch_' || s_suppkey || '(x);' || {NL} || '}};' || {NL}, '' ORDER BY s_suppkey) AS body
  FROM supplier GROUP BY ALL),
js_files AS (
  SELECT 'region_' || n_regionkey AS repo_id,
         'web/nation_' || k || '/block_' || blk || CASE WHEN k % 4 = 1 THEN '.ts' ELSE '.js' END AS file_path,
         'import tools from ''region_' || n_regionkey || ''';' || {NL} || 'const util = require(''util'');' || {NL}
         || 'function nation' || k || '() {{ return ' || k || '; }}' || {NL}
         || 'class Nation' || k || ' extends Base {{' || {NL} || '  constructor() {{' || {NL} || '    super();' || {NL} || '  }}' || {NL} || '}}' || {NL}
         || 'export default function main() {{' || {NL} || '  run();' || {NL} || '}}' || {NL} || 'export class Skip {{' || {NL} || '  m() {{}}' || {NL} || '}}' || {NL}
         || 'async function wide' || k || '(a,' || {NL} || '  b) {{' || {NL} || repeat('  step(a);' || {NL}, (k % 6 + 94)::INTEGER) || '}}' || {NL}
         || 'let text' || k || ' = (s) => {{' || {NL} || '  return ''}}'' + s;' || {NL} || '  // }}' || {NL} || '}};' || {NL}
         || chr(9) || 'function inner() {{' || {NL} || chr(9) || chr(9) || 'x();' || {NL} || chr(9) || '}}' || {NL}
         || 'export const typed' || k || ' = async (a: Map<string, {{n: number}}>): Promise<void> => {{' || {NL} || '  await $(a);' || {NL} || '}};' || {NL}
         || body AS source
  FROM js_fns JOIN nation ON n_nationkey = k),
jl0 AS (SELECT repo_id, file_path, string_split(source, {NL}) AS l FROM js_files),
jl1 AS (SELECT repo_id, file_path, CASE WHEN l[len(l)] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM jl0),
jl AS (SELECT repo_id, file_path, l, unnest(range(len(l))) AS i FROM jl1),
jt AS (SELECT repo_id, file_path, i, l[i + 1] AS t,
              len(l[i + 1]) - len(replace(l[i + 1], '{{', '')) - len(l[i + 1]) + len(replace(l[i + 1], '}}', '')) AS delta FROM jl),
jc AS (
  SELECT repo_id, file_path, i, CASE WHEN regexp_matches(t, '{JS_FN}') OR regexp_matches(t, '{JS_VAR}') THEN 'function' ELSE 'class' END AS chunk_type,
         CASE WHEN regexp_matches(t, '{JS_FN}') THEN regexp_extract(t, '{JS_FN}', 1) WHEN regexp_matches(t, '{JS_VAR}') THEN regexp_extract(t, '{JS_VAR}', 1)
              ELSE regexp_extract(t, '{JS_CLASS}', 1) END AS name
  FROM jt WHERE regexp_matches(t, '{JS_FN}') OR regexp_matches(t, '{JS_VAR}') OR regexp_matches(t, '{JS_CLASS}')),
jd AS (SELECT c.repo_id, c.file_path, c.i, t.i AS k, sum(t.delta) OVER w AS depth
       FROM jc c JOIN jt t ON t.repo_id = c.repo_id AND t.file_path = c.file_path AND t.i BETWEEN c.i AND c.i + 99
       WINDOW w AS (PARTITION BY c.repo_id, c.file_path, c.i ORDER BY t.i)),
jm AS (SELECT *, max(depth) OVER (PARTITION BY repo_id, file_path, i ORDER BY k) AS deepest FROM jd),
je AS (SELECT repo_id, file_path, i, min(k) AS e FROM jm WHERE deepest > 0 AND depth <= 0 GROUP BY ALL),
jv AS (SELECT c.*, je.e FROM jc c JOIN je USING (repo_id, file_path, i) WHERE je.e - c.i + 1 >= 3),
jn AS (SELECT a.repo_id, a.file_path, a.i, min(b.i) AS nxt
       FROM jv a JOIN jv b ON a.repo_id = b.repo_id AND a.file_path = b.file_path AND b.i > a.e GROUP BY ALL),
jk AS (
  SELECT repo_id, file_path, min(i) AS i FROM jv GROUP BY ALL
  UNION ALL
  SELECT n.repo_id, n.file_path, n.nxt FROM jk k JOIN jn n ON n.repo_id = k.repo_id AND n.file_path = k.file_path AND n.i = k.i),
js_bodies AS (
  SELECT v.repo_id, v.file_path, v.chunk_type, v.name, v.i + 1 AS start_line, v.e + 1 AS end_line,
         array_to_string(l.l[v.i + 1 : v.e + 1], {NL}) AS content
  FROM jk k JOIN jv v USING (repo_id, file_path, i) JOIN jl1 l ON l.repo_id = v.repo_id AND l.file_path = v.file_path
  UNION ALL
  SELECT repo_id, file_path, 'import_block', 'imports', 1, count(*), string_agg(t, {NL} ORDER BY i)
  FROM jt WHERE regexp_matches(t, '{JS_REQUIRE}') GROUP BY ALL),
js_chunks AS (
  SELECT repo_id, file_path || '::' || name || '::' || start_line AS chunk_id, file_path, chunk_type, name, start_line::INTEGER AS start_line,
         end_line::INTEGER AS end_line, 'javascript' AS language, NULL::VARCHAR AS parent_name, NULL::VARCHAR AS docstring,
         CASE WHEN chunk_type = 'import_block' THEN []::VARCHAR[] ELSE
           list_slice(list_sort(list_filter(list_distinct(regexp_extract_all(content, '{JS_CALL}', 1)),
                                            lambda c: NOT list_contains({JS_BUILTINS_SQL}, c))), 1, 15) END AS calls,
         []::VARCHAR[] AS imports, content
  FROM js_bodies)"""

ORACLE["js_chunks"] = f"WITH RECURSIVE {JS_CHUNKS} SELECT * FROM js_chunks"

ORACLE["chunk_files"] = f"WITH RECURSIVE {CURRENT}, {JS_CHUNKS} SELECT * FROM cur UNION ALL SELECT * FROM js_chunks"
