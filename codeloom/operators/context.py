"""Prompt context, prompts, citations and streamed answers.

Every per-query aggregate here groups the top-k results of one query (k <= a few
dozen rows), or the fragments of one answer (bounded by the answer length), so no
group grows with the corpus.  Orders inside a group are always made explicit with
``array_sort(collect_list(struct(rank, ...)))``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from codeloom.functions.text import col_, strip_ws
from codeloom.session import checked_broadcast, materialize

# Fixed values that must equal the reference (but for the assistant's name, a parameter):
# the system prompt and fixed replies.
SYSTEM_PROMPT = """You are ASSISTANT_NAME. Answer questions about a codebase using the provided code chunks.

STRICT OUTPUT FORMAT — follow exactly:

Line 1: One sentence direct answer. End with period.
Line 2: blank
Lines 3+: bullet points, one per line, each starting with "- "

Every bullet:  - **Label:** value [filename:lines]

Example:
The database connection is handled in `connectDB`.

- **File:** `backend/config/db.js` [backend/config/db.js:3-11]
- **Function:** `connectDB` calls `mongoose.connect()`
- **On error:** logs error and calls `process.exit(1)`
- **Also used in:** `server.js` at startup [server.js:8]

MANDATORY RULES:
- After line 1, ONLY blank lines or lines starting with "- "
- NO prose paragraphs after line 1
- NO numbered lists, NO headers (#, ##, ###)
- Max 6 bullets
- Every bullet has a [file:lines] citation
- Backticks around all code: `functionName`, `file.js`
"""
ASSISTANT = "a code assistant"
NOT_INDEXED = "Repository not indexed yet — please wait for ingestion to finish."
NOTHING_FOUND = "No relevant code found. Try asking about a specific function or file name."
RULE = "=" * 60
HISTORY_TURNS = 4
DOC_PREVIEW = 150

SOURCE_SCHEMA = ArrayType(StructType([
    StructField("file", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()),
    StructField("name", StringType()), StructField("type", StringType()), StructField("method", StringType()),
]))
SOURCES_RE = r"(?s)\[SOURCES\](.*?)\[/SOURCES\]"


def _present(c) -> Column:
    return col_(c).isNotNull() & (col_(c) != "")


def chunk_block() -> Column:
    """One chunk's context block: location, type label, optional doc, fenced code."""
    label = F.concat(F.upper("chunk_type"), F.lit(": "), F.col("name"),
                     F.when(_present("parent_name"), F.concat(F.lit(" (in "), F.col("parent_name"), F.lit(")")))
                      .otherwise(F.lit("")))
    header = F.concat(
        F.lit("LOCATION: ["), F.col("file_path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"),
        F.col("end_line").cast("string"), F.lit("]\nTYPE: "), label,
        F.when(_present("docstring"), F.concat(F.lit("\nDOC: "), F.substring("docstring", 1, DOC_PREVIEW)))
         .otherwise(F.lit("")))
    return F.concat(header, F.lit("\n```"), F.col("language"), F.lit("\n"), F.col("content"), F.lit("\n```"))


def build_context(results: DataFrame) -> DataFrame:
    """``(query_id, context)`` from ranked results (one shuffle on ``query_id``).

    The context starts with an index of referenced files in first-seen order, each with
    its chunk names in rank order, then a rule, then the chunk blocks in rank order."""
    items = results.select("query_id", F.struct("rank", "file_path", "name", chunk_block().alias("block")).alias("it"))
    g = items.groupBy("query_id").agg(F.array_sort(F.collect_list("it")).alias("its"))
    files = F.array_distinct(F.transform("its", lambda x: x["file_path"]))
    index = F.array_join(F.transform(files, lambda f: F.concat(
        F.lit("  "), f, F.lit(": "),
        F.array_join(F.transform(F.filter("its", lambda x: x["file_path"] == f), lambda x: x["name"]), ", "))), "\n")
    blocks = F.array_join(F.transform("its", lambda x: x["block"]), "\n\n")
    return g.select("query_id", F.concat(F.lit("REFERENCED FILES:\n"), index, F.lit("\n\n" + RULE + "\n\n"),
                                         blocks).alias("context"))


def last_turns(conv: DataFrame, n: int = HISTORY_TURNS, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``n`` turns of every conversation (W2).  The per-key top-n is planned
    as a ``WindowGroupLimit`` before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return conv.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def client_history(messages: DataFrame, welcome: Column, n: int = 6, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """What a client sends along: its messages without the welcome one, the last ``n``."""
    return last_turns(messages.filter(~welcome), n, key, order)


def build_prompts(queries: DataFrame, context: DataFrame, history: DataFrame | None = None,
                  repo_sizes: DataFrame | None = None, provider: str = "groq",
                  assistant: str = ASSISTANT) -> DataFrame:
    """``(query_id, reply, messages)`` (Q3, Q5).

    ``queries(query_id, repo_id, question)``, ``context(query_id, context)``,
    ``history(query_id, turn, role, content)`` (already the turns sent by the client),
    ``repo_sizes(repo_id, n_chunks)``.  ``reply`` is the fixed text when the repository
    is empty or nothing was retrieved; ``messages`` is null then.  Provider ``gemini``
    folds the system prompt into one user message and ignores history."""
    system = SYSTEM_PROMPT.replace("ASSISTANT_NAME", assistant)
    q = queries.join(context, "query_id", "left")
    if repo_sizes is not None:
        q = q.join(repo_sizes, "repo_id", "left")
    else:
        q = q.withColumn("n_chunks", F.lit(1))
    user = F.concat(F.lit("CODEBASE CONTEXT:\n\n"), F.col("context"), F.lit("\n\n" + RULE + "\n\nQUESTION: "),
                    F.col("question"))
    msg_type = "array<struct<role:string,content:string>>"
    if provider == "gemini" or history is None:
        hist = F.array().cast(msg_type)
        q2 = q
    else:
        # Turns of other conversations are left out before any is sorted.
        asked, _ = checked_broadcast(materialize(queries.select("query_id").distinct(), "asked"))
        h = (last_turns(history.join(asked, "query_id", "left_semi"), HISTORY_TURNS, "query_id", "turn")
             .groupBy("query_id")
             .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("_h")))
        q2 = q.join(h, "query_id", "left")
        hist = F.coalesce(F.transform("_h", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))),
                          F.array().cast(msg_type))
    if provider == "gemini":
        msgs = F.array(F.struct(F.lit("user").alias("role"),
                                F.concat(F.lit(system + "\n\n"), user).alias("content")))
    else:
        msgs = F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))),
                        hist, F.array(F.struct(F.lit("user").alias("role"), user.alias("content"))))
    empty = F.coalesce(F.col("n_chunks"), F.lit(0)) == 0
    reply = F.when(empty, F.lit(NOT_INDEXED)).when(F.col("context").isNull(), F.lit(NOTHING_FOUND))
    return q2.select("query_id", reply.alias("reply"), F.when(reply.isNull(), msgs).alias("messages"))


def to_sources(results: DataFrame) -> DataFrame:
    """``(query_id, sources_json, payload)``: the citations of each query in rank order
    as a JSON array and the ``[SOURCES]...[/SOURCES]`` trailer (compact JSON; equal to
    the reference's after parsing)."""
    s = F.struct("rank", F.struct(F.col("file_path").alias("file"), F.col("start_line").alias("start"),
                                  F.col("end_line").alias("end"), "name", F.col("chunk_type").alias("type"),
                                  F.col("retrieval_method").alias("method")).alias("src"))
    g = results.groupBy("query_id").agg(F.array_sort(F.collect_list(s)).alias("_s"))
    js = F.to_json(F.transform("_s", lambda x: x["src"]))
    return g.select("query_id", js.alias("sources_json"),
                    F.concat(F.lit("\n\n[SOURCES]"), js, F.lit("[/SOURCES]")).alias("payload"))


def parse_sources(answers: DataFrame, text_col: str = "text", key: str = "query_id") -> DataFrame:
    """``(key, pos, file, start, end, name, type, method)``: the first
    ``[SOURCES]...[/SOURCES]`` payload of each answer, parsed; a malformed or missing
    payload gives no rows (S8).  ``pos`` is 0-based."""
    payload = F.regexp_extract(F.col(text_col), SOURCES_RE, 1)
    parsed = F.from_json(F.when(F.col(text_col).rlike(SOURCES_RE), payload), SOURCE_SCHEMA)
    return (answers.select(key, F.posexplode(parsed).alias("pos", "s"))
            .select(key, "pos", "s.file", "s.start", "s.end", "s.name", "s.type", "s.method"))


def _without_first(text: Column) -> Column:
    """The text without its first sources payload."""
    return F.array_join(F.split(text, SOURCES_RE, 2), "")


def reassemble(fragments: DataFrame) -> DataFrame:
    """``(msg_id, text, sources_json)`` from streamed ``(msg_id, seq, data)`` fragments.

    Fragments fold in ``seq`` order: a sources fragment is not appended but takes the first
    payload out of the text so far, trims it, and supplies the citations if its payload is
    JSON (else the earlier ones stay); an ``[ERROR]`` fragment appends a warning
    line; any other fragment appends its text with ``\\n`` escapes undone."""
    g = fragments.groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("_f"))
    init = F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("src"))

    def step(acc, f):
        d = f["data"]
        is_src = d.rlike(SOURCES_RE)
        payload = F.regexp_extract(d, SOURCES_RE, 1)
        text = (F.when(is_src, strip_ws(_without_first(acc["text"])))
                .when(d.contains("[ERROR]"), F.concat(acc["text"], F.lit("\n⚠️ "),
                                                     F.regexp_replace(d, r"\[ERROR\]|\[/ERROR\]", "")))
                .otherwise(F.concat(acc["text"], F.replace(d, F.lit("\\n"), F.lit("\n")))))
        src = F.when(is_src & F.get_json_object(payload, "$").isNotNull(), payload).otherwise(acc["src"])
        return F.struct(text.alias("text"), src.alias("src"))

    r = F.aggregate("_f", init, step)
    text = strip_ws(_without_first(r["text"]))
    return g.select("msg_id", text.alias("text"), r["src"].alias("sources_json"))
