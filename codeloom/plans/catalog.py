"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver tables (or data Spark derives from them) in full.
Column names match the DuckDB twins in ``codeloom.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import embed_text
from codeloom.operators.bm25 import build_bm25, bm25_topk, term_freq
from codeloom.operators.chunk_lines import chunk_lines
from codeloom.functions.vectors import l2_normalise
from codeloom.operators.dense import cosine_topk
from codeloom.operators.embed import QUERY_PREFIX, embed
from codeloom.operators.expand import expand_queries
from codeloom.plans.hybrid import build_index, fused_ids, hybrid_search
from codeloom.functions.markup import citations, code_blocks
from codeloom.functions.text import display_location, in_skipped_dir, language_of, strip_ws
from codeloom.functions.urls import clone_url, is_rate_limit, job_id, repo_id, repo_name, valid_question, valid_repo_url
from codeloom.operators.answers import normalise_answers
from codeloom.operators.context import build_context, build_prompts, client_history, last_turns, parse_sources, reassemble, to_sources
from codeloom.operators.evaluate import evaluate, hit_ranks, metrics, report, write_report
from codeloom.operators.jobs import job_progress, pending_ingests
from codeloom.operators.metadata import flat_metadata, from_flat
from codeloom.operators.ivf import ivf_build, ivf_topk
from codeloom.operators.signatures import recall, signature_index, signature_topk
from codeloom.session import materialize, scratch, table
from codeloom.streaming.ingest import current_chunks, ingest_stream, repo_progress
from codeloom.streaming.living import compact, living_stream, open_index, replace_in, upsert_into, vacuum
from codeloom.sources.files import keep_source_files, scan_sources, write_files
from codeloom.sources.fixtures import answers, fragments, part_paths, relevance_pairs, repo_urls
from codeloom.sources.store import repo_info, upsert_chunks
from codeloom.operators.blockmax import block_postings, blockmax_topk
from codeloom.operators.chunk_js import chunk_files, chunk_javascript
from codeloom.operators.chunk_python import chunk_python
from codeloom.sources.fixtures import answerable_queries, benchmark_queries, documents_as_files, golden_queries, documents_as_named_files, js_sources, py_sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line blocks of every document, with their embed text."""
    return chunk_lines(documents_as_files(spark, sf_dir)).withColumn("embed_text", embed_text())


@register("line_blocks")
def q_line_blocks(spark, sf_dir):
    return doc_chunks(spark, sf_dir).select(
        "repo_id", "chunk_id", "file_path", "chunk_type", "name", "start_line", "end_line",
        "language", "content")


@register("term_freq")
def q_term_freq(spark, sf_dir):
    return term_freq(doc_chunks(spark, sf_dir)).select("repo_id", "chunk_id", "tok", "tf", "dl")


@register("doc_stats")
def q_doc_stats(spark, sf_dir):
    s = build_bm25(doc_chunks(spark, sf_dir)).stats
    return s.select("repo_id", "n", F.round("avgdl", 6).alias("avgdl"))


@register("term_idf")
def q_term_idf(spark, sf_dir):
    i = build_bm25(doc_chunks(spark, sf_dir)).idf
    return i.select("repo_id", "tok", "df", F.round("idf", 6).alias("idf"))


@register("bm25_topk")
def q_bm25_topk(spark, sf_dir):
    idx = build_bm25(doc_chunks(spark, sf_dir))
    q = benchmark_queries(spark, sf_dir).withColumnRenamed("question", "text")
    return bm25_topk(idx, q, 18).select("query_id", "repo_id", "chunk_id", "score", "rank")


def _blockmax(spark, sf_dir):
    idx = build_bm25(doc_chunks(spark, sf_dir))
    q = benchmark_queries(spark, sf_dir).withColumnRenamed("question", "text")
    return blockmax_topk(idx, block_postings(idx, 4), q, 18, size=4)     # small repositories, small blocks


@register("bm25_blockmax")
def q_bm25_blockmax(spark, sf_dir):
    """The rows of ``bm25_topk``, without scoring blocks that cannot hold any of them."""
    return _blockmax(spark, sf_dir)[0].select("query_id", "repo_id", "chunk_id", "score", "rank")


@register("bm25_blockmax_cost")
def q_bm25_blockmax_cost(spark, sf_dir):
    """Postings of each query's terms, and those that were scored."""
    return _blockmax(spark, sf_dir)[1].select("query_id", "postings_all", "postings_read")


def _dense(spark, sf_dir, method):
    idx = build_index(doc_chunks(spark, sf_dir).drop("embed_text"), materialize_tables=True)
    ex = expand_queries(benchmark_queries(spark, sf_dir))
    qv = embed(ex, "search_text", "qvec", query_prefix=QUERY_PREFIX)
    return cosine_topk(idx.vectors, qv, 24, method=method) \
        .select("query_id", "repo_id", "chunk_id", "score", "rank")


@register("cosine_topk")
def q_cosine_topk(spark, sf_dir):
    return _dense(spark, sf_dir, "native")


@register("cosine_topk_blocked")
def q_cosine_topk_blocked(spark, sf_dir):
    return _dense(spark, sf_dir, "blocked")


@register("rrf_hybrid")
def q_rrf_hybrid(spark, sf_dir):
    idx = build_index(doc_chunks(spark, sf_dir).drop("embed_text"), materialize_tables=True)
    return fused_ids(idx, benchmark_queries(spark, sf_dir), k=6) \
        .select("query_id", "repo_id", "chunk_id", "rd", "rb", "score", "rank", "retrieval_method")


@register("hybrid_search")
def q_hybrid_search(spark, sf_dir):
    idx = build_index(doc_chunks(spark, sf_dir).drop("embed_text"), materialize_tables=True)
    r = hybrid_search(idx, benchmark_queries(spark, sf_dir), k=8)
    return r.select("query_id", "rank", "repo_id", "chunk_id", "retrieval_method", "score",
                    "file_path", "chunk_type", "name", "start_line", "end_line", "language", "content")


@register("expand_queries")
def q_expand_queries(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    q = c.select("conv_id", "turn", F.col("text").alias("question"))
    return expand_queries(q).select("conv_id", "turn", "search_text")


@register("l2_normalise")
def q_l2_normalise(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform(l2_normalise("embedding"), lambda x: F.round(x, 6)).alias("unit"))


CHUNK_OUT = ["repo_id", "chunk_id", "file_path", "chunk_type", "name", "start_line", "end_line",
             "language", "parent_name", "docstring", "calls", "imports", "content"]


@register("py_chunks")
def q_py_chunks(spark, sf_dir):
    return chunk_python(py_sources(spark, sf_dir)).select(*CHUNK_OUT)


@register("js_chunks")
def q_js_chunks(spark, sf_dir):
    return chunk_javascript(js_sources(spark, sf_dir)).select(*CHUNK_OUT)


@register("chunk_files")
def q_chunk_files(spark, sf_dir):
    """All three chunkers routed by language over Python, JS/TS and text files."""
    files = py_sources(spark, sf_dir).unionByName(js_sources(spark, sf_dir)) \
        .unionByName(documents_as_files(spark, sf_dir))
    return chunk_files(files).select(*CHUNK_OUT)


# ---------------------------------------------------------------- scan filters, URLs
@register("scan_sources")
def q_scan_sources(spark, sf_dir):
    """Every document written out as a file, under names of all kinds, and scanned."""
    root = f"{scratch(spark, 'scan')}/build/my.repo [1]"
    write_files(documents_as_named_files(spark, sf_dir), root)
    f = scan_sources(spark, root, repo_id="r")
    return f.select("repo_id", "path", "length", "language", F.md5("source").alias("source_md5"))


@register("language_detect")
def q_language_detect(spark, sf_dir):
    p = part_paths(spark, sf_dir)
    kept = keep_source_files(p).select("p_partkey", F.lit(True).alias("keep"))
    return p.join(kept, "p_partkey", "left").select(
        "p_partkey", "path", language_of("path").alias("language"), in_skipped_dir("path").alias("skipped"),
        F.coalesce("keep", F.lit(False)).alias("keep"))


@register("url_functions")
def q_url_functions(spark, sf_dir):
    u = repo_urls(spark, sf_dir)
    return u.select("page_id", "url", repo_id("url").alias("repo_id"), job_id("url").alias("job_id"),
                    clone_url("url").alias("clone_url"), valid_repo_url("url").alias("valid"),
                    repo_name("url").alias("repo_name"))


@register("question_checks")
def q_question_checks(spark, sf_dir):
    """Every whole text (variant 0), and planted forms of it as further rows."""
    t = F.col("text")
    texts = F.array(t, F.lit("  \t\n"), F.lit("HTTP 429 Too Many"), F.concat(t, F.lit(" RESOURCE_EXHAUSTED")),
                    F.concat(t, F.lit("\u00a0Rate_Limit")))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(texts).alias("variant", "text"))
    return c.select("conv_id", "turn", "variant", valid_question("text").alias("valid_question"),
                    is_rate_limit("text").alias("rate_limited"))


# ---------------------------------------------------------------- chunk projections, store
@register("embed_text")
def q_embed_text(spark, sf_dir):
    ch = chunk_python(py_sources(spark, sf_dir))
    return ch.select("repo_id", "chunk_id", embed_text().alias("embed_text"),
                     display_location().alias("display_location"))


@register("flat_metadata")
def q_flat_metadata(spark, sf_dir):
    return flat_metadata(chunk_python(py_sources(spark, sf_dir)))


@register("repo_info")
def q_repo_info(spark, sf_dir):
    return repo_info(doc_chunks(spark, sf_dir))


@register("upsert_last_wins")
def q_upsert_last_wins(spark, sf_dir):
    old = doc_chunks(spark, sf_dir).select("repo_id", "chunk_id", "content")
    d = documents_as_files(spark, sf_dir)
    # All documents again, lower-cased, and as new files of the same and of new repositories.
    low = chunk_lines(d).select("repo_id", "chunk_id", F.lower("content").alias("content"))
    more = low.select(F.concat("repo_id", F.when(F.length("content") % 2 == 0, "/fork").otherwise("")).alias("repo_id"),
                      F.concat(F.lit("new/"), "chunk_id").alias("chunk_id"), "content")
    return upsert_chunks(old, low.unionByName(more))


@register("flat_round_trip")
def q_flat_round_trip(spark, sf_dir):
    """Chunk rows rebuilt from flattened metadata and the stored embed text."""
    ch = chunk_python(py_sources(spark, sf_dir))
    text = ch.select("repo_id", "chunk_id", embed_text().alias("document"))
    return from_flat(flat_metadata(ch).join(text, ["repo_id", "chunk_id"]))


# ---------------------------------------------------------------- context, prompts, citations
def _results(spark, sf_dir, k):
    idx = build_index(doc_chunks(spark, sf_dir).drop("embed_text"), materialize_tables=True)
    return hybrid_search(idx, benchmark_queries(spark, sf_dir), k=k)


@register("build_context")
def q_build_context(spark, sf_dir):
    return build_context(_results(spark, sf_dir, 6))


@register("history_last4")
def q_history_last4(spark, sf_dir):
    return last_turns(table(spark, sf_dir, "conversations"), 4).select("conv_id", "turn", "role", "text")


@register("client_history")
def q_client_history(spark, sf_dir):
    return client_history(table(spark, sf_dir, "conversations"), (F.col("turn") == 0) & (F.col("role") == "assistant")) \
        .select("conv_id", "turn", "role", "text")


def _prompt_queries(spark, sf_dir):
    """The benchmark questions, one for a repository that is not there, and a blank one."""
    more = table(spark, sf_dir, "documents").agg(F.min("source").alias("s")).select(F.inline(F.array(
        F.struct(F.lit(-1).cast("long").alias("query_id"), F.lit("no such repository").alias("repo_id"), F.lit("where").alias("question")),
        F.struct(F.lit(-2).cast("long").alias("query_id"), F.col("s").alias("repo_id"), F.lit("  ").alias("question")))))
    return benchmark_queries(spark, sf_dir).unionByName(more)


def _prompts(spark, sf_dir, provider):
    asked = materialize(_prompt_queries(spark, sf_dir), "asked")
    idx = build_index(doc_chunks(spark, sf_dir).drop("embed_text"), materialize_tables=True)
    res = hybrid_search(idx, asked, k=6)
    hist = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("query_id"), "turn", "role", F.col("text").alias("content"))
    # A folder's name holds every repository but the one without a name, whose chunks are counted by themselves.
    nameless = doc_chunks(spark, sf_dir).select("repo_id").where("repo_id = ''")
    sizes = repo_info(idx.chunks.select("repo_id").unionByName(nameless)).select("repo_id", F.col("total_chunks").alias("n_chunks"))
    p = build_prompts(asked, build_context(res), hist, sizes, provider)
    # One row per message (flat columns); a fixed reply gives one row with null msg_pos.
    return p.select("query_id", "reply", F.posexplode_outer("messages").alias("msg_pos", "m")) \
        .select("query_id", "reply", "msg_pos", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


@register("build_prompts")
def q_build_prompts(spark, sf_dir):
    return _prompts(spark, sf_dir, "groq")


@register("build_prompts_single")
def q_build_prompts_single(spark, sf_dir):
    return _prompts(spark, sf_dir, "gemini")


@register("to_sources")
def q_to_sources(spark, sf_dir):
    return to_sources(_results(spark, sf_dir, 6)).select("query_id", "sources_json")


@register("parse_sources")
def q_parse_sources(spark, sf_dir):
    return parse_sources(answers(spark, sf_dir), "text", "msg_id")


@register("reassemble_fragments")
def q_reassemble_fragments(spark, sf_dir):
    return reassemble(fragments(spark, sf_dir))


@register("extract_citations")
def q_extract_citations(spark, sf_dir):
    return answers(spark, sf_dir).select("msg_id", citations("text").alias("citations"))


@register("extract_code")
def q_extract_code(spark, sf_dir):
    a = answers(spark, sf_dir)
    return a.select("msg_id", F.posexplode(code_blocks("text")).alias("pos", "b")) \
        .select("msg_id", "pos", F.col("b.lang").alias("lang"), F.col("b.code").alias("code"))


# ---------------------------------------------------------------- evaluation, jobs
def _eval_inputs(spark, sf_dir):
    """The sources found for the questions, and the relevance pairs, which are written once."""
    pairs = materialize(relevance_pairs(spark, sf_dir), "relevance")
    idx = build_index(doc_chunks(spark, sf_dir).drop("embed_text"), materialize_tables=True)
    r = hybrid_search(idx, answerable_queries(spark, sf_dir, pairs), k=8)
    return r.select("query_id", F.col("rank").alias("pos"), F.col("file_path").alias("file"), "name"), pairs


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))


@register("eval_hits")
def q_eval_hits(spark, sf_dir):
    return hit_ranks(*_eval_inputs(spark, sf_dir), questions=_questions(spark, sf_dir))


@register("eval_metrics")
def q_eval_metrics(spark, sf_dir):
    return metrics(hit_ranks(*_eval_inputs(spark, sf_dir), questions=_questions(spark, sf_dir)))


@register("eval_report")
def q_eval_report(spark, sf_dir):
    """The report written as JSON and read back, a row per question with the repository's totals."""
    found, pairs = _eval_inputs(spark, sf_dir)
    sources, path = materialize(found, "eval-sources"), scratch(spark, "report")
    per_q, summary = evaluate(sources, pairs, questions=_questions(spark, sf_dir))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    n = table(spark, sf_dir, "documents").count()
    write_report(*report(per_q, summary, asked, sources, "https://github.com/a/b", "docs", n), path)
    head = spark.read.schema("repo_id string, total_chunks bigint, n bigint, hits_at_5 bigint, mrr_at_5 double").json(f"{path}/metrics")
    rows = spark.read.schema("query_id bigint, question string, hit_rank int, sources array<struct<file: string, name: string>>").json(f"{path}/results")
    named = F.array_join(F.transform("sources", lambda x: F.concat(x["file"], F.lit("#"), x["name"])), ",")
    return rows.withColumn("repo_id", F.lit("docs")).join(F.broadcast(head), "repo_id").select(
        "query_id", "question", "hit_rank", named.alias("sources"), "total_chunks", "n", "hits_at_5", "mrr_at_5")


def _golden_results(spark, sf_dir):
    idx = build_index(chunk_python(py_sources(spark, sf_dir)), materialize_tables=True)
    return hybrid_search(idx, golden_queries(spark, sf_dir), k=6)


@register("golden_context")
def q_golden_context(spark, sf_dir):
    """Context of the golden questions over code files: parents and docstrings occur."""
    return build_context(_golden_results(spark, sf_dir))


@register("golden_hits")
def q_golden_hits(spark, sf_dir):
    r = _golden_results(spark, sf_dir)
    src = r.select("query_id", F.col("rank").alias("pos"), F.col("file_path").alias("file"), "name")
    return hit_ranks(src, golden_queries(spark, sf_dir))


JOB_STATUS_BY_EVENT = {"click": "pending", "view": "cloning", "signup": "indexing", "purchase": "done",
                       "error": "error"}


def job_log(spark, sf_dir):
    """``(job_id, status, ts, seq)``: events of user u are status changes of the job
    for repository URL u."""
    e = table(spark, sf_dir, "events")
    u = repo_urls(spark, sf_dir)
    m = F.create_map(*[F.lit(x) for kv in JOB_STATUS_BY_EVENT.items() for x in kv])
    return e.join(u, e.user_id == u.page_id).select(
        job_id(strip_ws(F.col("url"))).alias("job_id"), F.element_at(m, F.col("event_type")).alias("status"),
        "ts", F.col("event_id").alias("seq"))


@register("pending_ingests")
def q_pending_ingests(spark, sf_dir):
    return pending_ingests(repo_urls(spark, sf_dir), job_log(spark, sf_dir))


@register("job_progress")
def q_job_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    b = e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("batch_id"),
                 (F.col("event_id") % 8 + 1).alias("n_chunks"))
    return job_progress(b)


@register("normalise_answers")
def q_normalise_answers(spark, sf_dir):
    return normalise_answers(answers(spark, sf_dir), "text", "formatted").select("msg_id", "formatted")


# ---------------------------------------------------------------- approximate search, streaming
IVF_CELLS = 16
IVF_PROBES = 12      # cells that reach IVF_RECALL on the given tables
IVF_RECALL = 0.9


def _bench_qvecs(spark, sf_dir):
    return embed(benchmark_queries(spark, sf_dir), "question", "qvec", query_prefix=QUERY_PREFIX) \
        .select("query_id", "qvec")


@register("ivf_topk")
def q_ivf_topk(spark, sf_dir):
    """All cells probed: equal to exact cosine top-10 (the DuckDB twin)."""
    idx = ivf_build(table(spark, sf_dir, "embeddings"), IVF_CELLS, id_col="vec_id")
    return ivf_topk(idx, _bench_qvecs(spark, sf_dir), 10, nprobe=IVF_CELLS) \
        .select("query_id", F.col("id").alias("vec_id"), "score", "rank")


def ivf_found(index, queries, nprobe=IVF_PROBES) -> DataFrame:
    """``(n_queries, k, recall)``: the share of the exact top 10 of ``queries`` that ``nprobe`` cells hold."""
    some, full = (ivf_topk(index, queries, 10, nprobe=n).select("query_id", "id") for n in (nprobe, IVF_CELLS))
    found = full.join(some.withColumn("_hit", F.lit(1)), ["query_id", "id"], "left")
    return found.agg(F.count_distinct("query_id").alias("n_queries"), F.lit(10).alias("k"),
                     (F.count("_hit") / F.count(F.lit(1))).alias("recall"))


@register("ivf_recall")
def q_ivf_recall(spark, sf_dir):
    """Whether the probed cells hold at least IVF_RECALL of the exact top 10 of the stated
    queries: the vectors whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings")
    idx = ivf_build(e, IVF_CELLS, id_col="vec_id")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return ivf_found(idx, q).select("n_queries", "k", (F.col("recall") >= IVF_RECALL).alias("recall_reached"))


@register("ivf_topk_12_of_16")
def q_ivf_topk_12_of_16(spark, sf_dir):
    """IVF_PROBES of the cells probed (approximate: rows only; see ivf_found)."""
    idx = ivf_build(table(spark, sf_dir, "embeddings"), IVF_CELLS, id_col="vec_id")
    return ivf_topk(idx, _bench_qvecs(spark, sf_dir), 10, nprobe=IVF_PROBES) \
        .select("query_id", F.col("id").alias("vec_id"), "score", "rank")


SIGNATURE_SHARE = 0.2     # of the vectors that are scored exactly


@register("signature_recall")
def q_signature_recall(spark, sf_dir):
    """``(n_queries, recall, scored_share)`` of the approximate top 10 by signatures, for the vectors whose id is
    divisible by 20 against all, held against the exact top 10."""
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    found = signature_topk(signature_index(e, id_col="vec_id"), q, 10, max(1, int(n * SIGNATURE_SHARE)))
    one = e.select(F.lit("").alias("repo_id"), F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    exact = cosine_topk(one, q.withColumn("repo_id", F.lit("")), 10).select("query_id", F.col("chunk_id").alias("id"))
    return recall(materialize(found, "found"), exact, n)


def _ingested(spark, sf_dir, with_older: bool):
    """Stream Python files and documents in several arrivals, the first of them, if asked, an
    older version of the documents; returns the folder of the stream's tables."""
    src = scratch(spark, "stream-src")
    cols = ["repo_id", "path", "source", "language"]
    docs = documents_as_files(spark, sf_dir).select(*cols)
    older = docs.withColumn("source", F.concat(F.repeat(F.lit("older line\n"), 70), F.upper("source")))
    for part in ([older] if with_older else []) + [py_sources(spark, sf_dir), docs]:
        part.select(*cols).write.mode("append").parquet(src)
    q, out = ingest_stream(spark, src, max_files_per_trigger=5)
    q.awaitTermination()
    return out


@register("stream_ingest")
def q_stream_ingest(spark, sf_dir):
    """Structured Streaming ingest (availableNow) of all files; the current index."""
    return current_chunks(spark, _ingested(spark, sf_dir, True)).select(*CHUNK_OUT)


@register("stream_progress")
def q_stream_progress(spark, sf_dir):
    """Final progress of every repository."""
    p = job_progress(repo_progress(spark, _ingested(spark, sf_dir, False)))
    return p.groupBy("job_id").agg(
        F.max("indexed").alias("indexed"), F.max("total").alias("total"), F.max("progress").alias("progress"))


# ---------------------------------------------------------------- the index as a living table
def _arrivals(spark, sf_dir):
    """Three arrivals of files after which just the documents are left.  First, older versions of them and
    files that will vanish.  Then every third repository starts a new snapshot (epoch 1) with half of its
    documents, the others replace theirs and delete what must go; last, the other half."""
    docs = documents_as_files(spark, sf_dir).select("repo_id", "path", "source", "language")
    snapshot = F.pmod(F.xxhash64("repo_id"), F.lit(3)) == 0
    half = F.pmod(F.xxhash64("path"), F.lit(2)) == 0
    epoch = F.when(snapshot, 1).otherwise(0).cast("long").alias("epoch")
    older = docs.withColumn("source", F.concat(F.repeat(F.lit("older line\n"), 70), F.upper("source")))
    ghosts = docs.select("repo_id", F.concat(F.lit("gone/"), "path").alias("path"), "source", "language")
    row = lambda df, epoch, deleted: df.select("repo_id", "path", "source", "language", epoch, F.lit(deleted).alias("deleted"))
    zero = F.lit(0).cast("long").alias("epoch")
    yield row(older.unionByName(ghosts), zero, False)
    yield row(docs.where(half | ~snapshot), epoch, False).unionByName(row(ghosts.where(~snapshot).withColumn("source", F.lit(None).cast("string")), zero, True))
    late = row(older.where(snapshot), zero, False)      # rows of an older snapshot that come too late
    yield row(docs.where(snapshot & ~half), epoch, False).unionByName(late)


def living_index(spark, sf_dir) -> str:
    """The folder of an index that the arrivals have been streamed into, one run of the stream for each."""
    src, path = scratch(spark, "living-src"), scratch(spark, "living")
    for part in _arrivals(spark, sf_dir):
        part.write.mode("append").parquet(src)
        living_stream(spark, src, path).awaitTermination()
    return path


@register("living_search")
def q_living_search(spark, sf_dir):
    """Hybrid search over the streamed index: equal to the search over an index built at once."""
    r = hybrid_search(open_index(spark, living_index(spark, sf_dir)), benchmark_queries(spark, sf_dir), k=8)
    return r.select("query_id", "rank", "repo_id", "chunk_id", "retrieval_method", "score",
                    "file_path", "chunk_type", "name", "start_line", "end_line", "language", "content")


@register("living_compacted")
def q_living_compacted(spark, sf_dir):
    """idf of the streamed index after compaction and vacuum: that of an index built at once."""
    path = living_index(spark, sf_dir)
    compact(spark, path)
    vacuum(spark, path)
    return open_index(spark, path).bm25.idf.select("repo_id", "tok", "df", F.round("idf", 6).alias("idf"))


def _edited(spark, sf_dir) -> DataFrame:
    """All documents' chunks again, lower-cased, as new files of the same repositories or of forks."""
    d = doc_chunks(spark, sf_dir).withColumn("content", F.lower("content"))
    more = d.withColumn("repo_id", F.concat("repo_id", F.when(F.length("content") % 2 == 0, "/fork").otherwise(""))).withColumn(
        "chunk_id", F.concat(F.lit("new/"), "chunk_id"))
    return d.where(F.pmod(F.col("start_line"), F.lit(100)) == 1).unionByName(more).drop("embed_text")


def _saved(spark, sf_dir, change, edited) -> DataFrame:
    path = scratch(spark, "living")
    replace_in(doc_chunks(spark, sf_dir).drop("embed_text"), path)
    change(edited, path)
    return open_index(spark, path).chunks.select("repo_id", "chunk_id", "content")


@register("living_upsert")
def q_living_upsert(spark, sf_dir):
    """S2 on a saved index: changed and new chunks of all documents upserted, then read back."""
    return _saved(spark, sf_dir, upsert_into, _edited(spark, sf_dir))


@register("living_replace")
def q_living_replace(spark, sf_dir):
    """S3 on a saved index: repositories with names of even length replaced by their changed chunks, the others left."""
    return _saved(spark, sf_dir, replace_in, _edited(spark, sf_dir).where(F.length("repo_id") % 2 == 0))


FLAGSHIP = "hybrid_search"
