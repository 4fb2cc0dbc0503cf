"""Ingestion bookkeeping as table operations.

``pending_ingests``: which requested repositories to (re)run.  A request is skipped
when the latest status of its job is done / cloning / chunking / indexing, and run
when it is unknown, ``error`` or ``pending`` (the reference schedules a pending job
again).  The latest status per job is a ``max_by`` aggregate (partial + final, no
window over the whole log); requests are then anti-joined against skipped jobs.

``job_progress``: ``45 + int(54 * indexed / total)`` after every indexed batch, as a
running sum per job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import strip_ws
from codeloom.functions.urls import clone_url, job_id, repo_id, valid_repo_url

# Fixed values that must equal the reference: job states and progress constants.
BUSY_OR_DONE = ["done", "cloning", "chunking", "indexing"]
PROGRESS_BASE, PROGRESS_SPAN = 45, 54


def latest_status(log: DataFrame) -> DataFrame:
    """``(job_id, status)``: the status with the greatest ``ts`` per job (ties: the
    greatest ``seq``)."""
    return log.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"))


def pending_ingests(requests: DataFrame, log: DataFrame, url_col: str = "url") -> DataFrame:
    """Valid requests whose job must run: ``(url, job_id, repo_id, clone_url)``."""
    req = (requests.filter(valid_repo_url(url_col))
           .select(strip_ws(F.col(url_col)).alias("url"))
           .select("url", job_id("url").alias("job_id"), repo_id("url").alias("repo_id"),
                   clone_url("url").alias("clone_url")))
    skip = latest_status(log).filter(F.col("status").isin(*BUSY_OR_DONE)).select("job_id")
    return req.join(skip, "job_id", "left_anti")


def job_progress(batches: DataFrame, bucket: int = 4096) -> DataFrame:
    """``(job_id, batch_id, indexed, total, progress)`` from ``(job_id, batch_id, n_chunks)``.

    The running sum is two-level so a job with a huge batch log is not one window
    partition: batches are bucketed by ``batch_id // bucket``; per-bucket totals (one
    row per bucket) give each bucket's offset, and the running sum inside a bucket is a
    window over ``(job_id, bucket)``."""
    b = batches.withColumn("_bk", F.floor(F.col("batch_id") / bucket))
    tot = b.groupBy("job_id", "_bk").agg(F.sum("n_chunks").alias("_bt"))
    before = Window.partitionBy("job_id").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    off = (tot.withColumn("_off", F.coalesce(F.sum("_bt").over(before), F.lit(0)))
           .withColumn("total", F.sum("_bt").over(Window.partitionBy("job_id"))))
    inner = Window.partitionBy("job_id", "_bk").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    out = b.withColumn("_run", F.sum("n_chunks").over(inner)).join(off, ["job_id", "_bk"])
    indexed = (F.col("_off") + F.col("_run")).cast("long")
    return out.select("job_id", "batch_id", indexed.alias("indexed"), F.col("total").cast("long").alias("total"),
                      (F.lit(PROGRESS_BASE) + F.floor(F.lit(PROGRESS_SPAN) * indexed / F.col("total")))
                      .cast("int").alias("progress"))
