"""codeloom: retrieval over code and text corpora as Spark DataFrame jobs.

Every operator is a function DataFrame -> DataFrame (or Column -> Column) built on
native Spark SQL expressions. Sub-packages:

* ``functions`` - Column helpers (line splitting, tokens, URLs, vectors, markup).
* ``sources``   - file scans, fixtures derived from tables, sinks.
* ``operators`` - chunkers, BM25, dense search, fusion, context, evaluation, answers.
* ``plans``     - end-to-end plans (index build, hybrid search, ask, evaluate).
* ``streaming`` - incremental ingest with Structured Streaming.
"""

__all__ = ["session"]
