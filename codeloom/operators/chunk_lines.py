"""Chunk schema and the generic line-block chunker (overlapping windows).

Chunkers are narrow jobs: the lines of a file become an array inside its row, chunk
boundaries are computed with array expressions into an ``array<struct>`` and
``inline`` emits the chunks.  The line array is dropped before ``inline`` so it is
never copied into each output row.  Files are at most 500 KB (see
``sources.files.keep_source_files``), which bounds the row size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import chunk_id, col_, lines_of

CHUNK_COLUMNS = [
    "repo_id", "chunk_id", "file_path", "chunk_type", "name", "start_line", "end_line",
    "language", "parent_name", "docstring", "calls", "imports", "content",
]


def chunk_struct(chunk_type, name, start_line, end_line, content, parent_name=None,
                 docstring=None, calls=None, imports=None) -> Column:
    """One chunk as a struct; 1-based inclusive line numbers."""
    empty = F.array().cast("array<string>")
    return F.struct(
        col_(chunk_type).alias("chunk_type"),
        col_(name).alias("name"),
        col_(start_line).cast("int").alias("start_line"),
        col_(end_line).cast("int").alias("end_line"),
        col_(content).alias("content"),
        (parent_name if parent_name is not None else F.lit(None)).cast("string").alias("parent_name"),
        (docstring if docstring is not None else F.lit(None)).cast("string").alias("docstring"),
        (calls if calls is not None else empty).alias("calls"),
        (imports if imports is not None else empty).alias("imports"),
    )


def finish_chunks(df: DataFrame) -> DataFrame:
    """Add ``chunk_id`` and order the columns of an exploded chunk frame.

    Chunkers emit with ``inline_outer`` and drop the null row of chunk-less files here.
    With plain ``inline`` the optimizer infers ``size(chunks) > 0`` and pushes it below
    the staged projections, which re-inlines the whole chunk expression into one
    predicate evaluated before (and besides) the projection."""
    return (df.filter(F.col("chunk_type").isNotNull())
            .withColumn("chunk_id", chunk_id()).select(*CHUNK_COLUMNS))


def line_blocks(lines: Column, window: int = 60, step: int = 50, min_lines: int = 3) -> Column:
    """Blocks of ``window`` lines starting every ``step`` lines; shorter than
    ``min_lines`` dropped.  Returns ``array<struct>`` of chunks (type ``block``)."""
    n = F.size(lines)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    kept = F.filter(starts, lambda i: F.least(F.lit(window), n - i) >= min_lines)
    return F.transform(kept, lambda i: chunk_struct(
        F.lit("block"),
        F.concat(F.lit("block_"), i.cast("string")),
        i + 1,
        i + F.least(F.lit(window), n - i),
        F.array_join(F.slice(lines, i + 1, F.least(F.lit(window), n - i)), "\n"),
    ))


def chunk_lines(files: DataFrame, window: int = 60, step: int = 50, min_lines: int = 3,
                language: str | Column = "language") -> DataFrame:
    """Generic chunker over ``files(repo_id, path, source, language)``."""
    lined = files.select("repo_id", F.col("path").alias("file_path"), col_(language).alias("language"),
                         lines_of("source").alias("_lines"))
    out = lined.select("repo_id", "file_path", "language",
                       F.inline_outer(line_blocks(F.col("_lines"), window, step, min_lines)))
    return finish_chunks(out)
