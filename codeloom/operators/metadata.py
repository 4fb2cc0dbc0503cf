"""Flattened chunk metadata (P6) and its inverse.

The native chunk table keeps real nulls and arrays; ``flat_metadata`` produces the
reference's flat, string-only projection for stores that need it, and ``from_flat``
reads such a projection back into chunk rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import strip_ws

# Fixed values that must equal the reference.
DOC_CHARS = 500
CALLS_KEPT = 20


def flat_metadata(chunks: DataFrame) -> DataFrame:
    """``(repo_id, chunk_id, file_path, chunk_type, name, start_line, end_line, language,
    parent_name, docstring, calls)``: nulls become ``''``, the docstring is cut to 500
    characters and the first 20 calls are joined with commas."""
    return chunks.select(
        "repo_id", "chunk_id", "file_path", "chunk_type", "name", "start_line", "end_line", "language",
        F.coalesce("parent_name", F.lit("")).alias("parent_name"),
        F.substring(F.coalesce("docstring", F.lit("")), 1, DOC_CHARS).alias("docstring"),
        F.array_join(F.slice(F.coalesce("calls", F.array().cast("array<string>")), 1, CALLS_KEPT), ",")
         .alias("calls"))


def from_flat(flat: DataFrame, doc_col: str = "document") -> DataFrame:
    """Chunk rows from flattened metadata plus the stored embed text: the leading
    ``#`` header lines are dropped and the rest stripped; ``''`` becomes null; calls are
    split at commas."""
    content = strip_ws(F.regexp_replace(F.col(doc_col), r"\A(#[^\n]*\n)*", ""))
    return flat.select(
        "repo_id", "chunk_id", "file_path", "chunk_type", "name", "start_line", "end_line", "language",
        F.nullif("parent_name", F.lit("")).alias("parent_name"), F.nullif("docstring", F.lit("")).alias("docstring"),
        F.when(F.col("calls") == "", F.array().cast("array<string>")).otherwise(F.split("calls", ",")).alias("calls"),
        content.alias("content"))
