"""Source-file scan (S1) and the scan filters.

Spark's own file sources never list names that begin with ``_`` or ``.``, which would lose
``__init__.py``, and read a path with brackets or stars as a pattern.  So directories are
listed in tasks: each level's directories are spread over the cluster, listed there
through Arrow's file systems, and written as a table; sub-directories with a skipped name
are dropped before they are listed.  The listing stops at the first level without
directories.  Files that pass the filters are then read where they are, spread by path.
Nothing is collected, and no path is ever read as a pattern.

Text is decoded as UTF-8 dropping undecodable bytes: ``make_valid_utf8`` replaces
them with U+FFFD, which is then removed.  A genuine U+FFFD in a file is removed as
well - the only difference from decoding with ``errors="ignore"``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import in_skipped_dir, language_of
from codeloom.session import materialize

# Fixed value that must equal the reference: files over this many bytes are skipped.
MAX_FILE_BYTES = 500_000
# Removed or unreadable meanwhile; any other error fails the task, which Spark then retries.
SKIPPED = (FileNotFoundError, PermissionError)


def keep_source_files(files: DataFrame, max_bytes: int = MAX_FILE_BYTES, path_col: str = "path") -> DataFrame:
    """Files not under a skipped directory, at most ``max_bytes`` long and with a known
    language; adds ``language``."""
    return (files.withColumn("language", language_of(path_col))
            .filter(~in_skipped_dir(path_col) & (F.col("length") <= max_bytes) & F.col("language").isNotNull()))


def file_system(root: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system for a folder, and the folder's path in it.  Without a scheme, or
    with ``file:``, the path is taken literally."""
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    if "://" in root:
        scheme, rest = root.split("://", 1)
        host, _, path = rest.partition("/")
        fs, base = pa.fs.FileSystem.from_uri(f"{scheme}://{host}/")
        return fs, f"{base.rstrip('/')}/{path}".rstrip("/")
    return pa.fs.LocalFileSystem(), root.rstrip("/") or "/"


def _list(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(root)
        for batch in batches:
            for d in batch.column("path").to_pylist():
                try:
                    found = fs.get_file_info(pa.fs.FileSelector(f"{base}/{d}".rstrip("/")))
                except SKIPPED:
                    continue
                prefix = f"{d}/" if d else ""
                yield pa.RecordBatch.from_arrays(
                    [pa.array([prefix + x.base_name for x in found], pa.string()),
                     pa.array([x.type == pa.fs.FileType.Directory for x in found], pa.bool_()),
                     pa.array([x.size for x in found], pa.int64())], ["path", "is_dir", "length"])

    return run


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(root)
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                try:
                    with fs.open_input_stream(f"{base}/{path}") as f:
                        content = f.read()
                except SKIPPED:
                    continue
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary())], [*row.schema.names, "content"])

    return run


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length)`` of the files below ``root``, ``path`` relative to it, without
    directories of skipped names."""
    slots = spark.sparkContext.defaultParallelism
    dirs = spark.createDataFrame([("",)], "path string")
    files = None
    while files is None or not dirs.isEmpty():
        level = materialize(dirs.repartition(slots, "path").mapInArrow(_list(root), "path string, is_dir boolean, length bigint"), "listing")
        found = level.filter(~F.col("is_dir")).select("path", "length")
        files = found if files is None else files.unionByName(found)
        dirs = level.filter(F.col("is_dir") & ~in_skipped_dir("path")).select("path")
    return files


def scan_sources(spark: SparkSession, root: str, repo_id: str | None = None,
                 max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """``files(repo_id, path, length, source, language)`` for a directory tree; ``path`` is
    relative to ``root`` (skipped names are tested below it)."""
    keep = keep_source_files(list_files(spark, root), max_bytes)
    slots = spark.sparkContext.defaultParallelism
    rows = keep.repartition(slots, "path").mapInArrow(_read(root), "path string, length bigint, language string, content binary")
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "�", "")
    return rows.select(F.lit(root if repo_id is None else repo_id).alias("repo_id"), "path", "length", text.alias("source"), "language")


def write_files(files: DataFrame, root: str) -> None:
    """Write ``files(path, source)`` as UTF-8 files below ``root``, in tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(root)
        for batch in batches:
            for path, source in zip(batch.column("path").to_pylist(), batch.column("source").to_pylist(), strict=True):
                name = f"{base}/{path}"
                fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(name) as f:
                    f.write((source or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.select("path", "source").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
