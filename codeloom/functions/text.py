"""Column helpers for text: lines, whitespace, tokens, languages, chunk keys.

All helpers return native Spark Columns (no Python UDFs).  Regex patterns are passed
as Python strings through the DataFrame API, never embedded in SQL text, so Spark's
string-literal unescaping cannot alter them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.splitlines() breaks at these, besides \n and \r\n.
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
# Python's str.isspace() set: Unicode White_Space plus the four separators 0x1c-0x1f.
WS = "[\\s\u001c-\u001f]"
WS_RUN = "(?U)" + WS + "+"
# The same set as characters, derived from Python itself, for ``trim``/``ltrim``.
WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Fixed values that must equal the reference: extension -> language map (13 entries).
LANGUAGE_BY_EXTENSION = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".rb": "ruby",
    ".cpp": "cpp",
    ".c": "c",
    ".cs": "csharp",
    ".php": "php",
}

# Directory / file names that exclude a path when any part equals one.
SKIP_DIRS = [
    "node_modules", ".git", "__pycache__", ".venv", "venv", "env",
    "dist", "build", ".next", "target", "vendor", "coverage",
    ".pytest_cache", ".mypy_cache", "eggs", ".eggs",
]


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lines_of(text) -> Column:
    """Python ``str.splitlines()``: split at every line break, drop only a final
    empty piece; empty text gives an empty array."""
    parts = F.split(col_(text), LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)) \
        .otherwise(parts)


def strip_ws(c) -> Column:
    """Python ``str.strip()`` (Unicode whitespace at both ends)."""
    return F.trim(col_(c), F.lit(WS_CHARS))


def lstrip_ws(c) -> Column:
    return F.ltrim(col_(c), F.lit(WS_CHARS))


def indent_of(c) -> Column:
    """``len(line) - len(line.lstrip())``; a tab counts as one."""
    return F.length(col_(c)) - F.length(lstrip_ws(c))


# The same set as an explicit character class: much faster than a (?U) class in Java.
# The runs beyond U+00FF are ranges, which is one test a run instead of one a character.
WS_CLASS_RUN = "[" + "".join(f"\\u{ord(c):04x}" for c in WS_CHARS if not "\u2000" <= c <= "\u200a") + "\\u2000-\\u200a]+"


def tokens(text) -> Column:
    """``text.lower().split()``: lower-case, split at whitespace runs, no empties."""
    return F.array_remove(F.split(F.lower(col_(text)), WS_CLASS_RUN, -1), "")


def language_of(path) -> Column:
    """Language from the lower-cased last suffix of the file name, else null.

    Like ``pathlib.Path.suffix``: a name that starts with its only dot (``.py``)
    has no suffix."""
    suffix = F.lower(F.regexp_extract(col_(path), r"[^/.][^/]*(\.[^./]+)$", 1))
    m = F.create_map(*[F.lit(x) for kv in LANGUAGE_BY_EXTENSION.items() for x in kv])
    return F.element_at(m, F.when(suffix != "", suffix))


def in_skipped_dir(path) -> Column:
    """True when any '/'-separated part of ``path`` equals a skipped name."""
    return F.arrays_overlap(F.split(col_(path), "/"), F.array(*[F.lit(s) for s in SKIP_DIRS]))


def chunk_id(file_path="file_path", name="name", start_line="start_line") -> Column:
    """``{path}::{name}::{start_line}``; unique within a repository."""
    return F.concat_ws("::", col_(file_path), col_(name), col_(start_line).cast("string"))


def display_location(file_path="file_path", start_line="start_line", end_line="end_line") -> Column:
    return F.concat(col_(file_path), F.lit(":"), col_(start_line).cast("string"), F.lit("-"),
                    col_(end_line).cast("string"))


def _present(c) -> Column:
    return col_(c).isNotNull() & (col_(c) != "")


def embed_text() -> Column:
    """Text given to the embedder and the BM25 tokenizer: a metadata header, a blank
    line, then the chunk content.  Empty parent/docstring count as absent."""
    header = F.concat(
        F.lit("# "), F.col("language"), F.lit(" "), F.col("chunk_type"), F.lit(": "), F.col("name"),
        F.when(_present("parent_name"), F.concat(F.lit(" (in class "), F.col("parent_name"), F.lit(")")))
         .otherwise(F.lit("")),
        F.lit("\n# File: "), F.col("file_path"), F.lit(" lines "),
        F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"),
        F.when(_present("docstring"), F.concat(F.lit("\n# Doc: "), F.substring("docstring", 1, 200)))
         .otherwise(F.lit("")),
    )
    return F.concat(header, F.lit("\n\n"), F.col("content"))


def calls_in(content, pattern: str, exclude: list[str], limit: int = 15) -> Column:
    """Distinct identifiers followed by ``(``, minus ``exclude``, sorted, first ``limit``.

    Sorting before the cut is an intended difference: the reference cuts an unordered
    set, which is not reproducible."""
    found = F.regexp_extract_all(col_(content), F.lit(pattern), 1)
    kept = F.array_except(F.array_distinct(found), F.array(*[F.lit(x) for x in exclude]))
    return F.slice(F.array_sort(kept), 1, limit)
