"""Column helpers over answer text: citations and fenced code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.text import col_, strip_ws

# Fixed values that must equal the reference: citation and fenced-code patterns.
CITATION_RE = r"\[([^\]]+\.\w+[:\d][^\]]{0,30})\]"
FENCE_RE = r"```(\w*)\n?([\s\S]*?)```"


def citations(text) -> Column:
    """Bracketed ``[file.ext:lines]`` citations, in order of appearance."""
    return F.regexp_extract_all(col_(text), F.lit(CITATION_RE), 1)


def code_blocks(text) -> Column:
    """``array<struct<lang, code>>`` of fenced blocks; the body is trimmed."""
    langs = F.regexp_extract_all(col_(text), F.lit(FENCE_RE), 1)
    codes = F.regexp_extract_all(col_(text), F.lit(FENCE_RE), 2)
    return F.transform(F.arrays_zip(langs.alias("lang"), codes.alias("code")),
                       lambda z: F.struct(z["lang"].alias("lang"), strip_ws(z["code"]).alias("code")))
