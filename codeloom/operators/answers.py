"""Answer clean-up (Q6): normalise recorded model answers to

    Summary sentence.

    - **Label:** value [citation]
    ...

A job over an answers table: each answer is rewritten by a chain of Java regex
replacements (look-arounds and ``(?m)`` are supported, back-references are ``$1``),
split into lines, folded into at most six bullets by an ``aggregate`` with struct state
(the one sequential step; it runs inside the row over the answer's own lines), and
each bullet gets a bold label.  No shuffle.  Checked with hand-worked rows and, on
composed texts too, against a SQL twin that folds by a recursive state machine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import WS_CHARS, col_, strip_ws

# Fixed values that must equal the reference: the normalisation rules in order.
REWRITES = [
    (r"(?U)•\s*", "- "),
    (r"(?U)[·‣]\s*", "- "),
    (r"(?U)(^|\n)(\s*)[\*\+]\s+", "$1$2- "),
    (r"(?U)([.!?])\s+(-\s+)", "$1\n$2"),
    (r"(?U)(?<!\n)\s+-\s+(?=[A-Z`\[\*])", "\n- "),
    (r"(?U)([.!?])\s+(\d+)[.)]\s+", "$1\n- "),
    (r"(?U)([.!?])\s+([A-Z][A-Za-z ]{1,22}: )", "$1\n- $2"),
    (r"(?d)(?U)(?m)^\s*([A-Z][A-Za-z ]{1,22}: )", "- $1"),
]
NUMBERED_RE = r"(?d)(?U)^\d+[.)]\s+(.*)"
HEADER_RE = r"(?d)(?U)^#{1,3}\s+(.*)"
LABEL_RE = r"(?d)(?U)^\*{0,2}([A-Za-z][A-Za-z\s]{0,20})\*{0,2}:\s+(.*)"
BOLD_RE = r"^\*\*[^*]+\*\*"
MAX_BULLETS = 6
JOIN_UNDER = 120       # a continuation joins the current bullet while it is shorter
ORPHAN_OVER = 8        # an orphan sentence longer than this starts a bullet
LABEL_COLON_BEFORE = 22


def py_title(c) -> Column:
    """Python ``str.title()``: a cased character is upper-cased when the previous
    character is not cased, lower-cased otherwise (so ``1st`` -> ``1St``)."""
    chars = F.split(col_(c), "")
    cased = lambda x: F.lower(x) != F.upper(x)
    return F.array_join(F.transform(chars, lambda ch, i: F.when(
        (i > 0) & cased(F.get(chars, i - 1)), F.lower(ch)).otherwise(F.upper(ch))), "")


def _fold_lines(lines: Column) -> Column:
    """Bullets from the lines after the summary (steps: existing bullet, numbered item,
    header, ``Label: value``, continuation or orphan)."""
    init = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def flush(acc):
        return F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])

    def step(acc, line):
        s = strip_ws(line)
        num = F.regexp_extract(s, NUMBERED_RE, 1)
        head = F.regexp_extract(s, HEADER_RE, 1)
        lab = strip_ws(F.regexp_extract(s, LABEL_RE, 1))
        val = strip_ws(F.regexp_extract(s, LABEL_RE, 2))
        is_label = s.rlike(LABEL_RE) & (F.length(lab) >= 2) & (F.length(lab) <= 22)
        joins = (acc["cur"] != "") & (F.length(acc["cur"]) < JOIN_UNDER)
        new_cur = (F.when(s == "", acc["cur"])
                   .when(s.startswith("- "), s)
                   .when(s.rlike(NUMBERED_RE), F.concat(F.lit("- "), num))
                   .when(s.rlike(HEADER_RE), F.concat(F.lit("- **"), strip_ws(head), F.lit("**")))
                   .when(is_label, F.concat(F.lit("- **"), py_title(lab), F.lit(":** "), val))
                   .when(joins, F.concat(acc["cur"], F.lit(" "), s))
                   .when(F.length(s) > ORPHAN_OVER, F.concat(F.lit("- "), s))
                   .otherwise(F.lit("")))
        keeps = (s == "") | (~s.startswith("- ") & ~s.rlike(NUMBERED_RE) & ~s.rlike(HEADER_RE) & ~is_label & joins)
        return F.struct(F.when(keeps, acc["done"]).otherwise(flush(acc)).alias("done"), new_cur.alias("cur"))

    res = F.aggregate(lines, init, step)
    return F.when(res["cur"] != "", F.concat(res["done"], F.array(res["cur"]))).otherwise(res["done"])


def _label(b: Column) -> Column:
    content = strip_ws(F.substring(b, 3, 1 << 30))
    colon = F.instr(content, ":") - 1            # 0-based, -1 when absent
    lbl = strip_ws(F.substring(content, 1, colon))
    val = strip_ws(F.substring(content, colon + 2, 1 << 30))
    dash = F.instr(content, " — ")
    d_lbl = strip_ws(F.substring(content, 1, dash - 1))
    d_val = strip_ws(F.substring(content, dash + 3, 1 << 30))
    labelled = (F.when(content.rlike(BOLD_RE), content)
                .when((colon > 0) & (colon < LABEL_COLON_BEFORE) & ~content.startswith("[") & ~content.startswith("`"),
                      F.concat(F.lit("**"), py_title(lbl), F.lit(":** "), val))
                .when(dash > 0, F.concat(F.lit("**"), d_lbl, F.lit("** — "), d_val))
                .otherwise(content))
    return F.concat(F.lit("- "), labelled)


def answer_lines(raw) -> Column:
    """The answer after the regex normalisations, split into right-trimmed lines."""
    text = F.replace(F.replace(strip_ws(col_(raw)), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    for pat, rep in REWRITES:
        text = F.regexp_replace(text, pat, rep)
    return F.transform(F.split(text, "\n", -1), lambda l: F.rtrim(l, F.lit(WS_CHARS)))


def format_lines(raw, lines) -> Column:
    """Summary line plus labelled bullets from the normalised ``lines``."""
    raw, lines = col_(raw), col_(lines)
    first = F.array_position(F.transform(lines, lambda l: strip_ws(l) != ""), True).cast("int")  # 1-based; 0 if none
    summary = F.when(first > 0, strip_ws(F.element_at(lines, F.greatest(first, F.lit(1))))).otherwise(F.lit(""))
    rest = F.when(first > 0, F.slice(lines, first + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
    bullets = F.slice(_fold_lines(rest), 1, MAX_BULLETS)
    clean = F.transform(bullets, _label)
    out = F.when(F.size(clean) > 0, F.concat(summary, F.lit("\n\n"), F.array_join(clean, "\n"))).otherwise(summary)
    return F.when(raw.isNull() | (strip_ws(raw) == ""), raw).otherwise(out)


def normalise_answers(df: DataFrame, col: str = "text", out: str = "formatted") -> DataFrame:
    """Add ``out``: the normalised form of ``col``.  The regex chain runs once per row
    (its line array is projected as a column before the fold reads it)."""
    return (df.withColumn("_nl", answer_lines(col))
            .withColumn(out, format_lines(col, "_nl")).drop("_nl"))
