"""Benchmark decontamination, in DataFrame functions only.

Words are the lower-cased text between blanks; a text's shingles are its five-word sequences,
or the whole sequence if it has fewer words, as a multiset of 64-bit hashes.  An item of n
words is leaked where a window of n words of a document has weighted Jaccard similarity (sum of
the smaller by sum of the larger multiplicities) of at least ``SIMILARITY`` with it.

1. Windows.  The items' distinct shingles meet those of all documents in a join.  For a document
   and an item size, the sorted positions that hold a shingle of such an item give every start
   whose window, clipped to the document, holds enough of them to reach the threshold: with m
   shingles against the item's k, at least SIMILARITY / (1 + SIMILARITY) * (m + k).  The order of
   the item's parts does not matter.
2. Fingerprints.  Every window and item gets a 64-bit SimHash of its shingle multiset.
3. Candidates.  Fingerprints are cut into RADIUS + 1 blocks; two within RADIUS bits agree in a
   block.  Blocks of two or three bits select little by themselves, so a block's key also holds a
   shingle: of n shingles in the order of their hashes, the first n - ceil(SIMILARITY * n) + 1 are
   the prefix, and two multisets that reach the threshold share one of their prefixes.  The join
   on (size, shingle, block, value) finds every pair that does; a pair is kept in the first block
   that agrees, once per shared prefix shingle, then made distinct.  An item that a third of all
   documents hold is spread over as many keys as it has blocks and prefix shingles.
4. Verification.  The exact similarity is taken from the two shingle multisets.

The most similar of a pair's windows is reported; of equal ones the first, then the longest.

At similarity 0.8 the expected distance is 10 of 64 bits with deviation 3; RADIUS 23 leaves a
miss below 1e-5 at the threshold and less above it.

The outer forms of posexplode and inline keep the optimizer from inferring a filter on the
array's size, which would be pushed below and have the split text recomputed per element.

The smaller side of a join is broadcast only below ``common.BROADCAST`` rows, else both are shuffled.

Cases: null and empty texts have no shingles and neither leak nor match; an item of fewer
than five words is found only in documents that are the same word sequence; items with equal
texts each match; documents are told apart by (doc_id, text hash), so repeated rows give one
result row per item; an empty table on either side gives no leaks; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import table

from .common import WORD, need, small, written

K = 5
SIMILARITY = 0.8
RADIUS = 23


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def with_shingles(df: DataFrame) -> DataFrame:
    """Adds n, the number of words, and sh, the shingle hashes in text order, to ``text``."""
    w = lambda i: F.get("w", i)
    several = F.transform(F.sequence(F.lit(0), F.col("n") - K), lambda i: F.xxhash64(*[w(i + j) for j in range(K)]))
    sh = F.when(F.col("n") >= K, several).when(F.col("n") >= 1, F.array(F.xxhash64(F.array_join("w", " "), F.col("n"))))
    return (df.withColumn("w", F.coalesce(words(F.col("text")), F.array().cast("array<string>"))).withColumn("n", F.size("w"))
            .withColumn("sh", F.coalesce(sh, F.array().cast("array<bigint>"))).drop("w", "text"))


def simhash(sh: Column) -> Column:
    """64-bit SimHash of a multiset of hashes."""
    def bit(b: Column) -> Column:
        return F.aggregate(sh, F.lit(0), lambda s, h: s + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1)).cast("int") * 2 - 1)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"),
                       lambda s, b: s.bitwiseOR(F.when(bit(b) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))))


def blocks(fingerprint: Column) -> Column:
    """(block, value) of the RADIUS + 1 parts of a fingerprint."""
    edge = [i * 64 // (RADIUS + 1) for i in range(RADIUS + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
                     for i, (a, b) in enumerate(zip(edge, edge[1:], strict=False))])


def first_block(a: Column, b: Column) -> Column:
    """The first block in which two fingerprints agree; null if there is none."""
    edge = [i * 64 // (RADIUS + 1) for i in range(RADIUS + 2)]
    differ = a.bitwiseXOR(b)
    agree = [F.when(F.shiftrightunsigned(differ, x).bitwiseAND(F.lit((1 << (y - x)) - 1)) == 0, i)
             for i, (x, y) in enumerate(zip(edge, edge[1:], strict=False))]
    return F.coalesce(*agree)


def prefix(sh: Column) -> Column:
    """The distinct shingles of which two multisets of similarity SIMILARITY share one."""
    return F.array_distinct(F.slice(F.sort_array(sh), 1, F.size(sh) - F.ceil(F.size(sh) * SIMILARITY - 1e-9).cast("int") + 1))


def candidates(windows: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, th, size, start_word, n_words, item_id), once each: the windows and items of a size
    that share a prefix shingle and a block, and differ in at most RADIUS bits."""
    parts = lambda p: [F.explode(prefix(F.col("sh"))).alias("h"), F.col(p), F.col("size")]
    keys = (windows.select("doc_id", "th", "start_word", "n_words", *parts("print"))
            .select("*", F.inline_outer(blocks(F.col("print")))))
    marks = (marks.withColumnRenamed("item_sh", "sh").select("item_id", *parts("item_print"))
             .select("*", F.inline_outer(blocks(F.col("item_print")))))
    return (keys.join(small(marks), ["size", "h", "block", "value"])
            .where((F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
                   & (F.col("block") == first_block(F.col("print"), F.col("item_print"))))
            .select("doc_id", "th", "size", "start_word", "n_words", "item_id").dropDuplicates())


def common_shingles(a: Column, b: Column) -> Column:
    """Sum over distinct hashes of the smaller multiplicity."""
    times = lambda xs, h: F.size(F.filter(xs, lambda y: y == h))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, h: s + F.least(times(a, h), times(b, h)))


def enough(m: Column, k: Column) -> Column:
    """Shared shingles that m shingles against k need for SIMILARITY."""
    return F.ceil((m + k) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9).cast("int")


def window_codes(at: Column, n: Column, size: Column) -> Column:
    """start_word * (size + 1) + n_words of every window, clipped to a document of n words, that
    holds enough of the sorted shingle positions ``at``."""
    k, all_ = F.greatest(F.lit(1), size - K + 1), F.greatest(F.lit(1), n - K + 1)
    code = lambda start, length: start.cast("bigint") * (size + 1) + length
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    need_ = enough(k, k)
    # Whole windows: those with the i-th to (i + need - 1)-th position that the run of i - 1 has not given.
    run = lambda i: span(F.greatest(F.lit(0), F.get(at, i + need_ - 1) - k + 1, F.get(at, i - 1) + 1), F.least(all_ - k, F.get(at, i)))
    whole = F.transform(F.flatten(F.transform(span(F.lit(0), F.size(at) - need_), run)), lambda s: code(s, size))
    # Windows of m < k shingles at the start and at the end of the document.
    cut = span(F.ceil(k * SIMILARITY - 1e-9).cast("int"), F.least(k - 1, all_))
    first = F.filter(cut, lambda m: F.coalesce(F.get(at, enough(m, k) - 1) < m, F.lit(False)))
    last = F.filter(cut, lambda m: F.coalesce(F.get(at, F.size(at) - enough(m, k)) >= all_ - m, F.lit(False)))
    return F.array_distinct(F.concat(whole, F.transform(first, lambda m: code(F.lit(0), m + K - 1)),
                                     F.transform(last, lambda m: code(all_ - m, m + K - 1))))


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, th, item_id, start_word, n_words, similarity): the best window of each leaked
    item in each document; th is the hash of the document's text."""
    items = with_shingles(need(benchmark, item_id="bigint", text="string").where("text is not null")).where("n > 0")
    items = written(items.withColumnRenamed("n", "size"), "items")
    theirs = items.select("size", F.explode_outer("sh").alias("h")).dropDuplicates()
    docs = need(documents, doc_id="bigint", text="string").withColumn("th", F.xxhash64("text"))

    met = (with_shingles(docs).select("doc_id", "th", "n", F.posexplode_outer("sh").alias("p", "h"))
           .join(small(theirs), "h").where((F.col("size") >= K) | (F.col("n") == F.col("size")))
           .groupBy("doc_id", "th", "n", "size").agg(F.sort_array(F.collect_set("p")).alias("at")))
    codes = window_codes(F.col("at"), F.col("n"), F.col("size"))
    met = (met.where(F.size("at") >= SIMILARITY * (F.col("size") - K + 1) - 1e-9)
           .select("doc_id", "th", "size", codes.alias("codes")).where(F.size("codes") > 0))
    met = written(met, "met")

    # Texts with windows once more, to cut the windows out of them.
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])
    hit = small(written(met.select("doc_id", "th").dropDuplicates(), "hit"))
    texts = with_shingles(docs.join(hit, same(docs, hit), "left_semi").dropDuplicates(["doc_id", "th"]))
    start, n = F.expr("int(code div (size + 1))"), F.expr("int(code % (size + 1))")
    windows = (met.select("doc_id", "th", "size", F.explode_outer("codes").alias("code"))
               .join(texts.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "sh"),
                     F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
               .select("doc_id", "th", "size", start.alias("start_word"), n.alias("n_words"),
                       F.slice("sh", start + 1, F.greatest(F.lit(1), n - K + 1)).alias("sh"))
               .withColumn("print", simhash(F.col("sh"))))
    windows = written(windows, "windows")

    marks = items.select("item_id", "size", simhash(F.col("sh")).alias("item_print"), F.col("sh").alias("item_sh"))
    marks = written(marks, "marks")
    found = candidates(windows, marks)
    shared = common_shingles(F.col("sh"), F.col("item_sh"))
    both = (found.join(windows.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("size").alias("z"),
                                      F.col("start_word").alias("b"), F.col("n_words").alias("c"), "sh"),
                       F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")) & (F.col("size") == F.col("z"))
                       & (F.col("start_word") == F.col("b")) & (F.col("n_words") == F.col("c")))
            .join(marks.select("item_id", "item_sh", "size"), ["item_id", "size"])
            .withColumn("shared", shared)
            .withColumn("similarity", F.col("shared") / (F.size("sh") + F.size("item_sh") - F.col("shared"))))
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("b"), F.col("n_words")))
    return (both.where(F.col("similarity") >= SIMILARITY).groupBy("doc_id", "th", "item_id").agg(best.alias("x"))
            .select("doc_id", "th", "item_id", (-F.col("x.b")).alias("start_word"), F.col("x.n_words").alias("n_words"), "x.similarity"))


def clean_rows(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` in which no item is leaked."""
    bad = written(leaks(documents, benchmark).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).dropDuplicates(), "leaking")
    doc = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row")
    rows = documents.select(doc, F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_th"))
    return rows.join(small(bad), F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left_anti").select(
        *[F.col(f"_row.`{c}`").alias(c) for c in documents.columns])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


OP7_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) AS n, unnest(range(len(w) - 4)) AS p, w FROM d WHERE len(w) >= 5),
dh AS (SELECT doc_id, n, p, array_to_string(w[p + 1:p + 5], ' ') AS h FROM ds),
it AS (SELECT item_id, len(w) AS size, unnest(range(len(w) - 4)) AS o, w FROM i WHERE len(w) >= 5),
ih AS (SELECT item_id, size, o, array_to_string(w[o + 1:o + 5], ' ') AS h FROM it),
met AS (SELECT doc_id, n, item_id, size, p FROM dh JOIN ih USING (h) GROUP BY ALL),
pair AS (SELECT doc_id, n, item_id, size FROM met GROUP BY ALL HAVING count(*) >= 0.8 * (size - 4) - 1e-9),
st AS (SELECT DISTINCT doc_id, n, item_id, size, unnest(range(p - size + 5, p + 1)) AS f FROM met JOIN pair USING (doc_id, n, item_id, size)),
win AS (SELECT DISTINCT doc_id, item_id, size, greatest(0, f) AS s, least(n, f + size) - greatest(0, f) AS c FROM st),
wc AS (SELECT win.doc_id, win.item_id, size, s, c, h, count(*) AS m
       FROM win JOIN dh ON dh.doc_id = win.doc_id AND dh.p BETWEEN s AND s + c - 5 GROUP BY ALL),
ic AS (SELECT item_id, h, count(*) AS m FROM ih GROUP BY ALL),
sh AS (SELECT wc.doc_id, wc.item_id, size, s, c, sum(least(wc.m, ic.m)) AS x FROM wc JOIN ic USING (item_id, h) GROUP BY ALL),
si AS (SELECT doc_id, item_id, s, c, x / (c - 4 + size - 4 - x) AS similarity FROM sh WHERE c >= 5
       UNION ALL SELECT doc_id, item_id, 0, len(d.w), 1.0 FROM d JOIN i ON d.w = i.w WHERE len(d.w) BETWEEN 1 AND 4),
r AS (SELECT doc_id, item_id, s, c, similarity,
             row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s, c DESC) AS k FROM si WHERE similarity >= 0.8)
SELECT doc_id, item_id, s::INT AS start_word, c::INT AS n_words, similarity FROM r WHERE k = 1
"""
