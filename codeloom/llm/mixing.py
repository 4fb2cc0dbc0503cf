"""Mixing sources to target weights by systematic sampling.

Sources, ordered by code point with null last, get the weights in turn.  The mix is to hold
``share`` times all words, split by weight; no source gives more than ``cap`` times its own
size, and what it can't give goes to the others by weight until none is above.  So every
target is min(cap * size, weight * level) for one level, found in closed form.

Each document's expected copies are its source's target / size, in fixed-point units, so all
sums are exact.  Within a source, documents stand in order of (size class, salt, size,
doc_id, text hash); the expected copies are prefix-summed in that order, one random offset
of the source (from its name and a seed) is added, and a copy is emitted for each integer
boundary crossed.  Neighbours are of similar size, so words follow the copies closely.

The prefix sum has three levels, so no task sees a whole source: sums of blocks (source,
class, salt), prefix over the classes of a source and over the salts of a class, and a
window inside each block.  Rows are shuffled once, to their block.

Cases: null text has size 0 and, as any empty text, takes no words; null sources are one
source, the last; a source of size 0 has target 0 and gives nothing; rows with equal doc_id
are drawn each by itself; an empty table gives no rows; other columns are ignored by
``draw``'s arithmetic and kept as they are in ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.session import table

from .common import WORD, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SALTS = 64
UNIT = 1 << 24    # fixed-point units of one copy
SEED = "mix-1"
BLOCK = ["_src", "_nosrc", "_cls", "_salt"]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes(_src, _nosrc, source_size)``, one row per source, with target and units added."""
    by_name = W.orderBy("_nosrc", "_src")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.lit(float(weights[-1]))
    for k, w in enumerate(weights[:-1]):
        weight = F.when(turn == k, F.lit(float(w))).otherwise(weight)
    s = sizes.withColumn("w", weight).withColumn("top", F.col("source_size") * F.lit(cap))
    # Sources in order of the level at which they reach their cap.
    upto = W.orderBy(F.col("top") / F.col("w"), "_nosrc", "_src")
    all_rows = W.partitionBy()
    s = (s.withColumn("total", F.sum("source_size").over(all_rows) * F.lit(share))
         .withColumn("full", F.sum("top").over(upto.rowsBetween(W.unboundedPreceding, 0)) - F.col("top"))
         .withColumn("rest", F.sum("w").over(upto.rowsBetween(0, W.unboundedFollowing)))
         .withColumn("lvl", (F.col("total") - F.col("full")) / F.col("rest"))
         .withColumn("nth", F.row_number().over(upto))
         .withColumn("level", F.min_by("lvl", F.when(F.col("lvl") <= F.col("top") / F.col("w"), F.col("nth"))).over(all_rows)))
    bound = F.col("level").isNull() | (F.col("top") <= F.col("w") * F.col("level"))
    target = F.when(bound, F.col("top")).otherwise(F.col("w") * F.col("level"))
    units = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size") * F.lit(float(UNIT)))).otherwise(F.lit(0))
    return s.select("_src", "_nosrc", "source_size", target.alias("target"), units.cast("bigint").alias("units"))


def offset() -> Column:
    """The source's random offset in [0, UNIT), from its name and the seed."""
    name = F.when(F.col("_nosrc") == 1, F.lit(SEED)).otherwise(F.concat(F.lit(SEED + "="), F.col("_src")))
    return F.conv(F.substring(F.md5(name), 1, 6), 16, 10).cast("bigint")


def draw(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Each row of ``documents(doc_id, text, source)`` as a struct ``_row`` with its size,
    source_size, target and copies."""
    doc_id, text, source = (F.col(f"_row.`{c}`") for c in ("doc_id", "text", "source"))
    rows = (documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"))
            .withColumn("size", n_words(text))
            .withColumn("_src", F.coalesce(source, F.lit("")))
            .withColumn("_nosrc", source.isNull().cast("int"))
            .withColumn("_cls", F.floor(F.sqrt("size")).cast("int"))
            .withColumn("_salt", F.pmod(F.coalesce(doc_id, F.lit(0)), F.lit(SALTS)).cast("int")))
    blocks = written(rows.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "mix-blocks")
    plan = targets(blocks.groupBy("_src", "_nosrc").agg(F.sum("words").alias("source_size")), weights, share, cap)
    source_of = W.partitionBy("_src", "_nosrc").orderBy("_cls")
    class_of = W.partitionBy("_src", "_nosrc", "_cls").orderBy("_salt")
    classes = blocks.groupBy("_src", "_nosrc", "_cls").agg(F.sum("n").alias("n")).withColumn(
        "above", F.sum("n").over(source_of) - F.col("n"))
    before = (blocks.withColumn("inner", F.sum("n").over(class_of) - F.col("n")).drop("n")
              .join(classes.drop("n"), ["_src", "_nosrc", "_cls"]).join(plan, ["_src", "_nosrc"])
              .select(*BLOCK, "source_size", "target", "units", (F.col("above") + F.col("inner")).alias("_before")))
    nth = F.row_number().over(W.partitionBy(*BLOCK).orderBy("size", doc_id, F.xxhash64(text)))
    crossed = lambda n: F.shiftright(n * F.col("units") + offset(), UNIT.bit_length() - 1)
    drawn = rows.join(before, BLOCK).withColumn("_n", nth + F.col("_before"))
    return drawn.select("_row", "size", "source_size", "target",
                        (crossed(F.col("_n")) - crossed(F.col("_n") - 1)).cast("bigint").alias("copies"))


def mix(documents: DataFrame, **how) -> DataFrame:
    """The rows of the mix, with the columns of ``documents``; a row drawn twice is there twice."""
    drawn = draw(documents, **how).where("copies > 0")
    return drawn.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in documents.columns])


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return draw(docs).select("_row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS src, CAST(source IS NULL AS INT) AS nosrc,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT src, nosrc, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY nosrc, src) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
             source_size * 2.0::DOUBLE AS top FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
                 - (sum(top) OVER (ORDER BY top / w, nosrc, src ROWS UNBOUNDED PRECEDING) - top))
                / sum(w) OVER (ORDER BY top / w, nosrc, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl,
             row_number() OVER (ORDER BY top / w, nosrc, src) AS nth FROM w),
v AS (SELECT (SELECT lvl FROM l WHERE lvl <= top / w ORDER BY nth LIMIT 1) AS level),
t AS (SELECT src, nosrc, source_size,
             CASE WHEN level IS NULL OR top <= w * level THEN top ELSE w * level END AS target FROM l, v),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 16777216.0::DOUBLE) ELSE 0 END::BIGINT AS units,
             ('0x' || substr(md5(CASE WHEN nosrc = 1 THEN 'mix-1' ELSE 'mix-1=' || src END), 1, 6))::BIGINT AS off FROM t),
n AS (SELECT doc_id, size, source_size, target, units, off,
             row_number() OVER (PARTITION BY src, nosrc ORDER BY floor(sqrt(size)),
               ((coalesce(doc_id, 0) % 64) + 64) % 64, size, doc_id NULLS FIRST) AS n
      FROM d JOIN u USING (src, nosrc))
SELECT doc_id, size, source_size, target,
       (((n * units + off) >> 24) - (((n - 1) * units + off) >> 24)) * size AS taken FROM n
"""
