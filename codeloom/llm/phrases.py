"""Phrase collocation mining by stripes: each prefix keys a counter of its next words.

Texts (null: empty) are lower-cased (A-Z), cut at ``[.,;:!?]`` and 0x0A-0x0D into pieces and those at
blanks and tabs into words.  Everything is per lang (null: ``und``).  A phrase of 2 to LONGEST words that
occurs at least LEAST times inside pieces is a candidate.

1. Shards.  One scan packs the words of about SHARD_BYTES of texts of one lang; words that occur
   LEAST times in all langs together get global numbers (``encode``), all others become gaps.
2. Stripes, for prefixes of 1, 2, 3 and 4 words.  A shard makes the stripes of the frequent
   prefixes in it: next word -> count, for next words whose phrase without the first word is
   frequent too (no other can be), and END -> all occurrences of the prefix.  Stripes are cut into
   parts by a hash of prefix and next word, so no prefix, however frequent, is one task's work,
   and the parts are merged elementwise by a task per hash range.  Each shard is told by one bit an
   entry which of its extensions are frequent, and drops all positions that they do not cover.
3. The merged stripes hold everything: entries of LEAST or more are the candidates; END entries are the
   totals l and r of the cuts' parts; and the largest entry that extends a phrase, on the right in
   its own stripe, on the left in that of a prefix which begins one word earlier, decides subsumption
   (a longer phrase is never more frequent than its middle links, so one word more is enough).
4. Scores are exact: floor(1000 a n / (l r)) in 38-digit integers, the lowest-scoring cut counting,
   ties to the smallest first part.

Nothing is broadcast but tables whose size has been checked (``common.small``); counts grow with the corpus.

Cases: null and empty texts have no words but their lang may have others; repeated rows count
as often as they occur; an empty table gives no rows; doc_id plays no part; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codeloom.session import table

from .common import limit_batches, mix, need, slices, small, text_buffer, tidy
from .encode import SHARD_BYTES, VOCABULARY, global_numbers, local_words, number_words, shard_numbers, unzipped, word_rows, zipped, zstd

LEAST = 100
LONGEST = 5
TOP = 2000
PERCENT = 100               # a phrase goes if a longer one has this share of its occurrences
GATHER_BYTES = 16 << 20     # of texts that a task sorts by lang at once
RANGE_ENTRIES = 4 << 20     # positions of shards behind a hash range; their entries are fewer
LEVEL = 7                   # of the packed arrays' compression: they are all of the disk used
END = -1                    # in a stripe: all occurrences of the prefix; in a shard: a gap

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CUT = np.zeros(256, bool)
_CUT[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_WORD = ~_CUT
_WORD[[9, 32]] = False
_rng = np.random.Generator(np.random.PCG64(11))
_ODD = _rng.integers(0, 2**64, 16, np.uint64) | np.uint64(1)

SHARDS = f"shard bigint, lang string, n bigint, local binary, {VOCABULARY}"
STATE = "lang string, shard bigint, range int, n bigint, ids binary, heads binary, keys binary, counts binary"
MERGED = "lang string, range int, shard bigint, keys binary, counts binary, bits binary"


def packed(a: np.ndarray) -> bytes:
    return zipped(a, LEVEL)


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the words, whose bytes are ``data[_WORD[data]]``, and for each word whether a piece begins there."""
    first = np.zeros(len(data) + 1, bool)
    first[bounds[:-1]] = True
    full = np.zeros(len(data) + 2, bool)
    full[1:-1] = _WORD[data]
    start = np.flatnonzero(full[1:-1] & (~full[:-2] | first[:-1]))
    end = np.flatnonzero(full[1:-1] & (~full[2:] | first[1:])) + 1
    gaps = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_CUT[data], out=gaps[1:])
    place = gaps[start] + np.searchsorted(bounds, start, "right")   # differs where a cut or another text lies between
    return end - start, np.diff(place, prepend=-1) != 0


@tidy
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = shard_numbers()

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.Table.from_batches(held)
        langs = texts["lang"].combine_chunks().dictionary_encode()
        code = langs.indices.to_numpy(zero_copy_only=False)
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            data, bounds = text_buffer(texts["text"].take(pa.array(np.flatnonzero(code == i))))
            for a, b in slices(bounds, SHARD_BYTES):
                part = _LOWER[data[bounds[a]:bounds[b]]]
                sizes, begins = pieces(part, bounds[a:b + 1] - bounds[a])
                local, vocabulary = local_words(part[_WORD[part]], sizes)
                # Gaps stand before the first word of a piece.
                seq = np.insert(local, np.flatnonzero(begins), END)
                yield _record([(next(number), lang, len(local), packed(seq.astype("<i4")), *vocabulary)], SHARDS)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= GATHER_BYTES:
            yield from flush(held)
            held, size = [], 0
    if held:
        yield from flush(held)


def global_ids(local: np.ndarray, entry: list[dict] | None) -> np.ndarray:
    """A shard's words as global numbers, with one gap for several."""
    numbers = np.append(global_numbers(entry), END)     # the last is what END points at
    if numbers.max() >= 1 << 31:
        raise OverflowError("more than 2**31 frequent words")
    ids = numbers[local]
    gap = ids == END
    return ids[~(gap & np.concatenate([[True], gap[:-1]]))] if len(ids) else ids


def hashes(keys: np.ndarray) -> np.ndarray:
    h = np.zeros(len(keys), np.uint64)
    for j in range(keys.shape[1]):
        h = mix(h + (keys[:, j].astype(np.int64) + 2).astype(np.uint64) * _ODD[j])
    return h


def number(ids: np.ndarray, heads: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the phrases of k words that begin at the positions marked in ``heads``, in the order of
    their words; -1 elsewhere."""
    rank = np.full(len(ids), -1, np.int64)
    at = np.flatnonzero(heads)
    r = ids[at]
    for j in range(1, k):
        r = np.unique(r << 32 | ids[at + j], return_inverse=True)[1]
    rank[at] = r
    return rank


def frequent(ids: np.ndarray, heads: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and heads without the positions that no phrase of k words from a head covers."""
    at = np.flatnonzero(heads)
    cover = np.zeros(len(ids) + k, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    keep = np.flatnonzero(np.cumsum(cover)[:len(ids)] > 0)
    holes = np.flatnonzero(np.diff(keep) > 1) + 1
    return np.insert(ids[keep], holes, END), np.insert(heads[keep], holes, False)


def stripes(ids: np.ndarray, heads: np.ndarray, k: int, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts, bounds, entry) of the phrases of k words: rows of prefix and next word (or END), how
    often each occurs, the bounds of the hash ranges, and the row of the phrase that begins at each position
    (-1: none).  ``heads`` marks the frequent phrases of k - 1 words.  The same input gives the same rows."""
    rank = number(ids, heads, k - 1)
    n = max(len(ids) - k + 1, 0)
    at = np.flatnonzero((rank[:n] >= 0) & (rank[1:n + 1] >= 0)) if n else np.zeros(0, np.int64)
    pair = rank[at] << 32 | ids[at + k - 1]
    _, first, place, counts = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
    begins = np.flatnonzero(rank >= 0)
    _, head, total = np.unique(rank[begins], return_index=True, return_counts=True)
    whole = ids[at[first][:, None] + np.arange(k)].reshape(-1, k)
    ends = np.concatenate([ids[begins[head][:, None] + np.arange(k - 1)].reshape(-1, k - 1), np.full((len(head), 1), END)], axis=1)
    keys = np.concatenate([whole, ends]).astype("<i4")
    part = ((hashes(keys) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")     # inside a range in the order of the words, which packs well
    new = np.empty(len(order), np.int64)
    new[order] = np.arange(len(order))
    entry = np.full(len(ids), -1, np.int64)
    entry[at] = new[place]
    return keys[order], np.concatenate([counts, total])[order], np.searchsorted(part[order], np.arange(ranges + 1)), entry


def _count(k: int, ranges: int, before: int):
    """Stripes of phrases of k words.  ``before`` was the number of ranges of those of k - 1 words."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
                if k == 2:
                    ids = global_ids(unzipped(get("local"), "<i4"), get("map"))
                    heads = ids >= 0
                else:
                    ids = unzipped(get("ids"), "<i4").astype(np.int64)
                    heads = np.unpackbits(unzipped(get("heads"), "u1"), count=len(ids)).astype(bool)
                    _, _, cut, entry = stripes(ids, heads, k - 1, before)
                    bits = np.zeros(cut[-1] + 1, bool)     # the last is what no phrase points at
                    for answer in get("answers") or []:
                        a, b = cut[answer["range"]:answer["range"] + 2]
                        bits[a:b] = np.unpackbits(unzipped(answer["bits"], "u1"), count=b - a)
                    ids, heads = frequent(ids, bits[entry], k - 1)
                if not heads.any():
                    continue
                keys, counts, cut, _ = stripes(ids, heads, k, ranges)
                lang, shard = get("lang"), get("shard")
                rows = [(lang, shard, r, None, None, None, packed(np.diff(keys[a:b].T, prepend=np.int32(0))), packed(counts[a:b].astype("<i4")))
                        for r, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if a < b]
                if k < LONGEST:
                    rows.append((lang, shard, None, len(ids), packed(ids.astype("<i4")), packed(np.packbits(heads)), None, None))
                yield _record(rows, STATE)
    return run


def _merge(k: int, least: int):
    @tidy
    def run(group: pa.Table) -> pa.Table:
        keys = [np.cumsum(unzipped(x, "<i4").reshape(k, -1), axis=1, dtype=np.int32).T for x in group["keys"].to_pylist()]
        sizes = [len(x) for x in keys]
        keys = np.concatenate(keys)
        counts = np.concatenate([unzipped(x, "<i4") for x in group["counts"].to_pylist()]).astype(np.int64)
        h = hashes(keys)
        order = np.argsort(h, kind="stable")
        new = (keys[order][1:] != keys[order][:-1]).any(axis=1)
        if (new & (h[order][1:] == h[order][:-1])).any():   # two phrases of one hash
            order = np.lexsort(keys.T)
            new = (keys[order][1:] != keys[order][:-1]).any(axis=1)
        new = np.concatenate([[True], new])
        total = np.add.reduceat(counts[order], np.flatnonzero(new))
        first = order[new]
        keep = total >= least
        bits = np.empty(len(order), np.uint8)
        bits[order] = (keep & (keys[first, -1] != END))[np.cumsum(new) - 1]
        lang, part = group["lang"][0].as_py(), group["range"][0].as_py()
        rows = [(lang, part, s, None, None, packed(np.packbits(b))) for s, b in zip(group["shard"].to_pylist(), np.split(bits, np.cumsum(sizes)[:-1]))]
        rows.append((lang, part, None, packed(keys[first][keep]), packed(total[keep].astype("<i8")), None))
        return pa.Table.from_batches([_record(rows, MERGED)])
    return run


def _entries(k: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, keys, counts in zip(*[batch.column(c).to_pylist() for c in ("lang", "keys", "counts")]):
                words, counts = unzipped(keys, "<i4"), unzipped(counts, "<i8")
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(counts), pa.string()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) + 1, k, dtype=np.int32)), pa.array(words)),
                    pa.array(counts)], ["lang", "phrase", "a"])
    return run


def merged_stripes(documents: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, sizes, words) of ``documents(text, lang)``: ``entries(lang, phrase array<int>, a)`` of all
    stripes, of ``least`` or more (a last word END: the prefix's total); ``sizes(lang, n)``; ``words(id, word, times)``."""
    limit_batches(documents.sparkSession)
    docs = need(documents, text="string", lang="string").withColumn("lang", F.coalesce("lang", F.lit("und")))
    shards = zstd(docs.mapInArrow(_pack, SHARDS), "phrase-shards")
    sizes = zstd(shards.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0"), "phrase-sizes")
    words, numbers = number_words(shards, least)
    state, entries, ranges = shards, None, 1
    for k in range(2, LONGEST + 1):
        before, ranges = ranges, int((state.agg(F.sum("n")).first()[0] or 0) // RANGE_ENTRIES) + 1
        # What goes back to the shards grows with the corpus: it is never broadcast.
        if k == 2:
            whole = shards.select("shard", "lang", "local").join(numbers.hint("merge"), "shard", "left")
        else:
            answers = merged.where("shard IS NOT NULL").groupBy("shard").agg(F.collect_list(F.struct("range", "bits")).alias("answers"))  # noqa: F821
            whole = state.where("ids IS NOT NULL").join(answers.hint("merge"), "shard", "left")
        state = zstd(whole.mapInArrow(_count(k, ranges, before), STATE), f"stripes-{k}")
        merged = zstd(state.where("range IS NOT NULL").groupBy("lang", "range").applyInArrow(_merge(k, least), MERGED), f"merged-{k}")
        found = merged.where("keys IS NOT NULL").mapInArrow(_entries(k), "lang string, phrase array<int>, a bigint")
        entries = found if entries is None else entries.unionByName(found)
    return zstd(entries, "phrase-entries"), sizes, zstd(word_rows(words), "phrase-words")


def collocations(documents: DataFrame, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate of ``documents(text, lang)`` that no longer one subsumes."""
    entries, sizes, words = merged_stripes(documents, least)
    last = F.element_at("phrase", -1)
    found = entries.where(last != END)
    totals = small(zstd(entries.where(last == END).select("lang", F.expr("slice(phrase, 1, size(phrase) - 1)").alias("part"), F.col("a").alias("f")),
                        "phrase-totals"))
    shorter = lambda i: F.slice("phrase", i, F.size("phrase") - 1)
    longer = found.select("lang", F.explode(F.array(shorter(1), shorter(2))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("above"))
    left = found.join(longer, ["lang", "phrase"], "left").where(
        F.col("above").isNull() | (F.lit(100) * F.col("above") < percent * F.col("a"))).drop("above")
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1))).select(
        "lang", "phrase", "a", "k", F.expr("slice(phrase, 1, k)").alias("part"), F.expr("slice(phrase, k + 1, size(phrase))").alias("tail"))
    cuts = cuts.join(totals.withColumnRenamed("f", "l"), ["lang", "part"]).drop("part").withColumnRenamed("tail", "part").join(
        totals.withColumnRenamed("f", "r"), ["lang", "part"]).join(small(sizes), "lang")
    scored = cuts.withColumn("score", F.expr("CAST(1000 AS DECIMAL(4,0)) * (CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(16,0))) div "
                                             "(CAST(l AS DECIMAL(16,0)) * CAST(r AS DECIMAL(16,0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    named = best.select("lang", "phrase", F.posexplode("phrase").alias("at", "id")).join(small(words.select("id", "word")), "id")
    texts = named.groupBy("lang", "phrase").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w")).select(
        "lang", "phrase", F.array_join("w.word", " ").alias("text"))
    return best.join(texts, ["lang", "phrase"]).select("lang", F.col("text").alias("phrase"), "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def top_phrases(found: DataFrame, top: int = TOP) -> DataFrame:
    """Each lang's first ``top`` phrases, with their rank."""
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("bigint"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_phrases(collocations(table(spark, sf_dir, "documents"))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP11_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(t, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t
        FROM documents WHERE text IS NOT NULL)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, w[i:i + k - 1] AS ws
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
            FROM (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS k FROM p))),
f AS (SELECT lang, k, ws, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE k > 1),
inner_parts AS (
  SELECT lang, ws[i:i + m - 1] AS ws, max(f) AS above
  FROM (SELECT lang, ws, k, f, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, ws, k, f, unnest(range(2, k)) AS m FROM c))
  GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inner_parts USING (lang, ws) WHERE above IS NULL OR 100 * above < 100 * f),
cuts AS (SELECT lang, ws, f AS a, j, ws[1:j] AS x, ws[j + 1:] AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
s AS (SELECT cuts.lang, cuts.ws, a, j, fx.f AS l, fy.f AS r, n.n AS n,
             ((1000::HUGEINT * a * n.n) // (fx.f::HUGEINT * fy.f)) AS score
      FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.ws = x JOIN f fy ON fy.lang = cuts.lang AND fy.ws = y JOIN n ON n.lang = cuts.lang),
b AS (SELECT *, array_to_string(ws, ' ') AS phrase FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, j) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM k WHERE rank <= 2000
"""
