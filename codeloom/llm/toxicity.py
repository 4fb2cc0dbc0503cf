"""Toxicity by a subsequence-kernel SVM with Nyström landmarks.

Kernel.  A word is its letters in lower case behind a start mark; other characters inside it
are skipped, and runs of one-letter words count as one word ("i d i o t").  Its features are
all three-letter subsequences that span at most five letters, with weight DECAY per letter
skipped; the kernel of two words is the product of their features, divided by a norm of their
lengths.  An inserted or changed letter leaves most subsequences of an insult in place.

Model.  A sentence is as toxic as its worst word and a text as its worst sentence.  A text's
label says that some sentence in it is toxic, so training is latent: each toxic text stands for
its worst word so far, at first the one most telling by log-odds; clean texts give their
words and, from the second round, the worst of each sentence.  The SVM (squared hinge, Newton)
works on Nyström features of LANDMARKS words.  As the kernel is a finite sum over
subsequences, the landmark expansion folds into one weight per subsequence, so scoring a text
is a sum of table look-ups, equal to summing its kernels with all landmarks.  A logistic curve
over the training texts' scores gives the probability.

The model is fitted on at most ``SAMPLE`` labelled texts a class (those with the smallest hash
of their id); every text is scored whole.  Labels, lang, source and doc_id are no inputs.

Cases: null and empty texts, and texts without letters, get the score of no insult; without
both labels in the training rows all scores are 0; a doc_id that is null or labelled twice
differently trains nothing; repeated rows count once each; an empty table gives no rows; other
columns are kept by ``score`` and ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import table

from .common import limit_batches, mix, slices, text_buffer, tidy

SAMPLE = 1500          # labelled texts of either class that the model is fitted on
LANDMARKS = 160
DECAY = 0.7
SPAN = 5
ROUNDS = 3
COST = 4.0
# (second, third) offsets of the subsequences of three letters within SPAN.
OFFSETS = tuple((a, b) for b in range(2, SPAN) for a in range(1, b))

# Letter classes: 0 no letter, 1-26 a-z, 27-58 U+00E0-U+00FF, 59-62 other letters, 63 the start.
START = 63
_CLASS = np.zeros(0x250, np.uint8)
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[0xE0:0x100] = _CLASS[0xC0:0xE0] = np.arange(27, 59)
_CLASS[0xDF], _CLASS[0xD7], _CLASS[0xF7] = 27 + 31, 0, 0
_CLASS[0x100:0x250] = 59 + np.arange(0x150) // 2 % 4


def classes(points: np.ndarray) -> np.ndarray:
    """Letter class of each code point; letters beyond Latin are told apart by their number."""
    out = np.zeros(len(points), np.uint8)
    low = points < 0x250
    out[low] = _CLASS[points[low]]
    high = ~low & (points < 0x2000) | (points >= 0x2E80) & (points < 0x1F000)
    out[high] = 59 + (points[high] >> 1) % 4
    return out


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in a UTF-8 buffer: the letter classes of all words, each behind a START; where
    each word begins in them; each word's text; and each word's sentence (over all texts)."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    cut = lead[bounds]
    letter = classes(points)
    blank = (points <= 32) & ((points == 32) | (points >= 9) & (points <= 13))
    at = np.flatnonzero(letter)
    if not len(at):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), none, none, none
    # A word begins at a letter with a blank, or a text's start, after the letter before it.
    blanks = np.cumsum(blank, dtype=np.int32)[at]
    text = np.searchsorted(cut, at, "right") - 1 if len(cut) > 2 else np.zeros(len(at), np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (blanks[1:] != blanks[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    if len(first) > 1:  # runs of one-letter words are one word
        joined = (size[1:] == 1) & (size[:-1] == 1) & (text[first[1:]] == text[first[:-1]])
        first = first[np.append(True, ~joined)]
        size = np.diff(np.append(first, len(at)))
    ends = np.cumsum((points == 46) | (points == 33) | (points == 63) | (points == 10), dtype=np.int32)[at[first]]
    sentence = np.cumsum(np.append(True, (ends[1:] != ends[:-1]) | (text[first[1:]] != text[first[:-1]]))) - 1
    begin = first + np.arange(len(first))
    out = np.empty(len(at) + len(first), np.uint8)
    out[begin] = START
    keep = np.ones(len(out), bool)
    keep[begin] = False
    out[keep] = letter[at]
    return out, begin, text[first], sentence


def occurrences(letters: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of offsets: the subsequence at every position, whether it lies inside one
    word, and its weight."""
    code = letters.astype(np.int32)
    word = np.zeros(len(code), np.int32)
    word[begin[1:]] = 1
    np.cumsum(word, out=word)
    padded = np.concatenate([code, np.zeros(SPAN, np.int32)])
    wordp = np.concatenate([word, np.full(SPAN, -1, np.int32)])
    n = len(code)
    inside = {b: wordp[b:b + n] == word for b in range(2, SPAN)}
    high = code << 12
    for a, b in OFFSETS:
        yield high + (padded[a:a + n] << 6) + padded[b:b + n], inside[b], DECAY ** (b - 2)


def norms(size: np.ndarray) -> np.ndarray:
    """Root of the summed squared weights of a word with so many letters and the start."""
    total = np.zeros(len(size))
    for _, b in OFFSETS:
        total += np.maximum(0, size + 1 - b) * DECAY ** (2 * (b - 2))
    return np.sqrt(np.maximum(total, 1.0))


def word_scores(letters: np.ndarray, begin: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(begin):
        return np.zeros(0)
    total = np.zeros(len(letters), np.float32)
    for code, inside, w in occurrences(letters, begin):
        got = weights[code]
        got *= inside
        got *= np.float32(w)
        total += got
    return np.add.reduceat(total, begin) / norms(np.diff(np.append(begin, len(letters))) - 1)


def word_arrays(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words, as bytes of letter classes, in the form of ``words_of``."""
    size = np.array([len(w) + 1 for w in words], np.int64)
    return np.frombuffer(b"".join(bytes([START]) + w for w in words), np.uint8), np.cumsum(size) - size


def feature_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, normed weight) of all occurrences in some words."""
    letters, begin = word_arrays(words)
    size = np.diff(np.append(begin, len(letters)))
    row = np.repeat(np.arange(len(words)), size)
    scale = 1 / norms(size - 1)
    parts = [(row[ok], code[ok], w * scale[row[ok]]) for code, ok, w in occurrences(letters, begin)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def kernel(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Kernel values of each word with each landmark."""
    l_row, l_code, l_w = feature_rows(landmarks)
    known, l_at = np.unique(l_code, return_inverse=True)
    dense = np.zeros((len(known), len(landmarks)))
    np.add.at(dense, (l_at, l_row), l_w)
    row, code, w = feature_rows(words)
    i = np.minimum(np.searchsorted(known, code), len(known) - 1)
    ok = known[i] == code
    order = np.argsort(row[ok], kind="stable")
    row, i, w = row[ok][order], i[ok][order], w[ok][order]
    out, step = np.zeros((len(words), len(landmarks))), 256
    for a in range(0, len(words), step):
        p, q = np.searchsorted(row, (a, a + step))
        rows = min(step, len(words) - a)
        sums = np.bincount((row[p:q] - a) * len(known) + i[p:q], w[p:q], rows * len(known))
        out[a:a + rows] = sums.reshape(rows, -1) @ dense
    return out


# ---------------------------------------------------------------------------- training

def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = COST) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM with bias, by Newton steps on its active rows."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-3
    beta = np.zeros(x1.shape[1])
    for _ in range(30):
        active = y * (x1 @ beta) < 1
        xa = x1[active] * weight[active, None]
        new = np.linalg.solve(ridge + 2 * cost * xa.T @ x1[active], 2 * cost * xa.T @ y[active])
        if np.allclose(new, beta, atol=1e-8):
            break
        beta = new
    return beta[:-1], float(beta[-1])


def logistic(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of label 1, by Newton steps; lightly shrunk."""
    x = np.stack([score, np.ones(len(score))], 1)
    w = np.array([1.0, 0.0])
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (balance * (p - y)) + 1e-2 * w
        w = w - np.linalg.solve((x * (balance * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), grad)
    return max(float(w[0]), 1e-6), float(w[1])


class Bag:
    """The words of some texts: distinct words, and each (text, sentence, word) once."""

    def __init__(self, texts: list[str]):
        data = "".join(texts).encode()
        bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
        number: dict[bytes, int] = {}
        rows = []
        for a, b in slices(bounds):
            letters, begin, text, sentence = words_of(np.frombuffer(data[bounds[a]:bounds[b]], np.uint8), bounds[a:b + 1] - bounds[a])
            raw, edge = letters.tobytes(), np.append(begin, len(letters))
            found = [number.setdefault(raw[i + 1:j], len(number)) for i, j in zip(edge, edge[1:], strict=False)]
            rows.append(np.stack([text + a, sentence + (rows[-1][-1, 1] + 1 if rows and len(rows[-1]) else 0), np.array(found, np.int64)], 1)
                        if found else np.zeros((0, 3), np.int64))
        self.words = list(number)
        self.rows = np.unique(np.concatenate(rows), axis=0) if rows else np.zeros((0, 3), np.int64)

    def sentences_with(self, which: np.ndarray) -> tuple[np.ndarray, int]:
        """For each word the different sentences of those texts that hold it, and their number;
        copies of a text, or of most of it, count once."""
        rows = self.rows[which[self.rows[:, 0]]]
        if not len(rows):
            return np.zeros(len(self.words)), 0
        sentence, at = np.unique(rows[:, 1], return_inverse=True)
        key = np.zeros(len(sentence), np.uint64)
        np.add.at(key, at, mix(rows[:, 2].astype(np.uint64) + np.uint64(1)))
        _, first = np.unique(key, return_index=True)
        once = np.zeros(len(sentence), bool)
        once[first] = True
        return np.bincount(rows[once[at], 2], minlength=len(self.words)), len(first)

    def worst(self, score: np.ndarray, by: int) -> np.ndarray:
        """The row with the highest word score of each text (by 0) or sentence (by 1)."""
        order = np.lexsort((self.rows[:, 2], -score[self.rows[:, 2]], self.rows[:, by]))
        key = self.rows[order, by]
        return self.rows[order[np.append(True, key[1:] != key[:-1])]] if len(order) else self.rows


def fit(texts: list[str], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float, float, float]:
    """(weight per subsequence, bias, slope, shift) from labelled texts."""
    y = np.asarray(labels)
    empty = np.zeros(1 << 18, np.float32), 0.0, 1.0, -1000.0
    if not (y == 1).any() or not (y == 0).any():
        return empty
    bag = Bag(texts)
    if not bag.words:
        return empty
    rng = np.random.default_rng(seed)
    count = [bag.sentences_with(y == c) for c in (0, 1)]
    odds = np.log((count[1][0] + 0.5) / (count[1][1] + 1)) - np.log((count[0][0] + 0.5) / (count[0][1] + 1))
    odds -= 2 / np.sqrt(count[1][0] + 0.25)      # rare words tell little
    long_enough = np.array([len(w) >= 2 for w in bag.words])
    score = np.where(long_enough, odds, odds.min())
    telling_words = np.flatnonzero(long_enough & (odds > 3))
    ordinary = np.flatnonzero(long_enough & (count[0][0] > 0))
    clean_words = rng.choice(ordinary, min(len(ordinary), 5000), replace=False)
    weights, bias = None, 0.0
    for round_ in range(ROUNDS):
        worst = bag.worst(score, 0)
        chosen = worst[y[worst[:, 0]] == 1, 2]
        if round_ == 0 and (odds[chosen] > 0).any():
            chosen = chosen[odds[chosen] > 0]
        tally = Counter(chosen.tolist()) | Counter({int(i): int(count[1][0][i]) for i in telling_words})
        hard = np.zeros(0, np.int64)
        if round_:
            per_sentence = bag.worst(score, 1)
            hard = np.unique(per_sentence[y[per_sentence[:, 0]] == 0, 2])
            hard = hard[np.argsort(-score[hard], kind="stable")][:5000]
        positive = np.array(sorted(tally, key=lambda i: (-tally[i], i))[:2000], np.int64)
        negative = np.setdiff1d(np.concatenate([clean_words, hard]), positive)
        if not len(negative):
            return empty
        mine = positive[:LANDMARKS * 2 // 3]
        landmarks = [bag.words[i] for i in [*mine, *rng.choice(negative, min(len(negative), LANDMARKS - len(mine)), replace=False)]]
        # Nyström: features k(w, Z) K(Z, Z)^(-1/2).
        values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
        ok = values > 1e-6 * values.max()
        root = vectors[:, ok] / np.sqrt(values[ok])
        both = np.concatenate([positive, negative])
        x = kernel([bag.words[i] for i in both], landmarks) @ root
        target = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        share = np.array([min(tally[i], 20) for i in positive], float)
        weight = np.concatenate([share * (len(negative) / max(1.0, share.sum())) * 0.5, np.ones(len(negative))])
        beta, bias = svm(x, target, weight)
        alpha = root @ beta
        weights = np.zeros(1 << 18)
        row, code, w = feature_rows(landmarks)
        np.add.at(weights, code, alpha[row] * w)
        weights = weights.astype(np.float32)
        score = word_scores(*word_arrays(bag.words), weights) + bias
    worst = bag.worst(score, 0)
    best = np.full(len(texts), -2.0)
    best[worst[:, 0]] = np.maximum(-2.0, score[worst[:, 2]])
    return weights, bias, *logistic(best, y)


def training_rows(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[int]]:
    """At most ``sample`` texts of either label, by hash, from the rows not held out."""
    keep = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where(keep & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
             .where("toxic = other"))
    order = F.xxhash64("doc_id")
    some = known.where("toxic = 1").orderBy(order, "doc_id").limit(sample).unionByName(
        known.where("toxic = 0").orderBy(order, "doc_id").limit(sample)).select("doc_id", "toxic")
    rows = (documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).orderBy("doc_id").toArrow())
    return [t or "" for t in rows.column("text").to_pylist()], rows.column("toxic").to_pylist()


def _probability(best: np.ndarray, model: tuple) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model[2] * best + model[3], -500, 500)))


def _score(model: tuple[np.ndarray, float, float, float]):
    weights, bias = model[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffer(batch.column("row").field("text").cast(pa.large_string()))
            best = np.full(batch.num_rows, -2.0)
            for a, b in slices(bounds, 1 << 20):
                letters, begin, text, _ = words_of(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a])
                np.maximum.at(best, text + a, word_scores(letters, begin, weights) + bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_probability(best, model))], ["row", "score"])

    return run


def score(documents: DataFrame, model: tuple) -> DataFrame:
    """The rows of ``documents`` as a struct ``row`` with the text's score."""
    limit_batches(documents.sparkSession)
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    return rows.mapInArrow(tidy(_score(model)), rows.select("row", F.lit(0.0).alias("score")).schema)


def clean_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are not predicted toxic."""
    model = fit(*training_rows(documents, labels))
    return score(documents, model).where("score < 0.5").select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(*training_rows(documents, labels))
    held = F.coalesce(F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score(documents.select("doc_id", "text"), model).select(
        "row.doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
