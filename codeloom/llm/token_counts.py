"""Edit-aware token counts: a segment tree of pre-tokens per document.

A document's text is split into pre-tokens by the tokenizer's pattern; each is encoded on its
own, so a document's count is the sum over its pre-tokens.  They are the leaves' content of a
segment tree: a leaf holds up to LEAF pre-tokens (length in characters, token count), and
inner nodes hold the sums of both below them.

An edit (start, end, replacement) gives code points of the text as it was before the edits.
The pattern reads at most one character beyond the end of a pre-token's match and one more
before it backs off, so pre-tokens that end two or more characters before an edit stand; those
from there on are split again from the first one's start until a boundary behind the edit falls
on an old boundary.  From that point both splits are the same, up to the next edit.  Only the
pre-tokens in between are encoded, the touched leaves are replaced, and the sums on their paths
to the root are updated.  Edits whose regions meet are one region.

Trees are a binary column, so they can be kept in a table and edited later (``build_trees``,
``edit_trees``); ``edited_counts`` does both in one pass over the documents.

Cases: null and empty texts have an empty tree and take edits as any other; an edit is clipped
to the text; null edits, and edits that begin before an earlier one ends (by start, end, place
in the list), are left out and not counted; a null replacement is empty; insertions at one
place are applied in order; repeated rows count each; an empty table gives no rows; other
columns are ignored.  Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import table

from .common import limit_batches, need

LEAF = 64
CACHE = 400_000      # pre-tokens whose count a worker keeps
ROWS = 64            # documents that a task turns into rows at once

Edit = tuple[int, int, str]


class Counter:
    """Splits text by the pattern and counts the tokens of pre-tokens."""

    def __init__(self, ranks_file: str, pattern: str):
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        try:
            return list(map(self.known.__getitem__, pieces))
        except KeyError:
            new = set(pieces).difference(self.known)
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
                new = set(pieces)
            self.known.update((p, len(self.encode(p))) for p in new if len(p) <= 256)
            return [self.known[p] if p in self.known else len(self.encode(p)) for p in pieces]


_counters: dict[tuple[str, str], Counter] = {}


def counter_for(ranks_file: str, pattern: str) -> Counter:
    """The worker process's counter, kept from task to task."""
    if (ranks_file, pattern) not in _counters:
        _counters[ranks_file, pattern] = Counter(ranks_file, pattern)
    return _counters[ranks_file, pattern]


class Tree:
    """Leaves of (lengths, counts) under nodes of their sums; node 1 is the root, node i's
    children are 2 i and 2 i + 1, and leaf j is node width + j."""

    def __init__(self, leaves: list[tuple[list[int], list[int]]]):
        self.leaves = leaves or [([], [])]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens, self.pieces = ([0] * (2 * self.width) for _ in range(3))
        for j in range(len(self.leaves)):
            self._sum_leaf(j)
        for i in range(self.width - 1, 0, -1):
            self._sum_node(i)

    @classmethod
    def of(cls, lengths: list[int], counts: list[int]) -> Tree:
        return cls([(lengths[i:i + LEAF], counts[i:i + LEAF]) for i in range(0, len(lengths), LEAF)])

    def _sum_leaf(self, j: int) -> None:
        lengths, counts = self.leaves[j]
        i = self.width + j
        self.chars[i], self.tokens[i], self.pieces[i] = sum(lengths), sum(counts), len(lengths)

    def _sum_node(self, i: int) -> None:
        for s in (self.chars, self.tokens, self.pieces):
            s[i] = s[2 * i] + s[2 * i + 1]

    def find(self, nth: int) -> tuple[int, int]:
        """Leaf and place in it of the nth pre-token."""
        i = 1
        while i < self.width:
            i *= 2
            if nth >= self.pieces[i]:
                nth -= self.pieces[i]
                i += 1
        return i - self.width, nth

    def tokens_before(self, chars: int) -> int:
        """Tokens of the pre-tokens that end within the first ``chars`` characters."""
        i, out = 1, 0
        while i < self.width:
            i *= 2
            if chars >= self.chars[i]:
                chars -= self.chars[i]
                out += self.tokens[i]
                i += 1
        for length, count in zip(*self.leaves[i - self.width], strict=True) if i - self.width < len(self.leaves) else ():
            if length > chars:
                break
            chars -= length
            out += count
        return out

    def replace(self, regions: list[tuple[int, int, list[int], list[int]]]) -> Tree:
        """Replace pre-tokens [i, j), given in order, by others; a tree whose leaves have
        outgrown is built anew from its leaves."""
        touched = set()
        for i, j, lengths, counts in reversed(regions):
            if i < self.pieces[1]:
                leaf, at = self.find(i)
            else:  # behind the last pre-token
                leaf = len(self.leaves) - 1
                at = len(self.leaves[leaf][0])
            rest, put = j - i, (lengths, counts)
            while True:
                mine = self.leaves[leaf]
                cut = min(rest, len(mine[0]) - at)
                self.leaves[leaf] = tuple(m[:at] + p + m[at + cut:] for m, p in zip(mine, put, strict=True))
                touched.add(leaf)
                rest -= cut
                if not rest:
                    break
                leaf, at, put = leaf + 1, 0, ([], [])
        if any(len(self.leaves[j][0]) > 4 * LEAF for j in touched):
            return Tree.of([x for a, _ in self.leaves for x in a], [x for _, b in self.leaves for x in b])
        nodes = set()
        for j in touched:
            self._sum_leaf(j)
            nodes.add((self.width + j) // 2)
        while nodes - {0}:
            for i in nodes - {0}:
                self._sum_node(i)
            nodes = {i // 2 for i in nodes}
        return self

    def to_bytes(self) -> bytes:
        """Leaf sizes, then lengths and counts, as variable-length numbers in columns."""
        parts = [[len(a) for a, _ in self.leaves], [x for a, _ in self.leaves for x in a], [x for _, b in self.leaves for x in b]]
        return b"".join(_packed(p) for p in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        at, columns = 0, []
        for _ in range(3):
            column, at = _unpacked(data, at)
            columns.append(column)
        sizes, lengths, counts = columns
        edges = [0, *accumulate(sizes)]
        return cls([(lengths[a:b], counts[a:b]) for a, b in zip(edges, edges[1:], strict=False)])


def _packed(numbers: list[int]) -> bytes:
    """Count, number of large ones, a byte each (255 for large ones), and the large ones."""
    x = np.array(numbers, np.int64)
    large = x[x >= 255].astype("<u4")
    return np.array([len(x), len(large)], "<u4").tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes() + large.tobytes()


def _unpacked(data: bytes, at: int) -> tuple[list[int], int]:
    n, many = np.frombuffer(data, "<u4", 2, at).tolist()
    x = np.frombuffer(data, np.uint8, n, at + 8).astype(np.int64)
    x[x == 255] = np.frombuffer(data, "<u4", many, at + 8 + n)
    return x.tolist(), at + 8 + n + 4 * many


def sound_edits(edits, size: int) -> list[Edit]:
    """Edits in order, clipped to the text, without nulls and those that overlap an earlier one."""
    known = [(min(max(e[0], 0), size), min(max(e[1], 0), size), e[2] or "") for e in edits or () if e is not None and e[0] is not None and e[1] is not None]
    out, done = [], 0
    for s, e, r in sorted((e for e in known if e[0] <= e[1]), key=lambda e: e[:2]):
        if s >= done:
            out.append((s, e, r))
            done = e
    return out


def build(text: str, counter: Counter) -> Tree:
    pieces = counter.pattern.findall(text)
    return Tree.of(list(map(len, pieces)), counter.counts(pieces))


def edit(text: str, tree: Tree, edits: list[Edit], counter: Counter) -> tuple[str, Tree, int]:
    """The edited text, its tree, and how many pre-tokens were encoded for it.  ``edits`` must
    be as from ``sound_edits``."""
    if not edits:
        return text, tree, 0
    ends = list(accumulate(x for lengths, _ in tree.leaves for x in lengths))
    starts = [0, *ends]          # the last one is the text's end
    parts, done, moved, shift = [], 0, [], 0
    for s, e, r in edits:
        parts += [text[done:s], r]
        done = e
        shift += len(r) - (e - s)
        moved.append(shift)      # new position less old position behind the edit
    parts.append(text[done:])
    new = "".join(parts)
    match = counter.pattern.match
    first = [bisect_left(ends, s - 1) for s, _, _ in edits]   # first pre-token that the edit may change
    regions, k, encoded = [], 0, 0
    while k < len(edits):
        i = first[k]
        at, pieces = starts[i] + (moved[k - 1] if k else 0), []
        while True:
            old = at - moved[k]
            # An edit whose first pre-token begins here or before belongs to this region.
            while k + 1 < len(edits) and at >= edits[k][1] + moved[k] and starts[first[k + 1]] <= old:
                k += 1
                old = at - moved[k]
            if old >= edits[k][1] and starts[j := bisect_left(starts, old)] == old:
                break
            m = match(new, at)
            pieces.append(m.group())
            at = m.end()
        regions.append((i, j, list(map(len, pieces)), counter.counts(pieces)))
        encoded += len(pieces)
        k += 1
    return new, tree.replace(regions), encoded


# ------------------------------------------------------------------------------- Spark

def _rows(columns: dict[str, pa.DataType], make: Callable) -> Callable:
    """A batch function that yields the rows ``make`` returns for each input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                rows = [make(r) for r in batch.slice(a, ROWS).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), columns.values(), strict=True)], list(columns))

    return run


EDITS = "array<struct<start:int,end:int,replacement:string>>"


def build_trees(documents: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, text, n_tokens, tree) of ``documents(doc_id, text)``."""
    def make(r: dict) -> tuple:
        tree = build(r["text"] or "", counter_for(ranks_file, pattern))
        return r["doc_id"], r["text"], tree.tokens[1], tree.to_bytes()

    return need(documents, doc_id="bigint", text="string").mapInArrow(
        _rows({"doc_id": pa.int64(), "text": pa.string(), "n_tokens": pa.int64(), "tree": pa.binary()}, make),
        "doc_id bigint, text string, n_tokens bigint, tree binary")


def edit_trees(trees: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, text, n_tokens, tree, n_encoded) after the edits of ``trees(doc_id, text, tree, edits)``."""
    def make(r: dict) -> tuple:
        text = r["text"] or ""
        edits = sound_edits([e and (e["start"], e["end"], e["replacement"]) for e in r["edits"] or ()], len(text))
        text, tree, encoded = edit(text, Tree.from_bytes(r["tree"]), edits, counter_for(ranks_file, pattern))
        return r["doc_id"], text, tree.tokens[1], tree.to_bytes(), encoded

    return need(trees, doc_id="bigint", text="string", tree="binary", edits=EDITS).mapInArrow(
        _rows({"doc_id": pa.int64(), "text": pa.string(), "n_tokens": pa.int64(), "tree": pa.binary(), "n_encoded": pa.int64()}, make),
        "doc_id bigint, text string, n_tokens bigint, tree binary, n_encoded bigint")


COUNTS = {"doc_id": pa.int64(), "n_pieces": pa.int64(), "n_tokens": pa.int64(), "n_edits": pa.int64(),
          "n_encoded": pa.int64(), "n_tokens_edited": pa.int64()}


def edited_counts(documents: DataFrame, ranks_file: str, pattern: str, edits_of: Callable[[str], list[Edit]]) -> DataFrame:
    """Counts of each document before and after the edits that ``edits_of`` makes of its text."""
    def make(r: dict) -> tuple:
        text, counter = r["text"] or "", counter_for(ranks_file, pattern)
        tree = build(text, counter)
        n_pieces, before = tree.pieces[1], tree.tokens[1]
        edits = sound_edits(edits_of(text), len(text))
        _, tree, encoded = edit(text, tree, edits, counter)
        return r["doc_id"], n_pieces, before, len(edits), encoded, tree.tokens[1]

    limit_batches(documents.sparkSession)
    return need(documents, doc_id="bigint", text="string").mapInArrow(
        _rows(COUNTS, make), ", ".join(f"{c} bigint" for c in COUNTS))


_CLEAN_UP = re.compile(r"\n+|[0-9]{4,}|[*$%&#!]{3,}")


def clean_up_edits(text: str) -> list[Edit]:
    """The edits of a usual clean-up: lines are joined, long numbers become 0, runs of marks go."""
    return [(m.start(), m.end(), " " if text[m.start()] == "\n" else "0" if text[m.start()].isdigit() else "") for m in _CLEAN_UP.finditer(text)]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return edited_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, clean_up_edits)
