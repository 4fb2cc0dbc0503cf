import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import token_counts as T

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
COUNTER = T.counter_for(RANKS, PATTERN)
TEXT = st.text(alphabet="ab 1\n\t'srev.,!é日 ", max_size=150)
EDITS = st.lists(st.tuples(st.integers(-2, 160), st.integers(-2, 160), st.one_of(st.none(), st.text(alphabet="a 1\n'r.", max_size=6))), max_size=8)


def plain(text, edits):
    for s, e, r in reversed(edits):
        text = text[:s] + r + text[e:]
    return text


def check(text, edits):
    edits = T.sound_edits(edits, len(text))
    new, tree, encoded = T.edit(text, T.build(text, COUNTER), edits, COUNTER)
    assert new == plain(text, edits)
    pieces = COUNTER.pattern.findall(new)
    assert [x for a, _ in tree.leaves for x in a] == list(map(len, pieces))
    assert [x for _, b in tree.leaves for x in b] == [len(COUNTER.encode(p)) for p in pieces]
    assert tree.tokens[1] == len(COUNTER.encode(new)) and tree.chars[1] == len(new)
    for i in range(1, tree.width):
        assert tree.tokens[i] == tree.tokens[2 * i] + tree.tokens[2 * i + 1]
    for at in range(0, len(new) + 1, 7):
        ends, total = 0, 0
        for p in pieces:
            ends += len(p)
            if ends > at:
                break
            total += len(COUNTER.encode(p))
        assert tree.tokens_before(at) == total
    assert T.Tree.from_bytes(tree.to_bytes()).leaves == tree.leaves
    return encoded


@settings(max_examples=600, deadline=None)
@given(TEXT, EDITS)
def test_equals_encoding_the_edited_text(text, edits):
    check(text, edits)


def test_long_texts_and_repeated_edits():
    text = "Some words, 1234 numbers!! and\n\nlines that's fine. " * 400
    assert check(text, [(5000, 5004, "XYZ"), (12000, 12000, " new text"), (0, 1, "")]) < 40
    assert check(text, [(100, 100, "many more words " * 500)]) < 1700
    assert check(text, [(0, len(text), "")]) == 0
    tree, new = T.build(text, COUNTER), text
    for i in range(200):
        edits = T.sound_edits([(i * 90, i * 90 + 3, "ab c"), (i * 7, i * 7, "'s")], len(new))
        new, tree, _ = T.edit(new, tree, edits, COUNTER)
    assert tree.tokens[1] == len(COUNTER.encode(new))


def test_whole_table(spark, documents):
    rows = {r.doc_id: r for r in T.edited_counts(documents, RANKS, PATTERN, T.clean_up_edits).collect()}
    for r in documents.collect():
        got, edits = rows[r.doc_id], T.clean_up_edits(r.text)
        assert (got.n_tokens, got.n_edits, got.n_tokens_edited) == (
            len(COUNTER.encode(r.text)), len(edits), len(COUNTER.encode(plain(r.text, edits))))
        assert got.n_encoded <= 6 * len(edits) + 2


@pytest.mark.parametrize("text", [None, "", "a b"])
def test_kept_trees(spark, text):
    df = spark.createDataFrame([(1, text, 5, [(0, 0, "new "), (9, 9, None), None])] * 2,
                               f"doc_id bigint, text string, n_tokens int, edits {T.EDITS}")
    trees = T.build_trees(df, RANKS, PATTERN).withColumn("edits", T.F.lit(None).cast(T.EDITS))
    trees = trees.join(df.select("doc_id", T.F.col("edits").alias("e")).limit(1), "doc_id").withColumn("edits", T.F.col("e"))
    got = T.edit_trees(trees, RANKS, PATTERN).collect()
    assert len(got) == 2 and got[0] == got[1]
    assert got[0].text == "new " + (text or "") and got[0].n_tokens == len(COUNTER.encode(got[0].text))
    assert T.edited_counts(df.limit(0), RANKS, PATTERN, T.clean_up_edits).count() == 0
