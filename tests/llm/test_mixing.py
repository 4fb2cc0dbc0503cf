import math
import re

import numpy as np
import pytest

from codeloom.llm import mixing as M


def water_fill(sizes, weights, share=1.5, cap=2.0):
    """Targets by resharing the excess until nobody is above."""
    left, total, got = dict(sizes), share * sum(sizes.values()), dict.fromkeys(sizes, 0.0)
    open_ = [s for s in sizes if sizes[s] > 0]
    while open_ and total > 1e-9:
        w = sum(weights[s] for s in open_)
        add = {s: min(total * weights[s] / w, cap * left[s] - got[s]) for s in open_}
        for s, x in add.items():
            got[s] += x
        total -= sum(add.values())
        open_ = [s for s in open_ if got[s] < cap * left[s] - 1e-9]
    return got


def table_of(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    names = ["b", "a", "é", None, "c", "Z"]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 200))), names[int(rng.choice(6, p=[.4, .3, .1, .1, .06, .04]))], 1, 2, "x") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, copies int, _row string")


def test_targets_and_taken_words(spark):
    rows, df = table_of(spark)
    got = M.draw(df).selectExpr("_row.doc_id", "_row.source", "size", "source_size", "target", "copies").collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = water_fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert 0 <= r.copies <= 2 and r.size == len(rows[r.doc_id][1].split())
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - want[s]) <= 0.03 * want[s] + 300 for s in sizes)
    again = M.draw(df.repartition(7)).selectExpr("_row.doc_id", "copies").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.copies) for r in got)


def test_copies_are_boundaries_crossed(spark):
    _, df = table_of(spark, 500, 2)
    got = M.draw(df).selectExpr("_row.doc_id", "_row.source", "size", "source_size", "target", "copies").toPandas()
    for _, g in got.groupby("source", dropna=False):
        g = g.assign(cls=np.floor(np.sqrt(g["size"])), salt=g.doc_id % M.SALTS).sort_values(["cls", "salt", "size", "doc_id"])
        units = math.floor(g.target.iloc[0] / g.source_size.iloc[0] * M.UNIT) if g.source_size.iloc[0] else 0
        prefix = np.arange(len(g) + 1) * units
        offsets = [u for u in range(0, M.UNIT, M.UNIT // 64)]
        total = int(g.copies.sum())
        assert total in {int((prefix[-1] + u) // M.UNIT - u // M.UNIT) for u in [*offsets, M.UNIT - 1]}


def test_mix_keeps_columns_and_repeats_rows(spark):
    rows, df = table_of(spark, 400, 3)
    mixed = M.mix(df)
    assert mixed.columns == df.columns
    copies = {r.doc_id: r.copies for r in M.draw(df).selectExpr("_row.doc_id", "copies").collect()}
    out = [r.doc_id for r in mixed.collect()]
    assert all(out.count(d) == c for d, c in copies.items())


def test_odd_tables(spark):
    schema = "doc_id bigint, text string, source string"
    same = spark.createDataFrame([(1, "a b", "s")] * 9 + [(None, "c", None), (2, None, "t"), (3, "", "t")], schema)
    got = M.draw(same).selectExpr("_row.doc_id", "size", "target", "copies").collect()
    assert len(got) == 12 and all(r.copies == 0 or r.size for r in got if r.target == 0)
    assert sum(r.copies * r.size for r in got if r.doc_id == 1) in (26, 27, 28)
    assert M.draw(same.limit(0)).count() == 0 and M.mix(same.limit(0)).count() == 0
    assert M.draw(spark.createDataFrame([(1, None, None)], schema)).first().copies == 0
    for text in ("", "a", " a\tb c\x85d \n", "x\x0by"):
        assert spark.createDataFrame([(text,)], "t string").select(M.n_words(M.F.col("t"))).first()[0] == len(re.findall(r"[^\x20\x09-\x0D]+", text))


@pytest.mark.parametrize("sizes", [[100, 1, 1], [0, 5, 5, 5], [7], [1, 1, 1, 1000]])
def test_water_fill_cases(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", 0, x) for i, x in enumerate(sizes)], "_src string, _nosrc int, source_size bigint")
    got = {r._src: r.target for r in M.targets(df).collect()}
    want = water_fill({f"s{i}": x for i, x in enumerate(sizes)}, {f"s{i}": (3, 1, 2)[i % 3] for i in range(len(sizes))})
    assert got == pytest.approx(want)
