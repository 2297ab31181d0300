import pytest

from newsloom.llm import source_mixing
from tests.conftest import SF
from tests.llm.oracle import assert_same

SCHEMA = "doc_id long, text string, source string, size string, target int, v double"


def water_fill(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            break
        level = (budget - sum(2 * sizes[s] for s in full)) / sum(w[s] for s in rest)
        over = {s for s in rest if w[s] * level > 2 * sizes[s]}
        if not over:
            break
        full |= over
    return {s: 2.0 * sizes[s] if s in full else w[s] * level for s in names}


def rows():
    out = [(i, "w " * (i % 37 + 1), f"s{'abcde'[min(i % 9, 4)]}") for i in range(900)]
    out += [(2000, None, "sa"), (2001, "", None), (2002, "one two", None), (None, "x y z", None), (5, "w " * 6, "sa"), (5, "w " * 6, "sa")]
    return [(*r, "", 0, 0.0) for r in out]


def test_targets_and_words_taken(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = source_mixing.mix(df).collect()
    assert len(got) == len(rows())
    sizes, taken, goal = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        goal[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    want = water_fill(sizes)
    assert goal == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) <= 20 for s in want), (taken, want)
    again = source_mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_inclusion_follows_unequal_weights(spark):
    df = spark.range(4000).selectExpr("id doc_id", "'a b c d' text", "'s' source", "if(id % 2 = 0, 3.0, 1.0) weight")
    got = source_mixing.mix(df, share=0.5, weight_col="weight").collect()
    heavy = sum(r.copies for r in got if r.doc_id % 2 == 0) / 2000
    light = sum(r.copies for r in got if r.doc_id % 2) / 2000
    assert abs(sum(r.taken for r in got) - 8000) <= 4
    assert abs(heavy - 0.75) < 0.03 and abs(light - 0.25) < 0.03


def test_against_sql(spark):
    assert_same(spark, source_mixing.op6_source_mixing(spark, SF), source_mixing.OP6_SQL, SF)


def test_empty(spark):
    assert source_mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
