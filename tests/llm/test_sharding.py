import zlib
from collections import Counter, defaultdict

import numpy as np

from newsloom.llm.sharding import op4_sharding, pack, shard_documents

SCHEMA = "doc_id long, text string, unit string, h int, size string, shard string"


def check(rows, got, shards=8):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr
    )
    slots = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return Counter({s: sum(r.size for r in got if r.shard == s) for s in range(shards)})


def test_hot_group_nulls_and_balance(spark):
    rows = [(i, "copied text of a third of all rows" if i % 3 == 0 else f"row {i} " + "x" * (i * 37 % 400)) for i in range(6000)]
    rows += [(None, None), (None, ""), (7, "same"), (7, "same"), (-1, "long " * 200)]
    df = spark.createDataFrame([(*r, "u", 0, "s", "t") for r in rows], SCHEMA)
    got = shard_documents(df).collect()
    size = check(rows, got)
    assert max(size.values()) - min(size.values()) < 0.01 * sum(size.values()) / 8 + 1000
    by_rows = Counter(r.shard for r in got)
    assert max(by_rows.values()) < 1.1 * min(by_rows.values())
    again = shard_documents(df.repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_small_groups_stay_together(spark):
    rows = [(i, f"group {i // 3}" + "y" * (i // 3 % 50)) for i in range(3000)]
    got = shard_documents(spark.createDataFrame([(*r, "u", 0, "s", "t") for r in rows], SCHEMA)).collect()
    check(rows, got)
    where = defaultdict(set)
    for r in got:
        where[r.doc_id // 3].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_null_and_repeated_ids_of_a_hot_group_spread(spark):
    for hot in (None, 5):
        rows = [(hot, "copied text of half of all rows " * 3) for _ in range(4000)] + [(i, f"text {i} " + "z" * (i % 90)) for i in range(4000)]
        got = shard_documents(spark.createDataFrame([(*r, "u", 0, "s", "t") for r in rows], SCHEMA)).collect()
        size = check(rows, got)
        assert max(size.values()) < 1.01 * min(size.values()), size
        by_rows = Counter(r.shard for r in got)
        assert max(by_rows.values()) < 1.02 * min(by_rows.values())
        assert {r.split for r in got if r.doc_id == hot and r.size > 90} == {True}


def brute(rows, shards=8):
    """Every group by itself, the largest share first, to the highest dot product with what is left."""
    groups = defaultdict(lambda: np.zeros(3))
    for _, t in rows:
        groups[t] += [len(t.encode()) + 1, len(t.split()), 1]
    total = sum(groups.values())
    left = [np.full(3, 1 / shards) for _ in range(shards)]
    out = {}
    for t, v in sorted(groups.items(), key=lambda g: -max(g[1] / total)):
        share = v / total
        best = max(range(shards), key=lambda s: (float(np.dot(left[s], share)), -s))
        left[best] = left[best] - share
        out[t] = best
    return out


def test_groups_are_placed_as_by_brute_force(spark):
    # groups of 1, 2, ... rows: their shares differ, so that the order of placement is defined
    texts = [f"group {k} " + "word " * (k % 3) for k in range(1, 60) for _ in range(k)]
    rows = list(enumerate(texts))
    got = shard_documents(spark.createDataFrame([(*r, "u", 0, "s", "t") for r in rows], SCHEMA), split_from=1, units=100_000).collect()
    want = brute(rows)
    assert {r.doc_id: r.shard for r in got} == {i: want[t] for i, t in rows}


def test_pack_prefers_residual_in_the_vector_s_direction():
    got = pack(np.array([[9.0, 1.0], [1.0, 9.0], [5.0, 5.0], [5.0, 5.0]]), 2)
    assert got[0] != got[1] and got[2] != got[3]


def test_real_documents_and_empty(spark):
    got = op4_sharding(spark, "/root/testdata/sf0.01").collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    assert max(size.values()) < 1.02 * min(size.values())
    assert shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0
