import random
from itertools import combinations

import numpy as np

from newsloom.llm import jaccard_join as jj
from tests.llm.oracle import assert_same
from tests.llm.test_url_filter import union_find

SCHEMA = "doc_id long, text string, node long, size string, component_id int"


def shingles(t, n=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows):
    sets = [(k, shingles(t)) for k, (_, t) in enumerate(rows)]
    links = [(a, b) for (a, x), (b, y) in combinations(sets, 2) if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    roots = union_find(links)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = roots.get(k, k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(sets[k][1]), least.get(roots.get(k, k))) for k, (i, _) in enumerate(rows)), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 0, "s", 1) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in jj.jaccard_components(df).collect()), key=repr)


def family(rng, words, size, rate, vocabulary):
    base = [rng.choice(vocabulary) for _ in range(words)]
    return [" ".join(rng.choice(vocabulary) if rng.random() < rate else w for w in base) for _ in range(size)]


def test_families_passages_and_edges(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 16)
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(3000)]
    texts = []
    for words, size, rate in ((40, 60, 0.01), (100, 40, 0.012), (300, 25, 0.02), (60, 30, 0.004), (12, 12, 0.02), (900, 8, 0.02)):
        texts += family(rng, words, size, rate, vocabulary)
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(k)) for k in range(0, 40)]  # one passage in all
    texts += [passage] * 30 + [t.upper() for t in texts[:10]] + [None, "", " \n", "one", "ONE", "one two three four", "one two three four five", "é è", "É è", "a\u00a0b c"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, passage), (None, "lonely words of no one else at all"), (5, "tie " * 9), (5, "tie " * 9), (-9, texts[0])]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


def test_bounds_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 700))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, max(1, n // 12)).astype(np.uint64)]))
        pa_, pb = (np.frombuffer(jj.parity(s), np.uint8)[None, :] for s in (a, b))
        size = min(pa_.shape[1], pb.shape[1])
        apart = int(np.bitwise_count(jj.folded(pa_, size) ^ jj.folded(pb, size)).sum())
        assert apart <= len(np.setxor1d(a, b))
        o = len(np.intersect1d(a, b))
        assert (o >= jj.allowed(np.array(len(a) + len(b)), 80)) == (100 * o >= 80 * (len(a) + len(b) - o))


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert_same(spark, jj.op3_jaccard_join(spark, sf), jj.OP3_SQL, sf)


def brute_link_counts(rows):
    sets = [shingles(t) for _, t in rows]
    linked = [sum(1 for k, y in enumerate(sets) if k != j and x and y and 100 * len(x & y) >= 80 * len(x | y)) for j, x in enumerate(sets)]
    return sorted(((i, len(x), m) for (i, _), x, m in zip(rows, sets, linked)), key=repr)


def test_link_counts_inside_components(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(jj, "BLOCK", 16)
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(2000)]
    texts = []
    for words, size, rate in ((60, 40, 0.008), (120, 40, 0.012), (300, 20, 0.015), (12, 10, 0.02)):
        texts += family(rng, words, size, rate, vocabulary)
    texts += [texts[0]] * 7 + [texts[45].upper()] * 3 + [None, "", "one", "ONE", "one two three four five"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (5, texts[5])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_link_counts(rows)
    got = sorted((tuple(r) for r in jj.op3_link_counts(spark, str(tmp_path)).collect()), key=repr)
    assert got == want
    assert len({m for _, _, m in want}) > 5
    assert jj.jaccard_link_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_blocks_are_skipped_and_no_possible_pair_is(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 8)
    rng = random.Random(13)
    rows = []
    for node in range(700):
        size = int(10 * 1.01 ** rng.randrange(400))
        rows.append((1, node, node // 3 if node < 300 else 1000, size, rng.randrange(jj.prefix_size(size, 80))))
    entries = spark.createDataFrame(rows, "element long, node long, component long, size long, position long").cache()

    def block_pairs(skip):
        dealt = jj.long_list_rows(entries, 80, skip).collect()
        blocks = {r.node: r.block for r in dealt}
        return {(r.a, r.b) for r in dealt}, blocks

    kept, _ = block_pairs(True)
    every, block = block_pairs(False)
    assert len(block) == len(rows) and kept < every
    possible = 0
    for (_, x, cx, nx, px), (_, y, cy, ny, py) in combinations(rows, 2):
        need = jj.allowed(np.array(nx + ny), 80)
        if cx != cy and min(nx, ny) >= need and min(nx - px, ny - py) >= need:
            possible += 1
            assert tuple(sorted((block[x], block[y]))) in kept
    skipped = 1 - len(kept) / len(every)
    assert possible > 1000 and skipped > 0.5, skipped


def test_keep_one_each_tells_rows_apart_by_id_and_text(spark):
    a = " ".join(f"w{i}" for i in range(60))
    unlike = " ".join(f"v{i}" for i in range(30))
    rows = [(3, a), (5, a + " tail"), (5, unlike), (7, unlike), (7, unlike), (None, a + " end"), (None, "quite alone in here"), (9, None), (9, None), (9, "")]
    rows += [(11, "twice the very same row here"), (11, "twice the very same row here")]
    df = spark.createDataFrame([(i, t, 0, "s", 1) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in jj.keep_one_each(df).collect()), key=repr)
    want = [(3, a), (5, unlike), (None, "quite alone in here"), (9, None), (9, None), (9, ""), (11, "twice the very same row here")]
    assert got == sorted(want, key=repr)
    assert jj.keep_one_each(df).columns == df.columns


def test_long_lists_of_unlike_sets(spark, monkeypatch):
    """One shingle in the prefix of most sets, families of close sets among them."""
    monkeypatch.setattr(jj, "BLOCK", 8)
    rng = random.Random(14)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = ["one two three four five " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 14))) for _ in range(200)]
    for k in range(30):
        base = texts[k].split()
        texts += [" ".join([*base, f"x{k}"]), " ".join([*base, f"x{k}", f"y{k}"])]
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jj.jaccard_link_counts(df).collect()), key=repr) == brute_link_counts(rows)
