import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from newsloom.llm import common
from newsloom.llm import merkle_manifest as m
from tests.conftest import SF
from tests.llm.oracle import assert_same

#: Small shuffle partitions stay apart.
APART = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
#: With columns whose names clash with those that the operator makes.
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, level string, idx int, grp string, digest string, path int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """(root, siblings and sides of each leaf) of a list of digests."""
    paths, now = [[] for _ in leaves], list(leaves)
    level = 0
    while len(now) > 1:
        for i, p in enumerate(paths):
            there = (i >> level) ^ 1
            p.append(("-", "") if there >= len(now) else ("L" if there < i >> level else "R", now[there]))
        now = [h(*now[i : i + 2]) for i in range(0, len(now), 2)]
        level += 1
    return now[0], paths


def fold(digest, path):
    for side, s in path:
        digest = h(digest) if side == "-" else h(s, digest) if side == "L" else h(digest, s)
    return digest


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in langs}
    root, tops = tree([trees[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops):
        for (_, _, d, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            path = path + top
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            end = fold(leaf((*r[:3], r[3] + 1, r[4])) if hit else d, path)
            out.append((r[0], d, trees[g][0], root, h(*(s for _, s in path)), end, end == root))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z", 2) for r in rows], SCHEMA)


def found(df, stride=m.STRIDE):
    return m.build_manifest(df, altered=m.tampered(df), stride=stride)


def checked(manifest):
    return sorted((tuple(r) for r in manifest.merged().mapInArrow(m._checked, m.CHECKED).collect()), key=repr)


ROWS = [(i * 37 % 211, f"s{i % 5}", ["en", "fr", None, "él", "z"][min(i % 9, 4)], i if i % 6 else None, f"text {i} é\U0001f3ce") for i in range(150)]
ROWS += [(7, "s", "en", 1, "tie a"), (7, "s", "en", 1, "tie b"), (7, "s", "en", 1, "tie b"), (None, None, None, None, None), (None, "s", "en", 0, ""), (-4, "", "alone", -9, "y" * 200_000)]


@pytest.mark.parametrize("stride", [1, 3, 12])
def test_matches_brute_force(spark, stride):
    got = checked(found(table(spark, ROWS).repartition(5), stride))
    assert got == brute(ROWS)
    assert 0 < sum(not r[6] for r in got) < len(got) // 3


def test_hot_group_spreads_over_runs_and_blocks(spark):
    rows = [(i, "s", "hot" if i % 20 else f"g{i}", 1, "same") for i in range(1000)]
    with common.settings(spark, APART):
        manifest = found(table(spark, rows).repartition(8), stride=4)
    assert manifest.groups.runs.select("part").distinct().count() > 1
    assert checked(manifest) == brute(rows)


def test_store_holds_every_level_in_full(spark):
    manifest = found(table(spark, ROWS), stride=2)
    n = {r["grp"]: r["n"] for r in manifest.groups.runs.collect()}
    sizes = {(r["grp"], r["level"]): r["count"] for r in manifest.groups.nodes(1, 99).groupBy("grp", "level").count().collect()}
    want = {(g, k): -(-c // 2**k) for g, c in n.items() for k in range(1, m.height(c) + 1)}
    assert sizes == want
    proofs = manifest.proofs().collect()
    assert all(m.folded(bytes.fromhex(r["leaf"]), bytes(r["path"])).hex() == r["root"] for r in proofs) and len(proofs) == len(ROWS)


def test_one_row_one_group_and_none(spark):
    one = [(14, "s", "en", 3, "abc")]
    assert checked(found(table(spark, one))) == brute(one)
    assert brute(one)[0][4] == sha256(b"").hexdigest()
    three = [(i, "s", None, None, None) for i in range(3)]
    assert checked(found(table(spark, three))) == brute(three)
    assert checked(found(table(spark, []))) == []


def test_identical_rows_split_over_tasks(spark):
    df = table(spark, [(None, "s", None, 1, "t")]).crossJoin(spark.range(2000)).drop("id")
    with common.settings(spark, APART):
        tree = m.build(df.select(F.lit("g").alias("grp"), F.unhex(F.sha2("text", 256)).alias("digest")).repartition(4), [], [], 12)
    assert tree.runs.count() > 1 and tree.roots().count() == 1


def test_against_sql(spark):
    assert_same(spark, m.op11_merkle_manifest(spark, SF), m.OP11_SQL, SF)
