import hashlib
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import xxhash
from pyspark.sql import functions as F

from newsloom.llm import exact_dedup as exact_dedup_module
from newsloom.llm.exact_dedup import OP7_SQL, build_index, directory, exact_dedup, grow_directory, op7_exact_dedup
from tests.conftest import SF
from tests.llm.oracle import assert_same

SCHEMA = "doc_id long, text string, digest string, h long, bucket int"


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for body, g in groups.items():
        keep = min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        best = max(len(t) for _, t in g)
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(i, keep, len(g), i == keep and len(t) == best, sha) for i, t in g]
    return sorted(out, key=repr)


ROWS = [
    (1, "a b"), (2, "ab"), (3, "a  b"), (4, "a\t\nb"), (5, None), (6, ""), (7, " \x0b\x0c\r"), (8, "é\u00a0x"),
    (9, "éx"), (None, "a   b"), (None, "only null"), (-5, "a  b"), (10, "🏎️ x"), (10, "🏎️ x"), (11, "🏎️\u2003x"), (12, "z" * 200_000),
    (13, "z" * 200_000 + " "), (2**63 - 1, "edge"), (-(2**63), "edge"),
]


def test_matches_brute_force_with_clashing_columns(spark):
    df = spark.createDataFrame([(i, t, "x", 7, 3) for i, t in ROWS], SCHEMA)
    got = exact_dedup(df, capacity=2, driver_depth=4)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(ROWS)


def test_colliding_texts_are_chained_and_told_apart_by_bytes(spark):
    rows = [*ROWS, *((100 + i, f"text {i % 40}") for i in range(200))]
    df = spark.createDataFrame([(i, t, "x", 7, 3) for i, t in rows], SCHEMA)
    for bits in (1, 3):
        _, index, _ = build_index(df, key_bits=bits)
        chains = [r.chain for r in index.collect()]
        assert len(chains) <= 2**bits and max(map(len, chains)) > 4
        assert all(len({e.body for e in c}) == len(c) for c in chains if len(c) > 1)
        assert sorted((tuple(r) for r in exact_dedup(df, key_bits=bits).collect()), key=repr) == brute(rows)


def test_overfull_buckets_split_beyond_the_driver_s_depth(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) h").cache()
    depth = {r.prefix: r.depth for r in directory(keys, 10, 3).collect()}
    assert len(depth) == 8 and min(depth.values()) > 3
    sizes = Counter((depth[h >> 61], h >> (64 - depth[h >> 61])) for h in ((r.h % 2**64) for r in keys.collect()))
    assert max(sizes.values()) <= 10
    rows = [(i, f"text {i // 2}") for i in range(2000)]
    df = spark.createDataFrame([(i, t, "", 0, 0) for i, t in rows], SCHEMA)
    _, index, _ = build_index(df, capacity=3, driver_depth=2)
    assert max(r["count"] for r in index.groupBy("bucket").count().collect()) <= 3
    assert sorted((tuple(r) for r in exact_dedup(df, capacity=3, driver_depth=2).collect()), key=repr) == brute(rows)


def test_hot_group_and_empty_table(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(600)]
    got = exact_dedup(spark.createDataFrame([(i, t, "", 0, 0) for i, t in rows], SCHEMA), capacity=10)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_directory_partitions_the_key_space():
    counts = {0: 5, 1: 5, 2: 1, 15: 3}
    got = grow_directory(counts, 4, 4)
    assert sum(1 << (4 - d) for d, _, _ in got) == 16
    assert sum(n for _, _, n in got) == 14
    assert all(n <= 4 or d == 4 for d, _, n in got)


def test_against_sql(spark):
    assert_same(spark, op7_exact_dedup(spark, SF), OP7_SQL, SF)


def test_a_bucket_file_is_a_key_range_and_can_be_walked(spark):
    rows = [(i, f"text {i % 4000}") for i in range(5000)]
    df = spark.createDataFrame([(i, t, "", 0, 0) for i, t in rows], SCHEMA)
    _, index, table = build_index(df, capacity=40)
    unsigned = F.expr("h ^ shiftleft(1L, 63)")  # in the order of leading bits
    files = index.groupBy(F.input_file_name().alias("file")).agg(F.min(unsigned).alias("low"), F.max(unsigned).alias("high"), F.count("*").alias("keys")).orderBy("low").collect()
    assert len(files) > 1 and sum(f["keys"] for f in files) == 4000
    assert all(a["high"] < b["low"] for a, b in zip(files, files[1:]))
    depth = {r.prefix: r.depth for r in table.collect()}
    for text in ("text 7", "text 3999"):
        body = text.replace(" ", "")
        h = xxhash.xxh64_intdigest(body.encode(), seed=42)
        file = next(f["file"] for f in files if f["low"] <= (h ^ 1 << 63) - ((h ^ 1 << 63) >> 63 << 64) <= f["high"])
        kept = pq.read_table(file.removeprefix("file:")).to_pylist()
        assert [(r["bucket"], r["h"]) for r in kept] == sorted((r["bucket"], r["h"]) for r in kept)
        d = depth[h >> 52]
        chain = next(r["chain"] for r in kept if r["h"] % 2**64 == h and r["bucket"] == (1 << d) + (h >> 64 - d))
        ids = [i for i, t in rows if t == text]
        assert [(e["digest"], e["keep_id"], e["group_size"]) for e in chain] == [(hashlib.sha256(body.encode()).hexdigest(), ids[0], len(ids))]


def test_texts_are_exchanged_once(spark):
    df = spark.createDataFrame([(i, f"text {i}", "", 0, 0) for i in range(300)], SCHEMA)
    keyed = exact_dedup_module._keyed(df, "doc_id", "text", 64).withColumns({"owner": F.expr("cast(pmod(h, 4) as int)"), "bucket": F.expr("pmod(h, 40)"), "rank": F.lit(1).cast("decimal(38,0)")})
    plan = exact_dedup_module._chains(exact_dedup_module._folded(keyed.repartitionById(4, "owner")))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan") :]
    assert physical.count("Exchange ") == 1
