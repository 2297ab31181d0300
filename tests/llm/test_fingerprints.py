import hashlib
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from newsloom.llm import common
from newsloom.llm import fingerprints as fp
from tests.conftest import SF
from tests.llm.oracle import assert_same

SCHEMA = "doc_id long, text string, stretch int, guest string, n_chars string"


def spans(t, size=24):
    return {t[i : i + size] for i in range(max(1, len(t) - size + 1))} if t else set()


def brute_likeness(a, b):
    """Dice of the sets of spans, of the length that the shorter text has room for twice."""
    size = next((s for s in fp.SPANS if min(len(a), len(b)) >= 2 * s), 1)
    sa, sb = spans(a, size), spans(b, size)
    return 2 * len(sa & sb) / (len(sa) + len(sb)) if sa and sb else float(sa == sb)


def test_spans_and_extensions_match_plain_strings():
    rng = random.Random(1)
    for _ in range(60):
        a = "".join(rng.choices("ab🏎é", k=rng.randrange(1, 90)))
        b = a[: rng.randrange(len(a) + 1)] + "".join(rng.choices("ab", k=rng.randrange(30)))
        x, y = fp.Prefix(fp.codes_of(a)), fp.Prefix(fp.codes_of(b))
        for n in (1, 2, 7):
            if len(a) >= n:
                got = x.spans(n)
                words = [a[i : i + n] for i in range(len(a) - n + 1)]
                assert len(set(got.tolist())) == len(set(words))
                assert all((got[i] == got[0]) == (w == words[0]) for i, w in enumerate(words))
        for _ in range(20):
            i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
            want = 0
            while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
                want += 1
            assert x.extension(i, y, j) == want


def test_likeness_is_exact_for_short_texts_and_near_for_long():
    rng = random.Random(2)
    for size in (5, 30, 60, 4000):
        a = "".join(rng.choices("abcdefgh ", k=size))
        b = a[: size * 2 // 3] + "".join(rng.choices("abcdefgh ", k=size // 3))
        want = brute_likeness(a, b)
        got = fp.likeness(fp.sketch(fp.Prefix(fp.codes_of(a))), fp.sketch(fp.Prefix(fp.codes_of(b))))
        assert abs(got - want) < (1e-12 if size <= 60 else 0.2)
    assert fp.likeness(*[fp.sketch(fp.Prefix(fp.codes_of("x" * n))) for n in (500, 800)]) == 1


def test_short_texts_with_half_kept_are_alike():
    rng = random.Random(12)
    sk = lambda t: fp.sketch(fp.Prefix(fp.codes_of(t)))
    for n in range(2, 47):
        for _ in range(5):
            a = "".join(rng.choices("abcdefghijklmnop é", k=n))
            b = fp.edit(a, "".join(rng.choices("qrstuvwxyz", k=n)))
            got = fp.likeness(sk(a), sk(b))
            assert got > 0 and abs(got - brute_likeness(a, b)) < 1e-12, (a, b)
    for a, b in (("the quick brown fox", "the quick brjumps over"), ("ab", "ac"), ("x" * 46, "x" * 500), ("abcd", "efgh")):
        assert abs(fp.likeness(sk(a), sk(b)) - brute_likeness(a, b)) < 1e-12


def hashed(text):
    """What orders the texts of one id."""
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >= 1 << 63 else h


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -hashed(r[1] or "")))
    out = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        changed = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), nxt, changed, t))
    return out


def test_rows_in_any_partitioning(spark):
    rng = random.Random(3)
    rows = [(i * 7 % 1009, "".join(rng.choices("abcde \u00e9", k=rng.randrange(80)))) for i in range(300)]
    rows += [(None, "null id"), (None, None), (5, "tie a"), (5, "tie b"), (5, "tie b"), (-3, "y" * 30_000), (2**62, None), (8, "")]
    df = spark.createDataFrame([(i, t, 1, "g", "n") for i, t in rows], SCHEMA)
    want = brute(rows)
    sk = lambda t: fp.sketch(fp.Prefix(fp.codes_of(t)))
    exp = sorted(
        ((i, n, sha, fp.written(sk(t)), fp.written(sk(c)), fp.likeness(sk(t), sk(c)), fp.likeness(sk(t), sk(nxt))) for i, n, sha, nxt, c, t in want),
        key=repr,
    )
    for n in (1, 2, 17, 400):
        got = fp.fingerprint_documents(df, ranges=n).drop("common_prefix").collect()
        assert sorted(map(tuple, got), key=repr) == exp, n
    assert len({r.fingerprint for r in got if r.n_chars == 0}) == 1


def test_one_row_and_none(spark):
    one = fp.fingerprint_documents(spark.createDataFrame([(1, "abcd", 0, "", "")], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1 and one[0].common_prefix == 2
    assert fp.fingerprint_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    back, made = fp.read(one[0].fingerprint), fp.sketch(fp.Prefix(fp.codes_of("abcd")))
    assert back.n == 4 and all(np.array_equal(x, y) for x, y in zip(back.levels, made.levels, strict=True))


def test_repeated_ids_spread_over_tasks(spark):
    rng = random.Random(9)
    rows = [(None, f"text {i} " + rng.choice("abc") * (i % 40)) for i in range(700)] + [(7, f"seven {i}") for i in range(400)] + [(i, f"t{i}") for i in range(100)] + [(9, "same")] * 50
    df = spark.createDataFrame([(i, t, 1, "g", "n") for i, t in rows], SCHEMA)
    want = sorted(((i, n, sha) for i, n, sha, *_ in brute(rows)), key=repr)
    with common.settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        made = fp.fingerprint_documents(df, ranges=12)
        got = made.select("doc_id", "n_chars", "edited_sha256", F.spark_partition_id().alias("task")).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == want
    for i, most in ((None, 200), (7, 200)):
        tasks = Counter(r.task for r in got if r.doc_id == i)
        assert len(tasks) >= 3 and max(tasks.values()) <= most


def test_against_sql(spark):
    """The columns that SQL can express; ids of the table do not repeat."""
    sql = """with d as (select doc_id, coalesce(text, '') text, coalesce(lead(text) over w, first_value(text) over w, '') following from documents window w as (order by doc_id desc))
      select doc_id, length(text) n_chars, sha256(left(text, length(text) - length(text) // 2) || left(following, length(text) // 2)) edited_sha256 from d"""
    assert_same(spark, fp.op8_fingerprints(spark, SF).select("doc_id", "n_chars", "edited_sha256"), sql, SF)
