import math
from fractions import Fraction

import numpy as np
import pytest

from newsloom.llm import embedding_whitening as w
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, x array<int>, w string, n long, d0 double, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, [1], "w", 1, 0.5, 9) for i, v in rows], SCHEMA)


def brute(rows, components=32):
    """(n, deviations, covariance) by exact fractions, over the rows that remain."""
    rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in rows]
    size = max(set(sizes), key=lambda d: (sizes.count(d), d))
    rows = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if len(v) == size]
    n = len(rows)
    sums = [sum(x[k] for _, x in rows) for k in range(size)]
    centred = [[x[k] - Fraction(sums[k], n) for k in range(size)] for _, x in rows]
    cov = [[float(sum(c[i] * c[j] for c in centred) / n) for j in range(size)] for i in range(size)]
    return rows, sums, np.array(cov), np.array([[float(c) for c in row] for row in centred])


def some_rows(n=180, size=6, seed=4):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(0, 1, (n, size)) @ rng.normal(0, 1, (size, size)) + 5
    return [(i, [float(c) for c in row]) for i, row in enumerate(mixed)]


ODD = [
    (900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [1.0, 2.0, float("inf"), 0.0, 0.0, 0.0]), (904, [1.0, 2.0]), (905, []),
    (3, [0.5] * 6), (3, [0.5] * 6), (None, [0.25] * 6), (906, [-1.0] * 6),
]


def test_matches_exact_fractions(spark):
    rows = some_rows() + ODD
    got = w.whiten_embeddings(table(spark, rows).repartition(5)).collect()
    kept, sums, cov, centred = brute(rows)
    n, size = len(kept), 6
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    assert len(got) == n * size
    dev = {}
    for i, x in kept:
        dev.setdefault(i, []).append(sum((n * a - b) ** 2 for a, b in zip(x, sums)))
    found = {}
    for r in got:
        found.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert r.n == n and r.deviation in dev[r.vec_id] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[order[r.component - 1]] / np.trace(cov), rel=1e-9)
    want = centred @ vectors[:, order] / np.sqrt(values[order])
    for (i, _), row in zip(kept, want):
        parts = next(v for k, v in found.items() if k[0] == i and any(abs(abs(v[1][0]) - abs(row[0])) < 1e-8 for _ in "x"))
        assert [abs(parts[c + 1][0]) for c in range(size)] == pytest.approx(np.abs(row), abs=1e-8)
    # one sign for all rows
    for c in range(size):
        signs = {np.sign(r[c]) * np.sign(found[(i, d)][c + 1][0]) for (i, x), r in zip(kept, want) for d in dev[i] if (i, d) in found and abs(r[c]) > 1e-3 and len(dev[i]) == 1}
        assert len(signs) == 1


def test_covariance_is_exact_far_from_zero(spark):
    rows = [(i, [20_000.0 + (i % 3) / 64, -20_000.0 + (i % 5) / 64]) for i in range(300)]
    x = w.integers(table(spark, rows), "vec_id", "embedding")
    fitted = w.fit(x, 2)
    _, _, cov, _ = brute(rows)
    assert fitted.vectors.T @ np.diag(fitted.values) @ fitted.vectors == pytest.approx(cov)
    n, sums = w.column_sums(x, "x", 2)
    centres = [(2 * s + n) // (2 * n) for s in sums]
    assert np.array_equal(w.covariance(w.pair_sums(x, "x", centres), [s - n * c for s, c in zip(sums, centres)], n), cov)


def test_pairs_in_several_aggregations_agree(spark):
    x = w.integers(table(spark, some_rows()), "vec_id", "embedding")
    centres = [1_000_300] * 6
    assert np.array_equal(w.pair_sums(x, "x", centres), w.pair_sums(x, "x", centres, pairs_at_once=4))


def test_flat_directions_single_rows_and_none(spark):
    flat = [(i, [float(i), 1.0, 2.0 * i]) for i in range(20)]
    got = w.whiten_embeddings(table(spark, flat)).collect()
    assert {r.component for r in got} == {1} and len(got) == 20
    assert w.whiten_embeddings(table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert w.whiten_embeddings(table(spark, [(1, None), (2, [])])).count() == 0
    assert w.whiten_embeddings(table(spark, [])).count() == 0
    assert w.whiten_embeddings(table(spark, [])).columns == w.whiten_embeddings(table(spark, flat)).columns


def test_deviation_beyond_64_bits_is_null():
    assert w._deviations(np.array([[2**40, 1]]), np.array([0, 0]), 10) == [None]
    assert w._deviations(np.array([[3, 1]]), np.array([5, -5]), 10) == [25**2 + 15**2]
    assert w._deviations(np.array([[3 << 27, 1]]), np.array([5, -5]), 2) == [((6 << 27) - 5) ** 2 + 49]


def test_query_agrees_with_the_whole_table(spark):
    got = w.op12_embedding_whitening(spark, SF).toPandas()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    kept, sums, cov, centred = brute(rows)
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    assert len(got) == 32 * len(kept) and got.identity_error.max() < 1e-9
    for c in (1, 7, 32):
        part = got[got.component == c]
        assert part.explained.iloc[0] == pytest.approx(values[c - 1] / np.trace(cov), rel=1e-9)
        assert (part.whitened**2).mean() == pytest.approx(1, abs=1e-9) and part.whitened.mean() == pytest.approx(0, abs=1e-9)
    n = len(kept)
    dev = {i: sum((n * a - b) ** 2 for a, b in zip(x, sums)) for i, x in kept}
    assert dict(zip(got.vec_id, got.deviation)) == dev
