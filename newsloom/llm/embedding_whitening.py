"""Whitening of embeddings by upper-triangle column aggregates (operator 12).

Entries become whole numbers x = floor(scale * c) + offset. The covariance V of x is
gathered by Spark SQL expressions that are generated for every pair of dimensions
i <= j: each sums the product of the two columns, centred before multiplying, and all
of them are read off one aggregation. The driver gets a row of sums, assembles the
symmetric matrix and decomposes it with LAPACK (``numpy.linalg.eigh``). Its eigenvectors,
by falling eigenvalue, and the roots of their eigenvalues whiten the rows.

*Exact sums.* Columns are centred by the whole number next to their mean, so that the products are
whole numbers too, and their sums are exact in double precision below 2**53, in any order: reruns agree, whatever
the partitions. What the rounded mean leaves is taken off by exact integer arithmetic on the driver.
``identity_error`` comes from the same aggregation over the whitened columns.

*Size.* One row of D * (D + 1) / 2 sums leaves each task; nothing else is shuffled, and no
key can be hot. More than ``PAIRS`` pairs (D above 115) are summed in several aggregations, so
the generated plan keeps its size; the matrix on the driver grows with D only, never with rows.

Edges: a vector that is null, or has a null, NaN or infinite entry, is dropped. Vectors of the length that most
of the others have (the longer one of a tie) are fitted and returned, the rest are dropped; empty ones always. Directions in
which the fit list does not vary beyond rounding (an eigenvalue of at most
``LEAST`` of the largest) have no whitened value and are left out, so a single row, or equal rows only, give none.
Repeated rows and null ids are rows like others. ``deviation`` is null where it needs more than 64 bits. Entries
are below 2**40 in size, beyond which they have no exact double in units of 1 / scale. An empty table gives an empty result.
Columns besides id and vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import common

SCALE, OFFSET = 64, 1_000_000
#: Pairs of dimensions of one aggregation.
PAIRS = 6_720
#: Eigenvalues at or below this share of the largest are rounding.
LEAST = 1e-12
COMPONENTS = 32


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x of the rows that remain."""
    whole = F.transform("v", lambda c: F.floor(c * SCALE) + OFFSET)
    sound = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(F.col("v").isNotNull() & sound).select("vec_id", whole.cast("array<long>").alias("x"))


def commonest_length(rows: DataFrame) -> int:
    """The length of most vectors; of a tie the longer. Zero if there is none."""
    top = rows.where("size(x) > 0").groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return top["d"] if top else 0


def column_sums(rows: DataFrame, vector: str, size: int) -> tuple[int, list]:
    """Number of rows and the sum of each dimension, in one aggregation."""
    made = [F.count("*"), *(F.sum(F.get(vector, F.lit(i))) for i in range(size))]
    n, *sums = rows.agg(*(c.alias(f"c{k}") for k, c in enumerate(made))).first()
    return n, sums


def pair_sums(rows: DataFrame, vector: str, centres: list, pairs_at_once: int = PAIRS) -> np.ndarray:
    """Upper triangle of the sums of centred products; ``centres`` is subtracted before multiplying."""
    size = len(centres)
    centred = rows.select(*((F.get(vector, F.lit(i)) - F.lit(c)).cast("double").alias(f"d{i}") for i, c in enumerate(centres)))
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    out = np.zeros((size, size))
    for at in range(0, len(pairs), pairs_at_once):
        part = pairs[at : at + pairs_at_once]
        sums = centred.selectExpr(*(f"sum(d{i} * d{j}) as s{k}" for k, (i, j) in enumerate(part))).first()
        for (i, j), s in zip(part, sums, strict=True):
            out[i, j] = s
    return out


def covariance(products: np.ndarray, rest: list, n: int) -> np.ndarray:
    """From sums of products around whole centres and what the centres leave of the sums; exact but for the last rounding."""
    size = len(rest)
    out = np.empty((size, size))
    for i in range(size):
        for j in range(i, size):
            out[i, j] = out[j, i] = float(Fraction(int(products[i, j]) * n - rest[i] * rest[j], n * n))
    return out


@dataclass
class Whitening:
    """What whitens a row: its fit list's size and sums, and the components by falling eigenvalue."""

    n: int
    sums: list[int]
    centres: list[int]
    rest: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def fit(rows: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """Components of the rows' covariance; none for an empty table."""
    n, sums = column_sums(rows, "x", size) if size else (0, [])
    if not n:
        return None
    centres = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centres, strict=True)]
    v = covariance(pair_sums(rows, "x", centres), rest, n)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    keep = [k for k in order[:components] if values[k] > LEAST * values[order[0]] and values[k] > 0]
    return Whitening(n, sums, centres, rest, vectors[:, keep].T.copy(), values[keep], values[keep] / np.trace(v))


def _deviations(moved: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """Sum over dimensions of (n * x - S)**2, exact; null beyond 64 bits."""
    if float(np.abs(moved).max(initial=0)) * n < 2**62:
        around = n * moved - rest
        if float(np.abs(around).max(initial=0)) ** 2 * around.shape[1] < 2**62:
            return (around * around).sum(1).tolist()
    exact = (sum((n * a - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in moved.tolist())
    return [x if x < 2**63 else None for x in exact]


WHITENED = "vec_id long, deviation long, w array<double>"


def whiten(rows: DataFrame, fitted: Whitening) -> DataFrame:
    """vec_id, deviation and the whitened components of each row."""
    size = len(fitted.centres)
    centres, rest = np.array(fitted.centres, np.int64), np.array(fitted.rest, np.int64)
    left, matrix = rest / fitted.n, fitted.vectors.T / np.sqrt(fitted.values)
    n, kept = fitted.n, len(fitted.values)
    names = ["vec_id", "deviation", "w"]

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            moved = batch.column("x").flatten().to_numpy().reshape(-1, size) - centres
            w = (moved - left) @ matrix
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * kept)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(_deviations(moved, rest, n), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], names)

    return rows.select(F.col("vec_id").cast("long"), "x").mapInArrow(values, WHITENED)


def identity_error(whitened: DataFrame, size: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    n, sums = column_sums(whitened, "w", size)
    products = pair_sums(whitened, "w", [s / n for s in sums])
    return float(np.abs(np.triu(products / n - np.eye(size))).max())


def whiten_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per remaining vector and component; see the module and the contract in the README."""
    spark = vectors.sparkSession
    rows = integers(vectors, id_col, vector_col)
    size = commonest_length(rows)
    rows = common.stored(rows.where(F.size("x") == size), "integers")
    fitted = fit(rows, size, components)
    if fitted is None or not len(fitted.values):
        return spark.createDataFrame([], OUT)
    kept = len(fitted.values)
    whitened = common.stored(whiten(rows, fitted), "whitened")
    error = identity_error(whitened, kept)
    share = F.array(*(F.lit(float(e)) for e in fitted.explained))
    each = whitened.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return each.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, "k").alias("explained"), F.lit(error).alias("identity_error")
    )


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened by their own covariance."""
    return whiten_embeddings(common.table(spark, sf_dir, "embeddings"))
