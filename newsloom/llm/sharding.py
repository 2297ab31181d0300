"""Sharding by vector bin packing (operator 4), under the law ``bytes``.

Groups of equal texts are packed so that bytes, tokens and rows are balanced
together: the largest first, each into the shard where the dot product of its
size vector with the shard's residual capacity vector (both as shares of the
totals) is highest. What is packed on the driver is bounded whatever the input:

1. Groups are summed (pre-aggregated in each task). A group above ``1 / units`` of
   all bytes, tokens or rows is packed by itself; there are at most 3 * units.
2. A group above ``1 / (split_from * shards)`` of a total would unbalance the shards
   wherever it went. It is split into pieces of about 1 / units of the whole by a
   hash of the rows' ids; rows that share an id and are themselves above half
   a unit (null ids, repeats) are dealt out by their row number. ``split`` tells
   the rows of such groups.
3. The groups that are left, each below 1 / units, are bundled by the hash of their
   text, so that equal texts stay together, and bundles are packed like groups.

``units`` is 8192, and more for large tables, so that a unit has about a million
rows: a row's slot is its unit's offset in the shard plus its place in the unit, which
needs no sort of a whole shard.

Edges: a null text has no bytes, tokens or checksum of text (crc32 of the empty
text, 0) and forms a group with the empty text. Null ids and repeated rows are dealt
as above; rows that are alike take slots in any order among themselves. A text larger
than a shard's share is placed whole. An empty table gives an empty result.
Columns besides id and text are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm import common
from newsloom.llm.source_mixing import word_count

DIMENSIONS = ("size", "tokens", "n_rows")
#: Rows of a unit on large tables, and the bounds of the number of units.
UNIT_ROWS, LEAST_UNITS, MOST_UNITS = 1_000_000, 8192, 1 << 17


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector: largest first, to the highest dot product with residual capacity."""
    if not len(vectors):
        return np.empty(0, np.int64)
    share = vectors / np.maximum(vectors.sum(axis=0), 1)
    residual = np.full((shards, vectors.shape[1]), 1.0 / shards)
    out = np.empty(len(share), np.int64)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        out[i] = best = int(np.argmax(residual @ share[i]))
        residual[best] -= share[i]
    return out


def shard_documents(
    docs: DataFrame, shards: int = 8, units: int | None = None, split_from: int = 64, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens and split of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = common.stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            word_count(text_col).alias("tokens"),
            F.xxhash64(text).alias("h"),
            F.monotonically_increasing_id().alias("row"),  # kept with the stored table, so the same for every reader
        ),
        "sized",
    )
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_rows")]
    spark = docs.sparkSession
    totals = sized.agg(*sums).first()
    units = units or min(max(LEAST_UNITS, totals["n_rows"] // UNIT_ROWS), MOST_UNITS)
    if not totals["n_rows"]:
        totals = {d: 1 for d in DIMENSIONS}
    weight = F.greatest(*[F.col(d) / float(max(totals[d], 1)) for d in DIMENSIONS])
    # at most 3 * units: each has more than 1 / units of one of three totals
    groups = sized.groupBy("h").agg(*sums).withColumn("w", weight).where(F.col("w") * units > 1)
    pieces = F.when((F.col("w") * split_from * shards > 1) & (F.col("n_rows") > 1), F.greatest(F.lit(2), F.ceil(F.col("w") * units))).otherwise(1)
    own = common.stored(groups.select("h", pieces.cast("int").alias("pieces")), "own")
    named = sized.join(F.broadcast(own), "h", "left")
    same_id = F.xxhash64("h", "doc_id", F.col("doc_id").isNull())
    # at most 6 * units: rows of one text and id above half a unit
    crowds = named.where("pieces > 1").groupBy(same_id.alias("crowd")).agg(*sums).where((F.col("n_rows") > 1) & (weight * 2 * units > 1)).select("crowd", F.lit(True).alias("by_row"))
    crowds = common.stored(crowds, "crowds")
    piece = F.pmod(F.when(F.col("by_row"), F.xxhash64("row")).otherwise(F.xxhash64("doc_id")), F.col("pieces"))
    unit = F.when(F.col("pieces").isNotNull(), F.xxhash64("h", piece)).otherwise(F.pmod("h", F.lit(units)))
    placed = named.join(F.broadcast(crowds), same_id == F.col("crowd"), "left").select(
        "doc_id", "size", "text_crc32", "tokens", unit.alias("unit"), F.coalesce(F.col("pieces") > 1, F.lit(False)).alias("split")
    )
    found = sorted(placed.groupBy("unit").agg(*sums).collect(), key=lambda r: r["unit"])
    shard = pack(np.array([[r[d] for d in DIMENSIONS] for r in found], float), shards)
    begin, rows = [0] * shards, []
    for r, s in zip(found, shard.tolist(), strict=True):
        rows.append((r["unit"], s, begin[s]))
        begin[s] += r["n_rows"]
    plan = spark.createDataFrame(rows, "unit long, shard int, begin long")  # as many rows as units, groups and pieces
    place = F.row_number().over(Window.partitionBy("unit").orderBy("doc_id", "text_crc32", "size"))
    return placed.withColumn("place", place).join(F.broadcast(plan), "unit").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("begin") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
        "split",
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal size."""
    return shard_documents(common.table(spark, sf_dir, "documents"))
