"""What several operators of this subpackage share: tables, shared storage, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts spell it: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: One word of the contracts: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none (tests, notebooks) a temporary folder of this
    machine is set, which only a local master can use.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = have.get() if have.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        found = tempfile.mkdtemp(prefix="newsloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts lineage with files that outlive any executor, compressed and columnar.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/newsloom/{uuid.uuid4().hex}/{name}"
    writer = df.write.option("compression", "zstd")
    with settings(spark, WRITING):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: While a step is written: files by size rather than one per core, and Arrow batches of a few MB.
WRITING = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block and are put back after it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose values in a column have ``limit`` bytes together, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, end - at)
        at, before = end, int(ends[end - 1])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star.

    ``edges`` has columns src and dst of one orderable type; null ends and loops
    are ignored, repeats are harmless. Returns (node, component): every node
    that has an edge, with the smallest node reachable from it. An empty input
    gives an empty result. The number of rounds is logarithmic in the longest
    path; more than ``max_rounds`` raises rather than return half a result.

    A hub's edges never meet in one task: minima are pre-aggregated before the
    shuffle, and each join reads two stored tables by fresh exchanges, which
    adaptive execution can split.
    """

    def kept(df: DataFrame, name: str) -> DataFrame:
        return stored(df, name)

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    now = kept(
        edges.select("src", "dst")
        .where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct(),
        "edges",
    )
    before = state(now)
    if before[0]:
        for _ in range(max_rounds):
            both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            least = kept(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low")), "large_low")
            # every larger neighbour of a node hangs on the node's minimum
            large = kept(
                both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct(), "large"
            )
            low = kept(large.groupBy("src").agg(F.min("dst").alias("low")), "small_low")
            # every smaller neighbour, and the node itself, hangs on the smallest
            small = large.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst")
            now = kept(small.unionByName(low.select("src", F.col("low").alias("dst"))).distinct(), "small")
            after = state(now)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("dst").alias("node")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
