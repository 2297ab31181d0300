"""The driver's tables in the shapes of the intake: Spark views and their SQL twins.

orders play the queue (status F is held, the others are staged), their status O the
published ledger, documents the articles (first line the title), events the attempts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "1998-08-02 12:00:00"
EVENTS_NOW = "2024-01-30 12:00:00"


def now(text: str = NOW) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.expr("interval 1 day")
    key, cust, date = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("timestamp_ntz")
    return read(spark, sf_dir, "orders").select(
        key.alias("link"),
        F.concat(F.lit("src"), (cust % 7).cast("string")).alias("source_name"),
        F.col("o_orderpriority").alias("title"),
        date.alias("fetched_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("hold_reason"),
        F.when(key % 3 == 0, date + F.make_dt_interval((cust % 40).cast("int"))).alias("publish_after"),
        F.when(key % 4 == 0, date + day).alias("notified_at"),
        F.when(key % 5 != 0, (cust % 9).cast("int")).alias("hold_count"),
        (cust % 4).cast("int").alias("attempt_count"),
        F.when(key % 2 == 0, F.lit("x")).alias("ru_paragraphs"),
    )


PENDING = """pending as (
  select o_orderkey link, 'src' || (o_custkey % 7) source_name, o_orderpriority title, o_orderdate fetched_at,
    case when o_orderstatus = 'F' then o_orderpriority end hold_reason,
    case when o_orderkey % 3 = 0 then o_orderdate + to_days((o_custkey % 40)::int) end publish_after,
    case when o_orderkey % 4 = 0 then o_orderdate + interval 1 day end notified_at,
    case when o_orderkey % 5 <> 0 then (o_custkey % 9)::int end hold_count, (o_custkey % 4)::int attempt_count,
    case when o_orderkey % 2 = 0 then 'x' end ru_paragraphs
  from orders)"""


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "orders")
        .where("o_orderstatus = 'O'")
        .select(
            F.col("o_orderkey").alias("link"),
            F.col("o_orderpriority").alias("title"),
            F.concat(F.lit("src"), (F.col("o_custkey") % 7).cast("string")).alias("source_name"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("published_at"),
        )
    )


PUBLISHED = """published as (
  select o_orderkey link, o_orderpriority title, 'src' || (o_custkey % 7) source_name, o_orderdate published_at from orders where o_orderstatus = 'O')"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("link"),
        F.col("source").alias("source_name"),
        F.get(lines, F.lit(0)).alias("title"),
        F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))).alias("paragraphs"),
        F.col("lang"),
    )


ARTICLES = """articles as (
  select doc_id link, source source_name, l[1] title, l[2:] paragraphs, lang
  from (select *, string_split(coalesce(text, ''), chr(10)) l from documents))"""
