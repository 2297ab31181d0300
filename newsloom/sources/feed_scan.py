"""Feeds to articles: entries of allowed hosts with their embedded bodies, and a reason for everything that is turned away.

A feed is a row (feed_url, body), as a crawler leaves it or as ``wholetext`` files give it. Its size is checked before it is
parsed, and the host of an entry before its body is. The body of an entry is read by the rules of its
site (operators.site_pages); a heading in it takes the place of the feed's title.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import site_pages as sp

MAX_BYTES = 5 * 1024 * 1024
ENTRY = "struct<title:string,link:string,pubDate:string,description:string,`content:encoded`:string,category:array<string>>"
FEED = f"channel struct<item:array<{ENTRY}>>, _corrupt_record string"


def feed_files(spark: SparkSession, path: str) -> DataFrame:
    """(feed_url, body) of feed files under a path of any file system."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("feed_url"), F.col("value").alias("body"))


def entries(feeds: DataFrame, sites: tuple[sp.Rules, ...] = sp.SITES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A row per entry in the feed's order, or one for a feed without any: feed_url, position, the entry's fields, source_name and reason."""
    fits = F.octet_length("body") <= max_bytes
    parsed = feeds.select("feed_url", "body", fits.alias("fits"), F.when(fits, F.from_xml("body", FEED, {"columnNameOfCorruptRecord": "_corrupt_record"})).alias("feed"))
    items = F.when(F.col("feed._corrupt_record").isNull(), F.col("feed.channel.item"))
    rows = parsed.select("feed_url", "body", "fits", "feed", F.posexplode_outer(items).alias("position", "entry"))
    link = F.trim("entry.link")
    site = sp.site_of(link, sites)
    reason = (
        F.when(F.col("body").isNull(), F.lit("no body"))
        .when(~F.col("fits"), F.lit("too large"))
        .when(F.col("feed").isNull() | F.col("feed._corrupt_record").isNotNull(), F.lit("malformed"))
        .when(F.col("entry").isNull(), F.lit("no entries"))
        .when(site.isNull(), F.lit("host rejected"))
    )
    return rows.select(
        "feed_url", "position", link.alias("link"), F.col("entry.title").alias("feed_title"), F.col("entry.pubDate").alias("published"), F.col("entry.description").alias("summary"),
        F.col("entry.`content:encoded`").alias("content"), F.col("entry.category").alias("labels"), site.alias("source_name"), reason.alias("refused"),
    )


def scan_feeds(feeds: DataFrame, sites: tuple[sp.Rules, ...] = sp.SITES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Articles of all feeds (feed_url, position, link, title, published, summary, labels, source_name, subtitle, paragraphs, images, blocks, reason).

    Refused entries keep their place and say why; their bodies are not read.
    """
    found = entries(feeds, sites, max_bytes).withColumns({"id": F.lit(0), "body": F.when(F.col("refused").isNull(), F.col("content"))})
    carry = ("feed_url", "position", "link", "feed_title", "published", "summary", "labels", "source_name", "refused")
    read = sp.articles(found, sites, id_col="id", url_col="link", html_col="body", carry=carry)
    title = F.when(F.col("carried.refused").isNull() & (F.coalesce("title", F.lit("")) != ""), F.col("title")).otherwise(F.col("carried.feed_title"))
    own = F.col("carried.refused").isNull()
    kept = lambda c: F.when(own, F.col(c)).alias(c)
    return read.select(
        *(F.col(f"carried.{c}") for c in ("feed_url", "position", "link")),
        title.alias("title"),
        *(F.col(f"carried.{c}") for c in ("published", "summary", "labels", "source_name")),
        *map(kept, ("subtitle", "paragraphs", "images", "blocks")),
        F.coalesce("carried.refused", "reason").alias("reason"),
    )
