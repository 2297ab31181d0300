"""Intake: new entries against the ledgers, defaults, positional zips of translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def new_entries(entries: DataFrame, processed: DataFrame, pending: DataFrame, keep: Column) -> DataFrame:
    """Entries with a link that is in neither ledger nor queue: per link the first relevant arrival.

    An irrelevant entry does not hide a later relevant one with its link.
    """
    fresh = entries.where(F.coalesce(F.col("link").cast("string"), F.lit("")) != "").where(keep)
    fresh = fresh.join(processed.select("link"), "link", "left_anti").join(pending.select("link"), "link", "left_anti")
    first = fresh.groupBy("link").agg(F.min("arrival").alias("arrival"))
    return fresh.join(first, ["link", "arrival"], "left_semi").dropDuplicates(["link"])


def sound_url(url: Column) -> Column:
    """An http(s) address with a host."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^\s/?#]+"), F.lit(False))


def sound_lists(feeds: DataFrame, by: list[str], limit: int = 5) -> DataFrame:
    """Per list of feeds (by, position, url) the number of its first ones, and whether all of them are addresses."""
    return feeds.where(F.col("position") < limit).groupBy(*by).agg(F.count("*").cast("int").alias("n"), F.min(sound_url(F.col("url"))).alias("whole"))


def feed_list(feeds: DataFrame, default: list[str], limit: int = 5) -> DataFrame:
    """The first feeds of (position, url); one invalid URL among them rejects the list for the default."""
    spark = feeds.sparkSession
    head = feeds.where(F.col("position") < limit)
    whole = sound_lists(feeds.withColumn("__all", F.lit(0)), ["__all"], limit)
    usual = spark.createDataFrame(list(enumerate(default)), "position int, url string")
    tagged = head.select(F.col("position").cast("int").alias("position"), "url").withColumn("own", F.lit(True)).unionByName(usual.withColumn("own", F.lit(False)))
    # one row, or none for an empty list
    use_own = F.coalesce("whole", F.lit(False))
    return tagged.withColumn("__all", F.lit(0)).join(F.broadcast(whole), "__all", "left").where(F.col("own") == use_own).select("position", "url")


def patchable(block: Column) -> Column:
    """A block whose text a translation replaces."""
    return block["type"].isin("lead", "paragraph", "heading", "list_item") & (F.trim(F.coalesce(block["text"], F.lit(""))) != "")


def aligned_blocks(blocks: Column, paragraphs: Column) -> Column:
    """Blocks if their patchable count equals the paragraphs, or is zero; else null."""
    n = F.size(F.filter(blocks, patchable))
    return F.when((n == 0) | (n == F.size(paragraphs)), blocks)


def patched_texts(blocks: Column, translated: Column) -> Column:
    """Block texts with the k-th patchable one replaced by the k-th translation; null if counts differ or one is blank."""
    n = F.size(F.filter(blocks, patchable))
    whole = (n == F.size(translated)) & F.forall(translated, lambda t: F.trim(F.coalesce(t, F.lit(""))) != "")
    text = F.transform(
        blocks, lambda b, i: F.when(patchable(b), F.get(translated, F.size(F.filter(F.slice(blocks, F.lit(1), i + 1), patchable)) - 1)).otherwise(b["text"])
    )
    return F.when(whole, text)


def paragraph_count(blocks: Column, paragraphs: Column) -> Column:
    """Text blocks if there are blocks, else paragraphs."""
    has = F.coalesce(F.size(blocks) > 0, F.lit(False))
    return F.when(has, F.size(F.filter(blocks, lambda b: b["type"].isin("lead", "paragraph", "heading", "list_item")))).otherwise(F.size(F.coalesce(paragraphs, F.array().cast("array<string>"))))


#: Provider answers that mean an outage, not a bad article.
OUTAGE_CODES = (401, 402, 403, 404, 407, 408, 409, 429)


def error_class(code: Column) -> Column:
    """outage for provider-wide codes and all 5xx, article otherwise."""
    return F.when(code.isin(*OUTAGE_CODES) | code.between(500, 599), F.lit("outage")).otherwise(F.lit("article"))


def translation_verdict(body: Column, paragraphs: Column, structured: Column, minimum: int = 30) -> Column:
    """ok, or the first rule that a translation's JSON breaks.

    Rules in order: a JSON object, a title, two or three alternatives, a subtitle
    text, a list of texts, their number, no blank ones if structured, enough text.
    """
    get = lambda path: F.get_json_object(body, path)
    title = get("$.title")
    alternatives = F.from_json(get("$.title_alternatives"), "array<string>")
    texts = F.from_json(get("$.paragraphs"), "array<string>")
    total = F.aggregate(F.coalesce(texts, F.array().cast("array<string>")), F.lit(0), lambda n, t: n + F.coalesce(F.char_length(t), F.lit(0)))
    blank = F.exists(texts, lambda t: F.trim(F.coalesce(t, F.lit(""))) == "")
    return (
        F.when(F.json_object_keys(F.when(body.rlike(r"(?s)^\s*\{"), body)).isNull(), F.lit("not an object"))
        .when(F.trim(F.coalesce(title, F.lit(""))) == "", F.lit("no title"))
        .when(~F.coalesce(F.size(alternatives).between(2, 3), F.lit(False)), F.lit("alternatives"))
        .when(get("$.subtitle").isNull(), F.lit("no subtitle"))
        .when(texts.isNull(), F.lit("no paragraphs"))
        .when(F.when(structured, F.size(texts) != paragraphs).otherwise((paragraphs > 0) & (F.size(texts) == 0)), F.lit("count"))
        .when(structured & blank, F.lit("blank paragraph"))
        .when((paragraphs >= 2) & (total < minimum), F.lit("too short"))
        .otherwise(F.lit("ok"))
    )
