"""Readers and sinks: feeds, staged JSON, embedded payloads, snapshots."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from newsloom.functions import urls
from newsloom.operators import render

#: An item of a feed; repeated categories are labels.
ITEM = "title string, link string, pubDate string, description string, `content:encoded` string, category array<string>"


def read_feed(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """Entries of RSS files: link, title, published, summary, content, labels, feed_url, source_name. Bad items are nulls, not errors."""
    items = spark.read.format("xml").option("rowTag", "item").option("mode", "PERMISSIVE").schema(ITEM).load(path)
    return items.select(
        F.trim("link").alias("link"),
        "title",
        F.col("pubDate").alias("published"),
        F.col("description").alias("summary"),
        F.col("`content:encoded`").alias("content"),
        F.col("category").alias("labels"),
        F.input_file_name().alias("feed_url"),
        urls.source_name(F.trim("link"), names).alias("source_name"),
    )


STAGE_KEYS = ["blocks", "paragraphs", "ru_blocks", "ru_paragraphs", "subtitle", "title"]


def stage_verdict(payload: Column) -> Column:
    """ok, or the first rule that a staged payload breaks; all its limits are bounds of the rule set."""
    parse = lambda path, kind: F.from_json(F.get_json_object(payload, path), kind)
    texts = parse("$.paragraphs", "array<string>")
    kinds = parse("$.blocks", "array<struct<type:string,level:int>>")
    english, russian = F.get_json_object(payload, "$.blocks").isNotNull(), F.get_json_object(payload, "$.ru_blocks").isNotNull()
    known = F.array(*map(F.lit, ("lead", "paragraph", "heading", "list_item", "image", "video")))
    return (
        F.when(F.octet_length(payload) > 256 * 1024, F.lit("too large"))
        .when(render.json_depth(payload).isNull(), F.lit("not JSON"))
        .when(render.json_depth(payload) > 5, F.lit("too deep"))
        .when(F.coalesce(F.array_sort(F.json_object_keys(payload)), F.array().cast("array<string>")) != F.array(*map(F.lit, STAGE_KEYS)), F.lit("keys"))
        .when(texts.isNull() | (F.size(texts) > 100), F.lit("paragraphs"))
        .when(F.exists(texts, lambda t: t.isNull() | (F.octet_length(t) > 10 * 1024)), F.lit("paragraph length"))
        .when(english != russian, F.lit("blocks of one language only"))
        .when(F.coalesce(F.exists(kinds, lambda b: ~F.coalesce(F.array_contains(known, b["type"]), F.lit(False))), F.lit(False)), F.lit("block type"))
        .when(F.coalesce(F.exists(kinds, lambda b: (b["type"] == "heading") & ~F.coalesce(b["level"].isin(3, 4), F.lit(False))), F.lit(False)), F.lit("heading level"))
        .otherwise(F.lit("ok"))
    )


def _string_at(text: str, at: int) -> int:
    """The end of a JSON string that begins at a quote."""
    at += 1
    while at < len(text) and text[at] != '"':
        at += 2 if text[at] == "\\" else 1
    return at + 1


def balanced(text: str, at: int) -> str | None:
    """The bracketed JSON value that begins at a place; brackets inside strings do not count."""
    depth, start = 0, at
    while at < len(text):
        c = text[at]
        if c == '"':
            at = _string_at(text, at)
            continue
        depth += (c in "[{") - (c in "]}")
        at += 1
        if depth == 0:
            return text[start:at]
    return None


def embedded(html: str | None, name: str, cap: int = 5_000_000) -> str | None:
    """The list named ``name`` in a page's pushed string payloads, its $row references resolved.

    Payloads are JSON strings pushed by scripts; joined, they hold rows
    'id:value' and texts 'id:T<hex length>,…' that values point to as "$id".
    """
    import json

    parts = []
    for m in re.finditer(r"\.push\(\[\s*\d+\s*,\s*(?=\")", html or ""):
        end = _string_at(html, m.end())
        try:
            parts.append(json.loads(html[m.end() : end]))
        except ValueError:
            continue
    flight = "".join(parts)
    key = flight.find(f'"{name}":[')
    found = balanced(flight, key + len(name) + 3) if key >= 0 else None
    if found is None:
        return None

    def text(m: re.Match) -> str:
        row = re.search(rf"(?:^|\n){m[1]}:T([0-9a-f]+),", flight)
        if not row:
            return m[0]
        raw = flight[row.end() :].encode()[: min(int(row[1], 16), cap)]
        return json.dumps(raw.decode(errors="ignore"))

    return re.sub(r'"\$([0-9a-f]+)"', text, found)


def embedded_lists(name: str):
    """A column function from a page to its embedded list as JSON."""

    @pandas_udf(StringType())
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(lambda p: embedded(p, name))

    return read


def snapshot(table: DataFrame, path: str) -> DataFrame:
    """A Parquet copy of a table, read back; an empty copy is an error."""
    table.write.mode("errorifexists").parquet(path)
    out = table.sparkSession.read.parquet(path)
    if out.isEmpty():
        raise ValueError(f"the snapshot at {path} is empty")
    return out


def keeps_ledger(before: DataFrame, after: DataFrame, key: str = "link") -> bool:
    """Whether no key was lost, and something is there."""
    return before.join(after, key, "left_anti").isEmpty() and not after.isEmpty()
