"""Text functions on columns: folding, cleaning, redaction, bounded diagnostics."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def text_or(*columns: Column) -> Column:
    """The first value that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


@pandas_udf(StringType())
def deaccented(values: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, in lower case; null is empty."""

    def one(text: str) -> str:
        if text.isascii():
            return text.lower()
        return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()

    return values.fillna("").map(one)


def tokens_of(plain: Column) -> Column:
    """The [a-z0-9]+ runs of an already deaccented text as ' a b ', with a space on either side."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0)), " "), F.lit(" "))


def folded(column: Column) -> Column:
    """Deaccented, lower-case words padded for whole-word substring tests; two spaces for no words."""
    return tokens_of(deaccented(column))


def fold_literal(text: str) -> str:
    """The same fold for a marker on the driver."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    out = "".join(c if c.isascii() and c.isalnum() else " " for c in plain).split()
    return " " + " ".join(out) + " "


def scan_input(column: Column, limit: int = 2000) -> Column:
    """What a scan sees of a text: null is empty, clipped before any folding."""
    return F.substring(F.coalesce(column, F.lit("")), 1, limit)


def joined_text(title: Column, subtitle: Column, paragraphs: Column) -> Column:
    """Non-empty title, subtitle and paragraphs, one to a line."""
    parts = F.concat(F.array(title, subtitle), F.coalesce(paragraphs, F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n")


def without_space(column: Column) -> Column:
    """All Unicode white space deleted, to compare titles."""
    return F.regexp_replace(column, r"(?U)\s+", "")


def single_spaced(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, r"(?U)\s+", " "))


def plain_paragraphs(html: Column) -> Column:
    """Summary markup to paragraphs: trailing 'continue reading' link and tags go, blank lines separate."""
    text = F.regexp_replace(html, r"(?is)<a\b[^>]*>\s*\(?continue reading\)?.*?</a>", "")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


def stripped(column: Column, patterns: list[str]) -> Column:
    """Each pattern in turn replaced by a space, then single-spaced; applying it twice changes nothing more."""
    for p in patterns:
        column = F.regexp_replace(column, p, " ")
    return single_spaced(column)


#: Shapes of secrets, in the order in which they must be tried.
SECRET_PATTERNS = [
    (r"(https?://)[^/\s:@]+:[^/\s@]+@", "$1***:***@"),
    (r"\b\d{6,12}:[A-Za-z0-9_-]{30,}", "***"),
    (r"sk-or-[A-Za-z0-9_-]{8,}", "***"),
    (r"sk-ant-[A-Za-z0-9_-]{8,}", "***"),
    (r"sk-[A-Za-z0-9_-]{16,}", "***"),
    (r"AIza[A-Za-z0-9_-]{20,}", "***"),
]


def redacted(column: Column, secrets: list[str] = ()) -> Column:
    """Known secrets and secret-shaped strings replaced; longer provider prefixes go first."""
    for s in secrets:
        column = F.replace(column, F.lit(s), F.lit("***"))
    for pattern, mask in SECRET_PATTERNS:
        column = F.regexp_replace(column, pattern, mask)
    return column


def clipped(column: Column, limit: int, mark: str = "…") -> Column:
    """At most ``limit`` characters, then a mark if anything was cut."""
    return F.when(F.char_length(column) > limit, F.concat(F.substring(column, 1, limit), F.lit(mark))).otherwise(column)


def safe_error(column: Column, secrets: list[str] = (), limit: int = 500) -> Column:
    """An error message without secrets, clipped."""
    out = F.coalesce(column, F.lit(""))
    for s in secrets:
        out = F.replace(out, F.lit(s), F.lit("[REDACTED]"))
    return clipped(out, limit)


def diagnostic(column: Column, limit: int = 200, oversized: int = 2048) -> Column:
    """One bounded line: controls to spaces, collapsed, redacted; '<unknown>' and '<oversized>' stand in."""
    line = redacted(single_spaced(F.regexp_replace(F.coalesce(column, F.lit("")), r"\p{C}", " ")))
    short = F.when(F.char_length(line) > limit, F.concat(F.substring(line, 1, limit - 1), F.lit("…"))).otherwise(line)
    return (
        F.when(F.char_length(column) > oversized, F.lit("<oversized>")).when(short == "", F.lit("<unknown>")).otherwise(short)
    )


def printable(column: Column, limit: int = 200) -> Column:
    """For a chat line: control characters dropped, other unprintables to '?', clipped."""
    out = F.regexp_replace(F.coalesce(column, F.lit("")), r"[\x00-\x1f\x7f]", "")
    return F.substring(F.regexp_replace(out, r"[\p{C}  ]", "?"), 1, limit)


def unfenced(column: Column) -> Column:
    """Text inside a ```json fence, or the trimmed text."""
    return F.regexp_replace(F.regexp_replace(F.trim(column), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def paragraphs_clipped(paragraphs: Column, limit: int) -> Column:
    return F.transform(paragraphs, lambda p: F.substring(p, 1, limit))


# The emojis that may begin a title, and what is looked for in a title without one, in order.
TITLE_EMOJIS = ["🏆", "🏎️", "🚀", "💎", "🤝", "📢", "🚗", "🔥"]
EMOJI_RULES = [
    ("легенд|legends|tour|чемпион|приз|победител", "🏆"),
    ("гонк|скорост|race|ралли", "🏎️"),
    ("релиз|выпуск|launch|запуск|вышел|выходит|дебют", "🚀"),
    ("коллекц|серия|series|collection", "💎"),
    ("сотруднич|партнёр|collab|partner", "🤝"),
    ("анонс|объявл|представля|announce", "📢"),
    (r"машин|автомобил|модел|(?U)\bcar\b", "🚗"),
]


def leading_emoji(title: Column, known: list[str] = TITLE_EMOJIS, rules: list[tuple[str, str]] = EMOJI_RULES, default: str = "🔥") -> Column:
    """The title if it starts with a known emoji, else the first matching rule's emoji before it; the rules read its lower case."""
    has = F.lit(False)
    for e in known:
        has = has | title.startswith(e)
    pick = F.lit(default)
    for pattern, emoji in reversed(rules):
        pick = F.when(F.lower(title).rlike(pattern), F.lit(emoji)).otherwise(pick)
    return F.when(has | (title == ""), title).otherwise(F.concat(pick, F.lit(" "), title))


def cyrillic_share(texts: Column) -> Column:
    """Share of Cyrillic among all letters of an array of texts; null without letters."""
    whole = F.array_join(texts, "\n")
    letters = F.regexp_count(whole, F.lit(r"\p{L}"))
    return F.try_divide(F.regexp_count(whole, F.lit(r"[\p{L}&&[Ѐ-ӿ]]")), letters)


def mostly_cyrillic(texts: Column, at_least: float = 0.30) -> Column:
    """Whether the share reaches a bound; texts without letters pass."""
    return F.coalesce(cyrillic_share(texts) >= at_least, F.lit(True))


def total_length(texts: Column) -> Column:
    """Characters of all texts of an array together."""
    return F.aggregate(F.coalesce(texts, F.array().cast("array<string>")), F.lit(0).cast("long"), lambda n, t: n + F.coalesce(F.char_length(t), F.lit(0)))
