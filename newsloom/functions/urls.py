"""URL functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host without port; null for what does not parse."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def netloc(url: Column) -> Column:
    """Lower-case authority with port, as written between // and the path."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def allowed_host(url: Column, hosts: list[str]) -> Column:
    """http(s) and a host equal to one of the list: no suffixes, no user info."""
    plain = url.rlike(r"(?i)^https?://[^/?#@\\\s]+(?:[/?#]|$)")
    return F.coalesce(plain & host(url).isin([h.lower() for h in hosts]), F.lit(False))


def source_name(url: Column, names: dict[str, str], default: str = "other") -> Column:
    """A source by exact netloc, or the default."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(table[netloc(url)], F.lit(default))


def hashtag(url: Column, overrides: dict[str, str] | None = None) -> Column:
    """Second-level label of the host, unless its netloc is overridden."""
    bare = F.regexp_replace(netloc(url), r"^www\.", "")
    labels = F.split(F.regexp_replace(bare, r":\d+$", ""), r"\.")
    label = F.coalesce(F.try_element_at(labels, F.lit(-2)), F.try_element_at(labels, F.lit(1)))
    table = F.create_map(*[F.lit(x) for kv in (overrides or {"": ""}).items() for x in kv])
    return F.concat(F.lit("#"), F.coalesce(table[bare], label))


def safe_link(url: Column, schemes: tuple[str, ...] = ("http", "https", "mailto")) -> Column:
    """The trimmed URL if its scheme is allowed, else null; relative and // forms are not."""
    out = F.trim(url)
    pattern = "(?i)^(?:" + "|".join(s + (":" if s == "mailto" else "://") for s in schemes) + ")"
    return F.when(out.rlike(pattern), out)


def safe_image(url: Column) -> Column:
    return safe_link(url, ("http", "https"))


def video_id(url: Column) -> Column:
    """Id of a video on a known player host; the host is tested before the id."""
    h = host(url)
    tube = F.regexp_extract(url, r"(?:/embed/|/v/|/shorts/|[?&]v=)([A-Za-z0-9_-]{6,20})", 1)
    short = F.regexp_extract(url, r"^https?://[^/]+/([A-Za-z0-9_-]{6,20})", 1)
    vimeo = F.regexp_extract(url, r"/(?:video/)?(\d{4,12})", 1)
    found = (
        F.when(h.isin("www.youtube.com", "youtube.com", "m.youtube.com", "www.youtube-nocookie.com"), F.concat(F.lit("https://www.youtube.com/watch?v="), F.nullif(tube, F.lit(""))))
        .when(h == "youtu.be", F.concat(F.lit("https://www.youtube.com/watch?v="), F.nullif(short, F.lit(""))))
        .when(h.isin("vimeo.com", "player.vimeo.com"), F.concat(F.lit("https://vimeo.com/"), F.nullif(vimeo, F.lit(""))))
    )
    return found


def embed_url(url: Column, proxy: str = "/embed/") -> Column:
    """The canonical video URL percent-encoded into an embedding path, or null."""
    canonical = video_id(url)
    kind = F.when(canonical.contains("vimeo"), F.lit("vimeo")).otherwise(F.lit("youtube"))
    return F.concat(F.lit(proxy), kind, F.lit("?url="), F.url_encode(canonical))


def image_key(url: Column) -> Column:
    """What two copies of an image share: no query, no =sNNN(-c) size suffix."""
    return F.regexp_replace(F.substring_index(url, "?", 1), r"=s\d+(?:-c)?$", "")


def under_host(url: Column, hosts: list[str]) -> Column:
    """Host equal to one of the list or a subdomain of it."""
    out = F.lit(False)
    for h in hosts:
        out = out | (host(url) == h) | host(url).endswith("." + h)
    return F.coalesce(out, F.lit(False))


def slug(url: Column) -> Column:
    """Last path segment without query."""
    return F.element_at(F.split(F.regexp_replace(F.substring_index(F.substring_index(url, "?", 1), "#", 1), "/+$", ""), "/"), -1)


def review_identifier(url: Column, limit: int = 200) -> Column:
    """A URL fit for a log: no query, fragment or user info, clipped."""
    out = F.regexp_replace(F.substring_index(F.substring_index(F.coalesce(url, F.lit("")), "#", 1), "?", 1), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")
    return F.substring(F.regexp_replace(out, r"[^\x21-\x7e]", "?"), 1, limit)
