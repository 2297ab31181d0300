"""The publish queue: predicates, order, snapshots and moves as table transformations.

The queue's tables are DataFrames; a mutation returns the table after it. Every
function takes ``now`` where time matters. Keys are unique per table; operators
that insert keep that so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------- predicates


def publishable(now: Column) -> Column:
    """Not held, and not deferred beyond now. With deferred() and held() it splits the table in three."""
    return F.col("hold_reason").isNull() & (F.col("publish_after").isNull() | (F.col("publish_after") <= now))


def deferred(now: Column) -> Column:
    return F.col("hold_reason").isNull() & F.coalesce(F.col("publish_after") > now, F.lit(False))


def held() -> Column:
    return F.col("hold_reason").isNotNull()


def queue_state(now: Column) -> Column:
    """held, deferred or publishable; a hold dominates a deferral."""
    return F.when(held(), F.lit("held")).when(deferred(now), F.lit("deferred")).otherwise(F.lit("publishable"))


def stale(now: Column, hours: int = 48) -> Column:
    """Never announced and strictly older than the bound."""
    return ~held() & F.col("notified_at").isNull() & (F.col("fetched_at") < now - F.expr(f"interval {hours} hours"))


def overdue(now: Column, hours: int = 2) -> Column:
    """Announced before the bound and still untranslated; deferrals do not matter here."""
    return ~held() & F.coalesce(F.col("notified_at") < now - F.expr(f"interval {hours} hours"), F.lit(False)) & F.col("ru_paragraphs").isNull()


def evictable(now: Column) -> Column:
    return publishable(now) & F.col("ru_paragraphs").isNull()


def listed(pending: DataFrame, which: str, now: Column) -> DataFrame:
    """One of the lists that operators are shown, the oldest first: held, stale, overdue or evictable rows."""
    tests = {"held": held, "stale": lambda: stale(now), "overdue": lambda: overdue(now), "evictable": lambda: evictable(now)}
    return pending.where(tests[which]()).orderBy("notified_at" if which == "overdue" else "fetched_at", "link")


def recent(ts: str, now: Column, days: int) -> Column:
    """Not before now minus days, the border included; held and deferred rows too."""
    return F.col(ts) >= now - F.expr(f"interval {days} days")


def needs_backfill(fingerprint: Column) -> Column:
    """Stored fingerprint JSON is invalid, or has no pairs or null pairs."""
    return F.get_json_object(fingerprint, "$.pairs").isNull()


def has_pairs_key(fingerprint: Column) -> Column:
    """A JSON object that has the key pairs, whatever its value."""
    return F.coalesce(F.array_contains(F.json_object_keys(fingerprint), "pairs"), F.lit(False))


# ---------------------------------------------------------------- order


def publish_order(now: Column) -> list[Column]:
    """Today's batch first, then by age, then by link."""
    return [F.when(F.to_date("fetched_at") == F.to_date(now), 0).otherwise(1), F.col("fetched_at"), F.col("link")]


def head(pending: DataFrame, now: Column) -> DataFrame:
    """The next row to publish: at most one."""
    return pending.where(publishable(now)).orderBy(*publish_order(now)).limit(1)


def indexed(pending: DataFrame, now: Column, per: str | None = None) -> DataFrame:
    """1-based place in publish order, over the table or per a column's value."""
    keys = [per] if per else [F.lit(1)]
    return pending.withColumn("queue_index", F.row_number().over(Window.partitionBy(*keys).orderBy(*publish_order(now))))


# ---------------------------------------------------------------- snapshots


def backlog(pending: DataFrame, now: Column) -> DataFrame:
    """One row: publishable, deferred and held counts, in one pass; zeros for an empty table."""
    return pending.agg(
        F.count_if(publishable(now)).alias("publishable"), F.count_if(deferred(now)).alias("deferred"), F.count_if(held()).alias("held")
    )


def held_by_reason(pending: DataFrame) -> DataFrame:
    return pending.where(held()).groupBy("hold_reason").agg(F.count("*").alias("n"))


def last_published(published: DataFrame) -> DataFrame:
    """Latest publication, null on an empty table."""
    return published.agg(F.max("published_at").alias("last_published"))


# ---------------------------------------------------------------- inserts and updates


def insert_missing(target: DataFrame, rows: DataFrame, key: str = "link") -> DataFrame:
    """target with the rows whose key it lacks, one per key; present rows stay untouched."""
    first = rows.dropDuplicates([key])
    return target.unionByName(first.join(target.select(key), key, "left_anti").select(*target.columns))


def inserted(target: DataFrame, rows: DataFrame, key: str = "link") -> DataFrame:
    """Whether each row would be inserted."""
    have = target.select(key).distinct().withColumn("__have", F.lit(True))
    return rows.join(have, key, "left").withColumn("inserted", F.col("__have").isNull()).drop("__have")


def update_by_key(target: DataFrame, changes: DataFrame, columns: list[str], key: str = "link") -> DataFrame:
    """target with the non-null values of changes in some columns, for rows with the same key."""
    new = changes.select(key, *[F.col(c).alias(f"__new_{c}") for c in columns])
    out = target.join(new, key, "left")
    return out.select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns])


def set_where(target: DataFrame, when: Column, **values: Column) -> DataFrame:
    """target with some columns replaced where a condition holds."""
    hit = F.coalesce(when, F.lit(False))
    return target.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def mark_notified(pending: DataFrame, which: Column, now: Column) -> DataFrame:
    return set_where(pending, which, notified_at=now)


def clear_notified(pending: DataFrame, which: Column) -> DataFrame:
    return set_where(pending, which, notified_at=F.lit(None))


def increment_attempt(pending: DataFrame, which: Column) -> DataFrame:
    return set_where(pending, which, attempt_count=F.col("attempt_count") + 1)


def increment_hold(pending: DataFrame, which: Column) -> DataFrame:
    """A null hold count is zero."""
    return set_where(pending, which, hold_count=F.coalesce("hold_count", F.lit(0)) + 1)


def defer(pending: DataFrame, which: Column, until: Column) -> DataFrame:
    return set_where(pending, which, publish_after=until)


def clear_deferral(pending: DataFrame, which: Column) -> DataFrame:
    return set_where(pending, which & F.col("publish_after").isNotNull(), publish_after=F.lit(None).cast("timestamp"))


def clear_hold(pending: DataFrame, which: Column) -> DataFrame:
    return set_where(pending, which & held(), hold_reason=F.lit(None).cast("string"))


def reset_hold_counts(pending: DataFrame, cap: int = 6) -> DataFrame:
    """Counts above zero and below the cap become zero; at the cap they mark a capped row and stay."""
    return set_where(pending, (F.col("hold_count") > 0) & (F.col("hold_count") < cap), hold_count=F.lit(0))


def upsert_latest(state: DataFrame, changes: DataFrame) -> DataFrame:
    """A key/value table after ordered changes (key, value, seq): the latest wins, a null value deletes."""
    last = changes.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    kept = state.join(last.select("key"), "key", "left_anti")
    return kept.select("key", "value").unionByName(last.where("value is not null").select("key", "value"))


def append_ledger(ledger: DataFrame, rows: DataFrame, key: str = "link") -> DataFrame:
    """ledger with new rows; a key that is there already is an error, raised when the row is read."""
    have = ledger.select(key).distinct().withColumn("__have", F.lit(True))
    checked = rows.join(have, key, "left").withColumn(
        key, F.when(F.col("__have").isNull(), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("already in the ledger: "), F.col(key).cast("string"))).cast(dict(ledger.dtypes)[key]))
    )
    return ledger.unionByName(checked.select(*ledger.columns))


# ---------------------------------------------------------------- moves between tables


def move_to_published(
    pending: DataFrame, published: DataFrame, processed: DataFrame, done: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pending, published, processed) after publishing the links of ``done`` (link, telegraph_url, via_review).

    A row that is no longer pending is rebuilt from the ledger's title; a row that is
    already published is not published twice.
    """
    fresh = done.dropDuplicates(["link"]).join(published.select("link"), "link", "left_anti")
    source = fresh.join(pending.select("link", "title", "source_name"), "link", "left")
    source = source.join(processed.select("link", F.col("title").alias("__ledger")), "link", "left")
    rows = source.select(
        "link",
        F.coalesce("title", "__ledger", F.lit("")).alias("title"),
        F.coalesce("source_name", F.lit("other")).alias("source_name"),
        "telegraph_url",
        now.alias("published_at"),
        F.coalesce("via_review", F.lit(False)).alias("via_review"),
    )
    ledger = rows.select("link", "title", F.col("published_at").alias("processed_at"))
    return (
        pending.join(done.select("link"), "link", "left_anti").select(*pending.columns),
        published.unionByName(rows.select(*published.columns)),
        insert_missing(processed, ledger),
    )


def move_to_failed(pending: DataFrame, failed: DataFrame, errors: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(pending, failed) after giving up the links of ``errors`` (link, last_error); fetch times are carried along."""
    rows = pending.join(errors.select("link", F.col("last_error").alias("__error")), "link").select(
        "link", "title", "source_name", F.col("__error").alias("last_error"), now.alias("failed_at"), F.col("fetched_at").alias("original_fetched_at")
    )
    kept = failed.join(rows.select("link"), "link", "left_anti").select(*failed.columns)
    return pending.join(errors.select("link"), "link", "left_anti").select(*pending.columns), kept.unionByName(rows.select(*failed.columns))


def skip_pending(pending: DataFrame, processed: DataFrame, links: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(pending, processed) after retiring links unpublished."""
    rows = pending.join(links.select("link"), "link").select("link", "title", now.alias("processed_at"))
    return pending.join(links.select("link"), "link", "left_anti").select(*pending.columns), insert_missing(processed, rows)


def retry_failed(failed: DataFrame, pending: DataFrame, links: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(failed, pending) after queueing failed links again with fresh attempts; links already pending are refused."""
    chosen = failed.join(links.select("link"), "link", "left_semi").join(pending.select("link"), "link", "left_anti")
    blank = {c: F.lit(None).cast(t) for c, t in pending.dtypes}
    known = {"link": F.col("link"), "title": F.col("title"), "source_name": F.col("source_name"), "fetched_at": now, "attempt_count": F.lit(0)}
    rows = chosen.select(*[known.get(c, blank[c]).cast(t).alias(c) for c, t in pending.dtypes])
    return failed.join(chosen.select("link"), "link", "left_anti").select(*failed.columns), pending.unionByName(rows)


# ---------------------------------------------------------------- review decisions

TOKEN_KINDS = ("dedup", "hold")


def encode_token(kind: str, link: Column) -> Column:
    return F.concat(F.lit(kind), F.lit("|"), link)


def decode_token(token: Column) -> Column:
    """struct(kind, link); a token without a known kind before the first bar is an old one of kind dedup."""
    kind = F.substring_index(token, "|", 1)
    known = token.contains("|") & kind.isin(*TOKEN_KINDS)
    return F.struct(
        F.when(known, kind).otherwise(F.lit("dedup")).alias("kind"),
        F.when(known, F.regexp_replace(token, r"^[^|]*\|", "")).otherwise(token).alias("link"),
    )


def approval(hold_reason: Column, publish_after: Column, present: Column, expected_reason: Column, now: Column) -> Column:
    """What approving a hold finds: unavailable, stale (another reason by now), deferred or ready."""
    return (
        F.when(~F.coalesce(present, F.lit(False)), F.lit("unavailable"))
        .when(hold_reason.isNull() | (hold_reason != expected_reason), F.lit("stale"))
        .when(F.coalesce(publish_after > now, F.lit(False)), F.lit("deferred"))
        .otherwise(F.lit("ready"))
    )


def callback_action(payload: Column, user_id: Column, admins: list[int]) -> Column:
    """The decision on an operator's button: authorisation first, then grammar of prefix:action:token."""
    parts = F.split(payload, ":")
    action = F.get(parts, F.lit(1))
    kind = F.get(parts, F.lit(0))
    fits = (F.octet_length(payload) <= 64) & (F.size(parts) == 3) & (F.get(parts, F.lit(2)) != "")
    return (
        F.when(~F.coalesce(user_id.isin(*admins), F.lit(False)), F.lit("denied"))
        .when(~F.coalesce(fits, F.lit(False)), F.lit("malformed"))
        .when((kind == "dedup") & (action == "keep"), F.lit("publish"))
        .when((kind == "dedup") & (action == "cancel"), F.lit("retire"))
        .when((kind == "hold") & (action == "approve"), F.lit("publish"))
        .when((kind == "hold") & (action == "reject"), F.lit("retire"))
        .otherwise(F.lit("malformed"))
    )


# ---------------------------------------------------------------- fetch failures


def record_fetch_failures(failures: DataFrame, attempts: DataFrame) -> DataFrame:
    """failures (link, attempts, first_failed_at, last_failed_at) after failed attempts (link, ts).

    A link counts once per UTC day: an attempt adds one only if it falls on a later day than the last
    failure before it. An attempt without time or link changes nothing.
    """
    rows = attempts.where("link is not null and ts is not null")
    known = rows.join(failures.select("link", F.col("last_failed_at").alias("known")), "link", "left")
    later = F.when(F.col("known").isNull() | (F.to_date("ts") > F.to_date("known")), F.to_date("ts"))
    new = known.groupBy("link").agg(F.count_distinct(later).alias("days"), F.min("ts").alias("low"), F.max("ts").alias("high"))
    both = failures.join(new, "link", "full_outer")
    return both.select(
        "link",
        (F.coalesce("attempts", F.lit(0)) + F.coalesce("days", F.lit(0))).cast("int").alias("attempts"),
        F.coalesce("first_failed_at", "low").alias("first_failed_at"),
        F.greatest("last_failed_at", "high").alias("last_failed_at"),
    )


def clear_fetch_failures(failures: DataFrame, fetched: DataFrame) -> DataFrame:
    """failures without the links (link) that were fetched; their streak begins anew."""
    return failures.join(fetched.select("link").where("link is not null").distinct(), "link", "left_anti")


def image_limits(articles: DataFrame, limits: DataFrame) -> DataFrame:
    """articles with image_limit of their source from limits (source_name, image_limit); null is no limit."""
    return articles.join(limits.select("source_name", "image_limit").dropDuplicates(["source_name"]), "source_name", "left")
