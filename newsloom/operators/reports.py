"""Reports over the queue and the intake: sources, health, funnel, recap, bounded events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import temporal

SEVERITIES = ("OK", "INFO", "WARN", "BAD")


def source_report(published: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Per source: publications in the window (strictly after its start), the latest one and its age in days."""
    fresh = F.col("published_at") > now - F.expr(f"interval {days} days")
    last = F.max("published_at")
    return published.groupBy("source_name").agg(
        F.sum(F.when(fresh, 1).otherwise(0)).alias("n"), last.alias("last_published"), temporal.julian_age_days(last, now).alias("age_days")
    )


def source_silence(expected: list[str], report: DataFrame, quiet_for_good: int = 45) -> DataFrame:
    """Verdict on each expected source name against the report's names that contain it; the first by name counts.

    The report is read once, whatever its size, and leaves one row per expected name.
    """
    names = list(dict.fromkeys(expected))
    wanted = report.sparkSession.createDataFrame([(n,) for n in names], "source string")
    found = F.filter(F.array(*map(F.lit, names)).cast("array<string>"), lambda s: F.contains("source_name", s))
    hits = report.select(F.col("source_name").alias("found"), "n", "age_days", F.explode(found).alias("source"))
    first = wanted.join(hits.groupBy("source").agg(F.min(F.struct("found", "n", "age_days")).alias("x")), "source", "left")
    n, age = F.col("x.n"), F.col("x.age_days")
    verdict = (
        F.when(F.col("x.found").isNull(), F.lit("WARN")).when((n == 0) & (age > quiet_for_good), F.lit("INFO")).when(n == 0, F.lit("WARN")).otherwise(F.lit("OK"))
    )
    return first.select("source", F.col("x.found").alias("found"), verdict.alias("severity"))


def dedup_warmth(rows: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """One row: recent rows, those with fingerprint, and the verdict on their share."""
    is_recent = F.col("ts") >= now - F.expr(f"interval {days} days")
    out = rows.agg(
        F.count_if(is_recent).alias("recent"), F.count_if(is_recent & F.col("fingerprint").isNotNull()).alias("with_fingerprint")
    )
    share = F.try_divide("with_fingerprint", "recent")
    verdict = (
        F.when(F.col("recent") == 0, F.lit("WARN")).when(F.col("with_fingerprint") == 0, F.lit("BAD")).when(share < 0.5, F.lit("WARN")).otherwise(F.lit("OK"))
    )
    return out.withColumn("severity", verdict)


def state_keys(state: DataFrame, excluded: tuple[str, ...] = ("outage", "fallback_active")) -> DataFrame:
    """Keys per prefix before the first colon, without the machines' own keys."""
    own = F.lit(False)
    for e in excluded:
        own = own | F.col("key").startswith(e)
    return state.where(~own).groupBy(F.substring_index("key", ":", 1).alias("prefix")).agg(F.count("*").alias("n"))


def worst(severities: DataFrame) -> DataFrame:
    """The highest severity and its exit code."""
    level = F.max(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")))
    code = F.coalesce(level - 1, F.lit(0))
    return severities.agg(code.cast("int").alias("exit_code"))


def heartbeat(last: Column, now: Column) -> Column:
    """OK below 26 hours since the last beat, WARN below 50, else BAD."""
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 3_600_000_000
    return F.when(last.isNull(), F.lit("BAD")).when(hours < 26, F.lit("OK")).when(hours < 50, F.lit("WARN")).otherwise(F.lit("BAD"))


def dry_spell(published: DataFrame, now: Column, days: int = 2) -> DataFrame:
    """Whether nothing was published for some days; an empty table does not count."""
    last = F.max("published_at")
    return published.agg(last.alias("last_published"), F.coalesce(last <= now - F.expr(f"interval {days} days"), F.lit(False)).alias("silent"))


# ---------------------------------------------------------------- intake funnel

#: Drop outcomes in the order that decides ties.
DROPS = ("block", "no_article", "checklist", "promo", "genre")
NOT_DROPS = ("staged", "held_for_review", "degraded", "suppressed")


def funnel(outcomes: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts of the outcome column per group: one column each, the total of drops and of all rows."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in (*DROPS, *NOT_DROPS)]
    out = outcomes.groupBy(*by).agg(F.count("*").alias("seen"), *counts)
    return out.withColumn("dropped", sum((F.col(d) for d in DROPS), F.lit(0)))


def collapse_note(funnels: DataFrame) -> DataFrame:
    """Why nothing was staged: no entries, nothing new, or the drop that took most."""
    ranked = F.array_max(F.array(*[F.struct(F.col(d).alias("n"), F.lit(-i).alias("p"), F.lit(d).alias("name")) for i, d in enumerate(DROPS)]))
    note = (
        F.when(F.col("staged") > 0, F.lit("")).when(F.col("seen") == 0, F.lit("no entries")).when(F.col("dropped") == 0, F.lit("nothing new")).otherwise(ranked["name"])
    )
    return funnels.withColumn("note", note)


def publish_recap(outcomes: DataFrame, failures: int = 5, clip: int = 200) -> DataFrame:
    """One row: published, held, deferred and failed counts; the first failures by link with clipped reasons."""
    counts = outcomes.agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("published", "held", "deferred")],
        F.count_distinct(F.when(F.col("outcome") == "failed", F.col("link"))).alias("failed"),
    )
    first = outcomes.where("outcome = 'failed'").groupBy("link").agg(F.min(F.struct("ts", "error")).alias("x"))
    top = first.orderBy("x.ts", "link").limit(failures)
    reason = F.concat(F.col("link").cast("string"), F.lit(": "), F.substring(F.coalesce("x.error", F.lit("")), 1, clip))
    lines = top.agg(F.array_sort(F.collect_list(F.struct("x.ts", "link", reason.alias("line")))).alias("l"))
    return counts.crossJoin(lines.select(F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("failures")))


def bounded_events(events: DataFrame, by: list[str], max_events: int = 500, max_links: int = 50) -> DataFrame:
    """Events (by, code, link, seq) per group and code, over the first events of a group only.

    Of each code the first links seen are listed with counts; events of further
    links are counted as overflow. ``total`` counts all events of a group.
    """
    group = Window.partitionBy(*by)
    numbered = events.withColumn("place", F.row_number().over(group.orderBy("seq"))).withColumn("total", F.count("*").over(group))
    kept = numbered.where(F.col("place") <= max_events)
    links = kept.groupBy(*by, "total", "code", "link").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    ranked = links.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "code").orderBy("first")))
    shown = F.col("rank") <= max_links
    out = ranked.groupBy(*by, "total", "code").agg(
        F.sum("n").alias("events"),
        F.count_if(shown).alias("links"),
        F.sum(F.when(~shown, F.col("n")).otherwise(0)).alias("overflow"),
        F.array_sort(F.collect_list(F.when(shown, F.struct("rank", "link", "n")))).alias("l"),
    )
    line = F.array_join(F.transform("l", lambda x: F.concat(x["link"].cast("string"), F.lit("×"), x["n"].cast("string"))), ", ")
    return out.withColumn("listing", F.substring(line, 1, 3500)).drop("l")


def verdict_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("verdict").agg(F.count("*").alias("n"))


def remaining_credits(*ceilings: Column) -> Column:
    """The least of the ceilings that are known; null if none is."""
    return F.least(*ceilings)
