"""What follows from verdicts: staged rows and ledger entries, fingerprint backfill, parser choice, alert texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as x
from newsloom.functions import urls
from newsloom.operators import intake
from newsloom.operators import queue as q

TEXTS = "array<string>"


def parser_of(url: Column, parsers: list[tuple[str, str]]) -> Column:
    """The parser of the first listed name that the URL's host contains; null if there is none."""
    host = F.lower(F.coalesce(urls.host(url), F.lit("")))
    found = F.lit(None).cast("string")
    for part, parser in reversed(parsers):
        found = F.when(F.contains(host, F.lit(part)), F.lit(parser)).otherwise(found)
    return found


def with_duplicates(gated: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Outcomes of the gates completed by the duplicate verdict (link, decision, match) of those that would be stored.

    A block outranks a hold; a flag keeps the outcome. An article without a verdict,
    or with an unknown one, is stored: a gate that fails lets articles through.
    """
    df = gated.join(verdicts.select("link", "decision", "match"), "link", "left")
    stored = F.col("outcome").isin("staged", "held_for_review")
    decision = F.when(stored, F.coalesce("decision", F.lit("pass")))
    return df.withColumns({"decision": decision, "match": F.when(decision.isin("block", "flag"), F.col("match")), "outcome": F.when(decision == "block", F.lit("duplicate")).otherwise(F.col("outcome"))})


def effects(judged: DataFrame, now: Column, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(staged, ledger) of rows that with_duplicates returned, one row per link each.

    A flagged article waits for the given hours, whether or not it is held; a held one
    carries its markers as the reason; a duplicate is not staged but remembered as seen.
    """
    kept = judged.where(F.col("outcome").isin("staged", "held_for_review"))
    after = F.when(F.col("decision") == "flag", now + F.make_dt_interval(F.lit(0), F.lit(hours)))
    reason = F.when((F.col("outcome") == "held_for_review") & (F.size("markers") > 0), F.array_join("markers", ", "))
    staged = kept.select("link", "title", after.alias("publish_after"), reason.alias("hold_reason")).dropDuplicates(["link"])
    seen = judged.where(F.col("outcome") == "duplicate").select("link", "title", "match").dropDuplicates(["link"])
    return staged, seen


#: Failed days of fetching after which a link is given up.
FETCH_RETRY_CAP = 3


def dropped(judged: DataFrame, failures: DataFrame, cap: int = FETCH_RETRY_CAP) -> DataFrame:
    """(link, title, why, match): what the ledger remembers of a tick besides what is staged, so that it does not come back.

    Promotions, dropped genres and duplicates are remembered; a link that could not be fetched is only once the ledger of
    failures (link, attempts) has reached the cap. Checklists and links that may still be fetched are not.
    """
    tried = judged.join(failures.select("link", "attempts").dropDuplicates(["link"]), "link", "left")
    retired = (F.col("outcome") == "no_article") & (F.coalesce("attempts", F.lit(0)) >= cap)
    why = F.when(F.col("outcome").isin("duplicate", "promo", "genre"), F.col("outcome")).when(retired, F.lit("retired"))
    rows = tried.withColumn("why", why).where(F.col("why").isNotNull())
    return rows.select("link", F.coalesce("title", F.lit("")).alias("title"), "why", F.when(F.col("why") == "duplicate", F.col("match")).alias("match")).dropDuplicates(["link"])


def staged_rows(judged: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """The rows that are staged, with all their columns: publish_after, hold_reason, the fingerprint as JSON, and blocks only if they pair with the paragraphs."""
    kept = judged.where(F.col("outcome").isin("staged", "held_for_review")).dropDuplicates(["link"])
    after = F.when(F.col("decision") == "flag", now + F.make_dt_interval(F.lit(0), F.lit(hours)))
    reason = F.when((F.col("outcome") == "held_for_review") & (F.size("markers") > 0), F.array_join("markers", ", "))
    made = {"publish_after": after, "hold_reason": reason}
    if "fp" in kept.columns:
        made["fingerprint"] = F.to_json("fp", {"ignoreNullFields": "false"})
    if {"blocks", "paragraphs"} <= set(kept.columns):
        made["blocks"] = intake.aligned_blocks(F.col("blocks"), F.col("paragraphs"))
    return kept.withColumns(made).drop("decision", "match", "outcome", "markers", "fp")


def backfill(rows: DataFrame, fetched: DataFrame) -> DataFrame:
    """Rows (link, fingerprint, …) with outcome and the fingerprint they have afterwards.

    fetched is (link, failed, paragraphs, found), at most one row per link. skipped: the
    row has pairs already; error: the fetch failed; unreachable: no row or no paragraphs
    came; updated: found is stored, an empty one too. Only updated rows change.
    """
    df = rows.join(fetched.select("link", "failed", "paragraphs", "found"), "link", "left")
    reached = F.coalesce(F.size("paragraphs") > 0, F.lit(False))
    outcome = (
        F.when(F.coalesce(q.has_pairs_key(F.col("fingerprint")), F.lit(False)), F.lit("skipped"))
        .when(F.coalesce("failed", F.lit(False)), F.lit("error"))
        .when(~reached, F.lit("unreachable"))
        .otherwise(F.lit("updated"))
    )
    df = df.withColumn("outcome", outcome)
    return df.withColumn("fingerprint", F.when(F.col("outcome") == "updated", F.col("found")).otherwise(F.col("fingerprint"))).drop("failed", "paragraphs", "found")


def days_in_range(raw: str, low: int = 1, high: int = 90) -> int:
    """A number of days given as text; anything else than a whole number from low to high is an error."""
    try:
        days = int(raw)
    except ValueError:
        raise ValueError(f"days must be a whole number, got {raw!r}") from None
    if not low <= days <= high:
        raise ValueError(f"days must be from {low} to {high}, got {days}")
    return days


# ---------------------------------------------------------------- alert texts


def alert_title(title: Column, limit: int = 200) -> Column:
    """A title cut to the limit; a missing one is written as None."""
    return x.clipped(F.coalesce(title, F.lit("None")), limit)


def alert_markers(markers: Column) -> Column:
    return F.when(F.coalesce(F.size(markers) > 0, F.lit(False)), F.array_join(markers, ", ")).otherwise(F.lit("—"))


def pair_label(pair: Column) -> Column:
    """model|series|tier as 'model + series', without the tier and without the * of any model."""
    parts = F.split(pair, r"\|")
    tier = F.get(parts, F.size(parts) - 1).isin("D", "B")
    named = F.slice(parts, F.lit(1), F.size(parts) - tier.cast("int"))
    return F.array_join(F.filter(named, lambda p: ~p.isin("", "*")), " + ")


def pair_labels(pairs: Column) -> Column:
    """One line per pair, in the order of the raw keys."""
    return F.array_join(F.transform(F.array_sort(pairs), pair_label), "\n")


# ---------------------------------------------------------------- translation of block strings


def block_strings(blocks: Column, skip_patched: bool = True) -> Column:
    """Array of (block, field, text): the strings of text and caption fields to translate, in order.

    With skip_patched the text of prose blocks is left out, as it comes with the paragraphs.
    """
    prose = ("lead", "paragraph", "heading", "list_item")

    def of_block(b: Column, i: Column) -> Column:
        both = F.array(*[F.struct(i.alias("block"), F.lit(n).alias("field"), b[n].alias("text")) for n in ("text", "caption")])
        own = lambda s: ~(F.coalesce(b["type"].isin(*prose), F.lit(False)) & (s["field"] == "text")) if skip_patched else F.lit(True)
        return F.filter(both, lambda s: F.coalesce(F.regexp_like(s["text"], F.lit(r"(?U)\S")), F.lit(False)) & own(s))

    return F.flatten(F.transform(blocks, of_block))


def spliced(blocks: Column, strings: Column, translations: Column) -> Column:
    """Blocks (with fields type, text, caption) with the k-th string replaced by the k-th translation.

    If the numbers differ, or there is no answer, blocks stay as they are; a blank
    translation leaves its own string.
    """
    keys = F.transform(strings, lambda s: F.concat_ws(":", s["block"].cast("string"), s["field"]))
    answers = F.map_from_arrays(keys, translations)

    def one(b: Column, i: Column) -> Column:
        def field(n: str) -> Column:
            answer = F.try_element_at(answers, F.concat_ws(":", i.cast("string"), F.lit(n)))
            return F.when(F.regexp_like(answer, F.lit(r"(?U)\S")), answer).otherwise(b[n])

        return b.withField("text", field("text")).withField("caption", field("caption"))

    same = F.coalesce(F.size(strings) == F.size(translations), F.lit(False))
    return F.when(same, F.transform(blocks, one)).otherwise(blocks)


def json_or_null(value: Column) -> Column:
    """A list as JSON text; null stays null, an empty list is []."""
    return F.to_json(value)


def list_or_null(text: Column) -> Column:
    """The list of strings that json_or_null wrote; null stays null."""
    return F.from_json(text, TEXTS)
