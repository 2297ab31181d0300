"""Queries of queue, token, text and time operators that no other module registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import temporal
from newsloom.functions import text as x
from newsloom.functions import urls as u
from newsloom.operators import queue as q
from newsloom.operators import reports as r
from newsloom.plans import tables as t

QUERIES: dict = {}
SQL: dict[str, str] = {}
N = f"timestamp '{t.NOW}'"
HALF = "timestamp '2024-01-15 00:00:00'"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after the failed attempts of both halves of the month, put down one after the other."""
    rows = t.read(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("link"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    none = spark.createDataFrame([], "link long, attempts int, first_failed_at timestamp_ntz, last_failed_at timestamp_ntz")
    half = F.expr(HALF.replace("timestamp ", "timestamp_ntz "))
    return q.record_fetch_failures(q.record_fetch_failures(none, rows.where(F.col("ts") < half)), rows.where(F.col("ts") >= half))


FAILURES = "select user_id link, count(distinct ts::date)::int attempts, min(ts) first_failed_at, max(ts) last_failed_at from events where event_type = 'error' group by 1"


@query(FAILURES)
def fetch_failure_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failures(spark, sf_dir)


@query(f"select * from ({FAILURES}) where link not in (select user_id from events where event_type = 'signup' and ts >= timestamp '2024-01-28 00:00:00')")
def fetch_failure_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = t.read(spark, sf_dir, "events").where("event_type = 'signup' and ts >= timestamp '2024-01-28 00:00:00'")
    return q.clear_fetch_failures(_failures(spark, sf_dir), done.select(F.col("user_id").alias("link")))


@query(f"""with {t.PENDING}, failed as (select * from pending where attempt_count >= 2), waiting as (select * from pending where attempt_count < 1),
a as (select link from failed where hold_reason is null)
select 'failed' "table", link, attempt_count from failed where link not in (select link from a) union all select 'pending', link, attempt_count from waiting
union all select 'pending', link, 0 from a""")
def retry_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.pending(spark, sf_dir)
    failed = rows.where("attempt_count >= 2")
    two = q.retry_failed(failed, rows.where("attempt_count < 1"), failed.where("hold_reason is null").select("link"), t.now())
    named = [d.select(F.lit(n).alias("table"), "link", "attempt_count") for n, d in zip(("failed", "pending"), two, strict=True)]
    return named[0].unionByName(named[1])


@query("""with c as (select conv_id, turn, case turn % 3 when 0 then 'dedup|' || coalesce(text, '') when 1 then 'hold|' || coalesce(text, '') else coalesce(text, '') end token from conversations)
select conv_id, turn, case when starts_with(token, 'hold|') then 'hold' else 'dedup' end kind,
  case when starts_with(token, 'dedup|') or starts_with(token, 'hold|') then token[strpos(token, '|') + 1:] else token end link from c""")
def review_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    token = F.when(F.col("turn") % 3 == 0, q.encode_token("dedup", text)).when(F.col("turn") % 3 == 1, q.encode_token("hold", text)).otherwise(text)
    return t.read(spark, sf_dir, "conversations").select("conv_id", "turn", q.decode_token(token).alias("d")).select("conv_id", "turn", "d.kind", "d.link")


@query(f"""with {t.PENDING} select link, case when attempt_count = 3 then 'unavailable' when hold_reason is null or hold_reason <> '1-URGENT' then 'stale'
  when coalesce(publish_after > {N}, false) then 'deferred' else 'ready' end approval from pending""")
def hold_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = q.approval(F.col("hold_reason"), F.col("publish_after"), F.col("attempt_count") < 3, F.lit("1-URGENT"), t.now())
    return t.pending(spark, sf_dir).select("link", found.alias("approval"))


@query("""with j as (select event_id, case event_type when 'view' then props when 'click' then '{"pairs": null}' when 'signup' then '{"pairs": ["a"]}' when 'error' then 'no json' else '{"strict": []}' end fp from events)
select event_id, coalesce(case when json_valid(fp) then json_extract(fp, '$.pairs')::varchar end, 'null') = 'null' needs,
  coalesce(case when json_valid(fp) then list_contains(json_keys(fp), 'pairs') end, false) has_key from j""")
def backfill_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"click": '{"pairs": null}', "signup": '{"pairs": ["a"]}', "error": "no json", "purchase": '{"strict": []}'}
    fp = F.coalesce(F.create_map(*[F.lit(v) for kv in kinds.items() for v in kv])[F.col("event_type")], F.col("props"))
    return t.read(spark, sf_dir, "events").select("event_id", q.needs_backfill(fp).alias("needs"), q.has_pairs_key(fp).alias("has_key"))


@query(f"""with {t.PENDING} select link, fetched_at >= {N} - interval 45 day recent, source_name,
  case source_name when 'src1' then 3 when 'src4' then 10 end image_limit from pending""")
def source_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.createDataFrame([("src1", 3), ("src4", 10)], "source_name string, image_limit int")
    return q.image_limits(t.pending(spark, sf_dir), limits).select("link", temporal.within(F.col("fetched_at"), t.now(), "45 days").alias("recent"), "source_name", "image_limit")


@query("""select page_id, case when regexp_matches(trim(url), '(?i)^https?://') then trim(url) end image,
  left(regexp_replace(regexp_replace(split_part(split_part(coalesce(url, ''), '#', 1), '?', 1), '^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@', '\\1'), '[^\\x21-\\x7e]', '?', 'g'), 200) logged from pages""")
def logged_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.read(spark, sf_dir, "pages").select("page_id", u.safe_image(F.col("url")).alias("image"), u.review_identifier(F.col("url")).alias("logged"))


@query("""with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) p from documents)
select doc_id, list_transform(p, lambda z: left(z, 20))::varchar[] clipped, length(regexp_replace(array_to_string(p, chr(10)), '\\P{L}', '', 'g')) = 0
  or length(regexp_replace(array_to_string(p, chr(10)), '[^Ѐ-ӿ]', '', 'g')) >= 0.3 * length(regexp_replace(array_to_string(p, chr(10)), '\\P{L}', '', 'g')) cyrillic from l""")
def paragraph_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    return t.read(spark, sf_dir, "documents").select("doc_id", x.paragraphs_clipped(parts, 20).alias("clipped"), x.mostly_cyrillic(parts).alias("cyrillic"))


@query("""select doc_id, case when starts_with(title, '🏁') then title when title = '' then title when regexp_matches(lower(title), 'the') then '📰 ' || title when regexp_matches(lower(title), 'der') then '🚗 ' || title else '🔹 ' || title end title
from (select doc_id, string_split(coalesce(text, ''), chr(10))[1] title from documents)""")
def titled_with_emoji(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0))
    return t.read(spark, sf_dir, "documents").select("doc_id", x.leading_emoji(title, ["🏁"], [("the", "📰"), ("der", "🚗")], "🔹").alias("title"))


@query(f"""with {t.PENDING} select case when hold_reason is not null then 'held' when publish_after > {N} then 'deferred' else 'publishable' end verdict, count(*)::bigint n from pending group by 1""")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.verdict_counts(t.pending(spark, sf_dir).select(q.queue_state(t.now()).alias("verdict")))


@query("select l_orderkey, l_linenumber, least(case when l_quantity > 25 then l_quantity end, case when l_discount > 0.03 then l_tax * 1000 end) credits from lineitem")
def remaining_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = r.remaining_credits(F.when(F.col("l_quantity") > 25, F.col("l_quantity")), F.when(F.col("l_discount") > 0.03, F.col("l_tax") * 1000))
    return t.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", left.alias("credits"))


@query("""select conv_id, turn, regexp_replace(regexp_replace(trim('```json ' || coalesce(text, '') || '```', ' '), '^```(?:json)?\\s*', ''), '\\s*```$', '') body,
  case when length(coalesce(text, '')) > 30 then left(coalesce(text, ''), 30) || '…' else coalesce(text, '') end error from conversations""")
def response_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```json "), F.coalesce("text", F.lit("")), F.lit("```"))
    return t.read(spark, sf_dir, "conversations").select("conv_id", "turn", x.unfenced(fenced).alias("body"), x.safe_error(F.col("text"), limit=30).alias("error"))


@query("""select o_orderkey link, o_orderdate::timestamp ts from orders""")
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("link"), temporal.parsed_time(written).cast("timestamp_ntz").alias("ts"))
