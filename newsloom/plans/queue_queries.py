"""Queries of the queue, its reports and time functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import temporal
from newsloom.operators import queue as q
from newsloom.operators import reports as r
from newsloom.plans import tables as t

QUERIES: dict = {}
SQL: dict[str, str] = {}
N = f"timestamp '{t.NOW}'"


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that must agree."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""with {t.PUBLISHED}
select source_name, sum(case when published_at > {N} - interval 30 day then 1 else 0 end)::bigint n, max(published_at) last_published,
  trunc(epoch({N} - max(published_at)) / 86400)::int age_days from published group by 1""")
def intake_source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.source_report(t.published(spark, sf_dir), t.now())


@query(f"""with {t.PUBLISHED}, rep as (
  select source_name found, sum(case when published_at > {N} - interval 30 day then 1 else 0 end) n,
    trunc(epoch({N} - max(published_at)) / 86400)::int age_days from published group by 1),
e(source) as (values ('src1'), ('src3'), ('src9'), ('rc')),
f as (select e.source, min(struct_pack(found := found, n := n, age := age_days)) x from e left join rep on contains(found, source) group by 1)
select source, x.found found, case when x.found is null then 'WARN' when x.n = 0 and x.age > 45 then 'INFO' when x.n = 0 then 'WARN' else 'OK' end severity
from f""")
def source_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.source_silence(["src1", "src3", "src9", "rc"], r.source_report(t.published(spark, sf_dir), t.now()))


@query(f"""with {t.PENDING}
select count_if(hold_reason is null and (publish_after is null or publish_after <= {N}))::bigint publishable,
  count_if(hold_reason is null and publish_after > {N})::bigint deferred, count_if(hold_reason is not null)::bigint held from pending""")
def backlog_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.backlog(t.pending(spark, sf_dir), t.now())


@query(f"""with {t.PENDING}
select link, case when hold_reason is not null then 'held' when publish_after > {N} then 'deferred' else 'publishable' end state,
  hold_reason is null and notified_at is null and fetched_at < {N} - interval 48 hour stale,
  hold_reason is null and coalesce(notified_at < {N} - interval 2 hour, false) and ru_paragraphs is null overdue,
  hold_reason is null and (publish_after is null or publish_after <= {N}) and ru_paragraphs is null evictable,
  fetched_at >= {N} - interval 30 day recent,
  greatest(0, floor(epoch({N} - fetched_at) / 3600))::bigint age_hours, trunc(epoch({N} - fetched_at) / 86400)::int age_days
from pending""")
def queue_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t.now()
    return t.pending(spark, sf_dir).select(
        "link",
        q.queue_state(n).alias("state"),
        q.stale(n).alias("stale"),
        q.overdue(n).alias("overdue"),
        q.evictable(n).alias("evictable"),
        q.recent("fetched_at", n, 30).alias("recent"),
        temporal.age_hours(F.col("fetched_at"), n).alias("age_hours"),
        temporal.julian_age_days(F.col("fetched_at"), n).alias("age_days"),
    )


@query(f"""with {t.PENDING} select link, fetched_at from pending where hold_reason is null and (publish_after is null or publish_after <= {N})
order by case when fetched_at::date = date '1998-08-02' then 0 else 1 end, fetched_at, link limit 1""")
def queue_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.head(t.pending(spark, sf_dir), t.now()).select("link", "fetched_at")


@query(f"""with {t.PENDING} select source_name, link,
  row_number() over (partition by source_name order by case when fetched_at::date = date '1998-08-02' then 0 else 1 end, fetched_at, link)::int queue_index
from pending""")
def queue_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.indexed(t.pending(spark, sf_dir), t.now(), per="source_name").select("source_name", "link", "queue_index")


@query(f"with {t.PENDING} select hold_reason, count(*)::bigint n from pending where hold_reason is not null group by 1")
def held_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.held_by_reason(t.pending(spark, sf_dir))


@query(f"with {t.PUBLISHED} select max(published_at) last_published, max(published_at) <= {N} - interval 2 day silent from published")
def last_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.dry_spell(t.published(spark, sf_dir), t.now())


@query(f"""with {t.PENDING} select link, title, failed_at from (select link, title, fetched_at failed_at from pending where attempt_count >= 3)
order by failed_at desc, link limit 3""")
def failed_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = t.pending(spark, sf_dir).where("attempt_count >= 3").select("link", "title", F.col("fetched_at").alias("failed_at"))
    return failed.orderBy(F.col("failed_at").desc(), "link").limit(3)


@query(f"""with {t.PENDING}, p as (select * from pending where hold_reason is not null)
select link, title, 'old' origin from p union all select link, title, 'new' from pending where link not in (select link from p)""")
def insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.pending(spark, sf_dir)
    target = rows.where(q.held()).select("link", "title", F.lit("old").alias("origin"))
    return q.insert_missing(target, rows.select("link", "title", F.lit("new").alias("origin")))


@query(f"""with {t.PENDING}
select link, case when attempt_count = 2 then {N} else notified_at end notified_at,
  case when hold_reason is null then attempt_count + 1 else attempt_count end::int attempt_count,
  case when h > 0 and h < 6 then 0 else h end::int hold_count,
  case when hold_reason = '1-URGENT' then null else hold_reason end hold_reason,
  case when publish_after < {N} then null else publish_after end publish_after
from (select *, case when hold_reason is not null then coalesce(hold_count, 0) + 1 else hold_count end h from pending)""")
def queue_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, rows = t.now(), t.pending(spark, sf_dir)
    rows = q.mark_notified(rows, F.col("attempt_count") == 2, n)
    rows = q.increment_attempt(rows, ~q.held())
    rows = q.reset_hold_counts(q.increment_hold(rows, q.held()))
    rows = q.clear_deferral(rows, F.col("publish_after") < n)
    rows = q.clear_hold(rows, F.col("hold_reason") == "1-URGENT")
    return rows.select("link", "notified_at", "attempt_count", "hold_count", "hold_reason", "publish_after")


@query(f"""with {t.PENDING}, c as (select link, 'new ' || title ru from pending where link % 7 = 0)
select p.link, coalesce(c.ru, p.title) title from pending p left join c using (link)""")
def update_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.pending(spark, sf_dir).select("link", "title")
    changes = rows.where("link % 7 = 0").withColumn("title", F.concat(F.lit("new "), F.col("title")))
    return q.update_by_key(rows, changes, ["title"])


@query(f"""with {t.PENDING}, {t.PUBLISHED}, d as (select link from pending where link % 5 = 0),
fresh as (select * from d where link not in (select link from published)),
moved as (select p.link, p.title, p.source_name, {N} published_at from fresh f join pending p using (link))
select 'pending' "table", link, title from pending where link not in (select link from d)
union all select 'published', link, title from published union all select 'published', link, title from moved
union all select 'processed', link, title from moved""")
def move_to_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending, published = t.pending(spark, sf_dir), t.published(spark, sf_dir)
    done = pending.where("link % 5 = 0").select("link", F.lit("https://pages.example/x").alias("telegraph_url"), F.lit(False).alias("via_review"))
    published = published.select(*published.columns, F.lit(None).cast("string").alias("telegraph_url"), F.lit(False).alias("via_review"))
    processed = spark.createDataFrame([], "link long, title string, processed_at timestamp_ntz")
    three = q.move_to_published(pending, published, processed, done, t.now())
    named = [x.select(F.lit(n).alias("table"), "link", "title") for n, x in zip(("pending", "published", "processed"), three, strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query(f"""with {t.PENDING} select 'pending' "table", link, null::varchar last_error, null::timestamp original_fetched_at from pending where attempt_count < 3
union all select 'failed', link, 'gave up', fetched_at from pending where attempt_count >= 3""")
def move_to_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = t.pending(spark, sf_dir)
    failed = spark.createDataFrame([], "link long, title string, source_name string, last_error string, failed_at timestamp_ntz, original_fetched_at timestamp_ntz")
    errors = pending.where("attempt_count >= 3").select("link", F.lit("gave up").alias("last_error"))
    left, gone = q.move_to_failed(pending, failed, errors, t.now())
    empty = [F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("timestamp_ntz").alias("original_fetched_at")]
    return left.select(F.lit("pending").alias("table"), "link", *empty).unionByName(gone.select(F.lit("failed").alias("table"), "link", "last_error", "original_fetched_at"))


@query("""with c as (select event_type || ':' || (user_id % 20) k, case when value > 80 then null else value::int::varchar end v, event_id seq from events),
l as (select k key, last(v order by seq) value from c group by 1) select key, value from l where value is not null""")
def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read(spark, sf_dir, "events")
    changes = e.select(
        F.concat_ws(":", "event_type", (F.col("user_id") % 20).cast("string")).alias("key"),
        F.when(F.col("value") <= 80, F.bround("value").cast("int").cast("string")).alias("value"),
        F.col("event_id").alias("seq"),
    )
    return q.upsert_latest(spark.createDataFrame([], "key string, value string"), changes)


@query("select event_type prefix, count(distinct user_id)::bigint n from events where event_type <> 'error' group by 1")
def state_key_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read(spark, sf_dir, "events")
    keys = e.select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key")).distinct()
    return r.state_keys(keys, excluded=("error",))


@query(f"""with {t.PENDING}, w as (
  select count_if(fetched_at >= {N} - interval 30 day) recent, count_if(fetched_at >= {N} - interval 30 day and ru_paragraphs is not null) w from pending)
select recent::bigint recent, w::bigint with_fingerprint,
  case when recent = 0 then 'WARN' when w = 0 then 'BAD' when w / recent < 0.5 then 'WARN' else 'OK' end severity from w""")
def dedup_warmth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.pending(spark, sf_dir).select(F.col("fetched_at").alias("ts"), F.col("ru_paragraphs").alias("fingerprint"))
    return r.dedup_warmth(rows, t.now())


@query("""with h as (select user_id, max(ts) last from events group by 1)
select user_id, case when epoch(timestamp '2024-01-30 12:00:00' - last) < 26 * 3600 then 'OK'
  when epoch(timestamp '2024-01-30 12:00:00' - last) < 50 * 3600 then 'WARN' else 'BAD' end severity from h""")
def heartbeat_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = t.read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.select("user_id", r.heartbeat(F.col("last"), t.now(t.EVENTS_NOW)).alias("severity"))


@query("""with e as (select event_type code, user_id, value::int % 30 link, event_id seq, row_number() over (partition by user_id order by event_id) place,
  count(*) over (partition by user_id) total from events),
k as (select user_id, total, code, link, count(*) n, min(place) f from e where place <= 60 group by all),
r as (select *, row_number() over (partition by user_id, code order by f) rk from k)
select user_id, total::bigint total, code, sum(n)::bigint events, count_if(rk <= 5)::bigint links, sum(case when rk > 5 then n else 0 end)::bigint overflow,
  string_agg(case when rk <= 5 then link || '×' || n end, ', ' order by rk) listing from r group by user_id, total, code""")
def bounded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read(spark, sf_dir, "events").select(
        "user_id", F.col("event_type").alias("code"), (F.bround("value").cast("int") % 30).alias("link"), F.col("event_id").alias("seq")
    )
    return r.bounded_events(e, ["user_id"], max_events=60, max_links=5)


@query("""with o as (select user_id, ts, event_id link, case event_type when 'purchase' then 'published' when 'view' then 'held' when 'click' then 'deferred'
  when 'error' then 'failed' else 'other' end outcome from events),
f as (select ts, link from o where outcome = 'failed' order by ts, link limit 5)
select count_if(outcome = 'published')::bigint published, count_if(outcome = 'held')::bigint held, count_if(outcome = 'deferred')::bigint deferred,
  count(distinct case when outcome = 'failed' then link end)::bigint failed, (select string_agg(link || ': ' || 'e' || link, chr(10) order by ts, link) from f) failures from o""")
def publish_recap(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"purchase": "published", "view": "held", "click": "deferred", "error": "failed"}
    outcome = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")], F.lit("other"))
    e = t.read(spark, sf_dir, "events").select("ts", F.col("event_id").alias("link"), outcome.alias("outcome"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error"))
    return r.publish_recap(e)


@query("""with s as (select o_orderkey link, o_orderdate + to_hours((o_orderkey % 24)::int) now, (o_orderkey % 5)::int - 1 n from orders),
c as (select *, list_filter([date_trunc('day', now) + interval 10 hour, date_trunc('day', now) + interval 15 hour, date_trunc('day', now) + interval 1170 minute],
  lambda x: x >= now - interval 5 minute) o from s)
select link, len(o[1:greatest(n, 0)])::int taken, (greatest(n, 0) - len(o[1:greatest(n, 0)]))::int carry, o[1:greatest(n, 0)][1] first_slot from c""")
def fixed_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    clock = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (key % 24).cast("int"))
    slots = temporal.fixed_slots(clock, (key % 5).cast("int") - 1)
    return t.read(spark, sf_dir, "orders").select(key.alias("link"), slots.alias("s")).select(
        "link", F.size("s.slots").alias("taken"), F.col("s.carry").alias("carry"), F.get("s.slots", F.lit(0)).alias("first_slot")
    )


@query("""select l_orderkey, l_linenumber, round_even(l_discount * 1250, 0)::int percent,
  greatest(1.0::double, least(120.0::double, coalesce(try_cast(case when l_linenumber = 3 then 'soon' else l_quantity::varchar end as double), 30.0::double))) wait from lineitem""")
def rounded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.when(F.col("l_linenumber") == 3, F.lit("soon")).otherwise(F.col("l_quantity").cast("string"))
    return t.read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", temporal.percent_half_even(F.col("l_discount") * 12.5).alias("percent"), temporal.retry_after(header).alias("wait")
    )


@query("""with h as (select user_id, count_if(event_type = 'error') bad, count(*) n from events group by 1),
s as (select user_id, case when bad * 4 > n then 'BAD' when bad * 5 > n then 'WARN' else 'OK' end severity from h)
select max(case severity when 'BAD' then 3 when 'WARN' then 2 else 0 end)::int exit_code from s""")
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = t.read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("bad"), F.count("*").alias("n"))
    return r.worst(h.select(F.when(F.col("bad") * 4 > F.col("n"), "BAD").when(F.col("bad") * 5 > F.col("n"), "WARN").otherwise("OK").alias("severity")))


@query("""with e as (select user_id, (ts::date) d from events where event_type = 'error' group by all)
select user_id, count(*)::bigint attempts, count(*) >= 3 retired from e group by 1""")
def fetch_failure_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = t.read(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", F.to_date("ts").alias("d")).distinct()
    return days.groupBy("user_id").agg(F.count("*").alias("attempts")).withColumn("retired", F.col("attempts") >= 3)


@query("""with c as (select conv_id, turn, role, case turn % 5 when 0 then 'dedup:keep:' when 1 then 'hold:approve:' when 2 then 'hold:reject:' when 3 then 'x:' else 'dedup:cancel:' end
  || left(text, (conv_id % 60)::int) p, conv_id % 3 u from conversations)
select conv_id, turn, case when u <> 1 then 'denied'
  when not (octet_length(encode(p)) <= 64 and len(string_split(p, ':')) = 3 and string_split(p, ':')[3] <> '') then 'malformed'
  when starts_with(p, 'dedup:keep') or starts_with(p, 'hold:approve') then 'publish' when starts_with(p, 'dedup:cancel') or starts_with(p, 'hold:reject') then 'retire'
  else 'malformed' end action from c""")
def operator_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn") % 5
    lead = F.when(turn == 0, "dedup:keep:").when(turn == 1, "hold:approve:").when(turn == 2, "hold:reject:").when(turn == 3, "x:").otherwise("dedup:cancel:")
    payload = F.concat(lead, F.expr("left(text, cast(conv_id % 60 as int))"))
    return t.read(spark, sf_dir, "conversations").select("conv_id", "turn", q.callback_action(payload, F.col("conv_id") % 3, [1]).alias("action"))
