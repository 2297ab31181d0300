"""Queries of text, URL, time and comparison functions over the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import temporal
from newsloom.functions import text as x
from newsloom.functions import urls as u
from newsloom.operators import entities as e
from newsloom.operators import intake as i
from newsloom.plans import tables as t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(r"""with h as (select doc_id, '<p>' || replace(coalesce(text, ''), '. ', '.' || chr(10) || ' ' || chr(10)) || '</p>&lt;b&gt; &amp; <a href="x">(Continue reading)</a>' h from documents),
p as (select doc_id, string_split_regex(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(h, '(?is)<a\b[^>]*>\s*\(?continue reading\)?.*?</a>', '', 'g'), '(?s)<[^>]+>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\n\s*\n') p from h)
select doc_id, list_filter(list_transform(p, lambda z: trim(z)), lambda z: z <> '') paragraphs from p""")
def summary_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<p>"), F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n \n")), F.lit('</p>&lt;b&gt; &amp; <a href="x">(Continue reading)</a>'))
    return t.read(spark, sf_dir, "documents").select("doc_id", x.plain_paragraphs(html).alias("paragraphs"))


@query(r"""with s as (select conv_id, turn, text, regexp_replace(trim(regexp_replace(regexp_replace(chr(1) || coalesce(text, '') || chr(9) || case when turn % 2 = 0 then 'sk-' || repeat('k', 20) else '' end, '\p{C}', ' ', 'g'), '\s+', ' ', 'g')), 'sk-k{20}', '***') line from conversations)
select conv_id, turn, case when length(text) + 2 + case when turn % 2 = 0 then 23 else 0 end > 2048 then '<oversized>' when line = '' then '<unknown>' when length(line) > 60 then left(line, 59) || '…' else line end diagnostic from s""")
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("\x01"), F.coalesce("text", F.lit("")), F.lit("\t"), F.when(F.col("turn") % 2 == 0, F.lit("sk-" + "k" * 20)).otherwise(F.lit("")))
    return t.read(spark, sf_dir, "conversations").select("conv_id", "turn", x.diagnostic(said, 60).alias("diagnostic"))


@query(r"""select doc_id, left(regexp_replace(regexp_replace(chr(7) || chr(8203) || coalesce(text, ''), '[\x00-\x1f\x7f]', '', 'g'), '[\p{C}\x{2028}\x{2029}]', '?', 'g'), 200) line from documents""")
def printable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.read(spark, sf_dir, "documents").select("doc_id", x.printable(F.concat(F.lit("\x07​"), F.coalesce("text", F.lit("")))).alias("line"))


@query("""with v as (select page_id, 'vid' || lpad(page_id::varchar, 8, '0') v, page_id % 6 k from pages)
select page_id, case when k in (0, 1, 3) then '/embed/youtube?url=' || url_encode('https://www.youtube.com/watch?v=' || v) when k = 2 then '/embed/vimeo?url=' || url_encode('https://vimeo.com/' || (100000 + page_id)) end embed from v""")
def embedded_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    video = F.concat(F.lit("vid"), F.lpad(F.col("page_id").cast("string"), 8, "0"))
    shapes = F.array(
        F.concat(F.lit("https://www.youtube.com/watch?v="), video, F.lit("&t=3")),
        F.concat(F.lit("https://youtu.be/"), video),
        F.concat(F.lit("https://player.vimeo.com/video/"), (F.col("page_id") + 100000).cast("string")),
        F.concat(F.lit("https://www.youtube-nocookie.com/embed/"), video),
        F.concat(F.lit("https://evil.example/watch?v="), video),
        F.col("url"),
    )
    return t.read(spark, sf_dir, "pages").select("page_id", u.embed_url(F.get(shapes, (F.col("page_id") % 6).cast("int"))).alias("embed"))


@query("""with e as (select event_id, (event_id % 5)::int n, ((event_id % 47) * 17)::double mins from events),
i as (select *, greatest(case when n <> 0 then mins / n end, 90.0) interval_ from e),
c as (select *, case when n <= 0 or mins <= 0 then 0 else least(n, floor(mins / interval_)::int + 1) end k from i)
select event_id, k::int slots, case when k > 0 then floor((k - 1) * interval_ * 60)::bigint end last_second, (n - k)::int carry from c""")
def spread_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    end = now + F.make_dt_interval(F.lit(0), F.lit(0), ((F.col("event_id") % 47) * 17).cast("int"))
    found = t.read(spark, sf_dir, "events").select("event_id", temporal.even_slots(now, end, (F.col("event_id") % 5).cast("int")).alias("s"))
    last = F.when(F.size("s.slots") > 0, F.unix_timestamp(F.get("s.slots", F.size("s.slots") - 1)) - F.unix_timestamp(now))
    return found.select("event_id", F.size("s.slots").alias("slots"), last.alias("last_second"), F.col("s.carry").alias("carry"))


@query("""with e as (select event_id, ts, ts + to_hours((event_id % 72)::int) + interval 3 hour clock from events where ts is not null),
a as (select *, date_diff('day', ts::date, clock::date) age from e)
select event_id, case when age = 0 then 'fresh' when age >= 2 then 'stale' when age = 1 and hour(clock) >= 21 then 'stale' else 'inconclusive' end verdict from a""")
def publication_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("some-title-"), F.date_format("ts", "MM-dd"), F.when(F.col("event_id") % 2 == 0, F.lit("-2")).otherwise(F.lit("")))
    now = F.col("ts").cast("timestamp") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 72).cast("int"))
    return t.read(spark, sf_dir, "events").where("ts is not null").select("event_id", temporal.page_freshness(path, now).alias("verdict"))


NAMES = [["a", "b", "c", "d"], ["c", "b", "e", "a"], ["p|s|D", "q|s|B", "r|s|B"], ["r|s|B", "q|s|B", "p|s|D"]]


@query(f"""with s as (select event_id, {NAMES[0]}[:event_id % 5] sa, {NAMES[1]}[:user_id % 5] sb, {NAMES[0]}[:event_id % 3] ba, {NAMES[1]}[:user_id % 4] bb, {NAMES[2]}[:event_id % 4] pa, {NAMES[3]}[:user_id % 4] pb from events),
j as (select *, case when len(sa) = 0 or len(sb) = 0 then 0.0 else len(list_intersect(sa, sb))::double / len(list_distinct(list_concat(sa, sb))) end m,
  case when len(ba) = 0 or len(bb) = 0 then 0.0 else len(list_intersect(ba, bb))::double / len(list_distinct(list_concat(ba, bb))) end b, list_sort(list_intersect(pa, pb)) shared from s)
select event_id, case when len(sa) = 0 or len(sb) = 0 then 0.0 when len(sa) <= 1 or len(sb) <= 1 or len(ba) < 2 or len(bb) < 2 then m else greatest(m, b) end similarity,
  array_to_string(shared, ';') shared, len(shared) > 0 any_shared, list_contains(shared, 'p|s|D') any_distinctive from j""")
def fingerprint_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda names, n: F.slice(F.array(*map(F.lit, names)), F.lit(1), n.cast("int"))
    ev, us = F.col("event_id"), F.col("user_id")
    rows = t.read(spark, sf_dir, "events").select(
        "event_id",
        F.struct(first(NAMES[0], ev % 5).alias("strict"), first(NAMES[0], ev % 3).alias("brands"), first(NAMES[2], ev % 4).alias("pairs")).alias("a"),
        F.struct(first(NAMES[1], us % 5).alias("strict"), first(NAMES[1], us % 4).alias("brands"), first(NAMES[3], us % 4).alias("pairs")).alias("b"),
    )
    rows = rows.select("event_id", e.similarity(F.col("a"), F.col("b")).alias("similarity"), e.shared_pairs(F.col("a"), F.col("b")).alias("s"))
    return rows.select("event_id", "similarity", F.array_join("s.pairs", ";").alias("shared"), F.col("s.any_shared"), F.col("s.any_distinctive"))


def _answer(**changed) -> str:
    return json.dumps({"title": "T", "title_alternatives": ["a", "b"], "subtitle": "", "paragraphs": ["x" * 20, "y" * 20]} | changed)


#: An answer for each verdict, to an article of two structured paragraphs.
ANSWERS = {
    "not an object": "[1]", "no title": _answer(title=" "), "alternatives": _answer(title_alternatives=["a"]), "no subtitle": _answer(subtitle=None), "no paragraphs": _answer(paragraphs="x"),
    "count": _answer(paragraphs=["x" * 50]), "blank paragraph": _answer(paragraphs=["x" * 50, " "]), "too short": _answer(paragraphs=["x", "y"]), "ok": _answer(),
}


@query(f"select event_id, {list(ANSWERS)!r}[event_id % {len(ANSWERS)} + 1] verdict from events")
def translation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each branch of the rules, dealt to the events."""
    body = F.get(F.array(*map(F.lit, ANSWERS.values())), (F.col("event_id") % len(ANSWERS)).cast("int"))
    return t.read(spark, sf_dir, "events").select("event_id", i.translation_verdict(body, F.lit(2), F.lit(True)).alias("verdict"))


@query("""select doc_id, case when text is null then 0 when doc_id % 3 = 0 then len(list_filter(string_split(text, chr(10)), lambda l: length(l) % 2 = 0)) else len(string_split(text, chr(10))) end::int n from documents""")
def paragraph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks, those of odd length as images, for every third document; as paragraphs for the others."""
    lines = F.split("text", "\n")
    kind = lambda s: F.when(F.char_length(s) % 2 == 0, F.lit("paragraph")).otherwise(F.lit("image"))
    blocks = F.when((F.col("doc_id") % 3 == 0) & F.col("text").isNotNull(), F.transform(lines, lambda s: F.struct(kind(s).alias("type"), s.alias("text"))))
    return t.read(spark, sf_dir, "documents").select("doc_id", i.paragraph_count(blocks, lines).alias("n"))


@query("""with f as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 position from events),
h as (select * from f where position < 5)
select user_id, count(*)::int n, bool_and(event_id % 11 <> 0) whole from h group by user_id""")
def feed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first feeds of each list, and whether all of its addresses are sound."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    url = F.when(F.col("event_id") % 11 == 0, F.lit("ftp://x")).otherwise(F.concat(F.lit("https://example.org/"), F.col("event_id").cast("string")))
    feeds = t.read(spark, sf_dir, "events").select("user_id", place.alias("position"), url.alias("url"))
    return i.sound_lists(feeds, ["user_id"]).select("user_id", "n", "whole")
