"""Queries of text, URL, classification, fingerprint, dedup and state operators over the driver's tables.

The invented prose holds none of the domain's words, so these queries give the
operators marker sets of words that occur in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as x
from newsloom.functions import urls as u
from newsloom.operators import classify as c
from newsloom.operators import dedup as d
from newsloom.operators import entities as e
from newsloom.operators import intake as i
from newsloom.operators import reports as r
from newsloom.operators import state as s
from newsloom.operators import storage
from newsloom.plans import tables as t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


FOLD = "' ' || array_to_string(regexp_extract_all(lower(strip_accents({0})), '[a-z0-9]+'), ' ') || ' '"


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.articles(spark, sf_dir).withColumn("url", F.concat(F.lit("https://example.org/"), F.col("lang"), F.lit("/"), F.col("link").cast("string")))


# ---------------------------------------------------------------- text


@query(f"""with {t.ARTICLES}
select link, {FOLD.format('title')} folded, regexp_replace(title, '\\s+', '', 'g') bare, length(array_to_string(list_filter(list_concat([title], paragraphs), lambda p: p <> ''), chr(10)))::int joined,
  case when length(title) > 40 then left(title, 40) || '…' else title end clipped, coalesce(list_sum(list_transform(paragraphs, lambda p: length(p))), 0)::bigint body
from articles""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.col("title")
    return t.articles(spark, sf_dir).select(
        "link",
        x.folded(title).alias("folded"),
        x.without_space(title).alias("bare"),
        F.char_length(x.joined_text(title, F.lit(None).cast("string"), F.col("paragraphs"))).alias("joined"),
        x.clipped(title, 40).alias("clipped"),
        x.total_length(F.col("paragraphs")).alias("body"),
    )


@query("""with x as (select doc_id, text, regexp_replace(coalesce(text, ''), '(?i)sk-[A-Za-z0-9_-]{16,}', '***', 'g') r from documents)
select doc_id, regexp_matches(coalesce(text, ''), '\\p{Cyrillic}') cyrillic, length(r)::int n from x""")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    share = F.coalesce(x.cyrillic_share(F.array(text)), F.lit(0.0))
    return t.read(spark, sf_dir, "documents").select("doc_id", (share > 0).alias("cyrillic"), F.char_length(x.redacted(text)).alias("n"))


@query("""select page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) host,
  '#' || coalesce(string_split(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\\.', ''), '.')[-2], '') hashtag,
  case when lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) = 'tionsh.example.net' then 'tionsh' else 'other' end source,
  lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) in ('tionsh.example.net', 'thnd.example.com') allowed,
  ends_with(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '.example.org') or lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) = 'example.org' under,
  regexp_replace(split_part(url, '?', 1), '=s\\d+(?:-c)?$', '') image_key,
  string_split(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/+$', ''), '/')[-1] slug from pages""")
def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return t.read(spark, sf_dir, "pages").select(
        "page_id",
        u.host(url).alias("host"),
        u.hashtag(url).alias("hashtag"),
        u.source_name(url, {"tionsh.example.net": "tionsh"}).alias("source"),
        u.allowed_host(url, ["tionsh.example.net", "thnd.example.com"]).alias("allowed"),
        u.under_host(url, ["example.org"]).alias("under"),
        u.image_key(url).alias("image_key"),
        u.slug(url).alias("slug"),
    )


# ---------------------------------------------------------------- classifiers

LONG, SHORT = [r"^licensed\s+under\b"], [r"^released\b", r"^\w+\.$"]


@query(f"""with {t.ARTICLES}, p as (select link, unnest(paragraphs) p from articles),
b as (select link, trim(p, ' ' || chr(9) || chr(10) || chr(13)) s from p)
select a.link, coalesce(n, 0)::int dropped from articles a left join (
  select link, count_if(s <> '' and (regexp_matches(s, '(?i)^licensed\\s+under\\b') or (length(s) <= 120 and (regexp_matches(s, '(?i)^released\\b') or regexp_matches(s, '(?i)^[\\p{{L}}\\p{{N}}_]+\\.$'))))) n
  from b group by 1) using (link)""")
def boilerplate_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = c.without_boilerplate(F.col("paragraphs"), long=LONG, short=SHORT)
    return t.articles(spark, sf_dir).select("link", (F.size("paragraphs") - F.size(kept)).alias("dropped"))


RELEVANCE = c.Relevance(title_terms=("the",), sibling_labels=("src1", "src2"), series_labels=("src3",), sibling_title=("der",), series_title=("que",), broad_hosts=("/fr/",))


@query(f"""with {t.ARTICLES}
select link, case when contains(lower(title), 'the') then true when source_name in ('src1', 'src2') then false when source_name = 'src3' then true
  when contains(lower(title), 'der') then false when contains(lower(title), 'que') then true when lang = 'fr' then false else true end relevant from articles""")
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).select("link", c.relevant(F.col("title"), F.array("source_name"), F.col("url"), RELEVANCE).alias("relevant"))


PROMO = c.Promo(direct=("in the", "it is"), offer=("on the", "de la"), seller=("of the", "par le"), weak=("the", "la"), url_tokens=("fr",))
SUBJECTS = c.Subjects(hold=("was", "und"), video=("the", "les", "der"), lead_only=("thing",), review=("and", "die"), verbs=("it",), heads=("of", "que"), event=("que", "la"), organisation=("de", "en"))


def _has(column: str, *words: str) -> str:
    return " + ".join(f"contains({column}, ' {w} ')::int" for w in words)


@query(f"""with {t.ARTICLES}, f as (
  select *, {FOLD.format('left(title, 2000)')} t, lower(strip_accents(left(title, 2000))) q,
    {FOLD.format("left(title, 2000) || ' ' || left(array_to_string(paragraphs[1:8], ' '), 2000)")} p from articles),
m as (select *, {_has('p', 'in the', 'it is')} d, {_has('p', 'on the', 'de la')} o, {_has('p', 'of the', 'par le')} s,
  {_has('t', 'was', 'und')} h, {_has('t', 'the', 'les', 'der')} v, {_has('t', 'and', 'die')} w, {_has('t', 'it')} k,
  {_has('t', 'que', 'la')} e, {_has('t', 'de', 'en')} g, coalesce(list_sum(list_transform(paragraphs, lambda z: length(z))), 0) n from f),
b as (select *, case when regexp_matches(q, '^\\s*(thing|the|les|der)\\s*[:\\-–—]') then 'video_lead'
  when regexp_matches(q, '^\\s*(the|les|der)\\s+(?:of|que)\\b') and k = 0 then 'video_np'
  when v > 0 and (w > 0 or v >= 2) then 'video_signals' when e > 0 and g > 0 then 'event' end b from m),
r as (select *, case when regexp_matches(title, '(?i)\\bcheck[\\s-]?list\\b') and n < 500 then 'checklist' when (s > 0 and (d > 0 or d + o >= 2)) or d + o >= 3 then 'promo'
  when h > 0 then 'held_for_review' when b in ('video_lead', 'event') then 'genre' when b is not null then 'held_for_review' else 'staged' end outcome from b)
select link, source_name, outcome, case when outcome in ('genre', 'held_for_review') and h = 0 then b end branch from r""")
def gate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the paths of these URLs hold only a language and a number
    return c.gate(_articles(spark, sf_dir).withColumn("url", F.lit("https://example.org/")), PROMO, SUBJECTS).select("link", "source_name", "outcome", "branch")


@query(f"""with g as ({SQL['gate_outcomes']})
select source_name, count(*)::bigint seen, count_if(outcome = 'promo')::bigint promo, count_if(outcome = 'genre')::bigint genre,
  count_if(outcome = 'staged')::bigint staged, count_if(outcome = 'held_for_review')::bigint held_for_review, count_if(outcome in ('promo', 'genre', 'checklist'))::bigint dropped,
  case when count_if(outcome = 'staged') > 0 then '' when count_if(outcome in ('promo', 'genre', 'checklist')) = 0 then 'nothing new'
    when count_if(outcome = 'checklist') >= greatest(count_if(outcome = 'promo'), count_if(outcome = 'genre')) then 'checklist'
    when count_if(outcome = 'promo') >= count_if(outcome = 'genre') then 'promo' else 'genre' end note from g group by 1""")
def intake_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = r.collapse_note(r.funnel(gate_outcomes(spark, sf_dir), ["source_name"]))
    return out.select("source_name", "seen", "promo", "genre", "staged", "held_for_review", F.col("dropped").cast("long").alias("dropped"), "note")


@query(f"""with {t.ARTICLES}, e as (select link, link arrival, title from articles union all select link, link + 1000000000, title from articles)
select link, min(arrival) arrival from e where contains(lower(title), 'the') and link not in (select doc_id from labels where quality = 1)
  and link not in (select doc_id from labels where toxic = 1) group by 1""")
def new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every article arrives twice; the labelled ones stand in the two ledgers
    rows = t.articles(spark, sf_dir).select("link", F.col("link").alias("arrival"), "title")
    entries = rows.unionByName(rows.withColumn("arrival", F.col("arrival") + 1_000_000_000))
    labels = t.read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "link")
    keep = F.contains(F.lower("title"), F.lit("the"))
    return i.new_entries(entries, labels.where("quality = 1").select("link"), labels.where("toxic = 1").select("link"), keep).select("link", "arrival")


@query("""with c as (select conv_id, list(struct_pack(role := role, text := text) order by turn) b from conversations group by 1),
k as (select *, list_filter(b, lambda x: x.role = 'user' and trim(x.text) <> '') p, list_filter(list_transform(b, lambda x: case when x.role = 'assistant' then x.text end), lambda x: x is not null) tr from c)
select conv_id, len(p)::int n, (len(p) = 0 or len(p) = len(tr)) aligned, len(p) = len(tr) patched from k""")
def translation_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    conv = t.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("b"))
    blocks = F.transform("b", lambda y: F.struct(F.when(y["role"] == "user", F.lit("paragraph")).otherwise(F.lit("image")).alias("type"), y["text"].alias("text")))
    translated = F.transform(F.filter("b", lambda y: y["role"] == "assistant"), lambda y: y["text"])
    df = conv.select("conv_id", blocks.alias("blocks"), translated.alias("tr"))
    return df.select(
        "conv_id",
        F.size(F.filter("blocks", i.patchable)).alias("n"),
        i.aligned_blocks(F.col("blocks"), F.col("tr")).isNotNull().alias("aligned"),
        i.patched_texts(F.col("blocks"), F.col("tr")).isNotNull().alias("patched"),
    )


@query("""select conv_id, turn, case when (turn * 100 + 400) in (401, 402, 403, 404, 407, 408, 409, 429) or turn * 100 + 400 between 500 and 599 then 'outage' else 'article' end cls from conversations""")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.read(spark, sf_dir, "conversations").select("conv_id", "turn", i.error_class(F.col("turn") * 100 + 400).alias("cls"))


# ---------------------------------------------------------------- fingerprints and duplicates

LEXICON = e.Lexicon(
    brands=("licensed", "released", "worthless", "kindness"),
    aliases={"pathetic": "worthless"},
    cased_brands=("GNU",),
    series={"license": ("license", "distinctive"), "apache license": ("apache", "distinctive"), "public license": ("public license", "broad"), "mit": ("mit", "broad")},
    capitals=("mit",),
    recurring=("mit",),
)


def _fingerprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = x.joined_text(F.col("title"), F.lit(None).cast("string"), F.col("paragraphs"))
    rows = t.articles(spark, sf_dir).withColumn("fp", e.fingerprint(LEXICON)(text)).withColumn("ts", t.now() - F.make_dt_interval((F.col("link") % 40).cast("int")))
    return d.with_subjects(rows.select("link", "source_name", "title", "ts", "fp", "lang"), LEXICON)


@query()
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fingerprinted(spark, sf_dir).select("link", *[F.array_join(f"fp.{n}", ";").alias(n) for n in ("strict", "brands", "series", "pairs")])


@query()
def dedup_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = storage.kept(_fingerprinted(spark, sf_dir))
    # every document is judged against every other; those in English play the queue, the others the ledger
    new = rows.withColumn("ordinal", F.lit(None).cast("struct<branch:int,ts:timestamp_ntz,link:bigint>"))
    pending = F.coalesce(F.col("lang") == "en", F.lit(False))
    candidates = d.candidate_set(rows.where(pending), rows.where(~pending), t.now())
    return d.verdicts(new.drop("lang"), candidates.drop("lang"), t.now()).withColumn("evidence", F.array_join("evidence", ";")).withColumn("rejected_series", F.array_join("rejected_series", ";"))


# ---------------------------------------------------------------- state machines


def _machine_events(spark: SparkSession, sf_dir: str, kinds: dict[str, str]) -> DataFrame:
    kind = F.create_map(*[F.lit(v) for kv in kinds.items() for v in kv])[F.col("event_type")]
    return t.read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), F.coalesce(kind, F.lit("other")).alias("kind"))


@query("""with e as (select user_id key, ts, event_id seq from events where event_type = 'error')
select key, seq, row_number() over (partition by key, ts::date order by ts, seq) = 1 sent from e""")
def once_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.once_per_day(_machine_events(spark, sf_dir, {"error": "ping"}).where("kind = 'ping'")).select("key", "seq", "sent")


@query("""with e as (select user_id key, ts, event_type = 'purchase' ok, event_type = 'error' bad from events where event_type in ('purchase', 'error')),
l as (select key, max(case when ok then ts end) last from e group by 1)
select key, count(distinct ts::date)::bigint as days, count(distinct ts::date) >= 3 retired from e join l using (key) where bad and (last is null or ts > last) group by 1""")
def failing_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _machine_events(spark, sf_dir, {"error": "bad", "purchase": "ok"}).where("kind <> 'other'")
    return s.failing_streaks(rows.select("key", "ts", (F.col("kind") == "ok").alias("ok")))


def _numbered(kinds: dict[str, str]) -> str:
    """SQL of the events e (key, ts, seq, kind, rn, grp) of a machine: rn counts a key's events, grp the successes before each."""
    cases = " ".join(f"when '{a}' then '{b}'" for a, b in kinds.items())
    good = ", ".join(f"'{b}'" for b in sorted(set(kinds.values()) & {"recovery", "published", "ok"}) or ["none"])
    return f"""k as (select user_id as key, ts, event_id seq, case event_type {cases} end kind from events where ts is not null),
    n as (select *, row_number() over w rn, lag(kind) over w before, count_if(kind in ({good})) over w grp_after from k where kind is not null window w as (partition by key order by ts, seq)),
    e as (select *, grp_after - (kind in ({good}))::int grp from n)"""


def _stepped(kinds: dict[str, str], state: str, first: str, later: str, output: str) -> str:
    """SQL of a machine that goes event by event: the state's columns, their first and later values, and what is said."""
    return f"""with recursive {_numbered(kinds)}, r as (
      select key, ts, seq, rn, {first} from e where rn = 1
      union all select e.key, e.ts, e.seq, e.rn, {later} from r join e on e.key is not distinct from r.key and e.rn = r.rn + 1)
    select key, ts, seq, {output} "output" from (select key, ts, seq, {state} from r)"""


MACHINE_KINDS = {
    "outage": {"error": "outage", "purchase": "recovery"},
    "gap": {"error": "ping", "click": "ping"},
    "hold": {"error": "held", "purchase": "published"},
    "strike": {"error": "failed", "purchase": "ok"},
    "streak": {"error": "failed", "purchase": "ok"},
    "cooldown": {"error": "throttled", "view": "ok"},
}
MACHINE_OPTIONS = {"cooldown": {"limit": 2}}
MACHINE_SQL = {
    "outage": f"""with {_numbered(MACHINE_KINDS["outage"])},
      a as (select *, ts - min(ts) over (partition by key, grp) age, row_number() over (partition by key, grp order by ts, seq) n from e where kind = 'outage'),
      b as (select *, min(case when age >= interval 1 hour then n end) over (partition by key, grp) n2 from a),
      c as (select *, min(case when n > n2 and age >= interval 2 hour then n end) over (partition by key, grp) n3 from b)
      select key, ts, seq, case n when 1 then 'ping1' when n2 then 'ping2' else 'fallback' end "output" from c where n = 1 or n = n2 or n = n3
      union all select key, ts, seq, 'recovered' from e where kind = 'recovery' and before = 'outage'""",
    "gap": _stepped(MACHINE_KINDS["gap"], "sent, said", "ts sent, true said", "case when e.ts - r.sent < interval 1 hour then r.sent else e.ts end, e.ts - r.sent >= interval 1 hour", "case when said then 'sent' else 'suppressed' end"),
    "hold": f"""with {_numbered(MACHINE_KINDS["hold"])}, h as (select *, row_number() over (partition by key, grp order by ts, seq) n from e where kind = 'held')
      select key, ts, seq, case when max(n) over (partition by key order by ts, seq) >= 6 then 'deferred' else 'held' end "output" from h
      union all select key, ts, seq, 'published' from e where kind = 'published'""",
    "strike": f"""with {_numbered(MACHINE_KINDS["strike"])}
      select key, ts, seq, case when row_number() over (partition by key, grp order by ts, seq) >= 3 then 'dead' else 'retry' end "output" from e where kind = 'failed'
      union all select key, ts, seq, 'ok' from e where kind = 'ok'""",
    "streak": f"""with {_numbered(MACHINE_KINDS["streak"])}
      select key, ts, seq, case when dense_rank() over (partition by key, grp order by ts::date) >= 3 then 'retired' else 'failing' end "output" from e where kind = 'failed'
      union all select key, ts, seq, 'reset' from e where kind = 'ok' and before = 'failed'""",
    "cooldown": _stepped(
        MACHINE_KINDS["cooldown"], "said", "(kind = 'throttled')::int n, null::timestamp until, case when kind = 'throttled' then 'throttled' else 'ok' end said",
        """case when e.ts < r.until then r.n when e.kind <> 'throttled' or r.n + 1 >= 2 then 0 else r.n + 1 end,
        case when e.ts < r.until then r.until when e.kind = 'throttled' and r.n + 1 >= 2 then e.ts + interval 1 hour end,
        case when e.ts < r.until then 'paused' when e.kind <> 'throttled' then 'ok' when r.n + 1 >= 2 then 'pause' else 'throttled' end""",
        "said",
    ),
}


def _machine(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return s.fold(_machine_events(spark, sf_dir, MACHINE_KINDS[name]).where("kind <> 'other'"), s.MACHINES[name], **MACHINE_OPTIONS.get(name, {}))

    run.__name__ = f"machine_{name}"
    return run


for _name in MACHINE_KINDS:
    QUERIES[f"machine_{_name}"] = _machine(_name)
    SQL[f"machine_{_name}"] = MACHINE_SQL[_name]
