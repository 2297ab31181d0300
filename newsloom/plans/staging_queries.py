"""Queries of what follows from verdicts, of alert texts and of translated block strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import classify as c
from newsloom.operators import dedup as d
from newsloom.operators import render
from newsloom.operators import staging as st
from newsloom.plans import content_queries as cq
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


@query()
def sequential_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in English arrive by id; the others are stored already."""
    rows = cq._fingerprinted(spark, sf_dir)
    new = F.coalesce(F.col("lang") == "en", F.lit(False))
    stored = rows.where(~new).drop("lang")
    articles = rows.where(new).drop("lang").withColumn("ordinal", F.col("link"))
    out = d.in_tick(articles, d.candidate_set(stored.limit(0), stored, t.now()), t.now())
    return out.withColumn("evidence", F.array_join("evidence", ";")).withColumn("rejected_series", F.array_join("rejected_series", ";"))


@query("""select page_id, case when contains(h, 'example.org') then 'next_data' when contains(h, 'example') then 'html' when contains(h, '.net') then 'feed' end parser
from (select page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1)) h from pages)""")
def page_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsers = [("example.org", "next_data"), ("example", "html"), (".net", "feed")]
    return t.read(spark, sf_dir, "pages").select("page_id", st.parser_of(F.col("url"), parsers).alias("parser"))


ORDERS_JUDGED = """g as (select o_orderkey link, o_orderpriority title, case o_orderstatus when 'F' then 'held_for_review' when 'P' then 'genre' else 'staged' end outcome,
  case when o_orderstatus = 'F' and o_custkey % 2 = 0 then 'a, b' end reason,
  case o_orderpriority when '1-URGENT' then 'block' when '2-HIGH' then 'flag' when '3-MEDIUM' then 'pass' end decision from orders)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.read(spark, sf_dir, "orders").withColumn("link", F.col("o_orderkey"))
    outcome = F.when(F.col("o_orderstatus") == "F", F.lit("held_for_review")).when(F.col("o_orderstatus") == "P", F.lit("genre")).otherwise(F.lit("staged"))
    markers = F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    gated = rows.select("link", F.col("o_orderpriority").alias("title"), outcome.alias("outcome"), markers.alias("markers"))
    decisions = F.create_map(*[F.lit(v) for v in ("1-URGENT", "block", "2-HIGH", "flag", "3-MEDIUM", "pass")])
    decided = rows.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
    return st.with_duplicates(gated, decided.select("link", decisions[F.col("o_orderpriority")].alias("decision"), (-F.col("link")).alias("match")))


@query(f"""with {ORDERS_JUDGED} select link, title, case when decision = 'flag' then timestamp '{t.NOW}' + interval 24 hour end publish_after, reason hold_reason
from g where outcome <> 'genre' and coalesce(decision, 'pass') <> 'block'""")
def staged_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.effects(_judged(spark, sf_dir), t.now())[0]


@query(f"with {ORDERS_JUDGED} select link, title, -link \"match\" from g where outcome <> 'genre' and decision = 'block'")
def duplicate_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.effects(_judged(spark, sf_dir), t.now())[1]


@query("""select event_id link, case when event_type = 'signup' then 'skipped' when event_type = 'error' then 'error' when event_type = 'view' then 'unreachable' else 'updated' end outcome,
  case event_type when 'signup' then '{"pairs": []}' when 'error' then null when 'view' then null else '{"pairs": [], "user": ' || user_id || '}' end fingerprint from events""")
def fingerprint_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, kind = t.read(spark, sf_dir, "events"), F.col("event_type")
    rows = events.select(F.col("event_id").alias("link"), F.when(kind == "signup", F.lit('{"pairs": []}')).alias("fingerprint"))
    body = F.when(kind == "view", F.array().cast("array<string>")).otherwise(F.array("event_type"))
    found = F.concat(F.lit('{"pairs": [], "user": '), F.col("user_id").cast("string"), F.lit("}"))
    return st.backfill(rows, events.select(F.col("event_id").alias("link"), (kind == "error").alias("failed"), body.alias("paragraphs"), found.alias("found")))


@query("""select doc_id, case when text is null then 'None' when length(text) > 200 then left(text, 200) || '…' else text end title,
  case when lang is null and source is null then '—' else concat_ws(', ', lang, source) end markers,
  case when lang is null then '' else coalesce(source, '') end pair from documents""")
def alert_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = F.filter(F.array("lang", "source"), lambda m: m.isNotNull())
    pair = F.when(F.col("lang").isNull(), F.lit("*||B")).otherwise(F.concat(F.lit("*|"), F.coalesce("source", F.lit("")), F.lit("|D")))
    return t.read(spark, sf_dir, "documents").select("doc_id", st.alert_title(F.col("text")).alias("title"), st.alert_markers(markers).alias("markers"), st.pair_labels(F.array(pair)).alias("pair"))


@query(r"""select conv_id, turn, case when regexp_matches(coalesce(text, ''), '\S') then case when role = 'user' then 2 else 1 end else 0 end::int n,
  case when role = 'user' and regexp_matches(coalesce(text, ''), '\S') then 'T:' || text else text end text,
  case when regexp_matches(coalesce(text, ''), '\S') then 'C:' || text else text end caption from conversations""")
def translated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", F.lit("image")).otherwise(F.lit("paragraph"))
    blocks = F.array(F.struct(kind.alias("type"), F.col("text"), F.col("text").alias("caption")))
    df = t.read(spark, sf_dir, "conversations").withColumn("blocks", blocks)
    df = df.withColumn("strings", st.block_strings(F.col("blocks")))
    answers = F.transform("strings", lambda s: F.concat(F.when(s["field"] == "text", F.lit("T:")).otherwise(F.lit("C:")), s["text"]))
    done = st.spliced(F.col("blocks"), F.col("strings"), answers)[0]
    return df.select("conv_id", "turn", F.size("strings").alias("n"), done["text"].alias("text"), done["caption"].alias("caption"))


@query("""select doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), '^ | $', '', 'g') body from documents""")
def plug_free_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invented prose advertises nothing: an article and a plug in a second block leave the article alone."""
    block = lambda text: F.struct(F.lit("paragraph").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("caption"))
    blocks = F.array(block(F.coalesce("text", F.lit(""))), block(F.lit("(follow me on Instagram @someone)")))
    left = c.blocks_without_plugs(blocks)
    return t.read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(left, lambda b: b["text"]), "").alias("body"))


@query("""select conv_id, turn, '{"source_name": "' || role || '", "title": null, "subtitle": null, "paragraphs": ' ||
  case when text is null then '[]' else '["x", "**y** z"]' end || '}' message from conversations""")
def user_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = F.lit('[{"type": "lead"}, {"type": "image"}, {"type": "paragraph", "runs": [{"text": "y", "formats": ["bold"]}]}]')
    paragraphs = st.json_or_null(F.when(F.col("text").isNotNull(), F.array(F.lit("x"), F.lit("y z"))))
    none = F.lit(None).cast("string")
    return t.read(spark, sf_dir, "conversations").select("conv_id", "turn", render.user_message("role", none, none, paragraphs, blocks).alias("message"))
