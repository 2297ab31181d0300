"""What follows from verdicts, on fixtures with nulls, ties, empty tables and counts that differ."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators import classify as c
from newsloom.operators import dedup as d
from newsloom.operators import render
from newsloom.operators import staging as st
from tests.test_dedup_query import brute
from tests.test_domain_rules import rows

NOW = datetime(1998, 8, 2, 12)
TITLES = ["Toyota Supra Top Gun", "Top Gun Toyota Supra", "The Toyota Supra of Top Gun", "Jeep Wrangler", "Toyota Supra and Jeep Wrangler", "Jeep Wrangler, Ford Bronco and Toyota Supra", "Nothing here", "Ford Bronco 2024", "Ford Bronco 1999"]


def in_order(articles, stored):
    """Each article judged against what is stored and what earlier articles left staged."""
    staged, out = [], {}
    for a in sorted(articles, key=lambda r: r.link):
        seen = sorted(staged, key=lambda r: (r.ts, r.link)) + sorted(stored, key=lambda r: (r.ts, r.link))
        (decision, reason), match, evidence, pct, _ = brute(a, seen)
        out[a.link] = (decision, reason, match, evidence, pct)
        if decision != "block":
            staged.append(a)
    return out


def test_in_tick_applies_both_rules_in_order(spark):
    rng = random.Random(5)
    data = [(n, rng.choice("abc"), rng.choice(TITLES), NOW - timedelta(days=rng.choice([0, 3, 20])), "") for n in range(1, 61)]
    every = rows(spark, data)
    new, old = every.where("link <= 40"), every.where("link > 40")
    now = F.lit(str(NOW)).cast("timestamp_ntz")
    out = d.in_tick(new.withColumn("ordinal", F.col("link")), d.candidate_set(old.limit(0), old, now), now).collect()
    got = {r.link: (r.decision, r.reason, r.match, ";".join(r.evidence) if r.evidence is not None else None, r.overlap_pct) for r in out}
    assert got == in_order(new.collect(), old.collect())
    assert {"pair", "overlap"} <= {r.reason for r in out} and any(r.match and r.match <= 40 for r in out)


@pytest.mark.parametrize("group_size", [0, 40])
def test_in_tick_in_rounds_and_mixed(spark, group_size):
    rng = random.Random(6)
    data = [(n, rng.choice("abc"), rng.choice(TITLES), NOW - timedelta(days=rng.choice([0, 3, 20])), "") for n in range(1, 37)]
    every = rows(spark, data)
    new, old = every.where("link <= 26"), every.where("link > 26")
    now = F.lit(str(NOW)).cast("timestamp_ntz")
    out = d.in_tick(new.withColumn("ordinal", F.col("link")), d.candidate_set(old.limit(0), old, now), now, group_size).collect()
    got = {r.link: (r.decision, r.reason, r.match, ";".join(r.evidence) if r.evidence is not None else None, r.overlap_pct) for r in out}
    assert got == in_order(new.collect(), old.collect())


def test_in_tick_follows_a_long_chain(spark):
    """Neighbours share half of their phrases, so each article hangs on the one before it, which hangs on all before."""
    kind = "struct<strict:array<string>,brands:array<string>,series:array<string>,pairs:array<string>>"
    fp = lambda i: {"strict": [f"b m{i + k:03}" for k in range(3)], "brands": ["b"], "series": [], "pairs": []}
    data = [(i, f"s{i % 2}", " ".join(fp(i)["strict"]), NOW - timedelta(hours=1), fp(i), fp(i), i) for i in range(500)]
    df = spark.createDataFrame(data, f"link long, source_name string, title string, ts timestamp_ntz, fp {kind}, subject {kind}, ordinal long")
    now = F.lit(str(NOW)).cast("timestamp_ntz")
    out = {r.link: (r.decision, r.match) for r in d.in_tick(df, d.candidate_set(df.limit(0), df.limit(0), now), now).collect()}
    assert out == {i: ("block", i - 1) if i % 2 else ("pass", None) for i in range(500)}


@pytest.mark.parametrize("group_size", [0, 200_000])
def test_in_tick_of_many_copies(spark, monkeypatch, group_size):
    """A hundred copies see each other, as classes: neither a round nor a task goes over their pairs."""
    rng = random.Random(7)
    data = [(n, rng.choice("abc"), TITLES[n % 3 + 3 * (n % 5 == 0)], NOW - timedelta(days=rng.choice([0, 3])), "") for n in range(1, 121)]
    every = rows(spark, data)
    new, old = every.where("link <= 100"), every.where("link > 100")
    found, rounds, whole, seen = [], [], d.pair_matches, getattr(d, "_seen", None)
    monkeypatch.setattr(d, "pair_matches", lambda *a: found.append(whole(*a)) or found[-1])
    monkeypatch.setattr(d, "_seen", lambda *a: rounds.append(1) or seen(*a), raising=False)
    now = F.lit(str(NOW)).cast("timestamp_ntz")
    out = d.in_tick(new.withColumn("ordinal", F.col("link")), d.candidate_set(old.limit(0), old, now), now, group_size).collect()
    got = {r.link: (r.decision, r.reason, r.match, ";".join(r.evidence) if r.evidence is not None else None, r.overlap_pct) for r in out}
    assert got == in_order(new.collect(), old.collect())
    assert found[-1].count() < 500 and len(rounds) <= 10


def test_gate_fails_open(spark):
    gated = spark.createDataFrame(
        [(1, "t", "staged", []), (2, "t", "staged", []), (3, None, "held_for_review", ["m", "n"]), (4, "t", "promo", ["p"]), (5, "t", "held_for_review", []), (6, "t", "staged", None)],
        "link long, title string, outcome string, markers array<string>",
    )
    said = spark.createDataFrame([(1, "block", 9), (3, "flag", 8), (4, "block", 7), (5, None, 6), (6, "odd", 5)], "link long, decision string, match long")
    staged, seen = st.effects(st.with_duplicates(gated, said), F.lit("1998-08-02 12:00:00").cast("timestamp_ntz"))
    assert {r.link: (r.publish_after, r.hold_reason) for r in staged.collect()} == {2: (None, None), 3: (NOW + timedelta(days=1), "m, n"), 5: (None, None), 6: (None, None)}
    assert [tuple(r) for r in seen.collect()] == [(1, "t", 9)]
    assert [x.count() for x in st.effects(st.with_duplicates(gated.limit(0), said), F.current_timestamp())] == [0, 0]


def test_backfill(spark):
    held = spark.createDataFrame([(1, '{"pairs": []}'), (2, None), (3, "no json"), (4, '{"strict": []}'), (5, None), (6, None)], "link long, fingerprint string")
    came = spark.createDataFrame([(1, False, ["a"], "f"), (2, True, ["a"], "f"), (3, False, ["a"], "f"), (4, False, [], "f"), (5, None, None, "f")], "link long, failed boolean, paragraphs array<string>, found string")
    got = {r.link: (r.outcome, r.fingerprint) for r in st.backfill(held, came).collect()}
    assert got == {1: ("skipped", '{"pairs": []}'), 2: ("error", None), 3: ("updated", "f"), 4: ("unreachable", '{"strict": []}'), 5: ("unreachable", None), 6: ("unreachable", None)}


def test_days():
    assert [st.days_in_range(x) for x in ("1", " 30 ", "90")] == [1, 30, 90]
    for bad in ("0", "91", "x", "1.5", ""):
        with pytest.raises(ValueError):
            st.days_in_range(bad)


def test_parsers_and_alerts(spark):
    df = spark.createDataFrame([("https://A.example.org/x", ["b|c|D", "*|a|B", "x|y"]), ("http://example.org@1.2.3.4/", []), (None, None)], "url string, pairs array<string>")
    out = df.select(st.parser_of(F.col("url"), [("example.org", "p")]), st.pair_labels(F.col("pairs")), st.alert_markers(F.col("pairs")), st.alert_title(F.repeat("url", 10))).collect()
    assert [tuple(r)[:3] for r in out] == [("p", "a\nb + c\nx + y", "b|c|D, *|a|B, x|y"), (None, "", "—"), (None, None, "—")]
    assert len(out[0][3]) == 201 and out[2][3] == "None"


def test_block_strings(spark):
    rows_ = [([("lead", "a", None), ("image", " ", "cap"), ("video", "v", "w")], ["X", " ", "Z"]), ([("image", "i", None)], ["1", "2"]), ([("image", "i", None)], None), ([], []), (None, None)]
    df = spark.createDataFrame(rows_, "b array<struct<type:string,text:string,caption:string>>, t array<string>")
    cut = df.withColumn("s", st.block_strings(F.col("b"))).withColumn("done", st.spliced(F.col("b"), F.col("s"), F.col("t"))).collect()
    assert [None if r.s is None else [tuple(x) for x in r.s] for r in cut] == [[(1, "caption", "cap"), (2, "text", "v"), (2, "caption", "w")], [(0, "text", "i")], [(0, "text", "i")], [], None]
    assert [None if r.done is None else [tuple(x) for x in r.done] for r in cut] == [[("lead", "a", None), ("image", " ", "X"), ("video", "v", "Z")], [("image", "i", None)], [("image", "i", None)], [], None]
    assert [len(r[0] or []) for r in df.select(st.block_strings(F.col("b"), False)).collect()] == [4, 1, 1, 0, 0]
    both = spark.createDataFrame([(["é"],), ([],), (None,)], "p array<string>").select(st.json_or_null(F.col("p")).alias("j")).select("j", st.list_or_null(F.col("j")).alias("p")).collect()
    assert [tuple(r) for r in both] == [('["é"]', ["é"]), ("[]", []), (None, None)]


def test_plugs(spark):
    cases = {
        "The new car is out. Follow me on Instagram for more! It costs $28.": "The new car is out. It costs $28.",
        "Good (follow me on X @someone) car": "Good car",
        "Цена 28 долларов. Нажмите здесь и посмотрите. Конец.": "Цена 28 долларов. Конец.",
        "Факт. Подробнее в видео ниже. Ещё факт.": "Факт. Ещё факт.",
        "Рекомендуем эту модель коллекционерам.": "Рекомендуем эту модель коллекционерам.",
        "We recommend matchbox.com/cars today.": "We recommend matchbox.com/cars today.",
        "Fact. We recommend this: www.instagram.com/some/ now": "Fact. now",
        "Подписывайтесь на меня в Instagram.": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", c.without_plugs(F.col("t")).alias("once")).withColumn("twice", c.without_plugs(F.col("once")))
    for r in df.collect():
        assert r.once == cases[r.t] == r.twice
    blocks = [("paragraph", "(follow us on X @someone)", None), ("image", None, "(follow us on X @someone)"), ("list_item", "", None), ("lead", None, None)]
    made = spark.createDataFrame([(blocks,), (None,)], "b array<struct<type:string,text:string,caption:string>>").select(c.blocks_without_plugs(F.col("b"))).collect()
    assert [tuple(x) for x in made[0][0]] == [("image", None, ""), ("list_item", "", None), ("lead", None, None)] and made[1][0] is None


def test_user_message(spark):
    bold = {"type": "paragraph", "runs": [{"text": "b", "formats": ["bold"]}]}
    assert render.marked_paragraphs(["a b", "b"], [{"type": "image"}, bold]) == ["a **b**", "b"]
    assert render.marked_paragraphs(["a"], [bold, bold]) == ["a"] and render.marked_paragraphs(["b"], None) == ["b"] and render.marked_paragraphs([], [bold]) == []
    row = spark.createDataFrame([("s", None, "é", None, None)], "s string, t string, u string, p string, b string").select(render.user_message("s", "t", "u", "p", "b")).first()
    assert json.loads(row[0]) == {"source_name": "s", "title": None, "subtitle": "é", "paragraphs": []} and "é" in row[0]


def test_drops_are_remembered_by_kind(spark):
    gated = spark.createDataFrame(
        [(1, "t", "promo"), (2, None, "genre"), (3, "t", "no_article"), (4, "t", "no_article"), (5, "t", "no_article"), (6, "t", "checklist"), (7, "t", "staged"), (8, "t", "held_for_review"), (8, "t", "held_for_review")],
        "link long, title string, outcome string",
    )
    said = spark.createDataFrame([(7, "flag", 1), (8, "block", 2), (1, "block", 3)], "link long, decision string, match long")
    failures = spark.createDataFrame([(3, 3), (4, 2), (1, 9)], "link long, attempts int")
    got = {tuple(r) for r in st.dropped(st.with_duplicates(gated, said), failures).collect()}
    assert got == {(1, "t", "promo", None), (2, "", "genre", None), (3, "t", "retired", None), (8, "t", "duplicate", 2)}


def test_staged_rows_keep_their_fingerprint(spark):
    fp = "struct<strict:array<string>,brands:array<string>,series:array<string>,pairs:array<string>>"
    block = "array<struct<type:string,text:string>>"
    rows_ = [(1, "staged", "flag", [], ([], [], [], []), ["a"], [("paragraph", "a")]), (2, "held_for_review", "pass", ["m", "n"], (["x y"], ["x"], None, []), ["a"], [("paragraph", "a"), ("heading", "b")]), (3, "duplicate", "block", [], None, [], [])]
    df = spark.createDataFrame([(*r, 0) for r in rows_], f"link long, outcome string, decision string, markers array<string>, fp {fp}, paragraphs array<string>, blocks {block}, match long")
    got = {r.link: r for r in st.staged_rows(df, F.lit(str(NOW)).cast("timestamp_ntz")).collect()}
    assert set(got) == {1, 2} and got[1].publish_after == NOW + timedelta(days=1) and got[2].publish_after is None
    assert got[2].hold_reason == "m, n" and json.loads(got[1].fingerprint) == {"strict": [], "brands": [], "series": [], "pairs": []}
    assert json.loads(got[2].fingerprint)["series"] is None and len(got[1].blocks) == 1 and got[2].blocks is None


def test_store_adverts_and_emojis(spark):
    texts = {
        "Na Universo Hot Wheels você encontra as miniaturas da linha": True, "A Universo Hot Wheels é a maior loja do Brasil": True, "**Universo Hot Wheels** — крупнейший магазин": True,
        "В **Universo Hot Wheels** вы найдёте все модели": True, "A Universo Hot Wheels anunciou uma parceria com a Mattel": False, "Na Universo Hot Wheels houve um evento. Você encontra fotos abaixo": False,
    }
    df = spark.createDataFrame([(k,) for k in texts], "t string")
    assert {r.t: r.b for r in df.select("t", c.boilerplate(F.col("t")).alias("b")).collect()} == texts
    from newsloom.functions import text as x

    titles = {"": "", "🏎️ x": "🏎️ x", "Легенды World Race": "🏆 Легенды World Race", "Гонка": "🏎️ Гонка", "the scar": "🔥 the scar", "A Car!": "🚗 A Car!", "Collab": "🤝 Collab"}
    df = spark.createDataFrame([(k,) for k in [*titles, None]], "t string")
    assert {r.t: r.e for r in df.select("t", x.leading_emoji(F.col("t")).alias("e")).collect()} == titles | {None: None}
