"""The real rule sets on fixtures of our own."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.functions import temporal, urls
from newsloom.operators import classify as c
from newsloom.operators import dedup as d
from newsloom.operators import entities as e
from newsloom.operators import html_blocks as h
from newsloom.operators import intake as i
from newsloom.operators import queue as q
from newsloom.operators import render as r
from newsloom.operators import state as s
from newsloom.sources import readers




def column(spark, rows, schema, *columns):
    return [tuple(x) for x in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_boilerplate(spark):
    cases = {
        "Share on Facebook": True, "SHARE VIA email now": True, " Comments ": True, "Comments were made about the new casting": False, "": False,
        "Follow us on Instagram": True, "(follow me on Instagram @maker22)": True, "@maker22": True, "Читайте также": True, "КОММЕНТАРИИ": True,
        "Saiba mais sobre " + "x" * 300: True, "Postagem": True, "Postagem nova": False, "Read more:": True, "Tags: cars" + "x" * 108: True,
        "Tags: cars" + "x" * 112: False, "A text that says share on facebook": False,
    }
    got = column(spark, [(k,) for k in cases], "t string", "t", c.boilerplate(F.col("t")))
    assert dict(got) == cases
    assert column(spark, [(None,)], "t string", c.boilerplate(F.col("t"))) == [(False,)]


def test_relevance(spark):
    rules = c.Relevance(broad_hosts=("broad.example",))
    rows = [
        ("", [], "http://x/", True), ("Hot Wheels and Matchbox", ["matchbox"], "", True), ("New casting", ["Matchbox "], "", False), ("New casting", ["RLC"], "", True),
        ("A matchbox story", [], "", False), ("Car Culture drop", [], "http://broad.example/1", True), ("Something", [], "http://broad.example/1", False), ("Something", None, None, True),
    ]
    got = column(spark, rows, "t string, l array<string>, u string, want boolean", c.relevant(F.col("t"), F.col("l"), F.col("u"), rules), "want")
    assert all(a == b for a, b in got), got


def test_gate_precedence(spark):
    rows = [
        ("http://x/case-contents-checklist", "A title", ["p"], "checklist"), ("http://x/1", "Full Check-List of the case", ["short"], "checklist"),
        ("http://x/1", "Full checklist of the case", ["y" * 500], "staged"), ("http://x/1", "Visit our store", ["Shop now and see"], "promo"),
        ("http://x/1", "Our store story", ["a discount code"], "staged"), ("http://x/1", "Cupom, frete grátis e promoção", ["x"], "promo"),
        ("http://x/1", "NÃO PERCA na nossa loja", ["x"], "promo"), ("http://x/the-new-poster", "A title", ["x"], "held_for_review"),
        ("http://x/1", "Vídeo: the new car", ["x"], "genre"), ("http://x/1", "Unboxing the H case", ["x"], "held_for_review"),
        ("http://x/1", "Unboxing the H case leaked", ["x"], "staged"), ("http://x/1", "Full video unboxing of the case on youtube", ["x"], "held_for_review"),
        ("http://x/1", "Convention tickets and dates", ["x"], "genre"), ("http://x/1", "Convention exclusive car", ["x"], "staged"),
        ("http://x/1", "Video: the poster", ["x"], "held_for_review"), ("http://x/1", "Anything", None, "no_article"), (None, None, [], "staged"),
    ]
    df = spark.createDataFrame(rows, "url string, title string, paragraphs array<string>, want string")
    got = c.gate(df).select("title", "outcome", "want", "markers", "branch").collect()
    assert [(x.title, x.outcome) for x in got] == [(x.title, x.want) for x in got]
    assert {x.title: x.branch for x in got}["Unboxing the H case"] == "video_np"


def test_fingerprint_grammar():
    lex = e.Lexicon()
    assert lex.problems() == []
    f = lex.scan("1999 Nissan Skyline GT-R and a Chevy Camaro review\nFord Mustang Boss 302, BMW and bmw; Land  Rover Defender")
    assert f["strict"] == ["chevrolet camaro", "ford mustang", "land rover defender", "nissan skyline gt-r"]
    assert f["brands"] == ["bmw", "chevrolet", "ford", "land rover", "nissan"]
    assert lex.scan(None) == lex.scan("") == {"strict": [], "brands": [], "series": [], "pairs": []}
    f = lex.scan("Porsche de K-Pop  Demon Hunters")
    assert f["strict"] == ["porsche de k-pop"] and f["pairs"] == ["*|k-pop demon hunters|B"]
    assert lex.scan("Toyota Supra in Top Gun and Car Culture")["pairs"] == ["toyota supra|car culture|B", "toyota supra|top gun|D"]
    assert lex.scan("RLC news, sth else, ZAMAC and sdcc")["series"] == ["red line club", "zamac"]
    assert lex.scan("a red line club drop")["pairs"] == []
    assert lex.scan("minimal ford ferrari f40") == {"strict": ["ferrari f40"], "brands": ["ferrari", "ford", "mini"], "series": [], "pairs": []}
    assert e.Lexicon(series={"a": ("x|y", "broad")}, recurring=()).problems()


FP = e.FINGERPRINT


def rows(spark, items, ordinal=False):
    lex = e.Lexicon()
    out = []
    for link, source, title, ts, text in items:
        f = lex.scan(title + "\n" + text)
        out.append((link, source, title, ts, f))
    df = spark.createDataFrame(out, f"link long, source_name string, title string, ts timestamp_ntz, fp {FP}")
    return d.with_subjects(df)


NOW = datetime(2026, 1, 30, 12)


def test_dedup_verdicts(spark):
    now = F.lit("2026-01-30 12:00:00").cast("timestamp_ntz")
    recent, old = NOW - timedelta(days=2), NOW - timedelta(days=20)
    known = rows(spark, [
        (1, "a", "Toyota Supra joins Top Gun", old, ""), (2, "a", "Nissan Skyline Car Culture", old, ""), (3, "a", "A round-up", recent, "Ford Mustang, Audi Quattro and Honda Civic"),
        (4, "a", "Ford Bronco and Jeep Wrangler", recent, ""), (5, "b", "Mazda Miata Top Gun 2025", old, ""),
    ])
    new = rows(spark, [
        (11, "b", "Top Gun: the Toyota Supra", NOW, ""), (12, "b", "Car Culture Nissan Skyline", NOW, ""), (13, "b", "Ford Mustang and Audi Quattro, Honda Civic", NOW, ""),
        (14, "b", "Ford Bronco, Jeep Wrangler", NOW, ""), (15, "b", "Mazda Miata Top Gun 2026", NOW, ""), (16, "c", "Mazda Miata Top Gun 2026", NOW, ""), (17, "b", "Nothing named", NOW, ""),
        (18, "a", "Toyota Supra joins Top Gun", NOW, ""),
    ]).withColumn("ordinal", F.lit(None).cast("struct<branch:int,ts:timestamp_ntz,link:bigint>"))
    cand = d.candidate_set(known.where("link < 4"), known.where("link >= 4"), now)
    got = {x.link: (x.decision, x.reason, x.match) for x in d.verdicts(new, cand, now).collect()}
    assert got[11] == ("block", "pair", 1)
    assert got[12] == ("flag", "broad_subject", 2)
    assert got[13] == ("flag", "overlap_title_capped", 3)
    assert got[14] == ("block", "overlap", 4)
    assert got[15] == got[16] == got[17] == ("pass", None, None)
    assert got[18] == ("pass", None, None)  # same source


def test_in_tick_order(spark):
    now = F.lit("2026-01-30 12:00:00").cast("timestamp_ntz")
    new = rows(spark, [
        (1, "a", "Toyota Supra Top Gun", NOW, ""), (2, "b", "Top Gun Toyota Supra", NOW, ""), (3, "c", "The Toyota Supra of Top Gun", NOW, ""), (4, "d", "Jeep Wrangler", NOW, ""),
    ])
    empty = d.candidate_set(new.limit(0), new.limit(0), now)
    got = {x.link: (x.decision, x.match) for x in d.in_tick(new.withColumn("ordinal", F.col("link")), empty, now).collect()}
    assert got == {1: ("pass", None), 2: ("block", 1), 3: ("block", 1), 4: ("pass", None)}


def test_machines(spark):
    t0 = datetime(2026, 1, 1)
    hours = [(0, "outage"), (0.5, "outage"), (1, "outage"), (1.5, "outage"), (2, "outage"), (3, "outage"), (4, "recovery"), (5, "recovery"), (6, "outage"), (9, "outage"), (9.1, "outage")]
    ev = [(1, t0 + timedelta(hours=x), n, k) for n, (x, k) in enumerate(hours)]
    df = spark.createDataFrame(ev, "key long, ts timestamp_ntz, seq long, kind string")
    got = [(x.seq, x.output) for x in s.fold(df, s.outage_step).orderBy("seq").collect()]
    assert got == [(0, "ping1"), (2, "ping2"), (4, "fallback"), (6, "recovered"), (8, "ping1"), (9, "ping2"), (10, "fallback")]
    state, said = None, []
    for x in (0, 0.5, 1, 1.5, 2):
        state, out = s.gap_step(state, t0 + timedelta(hours=x), "ping")
        said.append(out)
    assert said == ["sent", "suppressed", "sent", "suppressed", "sent"]
    state, said = None, []
    for day, kind in ((0, "failed"), (0.1, "failed"), (1, "failed"), (2, "ok"), (3, "failed"), (4, "failed"), (5, "failed")):
        state, out = s.streak_step(state, t0 + timedelta(days=day), kind)
        said.append(out)
    assert said == ["failing", "failing", "failing", "reset", "failing", "failing", "retired"]
    assert s.slot_loop([1, 2], [1, 2, 3], lambda row, slot: "held" if slot == 1 else "published") == [(1, 1, "held"), (2, 1, "published"), (3, 2, "published")]
    assert s.retries(["transient", "ok"]) == ("ok", timedelta(minutes=10)) and s.retries(["transient"] * 9)[0] == "transient" and s.retries(["fatal", "ok"])[0] == "fatal"


def test_stream_matches_fold(spark, tmp_path):
    from newsloom.streaming import machines

    t0 = datetime(2026, 1, 1)
    ev = [(k, t0 + timedelta(minutes=25 * n + k), n, "outage" if n % 7 else "recovery") for k in (1, 2) for n in range(30)]
    df = spark.createDataFrame(ev, "key long, ts timestamp, seq long, kind string")
    for part in range(3):
        df.where(f"seq div 10 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = machines.stream_machine(stream, s.outage_step).writeStream.format("memory").queryName("machine").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((x.key, x.seq, x.output) for x in spark.table("machine").collect())
    want = sorted((x.key, x.seq, x.output) for x in s.fold(df, s.outage_step).collect())
    assert got == want and len(got) > 8


def test_html_blocks_and_rendering():
    page = """<html><body><nav><p>menu</p></nav><article><h1>The Title</h1><h2>Part</h2><p>The Title</p>
      <p>One <b>bold <i>both</i></b> <a href="https://x.example/a">link</a> <a href="javascript:x">bad</a><br>after <em>break</em></p>
      <p><strong>All bold</strong></p><p><strong>Ends with dot.</strong></p><div class="share">no</div><ul><li>one</li><li></li><li>two <b>b</b></li></ul>
      <figure><img src="https://i.example/a.jpg?w=1"><figcaption>cap</figcaption></figure><img src="https://i.example/a.jpg?w=2"><img src="//x/y.jpg">
      <iframe src="https://www.youtube.com/embed/abcdefghij?x=1"></iframe><iframe src="https://evil.example/embed/abcdefghij"></iframe><script>var a="<p>no</p>"</script></article>"""
    got = h.article(page)
    kinds = [(b["type"], b["text"] or b["src"], b["level"]) for b in got["blocks"]]
    assert kinds == [
        ("heading", "Part", 3), ("paragraph", "One bold both link bad", None), ("paragraph", "after break", None), ("heading", "All bold", 4), ("paragraph", "Ends with dot.", None),
        ("list_item", "one", None), ("list_item", "two b", None), ("image", "https://i.example/a.jpg?w=1", None),
        ("video", "/embed/youtube?url=https%3A%2F%2Fwww.youtube.com%2Fwatch%3Fv%3Dabcdefghij", None),
    ]
    runs = got["blocks"][1]["runs"]
    assert "".join(x["text"] for x in runs) == "One bold both link bad"
    assert [x["text"].strip() for x in runs if x["href"]] == ["link"] and [x["formats"] for x in runs[:3]] == [[], ["bold"], ["bold", "italic"]]
    text = r.encode_markers("One bold word", [{"text": "bold", "formats": ["bold"]}])
    assert text == "One **bold** word"
    assert r.decode_markers(text)[1] == [{"text": "One ", "href": None, "formats": []}, {"text": "bold", "href": None, "formats": ["bold"]}, {"text": " word", "href": None, "formats": []}]
    nodes = r.nodes_of_blocks(got["blocks"])
    out = "".join(map(r.to_html, nodes))
    assert out.startswith('<figure><img src="https://i.example/a.jpg?w=1"><figcaption>cap</figcaption></figure><h3>Part</h3>') and "<ul><li>one</li><li>two <strong>b</strong></li></ul>" in out
    assert r.to_html({"tag": "script", "children": ["x"]}) == "" and r.to_html({"tag": "img", "attrs": {"src": "javascript:1"}}) == "<img>"
    assert [n["tag"] for n in r.nodes_of_paragraphs(["a"] * 4, ["https://i/1", "https://i/2", "bad"])] == ["p", "p", "p", "figure", "p", "figure"]
    assert r.nodes_of_blocks(got["blocks"], 0)[0]["tag"] == "h3"
    assert h.image_source(h.Node("img", {"srcset": "https://a/1 320w, https://a/2 1024w, https://a/3 2048w"})) == "https://a/2"


def test_times_and_urls(spark):
    cases = [("-01-30", "2026-01-30 12:00:00", "fresh"), ("-01-29", "2026-01-30 12:00:00", "inconclusive"), ("-01-29", "2026-01-30 18:00:00", "stale"), ("-01-28", "2026-01-30 12:00:00", "stale"), ("-12-31", "2026-01-02 12:00:00", "stale"), ("-02-30", "2026-01-30 12:00:00", "inconclusive"), ("none", "2026-01-30 12:00:00", "inconclusive"), ("-06-01", "2026-01-30 12:00:00", "inconclusive")]
    got = column(spark, cases, "p string, n string, want string", temporal.page_freshness(F.col("p"), F.to_timestamp("n")), "want")
    assert all(a == b for a, b in got), got
    links = [("https://a.example/x", True), ("http://A.example:80/x", True), ("https://a.example.evil/x", False), ("https://u@a.example/x", False), ("ftp://a.example/", False), (None, False), ("https://b.example", False)]
    got = column(spark, links, "u string, want boolean", urls.allowed_host(F.col("u"), ["a.example"]), "want")
    assert all(a == b for a, b in got), got
    slots = column(spark, [("2026-01-30 10:05:00", 2), ("2026-01-30 10:05:01", 5), ("2026-01-30 20:00:00", 1), ("2026-01-30 09:00:00", 0)], "n string, k int", temporal.fixed_slots(F.to_timestamp_ntz("n"), F.col("k")).alias("s"))
    assert [(len(x[0].slots), x[0].carry) for x in slots] == [(2, 0), (2, 3), (0, 1), (0, 0)]
    tokens = column(spark, [("hold|http://x|y",), ("http://x|y",), ("dedup|z",)], "t string", q.decode_token(F.col("t")))
    assert [tuple(x[0]) for x in tokens] == [("hold", "http://x|y"), ("dedup", "http://x|y"), ("dedup", "z")]


def test_backfill_predicates_and_translation(spark):
    fps = [('{"pairs": []}', False, True), ('{"pairs": null}', True, True), ('{"strict": []}', True, False), ("broken", True, False), (None, True, False), ("[1]", True, False)]
    got = column(spark, fps, "f string, a boolean, b boolean", q.needs_backfill(F.col("f")), "a", q.has_pairs_key(F.col("f")), "b")
    assert all(w == x and y == z for w, x, y, z in got), got
    good = '{"title": "t", "title_alternatives": ["a", "b"], "subtitle": "", "paragraphs": ["%s", "y"]}' % ("x" * 30)
    rows_ = [(good, 2, True, "ok"), (good, 3, True, "count"), ("[]", 2, True, "not an object"), (good.replace('"title": "t", ', ""), 2, True, "no title"), (good.replace('"a", "b"', '"a"'), 2, True, "alternatives"), (good.replace("x" * 30, "x"), 2, True, "too short"), (good.replace('"y"', '" "'), 2, True, "blank paragraph")]
    got = column(spark, rows_, "b string, n int, s boolean, want string", i.translation_verdict(F.col("b"), F.col("n"), F.col("s")), "want")
    assert all(a == b for a, b in got), got


def test_readers(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(
        "<rss><channel><item><title>A</title><link> https://s.example/a </link><category>x</category><category>y</category><pubDate>p</pubDate><description>d</description></item>"
        "<item><title>B</title></item></channel></rss>"
    )
    got = {x.title: x for x in readers.read_feed(spark, str(tmp_path / "feed.xml"), {"s.example": "s"}).collect()}
    assert got["A"].link == "https://s.example/a" and got["A"].labels == ["x", "y"] and got["A"].source_name == "s" and got["B"].source_name == "other"
    import json

    body = json.dumps('0:{"entries":[{"t":"a]b","body":"$1f"}]}\n1f:T5,héll\n')
    page = f"<script>self.__x.push([1,{body}])</script>"
    assert json.loads(readers.embedded(page, "entries")) == [{"t": "a]b", "body": "héll"}]
    assert readers.embedded("<p>no</p>", "entries") is None
    ok = {"title": "t", "subtitle": "", "paragraphs": ["a"], "ru_paragraphs": ["b"], "blocks": None, "ru_blocks": None}
    cases = [(ok, "ok"), ({**ok, "x": 1}, "keys"), ({**ok, "paragraphs": ["p"] * 101}, "paragraphs"), ({**ok, "paragraphs": ["p" * 10241]}, "paragraph length"), ({**ok, "blocks": []}, "blocks of one language only"), ({**ok, "blocks": [{"type": "zap"}], "ru_blocks": []}, "block type"), ({**ok, "blocks": [{"type": "heading", "level": 2}], "ru_blocks": []}, "heading level")]
    got = column(spark, [(json.dumps(p), w) for p, w in cases], "p string, want string", readers.stage_verdict(F.col("p")), "want")
    assert all(a == b for a, b in got), got
    df = spark.createDataFrame([(1, "a"), (2, "b")], "link long, title string")
    back = readers.snapshot(df, str(tmp_path / "snap"))
    assert readers.keeps_ledger(df, back) and not readers.keeps_ledger(df, back.where("link = 1"))
    with pytest.raises(ValueError):
        readers.snapshot(df.limit(0), str(tmp_path / "empty"))
    ledger = q.append_ledger(df, spark.createDataFrame([(3, "c")], df.schema))
    assert ledger.count() == 3
    with pytest.raises(Exception, match="already in the ledger"):
        q.append_ledger(df, df).collect()


def test_bold_paragraphs_that_are_headings():
    from newsloom.operators.html_blocks import looks_like_heading

    bold = lambda *parts: [{"text": p, "href": None, "formats": ["bold"]} for p in parts]
    assert looks_like_heading("A whole bold line", bold("A whole bold line"))
    assert looks_like_heading("Twoparts", bold("Two", "parts"))
    assert not looks_like_heading("Two parts", bold("Two", "parts"))  # the gap between them is prose
    assert not looks_like_heading("And so on...", bold("And so on..."))
    assert looks_like_heading("And so on….", bold("And so on….")) and looks_like_heading("And so on…", bold("And so on…"))
    assert not looks_like_heading("A sentence.", bold("A sentence.")) and not looks_like_heading("Name or Name", bold("Name"))


def test_fetch_failures_count_days(spark):
    from newsloom.operators import queue as q

    have = spark.createDataFrame([(1, 2, "2024-01-01 10:00:00", "2024-01-03 23:00:00"), (2, 1, "2024-01-01 00:00:00", "2024-01-01 00:00:00")], "link long, attempts int, a string, b string")
    have = have.selectExpr("link", "attempts", "timestamp(a) first_failed_at", "timestamp(b) last_failed_at")
    tries = [(1, "2024-01-03 23:30:00"), (1, "2024-01-04 00:10:00"), (1, "2024-01-04 09:00:00"), (3, "2024-01-05 01:00:00"), (None, "2024-01-05 01:00:00"), (3, None)]
    got = q.record_fetch_failures(have, spark.createDataFrame(tries, "link long, ts string").selectExpr("link", "timestamp(ts) ts"))
    assert sorted((r.link, r.attempts, str(r.first_failed_at), str(r.last_failed_at)) for r in got.collect()) == [
        (1, 3, "2024-01-01 10:00:00", "2024-01-04 09:00:00"),
        (2, 1, "2024-01-01 00:00:00", "2024-01-01 00:00:00"),
        (3, 1, "2024-01-05 01:00:00", "2024-01-05 01:00:00"),
    ]
    assert sorted(r.link for r in q.clear_fetch_failures(got, spark.createDataFrame([(1,), (None,)], "link long")).collect()) == [2, 3]
