"""Feeds with good, foreign, broken and oversized content."""

from newsloom.sources import feed_scan as fs

NS = 'xmlns:content="http://purl.org/rss/1.0/modules/content/"'


def item(link, content=None, title="T", more=""):
    body = f"<content:encoded><![CDATA[{content}]]></content:encoded>" if content is not None else ""
    return f"<item><title>{title}</title>{f'<link>{link}</link>' if link is not None else ''}{body}{more}</item>"


def rss(*items):
    return f"<rss {NS}><channel><title>feed</title>{''.join(items)}</channel></rss>"


FEEDS = {
    "good": rss(
        item(" https://orangetrackdiecast.com/a ", "<h1>Own title</h1><p>One <b>two</b></p><img src='https://i.example/a.jpg'>", more="<category>x</category><category>y</category>"),
        item("https://www.orangetrackdiecast.com/b", "<p>Only text</p>", title="Feed &amp; title"),
        item("https://orangetrackdiecast.com.evil.example/", "<p>never read</p>"),
        item(None, "<p>never read</p>"),
        item("https://orangetrackdiecast.com/c"),
    ),
    "one": rss(item("https://orangetrackdiecast.com/z", "<p>z</p>")),
    "none": rss(),
    "broken": "<rss><channel><item><title>x",
    "text": "not a feed",
    "large": rss(item("https://orangetrackdiecast.com/l", "<p>" + "x" * 3000 + "</p>")),
    "null": None,
}


def test_every_entry_has_a_place_or_a_reason(spark):
    df = spark.createDataFrame(list(FEEDS.items()), "feed_url string, body string")
    rows = {(r.feed_url, r.position): r for r in fs.scan_feeds(df, max_bytes=2000).collect()}
    assert {k: r.reason for k, r in rows.items()} == {
        ("good", 0): None, ("good", 1): None, ("good", 2): "host rejected", ("good", 3): "host rejected", ("good", 4): "empty",
        ("one", 0): None, ("none", None): "no entries", ("broken", None): "malformed", ("text", None): "malformed", ("large", None): "too large", ("null", None): "no body",
    }
    a, b, foreign = rows["good", 0], rows["good", 1], rows["good", 2]
    assert (a.title, a.link, a.labels, a.paragraphs, a.images) == ("Own title", "https://orangetrackdiecast.com/a", ["x", "y"], ["One two"], ["https://i.example/a.jpg"])
    assert (b.title, b.paragraphs, b.source_name) == ("Feed & title", ["Only text"], "orangetrack")
    assert foreign.paragraphs is None and foreign.title == "T" and foreign.source_name is None


def test_files_and_empty_tables(spark, tmp_path):
    for name in ("good", "one"):
        (tmp_path / f"{name}.xml").write_text(FEEDS[name])
    assert fs.scan_feeds(fs.feed_files(spark, str(tmp_path))).where("reason is null").count() == 3
    assert fs.scan_feeds(spark.createDataFrame([], "feed_url string, body string")).count() == 0
