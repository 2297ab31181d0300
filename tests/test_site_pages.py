"""The four sites' rules on pages written for them."""

import pytest

from newsloom.operators import site_pages as sp

BLOG = """<html><body><script>var x = "<p>no</p>"</script><h3 class="post-title entry-title"> Novo  <b>Mainline</b> 2026</h3>
<div class="post-body entry-content">
<p>Novo Mainline2026</p>
<p>Marcadores: novidades</p>
<p>O primeiro parágrafo <a href="https://example.org/a">com link</a>.</p>
<a href="https://blogger.googleusercontent.com/img/s1200/a.jpg"><img src="https://blogger.googleusercontent.com/img/w200/a.jpg"></a>
<a href="https://blogger.googleusercontent.com/img/b.jpg=s1600"><img src="https://blogger.googleusercontent.com/img/b.jpg=s320-c"></a>
<img src="https://blogger.googleusercontent.com/img/b.jpg=s640">
<a href="https://track.example/?u=blogger.googleusercontent.com"><img src="https://x.example/c.jpg"></a>
<img src="httpx://evil/d.jpg">
<p><b>Os carros</b></p>
<ul><li>Um</li><li> </li><li>Dois <em>raro</em></li></ul>
<p>Linha um<br>Linha dois</p>
<p><iframe src="https://www.youtube.com/embed/abcdefghijk"></iframe></p>
</div></body></html>"""

FLAT = """<h1 class="entry-title">Case report</h1><article><div class="entry-content">
<p>Case report</p><p>Share on Facebook</p><p>The lead <i>of</i> it.</p><h2>Models</h2><blockquote>Quoted</blockquote><ul><li>One</li></ul>
<a href="https://2.bp.blogspot.com/s1200/a.jpg?x=1"><img src="https://2.bp.blogspot.com/w200/a.jpg"></a>
<img src="https://2.bp.blogspot.com/s1200/a.jpg?x=2"><img src="/relative.jpg">
</div></article>"""

FEED = """<p>Intro <span class="has-vivid-red-color">red</span> text</p><h1>Unboxing</h1>
<div class="sharedaddy sd-block"><p>Share this</p></div>
<h2>Head</h2><h5>Marker line</h5><h6>dropped</h6>
<figure><img srcset="https://i.example/a.jpg?w=300 300w, https://i.example/a.jpg?w=1024 1024w, https://i.example/a.jpg?w=2000 2000w"><figcaption>The car</figcaption></figure>
<figure><img src="https://i.example/a.jpg?w=600"></figure>
<figure class="wp-block-embed"><div><iframe src="https://youtu.be/abcdefghijk"></iframe></div></figure>
loose text
<ol><li>First</li></ol>"""

NEWS = """<html><body><h1>The  Car</h1><div class="mgtop_10 mgbot_10 fsz19 x">A subtitle</div>
<div class="ch_pic mainpic"><a class="fullimg" href="https://s1.example/hero.jpg"><img src="https://s1.example/hero-t.jpg"></a><div class="ch_pic_crd">Photo: A</div></div>
<div class="newstext">
<div class="sanscond fsz22 bold">The lead here</div>
<div class="intext ad300">advert</div>
<p><h2 class="bold">Section one</h2><div class="ch_pic"><img data-src="https://s1.example/in.jpg"><div class="ch_pic_crd">Photo: B</div></div>Body <a href="https://example.org/x">link</a> text</p>
<p>Watch <a href="https://www.youtube.com/watch?v=abcdefghijk"><img src="t.jpg"></a>now</p>
<h3>Next</h3>
<p>Share on Facebook</p>
</div>
<div class="newsgal2"><a href="https://s1.example/images/news/gallery/the-car_1.jpg"><img data-description=" Side "></a>
<a href="https://s1.example/hero.jpg?size=2">x</a><a href="https://s1.example/images/news/gallery/other_1.jpg">y</a></div></body></html>"""

PAGES = [
    (1, "https://t-hunted.blogspot.com/2026/01/x.html", BLOG),
    (2, "https://www.lamleygroup.com/2026/x/", FLAT),
    (3, "https://orangetrackdiecast.com/x/", FEED),
    (4, "https://www.autoevolution.com/news/the-car-123.html", NEWS),
    (5, "https://t-hunted.blogspot.com.attacker.example/", BLOG),
    (6, "https://t-hunted.blogspot.com/gallery", '<h1 class="entry-title">T</h1><div class="post-body"><p>Only one.</p><img src="https://x.example/1.jpg"></div>'),
    (7, "https://lamleygroup.com/none", "<h1>T</h1><div>no body</div>"),
    (8, "https://orangetrackdiecast.com/video", '<h1>Clip</h1><iframe src="https://www.youtube.com/embed/abcdefghijk"></iframe>'),
    (9, "https://orangetrackdiecast.com/empty", None),
    (10, None, "<p>x</p>"),
    (11, "https://orangetrackdiecast.com/deep", "<div>" * 5000 + "<p>x</p>"),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return {r.id: r for r in sp.articles(df.repartition(3)).collect()}


def kinds(row):
    return [(b.type, b.text or b.src) for b in row.blocks]


def test_blog_with_full_size_links(found):
    r = found[1]
    assert (r.site, r.title, r.reason) == ("t_hunted", "Novo Mainline 2026", None)
    assert r.subtitle == "O primeiro parágrafo com link."  # after boilerplate and the repeated title are gone
    assert kinds(r) == [
        ("image", "https://blogger.googleusercontent.com/img/s1200/a.jpg"),
        ("image", "https://blogger.googleusercontent.com/img/b.jpg=s1600"),
        ("image", "https://x.example/c.jpg"),
        ("heading", "Os carros"),
        ("list_item", "Um"),
        ("list_item", "Dois raro"),
        ("paragraph", "Linha um"),
        ("paragraph", "Linha dois"),
        ("video", "/embed/youtube?url=https%3A%2F%2Fwww.youtube.com%2Fwatch%3Fv%3Dabcdefghijk"),
    ]
    assert r.paragraphs == ["Os carros", "Um", "Dois raro", "Linha um", "Linha dois"]
    assert r.images == [b.src for b in r.blocks if b.type == "image"]


def test_one_text_stays_in_the_body(found):
    r = found[6]
    assert r.subtitle == "" and r.paragraphs == ["Only one."] and r.images == ["https://x.example/1.jpg"]


def test_flat_page(found):
    r = found[2]
    assert (r.site, r.title, r.subtitle) == ("lamley", "Case report", "The lead of it.")
    assert r.blocks is None and r.paragraphs == ["Models", "Quoted", "One"]
    assert r.images == ["https://2.bp.blogspot.com/s1200/a.jpg?x=1"]


def test_feed_body(found):
    r = found[3]
    assert r.title == "Unboxing" and r.subtitle == ""
    assert kinds(r) == [
        ("paragraph", "Intro red text"), ("heading", "Head"), ("paragraph", "Marker line"), ("image", "https://i.example/a.jpg?w=1024"),
        ("video", "/embed/youtube?url=https%3A%2F%2Fwww.youtube.com%2Fwatch%3Fv%3Dabcdefghijk"), ("list_item", "First"),
    ]
    assert r.blocks[0].runs[1].formats == ["bold"] and r.blocks[3].caption == "The car"
    assert found[8].paragraphs == ["Clip"] and found[8].reason is None


def test_page_in_parts(found):
    r = found[4]
    assert (r.site, r.title, r.subtitle) == ("autoevolution", "The  Car", "A subtitle")
    assert kinds(r) == [
        ("image", "https://s1.example/hero.jpg"), ("lead", "The lead here"), ("image", "https://s1.example/in.jpg"), ("heading", "Section one"),
        ("paragraph", "Body link text"), ("video", "/embed/youtube?url=https%3A%2F%2Fwww.youtube.com%2Fwatch%3Fv%3Dabcdefghijk"), ("paragraph", "Watch now"),
        ("heading", "Next"), ("image", "https://s1.example/images/news/gallery/the-car_1.jpg"),
    ]
    assert [b.caption for b in r.blocks if b.type == "image"] == ["Photo: A", "Photo: B", "Side"]
    assert [b.level for b in r.blocks if b.type == "heading"] == [2, 3]
    assert r.paragraphs == ["The lead here", "Section one", "Body link text", "Watch now", "Next"]


def test_pages_without_article(found):
    assert {i: found[i].reason for i in (5, 7, 9, 10, 11)} == {5: "unknown host", 7: "no body", 9: "empty", 10: "unknown host", 11: "too deep"}
    assert found[5].site is None and found[5].blocks is None
    assert len(found) == len(PAGES)


def test_hosts_are_exact(spark):
    urls = {
        "http://lamleygroup.com": "lamley", "HTTPS://WWW.LamleyGroup.com:443/x": "lamley", "https://t-hunted.blogspot.com@evil.example/": None, "ftp://lamleygroup.com/": None,
        "//lamleygroup.com/": None, "https://evil.example/?lamleygroup.com": None, "https://www.t-hunted.blogspot.com/": None, "https://u:p@autoevolution.com/news": "autoevolution",
        "https://lamleygroup.com\\@evil.example/": None, "": None, None: None,
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.site for r in df.select("url", sp.site_of(df.url).alias("site")).collect()} == urls


def test_flat_lists_pair_with_blocks(found):
    for r in found.values():
        if r.blocks is not None and r.paragraphs != [r.title]:
            prose = next(s for s in sp.SITES if s.name == r.site).prose
            assert r.paragraphs == [b.text for b in r.blocks if b.type in prose]


def test_empty_table(spark):
    assert sp.articles(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
