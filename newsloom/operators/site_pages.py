"""Articles of known sites: a table of rules, read over the node tree of a page.

A site is data, not code: which nodes are title, lead and body, how its pictures
are addressed, what is chrome, and what is lifted into the subtitle. ``articles`` picks
the site of each row by the exact host of its URL and reads all pages of all sites in one pass;
the decisions on the texts that come out (boilerplate, repeated titles, subtitle, flat lists)
are column expressions over it.

A page of no known host, without its site's body, or with tags nested too deep gives no article: ``reason`` says which.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators import classify
from newsloom.operators import html_blocks as h

TEXT_KINDS = ("lead", "paragraph", "heading", "list_item")


@dataclass(frozen=True)
class Rules:
    """How a site's pages are read; selectors are ``tag.class.class``, the first that finds a node wins."""

    name: str
    hosts: tuple[str, ...]
    title: tuple[str, ...]
    body: tuple[str, ...]
    #: flow: nested content in order; parts: the body's own children; flat: texts and pictures apart.
    layout: str = "flow"
    subtitle: str | None = None
    #: What becomes the subtitle if no node is: none, first (of the texts), or first_of_two (only if another remains).
    lift: str = "none"
    #: own: the address of the picture; linked: that of a full-size copy around it; widest: of its set.
    picture: str = "own"
    full_size_hosts: tuple[str, ...] = ()
    size_in_path: bool = False
    chrome: tuple[str, ...] = ()
    emphasis: str | None = None
    headings_from_bold: bool = False
    title_repeats: bool = False
    title_stands_in: bool = False
    max_images: int = 10
    # of the layout "parts"
    advert: tuple[tuple[str, ...], ...] = ()
    lead: tuple[str, ...] = ()
    hero: str | None = None
    figure: str | None = None
    caption: str | None = None
    full_link: str | None = None
    gallery: str | None = None
    slug: str | None = None
    #: Kinds of blocks whose texts are paragraphs.
    prose: tuple[str, ...] = ("paragraph", "heading", "list_item")


_BLOG_IMAGES = ("blogger.googleusercontent.com", "bp.blogspot.com")
# Hosts, tags and classes of the sites.
SITES = (
    Rules(
        "autoevolution", ("autoevolution.com", "www.autoevolution.com"), ("h1",), ("div.newstext",), layout="parts", subtitle="div.mgtop_10.mgbot_10.fsz19",
        advert=(("ad", "intext"), ("ad", "ad300"), ("clearfix",)), lead=("fsz22", "sanscond"), hero="div.mainpic", figure="div.ch_pic", caption="div.ch_pic_crd",
        full_link="a.fullimg", gallery="div.newsgal2", slug=r"/news/([^/?#]+?)-\d+\.html", prose=("lead", "paragraph", "heading"),
    ),
    Rules(
        "lamley", ("lamleygroup.com", "www.lamleygroup.com"), ("h1.entry-title", "h1"), ("div.entry-content", "article"), layout="flat", lift="first", picture="linked",
        full_size_hosts=_BLOG_IMAGES,
    ),
    Rules(
        "t_hunted", ("t-hunted.blogspot.com",), ("h3.post-title", "h1.entry-title", "h1"), ("div.post-body", "div.entry-content", "article"), lift="first_of_two",
        picture="linked", full_size_hosts=_BLOG_IMAGES, size_in_path=True, headings_from_bold=True, title_repeats=True, max_images=30,
    ),
    Rules(
        "orangetrack", ("orangetrackdiecast.com", "www.orangetrackdiecast.com"), ("h1",), ("#root",), picture="widest", emphasis="-color", title_stands_in=True,
        chrome=("sharedaddy", "sd-", "taxonomies", "jp-related", "post-comments", "comment-form"),
    ),
)


def matches(node: h.Node, selector: str) -> bool:
    """Whether a node has the tag and all classes of a selector."""
    tag, *classes = selector.split(".")
    return node.tag == tag and node.classes().issuperset(classes)


def pick(root: h.Node, selectors: tuple[str, ...]) -> h.Node | None:
    """The first node in document order of the first selector that has any."""
    for s in selectors:
        if found := root.find(lambda n, s=s: matches(n, s)):
            return found
    return None


def spaced(node: h.Node) -> str:
    """The pieces of a node's text, each stripped, joined by spaces."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n.strip())
        elif n.tag not in ("script", "style", "noscript"):
            stack += reversed(n.children)
    return " ".join(filter(None, out))


def on_host(url: str, hosts: tuple[str, ...]) -> bool:
    """An address on a host of a list or on one below it."""
    try:
        host = (urlsplit(url).hostname or "").lower()
    except ValueError:
        return False
    return any(host == x or host.endswith("." + x) for x in hosts)


class Reader(h.Blocks):
    """Collects the blocks of a page by the rules of its site."""

    def __init__(self, rules: Rules, root: h.Node):
        super().__init__(h.Site(skip_tags=(), max_images=1 << 30))
        self.rules, self.root = rules, root
        self.within = {}
        stack = [root]
        while stack:
            node = stack.pop()
            for child in node.children:
                if isinstance(child, h.Node):
                    self.within[id(child)] = node
                    stack.append(child)
        if rules.emphasis:  # a coloured span counts as bold
            for node in root.all("span", "mark", "font", "a", "em", "i", "u"):
                if any(rules.emphasis in c for c in node.classes()):
                    node.children = [h.Node("b", {}, node.children)]

    def source(self, img: h.Node) -> str | None:
        own = safe_image(img.attrs.get("src"))
        if self.rules.picture == "widest":
            return h.image_source(img)
        if self.rules.picture == "linked":
            around = self.within.get(id(img))
            link = safe_image(around.attrs.get("href")) if around is not None and around.tag == "a" else None
            if link and on_host(link, self.rules.full_size_hosts):
                return link
        return own

    def key(self, src: str) -> str:
        """What two addresses of one picture share."""
        bare = src.split("?", 1)[0]
        return re.sub(r"=s\d+(-c)?(?:/|$)", "", bare) if self.rules.size_in_path else bare

    def add_image(self, src: str | None, caption: str | None) -> None:
        if src and self.key(src) not in self.seen:
            self.seen.add(self.key(src))
            self.out.append(block("image", src=src, caption=caption or None))

    def image(self, node: h.Node, caption: str | None = None) -> None:
        self.add_image(self.source(node), caption)

    def text(self, kind: str, node: h.Node, level: int | None = None) -> None:
        runs = h.runs_of(node)
        text = h.text_of(runs)
        if text:
            if kind == "paragraph" and self.rules.headings_from_bold and h.looks_like_heading(text, runs):
                kind, level = "heading", 3
            styled = any(r["href"] or r["formats"] for r in runs)
            self.out.append(block(kind, text=text, level=level, runs=runs if styled else None))

    def flow(self, node: h.Node) -> None:
        """Nested content in order; text outside of paragraphs, headings and items is not content."""
        for child in node.children:
            if isinstance(child, str) or child.tag in h.OPAQUE or child.tag in ("h1", "h6"):
                continue
            if any(part in c.lower() for c in child.classes() for part in self.rules.chrome):
                continue
            if child.tag == "p":
                frames = child.all("iframe")
                if not (frames and not spaced(child)):
                    for part in h.split_at_breaks(child):
                        self.text("paragraph", part)
                for frame in frames:
                    self.video(frame)
                for img in child.all("img") if spaced(child) or not frames else []:
                    self.image(img)
            elif child.tag in ("h2", "h3", "h4"):
                self.text("heading", child, 3)
            elif child.tag == "h5":
                self.text("paragraph", child)
            elif child.tag == "li":
                self.text("list_item", child)
            elif child.tag == "figure":
                self.figure(child)
            elif child.tag == "img":
                self.image(child)
            elif child.tag == "iframe":
                self.video(child)
            else:
                self.flow(child)

    def figure(self, node: h.Node) -> None:
        """The first picture of a figure and of each figure in it, with their captions; then its players."""
        nested = node.all("figure")[1:]
        if img := node.find(lambda n: n.tag == "img"):
            self.image(img, caption_of(node))
        for frame in node.all("iframe"):
            self.video(frame)
        for inner in nested:
            if img := inner.find(lambda n: n.tag == "img"):
                self.image(img, caption_of(inner))

    # layout "parts"

    def boxed(self, box: h.Node) -> tuple[str, str] | None:
        """Address and caption of a picture box: the full-size link if it is a picture, else the picture."""
        link, img = pick(box, (self.rules.full_link,)), box.find(lambda n: n.tag == "img")
        src = ""
        if link and re.search(r"\.(?:jpe?g|png|webp)(?:\?|$)", link.attrs.get("href", ""), re.I):
            src = safe_image(link.attrs["href"]) or ""
        if not src and img:
            src = safe_image(img.attrs.get("src") or img.attrs.get("data-src")) or ""
        credit = pick(box, (self.rules.caption,))
        return (src, spaced(credit) if credit else "") if src else None

    def parts(self, body: h.Node, url: str) -> None:
        rules = self.rules
        box = pick(self.root, (rules.hero,))
        hero = self.boxed(box) if box else None
        if hero:
            self.add_image(*hero)
        for child in [c for c in body.children if isinstance(c, h.Node)]:
            named = " ".join(sorted(child.classes()))
            if any(all(word in named for word in words) for words in rules.advert):
                continue
            if child.tag == "div" and any(word in named for word in rules.lead):
                self.text("lead", child)
                continue
            for box in detached(child, lambda n: matches(n, rules.figure)):
                if found := self.boxed(box):
                    self.add_image(*found)
            for link in detached(child, lambda n: n.tag == "a" and h.video_embed(n.attrs.get("href"))):
                src = h.video_embed(link.attrs["href"])
                if src not in self.seen:
                    self.seen.add(src)
                    self.out.append(block("video", src=src))
            if child.tag == "p":
                for inner in detached(child, lambda n: n.tag in ("h2", "h3", "h4")):
                    self.text("heading", inner, int(inner.tag[1]))
                self.text("paragraph", child)
            elif child.tag in ("h2", "h3", "h4"):
                self.text("heading", child, int(child.tag[1]))
        gallery, slug = pick(self.root, (rules.gallery,)), re.search(rules.slug, url)
        if gallery and slug:
            here = re.compile(r"/gallery/[^\"']*" + re.escape(slug[1]))
            for link in gallery.all("a"):
                href = link.attrs.get("href", "")
                if here.search(href):
                    img = link.find(lambda n: n.tag == "img")
                    self.add_image(href, (img.attrs.get("data-description") or "").strip() if img else None)


def block(kind: str, **values) -> dict:
    return {"type": kind, "text": None, "level": None, "src": None, "caption": None, "runs": None} | values


def safe_image(url: str | None) -> str | None:
    """An http(s) address of a host."""
    url = (url or "").strip()
    return url if re.match(r"(?i)https?://[^/\s]", url) else None


def caption_of(figure: h.Node) -> str | None:
    found = figure.find(lambda n: n.tag == "figcaption")
    return spaced(found) if found else None


def detached(node: h.Node, test) -> list[h.Node]:
    """The nodes below that pass a test, taken out of the tree; none inside another of them."""
    found = []
    for child in list(node.children):
        if isinstance(child, h.Node):
            if test(child):
                node.children = [c for c in node.children if c is not child]
                found.append(child)
            else:
                found += detached(child, test)
    return found


READ_COLUMNS = ("title", "subtitle", "texts", "images", "blocks")


def read_page(html: str | None, url: str, rules: Rules) -> dict:
    """title, subtitle, texts, images and blocks of one page as they stand there, or the reason why there are none."""
    empty = dict.fromkeys(READ_COLUMNS)
    try:
        return _read_page(h.parse(html, closing=False), url, rules, empty)
    except RecursionError:  # hundreds of tags inside one another
        return empty | {"reason": "too deep"}


def _read_page(root: h.Node, url: str, rules: Rules, empty: dict) -> dict:
    body = root if rules.body == ("#root",) else pick(root, rules.body)
    if body is None:
        return empty | {"reason": "no body"}
    heading = pick(root, rules.title)
    title = spaced(heading) if heading else ""
    lead = pick(root, (rules.subtitle,)) if rules.subtitle else None
    reader = Reader(rules, root)
    out = {"title": title, "subtitle": spaced(lead) if lead else "", "texts": None, "images": None, "blocks": None, "reason": None}
    if rules.layout == "flat":
        texts = [spaced(n) for n in body.all("p", "li", "h2", "h3", "h4", "blockquote")]
        for img in body.all("img"):
            reader.image(img)
        return out | {"texts": [t for t in texts if t and t != title], "images": [b["src"] for b in reader.out]}
    if rules.layout == "parts":
        reader.parts(body, url)
    else:
        reader.flow(body)
    return out | {"blocks": reader.out}


def site_of(url: Column, sites: tuple[Rules, ...] = SITES) -> Column:
    """The name of the site whose exact host an http(s) URL has; null for any other."""
    # what stands before an @ is not the host
    host = F.lower(F.regexp_extract(F.trim(url), r"^(?i:https?)://(?:[^/?#\\]*@)?([^/?#:@\\]+)(?::\d*)?(?:[/?#]|$)", 1))
    return reduce(lambda found, s: F.when(host.isin(*s.hosts), F.lit(s.name)).otherwise(found), sites, F.lit(None).cast("string"))


READ = f"id long, site string, title string, subtitle string, texts array<string>, images array<string>, blocks array<{h.BLOCK}>, reason string"


def read_pages(
    pages: DataFrame, sites: tuple[Rules, ...] = SITES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", carry: tuple[str, ...] = ()
) -> DataFrame:
    """What stands on each page by the rules of its site, in one pass over all of them; ``carry``: columns that come along in the struct ``carried``."""
    by_name = {s.name: s for s in sites}
    strings = pa.list_(pa.string())
    kinds = {"title": pa.string(), "subtitle": pa.string(), "texts": strings, "images": strings, "blocks": pa.list_(h.ARROW_BLOCK), "reason": pa.string()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                batch = whole.slice(at, 100)
                rows = zip(*(batch.column(c).to_pylist() for c in ("site", "url", "html")), strict=True)
                found = [read_page(html, url or "", by_name[site]) if site else dict.fromkeys(kinds) | {"reason": "unknown host"} for site, url, html in rows]
                made = [pa.array([f[c] for f in found], kind) for c, kind in kinds.items()]
                along = ["carried"] if carry else []
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("site"), *made, *map(batch.column, along)], ["id", "site", *kinds, *along])

    named = pages.select(
        F.col(id_col).cast("long").alias("id"),
        site_of(F.col(url_col), sites).alias("site"),
        F.col(url_col).alias("url"),
        F.col(html_col).alias("html"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )
    return named.mapInArrow(read, READ + (f", carried {dict(named.dtypes)['carried']}" if carry else ""))


def _by_site(value, sites: tuple[Rules, ...]) -> Column:
    """A value of the rules as a column of the row's site."""
    return reduce(lambda found, s: F.when(F.col("site") == s.name, value(s)).otherwise(found), sites, F.lit(None))


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def settled(read: DataFrame, sites: tuple[Rules, ...] = SITES) -> DataFrame:
    """Articles of what read_pages returns: boilerplate goes first, then a repeated title, then the subtitle is lifted.

    The flat lists come from the blocks that are left, after the lift, so that they pair with
    them one to one. A page of which nothing is left has the reason ``empty``.
    """
    prose = _by_site(lambda s: F.array(*map(F.lit, s.prose)), sites)
    repeats = _by_site(lambda s: F.lit(s.title_repeats), sites)
    lift = _by_site(lambda s: F.lit({"none": 1 << 30, "first": 1, "first_of_two": 2}[s.lift]), sites)  # texts that it takes
    stands_in = _by_site(lambda s: F.lit(s.title_stands_in), sites)
    cap = _by_site(lambda s: F.lit(s.max_images), sites)
    texts = F.array(*map(F.lit, TEXT_KINDS))
    has_text = lambda b: F.array_contains(texts, b["type"])
    said_again = lambda b: has_text(b) & (F.col("bare_title") != "") & (_bare(b["text"]) == F.col("bare_title"))

    df = read.withColumn("bare_title", _bare(F.col("title")))
    df = df.withColumns(
        {
            "blocks": classify.blocks_without_boilerplate(F.when(repeats, F.filter("blocks", lambda b: ~said_again(b))).otherwise(F.col("blocks"))),
            "texts": classify.without_boilerplate(F.col("texts")),
        }
    )
    # where the block stands that is lifted, counted from 1; 0: none
    spoken = F.filter(F.transform("blocks", lambda b, i: F.when(has_text(b), i + 1)), lambda i: i.isNotNull())
    df = df.withColumn("at", F.when((F.col("subtitle") == "") & F.col("blocks").isNotNull() & (F.size(spoken) >= lift), F.get(spoken, F.lit(0))).otherwise(0))
    df = df.withColumn("take", (F.col("subtitle") == "") & F.col("texts").isNotNull() & (F.size("texts") >= lift))
    df = df.withColumns(
        {
            "subtitle": F.when(F.col("at") > 0, F.get("blocks", F.col("at") - 1)["text"]).when(F.col("take"), F.get("texts", F.lit(0))).otherwise(F.col("subtitle")),
            "blocks": F.filter("blocks", lambda b, i: i + 1 != F.col("at")),
            "texts": F.when(F.col("take"), F.slice("texts", 2, F.greatest(F.size("texts") - 1, F.lit(0)))).otherwise(F.col("texts")),
        }
    )
    of_blocks = F.transform(F.filter("blocks", lambda b: F.array_contains(prose, b["type"])), lambda b: b["text"])
    pictures = F.transform(F.filter("blocks", lambda b: b["type"] == "image"), lambda b: b["src"])
    df = df.withColumns({"paragraphs": F.coalesce(of_blocks, "texts"), "images": F.slice(F.coalesce(pictures, "images"), 1, cap)})
    # a page of nothing but a player speaks by its title
    player_only = stands_in & (F.size("paragraphs") == 0) & F.exists("blocks", lambda b: b["type"] == "video") & (F.col("title") != "")
    df = df.withColumn("paragraphs", F.when(player_only, F.array("title")).otherwise(F.col("paragraphs")))
    nothing = (F.coalesce(F.size("blocks"), F.lit(0)) == 0) & (F.size("paragraphs") == 0) & (F.size("images") == 0) & (F.col("subtitle") == "")
    reason = F.coalesce("reason", F.when(nothing, F.lit("empty")))
    along = ["carried"] if "carried" in read.columns else []
    return df.select("id", "site", "title", "subtitle", "paragraphs", "images", "blocks", reason.alias("reason"), *along)


def articles(pages: DataFrame, sites: tuple[Rules, ...] = SITES, **columns) -> DataFrame:
    """id, site, title, subtitle, paragraphs, images, blocks and reason of each page."""
    return settled(read_pages(pages, sites, **columns), sites)
