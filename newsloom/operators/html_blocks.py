"""HTML to typed content blocks with inline runs, on Arrow batches.

The tree comes from the standard library's tolerant parser. A site is described
by data: where the content begins, what is chrome, how many images are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = "struct<text:string,href:string,formats:array<string>>"
BLOCK = f"struct<type:string,text:string,level:int,src:string,caption:string,runs:array<{RUN}>>"

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
OPAQUE = {"script", "style", "noscript", "template", "svg", "form", "button"}
#: Inline tags and the format each adds, in the order in which formats nest when rendered.
FORMATS = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "u": "underline", "s": "strikethrough", "strike": "strikethrough", "del": "strikethrough"}
HEADINGS = {"h2": 3, "h3": 3, "h4": 3}


@dataclass
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    children: list = field(default_factory=list)

    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def find(self, test) -> Node | None:
        """First node in document order that passes a test."""
        stack = [self]
        while stack:
            node = stack.pop()
            if test(node):
                return node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]
        return None

    def all(self, *tags: str) -> list[Node]:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if node.tag in tags:
                out.append(node)
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]
        return out

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in OPAQUE:
                stack += reversed(node.children)
        return "".join(out)


class _Tree(HTMLParser):
    #: A new one of these closes an open one.
    CLOSES = {"p": {"p"}, "li": {"li"}, "h1": {"p"}, "h2": {"p"}, "h3": {"p"}, "h4": {"p"}, "ul": {"p"}, "ol": {"p"}, "figure": {"p"}, "div": {"p"}, "article": {"p"}}

    def __init__(self, closing: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.closes = self.CLOSES if closing else {}
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for closed in self.closes.get(tag, ()):
            names = [n.tag for n in self.open]
            if closed in names[-8:]:
                del self.open[len(names) - 1 - names[::-1].index(closed) :]
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str | None, closing: bool = True) -> Node:
    """The tree of a page; without ``closing``, an open paragraph or item holds whatever follows it up to its end tag."""
    tree = _Tree(closing)
    tree.feed(html or "")
    tree.close()
    return tree.root


def safe_link(href: str | None) -> str | None:
    """An http(s) or mailto link; anything else, relative and // forms too, is none."""
    href = (href or "").strip()
    return href if re.match(r"(?i)(?:https?://[^/\s]|mailto:\S)", href) else None


def image_source(node: Node, base: str = "") -> str | None:
    """The widest srcset candidate of at most 1024 pixels, else the widest, else src; https? only."""
    best = None
    for part in (node.attrs.get("srcset") or "").split(","):
        m = re.fullmatch(r"\s*(\S+)\s+(\d+)w\s*", part)
        if m:
            width = int(m[2])
            rank = (width <= 1024, width if width <= 1024 else -0, width)
            if best is None or rank > best[0]:
                best = (rank, m[1])
    url = (best[1] if best else None) or node.attrs.get("data-src") or node.attrs.get("src") or ""
    url = urljoin(base, url.strip()) if base else url.strip()
    return url if re.match(r"(?i)https?://[^/\s]", url) else None


def video_embed(src: str | None, proxy: str = "/embed/") -> str | None:
    """Player URL on a known host as an embedding path; the host is tested before the id."""
    try:
        parts = urlsplit((src or "").strip() if not (src or "").startswith("//") else "https:" + src)
    except ValueError:
        return None
    host = (parts.hostname or "").lower()
    if parts.scheme not in ("http", "https"):
        return None
    if host in ("www.youtube.com", "youtube.com", "m.youtube.com", "www.youtube-nocookie.com"):
        m = re.search(r"(?:/embed/|/v/|/shorts/)([A-Za-z0-9_-]{6,20})", parts.path) or re.search(r"(?:^|&)v=([A-Za-z0-9_-]{6,20})", parts.query)
        return m and f"{proxy}youtube?url=" + quote(f"https://www.youtube.com/watch?v={m[1]}", safe="")
    if host == "youtu.be":
        m = re.match(r"/([A-Za-z0-9_-]{6,20})", parts.path)
        return m and f"{proxy}youtube?url=" + quote(f"https://www.youtube.com/watch?v={m[1]}", safe="")
    if host in ("vimeo.com", "player.vimeo.com"):
        m = re.search(r"/(?:video/)?(\d{4,12})", parts.path)
        return m and f"{proxy}vimeo?url=" + quote(f"https://vimeo.com/{m[1]}", safe="")
    return None


def runs_of(node: Node, max_runs: int = 100, max_chars: int = 100_000) -> list[dict]:
    """Inline runs in order: a new run wherever link or formats change, white space collapsed, ends trimmed.

    Text with too many runs or characters becomes one plain run.
    """
    pieces: list[tuple[str, str | None, tuple]] = []

    def walk(n: Node, href: str | None, formats: tuple) -> None:
        for child in n.children:
            if isinstance(child, str):
                pieces.append((child, href, formats))
            elif child.tag == "br":
                pieces.append((" ", href, formats))
            elif child.tag not in OPAQUE and child.tag not in ("img", "iframe", "video"):
                more = FORMATS.get(child.tag)
                link = safe_link(child.attrs.get("href")) if child.tag == "a" else None
                walk(child, link or href, tuple(sorted({*formats, more})) if more else formats)

    walk(node, None, ())
    runs: list[dict] = []
    for text, href, formats in pieces:
        text = re.sub(r"\s+", " ", text)
        if runs and runs[-1]["href"] == href and runs[-1]["formats"] == list(formats):
            runs[-1]["text"] = re.sub(r" +", " ", runs[-1]["text"] + text)
        elif text:
            if runs and runs[-1]["text"].endswith(" "):
                text = text.lstrip(" ")
            if text:
                runs.append({"text": text, "href": href, "formats": list(formats)})
    while runs and not runs[0]["text"].strip():
        runs.pop(0)
    while runs and not runs[-1]["text"].strip():
        runs.pop()
    if runs:
        runs[0]["text"], runs[-1]["text"] = runs[0]["text"].lstrip(), runs[-1]["text"].rstrip() if len(runs) > 1 else runs[-1]["text"].strip()
    if len(runs) > max_runs or sum(len(r["text"]) for r in runs) > max_chars:
        return [{"text": text_of(runs), "href": None, "formats": []}]
    return runs


def text_of(runs: list[dict]) -> str:
    """Runs joined without separator, white space collapsed."""
    return re.sub(r"\s+", " ", "".join(r["text"] for r in runs)).strip()


def looks_like_heading(text: str, runs: list[dict]) -> bool:
    """Bold spans, each at its first place in the text, join without a gap and cover it; a final dot disqualifies, save after an ellipsis sign."""
    bold = [w for r in runs if "bold" in (r["formats"] or []) and (w := (r["text"] or "").strip())]
    spans = sorted((text.find(w), len(w)) for w in bold)
    if not spans or spans[0][0] < 0 or text[: spans[0][0]].strip():
        return False
    reach = spans[0][0]
    for start, size in spans:
        if start > reach:
            return False
        reach = max(reach, start + size)
    return not text[reach:].strip() and (not text.endswith(".") or text.endswith("…."))


@dataclass(frozen=True)
class Site:
    """How to read a site's pages."""

    content: tuple[str, ...] = ("article", "main", "body")
    content_class: str | None = None
    chrome: tuple[str, ...] = ("ad", "share", "sharing", "related", "comments", "nav", "navigation", "footer", "sidebar", "social")
    skip_tags: tuple[str, ...] = ("nav", "footer", "header", "aside")
    max_images: int = 10
    subtitle: str = "none"  # none, first, or first_of_two


class Blocks:
    """Collects the blocks of a content tree."""

    def __init__(self, site: Site, base: str = ""):
        self.site, self.base, self.out = site, base, []
        self.seen: set[str] = set()

    def text(self, kind: str, node: Node, level: int | None = None) -> None:
        runs = runs_of(node)
        text = text_of(runs)
        if text:
            if kind == "paragraph" and looks_like_heading(text, runs):
                kind, level = "heading", 4
            styled = [r for r in runs if r["href"] or r["formats"]]
            self.out.append({"type": kind, "text": text, "level": level, "src": None, "caption": None, "runs": runs if styled else None})

    def image(self, node: Node, caption: str | None = None) -> None:
        src = image_source(node, self.base)
        key = re.sub(r"=s\d+(?:-c)?$", "", (src or "").split("?")[0])
        if src and key not in self.seen and len(self.seen) < self.site.max_images:
            self.seen.add(key)
            self.out.append({"type": "image", "text": None, "level": None, "src": src, "caption": caption or None, "runs": None})

    def walk(self, node: Node) -> None:
        for child in node.children:
            if isinstance(child, str):
                if child.strip():
                    self.text("paragraph", Node("p", {}, [child]))
                continue
            if child.tag in OPAQUE or child.tag in self.site.skip_tags or child.classes() & set(self.site.chrome) or child.tag in ("h1", "h6"):
                continue
            if child.tag == "p":
                self.paragraph(child)
            elif child.tag in HEADINGS:
                self.text("heading", child, HEADINGS[child.tag])
            elif child.tag == "h5":
                self.text("paragraph", child)
            elif child.tag == "li":
                self.text("list_item", child)
            elif child.tag == "figure":
                caption = child.find(lambda n: n.tag == "figcaption")
                for img in child.all("img"):
                    self.image(img, re.sub(r"\s+", " ", caption.text()).strip() if caption else None)
                for frame in child.all("iframe"):
                    self.video(frame)
            elif child.tag == "img":
                self.image(child)
            elif child.tag in ("iframe", "video"):
                self.video(child)
            else:
                self.walk(child)

    def video(self, node: Node) -> None:
        src = video_embed(node.attrs.get("src") or node.attrs.get("data-src"))
        if src:
            self.out.append({"type": "video", "text": None, "level": None, "src": src, "caption": None, "runs": None})

    def paragraph(self, node: Node) -> None:
        """A paragraph cut at its line breaks, wrappers kept; its media follow the text before them."""
        for part in split_at_breaks(node):
            self.text("paragraph", part)
            for n in part.all("img", "iframe", "video"):
                self.image(n) if n.tag == "img" else self.video(n)


def split_at_breaks(node: Node) -> list[Node]:
    """Copies of a node, one for each stretch between <br>, however deep the breaks are."""
    parts = [Node(node.tag, node.attrs)]
    for child in node.children:
        if isinstance(child, Node) and child.tag == "br":
            parts.append(Node(node.tag, node.attrs))
        elif isinstance(child, Node) and child.find(lambda n: n.tag == "br"):
            first, *rest = split_at_breaks(child)
            parts[-1].children.append(first)
            parts += [Node(node.tag, node.attrs, [r]) for r in rest]
        else:
            parts[-1].children.append(child)
    return parts


def empty_embed(node: Node) -> bool:
    """A wrapper of embedded media without any player in it."""
    return any("embed" in " ".join(n.classes()) and not n.all("iframe", "video") for n in node.all("figure", "div"))


def article(html: str | None, site: Site = Site(), base: str = "") -> dict:
    """title, subtitle, paragraphs, images, blocks of a page."""
    root = parse(html)
    heading = root.find(lambda n: n.tag == "h1")
    name = re.sub(r"\s+", " ", heading.text()).strip() if heading else ""
    if not name:
        found = root.find(lambda n: n.tag == "title")
        name = re.sub(r"\s+", " ", found.text()).strip() if found else ""
    content = None
    if site.content_class:
        content = root.find(lambda n: site.content_class in n.classes())
    for tag in site.content:
        content = content or root.find(lambda n, tag=tag: n.tag == tag)
    out = Blocks(site, base)
    out.walk(content or root)
    bare = lambda t: re.sub(r"\s+", "", t or "")
    blocks = [b for b in out.out if not (b["text"] and bare(b["text"]) == bare(name))]
    texts = [b["text"] for b in blocks if b["text"]]
    subtitle = texts[0] if texts and (site.subtitle == "first" or (site.subtitle == "first_of_two" and len(texts) > 1)) else ""
    return {"title": name, "subtitle": subtitle, "paragraphs": texts or [name], "images": [b["src"] for b in blocks if b["type"] == "image"], "blocks": blocks}


ARROW_RUN = pa.struct([("text", pa.string()), ("href", pa.string()), ("formats", pa.list_(pa.string()))])
ARROW_BLOCK = pa.struct([("type", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("src", pa.string()), ("caption", pa.string()), ("runs", pa.list_(ARROW_RUN))])
SCHEMA = f"id long, title string, subtitle string, paragraphs array<string>, images array<string>, blocks array<{BLOCK}>"


def with_basic_references(html: Column) -> Column:
    """The page as a reader sees it that knows no references but &lt; &gt; &amp;: all others, and those cut short, stand for themselves."""
    return F.regexp_replace(html, r"&(?!(?:lt|gt|amp);)", "&amp;")


def extract(pages: DataFrame, site: Site = Site(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The article of each page; a page without markup gives an empty one."""
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                found = [article(h, site, u or "") for u, h in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)]
                names = ["title", "subtitle", "paragraphs", "images"]
                columns = [pa.array([f[n] for f in found], k) for n, k in zip(names, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *columns, pa.array([f["blocks"] for f in found], pa.list_(ARROW_BLOCK))], ["id", *names, "blocks"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(read, SCHEMA)
