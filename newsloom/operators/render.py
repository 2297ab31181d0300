"""Run spans, format markers, content trees and HTML of content blocks."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType

#: Formats from the outside in.
NESTING = (("bold", "strong"), ("italic", "i"), ("underline", "u"), ("strikethrough", "s"))
ALLOWED = {
    "p": (), "h3": (), "h4": (), "ul": (), "li": (), "strong": (), "i": (), "u": (), "s": (), "br": (), "blockquote": (), "figure": (), "figcaption": (),
    "a": ("href",), "img": ("src",), "iframe": ("src",),
}


def spans(text: str, runs: list[dict] | None, formats: tuple[str, ...] | None = None) -> list[tuple[int, int, list[str]]]:
    """(start, end, formats) of formatted runs at their first place in the text; of overlapping ones the earlier wins."""
    found = []
    for order, run in enumerate(runs or []):
        body, marks = (run.get("text") or "").strip(), [f for f in run.get("formats") or [] if formats is None or f in formats]
        at = text.find(body) if body and marks else -1
        if at >= 0:
            found.append((at, order, at + len(body), marks))
    out, end = [], 0
    for at, _, stop, marks in sorted(found, key=lambda s: (s[0], s[1])):
        if at >= end:
            out.append((at, stop, marks))
            end = stop
    return out


def encode_markers(text: str, runs: list[dict] | None, max_runs: int = 100, max_chars: int = 100_000) -> str:
    """Bold spans as **…**; too many runs or characters leave the text plain."""
    if len(runs or []) > max_runs or len(text) > max_chars:
        return text
    out, at = [], 0
    for start, end, _ in spans(text, runs, ("bold",)):
        out += [text[at:start], "**", text[start:end], "**"]
        at = end
    return "".join([*out, text[at:]])


def decode_markers(text: str, runs: list[dict] | None = None) -> tuple[str, list[dict] | None]:
    """Text without ** and, unless there are runs already, the runs that the markers mean."""
    pieces = re.split(r"\*\*(.+?)\*\*", text or "")
    plain = "".join(pieces).replace("**", "")
    if runs or len(pieces) == 1:
        return plain, runs
    made = [{"text": p.replace("**", ""), "href": None, "formats": ["bold"] if k % 2 else []} for k, p in enumerate(pieces) if p.replace("**", "")]
    return plain, made


def wrap(children: list, formats: list[str]) -> list:
    """Children inside the tags of their formats, bold outermost."""
    for name, tag in reversed(NESTING):
        if name in formats:
            children = [{"tag": tag, "children": children}]
    return children


def inline(text: str, runs: list[dict] | None) -> list:
    """A paragraph's children: plain text and formatted spans; links are not rendered."""
    out, at = [], 0
    for start, end, formats in spans(text, runs):
        out += [text[at:start]] if text[at:start] else []
        out += wrap([text[start:end]], formats)
        at = end
    return out + ([text[at:]] if text[at:] else [])


def media_url(url: str | None) -> bool:
    return bool(re.match(r"(?i)(?:https?://[^/\s]|/embed/)", url or ""))


def figure(block: dict) -> dict:
    tag = "img" if block["type"] == "image" else "iframe"
    children = [{"tag": tag, "attrs": {"src": block["src"]}}]
    if block.get("caption"):
        children.append({"tag": "figcaption", "children": [block["caption"]]})
    return {"tag": "figure", "children": children}


def nodes_of_blocks(blocks: list[dict], max_images: int | None = None) -> list:
    """Content nodes: the first valid image leads; the cap counts it; list items join into lists.

    Images with an invalid source are dropped before they count; a cap of 0 keeps none.
    """
    blocks = [b for b in blocks if b["type"] not in ("image", "video") or media_url(b.get("src"))]
    images = [k for k, b in enumerate(blocks) if b["type"] == "image"]
    kept = set(images if max_images is None else images[:max_images])
    order = ([images[0]] if images and images[0] in kept else []) + [k for k in range(len(blocks)) if not images or k != images[0]]
    out: list = []
    for k in order:
        b = blocks[k]
        if b["type"] == "image":
            if k in kept:
                out.append(figure(b))
        elif b["type"] == "video":
            out.append(figure(b))
        elif b["type"] == "heading":
            out.append({"tag": "h4" if b.get("level") == 4 else "h3", "children": [b["text"]]})
        elif b["type"] == "list_item":
            item = {"tag": "li", "children": inline(b["text"], b.get("runs"))}
            if out and isinstance(out[-1], dict) and out[-1]["tag"] == "ul":
                out[-1]["children"].append(item)
            else:
                out.append({"tag": "ul", "children": [item]})
        elif b.get("text"):
            out.append({"tag": "p", "children": inline(b["text"], b.get("runs"))})
    return out


def nodes_of_paragraphs(paragraphs: list[str], images: list[str], every: int = 3) -> list:
    """Paragraphs with an image after every third, the remaining images at the end."""
    left = [i for i in images if media_url(i)]
    out: list = []
    for k, p in enumerate(paragraphs, 1):
        out.append({"tag": "p", "children": [p]})
        if k % every == 0 and left:
            out.append(figure({"type": "image", "src": left.pop(0)}))
    return out + [figure({"type": "image", "src": i}) for i in left]


def preview_nodes(blocks: list[dict] | None, paragraphs: list[str], images: list[str], max_images: int | None = None) -> list:
    return nodes_of_blocks(blocks, max_images) if blocks else nodes_of_paragraphs(paragraphs, images)


def to_html(node: dict | str) -> str:
    """Escaped HTML of a node; a tag outside the allow-list drops its subtree, an unsafe URL its attribute."""
    if isinstance(node, str):
        return html.escape(node, quote=False)
    tag = node.get("tag")
    if tag not in ALLOWED:
        return ""
    attrs = "".join(
        f' {k}="{html.escape(v, quote=True)}"' for k, v in (node.get("attrs") or {}).items() if k in ALLOWED[tag] and media_url(v)
    )
    if tag in ("br", "img"):
        return f"<{tag}{attrs}>"
    return f"<{tag}{attrs}>{''.join(map(to_html, node.get('children') or []))}</{tag}>"


def page(title: str, subtitle: str, nodes: list) -> str:
    head = f"<h1>{html.escape(title or '')}</h1>" + (f"<p><em>{html.escape(subtitle)}</em></p>" if subtitle else "")
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title or "")}</title></head><body>{head}{"".join(map(to_html, nodes))}</body></html>'


@pandas_udf(StringType())
def rendered(title: pd.Series, subtitle: pd.Series, blocks_json: pd.Series, paragraphs_json: pd.Series) -> pd.Series:
    """The preview page of an article; blocks and paragraphs come as JSON."""
    out = []
    for t, s, b, p in zip(title, subtitle, blocks_json, paragraphs_json, strict=True):
        blocks, paragraphs = json.loads(b) if b else None, json.loads(p) if p else []
        full = [{"runs": None, "text": None, "src": None, "level": None, "caption": None} | x for x in blocks or []]
        out.append(page(t or "", s or "", preview_nodes(full, paragraphs, [])))
    return pd.Series(out)


def marked_paragraphs(paragraphs: list[str], blocks: list[dict] | None) -> list[str]:
    """Paragraphs with the bold runs of the prose blocks in the same place; those beyond the blocks stay plain."""
    prose = [b.get("runs") for b in blocks or [] if isinstance(b, dict) and b.get("type") in ("lead", "paragraph", "heading", "list_item")]
    return [encode_markers(p, runs) for p, runs in zip(paragraphs, prose, strict=False)] + paragraphs[len(prose) :]


@pandas_udf(StringType())
def user_message(source_name: pd.Series, title: pd.Series, subtitle: pd.Series, paragraphs_json: pd.Series, blocks_json: pd.Series) -> pd.Series:
    """The article as JSON for a translation call: names, title, subtitle and marked paragraphs, without blocks."""
    out = []
    for n, t, s, p, b in zip(source_name, title, subtitle, paragraphs_json, blocks_json, strict=True):
        body = marked_paragraphs(json.loads(p) if p else [], json.loads(b) if b else None)
        out.append(json.dumps({"source_name": n, "title": t, "subtitle": s, "paragraphs": body}, ensure_ascii=False))
    return pd.Series(out)


@pandas_udf(IntegerType())
def json_depth(values: pd.Series) -> pd.Series:
    """How deep objects and lists of a JSON text nest; null if it is no JSON."""

    def depth(x: object) -> int:
        inner = x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
        return (1 + max(map(depth, inner), default=0)) if isinstance(x, (dict, list)) else 0

    def one(text: str | None) -> int | None:
        try:
            return depth(json.loads(text)) if text is not None else None
        except (ValueError, RecursionError):
            return None

    return values.map(one).astype("Int32")
