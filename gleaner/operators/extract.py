"""Decoding bodies and extracting clean documents from HTML, with the standard library only.

A page is parsed once into a light tree; every later step is a walk over it.
``extract_pages`` runs on Arrow batches, one page at a time.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import trim

# Elements without content, elements that hold no text of the page, and block elements.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NOISE = {"script", "style", "noscript", "nav", "footer", "header", "aside", "form", "iframe", "svg", "button"}
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "time"}
AD_NAME = re.compile(r"(^|[-_ ])(ad|ads|advert|banner|sponsor|cookie|popup)s?([-_ ]|$)", re.I)
CONTENT_NAME = re.compile(r"article|content|main|post|entry", re.I)
QA_NAME = re.compile(r"question|answer|reply|faq", re.I)
ANSWER_NAME = re.compile(r"answer|reply", re.I)
SEMANTIC_LEAST, SEMANTIC_RATIO, SHELL_MOST, EMPTY_MOST, SEVERE = 500, 0.55, 50, 20, 0.02

SCHEMA = (
    "page_id long, title string, method string, status string, n_paragraphs int, text string, "
    "sections array<struct<section_type:string,text:string,start:int,end:int,heading_path:array<string>>>"
)


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self):
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                todo += reversed(node.children)
        return tidy(" ".join(out))

    def name(self) -> str:
        return f"{self.attrs.get('id', '')} {self.attrs.get('class', '')}".strip()

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.open.tag == "p":  # a paragraph ends where the next begins
            self.open = self.open.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.children.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.open.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.open))

    def handle_endtag(self, tag):
        node = self.open
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.open = node.parent

    def handle_data(self, data):
        self.open.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def tidy(text: str) -> str:
    return unicodedata.normalize("NFC", " ".join(text.split()))


def drop_noise(root: Node) -> None:
    """Cut navigation, scripts, hidden parts and advertisements out of the tree."""
    for node in list(root.walk()):
        hidden = node.attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", node.attrs.get("style", ""), re.I)
        if node.parent and (node.tag in NOISE or hidden or AD_NAME.search(node.name())):
            node.parent.children.remove(node)


def blocks(root: Node) -> list[tuple[str, str]]:
    """(tag, text) of the block elements, each text once; the whole text if there is none."""
    seen: dict[str, str] = {}
    for node in root.all(*BLOCKS):
        text = node.text()
        if len(text) >= 2:
            seen.setdefault(text, node.tag)
    if not seen and (text := root.text()):
        return [("p", text)]
    return [(tag, text) for text, tag in seen.items()]


def semantic_root(root: Node) -> Node:
    """article, main, role=main, a content-like id or class, body, or everything: the first there is."""
    rules = (
        lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main",
        lambda n: CONTENT_NAME.search(n.attrs.get("id", "")), lambda n: CONTENT_NAME.search(n.attrs.get("class", "")), lambda n: n.tag == "body")
    nodes = list(root.walk())
    return next((n for rule in rules for n in nodes if rule(n)), root)


def densest_root(root: Node) -> Node:
    """The container with most text and paragraphs for its link text."""
    def density(n: Node) -> float:
        return len(n.text()) + 100 * len(n.all("p")) - 1.5 * sum(len(a.text()) for a in n.all("a"))

    found = root.all("article", "main", "section", "div")
    return max(found, key=density) if found else next(iter(root.all("body")), root)


def linked_types(root: Node) -> set[str]:
    """Lower-case ``@type`` values of all JSON-LD blocks."""
    out: set[str] = set()
    for node in root.all("script"):
        if "ld+json" not in node.attrs.get("type", "").lower():
            continue
        try:
            todo = [json.loads("".join(c for c in node.children if isinstance(c, str)))]
        except ValueError:
            continue
        while todo:
            v = todo.pop()
            if isinstance(v, dict):
                kind = v.get("@type", [])
                out |= {str(k).lower() for k in ([kind] if isinstance(kind, str) else kind)}
            todo += v.values() if isinstance(v, dict) else v if isinstance(v, list) else []
    return out


def qa_sections(root: Node) -> list[tuple[str, str, list[str]]]:
    out, seen = [], set()
    for node in root.walk():
        if not QA_NAME.search(node.name()):
            continue
        up = node.parent
        while up is not None and not QA_NAME.search(up.name()):
            up = up.parent
        if up is not None:
            continue  # inside another marked part
        kind = "answer" if ANSWER_NAME.search(node.name()) else "question"
        text = "\n\n".join(t for _, t in blocks(node))
        if text and (kind, text) not in seen:
            seen.add((kind, text))
            out.append((kind, text, []))
    return out


def content_sections(root: Node, title: str | None) -> list[tuple[str, str, list[str]]]:
    """Runs of blocks between headings, each with the path of headings above it."""
    out: list[tuple[str, str, list[str]]] = []
    path: list[str] = []
    held: list[str] = []
    at: list[str] = []
    for tag, text in blocks(root):
        if re.fullmatch("h[1-6]", tag):
            if held:
                out.append(("content", "\n\n".join(held), at))
            path = [*path[: int(tag[1]) - 1], text]
            held, at = [text], path
        else:
            at = at if held else path
            held.append(text)
    if held:
        out.append(("content", "\n\n".join(held), at))
    return ([("title", title, [])] if title else []) + [s for s in out if s[1] != title]


def with_offsets(sections: list[tuple[str, str, list[str]]]) -> tuple[str, list[dict]]:
    at, out = 0, []
    for kind, text, path in sections:
        out.append({"section_type": kind, "text": text, "start": at, "end": at + len(text), "heading_path": list(path)})
        at += len(text) + 2
    return "\n\n".join(s["text"] for s in out), out


def extract(html: str, severe: bool = False) -> dict:
    """Title, method, status, sections with offsets into the text, and the text."""
    root = parse(html)
    title = next((t for n in root.all("title", "h1") if (t := n.text())), None)
    visible = tidy(" ".join(n.text() for n in root.children if isinstance(n, Node) and n.tag not in ("script", "style")))
    if len(visible) < SHELL_MOST and root.all("script"):
        return {"title": title, "method": None, "status": "JS_SHELL", "n_paragraphs": 0, "text": "", "sections": []}
    types = linked_types(root)
    drop_noise(root)
    semantic, dense = semantic_root(root), densest_root(root)
    length = lambda n: len("\n\n".join(t for _, t in blocks(n)))
    good = length(semantic) >= SEMANTIC_LEAST and length(semantic) >= SEMANTIC_RATIO * length(dense)
    chosen, method = (semantic, "semantic") if good else (dense, "density")
    marked = sum(bool(QA_NAME.search(n.name())) for n in root.walk())
    sections = qa_sections(chosen) if marked >= 2 or types & {"qapage", "question", "answer"} else []
    if sections:
        method += "+qa"
        if title and title not in {s[1] for s in sections}:
            sections.insert(0, ("title", title, []))
    else:
        sections = content_sections(chosen, title)
    text, placed = with_offsets(sections)
    status = "EXTRACTION_FAILED" if severe else "EMPTY_CONTENT" if len(text) <= EMPTY_MOST else "SUCCESS"
    paragraphs = sum(1 for s in placed if s["section_type"] != "title")
    return {"title": title, "method": method, "status": status, "n_paragraphs": paragraphs, "text": text, "sections": placed}


def decode(body: bytes, content_type: str | None) -> tuple[str, str, bool]:
    """(text, encoding, severe): the first of header, byte order mark, meta tag, detector and UTF-8 that decodes strictly."""
    def known(name: str | None) -> str | None:
        try:
            return codecs.lookup(name.strip()).name if name else None
        except LookupError:
            return None

    header = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type or "", re.I)
    marks = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
    meta = re.search(rb"<meta[^>]+charset\s*=\s*[\"']?([\w.:-]+)", body[:16384], re.I)
    order = [known(header and header[1]), next((n for m, n in marks if body.startswith(m)), None), known(meta and meta[1].decode("ascii"))]
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(body).best() if body else None
        order.append(known(best and best.encoding))
    except ImportError:  # the detector is optional
        pass
    for name in dict.fromkeys([*order, "utf-8"]):
        if name:
            try:
                return unicodedata.normalize("NFC", body.decode(name)), name, False
            except (LookupError, UnicodeDecodeError):
                continue
    text = unicodedata.normalize("NFC", body.decode("utf-8", "replace"))
    return text, "utf-8", text.count("�") > SEVERE * max(1, len(text))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page (page_id, html): title, method, status, text and sections."""
    def run(frames):
        for pdf in frames:
            rows = [{"page_id": i, **extract(h or "")} for i, h in zip(pdf.page_id, pdf.html, strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return pages.select("page_id", "html").mapInPandas(run, SCHEMA)


def written_title(html: Column, entities: dict[str, str]) -> Column:
    """The first plain ``<title>`` as the page's source has it, empty if there is none.

    The ``entities`` are replaced one after the other and runs of ASCII blanks become one
    space; nothing else is decoded or composed, unlike the title of ``extract``.
    """
    out = F.regexp_extract(html, "<title>([^<]*)</title>", 1)
    for name, char in entities.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return trim(F.regexp_replace(out, r"[\t\n\f\r ]+", " "))


def probe(html: str) -> dict:
    """Structure counts and the template class of a page."""
    root = parse(html)
    types = linked_types(root)
    n = lambda *t: len(root.all(*t))
    text = " ".join(x.text() for x in root.children if isinstance(x, Node)).lower()
    marked = sum(bool(QA_NAME.search(x.name())) for x in root.walk())
    if re.search("captcha|access denied|please log in", text):
        kind = "ACCESS_RESTRICTED"
    elif n("script") and n("p") == 0 and len(text) < 200:
        kind = "JAVASCRIPT_HEAVY"
    elif marked >= 2 or types & {"qapage", "question"}:
        kind = "Q_AND_A"
    elif "newsarticle" in types or n("time"):
        kind = "NEWS"
    else:
        kind = "GENERIC" if n("article", "p") else "UNKNOWN"
    return {"n_paragraphs": n("p"), "n_links": n("a"), "n_scripts": n("script"), "n_headings": n("h1", "h2", "h3"), "template": kind}


PROBE_SCHEMA = "page_id long, n_paragraphs int, n_links int, n_scripts int, n_headings int, template string"


def probe_pages(pages: DataFrame) -> DataFrame:
    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([{"page_id": i, **probe(h or "")} for i, h in zip(pdf.page_id, pdf.html, strict=True)], columns=[c.split()[0] for c in PROBE_SCHEMA.split(", ")])

    return pages.select("page_id", "html").mapInPandas(run, PROBE_SCHEMA)


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, position, href) of all anchors, in order, from the stored HTML."""
    hrefs = F.regexp_extract_all("html", F.lit(r"<a\s[^>]*href=\"([^\"]*)\""), F.lit(1))
    return pages.select("page_id", F.posexplode(hrefs).alias("position", "href"))


def body_status(expected: DataFrame, bodies: DataFrame) -> DataFrame:
    """Every expected id with what became of its body."""
    joined = expected.join(bodies.select("id", F.length("body").alias("size")), "id", "left")
    return joined.select("id", F.when(F.col("size").isNull(), "MISSING_BODY").when(F.col("size") == 0, "EMPTY_BODY").otherwise("READY").alias("status"))
