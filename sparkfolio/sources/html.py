"""HTML to Markdown, with the standard library's parser, one row at a time in Arrow batches; head facts natively."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.session import ship_package

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements whose content is not the document.
DROPPED = {"script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "textarea", "iframe", "svg", "canvas", "dialog", "head", "title", "input"}
#: fixed values: class and id names of what surrounds a document
NOISE = {
    "nav", "navbar", "navbox", "navigation", "menu", "footer", "sidebar", "cookie", "cookies", "consent", "gdpr", "banner", "breadcrumb", "breadcrumbs", "share", "sharing", "social", "advert",
    "advertisement", "ads", "promo", "newsletter", "subscribe", "popup", "modal", "editsection", "ambox", "hatnote", "toolbar", "noprint", "catlinks", "printfooter", "related", "comments", "skip",
    "sronly", "srtext", "visuallyhidden", "screenreadertext",
}
#: fixed values: roles of the same
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "menu", "menubar"}
BLOCKS = {"address", "article", "blockquote", "body", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
ENDS_P = BLOCKS - {"body", "html"}
MAX_DEPTH = 200


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P and any(n.tag == "p" for n in self.open[-3:]):
            self._close("p")
        if tag == "li" and self.open[-1].tag == "li":
            self._close("li")
        if tag in ("td", "th") and self.open[-1].tag in ("td", "th"):
            self.open.pop()
        if tag == "tr" and any(n.tag == "tr" for n in self.open[-2:]):
            self._close("tr")
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < MAX_DEPTH:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in self.open[1:]):
            self._close(tag)

    def _close(self, tag):
        while len(self.open) > 1:
            if self.open.pop().tag == tag:
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(text: str) -> Node:
    tree = _Tree()
    tree.feed(text)
    tree.close()
    return tree.root


def walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack += [c for c in reversed(n.children) if isinstance(c, Node)]


def plain(node: Node | str) -> str:
    if isinstance(node, str):
        return node
    if node.tag in ("script", "style"):
        return ""
    return "".join(plain(c) for c in node.children)


def _length(node: Node) -> int:
    return len(re.sub(r"\s+", " ", plain(node)).strip())


def main_content(root: Node) -> Node:
    """The dominant article; else main; else the body."""
    nodes = list(walk(root))
    body = next((n for n in nodes if n.tag == "body"), root)
    articles = [n for n in nodes if n.tag == "article"]
    if articles:
        sizes = [_length(n) for n in articles]
        best = max(range(len(sizes)), key=lambda i: (sizes[i], -i))
        if sizes[best] >= 200 and sizes[best] * 4 >= _length(body) and sizes[best] * 10 >= 6 * sum(sizes):
            return articles[best]
    return next((n for n in nodes if n.tag == "main" or n.attrs.get("role") == "main"), body)


def _noise(node: Node, total: int) -> bool:
    if node.tag in DROPPED or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true":
        return True
    if re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", node.attrs.get("style", "")) or node.attrs.get("role", "").lower() in NOISE_ROLES:
        return True
    if node.tag == "header" and not any(n.tag in ("h1", "h2") for n in walk(node)):
        return True
    names = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower()
    tokens = {*re.split(r"[\s_-]+", names), *re.sub("[_-]", "", names).split()}
    return not NOISE.isdisjoint(tokens) and _length(node) * 10 < 4 * total


class Renderer:
    def __init__(self, base: str, total: int):
        self.base, self.total = base, total

    def inline(self, node: Node | str) -> str:
        if isinstance(node, str):
            return re.sub(r"\s+", " ", node)
        if _noise(node, self.total):
            return ""
        body = "".join(self.inline(c) for c in node.children)
        tag, bare = node.tag, body.strip()
        if tag == "br":
            return "\n"
        if tag == "img":
            alt = node.attrs.get("alt", "").strip()
            return f"![{alt}]({urljoin(self.base, node.attrs['src'])})" if node.attrs.get("src") and not node.attrs["src"].startswith("data:") else alt
        if not bare:
            return " " if body else ""
        lead, tail = body[: len(body) - len(body.lstrip())], body[len(body.rstrip()) :]
        if tag in ("b", "strong"):
            return f"{lead}**{bare}**{tail}"
        if tag in ("i", "em"):
            return f"{lead}*{bare}*{tail}"
        if tag in ("code", "kbd", "samp"):
            ticks = "`" * (max((len(m) for m in re.findall("`+", bare)), default=0) + 1)
            return f"{lead}{ticks}{bare}{ticks}{tail}"
        if tag in ("s", "del"):
            return f"{lead}~~{bare}~~{tail}"
        href = node.attrs.get("href", "")
        if tag == "a" and href and not href.lower().startswith(("javascript:", "#")):
            return f"{lead}[{bare}]({urljoin(self.base, href)}){tail}"
        return body

    def blocks(self, node: Node) -> list[str]:
        out: list[str] = []
        run: list[str] = []

        def flush() -> None:
            lines = [re.sub(r"[ \t]+", " ", x).strip() for x in "".join(run).split("\n")]
            text = "\n".join(x for x in lines if x)
            if text:
                out.append(text)
            run.clear()

        for child in node.children:
            if isinstance(child, str) or (child.tag not in BLOCKS and not any(n.tag in BLOCKS for n in walk(child))):
                run.append(self.inline(child))
                continue
            if _noise(child, self.total):
                continue
            flush()
            out += self.block(child)
        flush()
        return out

    def block(self, node: Node) -> list[str]:
        tag = node.tag
        if re.fullmatch("h[1-6]", tag):
            title = " ".join("".join(self.inline(c) for c in node.children).split())
            return [f"{'#' * int(tag[1])} {title}"] if title else []
        if tag in ("ul", "ol"):
            return self.list(node)
        if tag == "pre":
            text = plain(node).strip("\n")
            fence = "`" * max(3, max((len(m) for m in re.findall("`+", text)), default=0) + 1)
            code = next((n for n in walk(node) if n.tag == "code"), node)
            lang = re.search(r"(?:language|lang)-([\w+#-]+)", f"{code.attrs.get('class', '')} {node.attrs.get('class', '')}")
            return [f"{fence}{lang[1] if lang else ''}\n{text}\n{fence}"] if text.strip() else []
        if tag == "blockquote":
            return ["\n".join(f"> {line}".rstrip() for line in "\n\n".join(self.blocks(node)).split("\n"))]
        if tag == "hr":
            return ["---"]
        if tag == "table":
            return self.table(node)
        if tag in ("dt", "summary"):
            text = " ".join(self.blocks(node))
            return [f"**{text}**"] if text else []
        return self.blocks(node)

    def list(self, node: Node) -> list[str]:
        items, number = [], int(node.attrs["start"]) if re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")) else 1
        for child in node.children:
            if not isinstance(child, Node) or child.tag != "li":
                continue
            body = "\n".join(self.blocks(child))
            if not body.strip():
                continue
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            items.append(mark + body.replace("\n", "\n" + " " * len(mark)))
        return ["\n".join(items)] if items else []

    def table(self, node: Node) -> list[str]:
        rows = []
        for tr in (n for n in walk(node) if n.tag == "tr"):
            cells: list[str] = []
            for cell in tr.children:
                if isinstance(cell, Node) and cell.tag in ("td", "th"):
                    cells.append(" ".join(" ".join(self.blocks(cell)).split()).replace("|", "\\|"))
                    span = cell.attrs.get("colspan", "1")
                    cells += [""] * (min(50, int(span)) - 1 if span.isdigit() and int(span) > 1 else 0)
            if any(cells):
                rows.append(cells)
        if not rows:
            return []
        width = max(map(len, rows))
        caption = next((" ".join(self.blocks(n)) for n in walk(node) if n.tag == "caption"), "")
        if width == 1:
            return [*([caption] if caption else []), *(r[0] for r in rows)]
        padded = [r + [""] * (width - len(r)) for r in rows]
        text = "\n".join(["|" + "|".join(padded[0]) + "|", "|" + "---|" * width, *("|" + "|".join(r) + "|" for r in padded[1:])])
        return [*([caption] if caption else []), text]


def to_markdown(text: str | None, base: str = "") -> str:
    if not text:
        return ""
    root = parse(text)
    found = next((n.attrs.get("href", "") for n in walk(root) if n.tag == "base"), "")
    main = main_content(root)
    return "\n\n".join(Renderer(urljoin(base, found), _length(main)).blocks(main))


def convert(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(id, markdown, error): a page that cannot be parsed keeps its row."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, errors = [], []
            for raw, url in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    done.append(to_markdown(raw, url or ""))
                    errors.append(None)
                except Exception as e:  # one bad page must not end the job
                    done.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string()), pa.array(errors, pa.string())], [id_col, "markdown", "error"])

    rows = pages.select(id_col, html_col, url_col)
    return rows.mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, markdown string, error string")


def _attribute(head: Column, element: str, name: str, value: str, wanted: str) -> Column:
    one = rf"(?is)<{element}\b[^>]*\b{name}\s*=\s*[\"']{value}[\"'][^>]*\b{wanted}\s*=\s*[\"']([^\"']*)[\"']"
    other = rf"(?is)<{element}\b[^>]*\b{wanted}\s*=\s*[\"']([^\"']*)[\"'][^>]*\b{name}\s*=\s*[\"']{value}[\"']"
    return F.coalesce(F.nullif(F.regexp_extract(head, one, 1), F.lit("")), F.nullif(F.regexp_extract(head, other, 1), F.lit("")))


def head_facts(text: Column) -> Column:
    """struct<title, description, author, lang, base> from the head, by built-in functions."""
    head = F.substring_index(text, "</head>", 1)
    title = F.nullif(F.trim(F.regexp_replace(F.regexp_extract(head, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), F.lit(""))
    return F.struct(
        F.coalesce(title, _attribute(head, "meta", "property", "og:title", "content")).alias("title"),
        F.coalesce(_attribute(head, "meta", "name", "description", "content"), _attribute(head, "meta", "property", "og:description", "content")).alias("description"),
        _attribute(head, "meta", "name", "author", "content").alias("author"),
        F.nullif(F.regexp_extract(head, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']([^\"']*)", 1), F.lit("")).alias("lang"),
        F.nullif(F.regexp_extract(head, r"(?is)<base\b[^>]*\bhref\s*=\s*[\"']([^\"']*)", 1), F.lit("")).alias("base"),
    )


def unescape(text: str) -> str:
    return html.unescape(text)
