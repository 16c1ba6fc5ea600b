"""Headings, outline trees, and citation chunks: folds over one document's lines, made row by row in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.session import ship_package

CHUNK_UNITS = 1_800
_atx = re.compile(r"^(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?$")


def headings(markdown: str) -> list[tuple[int, str, int]]:
    """(level, title, byte offset) of ATX and Setext headings outside fences and comments."""
    out: list[tuple[int, str, int]] = []
    offset, fence, comment, before = 0, None, False, None
    for line in markdown.splitlines(keepends=True):
        at, offset = offset, offset + len(line.encode())
        text = line.rstrip()
        body = text.lstrip()
        indent = len(text) - len(body)
        mark = re.match(r"(`{3,}|~{3,})", body) if indent <= 3 else None
        if fence is None and (comment or body.startswith("<!--")):
            comment, before = "-->" not in body, None
        elif mark:
            if fence is None:
                fence = mark[1]
            elif mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and body.strip(fence[0]).strip() == "":
                fence = None
            before = None
        elif fence is None and indent <= 3 and not text.startswith("\t"):
            atx = _atx.match(body)
            if atx:
                if (atx[2] or "").strip():
                    out.append((len(atx[1]), atx[2].strip(), at))
                before = None
            elif before and re.fullmatch(r"=+|-+", body):
                out.append((1 if body[0] == "=" else 2, *before))
                before = None
            else:
                before = (body, at) if body else None
        else:
            before = None
    return out


def outline(markdown: str) -> list[tuple[str, str, int, str, int, int]]:
    """(id, title, level, path, start, end) in preorder; a node ends where the next of its level or above starts."""
    found = headings(markdown)
    size = len(markdown.encode())
    out: list[tuple[str, str, int, str, int, int]] = []
    stack: list[tuple[int, str, str]] = [(0, "n1", "")]
    children = {"n1": 0}
    for k, (level, title, start) in enumerate(found):
        end = next((s for lv, _, s in found[k + 1 :] if lv <= level), size)
        while stack[-1][0] >= level:
            stack.pop()
        parent = stack[-1]
        children[parent[1]] += 1
        node = f"{parent[1]}.{children[parent[1]]}"
        children[node] = 0
        path = f"{parent[2]} > {title}" if parent[2] else title
        out.append((node, title, level, path, start, end))
        stack.append((level, node, path))
    return out


def utf16(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def chunks(elements: list[dict], semantic: bool = True) -> list[tuple[str, int, int, str, list[str], str]]:
    """(id, page_start, page_end, text, element_ids, strategy) of ordered elements (id, page, type, content, role).

    A heading, a table, a page's end, and more than CHUNK_UNITS UTF-16 units (one counted for each separator) start another chunk;
    a table is a chunk of its own.
    """
    out: list[tuple[str, int, int, str, list[str], str]] = []
    held: list[dict] = []
    size, strategy = 0, "page"

    def close() -> None:
        nonlocal held, size
        text = "\n".join(e["content"] for e in held).strip()
        if text:
            a, b = held[0]["page"], held[-1]["page"]
            name = f"p{a}" if a == b else f"p{a}-p{b}"
            out.append((f"{name}-chunk-{len(out) + 1}", a, b, text, [e["id"] for e in held], strategy))
        held, size = [], 0

    for e in elements:
        if not e["content"]:
            continue
        heading, table = semantic and e.get("role") == "heading", e.get("type") == "table"
        full = bool(held) and size + utf16(e["content"]) > CHUNK_UNITS
        if held and (heading or table or full or held[-1]["page"] != e["page"]):
            close()
        if not held:
            strategy = "semantic" if heading else "table" if table else "size" if full else "page"
        held.append(e)
        size += utf16(e["content"]) + 1
        if table:
            close()
    close()
    return out


def _explode(rows: DataFrame, id_cols: list[str], payload: str, make, fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, found = [], []
            for k, value in enumerate(batch.column(payload).to_pylist()):
                made = make(value)
                owner += [k] * len(made)
                found += made
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in id_cols), *(pa.array([r[i] for r in found], kind) for i, (_, kind, _) in enumerate(fields))], [*id_cols, *(f[0] for f in fields)]
            )

    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in id_cols), *(f"{n} {sql}" for n, _, sql in fields)])
    return rows.select(*id_cols, payload).mapInArrow(run, schema)


def _outline_of(text):
    return outline(text or "")


def outlines(docs: DataFrame, id_cols: list[str], markdown_col: str = "markdown") -> DataFrame:
    """Outline nodes of Markdown documents, one row a node."""
    s, i = pa.string(), pa.int64()
    fields = [("node_id", s, "string"), ("title", s, "string"), ("level", i, "long"), ("section_path", s, "string"), ("start_byte", i, "long"), ("end_byte", i, "long")]
    return _explode(docs, id_cols, markdown_col, _outline_of, fields)


def _chunks_of(items):
    return chunks(items or [])


def citation_chunks(elements: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Citation chunks of elements (id, page, element_id, line, content, role). A document's elements meet in one row."""
    item = F.struct("line", F.col("element_id").alias("id"), "page", F.lit("text").alias("type"), "content", "role")
    held = elements.groupBy(id_col).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    s, i = pa.string(), pa.int64()
    fields = [("chunk_id", s, "string"), ("page_start", i, "long"), ("page_end", i, "long"), ("text", s, "string"), ("element_ids", pa.list_(s), "array<string>"), ("strategy", s, "string")]
    return _explode(held, [id_col], "_items", _chunks_of, fields)


def title_of(markdown: Column) -> Column:
    """The first heading of level one, null without."""
    return F.nullif(F.regexp_extract(markdown, r"(?m)^# (.*)$", 1), F.lit(""))
