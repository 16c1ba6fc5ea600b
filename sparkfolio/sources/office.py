"""Files as Markdown sections: Office Open XML and EPUB with the standard library's zip and XML readers, PDF, HTML, delimited and plain text.

Files are rows of the binaryFile source; each row is converted in an Arrow batch, and a bad file keeps its row with an error.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkfolio.session import ship_package
from sparkfolio.sources import html, pdf
from sparkfolio.sources.tabular import csv_to_markdown, markdown_table, number

MAX_ENTRIES = 10_000
MAX_ENTRY = 200 << 20
MAX_TOTAL = 512 << 20
Section = tuple[str, str]


class Archive:
    """A ZIP container within limits: entries, bytes of one entry, bytes of all that is read."""

    def __init__(self, raw: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        if len(self.zip.infolist()) > MAX_ENTRIES:
            raise ValueError(f"more than {MAX_ENTRIES} entries")
        self.names = set(self.zip.namelist())
        self.spent = 0

    def read(self, name: str) -> bytes | None:
        if name not in self.names:
            return None
        size = self.zip.getinfo(name).file_size
        self.spent += size
        if size > MAX_ENTRY or self.spent > MAX_TOTAL:
            raise ValueError("the container inflates beyond the limit")
        return self.zip.read(name)

    def xml(self, name: str) -> ElementTree.Element | None:
        raw = self.read(name)
        if raw is None:
            return None
        if b"<!ENTITY" in raw[:4096]:
            raise ValueError("entity declarations are not read")
        return ElementTree.fromstring(raw)

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """Relationship id -> (type, target path) of a part."""
        folder, name = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id", "")] = (r.get("Type", "").rsplit("/", 1)[-1], target)
        return out

    def properties(self) -> dict[str, str]:
        root = self.xml("docProps/core.xml")
        keys = {"title": "title", "creator": "author", "created": "created", "subject": "subject"}
        return {keys[local(e)]: e.text.strip() for e in (root if root is not None else ()) if local(e) in keys and (e.text or "").strip()}


def local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def attr(e: ElementTree.Element, name: str, default: str = "") -> str:
    for k, v in e.attrib.items():
        if k.rsplit("}", 1)[-1] == name:
            return v
    return default


def child(e: ElementTree.Element | None, *path: str) -> ElementTree.Element | None:
    for name in path:
        e = next((c for c in e if local(c) == name), None) if e is not None else None
    return e


def every(e: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in e.iter() if local(x) == name)


# --- spreadsheets ---


def _excel_date(value: float, code: str) -> str:
    at = datetime(1899, 12, 30) + timedelta(days=value)
    if "h" in code and not re.search("[yd]", code):
        return at.strftime("%H:%M:%S")
    return at.strftime("%Y-%m-%d %H:%M:%S") if value % 1 else at.strftime("%Y-%m-%d")


def xlsx(raw: bytes) -> list[Section]:
    """One section a sheet: its cells as a table."""
    zip_ = Archive(raw)
    book = zip_.xml("xl/workbook.xml")
    relations = zip_.relations("xl/workbook.xml")
    root = zip_.xml("xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in every(si, "t")) for si in root] if root is not None else []
    styles, codes = [], {14: "yyyy-mm-dd", 15: "d", 16: "d", 17: "my", 18: "h", 19: "h", 20: "h", 21: "h", 22: "yyyy h", 45: "h", 46: "h", 47: "h"}
    sheet_styles = zip_.xml("xl/styles.xml")
    if sheet_styles is not None:
        for f in every(sheet_styles, "numFmt"):
            bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", attr(f, "formatCode").lower())
            if re.search("[ymdhs]", bare) and not re.search("general", bare):
                codes[int(attr(f, "numFmtId", "0"))] = bare
        xfs = child(sheet_styles, "cellXfs")
        styles = [codes.get(int(attr(x, "numFmtId", "0"))) for x in xfs] if xfs is not None else []
    out = []
    for sheet in every(book, "sheet"):
        name, (_, path) = attr(sheet, "name"), relations.get(attr(sheet, "id"), ("", ""))
        page = zip_.xml(path)
        rows: list[list[str]] = []
        for row in every(page, "row") if page is not None else ():
            cells: list[str] = []
            for c in row:
                letters = re.match("[A-Z]+", attr(c, "r"))
                if letters:
                    column = 0
                    for ch in letters[0]:
                        column = column * 26 + ord(ch) - 64
                    cells += [""] * (min(column, 16_384) - 1 - len(cells))
                kind, value = attr(c, "t", "n"), child(c, "v")
                text = (value.text or "") if value is not None else ""
                if kind == "s" and text:
                    text = shared[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in every(c, "t"))
                elif kind == "b":
                    text = "TRUE" if text == "1" else "FALSE"
                elif kind == "n" and text:
                    style = int(attr(c, "s", "0"))
                    code = styles[style] if style < len(styles) else None
                    text = _excel_date(float(text), code) if code else number(float(text))
                cells.append(text)
            rows.append(cells)
        table = markdown_table(rows) or "(empty sheet)"
        out.append((name, table if re.fullmatch(r"Sheet\d+", name) else f"## {name}\n\n{table}"))
    return out


# --- text documents ---


class _Docx:
    def __init__(self, raw: bytes):
        self.zip = Archive(raw)
        self.main = next((t for k, t in self.zip.relations("").values() if k == "officeDocument"), "word/document.xml")
        self.relations = self.zip.relations(self.main)
        self.styles, self.levels, self.starts, self.counts = {}, {}, {}, {}
        root = self.zip.xml("word/styles.xml")
        for s in every(root, "style") if root is not None else ():
            name, base, level = child(s, "name"), child(s, "basedOn"), child(s, "pPr", "outlineLvl")
            self.styles[attr(s, "styleId")] = (attr(name, "val").lower() if name is not None else "", attr(base, "val") if base is not None else None, attr(level, "val") if level is not None else None)
        root = self.zip.xml("word/numbering.xml")
        if root is not None:
            kinds: dict[str, dict[int, tuple[str, int]]] = {}
            for a in every(root, "abstractNum"):
                for lvl in (x for x in a if local(x) == "lvl"):
                    form, start = child(lvl, "numFmt"), child(lvl, "start")
                    kinds.setdefault(attr(a, "abstractNumId"), {})[int(attr(lvl, "ilvl", "0"))] = (attr(form, "val") if form is not None else "decimal", int(attr(start, "val", "1")) if start is not None else 1)
            for n in (x for x in root if local(x) == "num"):
                ref = child(n, "abstractNumId")
                abstract = attr(ref, "val") if ref is not None else ""
                self.levels[attr(n, "numId")] = (abstract, kinds.get(abstract, {}))
        self.notes = {}
        for kind in ("footnote", "endnote"):
            root = self.zip.xml(f"word/{kind}s.xml")
            for n in every(root, kind) if root is not None else ():
                self.notes[kind, attr(n, "id")] = n
        self.used: list[tuple[str, str]] = []

    def heading(self, style: str) -> int | None:
        seen = set()
        while style and style not in seen:
            seen.add(style)
            name, base, level = self.styles.get(style, (style.lower(), None, None))
            if name == "title":
                return 1
            found = re.fullmatch(r"heading ?([1-9])", name)
            if found:
                return min(6, int(found[1]))
            if level is not None and level.isdigit() and int(level) < 9:
                return min(6, int(level) + 1)
            style = base or ""
        return None

    def marker(self, num: str, level: int) -> str | None:
        if num not in self.levels:
            return None
        abstract, kinds = self.levels[num]
        form, start = kinds.get(level, ("decimal", 1))
        if form in ("bullet", "none"):
            return "-"
        counts = self.counts.setdefault(abstract, {})
        counts[level] = counts.get(level, start - 1) + 1
        for deeper in [k for k in counts if k > level]:
            del counts[deeper]
        return f"{counts[level]}."

    def inline(self, node: ElementTree.Element) -> str:
        out = []
        for e in node:
            tag = local(e)
            if tag == "r":
                text = "".join(
                    (x.text or "") if local(x) == "t" else "\t" if local(x) == "tab" else "\n" if local(x) in ("br", "cr") else self.note(local(x)[:-9], x) if local(x) in ("footnoteReference", "endnoteReference") else ""
                    for x in e
                )
                props = child(e, "rPr")
                on = lambda name: props is not None and (p := child(props, name)) is not None and attr(p, "val", "1") not in ("0", "false")  # noqa: B023, E731
                bare = text.strip()
                if bare and on("b"):
                    text = text.replace(bare, f"**{bare}**")
                if bare and on("i"):
                    text = text.replace(bare, f"*{bare}*")
                out.append(text)
            elif tag == "hyperlink":
                target = self.relations.get(attr(e, "id"), ("", ""))[1]
                body = self.inline(e)
                out.append(f"[{body.strip()}]({target})" if target and body.strip() else body)
            elif tag in ("ins", "moveTo", "smartTag", "sdt", "sdtContent", "fldSimple"):
                out.append(self.inline(e))
            elif tag in ("oMath", "oMathPara"):
                out.append("$" + "".join(t.text or "" for t in every(e, "t")) + "$")
        return "".join(out).replace("****", "").replace("** **", " ")

    def note(self, kind: str, e: ElementTree.Element) -> str:
        key = (kind, attr(e, "id"))
        if key not in self.used:
            self.used.append(key)
        return f"[^{self.used.index(key) + 1}]"

    def blocks(self, body: ElementTree.Element) -> list[str]:
        out: list[str] = []
        for e in body:
            if local(e) == "p":
                props = child(e, "pPr")
                text = self.inline(e).strip()
                if not text:
                    continue
                style = child(props, "pStyle")
                level = self.heading(attr(style, "val")) if style is not None else None
                num, ilvl = child(props, "numPr", "numId"), child(props, "numPr", "ilvl")
                if level:
                    out.append(f"{'#' * level} {' '.join(text.replace('**', '').split())}")
                elif num is not None and (mark := self.marker(attr(num, "val"), depth := int(attr(ilvl, "val", "0")) if ilvl is not None else 0)):
                    line = "  " * depth + f"{mark} {text}"
                    if out and re.match(r"\s*(?:-|\d+\.) ", out[-1].rsplit("\n", 1)[-1]):
                        out[-1] += "\n" + line
                    else:
                        out.append(line)
                else:
                    out.append(text)
            elif local(e) == "tbl":
                rows = []
                for tr in (x for x in e if local(x) == "tr"):
                    cells: list[str] = []
                    for tc in (x for x in tr if local(x) == "tc"):
                        cells.append(" ".join(" ".join(self.blocks(tc)).split()))
                        span = child(tc, "tcPr", "gridSpan")
                        cells += [""] * (min(64, int(attr(span, "val", "1"))) - 1 if span is not None else 0)
                    rows.append(cells)
                if table := markdown_table(rows):
                    out.append(table)
            elif local(e) in ("sdt", "sdtContent", "ins"):
                out += self.blocks(e)
        return out


def docx(raw: bytes) -> list[Section]:
    """The whole text as one section; notes follow in the order of their references."""
    doc = _Docx(raw)
    root = doc.zip.xml(doc.main)
    body = child(root, "body")
    blocks = doc.blocks(body) if body is not None else []
    for k, key in enumerate(doc.used):
        note = doc.notes.get(key)
        blocks.append(f"[^{k + 1}]: {' '.join(doc.blocks(note)) if note is not None else ''}")
    return [("document", "\n\n".join(blocks))]


# --- slides ---


def pptx(raw: bytes) -> list[Section]:
    """One section a slide in the deck's order: title, then shapes from the top, tables, notes as a quotation."""
    zip_ = Archive(raw)
    relations = zip_.relations("ppt/presentation.xml")
    deck = zip_.xml("ppt/presentation.xml")
    out = []
    for n, ref in enumerate(every(deck, "sldId"), 1):
        rid = next((v for k, v in ref.attrib.items() if k.endswith("}id")), "")
        path = relations.get(rid, ("", ""))[1]
        slide = zip_.xml(path)
        if slide is None:
            continue
        title, shapes = "", []
        for order, sp in enumerate(e for e in slide.iter() if local(e) in ("sp", "graphicFrame")):
            holder = next((attr(p, "type", "body") for p in every(sp, "ph")), None)
            if holder in ("dt", "ftr", "sldNum"):
                continue
            rows = [[" ".join("".join(t.text or "" for t in every(p, "t")) for p in every(tc, "p")) for tc in every(tr, "tc")] for tr in every(sp, "tr")]
            if rows:
                text = markdown_table(rows)
            else:
                lines = []
                for p in every(sp, "p"):
                    line = "".join(t.text or "" for t in every(p, "t")).strip()
                    props = child(p, "pPr")
                    level = int(attr(props, "lvl", "0")) if props is not None else 0
                    if line:
                        lines.append(line if holder in ("title", "ctrTitle") else "  " * level + f"- {line}")
                text = "\n".join(lines)
            if not text:
                continue
            if holder in ("title", "ctrTitle") and not title:
                title = " ".join(text.split())
                continue
            off = next(every(sp, "off"), None)
            place = (int(attr(off, "y", "0")) // 50_000, int(attr(off, "x", "0"))) if off is not None else None
            shapes.append((place, order, text))
        if all(s[0] is not None for s in shapes):
            shapes.sort(key=lambda s: s[0])
        parts = ([f"# {title}"] if title else []) + [s[2] for s in shapes]
        for kind, target in zip_.relations(path).values():
            notes = zip_.xml(target) if kind == "notesSlide" else None
            if notes is not None:
                said = [" ".join("".join(t.text or "" for t in every(p, "t")).split()) for sp in every(notes, "sp") if any(attr(ph, "type") == "body" for ph in every(sp, "ph")) for p in every(sp, "p")]
                if any(said):
                    parts.append("\n".join(f"> {x}" for x in said if x))
        out.append((f"slide {n}", "\n\n".join(parts)))
    return out


# --- books ---


def epub(raw: bytes) -> list[Section]:
    """One section a chapter of the spine that has text."""
    zip_ = Archive(raw)
    container = zip_.xml("META-INF/container.xml")
    path = next((attr(r, "full-path") for r in every(container, "rootfile")), "") if container is not None else ""
    package = zip_.xml(path)
    if package is None:
        raise ValueError("no package document")
    folder = posixpath.dirname(path)
    items = {attr(i, "id"): attr(i, "href") for i in every(package, "item")}
    out = []
    for ref in every(package, "itemref"):
        href = unquote(items.get(attr(ref, "idref"), ""))
        body = zip_.read(posixpath.normpath(posixpath.join(folder, href))) if href else None
        if body is None:
            continue
        text = html.to_markdown(body.decode("utf-8", "replace"))
        if text.strip():
            heading = re.search(r"(?m)^#{1,6} (.+)$", text)
            n = len(out) + 1
            out.append((f"chapter {n}: {heading[1]}" if heading else f"chapter {n}", text))
    return out


def text(raw: bytes) -> list[Section]:
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return [("text", raw[len(mark) :].decode(codec, "replace" if codec == "utf-8" else "strict"))]
    if re.search(rb"[\x00-\x08\x0b\x0e-\x1f]", raw[:8192]):
        raise ValueError("binary data")
    return [("text", raw.decode("utf-8", "replace"))]


READERS = {
    "xlsx": xlsx, "docx": docx, "pptx": pptx, "epub": epub, "text": text, "subtitles": text,
    "pdf": pdf.convert_bytes,
    "html": lambda raw: [("page", html.to_markdown(text(raw)[0][1]))],
    "csv": lambda raw: [("table", csv_to_markdown(text(raw)[0][1]))],
    "tsv": lambda raw: [("table", csv_to_markdown(text(raw)[0][1], "\t"))],
}


def convert_bytes(kind: str | None, raw: bytes) -> list[Section]:
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}")
    return READERS[kind](raw)


def convert(files: DataFrame) -> DataFrame:
    """Units (path, number, label, markdown, error) of files (path, format, content)."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, kind, raw in zip(*(batch.column(k).to_pylist() for k in ("path", "format", "content")), strict=True):
                try:
                    rows += [(path, n, label, body, None) for n, (label, body) in enumerate(convert_bytes(kind, raw or b""), 1)]
                except Exception as e:  # one bad file must not end the job
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "number", "label", "markdown", "error"])

    return files.select("path", "format", "content").mapInArrow(run, "path string, number int, label string, markdown string, error string")
