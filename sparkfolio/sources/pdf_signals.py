"""What a PDF says besides its text: page boxes, annotations, labels, bookmarks, form fields, attachments, tags, images, permissions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.session import ship_package
from sparkfolio.sources.pdf import File, Ref, text_string

MAX_ITEMS = 10_000
SAFE_SCHEMES = ("http", "https", "mailto", "tel", "ftp")
#: fixed values: what the bits of an encryption dictionary's P allow, by bit position from 1
PERMISSIONS = {3: "print", 4: "modify_contents", 5: "copy", 6: "modify_annotations", 9: "fill_interactive_forms", 10: "copy_for_accessibility", 11: "assemble", 12: "print_high_quality"}


def _box(file: File, value: object) -> tuple[float, float, float, float] | None:
    parts = [file.get(x) for x in value] if isinstance(value := file.get(value), list) else []
    if len(parts) != 4 or not all(isinstance(x, (int, float)) for x in parts):
        return None
    a, b, c, d = (round(float(x), 4) + 0.0 for x in parts)
    return min(a, c), min(b, d), max(a, c), max(b, d)


def page_geometry(file: File) -> list[dict]:
    """View box, rotation and user unit of each page; the view box is the crop box inside the media box."""
    out = []
    for n, page in enumerate(file.pages(), 1):
        media, crop = _box(file, page.get("MediaBox")), _box(file, page.get("CropBox"))
        if media and crop:
            cut = (max(media[0], crop[0]), max(media[1], crop[1]), min(media[2], crop[2]), min(media[3], crop[3]))
            view = cut if cut[2] > cut[0] and cut[3] > cut[1] else media
        else:
            view = crop or media or (0.0, 0.0, 612.0, 792.0)
        rotate = file.get(page.get("Rotate"))
        unit = file.get(page.get("UserUnit"))
        out.append({"page": n, "box": view, "rotation": rotate % 360 if isinstance(rotate, int) else 0, "user_unit": float(unit) if isinstance(unit, (int, float)) and unit > 0 else 1.0})
    return out


def annotations(file: File) -> list[dict]:
    out = []
    for n, page in enumerate(file.pages(), 1):
        found = file.get(page.get("Annots"))
        for ref in found[:MAX_ITEMS] if isinstance(found, list) else []:
            a = file.get(ref)
            if not isinstance(a, dict) or a.get("Subtype") == "Popup":
                continue
            action = file.get(a.get("A"))
            uri = file.get(action.get("URI")) if isinstance(action, dict) else None
            url = uri.decode("utf-8", "replace") if isinstance(uri, bytes) else None
            scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", url or "")
            out.append(
                {
                    "page": n, "kind": str(file.get(a.get("Subtype")) or ""), "box": _box(file, a.get("Rect")), "url": url,
                    "unsafe": bool(url) and bool(scheme) and scheme[1].lower() not in SAFE_SCHEMES, "contents": text_string(file.get(a.get("Contents"))) or None,
                }
            )
    return out


def number_tree(file: File, ref: object, depth: int = 0) -> list[tuple[int, object]]:
    node = file.get(ref)
    if not isinstance(node, dict) or depth > 20:
        return []
    nums = file.get(node.get("Nums"))
    out = [(k, v) for k, v in zip(nums[::2], nums[1::2], strict=False) if isinstance(k, int)] if isinstance(nums, list) else []
    kids = file.get(node.get("Kids"))
    for kid in kids[:MAX_ITEMS] if isinstance(kids, list) else []:
        out += number_tree(file, kid, depth + 1)
    return out


def name_tree(file: File, ref: object, depth: int = 0) -> list[tuple[bytes, object]]:
    node = file.get(ref)
    if not isinstance(node, dict) or depth > 20:
        return []
    names = file.get(node.get("Names"))
    out = [(k, v) for k, v in zip(names[::2], names[1::2], strict=False) if isinstance(k, bytes)] if isinstance(names, list) else []
    kids = file.get(node.get("Kids"))
    for kid in kids[:MAX_ITEMS] if isinstance(kids, list) else []:
        out += name_tree(file, kid, depth + 1)
    return out


def roman(n: int) -> str:
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += sign * (n // value)
        n %= value
    return out


def page_labels(file: File) -> list[str] | None:
    """A label for each page: that of the last range that starts at or before it; null without ranges."""
    root = file.get(file.trailer.get("Root"))
    ranges = sorted((k, v) for k, v in ((k, file.get(v)) for k, v in number_tree(file, root.get("PageLabels"))) if isinstance(v, dict)) if isinstance(root, dict) and "PageLabels" in root else []
    if not ranges:
        return None
    out = []
    for index in range(len(file.pages())):
        held = [r for r in ranges if r[0] <= index]
        if not held:
            out.append(str(index + 1))
            continue
        start, rule = held[-1]
        first = file.get(rule.get("St"))
        n = (first if isinstance(first, int) else 1) + index - start
        style = file.get(rule.get("S"))
        body = {"D": str(n), "r": roman(n), "R": roman(n).upper(), "a": chr(97 + (n - 1) % 26) * ((n - 1) // 26 + 1), "A": (chr(97 + (n - 1) % 26) * ((n - 1) // 26 + 1)).upper()}.get(style, "")
        out.append(text_string(file.get(rule.get("P"))) + body)
    return out


def form_fields(file: File) -> list[dict]:
    """Leaf fields with their full names, kinds and values, inherited where they have none of their own."""
    root = file.get(file.trailer.get("Root"))
    form = file.get(root.get("AcroForm")) if isinstance(root, dict) else None
    top = file.get(form.get("Fields")) if isinstance(form, dict) else None
    out: list[dict] = []
    seen: set[int] = set()
    kinds = {"Tx": "text", "Btn": "button", "Ch": "choice", "Sig": "signature"}

    def walk(ref: object, name: str, kind: object, value: object, depth: int) -> None:
        if isinstance(ref, Ref):
            if int(ref) in seen:
                return
            seen.add(int(ref))
        node = file.get(ref)
        if not isinstance(node, dict) or depth > 40 or len(out) >= MAX_ITEMS:
            return
        own = text_string(file.get(node.get("T")))
        name = f"{name}.{own}" if name and own else name or own
        kind, value = file.get(node.get("FT")) or kind, file.get(node.get("V")) if "V" in node else value
        kids = file.get(node.get("Kids"))
        inner = [k for k in kids if isinstance(file.get(k), dict) and "T" in file.get(k)] if isinstance(kids, list) else []
        if inner:
            for kid in inner:
                walk(kid, name, kind, value, depth + 1)
        else:
            shown = text_string(value) if isinstance(value, bytes) else str(value) if isinstance(value, (str, int, float)) else None
            out.append({"name": name, "kind": kinds.get(str(kind), "unknown"), "value": shown, "box": _box(file, node.get("Rect"))})

    for ref in top if isinstance(top, list) else []:
        walk(ref, "", None, None, 0)
    return out


def attachments(file: File) -> list[dict]:
    root = file.get(file.trailer.get("Root"))
    names = file.get(root.get("Names")) if isinstance(root, dict) else None
    out = []
    for key, ref in name_tree(file, names.get("EmbeddedFiles")) if isinstance(names, dict) else []:
        spec = file.get(ref)
        if not isinstance(spec, dict):
            continue
        held = file.get(spec.get("EF"))
        stream = (held.get("UF") or held.get("F")) if isinstance(held, dict) else None
        body = file.stream(int(stream)) if isinstance(stream, Ref) else b""
        name = text_string(file.get(spec.get("UF")) or file.get(spec.get("F"))) or text_string(key)
        out.append({"name": name.replace("\\", "/").rsplit("/", 1)[-1], "size": len(body), "sha256": hashlib.sha256(body).hexdigest()})
    return out


def structure(file: File) -> dict:
    """Whether the file is tagged, and how many elements of each role its structure tree has."""
    root = file.get(file.trailer.get("Root"))
    mark = file.get(root.get("MarkInfo")) if isinstance(root, dict) else None
    tree = file.get(root.get("StructTreeRoot")) if isinstance(root, dict) else None
    roles: dict[str, int] = {}
    stack, seen = [(tree, 0)], set()
    while stack and len(seen) < 200_000:
        ref, depth = stack.pop()
        if isinstance(ref, Ref):
            if int(ref) in seen:
                continue
            seen.add(int(ref))
        node = file.get(ref)
        if isinstance(node, list):
            stack += [(x, depth) for x in node]
        elif isinstance(node, dict) and depth < 200:
            role = file.get(node.get("S"))
            if isinstance(role, str):
                roles[role] = roles.get(role, 0) + 1
            if "K" in node:
                stack.append((node["K"], depth + 1))
    return {"tagged": isinstance(mark, dict) and file.get(mark.get("Marked")) is True, "has_tree": isinstance(tree, dict), "roles": roles}


def image_signals(file: File) -> list[dict]:
    """Images in the resources of each page: name, size in pixels, and whether they are masks."""
    out = []
    for n, page in enumerate(file.pages(), 1):
        resources = file.get(page.get("Resources"))
        objects = file.get(resources.get("XObject")) if isinstance(resources, dict) else None
        for name, ref in sorted(objects.items()) if isinstance(objects, dict) else []:
            head = file.get(ref)
            if isinstance(head, dict) and head.get("Subtype") == "Image":
                w, h = file.get(head.get("Width")), file.get(head.get("Height"))
                out.append({"page": n, "name": name, "width": w if isinstance(w, int) else 0, "height": h if isinstance(h, int) else 0, "mask": file.get(head.get("ImageMask")) is True})
    return out


def permissions(value: int) -> list[str]:
    return [name for bit, name in PERMISSIONS.items() if value >> (bit - 1) & 1]


def linearized(raw: bytes) -> bool:
    """Whether the first object is a linearization dictionary."""
    head = re.search(rb"\d+\s+\d+\s+obj\s*<<(.*?)>>", raw[:2048], re.S)
    return bool(head) and b"/Linearized" in head[1]


_BOX = pa.struct([(k, pa.float64()) for k in ("left", "bottom", "right", "top")])
_BOX_SQL = "struct<left:double,bottom:double,right:double,top:double>"
_KINDS = {
    "geometry": (page_geometry, [("page", pa.int32(), "int"), ("box", _BOX, _BOX_SQL), ("rotation", pa.int32(), "int"), ("user_unit", pa.float64(), "double")]),
    "annotations": (annotations, [("page", pa.int32(), "int"), ("kind", pa.string(), "string"), ("box", _BOX, _BOX_SQL), ("url", pa.string(), "string"), ("unsafe", pa.bool_(), "boolean"), ("contents", pa.string(), "string")]),
    "fields": (form_fields, [("name", pa.string(), "string"), ("kind", pa.string(), "string"), ("value", pa.string(), "string"), ("box", _BOX, _BOX_SQL)]),
    "attachments": (attachments, [("name", pa.string(), "string"), ("size", pa.int64(), "long"), ("sha256", pa.string(), "string")]),
    "images": (image_signals, [("page", pa.int32(), "int"), ("name", pa.string(), "string"), ("width", pa.int32(), "int"), ("height", pa.int32(), "int"), ("mask", pa.bool_(), "boolean")]),
    "outline": (lambda f: [{"depth": d, "title": t} for d, t in f.outline()], [("depth", pa.int32(), "int"), ("title", pa.string(), "string")]),
    "labels": (lambda f: [{"page": n, "label": x} for n, x in enumerate(page_labels(f) or [], 1)], [("page", pa.int32(), "int"), ("label", pa.string(), "string")]),
    "roles": (lambda f: [{"role": k, "elements": v} for k, v in sorted(structure(f)["roles"].items())], [("role", pa.string(), "string"), ("elements", pa.int64(), "long")]),
}


def signals(files: DataFrame, kind: str) -> DataFrame:
    """One projection of PDF files (path, content): path, the fields of the kind, error. Each is a plan of its own; what is not asked for is not made."""
    make, fields = _KINDS[kind]
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [{"path": path, **r} for r in _KINDS[kind][0](File(raw or b""))]
                except Exception as e:  # one bad file must not end the job
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"[:200]})
            for r in rows:
                if isinstance(r.get("box"), tuple):
                    r["box"] = dict(zip(("left", "bottom", "right", "top"), r["box"], strict=True))
            columns = [("path", pa.string()), *((n, t) for n, t, _ in _KINDS[kind][1]), ("error", pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in columns], [n for n, _ in columns])

    schema = ", ".join(["path string", *(f"`{n}` {sql}" for n, _, sql in fields), "error string"])
    return files.select("path", "content").mapInArrow(run, schema)


def presence(files: DataFrame) -> DataFrame:
    """Which signals a file has, as flags, from one look at its bytes: no object is parsed."""
    has = lambda mark: F.contains(F.decode("content", "ISO-8859-1"), F.lit(mark))
    return files.select(
        "path", has("/StructTreeRoot").alias("structure"), has("/AcroForm").alias("form"), has("/Annots").alias("annotations"), has("/EmbeddedFiles").alias("attachments"),
        has("/Outlines").alias("outline"), has("/PageLabels").alias("labels"), has("/Encrypt").alias("encrypted"),
    )
